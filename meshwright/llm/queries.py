"""The queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, flac, html_extract, mixing, ngram_join, packing, quality, secret_scan, substring_dedup, toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in secret_scan.BASE_RULES]
    digest = F.sha2(secret_scan.labelled(F.filter("spans", lambda s: s["kind"].isin(*base))), 256)
    return found.select("doc_id", *map(n, base), digest.alias("base_sha256"), secret_scan.labelled(F.col("spans")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = flac.read(flac.store(table(spark, sf_dir, "documents")))
    size = F.length("pcm").cast("long")
    tail = F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32")
    whole = (F.col("md5_ok") & F.forall("blocks", lambda b: b["crc_ok"])).alias("whole")
    return r.select("doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), tail, F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.size("blocks").alias("n_blocks"), whole)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_substring_dedup, op3_best_fit_packing, op4_secret_scan, op5_toxicity, op6_quality, op7_nearest_neighbours, op8_html_extraction, op9_mixing, op10_flac)
}



def _matches(order: int, r: secret_scan.Rule) -> str:
    regex = r.regex.replace("'", "''")
    return f"SELECT doc_id, '{r.kind}' kind, {order} ord, {r.least} least, string_split_regex(t, '{regex}') p, regexp_extract_all(t, '{regex}', 0) h, regexp_extract_all(t, '{regex}', {r.group}) v FROM d"


_WORDS = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op1_ngram_join": rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT r, md5(array_to_string(w[i:i + {ngram_join.SHINGLE - 1}], ' ')) h
  FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - {ngram_join.SHINGLE - 2}))) i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) n FROM g GROUP BY r),
p AS MATERIALIZED (SELECT a.r x, b.r y, count(*) s FROM g a JOIN g b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r),
k AS MATERIALIZED (SELECT x, y FROM p JOIN n u ON u.r = x JOIN n v ON v.r = y WHERE 100 * s >= {ngram_join.PERCENT} * (u.n + v.n - s)),
e AS MATERIALIZED (SELECT DISTINCT u.doc_id a, v.doc_id b FROM (SELECT x, y FROM k UNION ALL SELECT y, x FROM k) JOIN d u ON u.r = x JOIN d v ON v.r = y),
c(v, c) USING KEY (v) AS (SELECT DISTINCT a, a FROM e UNION (SELECT e.b, min(c.c) FROM c JOIN e ON e.a = c.v JOIN recurring.c x ON x.v = e.b WHERE c.c < x.c GROUP BY e.b))
SELECT doc_id, coalesce(n.n, 0)::BIGINT n_shingles, coalesce(c.c, doc_id) component_id FROM d LEFT JOIN n USING (r) LEFT JOIN c ON c.v = doc_id""",
    "op2_substring_dedup": rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') w FROM documents),
h AS MATERIALIZED (SELECT r, i, md5(array_to_string(w[i:i + {substring_dedup.WINDOW - 1}], ' ')) h FROM (SELECT r, w, unnest(range(1, len(w) - {substring_dedup.WINDOW - 2})) i FROM d WHERE len(w) >= {substring_dedup.WINDOW})),
gone AS MATERIALIZED (SELECT DISTINCT r, i + unnest(range({substring_dedup.WINDOW})) i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
word AS (SELECT r, unnest(w) word, unnest(range(1, len(w) + 1)) i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) t FROM word ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n.n, 0)::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)""",
    "op4_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
m AS ({" UNION ALL ".join(_matches(i, r) for i, r in enumerate(secret_scan.RULES))}),
s AS (
  SELECT doc_id, kind, ord, least, v[i] val,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) st, length(h[i]) len
  FROM (SELECT *, unnest(range(1, len(h) + 1)) i FROM m)),
g AS (SELECT * FROM s WHERE length(val) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') na, count(*) FILTER (kind = 'access') nc, count(*) FILTER (kind = 'hex') nh,
    string_agg(kind || ':' || st::BIGINT || ':' || (st + len)::BIGINT, ',' ORDER BY st, ord) FILTER (ord < 3) b,
    string_agg(kind || ':' || st::BIGINT || ':' || (st + len)::BIGINT, ',' ORDER BY st, ord) j FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(na, 0)::BIGINT n_assign, coalesce(nc, 0)::BIGINT n_access, coalesce(nh, 0)::BIGINT n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(j, '') spans
FROM d LEFT JOIN a USING (doc_id)""",
    "op9_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size,
    coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) nm, ('0x' || substr(md5('{mixing.SEED}:' || nm), 1, 15))::BIGINT k FROM documents),
s AS (SELECT source, sum(size)::BIGINT ss FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] w, row_number() OVER (ORDER BY source NULLS LAST) r, 3 * ss cap, sum(ss) OVER () total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE lev, row_number() OVER (ORDER BY cap / w, r) pl FROM w),
t AS (SELECT source, ss, least(cap::DOUBLE, (SELECT min_by(lev, pl) FROM l WHERE lev * w <= cap) * w) target FROM l),
u AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss)::BIGINT ELSE 0 END whole FROM t),
c AS (SELECT d.*, u.ss, u.target, u.whole, u.target - u.whole * u.ss rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY d.k, d.nm, d.size) upto
    FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, ss source_size, target, size * (whole + CASE WHEN 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END)::BIGINT taken FROM c""",
}
