"""Extra columns by the operators' helper names, in either case, pass through untouched; results replace only their own names."""

import re
import time

import pytest

import corpus_pipeline
from meshwright.llm import flac, html_extract, mixing, ngram_join, quality, secret_scan, toxicity

HELPERS = "key mask grams gram low clean hit time _s _key _id _size _range _last _whole _copy _rest _text score held_out predicted SCORE_ at_ first at _first _row _rules _grams _host _html _at _part host part c0 c1 c2 C30 in x v rows media pcm rate size target copies source_size SPANS_".split()


def wide(spark, rows, upper):
    """Rows of (doc_id, text, source) and a column for each helper name, with its own name as value."""
    names = [h.upper() if upper else h for h in HELPERS]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.toDF("Doc_ID", "TEXT", "Source") if upper else df, names


@pytest.mark.parametrize("upper", [False, True])
def test_clashing_columns(spark, upper):
    rows = [(1, "token=abcdefghijkl and more", "a"), (2, "a b c", None), (2, "a b c", None), (None, None, "a"), (3, "", "b"), (4, "a b c", "b")]
    df, names = wide(spark, rows, upper)
    from pyspark.sql import functions as F

    given = df.select("*", *[F.lit(n).alias(n) for n in names])
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    runs = {
        "scan": (secret_scan.scan(given), ["spans"]),
        "redact": (secret_scan.redact(given), []),
        "mix": (mixing.mix(given), ["size", "source_size", "target", "copies"]),
        "mixed": (mixing.mixed(given), []),
        "first": (ngram_join.first_of_each(given), []),
        "quality": (quality.classify(given, labels), ["held_out", "score", "predicted"]),
        "toxicity": (toxicity.classify(given, labels), ["held_out", "score", "predicted"]),
        "good": (corpus_pipeline.keep_good(spark, given, "/root/testdata/sf0.001"), []),
    }
    for name, (out, new) in runs.items():
        old = [c for c in given.columns if c.lower() not in new]
        assert out.columns == old + new, name
        got = out.collect()
        assert got or name == "good"
        for r in got:
            for c in set(names) & set(old):
                assert r[old.index(c)] == c, (name, c)
    texts = [r[1] for r in runs["redact"][0].collect()]
    assert sorted(map(str, texts)) == sorted(["[SECRET] and more", "a b c", "a b c", "a b c", "", "None"])
    pages = spark.createDataFrame([(1, "http://h.x/1", "<p>one</p>"), (2, None, None)], "page_id long, url string, html string")
    out = html_extract.extract(pages.select("*", *[F.lit(n).alias(n) for n in names]))
    assert sorted((r["page_id"], r["text"]) for r in out.collect()) == [(1, "one"), (2, "")] and [c for c in out.columns if c in names] == names
    stored = flac.store(given).select("doc_id", "media", *[F.lit(n).alias(n) for n in names if n.lower() not in ("media", "pcm", "rate")])
    assert flac.read(stored).filter("md5_ok and valid").count() == len(rows)


def test_many_matches_in_one_text(spark):
    one = "deadbeefdeadbeef "
    docs = spark.createDataFrame([(1, one * 32_000)], "doc_id long, text string")
    secret_scan.scan(docs.limit(0)).collect()
    began = time.perf_counter()
    (row,) = secret_scan.scan(docs).collect()
    assert len(row["spans"]) == 32_000 and [tuple(s)[:3] for s in row["spans"][-2:]] == [(17 * i, 2, 17 * i + 16) for i in (31_998, 31_999)]
    assert time.perf_counter() - began < 10
    began = time.perf_counter()
    assert secret_scan.redact(docs).first()["text"] == "[SECRET] " * 32_000
    assert time.perf_counter() - began < 20


KEYS = {
    "private_key": "-----BEGIN RSA PRIVATE KEY-----", "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh_-", "url_password": "postgres://user:pa55word@db.example.com", "aws_session": "ASIAABCDEFGHIJKLMNOP",
    "azure_key": "AccountKey=" + "Ab1+" * 12 + "==", "github": "ghp_" + "aB3" * 12, "github_fine": "github_pat_" + "aB3_" * 6, "gitlab": "glpat-" + "x-Y_z" * 4, "google_api": "AIza" + "b_C-d" * 7,
    "google_oauth": "ya29." + "a" * 20, "npm": "npm_" + "aZ09" * 9, "pypi": "pypi-" + "AgEI" * 4, "sendgrid": "SG." + "a" * 16 + "." + "b" * 16, "shopify": "shpat_" + "0aF1" * 8, "slack": "xoxb-1234567890-ab",
    "slack_hook": "hooks.slack.com/services/T000/B000/abcdefghij", "stripe": "sk_live_" + "a1B2" * 4,
}


def test_key_formats(spark):
    docs = spark.createDataFrame([(i, f"é see {v} here") for i, v in enumerate(KEYS.values())], "doc_id long, text string")
    assert [r.kind for r in secret_scan.MORE_RULES] == list(KEYS)
    for r in secret_scan.scan(docs).collect():
        kind, value = list(KEYS.items())[r["doc_id"]]
        assert (6, 6 + len(value), kind) in {(s["start"], s["end"], s["kind"]) for s in r["spans"]}, kind
    for r in secret_scan.MORE_RULES:
        assert secret_scan.trigram_query(r.regex) is not None and re.search(r.regex, KEYS[r.kind])
    clean = spark.createDataFrame([(1, "The github page, an SG. note, npm_ and https://example.com:80/a@b are no secrets; eyJ neither. -----BEGIN CERTIFICATE-----")], "doc_id long, text string")
    assert secret_scan.scan(clean).first()["spans"] == []
