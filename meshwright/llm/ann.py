"""Approximate nearest neighbours by cosine: inverted lists scanned dimension block by dimension block.

Method: vectors are scaled to length 1 and rotated by a random orthogonal
matrix, so that any k of the d dimensions hold about k/d of a distance. Within
each probed list the candidates' partial squared distances grow one column
block at a time; a hypothesis test abandons a candidate as soon as its partial
distance is too large for its whole distance to be below the current k-th best.
Survivors are scored exactly, in double precision, on the original vectors.

The lists' centres are fitted on a bounded sample; every vector is indexed.
Lists are cut into blocks of bounded size, and so are the queries that probe a
list; each pair of blocks is a group of its own. So a list with a third of all
vectors is spread, and so is one that a third of all queries probe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
#: Vectors that the centres are fitted on, at most; vectors to a list, about; lists, at most (four sampled vectors each).
SAMPLE, LIST, MOST_LISTS = 16_384, 800, 4096
#: Lists are probed until they hold this share of the true neighbours of TRIALS sampled vectors within the sample.
COVER, TRIALS = 0.97, 512
#: Vectors and queries in a pair of blocks, about.
BLOCK, QUERIES = 8192, 4096
#: Columns in a block; significance of the test that abandons a candidate (larger: fewer are abandoned wrongly).
COLUMNS, EPSILON = 16, 2.1
SEED = 7


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: not null, all finite, not all zero."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    y = x / scale
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row with ``q``; scaled first where squares could overflow or vanish. Equal rows get equal values."""
    top = np.abs(x).max(1)
    if len(x) and (top.max() > 1e100 or top.min() < 1e-100) or not 1e-100 < np.abs(q).max() < 1e100:
        x, q = x / top[:, None], q / np.abs(q).max()
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The list of each row, block by block."""
    return np.concatenate([np.argmax(x[i : i + 1024] @ centre.T, 1) for i in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])


def centres(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Spherical k-means on rows of length 1; an emptied list restarts at a random row."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(sample, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero((sums * sums).sum(1) < 1e-12)
        sums[empty] = sample[rng.integers(0, len(sample), len(empty))]
        c = unit(sums)
    return c


def probes_needed(sample: np.ndarray, centre: np.ndarray, k: int, cover: float = COVER, trials: int = TRIALS) -> int:
    """How many of its nearest lists a vector probes so that ``cover`` of its k nearest in the sample lie in them."""
    own = nearest(sample, centre)
    ranks = []
    for i in range(0, min(trials, len(sample)), 64):
        q = sample[i : min(i + 64, trials)]
        sims = q @ sample.T
        sims[np.arange(len(q)), np.arange(i, i + len(q))] = -2
        near = np.argpartition(-sims, min(k, len(sample) - 1) - 1, axis=1)[:, :k] if len(sample) > 1 else np.zeros((len(q), 1), int)
        place = np.argsort(np.argsort(-(q @ centre.T), axis=1, kind="stable"), axis=1)
        ranks.append(np.take_along_axis(place, own[near], 1).ravel())
    return int(np.quantile(np.concatenate(ranks), cover)) + 1


def distinct_rows(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of the rows that repeat an id with equal components, in order of first sight; 0.0 and -0.0 are equal."""
    if len(np.unique(ids)) == len(ids):
        return ids, v
    first = list({(i, r.tobytes()): n for n, i, r in zip(range(len(ids) - 1, -1, -1), ids[::-1].tolist(), v[::-1] + 0.0)}.values())
    first.sort()
    return ids[first], v[first]


def scan_list(x: np.ndarray, q: np.ndarray, skip: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> np.ndarray:
    """Rows of ``x`` that survive as possible members of the ``k`` nearest to ``q`` (both rotated, of length 1)."""
    alive_all = np.flatnonzero(~skip)
    d = len(q)
    best = np.zeros(0)
    kept, dists = [], []
    at, step = 0, 256  # a first chunk sets the limit, larger ones follow
    while at < len(alive_all):
        alive = alive_all[at : at + step]
        at, step = at + step, 1024
        limit = np.partition(best, k - 1)[k - 1] if len(best) >= k else np.inf
        part = np.zeros(len(alive))
        for a in range(0, d, columns):
            b = min(a + columns, d)
            t = x[alive, a:b] - q[a:b]
            part += np.einsum("ij,ij->i", t, t)
            if b < d and limit < np.inf:
                ok = part <= limit * (b / d) * (1 + epsilon / np.sqrt(b)) ** 2 + 1e-9
                alive, part = alive[ok], part[ok]
                if not len(alive):
                    break
        ok = part <= limit + 1e-9
        kept.append(alive[ok])
        dists.append(part[ok])
        best = np.concatenate([best, part[ok]])
        if len(best) > 4 * k:
            best = np.partition(best, k - 1)[:k]
    kept, dists = np.concatenate(kept or [np.zeros(0, int)]), np.concatenate(dists or [np.zeros(0)])
    if len(dists) > k:
        kept = kept[dists <= np.partition(dists, k - 1)[k - 1] + 1e-9]
    return kept


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", cover: float = COVER, list_size: int = LIST, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found to each query, its own id left out.

    Nearness is the cosine in double precision on the original vectors, ties to the smaller vec_id. Vectors that are
    null, zero or hold null or non-finite components take no part, as queries or candidates; nor do vectors of another
    length than most have. Rows that repeat an id with equal components count once. With fewer than k candidates all
    are returned; an empty table gives no rows. Other columns, whatever their names, are not used. Any number of vectors
    and queries: a group holds about ``block`` vectors and ``query_block`` queries of one list, each vector is sent once
    for each block of queries of its list, each query once for each block of vectors of the lists that it probes.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    base = usable(vectors, id_col, vec_col)
    common = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return spark.createDataFrame([], schema)
    d, n = common[0]["d"], common[0]["count"]
    base = base.filter(F.size("v") == d)
    asked = usable(queries, id_col, vec_col).filter(F.size("v") == d)
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    turn = rotation(d)
    sample = unit(np.array(drawn.tolist(), float).reshape(-1, d)) @ turn
    lists = int(max(1, min(MOST_LISTS, n // list_size, len(np.unique(sample, axis=0)))))
    centre = centres(sample, lists)
    probes = probes_needed(sample, centre, k, cover)

    def assign(take: int, sizes: dict[int, int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                if not len(v):
                    continue
                near = (unit(v) @ turn) @ centre.T
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                raw = [r.tobytes() for r in np.ascontiguousarray(v)]
                if sizes is None:
                    where = [[w] for w in np.argmax(near, 1).tolist()]
                else:
                    where = []
                    for order in np.argsort(-near, axis=1, kind="stable").tolist():
                        got, own = 0, []
                        for w in order:  # lists in order of nearness; more than usual while they hold too few vectors
                            if len(own) >= take and got > k:
                                break
                            if sizes.get(w):
                                own.append(w)
                                got += sizes[w]
                        where.append(own)
                many = [len(w) for w in where]
                yield pa.RecordBatch.from_arrays([pa.array([x for w in where for x in w], pa.int32()), pa.array(np.repeat(ids, many), pa.int64()), pa.array([r for r, m in zip(raw, many) for _ in range(m)], pa.binary())], ["list", "id", "raw"])

        return run

    row = "list int, id bigint, raw binary"
    placed = base.mapInArrow(assign(1, None), row)
    counts = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).collect()  # one row per list, MOST_LISTS at most
    sizes = {r["list"]: r["ids"] for r in counts}
    probing = asked.mapInArrow(assign(probes, sizes), row)
    asking = {r["list"]: r["count"] for r in probing.groupBy("list").count().collect()}  # no more rows than that

    def cut(many: dict[int, int], size: int):
        """So many blocks to a list."""
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for w, n in many.items() for x in (w, -(-n // size))]), F.col("list")), F.lit(0)) if many else F.lit(0)

    subs, asks = cut({r["list"]: r["n"] for r in counts}, block), cut(asking, query_block)
    every = lambda n: F.explode(F.filter(F.sequence(F.lit(0), n), lambda i: i < n))  # noqa: E731  # none for a list without
    data = placed.withColumn("sub", F.pmod(F.xxhash64("id"), subs).cast("int")).withColumn("ask", every(asks)).withColumn("query", F.lit(False))
    probing = probing.withColumn("sub", every(subs)).withColumn("ask", F.pmod(F.xxhash64("id", F.lit(1)), asks).cast("int")).withColumn("query", F.lit(True))

    def scan(t: pa.Table) -> pa.Table:
        ask = t.column("query").to_numpy()
        ids = t.column("id").to_numpy()
        v = np.frombuffer(b"".join(t.column("raw").to_pylist()), float).reshape(-1, d)
        x_ids, x_raw = distinct_rows(ids[~ask], v[~ask])
        out: list[tuple] = []
        if len(x_raw) and ask.any():
            x = unit(x_raw) @ turn
            q_raw = v[ask]
            for qi, qv, qr in zip(ids[ask].tolist(), q_raw, unit(q_raw) @ turn):
                kept = scan_list(x, qr, x_ids == qi, k)
                score = cosine(x_raw[kept], qv)
                top = sorted(zip((-score).tolist(), x_ids[kept].tolist()))
                seen = list(dict.fromkeys(top))[:k]
                out += [(qi, i, -s) for s, i in seen]
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    found = data.unionByName(probing).groupBy("list", "sub", "ask").applyInArrow(scan, "query_id long, vec_id long, score double")
    found = found.distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
