"""Classifiers by held-out accuracy, neighbours by recall, and the pipeline stage by stage."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshwright.llm import ann, ngram_join, quality, queries, secret_scan, toxicity, words

SF = "/root/testdata/sf0.01"


def held(spark, name, target, sf=SF):
    got = queries.QUERIES[name](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    y, s = rows[target].to_numpy(), rows["score"].to_numpy()
    assert ((s >= 0) & (s <= 1)).all()
    order = np.argsort(np.argsort(s, kind="stable"))
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / max(1, (y == 1).sum() * (y == 0).sum())
    return rows, auc


def test_quality_held_out(spark):
    rows, auc = held(spark, "op6_quality", "quality")
    assert auc > 0.95
    assert rows[rows.quality == 1].predicted.mean() > 0.95 and rows[rows.quality == 0].predicted.mean() < 0.3


def test_toxicity_held_out(spark):
    rows, auc = held(spark, "op5_toxicity", "toxic")
    assert auc > 0.8 and rows[rows.toxic == 0].predicted.mean() < 0.05 and rows[rows.toxic == 1].predicted.mean() > 0.6
    rows, auc = held(spark, "op5_toxicity", "toxic", "/root/testdata/sf0.1")  # 305 learned toxic rows instead of 33
    assert auc > 0.9 and rows[rows.toxic == 0].predicted.mean() < 0.02 and rows[rows.toxic == 1].predicted.mean() > 0.85


def test_terms_that_come_often_are_second_terms():
    raw, off = words.text_buffers(pa.array(["one two one", "one two one one", None, "", "one " * 5000]))
    row, term = toxicity.present(raw, off)
    once, often = set(term[row == 0].tolist()), set(term[row == 1].tolist())
    assert once < often and {int(toxicity._SECOND[t]) for t in term[row == 4].tolist()} >= often - once and len(often - once) == 1
    assert not len(term[(row == 2) | (row == 3)])
    interest = np.zeros(1 << toxicity.BITS, bool)
    interest[list(often - once)] = True
    row, term = toxicity.present(raw, off, interest)
    assert row.tolist() == [1, 4] and set(term.tolist()) == often - once


@pytest.mark.parametrize("model, target", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_never_learned(spark, model, target):
    """Turning every held-out label around changes no score."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % model.MODULUS == model.REST
    turned = labels.withColumn(target, F.when(held, 1 - F.col(target)).otherwise(F.col(target)))
    a, b = ({r["doc_id"]: r["score"] for r in model.classify(docs, y).collect()} for y in (labels, turned))
    assert a == b


def test_votes_match_brute_force():
    """Nearest-neighbour votes, one document at a time."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 12)) for _ in range(60)]
    raw, off = words.text_buffers(pa.array(texts))
    made = quality.counts(raw, off)
    m = quality.train(made[:40], np.arange(40) % 2)
    for i, s in enumerate(m.score(raw, off)):
        v = m.place(made[i : i + 1])[0].astype(np.float64)
        sims = m.vectors.astype(np.float64) @ v
        near = np.argsort(-sims)[: quality.NEIGHBOURS]
        w = np.maximum(sims[near], 0)
        w = (w / w.max()) ** quality.SHARPNESS
        assert s == pytest.approx((w * m.labels[near]).sum() / w.sum(), abs=1e-3)


@pytest.mark.parametrize("model, target", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, model, target):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "a b c", 0.5), (3, "a b c", 0.5), (None, "x", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], f"doc_id long, {target} int")
    for labels in (none, spark.createDataFrame([(3, None), (3, 7), (77, 1), (None, 1)], f"doc_id long, {target} int"), spark.createDataFrame([(3, 1), (3, 1), (2, 1), (1, 0)], f"doc_id long, {target} int")):
        rows = model.classify(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
        assert model.classify(docs.limit(0), labels).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.15
    votes = np.stack([np.where(y, rng.random(4000) < r1, rng.random(4000) < r0) for r1, r0 in ((0.5, 0.002), (0.6, 0.004), (0.4, 0.001), (0.5, 0.003))], 1)
    votes = np.concatenate([votes, votes[:, :1], votes.sum(1, keepdims=True) == 0], 1)  # a copied voter, and one for silence
    p, rates, corr = toxicity.label_model(votes, 5)
    assert ((p > 0.5) == y).mean() > 0.97 and corr[0, 4] > 0.95
    assert np.allclose(rates[1][:4], [0.5, 0.6, 0.4, 0.5], atol=0.1)


def brute(vectors, ids, k=5):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        out[int(ids[q])] = np.sort(s)[::-1][:k]
    return out


def test_neighbour_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = brute(np.array(v.embedding.tolist(), float), v.vec_id.to_numpy())
    got = queries.op7_nearest_neighbours(spark, SF).toPandas()
    hits = sum((got[got.query_id == q].score.to_numpy() >= s[-1] - 1e-12).sum() for q, s in want.items())
    assert hits >= 0.9 * sum(map(len, want.values())) and (got.groupby("query_id").size() == 5).all()


def test_neighbours_in_many_lists_and_blocks(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((1200, 24)), np.tile(rng.standard_normal(24), (500, 1))])  # a hot vector
    ids = rng.permutation(len(x))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id % 50 = 0"), list_size=100, block=64, query_block=7).toPandas()
    want = brute(x, ids)
    hits = sum((got[got.query_id == q].score.to_numpy() >= s[-1] - 1e-9).sum() for q, s in want.items())
    assert hits >= 0.9 * 5 * len(want)
    hot = set(ids[1200:].tolist())
    for q in hot & set(want):  # ties go to the smaller id
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == sorted(hot - {q})[:5]
    by = dict(rows)
    for r in got.head(50).itertuples():
        a, b = np.array(by[r.query_id]), np.array(by[r.vec_id])
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_recall_over_many_lists(spark):
    """50,000 vectors in 62 lists: recall against brute force, a few lists probed, a part of the columns read."""
    rng = np.random.default_rng(9)
    middle = rng.standard_normal((400, 32))
    x = middle[rng.integers(0, 400, 50_000)] + 0.4 * rng.standard_normal((50_000, 32))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": pa.array(list(x))}))
    got = ann.search(df, df.filter("vec_id % 50 = 0")).toPandas().sort_values(["query_id", "rank"])
    u = ann.unit(x)
    hits = 0
    for q, own in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -9
        hits += (own.score.to_numpy() >= np.partition(s, -5)[-5] - 1e-12).sum()
    assert hits >= 0.9 * 5 * 1000 and len(got) == 5000
    sample = u[:16_384] @ ann.rotation(32)
    assert ann.probes_needed(sample, ann.centres(sample, 62), 5) <= 15


def test_neighbour_edges(spark):
    schema = "vec_id long, embedding array<float>, score string"
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 1.0], "x"), (1, [1.0, 1.0], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [float("nan"), 1.0], "x"), (5, [None, 1.0], "x"), (6, [float("inf"), 1.0], "x"), (7, [1.0], "x"), (None, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, schema)
    got = ann.search(df, df.filter("vec_id = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)] and got[0]["score"] == pytest.approx(0.5**0.5)
    assert ann.search(df.limit(0), df).count() == 0


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    near = int(np.argsort(-(x @ x[0]) / np.linalg.norm(x, axis=1))[1])
    once = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    more = spark.createDataFrame([(near, x[near].tolist())] * 400, once.schema)
    found = [[(r["rank"], r["vec_id"]) for r in ann.search(v, once.filter("vec_id = 0")).orderBy("rank").collect()] for v in (once, once.unionByName(more))]
    assert len(found[0]) == 5 and found[0] == found[1]


def test_repeated_rows_do_not_fill_a_list(spark):
    """A list of few vectors, one of them many times: the next list is probed too."""
    rng = np.random.default_rng(4)
    a = np.eye(8)[0] + 0.01 * rng.standard_normal((3, 8))
    b = np.eye(8)[1] + 0.1 * rng.standard_normal((300, 8))
    rows = [(i, r.tolist()) for i, r in enumerate([*a, *b])] + [(1, a[1].tolist())] * 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id = 0"), list_size=300).orderBy("rank").collect()
    assert len(got) == 5 and {got[0]["vec_id"], got[1]["vec_id"]} == {1, 2}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    from meshwright.plans.recovery import written

    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf), "test-stage"))
        if name != names[-1]:
            assert seen[-1].columns == docs.columns
    good, firsts, hidden, mixed, packed = seen[1:]
    kept = {r["doc_id"] for r in queries.op6_quality(spark, sf).filter("predicted = 1").collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(kept)
    assert sorted(r["doc_id"] for r in firsts.collect()) == sorted({r["component_id"] for r in ngram_join.link(good).collect()})
    assert secret_scan.scan(hidden).agg(F.sum(F.size("spans"))).first()[0] == 0 and hidden.count() == firsts.count()
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, sf).count() == packed.count()
