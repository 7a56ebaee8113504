"""Near-duplicates, repeated passages and hashing, against brute force on small fixtures."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwright.llm import census, ngram_join, queries, substring_dedup, words

SF = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(texts):
    """Brute force: class of each index by the link rule."""
    s = [shingles(t) for t in texts]
    up = list(range(len(s)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            n = len(s[i] & s[j])
            if n and 100 * n >= 80 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(s))], [len(x) for x in s]


def near_copies(seed, n_bases=6, copies=12, words_each=60):
    rng = np.random.default_rng(seed)
    out = []
    for b in range(n_bases):
        base = [f"w{rng.integers(0, 40 if b % 2 else 4000)}" for _ in range(words_each + 10 * b)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.integers(0, 5)):
                t[rng.integers(0, len(t))] = f"X{rng.integers(0, 99)}"
            out.append(" ".join(t[rng.integers(0, 3) :]))
    return out


ODD = [None, "", " \t\n", "one", "ONE", "one two", "one  two", "a b c d", "a b c d e", "A B C D E", "a b c d e f", "ß ñ", "x y", "long " * 3000, "long " * 3001]


@pytest.mark.parametrize("block, group, hot", [(2048, 24, 1 << 20), (8, 3, 4)])
def test_join_matches_brute_force(spark, monkeypatch, block, group, hot):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    texts = near_copies(block) + ODD + near_copies(block)[:5]
    want, n = classes(texts)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, component_id int")
    got = sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in ngram_join.link(docs).collect())
    assert got == [(i, c, k) for i, (c, k) in enumerate(zip(want, n))]
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def morse(n, a, b):
    out = [a, b]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return "".join(out[:n])


def test_long_words_are_told_apart(spark):
    """Thue-Morse words, whose polynomials modulo 2**64 are equal for every base."""
    for n in (512, 2048, 65536):
        pair = [morse(n, "a", "b"), morse(n, "b", "a")]
        raw, off = words.text_buffers(pa.array(pair))
        assert len(set(words.word_hashes(raw, off[:-1], off[1:]).tolist())) == 2
    texts = [" ".join([f"{w}", *(f"v{i}" for i in range(34))]) for w in (morse(2048, "a", "b"), morse(2048, "b", "a"))]
    texts += [f"{w} a b c" for w in (morse(4096, "x", "y"), morse(4096, "y", "x"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.link(docs).collect()) == list(enumerate(classes(texts)[0]))
    assert [(r["n_words"], len(r["removed"])) for r in sorted(substring_dedup.dedup(docs).collect())] == [(35, 0), (35, 0), (4, 0), (4, 0)]


def test_shared_passages_make_no_candidates(spark, monkeypatch):
    """Documents that share half their text are not thrown together; large classes of near-copies are whole."""
    seen = []
    verify = ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda sets, near, tasks: seen.append(near) or verify(sets, near, tasks))
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join(f"o{rng.integers(0, 10**9)}" for _ in range(24)) + " " + passage for _ in range(300)]
    base = [f"b{i}" for i in range(120)]
    for i in range(150):
        t = list(base)
        t[int(rng.integers(0, 120))] = f"x{i}"
        texts.append(" ".join(t[: 120 - int(rng.integers(0, 4))]))
    far = list(base)
    far[40:58] = [f"f{i}" for i in range(18)]  # linked with few of the class only, if at all
    texts.append(" ".join(far))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.link(docs).collect())
    assert got == list(enumerate(classes(texts)[0]))
    assert max((r["count"] for r in seen[0].groupBy("component").count().collect()), default=0) <= 151


def test_one_row_of_each_class(spark):
    t = "a b c d e f g h i j"
    rows = [(3, t, 1), (3, t, 1), (3, t, 2), (3, None, 1), (3, "x y z", 1), (5, t, 1), (7, None, 1), (7, None, 1), (None, t, 1), (None, t, 2), (None, "other", 1), (None, None, 1), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = ngram_join.first_of_each(docs).collect()
    assert sorted((r["doc_id"] for r in got if r["doc_id"] is not None)) == [3, 7] and next(r for r in got if r["doc_id"] == 3)["text"] in (t, "x y z")
    assert sorted(str(r["text"]) for r in got if r["doc_id"] is None) == ["None", "None", t, "other"]
    assert ngram_join.first_of_each(docs.repartition(5)).exceptAll(ngram_join.first_of_each(docs)).count() == 0


def test_join_repeats_nulls_and_empty(spark):
    t = "a b c d e f g h i j"
    docs = spark.createDataFrame([(5, t), (5, t), (3, t.upper()), (None, t), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs).collect()), key=str)
    assert got == sorted([(5, 6, 3), (5, 6, 3), (3, 6, 3), (None, 6, None), (9, 0, 9)], key=str)
    assert ngram_join.link(docs.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in ngram_join.first_of_each(docs).collect()) == ["3", "9", "None"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=40).map(lambda x: sorted(set(x))), min_size=2, max_size=25))
def test_trie_finds_the_classes(sets):
    grams = np.array([g for s in sets for g in s], np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(int)
    links = ngram_join.trie_join(grams, bounds) if len(grams) else []
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    want = []
    for i in range(len(sets)):
        for j in range(i):
            n = len(set(sets[i]) & set(sets[j]))
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                want.append((i, j))
    p = len(sets) // 3
    across = ngram_join.trie_join(grams, bounds, p) if len(grams) else []
    two = list(range(len(sets)))
    for a, b in [x for x in want if p and (x[0] < p) != (x[1] < p)]:
        two = [two[a] if c == two[b] else c for c in two]
    one = list(range(len(sets)))
    for a, b in across if p else []:
        assert (max(a, b), min(a, b)) in set(want) and a < p <= b
        one = [one[a] if c == one[b] else c for c in one]
    assert len(set(one)) == len(set(two))
    for a, b in links:
        assert (max(a, b), min(a, b)) in set(want)  # only true links
        assert find(a) != find(b)  # a forest
        up[find(a)] = find(b)
    assert all(find(i) == find(j) for i, j in want)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400), st.floats(0, 1), st.integers(0, 2**31))
def test_prefix_bounds(a, b, f, seed):
    """Linked sets share as much of their prefixes as the filters assume, under random orders."""
    common = int(f * min(a, b))
    if 100 * common < 80 * (a + b - common):
        return
    rng = np.random.default_rng(seed)
    key = rng.permutation(a + b)
    x, y = np.sort(key[:a]), np.sort(np.concatenate([rng.permutation(key[:a])[:common], key[a : a + b - common]]))
    n = np.array([len(x), len(y)])
    p, least = ngram_join._prefix(n), int(min(n))
    px, py = set(x[: p[0]].tolist()), set(y[: p[1]].tolist())
    assert len(px & py) >= ngram_join._shared(np.array(least))
    order = rng.permutation(a + b)
    for sets, length in (((px, py), ngram_join._index), ((set(x.tolist()), set(y.tolist())), ngram_join._whole_index)):
        ix, iy = (set(sorted(s, key=lambda v: order[v])[:k]) for s, k in zip(sets, length(n).tolist()))
        assert len(ix & iy) >= ngram_join._seen(np.array(least))


def repeated(texts, k):
    w = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(x[i : i + k]) for x in w for i in range(len(x) - k + 1))
    out = []
    for x in w:
        gone = [False] * len(x)
        for i in range(len(x) - k + 1):
            if seen[tuple(x[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((len(x), sum(gone), b" ".join(v for v, g in zip(x, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("k", [3, 35])
def test_dedup_matches_brute_force(spark, k):
    rng = np.random.default_rng(k)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 12 if k == 3 else 3, rng.integers(0, 90))) for _ in range(40)]
    texts += [texts[3] + " " + texts[4], *ODD, "the " * 200, " ".join(map(str, range(200)))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = sorted(substring_dedup.dedup(docs, k).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["text"]) for r in rows] == repeated(texts, k)
    for r in rows:  # maximal: ascending with gaps
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


def test_dedup_repeats_nulls_and_empty(spark):
    t = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t + " x"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["text"]) for r in substring_dedup.dedup(docs).collect())
    assert got == [("1", 40, ""), ("1", 40, ""), ("None", 0, ""), ("None", 41, "x")]
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_queries_match_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    ids, texts = [d for d, _ in docs], [t for _, t in docs]
    want, n = classes(texts)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op1_ngram_join(spark, SF).collect())
    assert got == [(i, k, ids[c]) for i, k, c in zip(ids, n, want)]
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in queries.op2_substring_dedup(spark, SF).collect())
    assert got == [(i, a, b, hashlib.sha256(t.encode()).hexdigest()) for i, (a, b, t) in zip(ids, repeated(texts, 35))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85 aAzß東", max_size=30), max_size=8))
def test_words(texts):
    raw, off = words.text_buffers(pa.array(texts, pa.string()))
    starts, ends, row = words.spans(raw, off)
    got = [[] for _ in texts]
    for s, e, r in zip(starts, ends, row):
        got[r].append(raw[s:e].tobytes())
    assert got == [t.encode().split() for t in texts]
    h = words.word_hashes(raw, starts, ends, True)
    flat = [w.translate(LOWER) for t in texts for w in t.encode().split()]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing_codecs(values):
    v = np.array(sorted(values), np.uint64)
    assert (words.unpack_sorted(words.pack_sorted(v)) == v).all()
    assert (words.unplanes(words.planes(v, 8), 8) == v).all()
    assert (words.bucket_of(v, 7) < 7).all() and (np.diff(words.bucket_of(v, 7).astype(int)) >= 0).all()


def test_census_totals(spark):
    texts = ["a b c", "b c d", "c d e a", "a a a"] * 5 + ["z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def grams(column):
        raw, off = words.text_buffers(column)
        starts, ends, _ = words.spans(raw, off)
        return words.word_hashes(raw, starts, ends)

    told = {}
    for r in census.shared(census.chunked(docs), grams, 3).collect():
        told |= dict(zip(words.unpack_sorted(r["h"]).tolist(), words.unplanes(r["n"], 4).tolist()))
    want = Counter(w for t in texts for w in t.split())
    hashes = {w: int(grams(pa.array([w]))[0]) for w in want}
    assert told == {hashes[w]: n for w, n in want.items() if n > 1}
