"""Vertex programs and layouts on hand-made graphs, against plain Python."""

from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from meshwright.operators import graph as ops
from meshwright.operators import layout, reads
from meshwright.operators.components import connected_components
from meshwright.operators.graph import Graph
from meshwright.plans import programs
from meshwright.plans.superstep import metrics_frame


def both(pairs):
    return [*pairs, *[(b, a) for a, b in pairs]]


GRAPHS = {
    "single": [(0, 1)],
    "loop": [(0, 0), (0, 1), (1, 0)],
    "multi": [(0, 1)] * 3 + [(1, 0)] * 3,
    "gaps": [(0, 9), (9, 0)],
    "path": both([(i, i + 1) for i in range(40)]),
    "triangles": both([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]),
    "star": both([(0, i) for i in range(1, 60)]),
    "fan_in": [(1, 0), (2, 0)],
    "islands": both([(0, 1), (5, 6), (6, 7), (10, 11)]),
}


@pytest.fixture(params=GRAPHS)
def case(request, spark):
    pairs = GRAPHS[request.param]
    return pairs, Graph(spark.createDataFrame(pairs, "src long, dst long"))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def levels(pairs, root):
    out, near = {root: 0}, defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
    queue = deque([root])
    while queue:
        a = queue.popleft()
        for b in near[a]:
            if b not in out:
                out[b] = out[a] + 1
                queue.append(b)
    return out


def test_stats_degrees_offsets(case):
    pairs, g = case
    n = max(map(max, pairs)) + 1
    out, into = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    assert ops.stats(g.edges).first().asDict() == {"min_vert": min(map(min, pairs)), "max_vert": n - 1, "edge_count": len(pairs), "vert_count": n}
    assert rows(ops.degrees(g), "v", "degree") == [(v, out[v]) for v in range(n)]
    assert rows(ops.degrees(g, "dst"), "v", "degree") == [(v, into[v]) for v in range(n)]
    at, want = 0, []
    for v in range(n):
        want.append((v, at, at + out[v]))
        at += out[v]
    assert rows(layout.beg_pos(g), "v", "beg", "end") == want
    assert rows(layout.csr_slots(g), "slot", "v", "dst") == [(i, a, b) for i, (a, b) in enumerate(sorted(pairs))]


def test_bfs_and_components(case):
    pairs, g = case
    root = ops.max_degree_vertex(g.edges).first()["v"]
    assert root == min(Counter(a for a, _ in pairs).items(), key=lambda x: (-x[1], x[0]))[0]
    found = levels(pairs, root)
    assert rows(programs.bfs(g, root), "v", "level") == sorted(found.items())
    shallow = {v: d for v, d in found.items() if d <= 1}
    assert rows(programs.bfs(g, root, max_depth=1), "v", "level") == sorted(shallow.items())
    want = sorted((v, min(levels(both(pairs), v))) for v in {x for p in pairs for x in p})
    assert rows(programs.components(g), "v", "component") == want


def test_cores(case):
    pairs, g = case
    n = max(map(max, pairs)) + 1
    for k in (1, 2):
        alive, gone, r = set(range(n)), {}, 0
        deg = Counter(a for a, _ in pairs)
        while out := {v for v in alive if deg[v] <= k}:
            r += 1
            alive -= out
            gone |= dict.fromkeys(out, r)
            for a, b in pairs:
                if a in out and b in alive:
                    deg[b] -= 1
        got = {r["v"]: r for r in programs.kcore(g, k).collect()}
        assert {v: x["round"] for v, x in got.items()} == {v: gone.get(v) for v in range(n)}
        assert {v: got[v]["degree"] for v in alive} == {v: deg[v] for v in alive}


def test_rank_and_product(case):
    pairs, g = case
    n = max(map(max, pairs)) + 1
    deg = Counter(a for a, _ in pairs)
    rank = [1 / n] * n
    for _ in range(3):
        c = [rank[v] / deg[v] if deg[v] else 0 for v in range(n)]
        s = [0.0] * n
        for a, b in pairs:
            s[a] += c[b]
        rank = [0.85 * x + 0.15 for x in s]
    got = {r["v"]: r["rank"] for r in programs.pagerank(g, 3).collect()}
    assert got == pytest.approx(dict(enumerate(rank)))
    assert all(r["rank"] == 1 / n for r in programs.pagerank(g, 0).collect())
    y = [0] * n
    for a, b in pairs:
        y[a] += b * b
    assert rows(programs.spmv(g, g.vertices.select("v", (F.col("v") * F.col("v")).alias("x"))), "v", "y") == list(enumerate(y))


def test_many_sources(case):
    pairs, g = case
    n = max(map(max, pairs)) + 1
    sources = list(range(min(n, 5)))
    reached = programs.multi_source(g, sources).cache()
    want = sorted((s, v, d) for s in sources for v, d in levels(pairs, s).items())
    assert rows(programs.source_levels(reached, sources), "source", "v", "level") == want
    masks = defaultdict(int)
    for s, v, _ in want:
        masks[v] |= 1 << s
    assert rows(programs.source_masks(reached), "v", "mask") == sorted(masks.items())


def scan_cuts(cum, step, parts, n):
    return [0] + [min((i for i in range(1, n) if cum[i] >= k * step), default=n + 1) - 1 for k in range(1, parts)] + [n]


def test_balanced_partitions(case):
    pairs, g = case
    n, m = max(map(max, pairs)) + 1, len(pairs)

    def running(ends):
        c, out = Counter(ends), []
        for v in range(n):
            out.append((out[-1] if out else 0) + c[v])
        return out

    for r, c in ((2, 2), (3, 5)):
        cut = scan_cuts(running(a for a, _ in pairs), (m - 1) // r + 1, r, n)
        want = []
        for i in range(r):
            strip = [b for a, b in pairs if cut[i] <= a < cut[i + 1]]
            cols = scan_cuts(running(strip), (m - 1) // (r * c) + 1, c, n)
            want += [(i, j, cut[i], cut[i + 1], cols[j], cols[j + 1]) for j in range(c)]
        ranges = layout.partition_ultra(g, r, c).cache()
        assert rows(ranges, "row", "col", "row_beg", "row_end", "col_beg", "col_end") == want
        counts = Counter((i, j) for a, b in pairs for i, j, x, y, z, w in want if x <= a < y and z <= b < w)
        assert sum(counts.values()) == m
        got = layout.partition_edge_counts(g, ranges)
        assert rows(got, "row", "col", "edges") == sorted((*k, v) for k, v in counts.items())
        assert layout.validate_layout(layout.partition_beg_pos(g, ranges), got).count() == 0


def test_blocks(case):
    pairs, g = case
    order = sorted(pairs)
    first = {}
    for slot, (a, _) in enumerate(order):
        for blk in {slot // 4}:
            first.setdefault(blk, 0 if blk == 0 else a)
    assert rows(layout.block_index(g, 4), "blk", "beg_vert") == sorted(first.items())
    want = {slot // 4 for slot, (a, _) in enumerate(order) if a % 2 == 0}
    assert {r["blk"] for r in layout.frontier_blocks(g, F.col("v") % 2 == 0, 4).collect()} == want


@pytest.mark.parametrize("in_total", [False, True])
def test_chunks(spark, in_total):
    ids = [0, 1, 2, 5, 6, 7, 9, 20, 21, 22, 23, 24, 25, 26, 27, 28, 40, 42, 44, 46, 60]
    most, useless = 6, 3
    want, i = [], 0
    while i < len(ids):
        beg, end, n, gap = ids[i], ids[i] + 1, 1, 0
        i += 1
        while i < len(ids):
            gap += ids[i] - end
            if ids[i] + 1 - beg > most or (gap >= useless if in_total else ids[i] - end + 1 >= useless):
                break
            end, n, i = ids[i] + 1, n + 1, i + 1
        want.append((len(want), beg, end, n))
    got = layout.block_chunks(spark.createDataFrame([(b,) for b in ids + ids[:4]], "blk long"), most, useless, in_total)
    assert rows(got, "chunk", "blk_beg", "blk_end", "requested") == want


def walked(ids, most, useless, in_total):
    want, i = [], 0
    while i < len(ids):
        beg, end, n, gap = ids[i], ids[i] + 1, 1, 0
        i += 1
        while i < len(ids):
            gap += ids[i] - end
            if ids[i] + 1 - beg > most or (gap >= useless if in_total else ids[i] - end + 1 >= useless):
                break
            end, n, i = ids[i] + 1, n + 1, i + 1
        want.append((len(want), beg, end, n))
    return want


@pytest.mark.parametrize("most, useless, in_total", [(1, 3, True), (6, 0, False), (6, 1, False), (9, 4, False), (9, 4, True), (2, 50, True)])
def test_chunks_by_file(spark, monkeypatch, most, useless, in_total):
    """Files whose blocks spread over many ranges, cut at certain gaps and walked in parts."""
    monkeypatch.setattr(layout, "RANGE", 8)
    files = {f: sorted({(i * i * (f + 3) + f) % 211 for i in range(40 * f + 1)}) for f in range(4)}
    df = spark.createDataFrame([(f, b) for f, ids in files.items() for b in ids], "f int, blk int")
    got = layout.block_chunks(df, most, useless, in_total, ("f",))
    want = [(f, *w) for f, ids in files.items() for w in walked(ids, most, useless, in_total)]
    assert rows(got, "f", "chunk", "blk_beg", "blk_end", "requested") == want
    assert layout.block_chunks(df.limit(0), most, useless, in_total).count() == 0


def test_adjacency_chunks(case):
    pairs, g = case
    got = layout.adjacency_chunks(g, 3)
    lists = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r["v"], r["chunk"])):
        assert len(lists[r["v"]]) == 3 * r["chunk"] and 0 < len(r["neighbours"]) <= 3
        lists[r["v"]] += r["neighbours"]
    assert sorted(lists.items()) == sorted((v, sorted(b for a, b in pairs if a == v)) for v in {a for a, _ in pairs})


def test_reads(case):
    pairs, g = case
    order, block, most = sorted(pairs), 4, 2
    total = -(-len(order) // block)
    chunks = reads.scan_chunks(g, most, block)
    want = [(i // most, i, min(i + most, total), 0 if i == 0 else order[i * block][0]) for i in range(0, total, most)]
    assert rows(chunks, "chunk", "blk_beg", "blk_end", "beg_vert") == want
    slots = defaultdict(list)
    for slot, (a, _) in enumerate(order):
        slots[slot // (block * most), a].append(slot % (block * most))
    assert rows(reads.clipped(layout.beg_pos(g), chunks, block), "chunk", "v", "beg", "end") == sorted((c, v, min(s), max(s) + 1) for (c, v), s in slots.items())
    even = [v for v in range(g.n) if v % 2 == 0]
    assert rows(reads.queue(g.vertices.union(g.vertices), F.col("v") % 2 == 0), "place", "v") == list(enumerate(even))
    levels = programs.bfs(g, order[0][0])
    level = {r["v"]: r["level"] for r in levels.collect()}
    asked = defaultdict(set)
    for slot, (a, _) in enumerate(order):
        if a in level:
            asked[level[a]].add(slot // block)
    got = reads.level_bytes(g, levels, most, 3, block)
    made = {lv: walked(sorted(b), most, 3, True) for lv, b in asked.items()}
    assert rows(got, "level", "blocks", "chunks", "bytes") == sorted((lv, len(asked[lv]), len(w), sum(e - b for _, b, e, _ in w) * block * reads.ID_BYTES) for lv, w in made.items())


def test_previews_overlaps_and_runs(spark):
    pairs = GRAPHS["star"]
    g = Graph(spark.createDataFrame(pairs, "src long, dst long"))
    ranges = layout.partition_p2d(g, 3, 2).cache()
    parts = defaultdict(list)
    spans = [tuple(r) for r in ranges.select("row", "col", "row_beg", "row_end", "col_beg", "col_end").collect()]
    for a, b in sorted(pairs):
        parts[next((i, j) for i, j, x, y, z, w in spans if x <= a < y and z <= b < w)].append((a, b))
    assert rows(reads.preview(g, ranges, 4), "row", "col", "place", "src", "dst") == sorted((*k, p, *e) for k, es in parts.items() for p, e in enumerate(es[:4]))
    strips = {(i, x, y) for i, _, x, y, _, _ in spans}
    assert rows(reads.overlaps(ranges), "row", "col", "other") == sorted((i, j, o) for i, j, _, _, z, w in spans for o, x, y in strips if max(x, z) < min(y, w))
    values = [(i * 37) % 11 for i in range(21)]
    got = reads.sorted_runs(spark.createDataFrame(list(enumerate(values)), "at long, value int"), "at", "value", 8)
    assert [v for _, v in rows(got, "at", "value")] == [v for i in range(0, 21, 8) for v in sorted(values[i : i + 8])]
    none = Graph(g.edges.limit(0))
    assert reads.scan_chunks(none, 4).count() == reads.queue(none.vertices, F.lit(True)).count() == 0


def test_prefix_sum_spans_ranges(spark):
    df = spark.range(50).selectExpr("id v", "id % 3 g", "id x")
    got = rows(layout.prefix_sum(df, "x", ("g",), width=7), "v", "cum")
    assert got == [(v, sum(u for u in range(v + 1) if u % 3 == v % 3)) for v in range(50)]


def test_long_path_is_not_capped(spark):
    g = Graph(spark.createDataFrame(both([(i, i + 1) for i in range(300)]), "src long, dst long"))
    assert programs.bfs(g, 0).agg(F.max("level")).first()[0] == 300
    assert programs.components(g).filter("component <> 0").count() == 0


def test_empty(spark):
    e = spark.createDataFrame([], "src long, dst long")
    g = Graph(e)
    assert ops.stats(e).first()["vert_count"] == 0
    for df in (ops.degrees(g), layout.beg_pos(g), programs.bfs(g, 0), programs.components(g), programs.kcore(g, 1), programs.pagerank(g, 2), layout.block_index(g), programs.giant_by_bfs(g)):
        assert df.count() == 0
    assert connected_components(spark.createDataFrame([(None, 3), (4, 4)], "src long, dst long")).collect()[0].asDict() == {"v": 4, "component": 4}


def test_hybrid_and_metrics(spark):
    g = Graph(spark.createDataFrame(GRAPHS["islands"], "src long, dst long"))
    assert rows(programs.components_hybrid(g), "v", "component") == rows(programs.components(g), "v", "component")
    metrics = []
    programs.bfs(g, 5, metrics=metrics)
    found = {r["step"]: r["frontier"] for r in metrics_frame(spark, metrics).collect()}
    assert found == {r["level"]: r["count"] for r in programs.bfs(g, 5).filter("level > 0").groupBy("level").count().collect()}
    assert rows(programs.level_counts(programs.bfs(g, 5)), "level", "frontier") == [(0, 1), (1, 1), (2, 1)]
    assert rows(programs.unreached(g, programs.bfs(g, 5)), "v") == [(v,) for v in (0, 1, 2, 3, 4, 8, 9, 10, 11)]
