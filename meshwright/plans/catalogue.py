"""The registered graph queries and their SQL twins, over the edge tables of ``sources.fixtures``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import graph as ops
from meshwright.operators import layout, reads
from meshwright.operators.graph import Graph
from meshwright.sources import binary_layout, fixtures
from meshwright.sources import edges as sources

from . import programs
from .recovery import own_dir
from .superstep import metrics_frame

ROWS, COLS = 4, 4
#: Merging of blocks: longest chunk, gap that ends one.
MOST, USELESS = 8, 3
CORE, DENSE_CORE, ROUNDS = 1, 25, 24
SOURCES = list(range(32))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, fixture: str, query: Callable[[Graph], DataFrame], sql: str, ctes: str = "", recursive: str = "") -> None:
    """Registers a query over a fixture; its SQL sees the edges as e and all vertices as vs."""
    QUERIES[name] = lambda spark, sf_dir: query(Graph(fixtures.edges(spark, sf_dir, fixture)))
    edges = f"e AS MATERIALIZED (SELECT CAST(src AS BIGINT) src, CAST(dst AS BIGINT) dst FROM ({fixtures.plain_sql(fixture)}))"
    vertices = "vs AS MATERIALIZED (SELECT unnest(range((SELECT max(greatest(src, dst)) + 1 FROM e))) v)"
    SQL[name] = f"WITH {recursive} {edges}, {vertices}{', ' + ctes if ctes else ''} {sql}"


_DEG = "deg AS MATERIALIZED (SELECT v, coalesce(d, 0)::BIGINT degree FROM vs LEFT JOIN (SELECT src v, count(*) d FROM e GROUP BY 1) USING (v))"
_CUM = f'{_DEG}, bp AS MATERIALIZED (SELECT v, (sum(degree) OVER (ORDER BY v) - degree)::BIGINT beg, (sum(degree) OVER (ORDER BY v))::BIGINT "end" FROM deg)'
_M, _N = "(SELECT count(*) FROM e)", "(SELECT count(*) FROM vs)"

for _f in ("f1", "f4"):
    _tail = "" if _f == "f1" else "_multi"
    _add(f"graph_stats{_tail}", _f, lambda g: ops.stats(g.edges), "SELECT min(least(src, dst)) min_vert, max(greatest(src, dst)) max_vert, count(*) edge_count, max(greatest(src, dst)) + 1 vert_count FROM e")
    _add(f"out_degree{_tail}", _f, ops.degrees, "SELECT v, degree FROM deg", _DEG)
    _add(f"in_degree{_tail}", _f, lambda g: ops.degrees(g, "dst"), "SELECT v, coalesce(d, 0)::BIGINT degree FROM vs LEFT JOIN (SELECT dst v, count(*) d FROM e GROUP BY 1) USING (v)")
    _add(f"beg_pos{_tail}", _f, layout.beg_pos, 'SELECT v, beg, "end" FROM bp', _CUM)
    _add(f"csr_slots{_tail}", _f, layout.csr_slots, "SELECT src v, (beg + row_number() OVER (PARTITION BY src ORDER BY dst) - 1)::BIGINT slot, dst FROM e JOIN bp ON v = src", _CUM)
_add("max_degree_vertex", "f1", lambda g: ops.max_degree_vertex(g.edges), "SELECT src v, count(*) degree FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
_add("adjacency_sizes", "f2", lambda g: layout.adjacency(g).select("v", F.size("neighbours").cast("long").alias("size"), F.element_at("neighbours", 1).alias("first"), F.element_at("neighbours", -1).alias("last")), "SELECT src v, count(*) size, min(dst) first, max(dst) last FROM e GROUP BY 1")

_add(
    "adjacency_chunks", "f2", lambda g: layout.adjacency_chunks(g, 16).select("v", "chunk", F.size("neighbours").cast("long").alias("size"), F.element_at("neighbours", 1).alias("first"), F.element_at("neighbours", -1).alias("last")),
    "SELECT src v, (p // 16)::BIGINT chunk, count(*) size, min(dst) first, max(dst) last FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 p FROM e) GROUP BY 1, 2",
)

_add(
    "partition_p2d", "f1", lambda g: layout.partition_p2d(g, ROWS, COLS),
    f'SELECT r AS "row", c AS col, r * (n // {ROWS}) row_beg, CASE WHEN r = {ROWS - 1} THEN n ELSE (r + 1) * (n // {ROWS}) END row_end, c * (n // {COLS}) col_beg, CASE WHEN c = {COLS - 1} THEN n ELSE (c + 1) * (n // {COLS}) END col_end FROM range({ROWS}) x(r), range({COLS}) y(c), (SELECT count(*) n FROM vs)',
)


def _ends(name: str, cut: str, parts: int) -> str:
    return f"{name} AS MATERIALIZED (SELECT k, b, coalesce(lead(b) OVER (ORDER BY k), {_N})::BIGINT e FROM (SELECT k, CASE WHEN k = 0 THEN 0 ELSE coalesce((SELECT min(v) - 1 FROM {cut} WHERE v >= 1 AND c >= k * (({_M} - 1) // {parts} + 1)), {_N}) END::BIGINT b FROM range({parts}) t(k)))"


_ROWCUM = f'{_CUM}, rc AS MATERIALIZED (SELECT v, "end" c FROM bp), {_ends("rr", "rc", ROWS)}'
_INCUM = "ic AS MATERIALIZED (SELECT v, sum(coalesce(d, 0)) OVER (ORDER BY v) c FROM vs LEFT JOIN (SELECT dst v, count(*) d FROM e GROUP BY 1) USING (v))"
_add("partition_independent", "f2", lambda g: layout.partition_independent(g, ROWS, COLS), 'SELECT r.k AS "row", c.k AS col, r.b row_beg, r.e row_end, c.b col_beg, c.e col_end FROM rr r, cc c', f'{_ROWCUM}, {_INCUM}, {_ends("cc", "ic", COLS)}')
_ULTRA = (
    f"{_ROWCUM}, sd AS MATERIALIZED (SELECT k, dst v, count(*) d FROM e JOIN rr ON src >= b AND src < e.e GROUP BY 1, 2)".replace("src < e.e", "src < rr.e")
    + f", sc AS MATERIALIZED (SELECT rr.k rk, vs.v, sum(coalesce(d, 0)) OVER (PARTITION BY rr.k ORDER BY vs.v) c FROM rr CROSS JOIN vs LEFT JOIN sd ON sd.k = rr.k AND sd.v = vs.v)"
    + f", cb AS MATERIALIZED (SELECT rr.k rk, t.k ck, CASE WHEN t.k = 0 THEN 0 ELSE coalesce((SELECT min(v) - 1 FROM sc WHERE sc.rk = rr.k AND v >= 1 AND c >= t.k * (({_M} - 1) // {ROWS * COLS} + 1)), {_N}) END::BIGINT cbeg FROM rr, range({COLS}) t(k))"
    + f', pu AS MATERIALIZED (SELECT rr.k AS "row", ck col, rr.b row_beg, rr.e row_end, cbeg col_beg, coalesce(lead(cbeg) OVER (PARTITION BY rk ORDER BY ck), {_N})::BIGINT col_end FROM cb JOIN rr ON rr.k = rk)'
)
_ASSIGN = 'pe AS MATERIALIZED (SELECT src, dst, "row", col FROM e JOIN pu ON src >= row_beg AND src < row_end AND dst >= col_beg AND dst < col_end)'
for _f in ("f1", "f2"):
    _tail = "" if _f == "f1" else "_dense"
    _add(f"partition_ultra{_tail}", _f, lambda g: layout.partition_ultra(g, ROWS, COLS), 'SELECT "row", col, row_beg, row_end, col_beg, col_end FROM pu', _ULTRA)
    _add(f"partition_edge_counts{_tail}", _f, lambda g: layout.partition_edge_counts(g, layout.partition_ultra(g, ROWS, COLS)), 'SELECT "row", col, count(*) edges FROM pe GROUP BY 1, 2', f"{_ULTRA}, {_ASSIGN}")
_add(
    "partition_beg_pos", "f1", lambda g: layout.partition_beg_pos(g, layout.partition_ultra(g, ROWS, COLS)),
    'SELECT "row", col, v, (c - d)::BIGINT beg, c::BIGINT "end" FROM (SELECT "row", col, v, d, sum(d) OVER (PARTITION BY "row", col ORDER BY v) c FROM (SELECT pu."row", pu.col, vs.v, (SELECT count(*) FROM pe WHERE pe."row" = pu."row" AND pe.col = pu.col AND pe.src = vs.v) d FROM pu JOIN vs ON v >= row_beg AND v < row_end))',
    f"{_ULTRA}, {_ASSIGN}",
)

_BLK = lambda where: f'SELECT v, unnest(range(beg // {layout.BLOCK}, ("end" - 1) // {layout.BLOCK} + 1)) blk FROM bp WHERE "end" > beg{where}'
_add("block_index", "f1", layout.block_index, f"SELECT blk, CASE WHEN blk = 0 THEN 0 ELSE min(v) END::BIGINT beg_vert FROM ({_BLK('')}) GROUP BY blk", _CUM)
_add("frontier_blocks", "f1", lambda g: layout.frontier_blocks(g, F.col("v") % 97 == 0), f"SELECT DISTINCT blk FROM ({_BLK(' AND v % 97 = 0')})", _CUM)
_LIST = f"{_CUM}, b AS MATERIALIZED (SELECT blk, row_number() OVER (ORDER BY blk) rn FROM (SELECT DISTINCT blk FROM ({_BLK(' AND v % 41 = 0')})))"
for _name, _total, _stop in (("block_chunks", False, f"b.blk - r.blk >= {USELESS}"), ("block_chunks_total", True, f"r.gap + b.blk - r.blk - 1 >= {USELESS}")):
    _brk = f"(b.blk + 1 - r.beg > {MOST} OR {_stop})"
    _add(
        _name, "f2", lambda g, t=_total: layout.block_chunks(layout.frontier_blocks(g, F.col("v") % 41 == 0), MOST, USELESS, t),
        "SELECT chunk::BIGINT chunk, min(blk) blk_beg, max(blk) + 1 blk_end, count(*) requested FROM r GROUP BY chunk",
        f"{_LIST}, r AS (SELECT rn, blk, blk beg, 0 gap, 0 chunk FROM b WHERE rn = 1 UNION ALL SELECT b.rn, b.blk, CASE WHEN {_brk} THEN b.blk ELSE r.beg END, CASE WHEN {_brk} THEN 0 ELSE r.gap + b.blk - r.blk - 1 END, r.chunk + CASE WHEN {_brk} THEN 1 ELSE 0 END FROM r JOIN b ON b.rn = r.rn + 1)",
        "RECURSIVE",
    )

_ROOT = "root AS MATERIALIZED (SELECT src v FROM e GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1)"
_BFS = f"{_ROOT}, r(v, l) USING KEY (v) AS (SELECT v, 0 FROM root UNION (SELECT e.dst, min(r.l) + 1 FROM r JOIN e ON e.src = r.v WHERE NOT EXISTS (SELECT 1 FROM recurring.r x WHERE x.v = e.dst) GROUP BY e.dst))"


def _from_root(g: Graph) -> DataFrame:
    return programs.bfs(g, ops.max_degree_vertex(g.edges).first()["v"])


for _f in ("f1", "f2", "f3", "f4"):
    _tail = {"f1": "", "f2": "_dense", "f3": "_chains", "f4": "_multi"}[_f]
    _add(f"bfs_levels{_tail}", _f, _from_root, "SELECT v, l::INTEGER AS level FROM r", _BFS, "RECURSIVE")
_add("bfs_level_counts", "f1", lambda g: programs.level_counts(_from_root(g)), "SELECT l::INTEGER AS level, count(*) frontier FROM r GROUP BY 1", _BFS, "RECURSIVE")
_add("bfs_unreached", "f1", lambda g: programs.unreached(g, _from_root(g)), "SELECT v FROM vs WHERE v NOT IN (SELECT v FROM r)", _BFS, "RECURSIVE")


def _x(g: Graph) -> DataFrame:
    return g.vertices.select("v", (F.col("v") * 31 % 97).alias("x"))


_add("spmv", "f1", lambda g: programs.spmv(g, _x(g)), "SELECT v, coalesce(y, 0)::BIGINT y FROM vs LEFT JOIN (SELECT src v, sum(dst * 31 % 97) y FROM e GROUP BY 1) USING (v)")
_add("spmv_dense", "f2", lambda g: programs.spmv(g, _x(g)), "SELECT v, coalesce(y, 0)::BIGINT y FROM vs LEFT JOIN (SELECT src v, sum(dst * 31 % 97) y FROM e GROUP BY 1) USING (v)")


def _rank_ctes(rounds: int) -> str:
    out = [_DEG, f"p0 AS MATERIALIZED (SELECT v, 1.0::DOUBLE / {_N} AS rank FROM vs)"]
    for i in range(rounds):
        share = f"SELECT v, CASE WHEN degree > 0 THEN rank * (1.0::DOUBLE / degree) ELSE 0 END c FROM p{i} JOIN deg USING (v)"
        out.append(f"p{i + 1} AS MATERIALIZED (SELECT vs.v, 0.85::DOUBLE * coalesce(s, 0) + 0.15::DOUBLE AS rank FROM vs LEFT JOIN (SELECT src v, sum(c) s FROM e JOIN ({share}) q ON q.v = e.dst GROUP BY 1) z ON z.v = vs.v)")
    return ", ".join(out)


for _i in (1, 10):
    _add(f"pagerank_{_i}", "f1", lambda g, i=_i: programs.pagerank(g, i).select("v", F.round("rank", 8).alias("rank")), f"SELECT v, round(rank, 8) AS rank FROM p{_i}", _rank_ctes(_i))

_WCC = "u AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r(v, c) USING KEY (v) AS (SELECT DISTINCT src, src FROM u UNION (SELECT u.dst, min(r.c) FROM r JOIN u ON u.src = r.v JOIN recurring.r x ON x.v = u.dst WHERE r.c < x.c GROUP BY u.dst))"
for _f in ("f1", "f3", "f5"):
    _tail = {"f1": "", "f3": "_chains", "f5": "_conversations"}[_f]
    _add(f"wcc_labels{_tail}", _f, programs.components, "SELECT v, c AS component FROM r", _WCC, "RECURSIVE")
_add("wcc_hybrid", "f1", programs.components_hybrid, "SELECT v, c AS component FROM r", _WCC, "RECURSIVE")
_add("wcc_count", "f1", lambda g: programs.components(g).agg(F.countDistinct("component").alias("component_count")), "SELECT count(DISTINCT c) component_count FROM r", _WCC, "RECURSIVE")
_add("wcc_sizes", "f1", lambda g: programs.component_sizes(programs.components(g)), "SELECT c AS component, count(*) AS size FROM r GROUP BY 1", _WCC, "RECURSIVE")
_add("wcc_giant_bfs", "f1", programs.giant_by_bfs, "SELECT v FROM r", _BFS, "RECURSIVE")


def _core_ctes(k: int) -> str:
    a = ["a0 AS MATERIALIZED (SELECT v FROM vs)"]
    a += [f"a{i + 1} AS MATERIALIZED (SELECT e.src v FROM e JOIN a{i} x ON x.v = e.src JOIN a{i} y ON y.v = e.dst GROUP BY 1 HAVING count(*) > {k})" for i in range(ROUNDS)]
    return ", ".join(a)


_ALL = " UNION ALL ".join(f"SELECT v FROM a{i}" for i in range(ROUNDS + 1))
_add("kcore_members", "f1", lambda g: programs.kcore(g, CORE).filter("round is null").select("v", F.col("degree").alias("degree_in_core")), f"SELECT e.src v, count(*) degree_in_core FROM e JOIN a{ROUNDS} x ON x.v = e.src JOIN a{ROUNDS} y ON y.v = e.dst GROUP BY 1", _core_ctes(CORE))
_add("kcore_rounds", "f1", lambda g: programs.kcore(g, CORE).filter("round is not null").select("v", "round"), f"SELECT v, count(*)::INTEGER round FROM ({_ALL}) GROUP BY v HAVING count(*) <= {ROUNDS}", _core_ctes(CORE))
for _f, _k in (("f1", CORE), ("f2", DENSE_CORE)):
    _add(
        "kcore_count" if _f == "f1" else "kcore_count_dense", _f,
        lambda g, k=_k: programs.kcore(g, k).agg(F.lit(k).alias("k"), F.count_if(F.col("round").isNull()).alias("remaining")),
        f"SELECT {_k}::INTEGER k, count(*) remaining FROM a{ROUNDS}", _core_ctes(_k),
    )

_MS = f"r(source, v, l) USING KEY (source, v) AS (SELECT s::BIGINT, s::BIGINT, 0 FROM range({len(SOURCES)}) t(s) UNION (SELECT r.source, e.dst, min(r.l) + 1 FROM r JOIN e ON e.src = r.v WHERE NOT EXISTS (SELECT 1 FROM recurring.r x WHERE x.v = e.dst AND x.source = r.source) GROUP BY r.source, e.dst))"
_add("msbfs_mask", "f1", lambda g: programs.source_masks(programs.multi_source(g, SOURCES)), "SELECT v, bit_or(1::BIGINT << source::INTEGER)::BIGINT mask FROM r GROUP BY v", _MS, "RECURSIVE")
_add("msbfs_levels", "f1", lambda g: programs.source_levels(programs.multi_source(g, SOURCES), SOURCES), "SELECT source, v, l::INTEGER AS level FROM r", _MS, "RECURSIVE")
_add("msbfs_frontier", "f1", lambda g: programs.source_levels(programs.multi_source(g, SOURCES), SOURCES).groupBy("level").agg(F.count(F.lit(1)).alias("reached_pairs")), "SELECT l::INTEGER AS level, count(*) reached_pairs FROM r GROUP BY 1", _MS, "RECURSIVE")


def _text_trip(g: Graph) -> DataFrame:
    path = f"{own_dir(g.edges.sparkSession)}/edges-{uuid.uuid4().hex}"
    sources.write_text_edges(g.edges, path)
    return sources.read_text_edges(g.edges.sparkSession, path)


def _binary_trip(g: Graph) -> DataFrame:
    path = f"{own_dir(g.edges.sparkSession)}/edges-{uuid.uuid4().hex}"
    sources.write_binary_edges(g.edges, path)
    return sources.read_binary_edges(g.edges.sparkSession, path)


def _files_trip(g: Graph) -> DataFrame:
    path = f"{own_dir(g.edges.sparkSession)}/files-{uuid.uuid4().hex}"
    sources.write_edge_files(g.edges.repartition(5), path)
    return sources.read_binary_edges(g.edges.sparkSession, f"{path}/*.bin")


def _layout_trip(g: Graph) -> DataFrame:
    path = f"{own_dir(g.edges.sparkSession)}/layout-{uuid.uuid4().hex}"
    binary_layout.write_layout_files(g, layout.partition_ultra(g, ROWS, COLS), path)
    return binary_layout.read_layout_files(g.edges.sparkSession, path)


def _dirty_trip(g: Graph) -> DataFrame:
    """Edges as text lines, each after lines that must be skipped."""
    junk = ["% comment", "# comment 1 2", "", "  ", "only", "1 x", "9999999999999999999 1", "1.5 2", "12e3 4"]
    line = F.concat_ws("\t ", F.lit(""), "src", "dst", F.lit("0.25"))
    return sources.parse_edge_lines(g.edges.select(F.explode(F.array(*map(F.lit, junk), line)).alias("value")))


def _bfs_metrics(g: Graph) -> DataFrame:
    rows: list[dict] = []
    programs.bfs(g, ops.max_degree_vertex(g.edges).first()["v"], metrics=rows)
    return metrics_frame(g.edges.sparkSession, rows).select("step", "frontier")


_add("frontier_queue", "f1", lambda g: reads.queue(g.vertices, F.col("v") % 97 == 0), "SELECT row_number() OVER (ORDER BY v) - 1 place, v FROM vs WHERE v % 97 = 0")
_add(
    "sorted_runs", "f1", lambda g: reads.sorted_runs(layout.csr_slots(g).select("slot", "dst"), "slot", "dst"),
    f"SELECT (s // {reads.RUN} * {reads.RUN} + row_number() OVER (PARTITION BY s // {reads.RUN} ORDER BY dst) - 1)::BIGINT slot, dst FROM (SELECT beg + row_number() OVER (PARTITION BY src ORDER BY dst) - 1 s, dst FROM e JOIN bp ON v = src)", _CUM,
)
_add(
    "partition_preview", "f1", lambda g: reads.preview(g, layout.partition_ultra(g, ROWS, COLS)),
    'SELECT * FROM (SELECT "row", col, row_number() OVER (PARTITION BY "row", col ORDER BY src, dst) - 1 place, src, dst FROM pe) WHERE place < 10', f"{_ULTRA}, {_ASSIGN}",
)
_add(
    "range_overlaps", "f1", lambda g: reads.overlaps(layout.partition_ultra(g, ROWS, COLS)),
    'SELECT pu."row", pu.col, rr.k AS other FROM pu JOIN rr ON col_beg < rr.e AND rr.b < col_end AND rr.b < rr.e AND col_beg < col_end', _ULTRA,
)
_SCAN = f"{_CUM}, sc AS MATERIALIZED (SELECT (blk // {MOST})::BIGINT chunk, blk::BIGINT blk_beg, least(blk + {MOST}, ({_M} + {layout.BLOCK - 1}) // {layout.BLOCK})::BIGINT blk_end, CASE WHEN blk = 0 THEN 0 ELSE min(v) END::BIGINT beg_vert FROM ({_BLK('')}) WHERE blk % {MOST} = 0 GROUP BY blk)"
_add("scan_chunks", "f2", lambda g: reads.scan_chunks(g, MOST), "SELECT chunk, blk_beg, blk_end, beg_vert FROM sc", _SCAN)
_add(
    "chunk_clipping", "f2", lambda g: reads.clipped(layout.beg_pos(g), reads.scan_chunks(g, MOST)),
    f'SELECT chunk, v, greatest(beg - blk_beg * {layout.BLOCK}, 0)::BIGINT beg, least("end" - blk_beg * {layout.BLOCK}, (blk_end - blk_beg) * {layout.BLOCK})::BIGINT "end" FROM bp JOIN sc ON beg < blk_end * {layout.BLOCK} AND "end" > blk_beg * {layout.BLOCK} WHERE "end" > beg', _SCAN,
)
_LEVEL_BRK = f"(b.blk + 1 - w.beg > {MOST} OR w.gap + b.blk - w.blk - 1 >= {USELESS})"
_add(
    "bfs_bytes", "f1", lambda g: reads.level_bytes(g, _from_root(g), MOST, USELESS),
    f"SELECT l::INTEGER AS level, sum(k)::BIGINT blocks, count(*) chunks, (sum(e - b) * {layout.BLOCK * reads.ID_BYTES})::BIGINT bytes FROM (SELECT l, chunk, count(*) k, min(blk) b, max(blk) + 1 e FROM w GROUP BY 1, 2) GROUP BY 1",
    f"{_BFS}, {_CUM}, b AS MATERIALIZED (SELECT l, blk, row_number() OVER (PARTITION BY l ORDER BY blk) rn FROM (SELECT DISTINCT l, blk FROM ({_BLK('')}) JOIN r USING (v))), w AS (SELECT l, rn, blk, blk beg, 0 gap, 0 chunk FROM b WHERE rn = 1 UNION ALL SELECT b.l, b.rn, b.blk, CASE WHEN {_LEVEL_BRK} THEN b.blk ELSE w.beg END, CASE WHEN {_LEVEL_BRK} THEN 0 ELSE w.gap + b.blk - w.blk - 1 END, w.chunk + CASE WHEN {_LEVEL_BRK} THEN 1 ELSE 0 END FROM w JOIN b ON b.l = w.l AND b.rn = w.rn + 1)",
    "RECURSIVE",
)
_add("bfs_metrics", "f1", _bfs_metrics, "SELECT l::INTEGER AS step, count(*) frontier FROM r WHERE l > 0 GROUP BY 1", _BFS, "RECURSIVE")
_add("bin_roundtrip", "f1", _files_trip, "SELECT src, dst FROM e")
_add("layout_roundtrip", "f2", _layout_trip, "SELECT src, dst FROM e")
_add("text_ingest_dirty", "f1", _dirty_trip, "SELECT src, dst FROM e")
_add("text_ingest_roundtrip", "f1", _text_trip, "SELECT src, dst FROM e")
_add("binary_ingest_roundtrip", "f4", _binary_trip, "SELECT src, dst FROM e")
_add("symmetrize_dedupe", "f4", lambda g: sources.dedupe(sources.symmetrize(g.edges)), "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)")
