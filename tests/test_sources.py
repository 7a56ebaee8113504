"""Edge formats: text, packed binary, layout folders and streams."""

import struct

import pytest

from meshwright.operators import layout
from meshwright.operators.graph import Graph
from meshwright.sources import binary_layout
from meshwright.sources import edges as sources
from meshwright.streaming import running_degrees, stream_text_edges

TEXT = "% head\n# head\n0 1\n\n2\t3\n  4   5  \n6 7 0.5\nx y\n8\n-9 10\n"


def rows(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(TEXT)
    want = [(-9, 10), (0, 1), (2, 3), (4, 5), (6, 7)]
    got = sources.read_text_edges(spark, str(tmp_path / "in"))
    assert rows(got) == want
    sources.write_text_edges(got, str(tmp_path / "out"))
    assert rows(sources.read_text_edges(spark, str(tmp_path / "out"))) == want


def test_binary(spark, tmp_path):
    pairs = [(0, 1), (2**40, -3), (5, 5), (5, 5)]
    (tmp_path / "p-00000.bin").write_bytes(b"".join(struct.pack("<qq", *p) for p in pairs))
    assert rows(sources.read_binary_edges(spark, str(tmp_path / "p-00000.bin"))) == sorted(pairs)
    sources.write_binary_edges(spark.createDataFrame(pairs, "src long, dst long"), str(tmp_path / "out"))
    assert rows(sources.read_binary_edges(spark, str(tmp_path / "out"))) == sorted(pairs)
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole edges"):
        sources.read_binary_edges(spark, str(tmp_path / "bad.bin")).collect()


def test_symmetrize_and_dedupe(spark):
    e = spark.createDataFrame([(0, 1), (0, 1), (2, 2)], "src long, dst long")
    assert rows(sources.symmetrize(e)) == [(0, 1), (0, 1), (1, 0), (1, 0), (2, 2)]
    assert rows(sources.dedupe(e)) == [(0, 1), (2, 2)]


def test_layout_folders(spark, tmp_path):
    pairs = [(a, (a * 7) % 20) for a in range(20)]
    g = Graph(spark.createDataFrame(pairs, "src long, dst long"))
    layout.write_layout(g, layout.partition_ultra(g, 2, 2), str(tmp_path / "g"))
    back = spark.read.parquet(str(tmp_path / "g"))
    assert rows(back) == sorted(pairs) and {"prow", "pcol"} <= set(back.columns)


def test_binary_layout(spark, tmp_path):
    pairs = sorted([(a, (a * 7) % 20) for a in range(20)] + [(3, 4), (3, 4), (0, 19)])
    g = Graph(spark.createDataFrame(pairs, "src long, dst long"))
    ranges = layout.partition_ultra(g, 2, 3).cache()
    files = binary_layout.small_files(g, ranges, "g")
    for r in sorted(binary_layout.layout_files(g, ranges, "g").collect()):
        files[r["name"]] = files.get(r["name"], b"") + bytes(r["content"])
    made = str(tmp_path / "made")
    assert binary_layout.write_layout_files(g, ranges, made, "g") == sorted(files)
    assert {f: open(f"{made}/{f}", "rb").read() for f in files} == files
    assert sorted(map(tuple, binary_layout.read_ranges(spark, made).collect())) == sorted(tuple(r[c] for c in ("row", "col", "row_beg", "row_end", "col_beg", "col_end")) for r in ranges.collect())
    assert len(files) == 2 * 6 + 3
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    starts = list(struct.unpack("<3I", files["g_beg-2x3-row-ranger.bin"]))
    assert starts[0] == 0 and starts[-1] == 20 and len(files["g_beg-2x3-col-ranger.bin"]) == 4 * 4 * 2
    assert binary_layout.read_metadata(files["g-glb-vert-edge-count.bin"]) == {"min_vert": 0, "max_vert": 19, "edge_count": 23}
    with pytest.raises(ValueError):
        binary_layout.read_metadata(struct.pack("<IIq", 5, 5, 1))
    read = lambda: binary_layout.edges_of_layout(spark.read.format("binaryFile").load(str(tmp_path)), starts)
    assert rows(read()) == pairs
    (tmp_path / "g_csr.0_0_of_2x3.bin").write_bytes(bytes(400))
    with pytest.raises(Exception, match="neighbours"):
        read().collect()


def test_block_trace(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(struct.pack("<6q", 5, 3, 5, 9, 10, 3))
    path = str(tmp_path / "t.bin")
    assert sorted(r["blk"] for r in binary_layout.read_block_trace(spark, path, 10).collect()) == [3, 5, 9]
    assert sorted(r["blk"] for r in binary_layout.read_block_trace(spark, path, 10, distinct=False).collect()) == [3, 3, 5, 5, 9]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(TEXT)
    q = running_degrees(stream_text_edges(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("deg").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("deg").collect()) == [(-9, 1), (0, 1), (2, 1), (4, 1), (6, 1)]
