"""A sink of flat binary files, for programs that map them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_files(cells: DataFrame, path: str) -> list[str]:
    """Writes rows (name, content) as files in the folder ``path``, which all machines must reach; the files' names, sorted.

    A file is made of the cells with its name, in their order; they must follow each other in one partition. A task
    appends to files of its own attempt, and only those of the attempts that succeeded get their names, so lost
    executors and speculation leave no half files under them. Existing files are replaced.
    """
    attempt = f"_writing-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        store.create_dir(f"{root}/{attempt}", recursive=True)
        mine, name, out, made = uuid.uuid4().hex, None, None, []
        for batch in batches:
            for own, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != name:
                    if out is not None:
                        out.close()
                    name = own
                    made.append((name, f"{attempt}/{mine}-{len(made)}"))
                    out = store.open_output_stream(f"{root}/{made[-1][1]}")
                out.write(content or b"")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.string()) for i in (0, 1)], ["name", "at"])

    store, root = _store(path)
    made = cells.select("name", "content").mapInArrow(write, "name string, at string").collect()  # a row per file
    for name, at in made:
        store.move(f"{root}/{at}", f"{root}/{name}")
    if made:
        store.delete_dir(f"{root}/{attempt}")
    return sorted(name for name, _ in made)
