"""HDF5 files, where the h5py library is installed: nodes as streams, frame groups as one table.

Files are listed by Spark and opened by range reads in the tasks, so a node or a frame is read without the rest of its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import staged
from .files import open_file

#: Digit-named top groups from which a file is one group a frame.
FRAME_GROUPS = 50
#: Rows of a node, or frames, that a task reads at once.
ROWS_AT_ONCE, FRAMES_AT_ONCE = 200_000, 2_000
NODES = "path string, node string, n_rows bigint, n_cols bigint, fields array<string>"


def available() -> bool:
    try:
        import h5py  # noqa: F401
    except ImportError:
        return False
    return True


def _need() -> None:
    if not available():
        raise RuntimeError("reading HDF5 needs the h5py library")


def _leaves(group, prefix: str = "") -> Iterator[tuple[str, object]]:
    for name in group:
        item = group[name]
        path = f"{prefix}/{name}"
        if hasattr(item, "shape"):
            if item.ndim <= 2 and (item.dtype.names or item.dtype.kind in "iufb"):
                yield path, item
        else:
            yield from _leaves(item, path)


def is_frame_layout(names: list[str]) -> bool:
    """Whether the top groups are frames: at least 50 names, all of digits."""
    return len(names) >= FRAME_GROUPS and all(n.isdigit() for n in names)


def list_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Numeric nodes of at most two dimensions: path, node, n_rows, n_cols, fields. A file of frames lists one frame's nodes."""
    _need()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as raw, h5py.File(raw, "r") as f:
                    frames = is_frame_layout(list(f))
                    top = f[next(iter(f))] if frames else f
                    out = []
                    for node, d in _leaves(top):
                        fields = list(d.dtype.names or [])
                        width = len(fields) or (d.shape[1] if d.ndim == 2 else 1)
                        out.append({"path": row["path"], "node": node, "n_rows": len(f) if frames else (d.shape[0] if d.ndim else 1), "n_cols": width, "fields": fields})
                    if out:
                        yield pa.RecordBatch.from_pylist(out)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, NODES)


def stretches(f, node: str) -> list[tuple[int, int]]:
    """Stretches of a node's rows, or of frames, that a task reads at once."""
    key = node.strip("/")
    frames = is_frame_layout(list(f))
    n = len(f) if frames else (f[key].shape[0] if f[key].ndim else 1)
    step = FRAMES_AT_ONCE if frames else ROWS_AT_ONCE
    return [(i, min(n, i + step)) for i in range(0, n, step)]


def rows_of(f, node: str, begin: int, end: int) -> list[tuple[int, list[float]]]:
    """(row or frame number, values) of a stretch; frames without the node have no row."""
    import numpy as np

    def numbers(x) -> np.ndarray:
        x = np.asarray(x)
        return np.stack([np.asarray(x[n], float).reshape(len(x), -1)[:, 0] for n in x.dtype.names], 1) if x.dtype.names else x.astype(float)

    key = node.strip("/")
    if is_frame_layout(list(f)):
        return [(int(n), numbers(f[n][key][...]).reshape(-1).tolist()) for n in sorted(f, key=int)[begin:end] if key in f[n]]
    if not f[key].ndim:
        return [(0, [float(f[key][...])])]
    found = numbers(f[key][begin:end])
    return list(enumerate(found.reshape(len(found), -1).tolist(), begin))


def read_node(spark: SparkSession, path: str, node: str | None) -> DataFrame:
    """Rows of a node: path, row_index (the frame's number for a file of frames) and values as an array of doubles.

    A task a file tells its stretches of rows or frames, which are then dealt over tasks and read by range.
    """
    _need()
    if not node:
        raise ValueError("name a node as path::node; list_nodes shows them")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        for batch in batches:
            for name in batch.column("path").to_pylist():
                with open_file(name) as raw, h5py.File(raw, "r") as f:
                    if found := stretches(f, node):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))], names=["path", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        for batch in batches:
            for name, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end")), strict=True):
                with open_file(name) as raw, h5py.File(raw, "r") as f:
                    found = rows_of(f, node, begin, end)
                if found:
                    at, values = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int64()), pa.array(values, pa.list_(pa.float64()))], names=["path", "row_index", "values"])

    files = spark.read.format("binaryFile").load(path).select("path")
    listed = staged(files.mapInArrow(split, "path string, begin bigint, end bigint"), "stretches")
    dealt = listed.repartitionByRange(max(1, min(listed.count(), 10_000)), "path", "begin")
    return dealt.mapInArrow(run, "path string, row_index bigint, values array<double>")
