"""Range reads of files in tasks, from any store that pyarrow or Spark's paths name."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit


def _place(uri: str):
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(uri)


def open_file(uri: str):
    """A seekable file of a URI; local paths and file: URIs need no further library."""
    files, path = _place(uri)
    return files.open_input_file(path)


def read_rows(uri: str, columns: list[str]) -> list[dict]:
    """Rows of a small Parquet table that Spark has written."""
    from pyarrow import parquet

    files, path = _place(uri)
    return parquet.read_table(path, filesystem=files, columns=columns).to_pylist()
