"""Zip archives held as bytes."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, key: str, members: str) -> DataFrame:
    """``key, archive``: a zip of each row's array of ``struct<path, text>``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for files in b.column(1).to_pylist():
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for f in files or ():
                        z.writestr(f["path"], f["text"] or "")
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "archive"])

    return df.select(key, members).mapInArrow(run, f"{key} {kind}, archive binary")


def matching_members(df: DataFrame, key: str, archive: str, pattern: str) -> DataFrame:
    """``key, paths, n_bytes``: the paths in each archive that match a glob, in order, joined by colons, and their size unpacked. What is no archive, or null, has null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, sizes = [], []
            for data in b.column(1):
                try:
                    with zipfile.ZipFile(io.BytesIO(data.as_py() or b"")) as z:
                        own = sorted((i.filename, i.file_size) for i in z.infolist() if fnmatch.fnmatchcase(i.filename, pattern))
                    paths.append(":".join(p for p, _ in own))
                    sizes.append(sum(n for _, n in own))
                except zipfile.BadZipFile:
                    paths.append(None)
                    sizes.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=[key, "paths", "n_bytes"])

    return df.select(F.col(key), archive).mapInArrow(run, f"{key} {kind}, paths string, n_bytes long")
