"""Recordings with a JSON header: headers as tables, samples as frames.

Samples are read by a Python data source whose partitions are ranges of frames,
planned from the files' sizes, so that a large file is read by many tasks and no
task holds more than a batch of frames.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The header's field names.
HEADER = (
    "`global` struct<`core:sample_rate`: double, `core:datatype`: string>, captures array<struct<`core:frequency`: double, `core:sample_start`: long>>, "
    "annotations array<struct<`core:sample_start`: long, `core:sample_count`: long, `core:freq_lower_edge`: double, `core:freq_upper_edge`: double, `core:label`: string, kind: string, time_group: int, bandwidth_hz: double>>"
)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Whole header files as ``stem, header``; a header that can't be read is null."""
    text = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.sigmf-meta").text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return text.select(F.regexp_replace("file", r"\.sigmf-meta$", "").alias("stem"), F.from_json("value", HEADER).alias("header"))


def captures(headers: DataFrame) -> DataFrame:
    """``stem, sample_rate, center_freq_hz, attenuation_db, datatype``."""
    from wavemill.functions.scalar import attenuation_of

    return headers.where("header is not null").select(
        "stem", F.col("header.global.`core:sample_rate`").alias("sample_rate"), F.try_element_at("header.captures", F.lit(1))["core:frequency"].alias("center_freq_hz"),
        attenuation_of(F.col("stem")).alias("attenuation_db"), F.col("header.global.`core:datatype`").alias("datatype"),
    )


def annotations(headers: DataFrame) -> DataFrame:
    """One row per annotation, numbered by start; labels and kinds that are missing have their defaults."""
    a = headers.select("stem", F.explode("header.annotations").alias("a"))
    from pyspark.sql import Window

    order = ("core:sample_start", "core:freq_lower_edge", "core:label", "core:freq_upper_edge", "core:sample_count", "kind")
    w = Window.partitionBy("stem").orderBy(*[F.col(f"a.`{c}`") for c in order])  # a header's annotations
    return a.select(
        "stem", (F.row_number().over(w) - 1).alias("ann_idx"), F.col("a.`core:sample_start`").alias("sample_start"), F.col("a.`core:sample_count`").alias("sample_count"),
        F.col("a.`core:freq_lower_edge`").alias("freq_lower_hz"), F.col("a.`core:freq_upper_edge`").alias("freq_upper_hz"), F.coalesce("a.`core:label`", F.lit("UNLABELED")).alias("label"),
        F.coalesce("a.kind", F.lit("annotation")).alias("kind"), F.col("a.time_group").alias("time_group"), F.col("a.bandwidth_hz").alias("bandwidth_hz"),
    )


def header_json(df: DataFrame, annotations: str) -> DataFrame:
    """``value``: a header's text per row of ``stem, sample_rate, datatype, center_freq_hz`` and an array of annotations."""
    return df.select("stem", F.to_json(F.struct(
        F.struct(F.col("sample_rate").alias("core:sample_rate"), F.col("datatype").alias("core:datatype")).alias("global"),
        F.array(F.struct(F.col("center_freq_hz").alias("core:frequency"), F.lit(0).cast("long").alias("core:sample_start"))).alias("captures"),
        F.col(annotations).alias("annotations"),
    )).alias("value"))


def scalar_type(name: str) -> tuple[np.dtype, float, float]:
    """NumPy type, midpoint and scale of a sample format such as ``cf32_le``, ``ci16_be`` or ``cu8``."""
    body, _, order = name.lower().partition("_")
    kind, bits = body[1], int(body[2:])
    if body[0] != "c" or kind not in "fiu" or bits not in ((32, 64) if kind == "f" else (8, 16, 32)):
        raise ValueError(f"unknown sample format {name}")
    t = np.dtype(("<", ">")[order == "be"] + kind + str(bits // 8))
    return t, float(1 << (bits - 1)) if kind == "u" else 0.0, 1.0 if kind == "f" else float((1 << (bits - 1)) - 1)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, local without a scheme, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def write_files(df: DataFrame, folder: str, ending: str) -> DataFrame:
    """Each row of ``stem, value`` (text or bytes) as the file ``folder/stem + ending``: ``stem, n_bytes``. Files are written by the tasks, whole and under their last name, so a task that runs again replaces its own."""
    kind = df.schema["stem"].dataType.simpleString()
    arrow = pa.schema([("stem", pa.string()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = file_system(folder)
        where.create_dir(path)
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for stem, value in zip(names, b.column(1), strict=True):
                v = value.as_py()
                v = v.encode() if isinstance(v, str) else v
                with where.open_output_stream(f"{path}/{stem}{ending}") as out:
                    out.write(v)
                sizes.append(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], schema=arrow)

    return df.select("stem", "value").where("stem is not null and value is not null").mapInArrow(run, f"stem {kind}, n_bytes long")


def write_samples(df: DataFrame, folder: str) -> DataFrame:
    """Samples in long form (``stem, at, i, q``) as cf32 recordings ``folder/stem.sigmf-data``: ``stem, n_samples``. A recording is written by one task, as a stream in order of ``at``."""
    arrow = pa.schema([("stem", pa.string()), ("n_samples", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = file_system(folder)
        where.create_dir(path)
        now, out, n, done = None, None, 0, []
        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            x = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1).astype("<f4")
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else []
            for a, z in zip(cuts, cuts[1:], strict=False):
                if names[a] != now:
                    if out is not None:
                        out.close()
                        done.append((now, n))
                    now, n = names[a], 0
                    out = where.open_output_stream(f"{path}/{now}.sigmf-data")
                out.write(x[a:z].tobytes())
                n += z - a
        if out is not None:
            out.close()
            done.append((now, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], schema=arrow)

    rows = df.where("stem is not null and at is not null").repartition("stem").sortWithinPartitions("stem", "at")
    rows = rows.select("stem", *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("i", "q")])
    return rows.mapInArrow(run, "stem string, n_samples long")


@dataclass
class Frames(InputPartition):
    path: str
    first: int
    last: int


class FrameReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("datatype", "cf32_le")
        self.size, self.step = int(options.get("frame_samples", 4096)), int(options.get("frames_per_partition", 256))
        if self.size <= 0 or self.step <= 0:
            raise ValueError("frames and partitions must not be empty")
        self.schema = pa.schema([("path", pa.string()), ("frame_number", pa.int64()), ("sample_start", pa.int64()), ("n_read", pa.int32()), ("i", pa.list_(pa.float32())), ("q", pa.list_(pa.float32()))])

    def partitions(self) -> list[Frames]:
        where, path = file_system(self.path)
        info = where.get_file_info(path)
        files = [info] if info.is_file else sorted((f for f in where.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".sigmf-data")), key=lambda f: f.path)
        width = 2 * scalar_type(self.kind)[0].itemsize
        out = []
        for f in files:
            n = -(-(f.size // width) // self.size)
            out += [Frames(f.path, k, min(k + self.step, n)) for k in range(0, n, self.step)]
        return out or [Frames("", 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        t, middle, scale = scalar_type(self.kind)
        frame = self.size * 2 * t.itemsize
        source = file_system(self.path)[0].open_input_file(partition.path)
        for first in range(partition.first, partition.last, 16):
            count = min(16, partition.last - first)
            data = source.read_at(min(count * frame, source.size() - first * frame), first * frame)
            raw = np.frombuffer(data[: len(data) // t.itemsize * t.itemsize], t)
            have = len(raw) // 2
            x = np.zeros(count * self.size * 2, np.float32)
            x[: 2 * have] = (raw[: 2 * have].astype(np.float64) - middle) / scale
            x = x.reshape(count, self.size, 2)
            at = np.arange(first, first + count)
            n = np.clip(have - np.arange(count) * self.size, 0, self.size)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * self.size), pa.array(np.ascontiguousarray(x[:, :, k]).ravel())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * count), pa.array(at), pa.array(at * self.size), pa.array(n.astype(np.int32)), *lists], schema=self.schema)


class IqFrames(DataSource):
    """``spark.read.format("iq_frames")``: frames of ``frame_samples`` from a file or a folder on storage all executors see, the last one padded with zeros (``n_read`` tells how much was there)."""

    @classmethod
    def name(cls) -> str:
        return "iq_frames"

    def schema(self) -> str:
        return "path string, frame_number long, sample_start long, n_read int, i array<float>, q array<float>"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IqFrames)
