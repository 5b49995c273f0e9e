"""Path traces of a dataflow: ``(op,recv,pub) -> (op,recv,pub)`` a line, stamps in microseconds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace_lines(df: DataFrame, ops: str) -> DataFrame:
    """``value``: the line of each row's array of ``struct<op, recv_us, pub_us>``."""
    one = lambda o: F.concat(F.lit("("), o["op"], F.lit(","), o["recv_us"].cast("string"), F.lit(","), o["pub_us"].cast("string"), F.lit(")"))
    return df.select(F.array_join(F.transform(ops, one), " -> ").alias("value"))


def parse_traces(lines: DataFrame) -> DataFrame:
    """``ops`` of every line that begins with a bracket; others are left out, unreadable stamps are null."""
    part = lambda s: F.regexp_replace(s, r"^\s*\(|\)\s*$", "")

    def one(s):
        f = F.split(part(s), ",")
        return F.struct(F.trim(f[0]).alias("op"), F.trim(f[1]).try_cast("long").alias("recv_us"), F.trim(f[2]).try_cast("long").alias("pub_us"))

    return lines.where(F.col("value").startswith("(")).select(F.transform(F.split("value", " *-> *"), one).alias("ops"))


def path_latency(traces: DataFrame) -> DataFrame:
    """``path`` and ``latency_ms``: the last publish less the first receive."""
    ops = F.col("ops")
    return traces.select("*", F.array_join(F.transform(ops, lambda o: o["op"]), " -> ").alias("path"), ((F.element_at(ops, -1)["pub_us"] - F.element_at(ops, 1)["recv_us"]) / 1000.0).alias("latency_ms"))


def operator_latency(traces: DataFrame) -> DataFrame:
    """Per operator, and per edge to the next operator: ``op, next_op (null: the operator itself), n, mean_us, most_us``."""
    each = traces.select(F.posexplode("ops").alias("i", "o"), "ops")
    inside = each.select(F.col("o.op").alias("op"), F.lit(None).cast("string").alias("next_op"), (F.col("o.pub_us") - F.col("o.recv_us")).alias("us"))
    after = each.where(F.col("i") + 1 < F.size("ops")).select("o", F.element_at("ops", F.col("i") + 2).alias("b"))
    between = after.select(F.col("o.op").alias("op"), F.col("b.op").alias("next_op"), (F.col("b.recv_us") - F.col("o.pub_us")).alias("us"))
    return inside.unionByName(between).groupBy("op", "next_op").agg(F.count("us").alias("n"), F.avg("us").alias("mean_us"), F.max("us").alias("most_us"))


def drop_repeats(df: DataFrame, keys: list[str], order: list[str], stamp: str, tolerance: int) -> DataFrame:
    """Per key, in order, without rows whose whole-number stamp is within ``tolerance`` of the last kept one. Rows without a stamp are left out.

    What is kept depends on all that was kept before, so a key is read by one
    task, but as a stream: the task holds a batch of rows and the last stamp.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = df.select(*df.columns, F.col(stamp).cast("long").alias("_stamp")).where("_stamp is not null").repartition(*keys).sortWithinPartitions(*keys, *order)
    places = [rows.columns.index(k) for k in keys]
    arrow = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            own = zip(*[b.column(i).to_pylist() for i in places], strict=True)
            keep = np.zeros(b.num_rows, bool)
            for i, (k, s) in enumerate(zip(own, b.column(b.num_columns - 1).to_pylist(), strict=True)):
                if k != now or last is None or abs(s - last) > tolerance:
                    keep[i], now, last = True, k, s
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:-1]], schema=arrow)

    return rows.mapInArrow(run, df.schema)
