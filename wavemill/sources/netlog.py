"""Counters in network logs: ``[port 0][queue 3] rx_packets: 12, missed: 0, errors: 1``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ("rx_packets", "missed", "errors")


def parse_counters(lines: DataFrame) -> DataFrame:
    """``port, queue`` (null: of the whole port) and the counters of each line with a port; a counter not in the line is null."""
    number = lambda pattern: F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).try_cast("long")
    got = lines.select(number(r"\[port (\d+)\]").cast("int").alias("port"), number(r"\[queue (\d+)\]").cast("int").alias("queue"), *[number(rf"\b{c}: *(\d+)").alias(c) for c in COUNTERS])
    return got.where("port is not null")


def validate(counters: DataFrame, missed: float, errors: float) -> DataFrame:
    """Per port the sums, their ratios to all packets, and whether both are within bounds; a port without packets isn't."""
    s = counters.groupBy("port").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], F.countDistinct("queue").alias("n_queues"))
    every = F.nullif(F.col("rx_packets") + F.col("missed") + F.col("errors"), F.lit(0))
    s = s.withColumns({"missed_ratio": F.col("missed") / every, "error_ratio": F.col("errors") / every})
    return s.withColumn("good", F.coalesce((F.col("missed_ratio") <= missed) & (F.col("error_ratio") <= errors), F.lit(False)))
