"""Interval joins and interval algebra on half-open ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: float, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Pairs whose half-open ranges overlap, as an equi-join on the buckets of ``width`` that both touch.

    Each pair comes out once, in the first bucket common to both. ``on`` adds
    equality columns, which must be on both sides. Null bounds match nothing.
    """
    on = on or []

    def spread(df: DataFrame, bounds: tuple[str, str], name: str) -> DataFrame:
        a, b = (F.floor(F.col(c) / F.lit(width)) for c in bounds)
        return df.where(F.col(bounds[0]) < F.col(bounds[1])).withColumn(name, a).withColumn("_bucket", F.explode(F.sequence(a, b)))

    pairs = spread(left, left_range, "_left0").join(spread(right, right_range, "_right0"), [*on, "_bucket"], how)
    meets = (F.col(left_range[0]) < F.col(right_range[1])) & (F.col(left_range[1]) > F.col(right_range[0]))
    return pairs.where(meets & (F.col("_bucket") == F.greatest("_left0", "_right0"))).drop("_bucket", "_left0", "_right0")


def merge_touching(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Gaps-and-islands: overlapping or touching ranges per key become one, with the number of members.

    For keys of moderate size; :mod:`wavemill.operators.dyadic` splits crowded ones.
    """
    w = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) <= reach, 0).otherwise(1)
    marked = df.where(F.col(start) < F.col(stop)).withColumn("_new", new)
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count(F.lit(1)).alias("members")).drop("_run")


def complement(merged: DataFrame, keys: list[str], start: str, stop: str, low: Column, high: Column) -> DataFrame:
    """The stretches of ``[low, high)`` that disjoint ``merged`` ranges leave free."""
    w = Window.partitionBy(*keys).orderBy(start)
    edges = F.array(
        F.struct(F.coalesce(F.lag(stop).over(w), low).alias("gap_start"), F.col(start).alias("gap_stop")),
        F.struct(F.when(F.lead(start).over(w).isNull(), F.col(stop)).alias("gap_start"), high.alias("gap_stop")),
    )
    return merged.select(*keys, edges.alias("_edges")).select(*keys, F.inline("_edges")).where(F.col("gap_start") < F.col("gap_stop"))
