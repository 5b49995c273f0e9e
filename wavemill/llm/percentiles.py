"""Exact percentiles per group from one distributed sort.

The values are range-partitioned and sorted by (group, value, id), so that a
group with a third of all rows takes up many partitions and repeats of a row lie
together. The sorted rows are written once, each with its partition and place.
Counts per (partition, group) give every group's offsets; a target position is
then one known row, and only those rows are joined back. The result has no
error: it is the order statistic, or the interpolation between two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.session import small_side, written


def sorted_values(df: DataFrame, groups: list[str], value: Column | str, ids: list[str], valid: Column | None = None, partitions: int | None = None) -> DataFrame:
    """The sort: ``groups, value, rid``, written out; ``rid`` is the partition (above bit 33) and the place in it.

    Null and NaN values, values for which ``valid`` isn't true and rows with a
    null group are left out. Rows equal in groups, value and ``ids`` count once;
    a row with a null id is no repeat of any other.
    """
    spark = df.sparkSession
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    g_names, i_names = [f"_g{i}" for i in range(len(groups))], [f"_i{i}" for i in range(len(ids))]
    rows = df.select(
        *[F.col(c).alias(n) for c, n in zip(groups, g_names, strict=True)],
        v.alias("value"),
        *[F.col(c).alias(n) for c, n in zip(ids, i_names, strict=True)],
        F.coalesce(valid if valid is not None else F.lit(True), F.lit(False)).alias("_valid"),
    )
    rows = rows.where(F.col("_valid") & F.col("value").isNotNull() & ~F.isnan("value")).drop("_valid").dropna(subset=g_names)
    if ids:
        missing = F.lit(False)
        for n in i_names:
            missing |= F.col(n).isNull()
        i_names = [*i_names, "_solo"]
        rows = rows.withColumn("_solo", F.when(missing, F.monotonically_increasing_id()))
    keys = [*g_names, "value", *i_names]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *keys)
    if ids:
        rows = rows.dropDuplicates(keys)  # the ranges keep equal keys together: no second shuffle
    rows = rows.sortWithinPartitions(*keys)
    return written(rows.select(*[F.col(n).alias(c) for c, n in zip(groups, g_names, strict=True)], "value", F.monotonically_increasing_id().alias("rid")), "sorted")


def _offsets(ranked: DataFrame, groups: list[str]) -> DataFrame:
    """Per (group, partition): ``first`` rid, ``n`` rows, ``before`` (rows of the group in earlier partitions) and ``total``. A group has at most one row per partition."""
    part = ranked.groupBy(*groups, F.shiftright("rid", 33).alias("_pid")).agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first"))
    w = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("n").over(w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.select("*", before.alias("before"), F.sum("n").over(w).alias("total"))


def at_positions(ranked: DataFrame, groups: list[str], positions: Column) -> DataFrame:
    """Values at places of each group's ascending order.

    ``positions`` gives an array of ``struct<tag, place>`` from ``total``; places
    count from 1. Result: ``groups, tag, place, total, value``.
    """
    wanted = _offsets(ranked, groups).select("*", F.inline(positions)).where((F.col("place") > F.col("before")) & (F.col("place") <= F.col("before") + F.col("n")))
    wanted = written(wanted.select(*groups, "tag", "place", "total", (F.col("first") + F.col("place") - F.col("before") - 1).alias("rid")), "places")
    return ranked.select("rid", "value").join(small_side(wanted), "rid").select(*groups, "tag", "place", "total", "value")


def percentiles(ranked: DataFrame, groups: list[str], pcts: list[int]) -> DataFrame:
    """Nearest-rank percentiles: place ``ceil(p * n / 100)`` (1 for p = 0). Result: ``groups, pct, n, value``."""
    each = F.array(*[F.struct(F.lit(int(p)).alias("tag"), F.greatest(F.lit(1).cast("long"), F.expr(f"({int(p)} * total + 99) div 100")).alias("place")) for p in pcts])
    return at_positions(ranked, groups, each).select(*groups, F.col("tag").alias("pct"), F.col("total").alias("n"), "value")


def quantiles(ranked: DataFrame, groups: list[str], pcts: list[int]) -> DataFrame:
    """Percentiles interpolated linearly between the neighbouring order statistics, at ``(n - 1) * p / 100``. Result: ``groups, pct, n, value``."""
    pair = []
    for p in pcts:
        low = F.expr(f"({int(p)} * (total - 1)) div 100 + 1")
        pair += [F.struct(F.lit(2 * int(p)).alias("tag"), low.alias("place")), F.struct(F.lit(2 * int(p) + 1).alias("tag"), F.least(low + 1, F.col("total")).alias("place"))]
    got = at_positions(ranked, groups, F.array(*pair)).withColumn("pct", F.expr("tag div 2").cast("int"))
    side = lambda odd: F.max(F.when(F.col("tag") % 2 == odd, F.col("value")))
    both = got.groupBy(*groups, "pct").agg(F.max("total").alias("n"), side(0).alias("a"), side(1).alias("b"))
    share = F.pmod(F.col("pct") * (F.col("n") - 1), F.lit(100)) / 100
    return both.select(*groups, "pct", "n", (F.col("a") + (F.col("b") - F.col("a")) * share).alias("value"))


# --- reductions that can be put together later ------------------------------


def reduced(ranked: DataFrame, groups: list[str]) -> DataFrame:
    """A day's (or any part's) reduction: ``groups, value, weight``, its sorted values with how often each occurs. Nothing is lost."""
    return ranked.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("weight"))


def merged_percentiles(parts: DataFrame, groups: list[str], pcts: list[int], partitions: int | None = None) -> DataFrame:
    """Nearest-rank percentiles of reductions put together: the same as of all their rows at once. Result: ``groups, pct, n, value``."""
    n = partitions or int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = parts.groupBy(*groups, "value").agg(F.sum("weight").alias("weight"))
    ranged = written(summed.repartitionByRange(n, *groups, "value").withColumn("_pid", F.spark_partition_id()), "merged")
    w = Window.partitionBy(*groups)
    part = ranged.groupBy(*groups, "_pid").agg(F.sum("weight").alias("_n"))
    part = part.select("*", F.coalesce(F.sum("_n").over(w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("_n").over(w).alias("total"))
    each = F.array(*[F.struct(F.lit(int(p)).alias("pct"), F.greatest(F.lit(1).cast("long"), F.expr(f"({int(p)} * total + 99) div 100")).alias("place")) for p in pcts])
    wanted = part.select("*", F.inline(each)).where((F.col("place") > F.col("before")) & (F.col("place") <= F.col("before") + F.col("_n")))
    inside = Window.partitionBy(*groups, "_pid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("_upto", F.sum("weight").over(inside))
    hit = running.join(small_side(written(wanted.drop("_n"), "places")), [*groups, "_pid"])
    upto = F.col("before") + F.col("_upto")
    return hit.where((upto >= F.col("place")) & (upto - F.col("weight") < F.col("place"))).select(*groups, "pct", F.col("total").alias("n"), "value")
