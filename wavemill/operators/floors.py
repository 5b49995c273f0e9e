"""Learned noise floors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.ordered import numbered
from wavemill.session import written


def dynamic_floor(df: DataFrame, keys: list[str], order: list[str], level: str, slot_frames: int, slots: int) -> DataFrame:
    """``floor``: the least level of the current slot so far, of the ``slots - 1`` slots before, and of the first frame while fewer slots are full.

    A slot is ``slot_frames`` frames of a key. Windows run inside slots and over
    one row per slot.
    """
    rows = written(numbered(df, keys, order).withColumn("_slot", F.expr(f"(row_no - 1) div {slot_frames}")), "slots")
    so_far = Window.partitionBy(*keys, "_slot").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    per = rows.groupBy(*keys, "_slot").agg(F.min(level).alias("_low"), F.max(F.when(F.col("row_no") == 1, F.col(level))).alias("_seed"))
    w = Window.partitionBy(*keys).orderBy("_slot")
    per = per.select(*keys, "_slot", F.min("_low").over(w.rangeBetween(-(slots - 1), -1)).alias("_before"), F.when(F.col("_slot") < slots - 1, F.max("_seed").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("_seeded"))
    return rows.withColumn("_own", F.min(level).over(so_far)).join(per, [*keys, "_slot"]).withColumn("floor", F.least("_own", "_before", "_seeded")).drop("_own", "_before", "_seeded", "_slot", "row_no", "n_rows")
