"""Boxes on the time-frequency plane: half-open rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.operators.intervals import overlap_join
from wavemill.session import written

SIDES = ["row0", "row1", "col0", "col1"]


def area(p: str = "", pixel: int = 0) -> Column:
    """Height times width; ``pixel=1`` counts inclusive pixels."""
    return (F.col(f"{p}row1") - F.col(f"{p}row0") + pixel) * (F.col(f"{p}col1") - F.col(f"{p}col0") + pixel)


def iou(a: str, b: str, pixel: int = 0) -> Column:
    """Intersection over union of two boxes with column prefixes ``a`` and ``b``; 0 if the union is empty."""
    h = F.least(f"{a}row1", f"{b}row1") - F.greatest(f"{a}row0", f"{b}row0") + pixel
    w = F.least(f"{a}col1", f"{b}col1") - F.greatest(f"{a}col0", f"{b}col0") + pixel
    inter = F.greatest(h, F.lit(0)) * F.greatest(w, F.lit(0))
    return F.coalesce(inter / F.nullif(area(a, pixel) + area(b, pixel) - inter, F.lit(0)), F.lit(0.0))


def _prefixed(df: DataFrame, keys: list[str], p: str, *more: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(p + c) for c in (*SIDES, *more)])


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], carry: tuple[str, ...], height: int) -> DataFrame:
    """Pairs of boxes of one key that overlap, as ``a_*`` and ``b_*``: only those, found by buckets of rows."""
    pairs = overlap_join(_prefixed(left, keys, "a_", *carry), _prefixed(right, keys, "b_", *carry), ("a_row0", "a_row1"), ("b_row0", "b_row1"), height, keys)
    return pairs.where((F.col("a_col0") < F.col("b_col1")) & (F.col("b_col0") < F.col("a_col1")))


def best_iou(left: DataFrame, right: DataFrame, keys: list[str], box: str, height: int = 64) -> DataFrame:
    """Per left box the highest IoU with a right box of the same key, 0 without any: ``keys, box, best``."""
    hits = overlapping(left, right, keys, (box,), height).groupBy(*keys, F.col(f"a_{box}").alias(box)).agg(F.max(iou("a_", "b_")).alias("best"))
    return left.select(*keys, box).distinct().join(hits, [*keys, box], "left").fillna(0.0, ["best"])


def suppress(boxes: DataFrame, keys: list[str], box: str, score: str, threshold: float, height: int = 64) -> DataFrame:
    """Greedy non-maximum suppression: by falling score (ties: the smaller ``box`` first) a box is kept if its IoU with every kept one is below ``threshold``.

    The same outcome without an order of work: a box all of whose better
    overlapping neighbours are decided is decided; rounds go on until all are.
    Boxes of a key are never brought together, only those that overlap enough.
    Areas count inclusive pixels, as box corners are pixels here.
    """
    rows = written(boxes.select(*keys, box, score, *SIDES), "boxes")
    grown = rows.withColumns({"row1": F.col("row1") + 1, "col1": F.col("col1") + 1})  # inclusive corners
    pairs = overlapping(grown, grown, keys, (box, score), height)
    better = (F.col("a_" + score) > F.col("b_" + score)) | ((F.col("a_" + score) == F.col("b_" + score)) & (F.col("a_" + box) < F.col("b_" + box)))
    edges = written(pairs.where(better & (iou("a_", "b_") >= threshold)).select(*keys, F.col("a_" + box).alias("x"), F.col("b_" + box).alias("y")), "edges")
    open_ = rows.select(*keys, F.col(box).alias("y"))
    kept = []
    while True:
        # Boxes that no undecided one outdoes are kept; those they outdo go. Only the others stay for the next round.
        free = written(open_.join(edges, [*keys, "y"], "left_anti"), "kept")
        kept.append(free)
        gone = edges.join(free.withColumnRenamed("y", "x"), [*keys, "x"], "left_semi").select(*keys, "y").distinct()
        open_ = written(open_.join(free, [*keys, "y"], "left_anti").join(gone, [*keys, "y"], "left_anti"), "open")
        if open_.isEmpty():
            break
        edges = written(edges.join(open_, [*keys, "y"], "left_semi").join(open_.withColumnRenamed("y", "x"), [*keys, "x"], "left_semi"), "edges")
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    return boxes.join(every.withColumnRenamed("y", box), [*keys, box], "left_semi")


def merge_close(boxes: DataFrame, keys: list[str], row_gap: int, col_gap: int, count: str, height: int = 64) -> DataFrame:
    """Boxes (inclusive corners) whose rows and columns are within the gaps become one, again and again until none are: ``keys, row0..col1``, summed ``count``."""
    now = written(boxes.select(*keys, *SIDES, F.col(count).cast("long").alias(count)).withColumn("id", F.monotonically_increasing_id()), "boxes")
    while True:
        # One box reaches out by the gaps, half-open; a pair meets if the lower one's reach takes in the other, tested in either direction.
        reach = now.withColumns({"row1": F.col("row1") + 1 + row_gap, "col1": F.col("col1") + 1 + col_gap})
        pairs = overlap_join(_prefixed(reach, keys, "a_", "id"), _prefixed(now.withColumn("row1", F.col("row1") + 1), keys, "b_", "id"), ("a_row0", "a_row1"), ("b_row0", "b_row1"), height, keys)
        near = pairs.where((F.col("a_id") != F.col("b_id")) & (F.col("b_col0") < F.col("a_col1")) & (F.col("a_col0") <= F.col("b_col1") + col_gap))
        edges = written(near.select(*keys, F.col("a_id").alias("x"), F.col("b_id").alias("y")), "edges")
        if edges.isEmpty():
            return now.drop("id")
        both = edges.unionByName(edges.select(*keys, F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy(*keys, F.col("x").alias("id")).agg(F.min("y").alias("m"))
        to = now.join(least, [*keys, "id"], "left").select(*keys, "id", F.least("id", F.coalesce("m", "id")).alias("to"))
        to = written(to, "targets")
        while True:  # targets of targets, so that a chain of boxes is one after a few turns
            further = to.select(*keys, F.col("id").alias("to"), F.col("to").alias("far"))
            jumped = written(to.join(further, [*keys, "to"]), "targets")
            to = jumped.select(*keys, "id", F.col("far").alias("to"))
            if jumped.where("far <> to").isEmpty():
                break
        target = now.join(to, [*keys, "id"])
        now = written(target.groupBy(*keys, "to").agg(F.min("row0").alias("row0"), F.max("row1").alias("row1"), F.min("col0").alias("col0"), F.max("col1").alias("col1"), F.sum(count).alias(count)).withColumnRenamed("to", "id"), "boxes")


def physical(df: DataFrame, rows: int, cols: int, samples: Column, center: Column, rate: Column) -> DataFrame:
    """Half-open pixel boxes as samples and Hz: ``start_sample, stop_sample, low_hz, high_hz``."""
    return df.withColumns({
        "start_sample": F.floor(F.col("row0") / F.lit(rows) * samples),
        "stop_sample": F.least(F.ceil(F.col("row1") / F.lit(rows) * samples), samples),
        "low_hz": center + (F.col("col0") / F.lit(cols) - 0.5) * rate,
        "high_hz": center + (F.col("col1") / F.lit(cols) - 0.5) * rate,
    })


def normalised(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """Centre and size over the grid, within [0, 1]; boxes without height or width are left out."""
    one = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    kept = df.where((F.col("row1") > F.col("row0")) & (F.col("col1") > F.col("col0")))
    return kept.withColumns({
        "cx": one((F.col("col0") + F.col("col1")) / 2 / cols), "cy": one((F.col("row0") + F.col("row1")) / 2 / rows),
        "w": one((F.col("col1") - F.col("col0")) / cols), "h": one((F.col("row1") - F.col("row0")) / rows),
    })
