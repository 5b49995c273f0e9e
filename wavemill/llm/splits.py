"""Splits that keep related records together.

Records and the entities they share make a bipartite graph. Each round gives
every entity the least label of its records and every record the least of its
entities, then follows labels of labels; the distance to the least record
halves, so rounds grow with the logarithm of a component's diameter. A round's
result is a written table. Hot keys are salted.

Components are then assigned whole, every one where the label distributions of
the splits deviate least from the shares wanted, larger ones first. All labels
count, and so does the weight as a whole. Those that hold a thousandth of the
weight or more, at most a thousand, are placed first; what each split then lacks
of each label is shared out over hash shards of the others, which are placed in
parallel, a bounded number in each shard.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.names import region_captures
from wavemill.session import small_side, within, written

HOT_DEGREE, SALTS = 10_000, 32
HEAVY_SHARE, SHARD_UNITS = 1_000, 2_000
#: More different labels than this are an error: each has a target of its own.
MOST_LABELS = 100_000


def _hot(edges: DataFrame, key: str) -> DataFrame | None:
    """The keys with many edges, if there are any; at most one per ``HOT_DEGREE`` edges."""
    hot = written(edges.groupBy(key).count().where(F.col("count") > HOT_DEGREE).select(key), "hot")
    return None if hot.isEmpty() else small_side(hot)


def _salted(edges: DataFrame, key: str, other: str, hot: DataFrame | None, name: str) -> DataFrame:
    """``edges`` with a column that spreads those of each hot key, 0 for all other keys."""
    if hot is None:
        return edges.withColumn(name, F.lit(0))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    return edges.join(hot.withColumn("_hot", F.lit(True)), key, "left").withColumn(name, spread).drop("_hot")


def _onto(edges: DataFrame, values: DataFrame, key: str, hot: DataFrame | None, salt: str) -> DataFrame:
    """Join one value per key to the key's edges, a hot key's in ``SALTS`` pieces."""
    if hot is None:
        return edges.join(values, key)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    values = values.join(hot.withColumn("_hot", F.lit(True)), key, "left").withColumn(salt, F.explode(copies)).drop("_hot")
    return edges.join(values, [key, salt])


def components(records: DataFrame, edges: DataFrame, record: str, entity: str) -> DataFrame:
    """``record, component``: the least record (by code points) connected with each record.

    ``records`` has all records; ``edges`` pairs of record and entity, repeats
    and pairs with a null don't matter. Records without an edge are alone.
    """
    all_records = records.select(F.col(record).alias("r")).where("r is not null").distinct()
    pairs = written(edges.select(F.col(record).alias("r"), F.col(entity).alias("e")).dropna().distinct(), "pairs")
    shared = pairs.groupBy("e").agg(F.min("r").alias("_a"), F.max("r").alias("_b")).where("_a < _b").select("e")  # the others join nothing
    pairs = pairs.join(shared, "e", "left_semi")
    hot_e, hot_r = _hot(pairs, "e"), _hot(pairs, "r")
    pairs = written(_salted(_salted(pairs, "e", "r", hot_e, "salt_e"), "r", "e", hot_r, "salt_r"), "pairs")
    labels = written(pairs.select("r").distinct().withColumn("label", F.col("r")).withColumn("was", F.lit("")), "labels").select("r", "label")
    few = within(labels)
    while True:
        least = _onto(pairs, labels, "r", hot_r, "salt_r").groupBy("e").agg(F.min("label").alias("least"))
        heard = _onto(pairs, least, "e", hot_e, "salt_e").groupBy("r").agg(F.min("least").alias("heard"))
        # The label that the heard record itself has is as good, and may be smaller.
        further = labels.select(F.col("r").alias("heard"), F.col("label").alias("further"))
        further = F.broadcast(further) if few else further
        told = labels.join(heard, "r")
        if few:
            both = told.join(further, "heard")
        else:  # most of a large component hears one label
            told = written(told, "heard")
            hot = _hot(told, "heard")
            both = _onto(_salted(told, "heard", "r", hot, "salt_h"), further, "heard", hot, "salt_h")
        new = written(both.select("r", F.least("label", "heard", "further").alias("label"), F.col("label").alias("was")), "labels")
        labels = new.select("r", "label")
        if new.where("label <> was").isEmpty():
            break
    return all_records.join(labels, "r", "left").select(F.col("r").alias(record), F.coalesce("label", "r").alias("component"))


ALL, NONE, NULL = "all", "none", "null"  # strata beside those of the labels, which begin with "=": all weight, units without weight, and the label null


def place(units: Iterable[tuple[str, dict[str, float]]], targets: dict[str, np.ndarray]) -> tuple[dict[str, int], dict[str, np.ndarray]]:
    """The split of each unit, and the weight that each split then has by label.

    Units, with their weights by label, are taken in order of their weight, ties
    in their own order, and go where the squared deviations from the targets,
    over those, grow least; of equal ones to the first split.
    """
    have = {label: np.zeros(len(t)) for label, t in targets.items()}
    least = {label: np.maximum(t, max(float(t.sum()) * 1e-3, 1e-9)) for label, t in targets.items()}
    out = {}
    for u, own in sorted(units, key=lambda kv: (-kv[1].get(ALL, 0.0), kv[0])):
        worse = sum((w * (2 * (have[x] - targets[x]) + w) / least[x] for x, w in own.items()), np.float64(0))
        best = int(np.argmin(worse))
        for x, w in own.items():
            have[x][best] += w
        out[u] = best
    return out, have


def assign(sizes: DataFrame, unit: str, label: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """``unit, split``: each unit whole in one split, near the given shares of the weight, overall and per label.

    ``sizes`` has the weight of each (unit, label). Shares are scaled to 1. Null
    units are left out; a null label is a label; units without weight are spread
    by the shares as well. More than ``MOST_LABELS`` labels are a ValueError.
    """
    spark = sizes.sparkSession
    names = list(shares)
    part = np.array([shares[n] / sum(shares.values()) for n in names])
    base = sizes.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("u"), F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(NULL)).alias("l")).agg(F.greatest(F.coalesce(F.sum(weight), F.lit(0)), F.lit(0)).cast("double").alias("w"))
    base = written(base, "sizes")
    units = base.groupBy("u").agg(F.sum("w").alias("w"))
    whole = units.select("u", F.when(F.col("w") > 0, ALL).otherwise(NONE).alias("l"), F.when(F.col("w") > 0, F.col("w")).otherwise(1.0).alias("w"))
    base = written(base.where("w > 0").unionByName(whole), "strata")
    summed = base.groupBy("l").agg(F.sum("w").alias("w"))
    if not within(summed, MOST_LABELS):
        raise ValueError(f"more than {MOST_LABELS} labels")
    totals = {r["l"]: r["w"] for r in summed.collect()}
    heavy = base.where((F.col("l") == ALL) & (F.col("w") >= totals.get(ALL, 0.0) / HEAVY_SHARE)).select("u")
    big: dict[str, dict[str, float]] = {}
    for r in base.join(F.broadcast(heavy), "u").collect():  # at most HEAVY_SHARE units
        big.setdefault(r["u"], {})[r["l"]] = r["w"]
    placed, have = place(big.items(), {x: part * w for x, w in totals.items()})
    lack = {x: np.maximum(part * w - have[x], 0.0) for x, w in totals.items()}
    due = [(x, (v / v.sum() if v.sum() > 0 else part).tolist()) for x, v in lack.items()]
    kind = sizes.schema[unit].dataType.simpleString()
    first = spark.createDataFrame([(u, names[k]) for u, k in placed.items()], f"u {kind}, split string")

    light = base.join(F.broadcast(heavy), "u", "left_anti")
    shards = max(1, -(-light.where(F.col("l").isin(ALL, NONE)).count() // SHARD_UNITS))
    light = light.join(small_side(spark.createDataFrame(due, "l string, due array<double>")), "l").withColumn("shard", F.pmod(F.xxhash64("u"), F.lit(shards)))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        own: dict[str, dict[str, float]] = {}
        for u, x, w in zip(rows["u"], rows["l"], rows["w"], strict=True):
            own.setdefault(u, {})[x] = w
        each = rows.groupby("l").agg({"w": "sum", "due": "first"})
        got, _ = place(own.items(), {x: np.array(d) * w for x, w, d in zip(each.index, each["w"], each["due"], strict=True)})
        return pd.DataFrame({"u": list(got), "split": [names[k] for k in got.values()]})

    rest = light.groupBy("shard").applyInPandas(solve, f"u {kind}, split string")
    return first.unionByName(rest).withColumnRenamed("u", unit)


def deviation(sizes: DataFrame, assigned: DataFrame, unit: str, label: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """``label, all, split, n, share, wanted``: what each split has of each label's weight, 0 where it has none; with ``all``, of all labels together."""
    each = sizes.groupBy(unit, F.col(label).alias("label")).agg(F.sum(weight).alias("n")).join(assigned, unit).groupBy("label", "split").agg(F.sum("n").alias("n")).where("n > 0")
    every = each.groupBy("split").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("label"), "split", "n", F.lit(True).alias("all"))
    each = each.select("label", "split", "n", F.lit(False).alias("all")).unionByName(every)
    total = each.groupBy("label", "all").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("by"))  # one entry a split
    out = total.select("label", "all", "total", "by", F.explode(F.array(*[F.struct(F.lit(k).alias("split"), F.lit(v / sum(shares.values())).alias("wanted")) for k, v in shares.items()])).alias("s"))
    n = F.coalesce(F.try_element_at("by", F.col("s.split")), F.lit(0))
    return out.select("label", "all", F.col("s.split").alias("split"), n.alias("n"), (n / F.col("total")).alias("share"), F.col("s.wanted").alias("wanted"))


# --- captures, their scenes and their emissions -------------------------

SCENE_END = "_attenuation_dB_"  # fixed value


def capture_groups(captures: DataFrame, regions: DataFrame) -> DataFrame:
    """``stem, component``: captures of one scene or with a set ``time_group`` (not null, not 0) in common are together, and so are their relatives."""
    stems = captures.select("stem").where("stem is not null").distinct()
    scenes = stems.where(F.instr("stem", SCENE_END) > 0).select("stem", F.concat(F.lit("s:"), F.substring_index("stem", SCENE_END, 1)).alias("e"))
    emitted = regions.where("time_group is not null and time_group <> 0").select("stem", "frame_id", "time_group").distinct()
    emissions = region_captures(emitted, captures, "time_group").select(F.col("capture").alias("stem"), F.concat(F.lit("t:"), F.col("time_group").cast("string")).alias("e"))
    return components(stems, scenes.unionByName(emissions), "stem", "e")


SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}


def _group_sizes(groups: DataFrame, captures: DataFrame, regions: DataFrame) -> DataFrame:
    """``group_stem, label, n``: regions of each group by label, repeats once; a group without any has a row."""
    frame = F.when(F.col("frame_id").contains("#"), F.substring_index("frame_id", "#", -1))
    keys = ["ann_idx", "row0", "row1", "col0", "col1"]
    rows = region_captures(regions.withColumn("_frame", frame), captures, "_frame", *keys, "label").dropDuplicates(["capture", "_frame", *keys])
    sizes = rows.groupBy(F.col("capture").alias("stem"), F.upper(F.trim("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return written(groups.join(sizes, "stem", "left").select("group_stem", "label", F.coalesce("n", F.lit(0)).alias("n")), "group-sizes")


def capture_splits(captures: DataFrame, regions: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """``stem, group_stem, split``, in proportion by rows of ``regions`` (repeats count once), 70/15/15 unless told otherwise."""
    groups = written(capture_groups(captures, regions).withColumnRenamed("component", "group_stem"), "groups")
    chosen = assign(_group_sizes(groups, captures, regions), "group_stem", "label", "n", shares or SHARES)
    return groups.join(chosen, "group_stem").select("stem", "group_stem", "split")


def split_deviation(captures: DataFrame, regions: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """How near the splits of :func:`capture_splits` come to the shares, per label and in all."""
    groups = written(capture_groups(captures, regions).withColumnRenamed("component", "group_stem"), "groups")
    sizes = _group_sizes(groups, captures, regions)
    return deviation(sizes, assign(sizes, "group_stem", "label", "n", shares or SHARES), "group_stem", "label", "n", shares or SHARES)
