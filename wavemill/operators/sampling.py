"""Frame samplers, splits by position, and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.operators.ordered import numbered


def stride(df: DataFrame, keys: list[str], order: list[str], every: int) -> DataFrame:
    """Frames ``every``, ``2 * every``, ... of each channel, never the first."""
    if every <= 0:
        raise ValueError("the interval must be positive")
    return numbered(df, keys, order).where(F.col("row_no") % every == 0)


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """``count`` frames spread over each key, first and last among them: indices ``round(i * (n - 1) / (count - 1))``, halves to even; all frames of shorter keys."""
    if count < 1:
        raise ValueError("at least one frame must be asked for")
    rows = numbered(df, keys, order)
    if count == 1:
        return rows.where("row_no = 1")
    i = F.round((F.col("row_no") - 1) * (count - 1) / F.greatest(F.col("n_rows") - 1, F.lit(1)))
    near = F.array(*[F.bround((i + d) * (F.col("n_rows") - 1) / F.lit(count - 1)) for d in (-1, 0, 1)])
    wanted = F.exists(F.arrays_zip(near.alias("at"), F.array(i - 1, i, i + 1).alias("i")), lambda x: (x["at"] == F.col("row_no") - 1) & (x["i"] >= 0) & (x["i"] <= count - 1))
    return rows.where((F.col("n_rows") <= count) | wanted)


def temporal_split(df: DataFrame, keys: list[str], order: list[str], train: float, val: float, guard: int) -> DataFrame:
    """``split`` by position in each key: train, ``guard`` frames left out, val, ``guard`` left out, test."""
    rows = numbered(df, keys, order)
    i, n = F.col("row_no") - 1, F.col("n_rows")
    a, b = F.floor(n * train), F.floor(n * (train + val))
    split = F.when(i < a, "train").when(i < a + guard, None).when(i < b, "val").when(i < b + guard, None).otherwise("test")
    return rows.withColumn("split", split).where("split is not null")


def route(df: DataFrame, decision: Column, *branches) -> DataFrame:
    """Rows for which ``decision`` is true go through the first branch, all others (also null) through the second; both come back as one."""
    yes, no = branches
    taken = F.coalesce(decision, F.lit(False))
    return yes(df.where(taken)).unionByName(no(df.where(~taken)), allowMissingColumns=True)


def fill_missing(df: DataFrame, map_column: str, defaults: dict[str, str]) -> DataFrame:
    """The map with defaults for keys it lacks; its own values win."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.coalesce(F.col(map_column), F.create_map().cast("map<string,string>"))
    lacking = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return df.withColumn(map_column, F.map_concat(lacking, own))


def channel(df: DataFrame, column: str, wanted: int, partial: str | None = None) -> DataFrame:
    """Rows of one channel, of all for -1; ``partial`` names a flag whose rows are skipped."""
    out = df if wanted == -1 else df.where(F.col(column) == wanted)
    return out if partial is None else out.where(~F.coalesce(F.col(partial), F.lit(False)))


def every_nth(df: DataFrame, keys: list[str], order: list[str], every: int, most: int) -> DataFrame:
    """Of each channel's frames ``every``, ``2 * every``, ... the first ``most``."""
    return stride(df, keys, order, every).where(F.col("row_no") <= every * most)


def shed(df: DataFrame, channel: list[str], period: Column, order: list[str], room: int, lost: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """What a sink with room for ``room`` batches a period keeps, and an account of what it drops.

    In each period of a channel the first ``room`` rows are kept and later ones
    dropped, not put off. The account has ``channel, period, n_kept, n_dropped``
    and, for each entry of ``lost``, the sum of that column over the dropped rows;
    nulls count as 0. Rows without a period are kept, as nothing says when they came.
    """
    keys, places = [f"_k{i}" for i in range(len(channel))], [f"_o{i}" for i in range(len(order))]
    named = [F.col(c).alias(n) for c, n in zip([*channel, *order], [*keys, *places], strict=True)]
    rows = numbered(df.select(F.struct(*df.columns).alias("_own"), *named, period.alias("_period")), [*keys, "_period"], places)
    dropped = (F.col("row_no") > max(1, room)) & F.col("_period").isNotNull()
    sums = [F.coalesce(F.sum(F.when(dropped, F.col("_own")[c])), F.lit(0)).alias(name) for name, c in lost.items()]
    account = rows.groupBy(*keys, "_period").agg(F.count_if(~dropped).alias("n_kept"), F.count_if(dropped).alias("n_dropped"), *sums)
    told = [F.col(n).alias(c) for c, n in zip(channel, keys, strict=True)]
    return rows.where(~dropped).select("_own.*"), account.select(*told, F.col("_period").alias("period"), "n_kept", "n_dropped", *lost)
