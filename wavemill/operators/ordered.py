"""Ordered operations that stay distributed when one key holds much of the data.

A window partition is one task. Here the rows are range-partitioned by (keys,
order), so a crowded key spreads over many chunks; windows run inside chunks,
and what crosses their borders (counts, sums, last rows) comes from one row per
(key, chunk). Chunks are written once, so that they are the same for all uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.session import small_side, written

CHUNK = "_chunk"


def chunked(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """``df`` with a chunk number, ascending in (keys, order). Equal rows of (keys, order) share a chunk; nulls come first."""
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _carried(rows: DataFrame, keys: list[str], total: Column, how: str) -> DataFrame:
    """Per (key, chunk) the aggregate of the key's earlier chunks; at most one row per key and chunk."""
    per = rows.groupBy(*keys, CHUNK).agg(total.alias("_t"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias("_k_chunk"), getattr(F, how)("_t").over(before).alias("_before"))


def _with_carried(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    on = rows[CHUNK] == carried["_k_chunk"]
    for k in keys:
        on &= rows[k].eqNullSafe(carried[f"_k_{k}"])
    return rows.join(small_side(carried), on, "left").drop("_k_chunk", *[f"_k_{k}" for k in keys])


def numbered(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """``row_no`` from 1 in the order of each key, and ``n_rows`` of the key. Ties in ``order`` are numbered in any order: add a unique column."""
    rows = chunked(df, keys, order, chunks)
    per = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_t"))
    w = Window.partitionBy(*keys)
    carried = per.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(CHUNK).alias("_k_chunk"),
        F.coalesce(F.sum("_t").over(w.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_t").over(w).alias("n_rows"),
    )
    own = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order))
    return _with_carried(rows.withColumn("_no", own), carried, keys).withColumn("row_no", F.col("_before") + F.col("_no")).drop("_before", "_no", CHUNK)


def running(df: DataFrame, keys: list[str], order: list[str], name: str, value: Column, how: str = "sum", chunks: int | None = None) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` of ``value`` up to and with each row."""
    rows = chunked(df.withColumn("_v", value), keys, order, chunks)
    agg = getattr(F, how)
    carried = _carried(rows, keys, agg("_v"), how)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = _with_carried(rows.withColumn("_own", agg("_v").over(inside)), carried, keys)
    joined = {"sum": F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.col("_own"), F.lit(0)), "max": F.greatest("_before", "_own"), "min": F.least("_before", "_own")}[how]
    return both.withColumn(name, joined).drop("_v", "_own", "_before", CHUNK)


def previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], chunks: int | None = None) -> DataFrame:
    """The row before each row of its key: ``columns`` maps a column to the name of its previous value (null for the first row)."""
    rows = chunked(df, keys, order, chunks)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    last = F.max_by(F.struct(*columns), F.struct(*order))
    carried = _carried(rows, keys, last, "last")
    got = rows.withColumn("_prev", F.lag(F.struct(*columns)).over(w))
    got = _with_carried(got, carried, keys).withColumn("_prev", F.coalesce("_prev", "_before"))
    return got.select(*df.columns, *[F.col(f"_prev.{c}").alias(n) for c, n in columns.items()])


def last_known(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, chunks: int | None = None) -> DataFrame:
    """The latest value of ``column`` that isn't null, up to and with each row."""
    rows = chunked(df, keys, order, chunks)
    seen = F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.struct(*order)))
    per = rows.groupBy(*keys, CHUNK).agg(seen.alias("_t"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias("_k_chunk"), F.last("_t", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = _with_carried(rows.withColumn("_own", F.last(column, ignorenulls=True).over(inside)), carried, keys)
    return got.withColumn(name, F.coalesce("_own", "_before")).drop("_own", "_before", CHUNK)
