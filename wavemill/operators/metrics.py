"""Detection and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.operators.ordered import numbered, written


def real(c: str | Column) -> Column:
    """A number, or null for what isn't one: text that can't be read, and NaN."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def detection_rate(df: DataFrame, by: list[str], value: str, threshold: float) -> DataFrame:
    """Per group the share of rows with ``value >= threshold``; missing values count as not detected."""
    hit = F.when(real(value) >= threshold, 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 9).alias("rate"))


def index_percentiles(df: DataFrame, keys: list[str], value: str, tie: list[str], pcts: list[int]) -> DataFrame:
    """The element ``int(n * p / 100)`` of each key's sorted values, the last one for p = 100: ``keys, pct, value``. Exact, by a distributed sort."""
    rows = numbered(df.where(F.col(value).isNotNull()).select(*keys, value, *tie), keys, [value, *tie])
    at = F.array(*[F.struct(F.lit(p).alias("pct"), F.least(F.expr(f"(n_rows * {p}) div 100"), F.col("n_rows") - 1).alias("place")) for p in pcts])
    return rows.select(*keys, F.col(value).alias("value"), "row_no", F.inline(at)).where(F.col("row_no") - 1 == F.col("place")).select(*keys, "pct", "value")


def trimmed(df: DataFrame, keys: list[str], order: list[str], first: int, last: int) -> DataFrame:
    """Without the first and last rows of each key."""
    return numbered(df, keys, order).where((F.col("row_no") > first) & (F.col("row_no") <= F.col("n_rows") - last))


def top_fraction_mean(df: DataFrame, keys: list[str], value: str, tie: list[str], fraction: float) -> DataFrame:
    """Mean of the largest ``max(1, round(fraction * n))`` values of each key, halves rounded to even."""
    rows = numbered(df.where(F.col(value).isNotNull()).withColumn("_neg", -F.col(value)), keys, ["_neg", *tie])
    kept = rows.where(F.col("row_no") <= F.greatest(F.lit(1), F.bround(F.col("n_rows") * fraction)))
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("top_mean"))


def binned_rate(df: DataFrame, value: Column, low: float, high: float, bins: int, hit: Column) -> DataFrame:
    """Equal-width bins, open to the right; values out of range are left out: ``bin_low, n, hits, rate``."""
    width = (high - low) / bins
    rows = df.select(value.alias("_x"), hit.alias("_hit")).where((F.col("_x") >= low) & (F.col("_x") < high))
    b = rows.groupBy(F.floor((F.col("_x") - low) / width).alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_hit").cast("long")).alias("hits"))
    return b.select((F.col("_bin") * width + low).alias("bin_low"), "n", "hits", F.round(F.col("hits") / F.col("n"), 9).alias("rate"))


def best_threshold(df: DataFrame, by: list[str], score: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """The first threshold with the highest micro-F1: ``by, threshold, f1``. One pass: each row goes to the thresholds it reaches, as counts."""
    reached = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    per = df.where(F.col(score).isNotNull()).groupBy(*by, reached.alias("_r")).agg(F.count_if(truth).alias("_p"), F.count(F.lit(1)).alias("_n"))
    each = per.select(*by, F.posexplode(F.array(*[F.lit(t) for t in thresholds])).alias("_i", "threshold"), "_r", "_p", "_n")
    got = F.col("_r") > F.col("_i")
    c = each.groupBy(*by, "threshold").agg(F.sum(F.when(got, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(got, F.col("_n") - F.col("_p")).otherwise(0)).alias("fp"), F.sum(F.when(~got, F.col("_p")).otherwise(0)).alias("fn"))
    c = c.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)))
    return c.groupBy(*by).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select(*by, "b.threshold", F.round("b.f1", 9).alias("f1"))


def mad_outliers(df: DataFrame, keys: list[str], value: str, tie: list[str], k: float) -> DataFrame:
    """Rows above ``median + k * (1.4826 * MAD + 1e-6)`` of their key, as ``hit``: an energy gate. Medians of even counts lie between the middle two."""
    rows = written(df.where(F.col(value).isNotNull()), "values")

    def median(d: DataFrame, c: str, name: str) -> DataFrame:
        n = numbered(d.select(*keys, c, *tie), keys, [c, *tie])
        mid = n.where((F.col("row_no") == F.expr("(n_rows + 1) div 2")) | (F.col("row_no") == F.expr("n_rows div 2 + 1")))
        return mid.groupBy(*keys).agg(F.avg(c).alias(name))

    m = median(rows, value, "median")
    off = rows.join(m, keys).withColumn("_off", F.abs(F.col(value) - F.col("median")))
    both = off.join(median(off, "_off", "mad"), keys)
    return both.withColumn("hit", F.col(value) > F.col("median") + k * (F.col("mad") * 1.4826 + 1e-6)).drop("_off")


def quantiles(df: DataFrame, keys: list[str], value: str, tie: list[str], wanted: dict[str, float], count: str | None = None) -> DataFrame:
    """Exact quantiles per key, interpolated at ``q * (n - 1)``: ``keys``, a column per name, and the number of values under ``count``. By a distributed sort, so groups may be of any size; without keys, of all rows."""
    rows = numbered(df.where(F.col(value).isNotNull()).select(*keys, value, *tie), keys, [value, *tie])
    out = [F.max("n_rows").alias(count)] if count else []
    for name, q in wanted.items():
        h = F.lit(q) * (F.col("n_rows") - 1)
        low = F.floor(h)
        share = F.when(F.col("row_no") - 1 == low, 1 - (h - low)).when(F.col("row_no") - 2 == low, h - low)
        out.append(F.sum(F.col(value) * share).alias(name))
    return rows.groupBy(*keys).agg(*out)
