"""Busy periods and free gaps of the sub-bands of each capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.operators.dyadic import CELL_BITS, busy_and_gaps
from wavemill.session import small_side

#: Most buckets of frequency; with fewer bands there are as many as bands.
BUCKETS = 4_096


def _in_bands(a: DataFrame, b: DataFrame) -> DataFrame:
    """Annotations with each band that ``low < b_high`` and ``high > b_low`` hold for: an equi-join on the buckets both touch, each pair in its first common one.

    A band without width, or with its edges turned, is in an annotation that goes beyond both its edges.
    """
    span = b.agg(F.min(F.least("b_low", "b_high")).alias("low"), F.max(F.greatest("b_low", "b_high")).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if not span["n"]:
        return a.join(b, F.lit(False))
    width = max((span["high"] - span["low"]) / min(span["n"], BUCKETS), 1e-9)
    last = int((span["high"] - span["low"]) / width)
    bucket = lambda x: F.least(F.greatest(F.floor((x - span["low"]) / width), F.lit(0)), F.lit(last)).cast("int")
    near = a.where((F.col("low") < span["high"]) & (F.col("high") > span["low"])).withColumn("_a0", bucket(F.greatest("low", F.lit(span["low"]))))
    near = near.withColumn("_bucket", F.explode(F.sequence("_a0", bucket(F.least("high", F.lit(span["high"]))))))
    bands = b.withColumn("_b0", bucket(F.least("b_low", "b_high"))).withColumn("_bucket", F.explode(F.sequence("_b0", bucket(F.greatest("b_low", "b_high")))))
    pairs = near.join(small_side(bands), "_bucket")
    return pairs.where((F.col("low") < F.col("b_high")) & (F.col("high") > F.col("b_low")) & (F.col("_bucket") == F.greatest("_a0", "_b0")))


def band_occupancy(annotations: DataFrame, captures: DataFrame, bands: DataFrame, cell_bits: int = CELL_BITS) -> DataFrame:
    """Busy and free stretches per (``stem``, ``band_id``): ``stem, band_id, seg_kind, seg_start, seg_stop``.

    An annotation covers ``[sample_start, sample_start + sample_count)``, up to
    ``n_samples`` if its count is null or 0, and lies in every band it overlaps.
    It is left out if its start, an edge (null or NaN) or its capture is missing,
    its count is negative, or nothing remains after cutting to
    ``[0, n_samples)``. Repeated annotations and captures change nothing; a
    capture told twice with different lengths has the larger. Extra columns are
    ignored; empty tables give an empty result. Bands with a null or NaN edge
    are left out.
    """
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    a = annotations.select(
        "stem",
        F.col("sample_start").cast("long").alias("start"),
        F.coalesce(F.col("sample_count"), F.lit(0)).cast("long").alias("count"),
        F.least(real("freq_lower_hz"), real("freq_upper_hz")).alias("low"),
        F.greatest(real("freq_lower_hz"), real("freq_upper_hz")).alias("high"),
        (real("freq_lower_hz").isNotNull() & real("freq_upper_hz").isNotNull()).alias("edges"),
    ).where("stem is not null and start is not null and count >= 0 and edges")
    c = captures.groupBy("stem").agg(F.max("n_samples").cast("long").alias("extent"))
    b = bands.select("band_id", F.col("band_lower_hz").alias("b_low"), F.col("band_upper_hz").alias("b_high")).dropna().where("not isnan(b_low) and not isnan(b_high)").distinct()
    found = _in_bands(a, b)
    stop: Column = F.when(F.col("count") == 0, F.col("extent")).otherwise(F.coalesce(F.try_add("start", "count"), "extent"))
    found = found.select("stem", "band_id", "start", "count").join(c, "stem")
    return busy_and_gaps(found, ["stem", "band_id"], "start", stop, "extent", cell_bits)
