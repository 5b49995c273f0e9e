"""Names of captures and frames that come in several spellings, and regions known by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.session import small_side, written

BOX = ["row0", "row1", "col0", "col1"]
CONTENT = ["label", "kind", "attenuation_db", "bandwidth_hz", "length_samples", "time_group"]


def plain_name(c: Column) -> Column:
    """A capture's name without folder, file ending, case and kind of separator."""
    s = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^.*[/\\]", "")
    s = F.regexp_replace(F.lower(s), r"\.sigmf([-_ ]?(meta|data))?$", "")
    return F.regexp_replace(F.regexp_replace(s, r"[\s\-_.]+", "_"), r"^_+|_+$", "")


def known_captures(spelled: DataFrame, captures: DataFrame) -> DataFrame:
    """``_raw, capture``: for each spelling in ``_raw`` the stem it means, exactly or else by its plain name. Names of no capture are left out."""
    names = captures.select("stem").where("stem is not null").distinct()
    spelled = spelled.select("_raw").where("_raw is not null").distinct()
    exact = names.select(F.col("stem").alias("_raw"), F.col("stem").alias("_exact"))
    loose = names.groupBy(plain_name(F.col("stem")).alias("_plain")).agg(F.min("stem").alias("_loose"))
    known = spelled.withColumn("_plain", plain_name(F.col("_raw"))).join(exact, "_raw", "left").join(loose, "_plain", "left")
    return small_side(written(known.select("_raw", F.coalesce("_exact", "_loose").alias("capture")).where("capture is not null"), "spelled"))


def region_captures(regions: DataFrame, captures: DataFrame, *carry: str) -> DataFrame:
    """Each region with ``capture``, the stem it belongs to: the stem written in it, else in its frame id, exactly or else by its plain name. Regions of no capture are left out."""
    raw = F.coalesce(F.col("stem"), F.regexp_replace("frame_id", "#[^#]*$", ""))
    rows = regions.select(raw.alias("_raw"), *carry)
    return rows.join(known_captures(rows, captures), "_raw").drop("_raw")


def regions_once(regions: DataFrame, captures: DataFrame) -> DataFrame:
    """Each region once however often it was delivered, with ``capture``, ``frame`` and a ``frame_id`` of these two.

    Where the frame isn't known, ``frame`` is null and ``frame_id`` the capture
    alone; such regions are told apart by their content too. A capture that isn't
    in ``captures`` goes by its plain name.
    """
    number = F.trim(F.substring_index("frame_id", "#", -1))
    frame = F.when(F.col("frame_id").contains("#"), F.coalesce(number.try_cast("long").cast("string"), number))
    raw = F.coalesce(F.regexp_replace("frame_id", "#[^#]*$", ""), F.col("stem"))
    rows = regions.withColumns({"_raw": raw, "frame": frame})
    rows = rows.join(known_captures(rows, captures), "_raw", "left").withColumn("capture", F.coalesce("capture", plain_name(F.col("_raw"))))
    rows = rows.withColumn("frame_id", F.concat_ws("#", "capture", "frame"))
    rows = rows.withColumn("_content", F.when(F.col("frame").isNull(), F.struct(*CONTENT)))
    return rows.dropDuplicates(["capture", "frame", "ann_idx", *BOX, "_content"]).drop("_raw", "_content")
