"""Calibration, mask scores, packs of recordings and other reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavemill.functions import scalar as S
from wavemill.operators import metrics as M
from wavemill.operators.ordered import numbered
from wavemill.plans.detections import _REG, regions
from wavemill.plans.grids import _GRID, N, grid
from wavemill.plans.registry import Registry
from wavemill.plans.streams import recording_offsets
from wavemill.session import small_side
from wavemill.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query(f"""WITH {_GRID}, q AS (SELECT frame, "row", quantile_cont(value, 0.95) AS q FROM g GROUP BY 1, 2), p AS (SELECT "row", quantile_cont(value, 0.95) + 1.5 AS pooled FROM g GROUP BY 1) SELECT p."row", round(p.pooled, 6) AS pooled_floor, round(median(q.q), 6) AS median_floor FROM q JOIN p USING ("row") GROUP BY 1, p.pooled""")
def calibrated_floors(spark, folder):
    """Noise floor per row: a quantile over all frames with a margin, and the median of the frames' own quantiles."""
    g = grid(spark, folder)
    own = g.groupBy("frame", "row").agg(F.percentile("value", F.lit(0.95)).alias("q"))
    own = M.quantiles(own, ["row"], "q", ["frame"], {"m": 0.5}).select("row", F.round("m", 6).alias("median_floor"))
    pooled = M.quantiles(g, ["row"], "value", ["frame", "col"], {"q": 0.95}).select("row", F.round(F.col("q") + 1.5, 6).alias("pooled_floor"))
    return pooled.join(own, "row").select("row", "pooled_floor", "median_floor")


@query(f"""WITH {_GRID} SELECT round(quantile_cont(10 * log10(value + 1e-12), 0.01), 6) AS low_db, round(quantile_cont(10 * log10(value + 1e-12), 0.999), 6) AS high_db, count(*) AS n FROM g""")
def decibel_range(spark, folder):
    """The range that previews are scaled to."""
    db = grid(spark, folder).select("frame", "row", "col", S.to_db(F.col("value")).alias("db"))
    q = M.quantiles(db, [], "db", ["frame", "row", "col"], {"low_db": 0.01, "high_db": 0.999}, "n")
    return q.select(F.round("low_db", 6).alias("low_db"), F.round("high_db", 6).alias("high_db"), "n")


_SCORES = "count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn, count(*) AS n"


@query(f"""WITH {_GRID}, c AS (SELECT frame, value > 10 AS p, value > 20 OR (value > 0 AND col % 8 = 0) AS t FROM g), s AS (SELECT frame, {_SCORES} FROM c GROUP BY 1) SELECT frame, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 9) AS iou, round(fp / n, 9) AS fp_area FROM s""")
def pixel_metrics(spark, folder):
    """Precision, recall, F1, IoU and false-alarm area of a mask against the truth, per frame; 0 where there is nothing to divide by."""
    c = grid(spark, folder).select("frame", (F.col("value") > 10).alias("p"), ((F.col("value") > 20) | ((F.col("value") > 0) & (F.col("col") % 8 == 0))).alias("t"))
    p, t = F.col("p"), F.col("t")
    s = c.groupBy("frame").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count(F.lit(1)).alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 9)
    return s.select("frame", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp + fn).alias("iou"), F.round(fp / F.col("n"), 9).alias("fp_area"))


@query(f"""WITH {_GRID}, m AS (SELECT frame, "row", avg(value) AS m FROM g GROUP BY 1, 2) SELECT frame, round(avg(m) + least(greatest((0.75 - 0.5) / 0.5, 0), 1) * (max(m) - avg(m)), 6) AS reference FROM m GROUP BY 1""")
def frontend_reference(spark, folder):
    """A frame's reference level: as far above the mean of its rows, towards the highest, as the wanted quantile is above one half."""
    m = grid(spark, folder).groupBy("frame", "row").agg(F.avg("value").alias("m"))
    share = min(max((0.75 - 0.5) / 0.5, 0.0), 1.0)
    return m.groupBy("frame").agg(F.round(F.avg("m") + share * (F.max("m") - F.avg("m")), 6).alias("reference"))


@query(f"""WITH {_GRID}, o AS (SELECT frame, value, row_number() OVER (PARTITION BY frame ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY frame) AS n FROM g) SELECT frame, max(value) FILTER (WHERE i = CAST(round(0.5 * (n - 1)) AS BIGINT)) AS q50, max(value) FILTER (WHERE i = CAST(round(0.93 * (n - 1)) AS BIGINT)) AS q93 FROM o GROUP BY 1""")
def nearest_rank_quantiles(spark, folder):
    """The element at ``round(q * (n - 1))``, halves away from zero, of each frame's 1,024 cells."""
    s = grid(spark, folder).groupBy("frame").agg(F.sort_array(F.collect_list("value")).alias("v"))
    at = lambda q: F.element_at("v", (S.half_away(F.lit(q) * (F.size("v") - 1)) + 1).cast("int"))
    return s.select("frame", at(0.5).alias("q50"), at(0.93).alias("q93"))


@query(f"""WITH {_GRID}, f AS (SELECT "row", quantile_cont(value, 0.5) AS f FROM g GROUP BY 1), s AS (SELECT frame, g."row", col, value > f + 30 AS strong FROM g JOIN f USING ("row")), w AS (SELECT *, sum(strong::INT) OVER (PARTITION BY frame, "row" ORDER BY col ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM s) SELECT frame, "row", count(*) FILTER (WHERE strong AND near >= 2) AS n_rescued FROM w GROUP BY 1, 2 HAVING count(*) FILTER (WHERE strong AND near >= 2) > 0""")
def strong_rescue(spark, folder):
    """Cells far above their row's floor with enough such cells around them in time."""
    g = grid(spark, folder)
    f = M.quantiles(g, ["row"], "value", ["frame", "col"], {"f": 0.5})
    w = Window.partitionBy("frame", "row").orderBy("col").rowsBetween(-4, 4)
    s = g.join(small_side(f), "row").withColumn("strong", F.col("value") > F.col("f") + 30)
    s = s.withColumn("near", F.sum(F.col("strong").cast("int")).over(w))
    return s.groupBy("frame", "row").agg(F.count_if(F.col("strong") & (F.col("near") >= 2)).alias("n_rescued")).where("n_rescued > 0")


@query("""WITH s AS (SELECT DISTINCT snippet_id, stem, channel, frame_number, orig_sample_start, n_iq, sample_rate_hz, center_freq_hz FROM snippets), p AS (SELECT *, (dense_rank() OVER (PARTITION BY stem, channel ORDER BY frame_number) - 1) // 4 AS pack FROM s)
SELECT stem, channel, CAST(pack AS BIGINT) AS pack, count(*) AS n_snippets, sum(n_iq)::BIGINT AS n_samples, count(DISTINCT (sample_rate_hz, center_freq_hz)) = 1 AS one_recording FROM p GROUP BY 1, 2, 3""")
def recording_packs(spark, folder):
    """Packs of four frames: one recording if all snippets have one rate and centre, else a container."""
    setting = table(spark, folder, "snippets").select("snippet_id", "n_iq", F.struct("sample_rate_hz", "center_freq_hz").alias("setting")).distinct()
    p = recording_offsets(spark, folder).join(setting, "snippet_id")
    return p.groupBy("stem", "channel", "pack").agg(F.count(F.lit(1)).alias("n_snippets"), F.sum("n_iq").alias("n_samples"), (F.min("setting") == F.max("setting")).alias("one_recording"))


@query(f"""WITH {_REG} SELECT frame_id, count(*) AS n, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), 'noise') AS labels FROM r WHERE bandwidth_hz >= 1e6 AND length_samples BETWEEN 10000 AND 5000000 AND kind IN ('waveform', 'annotation') GROUP BY 1""")
def matching_frames(spark, folder):
    """Frames with regions that meet all filters given, and their labels."""
    filters = {"bandwidth_hz": (1e6, None), "length_samples": (10_000, 5_000_000)}
    r = regions(spark, folder).where(F.col("kind").isin("waveform", "annotation"))
    for c, (low, high) in filters.items():
        r = r.where(F.col(c) >= low) if low is not None else r
        r = r.where(F.col(c) <= high) if high is not None else r
    names = F.array_join(F.sort_array(F.collect_set("label")), ",")
    return r.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.nullif(names, F.lit("")), F.lit("noise")).alias("labels"))


@query("""WITH a AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer), b AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') SELECT c_mktsegment, c_custkey, o_orderkey, k AS place FROM a JOIN b USING (k)""")
def zipped_sources(spark, folder):
    """Two ordered sources read side by side, as far as the shorter one goes."""
    a = numbered(table(spark, folder, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], ["c_custkey"]).select("c_mktsegment", "c_custkey", F.col("row_no").alias("place"))
    b = numbered(table(spark, folder, "orders").where("o_orderstatus = 'O'").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"]).select("o_orderkey", F.col("row_no").alias("place"))
    return a.join(b, "place").select("c_mktsegment", "c_custkey", "o_orderkey", "place")


@query(f"""WITH {_GRID} SELECT frame, "row" // 10 AS tile, CAST("row" % 10 AS INT) AS tile_row, sum(value) AS total FROM g GROUP BY ALL UNION ALL SELECT DISTINCT frame, {N} // 10, k::INT, 0.0 FROM g, range({N} % 10, 10) t(k)""")
def tiled_rows(spark, folder):
    """Frames cut into tiles of ten rows, the last one filled up with zeros."""
    g = grid(spark, folder)
    pad = g.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(N), F.lit(-(-N // 10) * 10 - 1))).alias("row"), F.lit(0.0).alias("value"))
    every = g.select("frame", "row", "value").unionByName(pad)
    return every.groupBy("frame", F.expr("row div 10").alias("tile"), (F.col("row") % 10).alias("tile_row")).agg(F.sum("value").alias("total"))
