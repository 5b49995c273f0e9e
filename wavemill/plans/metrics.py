"""Detector reports, calibration and latency statistics over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.functions import scalar as S
from wavemill.operators import metrics as M
from wavemill.operators.names import regions_once
from wavemill.plans.detections import _ONCE
from wavemill.plans.registry import Registry
from wavemill.session import scratch_path, small_side
from wavemill.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_METRICS = "m AS (SELECT DISTINCT detector, file_stem, frame_number, ann_idx, attenuation_db, signal_class, kind, bandwidth_bucket, length_bucket, CASE WHEN NOT isnan(coverage) THEN coverage END AS coverage, CASE WHEN NOT isnan(box_iou) THEN box_iou END AS box_iou, mask_present FROM region_metrics)"
_KEYS = ["detector", "file_stem", "frame_number", "ann_idx"]


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Each detection once, NaN as null."""
    m = table(spark, folder, "region_metrics").dropDuplicates(_KEYS)
    return m.withColumns({"coverage": M.real("coverage"), "box_iou": M.real("box_iou")}).drop("evaluated_at")


@query(f"WITH {_METRICS} SELECT detector, attenuation_db, count(*) AS n, round(avg(CASE WHEN coverage >= 0.3 THEN 1.0 ELSE 0.0 END), 9) AS rate FROM m GROUP BY 1, 2")
def detection_rate_by_attenuation(spark, folder):
    return M.detection_rate(_metrics(spark, folder), ["detector", "attenuation_db"], "coverage", 0.30)


@query(f"""WITH {_METRICS} SELECT detector, bandwidth_bucket, length_bucket, count(*) AS n, count(coverage) AS n_valid, round(avg(coverage), 9) AS mean_coverage, round(avg(box_iou) FILTER (WHERE mask_present), 9) AS iou_with_mask, round(avg(box_iou) FILTER (WHERE NOT mask_present), 9) AS iou_without
FROM m GROUP BY 1, 2, 3""")
def coverage_by_bucket(spark, folder):
    m = _metrics(spark, folder)
    return m.groupBy("detector", "bandwidth_bucket", "length_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count("coverage").alias("n_valid"), F.round(F.avg("coverage"), 9).alias("mean_coverage"),
        F.round(F.avg(F.when(F.col("mask_present"), F.col("box_iou"))), 9).alias("iou_with_mask"), F.round(F.avg(F.when(~F.col("mask_present"), F.col("box_iou"))), 9).alias("iou_without"),
    )


#: The SQL names the detectors of the tables given; the query finds them.
_RATES = ", ".join(f"max(r) FILTER (WHERE detector = '{d}') AS {d}" for d in ("coherent_sum", "energy_gate", "segmenter_large", "segmenter_small"))


@query(f"""WITH {_METRICS} SELECT signal_class, attenuation_db, {_RATES} FROM (SELECT signal_class, attenuation_db, detector, round(avg(CASE WHEN coverage >= 0.3 THEN 1.0 ELSE 0.0 END), 9) AS r FROM m WHERE detector IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def rate_pivot(spark, folder):
    """Detection rates with a column for every detector there is."""
    r = M.detection_rate(_metrics(spark, folder).where("detector is not null"), ["signal_class", "attenuation_db", "detector"], "coverage", 0.30)
    return r.groupBy("signal_class", "attenuation_db").pivot("detector").agg(F.max("rate"))


@query(f"""WITH {_METRICS}, f AS (SELECT DISTINCT ON (file_stem, frame_number, detector) file_stem, frame_number, detector, coverage FROM m ORDER BY file_stem, frame_number, detector, ann_idx),
p AS (SELECT file_stem, frame_number, max(coverage) FILTER (WHERE detector = 'coherent_sum') AS own, max(coverage) FILTER (WHERE detector <> 'coherent_sum') AS other FROM f GROUP BY 1, 2)
SELECT file_stem, frame_number, round(own - other, 9) AS lead FROM p WHERE own IS NOT NULL AND other IS NOT NULL""")
def detector_lead(spark, folder):
    """How far one detector's first region of a frame is ahead of the best other one, whichever detectors there are."""
    m = _metrics(spark, folder)
    first = m.groupBy("file_stem", "frame_number", "detector").agg(F.min_by(F.struct("coverage"), "ann_idx").alias("first"))
    c, own = F.col("first.coverage"), F.col("detector") == "coherent_sum"
    p = first.groupBy("file_stem", "frame_number").agg(F.max(F.when(own, c)).alias("own"), F.max(F.when(~own, c)).alias("other"))
    return p.where("own is not null and other is not null").select("file_stem", "frame_number", F.round(F.col("own") - F.col("other"), 9).alias("lead"))


@query(f"""WITH {_METRICS}, f AS (SELECT DISTINCT ON (file_stem, frame_number, detector) file_stem, frame_number, detector, signal_class, coverage FROM m ORDER BY file_stem, frame_number, detector, ann_idx),
p AS (SELECT file_stem, frame_number, max(coverage) FILTER (WHERE detector = 'coherent_sum') AS own, max(coverage) FILTER (WHERE detector <> 'coherent_sum') AS other, max(signal_class) AS signal_class FROM f GROUP BY 1, 2)
SELECT signal_class, file_stem, frame_number, round(own - other, 9) AS lead, rank FROM (SELECT *, row_number() OVER (PARTITION BY signal_class ORDER BY round(own - other, 9) DESC, file_stem, frame_number) AS rank FROM p WHERE own IS NOT NULL AND other IS NOT NULL) WHERE rank <= 3""")
def widest_leads(spark, folder):
    """The three frames of each class in which one detector is furthest ahead of all others."""
    m = _metrics(spark, folder)
    first = m.groupBy("file_stem", "frame_number", "detector").agg(F.min_by(F.struct("coverage", "signal_class"), "ann_idx").alias("first"))
    c, own = F.col("first.coverage"), F.col("detector") == "coherent_sum"
    p = first.groupBy("file_stem", "frame_number").agg(F.max(F.when(own, c)).alias("own"), F.max(F.when(~own, c)).alias("other"), F.max("first.signal_class").alias("signal_class"))
    p = p.where("own is not null and other is not null").select("signal_class", "file_stem", "frame_number", F.round(F.col("own") - F.col("other"), 9).alias("lead"))
    w = Window.partitionBy("signal_class").orderBy(F.desc("lead"), "file_stem", "frame_number")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 3")  # the k best of a partition are kept before the shuffle


@query(f"""WITH {_METRICS}, g AS (SELECT detector, CASE WHEN coverage >= t.x THEN 1 ELSE 0 END AS got, box_iou >= 0.5 AS truth, t.x FROM m, (SELECT round(k * 0.05, 2) AS x FROM range(1, 20) r(k)) t WHERE coverage IS NOT NULL),
s AS (SELECT detector, x, coalesce(2.0 * sum(CASE WHEN got = 1 AND coalesce(truth, FALSE) THEN 1 ELSE 0 END) / nullif(sum(got) + sum(CASE WHEN coalesce(truth, FALSE) THEN 1 ELSE 0 END), 0), 0) AS f1 FROM g GROUP BY 1, 2)
SELECT detector, CAST(x AS DOUBLE) AS threshold, round(f1, 9) AS f1 FROM s QUALIFY row_number() OVER (PARTITION BY detector ORDER BY f1 DESC, x) = 1""")
def tuned_threshold(spark, folder):
    return M.best_threshold(_metrics(spark, folder), ["detector"], "coverage", F.coalesce(F.col("box_iou") >= 0.5, F.lit(False)), [round(0.05 * k, 2) for k in range(1, 20)])


@query(f"""WITH {_METRICS} SELECT CAST(floor((coverage - 0.0) / 0.1) * 0.1 + 0.0 AS DOUBLE) AS bin_low, count(*) AS n, sum(CASE WHEN coalesce(box_iou, -1) >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS hits, round(sum(CASE WHEN coalesce(box_iou, -1) >= 0.5 THEN 1 ELSE 0 END) / count(*), 9) AS rate FROM m WHERE coverage >= 0 AND coverage < 1 GROUP BY 1""")
def coverage_histogram(spark, folder):
    return M.binned_rate(_metrics(spark, folder), F.col("coverage"), 0.0, 1.0, 10, F.coalesce(F.col("box_iou") >= 0.5, F.lit(False)))


@query(f"""WITH {_METRICS}, cal AS (SELECT signal_class, bandwidth_bucket, median(coverage) AS snr0, count(*) AS n FROM m WHERE attenuation_db = 0 AND mask_present AND coverage IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT m.detector, m.file_stem, m.frame_number, round(avg(cal.snr0 - m.attenuation_db), 9) AS mean_snr, count(*) AS n, count(cal.snr0) AS n_known FROM m LEFT JOIN cal USING (signal_class, bandwidth_bucket) GROUP BY 1, 2, 3""")
def frame_snr(spark, folder):
    """Calibrated level per class and bandwidth, looked up (a miss is null), less the attenuation, averaged over each frame."""
    m = _metrics(spark, folder)
    loud = m.where("attenuation_db = 0 and mask_present and coverage is not null")
    enough = loud.groupBy("signal_class", "bandwidth_bucket").agg(F.count(F.lit(1)).alias("n_cal")).where("n_cal >= 3")
    cal = M.quantiles(loud, ["signal_class", "bandwidth_bucket"], "coverage", _KEYS, {"snr0": 0.5}).join(enough, ["signal_class", "bandwidth_bucket"])
    j = m.join(small_side(cal), ["signal_class", "bandwidth_bucket"], "left")
    return j.groupBy("detector", "file_stem", "frame_number").agg(F.round(F.avg(F.col("snr0") - F.col("attenuation_db")), 9).alias("mean_snr"), F.count(F.lit(1)).alias("n"), F.count("snr0").alias("n_known"))


@query(f"""WITH {_METRICS}, a AS (SELECT * FROM m WHERE detector = 'energy_gate')
SELECT a.file_stem, a.frame_number, a.ann_idx, b.coverage AS other_coverage, coalesce(b.mask_present, FALSE) AS other_present FROM a LEFT JOIN m b ON b.detector = 'segmenter_large' AND a.file_stem = b.file_stem AND a.frame_number = b.frame_number AND a.ann_idx = b.ann_idx""")
def detector_manifests(spark, folder):
    """One detector's regions beside another's; a region the other lacks has no mask."""
    m = _metrics(spark, folder).select(*_KEYS, "coverage", "mask_present")
    a = m.where("detector = 'energy_gate'").drop("detector", "coverage", "mask_present")
    b = m.where("detector = 'segmenter_large'").select(*_KEYS[1:], F.col("coverage").alias("other_coverage"), F.col("mask_present").alias("_p"))
    return a.join(b, _KEYS[1:], "left").select(*_KEYS[1:], "other_coverage", F.coalesce("_p", F.lit(False)).alias("other_present"))


@query(f"""WITH {_METRICS} SELECT DISTINCT file_stem, frame_number FROM m a WHERE mask_present AND EXISTS (SELECT 1 FROM m b WHERE b.file_stem = a.file_stem AND b.frame_number = a.frame_number AND b.signal_class = 'tone' AND b.coverage >= 0.8)""")
def frames_with_strong_tone(spark, folder):
    m = _metrics(spark, folder)
    strong = m.where("signal_class = 'tone' and coverage >= 0.8").select("file_stem", "frame_number")
    return m.where("mask_present").select("file_stem", "frame_number").join(strong, ["file_stem", "frame_number"], "left_semi").distinct()


@query(f"""WITH {_METRICS} SELECT detector, signal_class, grouping(detector, signal_class)::BIGINT AS level, count(*) AS n, count(DISTINCT file_stem) AS n_files FROM m GROUP BY CUBE (detector, signal_class)""")
def detection_cube(spark, folder):
    return _metrics(spark, folder).cube("detector", "signal_class").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.countDistinct("file_stem").alias("n_files"))


@query("""SELECT label, attenuation_db, count(*) AS n, count(DISTINCT stem) AS n_stems FROM (SELECT DISTINCT stem, ann_idx, coalesce(a.label, 'UNLABELED') AS label, CAST(nullif(regexp_extract(stem, 'attenuation_dB_(\\d+)', 1), '') AS INT) AS attenuation_db FROM annotations a) GROUP BY 1, 2""")
def annotation_counts(spark, folder):
    a = table(spark, folder, "annotations").select("stem", "ann_idx", F.coalesce("label", F.lit("UNLABELED")).alias("label"), S.attenuation_of(F.col("stem")).alias("attenuation_db")).distinct()
    return a.groupBy("label", "attenuation_db").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stem").alias("n_stems"))


_BW = "CASE WHEN bandwidth_hz IS NULL OR isnan(bandwidth_hz) THEN 'unknown' WHEN bandwidth_hz < 2e6 THEN '<2MHz' WHEN bandwidth_hz < 10e6 THEN '2-10MHz' WHEN bandwidth_hz < 25e6 THEN '10-25MHz' WHEN bandwidth_hz < 60e6 THEN '25-60MHz' ELSE '>=60MHz' END"
_LEN = "CASE WHEN length_samples IS NULL THEN 'unknown' WHEN length_samples < 10000 THEN '<10k' WHEN length_samples < 100000 THEN '10k-100k' WHEN length_samples < 1000000 THEN '100k-1M' WHEN length_samples < 5000000 THEN '1M-5M' ELSE '>=5M' END"


@query(f"WITH {_ONCE} SELECT split, {_BW} AS bandwidth_bucket, {_LEN} AS length_bucket, count(*) AS n, sum((row1 - row0) * (col1 - col0))::BIGINT AS pixels FROM once GROUP BY 1, 2, 3")
def region_buckets(spark, folder):
    r = regions_once(table(spark, folder, "regions"), table(spark, folder, "captures"))
    return r.groupBy("split", S.bucket_label(F.col("bandwidth_hz"), *S.BANDWIDTH_EDGES).alias("bandwidth_bucket"), S.bucket_label(F.col("length_samples"), *S.LENGTH_EDGES).alias("length_bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(((F.col("row1") - F.col("row0")) * (F.col("col1") - F.col("col0"))).cast("long")).alias("pixels")
    )


_LAT = "l AS (SELECT DISTINCT sample_id, cell_index, run_day, latency_ms AS v, logged_at FROM (SELECT sample_id, cell_index, run_day, latency_ms, min(logged_at) AS logged_at FROM latency_samples WHERE latency_ms >= 0 AND NOT isnan(latency_ms) GROUP BY ALL))"


def _latency(spark: SparkSession, folder: str) -> DataFrame:
    """Each valid timing once, at its first arrival."""
    l = table(spark, folder, "latency_samples").where("latency_ms >= 0 and not isnan(latency_ms)")  # noqa: E741
    return l.groupBy("sample_id", "cell_index", "run_day", F.col("latency_ms").alias("v")).agg(F.min("logged_at").alias("logged_at"))


@query(f"""WITH {_LAT}, n AS (SELECT *, row_number() OVER (PARTITION BY cell_index, run_day ORDER BY logged_at, sample_id) AS i, count(*) OVER (PARTITION BY cell_index, run_day) AS c FROM l)
SELECT cell_index, count(*) AS n, max(v) AS most, min(v) AS least, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM n WHERE i > 10 AND i <= c - 10 GROUP BY 1""")
def trimmed_latency(spark, folder):
    """Latency per cell without the first and last ten timings of each day's run."""
    t = M.trimmed(_latency(spark, folder), ["cell_index", "run_day"], ["logged_at", "sample_id"], 10, 10)
    return t.groupBy("cell_index").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most"), F.min("v").alias("least"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


@query(f"""WITH {_LAT}, s AS (SELECT cell_index, v, row_number() OVER (PARTITION BY cell_index ORDER BY v, sample_id) - 1 AS i, count(*) OVER (PARTITION BY cell_index) AS n FROM l)
SELECT cell_index, p.pct, v AS value FROM s, (VALUES (10), (50), (90), (95), (100)) p(pct) WHERE i = least(n * p.pct // 100, n - 1)""")
def latency_index_percentiles(spark, folder):
    return M.index_percentiles(_latency(spark, folder), ["cell_index"], "v", ["sample_id"], [10, 50, 90, 95, 100])


@query(f"""WITH {_LAT}, s AS (SELECT cell_index, v, row_number() OVER (PARTITION BY cell_index ORDER BY v, sample_id) - 1 AS i, count(*) OVER (PARTITION BY cell_index) AS n FROM l),
p AS (SELECT cell_index, max(v) FILTER (WHERE i = least(n * 95 // 100, n - 1)) AS p95, max(v) FILTER (WHERE i = n - 1) AS p100, max(v) FILTER (WHERE i = n * 10 // 100) AS p10, max(v) FILTER (WHERE i = n * 90 // 100) AS p90 FROM s GROUP BY 1)
SELECT cell_index, round(p100 - p95, 6) AS tail, round(p90 - p10, 6) AS flatness FROM p""")
def latency_tail_and_flatness(spark, folder):
    p = M.index_percentiles(_latency(spark, folder), ["cell_index"], "v", ["sample_id"], [10, 90, 95, 100])
    w = p.groupBy("cell_index").pivot("pct", [10, 90, 95, 100]).agg(F.max("value"))
    return w.select("cell_index", F.round(F.col("100") - F.col("95"), 6).alias("tail"), F.round(F.col("90") - F.col("10"), 6).alias("flatness"))


@query(f"""WITH {_LAT}, s AS (SELECT cell_index, v, row_number() OVER (PARTITION BY cell_index ORDER BY v DESC, sample_id) AS i, count(*) OVER (PARTITION BY cell_index) AS n FROM l)
SELECT cell_index, count(*) AS n, round(avg(v), 6) AS top_mean FROM s WHERE i <= greatest(1, round_even(n * 0.02, 0)) GROUP BY 1""")
def latency_top_fraction(spark, folder):
    return M.top_fraction_mean(_latency(spark, folder), ["cell_index"], "v", ["sample_id"], 0.02)


@query(f"""WITH {_LAT}, m AS (SELECT cell_index, median(v) AS med FROM l GROUP BY 1), o AS (SELECT l.*, med, abs(v - med) AS off FROM l JOIN m USING (cell_index)), d AS (SELECT cell_index, median(off) AS mad FROM o GROUP BY 1)
SELECT cell_index, CAST(run_day AS VARCHAR) AS run_day, count(*) AS n, sum(CASE WHEN v > med + 8 * (mad * 1.4826 + 1e-6) THEN 1 ELSE 0 END)::BIGINT AS n_hit FROM o JOIN d USING (cell_index) GROUP BY 1, 2""")
def energy_gate(spark, folder):
    """Per cell and day how many timings stand out of their cell by 8 robust deviations."""
    hit = M.mad_outliers(_latency(spark, folder), ["cell_index"], "v", ["sample_id"], 8.0)
    return hit.groupBy("cell_index", F.col("run_day").cast("string").alias("run_day")).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hit"))


@query(f"""WITH {_LAT}, a AS (SELECT detector, device, sample_rate_hz, avg(v) AS mean FROM l JOIN latency_cells USING (cell_index) GROUP BY 1, 2, 3)
SELECT detector, device, round(regr_slope(ln(mean), ln(sample_rate_hz)), 6) AS slope, round(regr_intercept(ln(mean), ln(sample_rate_hz)), 5) AS intercept FROM a GROUP BY 1, 2""")
def latency_scaling(spark, folder):
    """Log-log fit of mean latency over sample rate per detector and device."""
    a = _latency(spark, folder).join(table(spark, folder, "latency_cells"), "cell_index").groupBy("detector", "device", "sample_rate_hz").agg(F.avg("v").alias("mean"))
    x, y = F.log("sample_rate_hz"), F.log("mean")
    return a.groupBy("detector", "device").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 5).alias("intercept"))


@query(f"""WITH {_LAT}, h AS (SELECT cell_index, date_trunc('hour', logged_at) AS hour, count(*) AS n, round(sum(samples_per_frame) / 3600e6, 6) AS msps FROM l JOIN latency_cells USING (cell_index) GROUP BY 1, 2)
SELECT cell_index, hour, n, msps FROM h""")
def throughput_per_hour(spark, folder):
    l = _latency(spark, folder).join(table(spark, folder, "latency_cells").select("cell_index", "samples_per_frame"), "cell_index")  # noqa: E741
    return l.groupBy("cell_index", F.date_trunc("hour", "logged_at").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("samples_per_frame") / 3600e6, 6).alias("msps"))


@query("""WITH t AS (SELECT DISTINCT sample_id, cell_index, latency_ms FROM latency_samples WHERE latency_ms >= 0 AND NOT isnan(latency_ms)) SELECT detector, count(*) AS n, max(CAST(round(latency_ms * 1000) AS BIGINT)) / 1000.0 AS most, round(avg(CAST(round(latency_ms * 1000) AS BIGINT) / 1000.0), 5) AS mean FROM t JOIN latency_cells USING (cell_index) GROUP BY 1""")
def trace_latency(spark, folder):
    """Timings written as path traces, read back as text, and measured: last publish less first receive, per path."""
    from wavemill.sources.traces import parse_traces, path_latency, trace_lines

    l = table(spark, folder, "latency_samples").where("latency_ms >= 0 and not isnan(latency_ms)").select("sample_id", "cell_index", "latency_ms").distinct()  # noqa: E741
    l = l.join(table(spark, folder, "latency_cells").select("cell_index", "detector"), "cell_index")
    start, us = F.col("sample_id") * 1000, F.round(F.col("latency_ms") * 1000).cast("long")
    ops = F.array(
        F.struct(F.lit("rx").alias("op"), start.alias("recv_us"), (start + 1).alias("pub_us")),
        F.struct(F.col("detector").alias("op"), (start + 2).alias("recv_us"), (start + us).alias("pub_us")),
    )
    text = trace_lines(l.select(ops.alias("ops")), "ops")
    at = scratch_path(spark, "traces")
    text.write.text(at)
    p = path_latency(parse_traces(spark.read.text(at)))
    return p.groupBy(F.element_at(F.split("path", " -> "), -1).alias("detector")).agg(F.count(F.lit(1)).alias("n"), F.max("latency_ms").alias("most"), F.round(F.avg("latency_ms"), 5).alias("mean"))


