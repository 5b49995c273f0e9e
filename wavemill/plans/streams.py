"""Samplers, routing, and ordered operations over the event stream and the snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions import scalar as S
from wavemill.operators import ordered, sampling
from wavemill.plans.registry import Registry
from wavemill.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


@query("""SELECT event_type, event_id, row_no FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_no FROM events) WHERE row_no % 7 = 0""")
def stride_sample(spark, folder):
    return sampling.stride(_events(spark, folder).select("event_type", "ts", "event_id"), ["event_type"], ["ts", "event_id"], 7).select("event_type", "event_id", "row_no")


@query("""WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
w AS (SELECT DISTINCT event_type, CAST(round_even(k * (n - 1) / 16.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT event_type, n FROM e), range(17) t(k))
SELECT e.event_type, e.event_id FROM e JOIN w USING (event_type, i)""")
def evenly_spaced_frames(spark, folder):
    return sampling.evenly_spaced(_events(spark, folder).select("event_type", "ts", "event_id"), ["event_type"], ["ts", "event_id"], 17).select("event_type", "event_id")


@query("""SELECT user_id, event_id, split FROM (SELECT *, CASE WHEN i < floor(n * 0.5) THEN 'train' WHEN i < floor(n * 0.5) + 1 THEN NULL WHEN i < floor(n * 0.75) THEN 'val' WHEN i < floor(n * 0.75) + 1 THEN NULL ELSE 'test' END AS split
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)) WHERE split IS NOT NULL""")
def temporal_split_guarded(spark, folder):
    return sampling.temporal_split(_events(spark, folder).select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 0.5, 0.25, 1).select("user_id", "event_id", "split")


@query("""SELECT event_id, 'high' AS branch, value * 2 AS out FROM events WHERE value > 1 UNION ALL SELECT event_id, 'low', value FROM events WHERE value IS NULL OR NOT value > 1""")
def conditional_route(spark, folder):
    e = _events(spark, folder).select("event_id", "value")
    return sampling.route(
        e, F.col("value") > 1,
        lambda d: d.select("event_id", F.lit("high").alias("branch"), (F.col("value") * 2).alias("out")),
        lambda d: d.select("event_id", F.lit("low").alias("branch"), F.col("value").alias("out")),
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, '1' AS gain, 'none' AS window FROM events""")
def filled_metadata(spark, folder):
    """Metadata maps with defaults for missing keys; later maps win."""
    e = _events(spark, folder).select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    e = sampling.fill_missing(e, "m", {"k": "0", "gain": "1", "window": "none"})
    return e.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["gain"].alias("gain"), F.col("m")["window"].alias("window"))


@query("""SELECT user_id, event_id, date_diff('microsecond', lag(ts) OVER w, ts) AS period_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def successive_difference(spark, folder):
    e = ordered.previous(_events(spark, folder).select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], {"ts": "before"})
    return e.select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, before, ts)").alias("period_us"))


@query("""WITH d AS (SELECT event_type, date_diff('microsecond', lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id), ts) / 1000.0 AS ms FROM events)
SELECT event_type, count(ms) AS n, round(avg(ms), 4) AS mean_ms, round(stddev_samp(ms), 4) AS std_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM d GROUP BY event_type""")
def frame_period_stats(spark, folder):
    e = ordered.previous(_events(spark, folder).select("event_type", "ts", "event_id"), ["event_type"], ["ts", "event_id"], {"ts": "before"})
    ms = e.select("event_type", (F.expr("timestampdiff(MICROSECOND, before, ts)") / 1000.0).alias("ms"))
    return ms.groupBy("event_type").agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.round(F.stddev_samp("ms"), 4).alias("std_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


@query("""SELECT event_type, event_id, value, round((row_number() OVER w - 1) / count(*) OVER (PARTITION BY event_type), 9) AS cdf FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)""")
def empirical_cdf(spark, folder):
    """The share of smaller places: starts at 0 and never reaches 1."""
    e = ordered.numbered(_events(spark, folder).where("value is not null").select("event_type", "event_id", "value"), ["event_type"], ["value", "event_id"])
    return e.select("event_type", "event_id", "value", F.round((F.col("row_no") - 1) / F.col("n_rows"), 9).alias("cdf"))


@query("""WITH c AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS context FROM events),
s AS (SELECT event_id, user_id, event_type, last_value(context IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS context FROM c)
SELECT event_id, user_id, context FROM s WHERE event_type <> 'purchase' AND context IS NOT NULL""")
def context_as_of(spark, folder):
    """Data rows with the latest context before them; rows before the first context are dropped."""
    e = _events(spark, folder).select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_type") == "purchase", F.col("value")).alias("c"))
    e = ordered.last_known(e, ["user_id"], ["ts", "event_id"], "c", "context")
    return e.where("event_type <> 'purchase' and context is not null").select("event_id", "user_id", "context")


@query("""SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events""")
def running_peak(spark, folder):
    e = _events(spark, folder).select("user_id", "ts", "event_id", "value")
    return ordered.running(e, ["user_id"], ["ts", "event_id"], "peak", F.col("value"), "max").select("user_id", "event_id", "peak")


@query("""WITH s AS (SELECT DISTINCT snippet_id, stem, channel, frame_number, orig_sample_start, n_iq FROM snippets)
SELECT snippet_id, stem, channel, CAST(sum(n_iq) OVER w - n_iq AS BIGINT) AS sample_start, CAST((dense_rank() OVER (PARTITION BY stem, channel ORDER BY frame_number) - 1) // 4 AS BIGINT) AS pack FROM s
WINDOW w AS (PARTITION BY stem, channel ORDER BY frame_number, orig_sample_start, snippet_id ROWS UNBOUNDED PRECEDING)""")
def recording_offsets(spark, folder):
    """Where each snippet begins in the recording it is appended to, and which pack of four frames it falls in."""
    s = table(spark, folder, "snippets").select("snippet_id", "stem", "channel", "frame_number", "orig_sample_start", "n_iq").distinct()
    keys, order = ["stem", "channel"], ["frame_number", "orig_sample_start", "snippet_id"]
    s = ordered.running(s, keys, order, "upto", F.col("n_iq"))
    frames = s.select(*keys, "frame_number").distinct()
    frames = ordered.numbered(frames, keys, ["frame_number"]).select(*keys, "frame_number", F.expr("(row_no - 1) div 4").alias("pack"))
    return s.join(frames, [*keys, "frame_number"]).select("snippet_id", *keys, (F.col("upto") - F.col("n_iq")).alias("sample_start"), "pack")


@query("""WITH c AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, sum(CASE WHEN before IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM c""")
def retune_segments(spark, folder, rows=None):
    """A new segment whenever the setting changes: state is seeded anew in each."""
    rows = _events(spark, folder) if rows is None else rows
    e = ordered.previous(rows.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], {"event_type": "before"})
    e = ordered.running(e, ["user_id"], ["ts", "event_id"], "segment", F.when(F.col("before").eqNullSafe(F.col("event_type")), 0).otherwise(1))
    return e.select("user_id", "event_id", F.col("segment").cast("long").alias("segment"))


@query("""SELECT cell_index, round(power(2, round(log2(sample_rate_hz / 20000000.0))) * 1024)::BIGINT AS size, round(512 * (power(2, round(log2(sample_rate_hz / 20000000.0))) * 1024) / sample_rate_hz * 1000, 6) AS budget_ms, n FROM latency_cells JOIN (SELECT cell_index, count(DISTINCT sample_id) AS n FROM latency_samples GROUP BY 1) USING (cell_index)""")
def snapshot_budget(spark, folder):
    """FFT size and time budget of each cell's rate, with the number of its timings."""
    n = table(spark, folder, "latency_samples").select("cell_index", "sample_id").distinct().groupBy("cell_index").agg(F.count("sample_id").alias("n"))
    c = table(spark, folder, "latency_cells").withColumn("size", S.fft_size(F.col("sample_rate_hz"), 20e6, 1024))
    return c.join(n, "cell_index").select("cell_index", "size", F.round(S.frame_budget_ms(F.lit(512), F.col("size"), F.col("sample_rate_hz")), 6).alias("budget_ms"), "n")


@query("""WITH s AS (SELECT snippet_id, channel, n_iq, orig_sample_count, min(received_at) AS came FROM snippets GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY channel, date_trunc('hour', came) ORDER BY came, snippet_id) AS k FROM s)
SELECT channel, date_trunc('hour', came) AS period, count(*) FILTER (WHERE k <= 4) AS n_kept, count(*) FILTER (WHERE k > 4) AS n_dropped, coalesce(sum(n_iq) FILTER (WHERE k > 4), 0)::BIGINT AS iq_dropped, coalesce(sum(orig_sample_count) FILTER (WHERE k > 4), 0)::BIGINT AS original_dropped FROM k GROUP BY 1, 2""")
def shed_load(spark, folder):
    """What a sink with room for four snippets an hour of each channel keeps and drops."""
    s = table(spark, folder, "snippets").groupBy("snippet_id", "channel", "n_iq", "orig_sample_count").agg(F.min("received_at").alias("at"))
    return sampling.shed(s, ["channel"], F.date_trunc("hour", "at"), ["at", "snippet_id"], 4, {"iq_dropped": "n_iq", "original_dropped": "orig_sample_count"})[1]
