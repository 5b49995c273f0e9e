"""Structured Streaming queries over the event and snippet tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.plans.registry import Registry
from wavemill.streaming import operators as S
from wavemill.streaming.runner import file_stream, run_available

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


#: Events are stored in order of their time; a repeat of a snippet arrives within two days.
LATE, REPEATED = "1 day", "2 days"
_MARK = "(SELECT epoch_ms(max(ts)) - 86400000 FROM events)"


def events(spark, folder):
    """The event stream; its times, which have no zone, are UTC."""
    e = file_stream(spark, folder, "events")
    return e.withColumn("ts", F.to_timestamp(F.col("ts").cast("string")))


@query("""SELECT CAST(epoch_us(time_bucket(INTERVAL 1 day, ts)) // 1000000 AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def streamed_tumbling(spark, folder):
    """Counts and sums per day and type, updated batch by batch."""
    got = run_available(S.tumbling(events(spark, folder), "ts", LATE, "1 day", ["event_type"], "value"), "update", ["window_start", "event_type"])
    return got.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"), "most")


@query("""SELECT CAST(epoch_us(time_bucket(INTERVAL 1 day, ts)) // 1000000 AS BIGINT) - d.k * 86400 AS window_start, event_type, min(value) AS least FROM events, range(3) d(k) WHERE ts IS NOT NULL GROUP BY 1, 2""")
def streamed_sliding(spark, folder):
    """Least value over the last three days, per type."""
    got = run_available(S.sliding(events(spark, folder), "ts", LATE, "3 days", "1 day", ["event_type"], "value"), "update", ["window_start", "event_type"])
    return got.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "least")


@query("""WITH p AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM p) SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS n FROM s GROUP BY user_id, k""")
def streamed_sessions(spark, folder):
    """Bursts of each user, ended by six idle hours."""
    s = S.sessions(events(spark, folder), "ts", LATE, "6 hours", ["user_id"])
    got = run_available(s, "complete")
    latest = got.select(F.unix_micros("session_start").alias("started_us"), "user_id", "n")
    return latest.select("user_id", "started_us", "n")


@query("SELECT count(DISTINCT snippet_id) AS n FROM snippets WHERE snippet_id IS NOT NULL")
def streamed_first_arrivals(spark, folder):
    """Snippets without the repeats that came within the watermark."""
    s = file_stream(spark, folder, "snippets").where("snippet_id is not null").select("snippet_id", "stem", "channel", F.to_timestamp(F.col("received_at").cast("string")).alias("received_at"))
    return run_available(S.first_arrivals(s, "received_at", REPEATED, ["snippet_id"]), "append").agg(F.count(F.lit(1)).alias("n"))


_SIZE, _IDLE, _SHARDS = 20, 6 * 3_600_000, 8


@query(f"""WITH e AS (SELECT event_type, user_id % {_SHARDS} AS shard, event_id, value, epoch_ms(ts) AS ms FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND epoch_ms(ts) <= {_MARK}),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w > {_IDLE} THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY event_type, shard ORDER BY ms, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY event_type, shard ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM g),
b AS (SELECT *, (row_number() OVER (PARTITION BY event_type, shard, seg ORDER BY ms, event_id) - 1) // {_SIZE} AS part FROM s),
c AS (SELECT event_type, shard, seg, part, count(*) AS n, sum(value) AS total, max(ms) AS last FROM b GROUP BY ALL)
SELECT event_type, shard, row_number() OVER (PARTITION BY event_type, shard ORDER BY seg, part) - 1 AS batch_no, n, round(total, 4) AS total, n < {_SIZE} AS partial FROM c
WHERE n = {_SIZE} OR last + {_IDLE} < {_MARK} OR seg < (SELECT max(seg) FROM c d WHERE d.event_type = c.event_type AND d.shard = c.shard)""")
def streamed_batches(spark, folder):
    """Batches of twenty events per type and shard of users; one that waits six hours for its next event is given out as it is."""
    e = events(spark, folder).withColumn("shard", F.col("user_id") % _SHARDS)
    got = run_available(S.count_batches(e, ["event_type", "shard"], "event_id", "ts", LATE, "value", _SIZE, _IDLE), "append")
    return got.select("event_type", "shard", "batch_no", "n", F.round("total", 4).alias("total"), "partial")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND epoch_ms(ts) <= {_MARK}),
r AS (SELECT user_id, event_id, k, v AS kept FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN abs(e.v - r.kept) > 50 THEN e.v ELSE r.kept END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, kept FROM r""")
def streamed_dead_zone(spark, folder):
    """Each user's value as a tracker sees it, which moves only when it is more than 50 away; state per user, up to the watermark."""
    return run_available(S.dead_zone(events(spark, folder), "user_id", "event_id", "ts", LATE, "value", 50.0), "append")


@query(f"""WITH e AS (SELECT user_id, event_id, value AS v, sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch, epoch_ms(ts) AS ms FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND epoch_ms(ts) <= {_MARK})
SELECT user_id, event_id, epoch, max(v) OVER (PARTITION BY user_id, epoch ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS best FROM e""")
def streamed_epochs(spark, folder):
    """Best reading of each user since it last fell below 5, which starts a new epoch."""
    return run_available(S.reset_epochs(events(spark, folder), "user_id", "event_id", "ts", LATE, "value", 5.0), "append")
