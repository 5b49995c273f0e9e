"""Rasters, graphs, logs, packets in a stream, retrieval chunks and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.operators import grids as G
from wavemill.operators import ordered
from wavemill.operators.graphs import longest_paths
from wavemill.plans.detections import _REG, regions
from wavemill.plans.grids import _GRID, N, grid
from wavemill.plans.registry import Registry
from wavemill.session import scratch_path
from wavemill.sources import netlog
from wavemill.sources.tables import table
from wavemill.streaming.runner import file_stream, run_available

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query(f"""WITH {_REG}, b AS (SELECT frame_id, unnest(range(row0 // 16, (row1 - 1) // 16 + 1)) AS r, col0, col1 FROM r), c AS (SELECT DISTINCT frame_id, r, unnest(range(col0 // 64, (col1 - 1) // 64 + 1)) AS c FROM b)
SELECT frame_id, count(*) AS n_set, min(r) AS top, max(c) AS right_edge FROM c GROUP BY 1""")
def frame_masks(spark, folder):
    """Regions of each frame as a raster of 16 x 64 blocks, overlapping ones counted once."""
    span = lambda a, b, k: F.sequence(F.floor(F.col(a) / k), F.floor((F.col(b) - 1) / k))
    r = regions(spark, folder).select("frame_id", F.explode(span("row0", "row1", 16)).alias("r"), "col0", "col1")
    c = r.select("frame_id", "r", F.explode(span("col0", "col1", 64)).alias("c")).distinct()
    return c.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_set"), F.min("r").alias("top"), F.max("c").alias("right_edge"))


_EDGES = """m AS (SELECT DISTINCT detector, file_stem, frame_number, ann_idx, signal_class, bandwidth_bucket, length_bucket, coverage FROM region_metrics WHERE coverage BETWEEN 0 AND 1 AND NOT isnan(coverage)),
e AS (SELECT 'd:' || detector AS src, 'c:' || signal_class AS dst, count(*) AS w FROM m GROUP BY 1, 2 UNION ALL SELECT 'c:' || signal_class, 'b:' || bandwidth_bucket, count(*) FROM m GROUP BY 1, 2 UNION ALL SELECT 'b:' || bandwidth_bucket, 'l:' || length_bucket, count(*) FROM m GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_EDGES}, p AS (SELECT src, dst, CAST(w AS DOUBLE) AS cost, 1 AS hops FROM e UNION ALL SELECT p.src, e.dst, p.cost + e.w, p.hops + 1 FROM p JOIN e ON e.src = p.dst) SELECT src, dst, max(cost) AS cost, max(hops) AS hops FROM p GROUP BY 1, 2""")
def heaviest_paths(spark, folder):
    """Worst-case path between any two stages of the flow of detections."""
    m = table(spark, folder, "region_metrics").where("coverage between 0 and 1 and not isnan(coverage)")
    m = m.select("detector", "file_stem", "frame_number", "ann_idx", "signal_class", "bandwidth_bucket", "length_bucket", "coverage").distinct()
    stages = [("d:", "detector"), ("c:", "signal_class"), ("b:", "bandwidth_bucket"), ("l:", "length_bucket")]
    every = m.select(F.inline(F.array(*[F.struct(F.concat(F.lit(p), F.col(a)).alias("src"), F.concat(F.lit(q), F.col(b)).alias("dst")) for (p, a), (q, b) in zip(stages, stages[1:], strict=False)])))
    return longest_paths(every.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")), "src", "dst", "w")


@query("""WITH s AS (SELECT cell_index // 4 AS port, cell_index % 4 AS queue, count(*) FILTER (WHERE latency_ms >= 0 AND NOT isnan(latency_ms)) AS rx, count(*) FILTER (WHERE latency_ms IS NULL) AS missed, count(*) FILTER (WHERE latency_ms < 0) AS errors FROM (SELECT DISTINCT ON (sample_id) * FROM latency_samples WHERE cell_index IS NOT NULL) GROUP BY 1, 2),
p AS (SELECT port, sum(rx) AS rx, sum(missed) AS missed, sum(errors) AS errors FROM s GROUP BY 1) SELECT port, rx::BIGINT AS rx_packets, round(missed / (rx + missed + errors), 9) AS missed_ratio, missed / (rx + missed + errors) <= 0.01 AND errors / (rx + missed + errors) <= 0.05 AS good FROM p""")
def network_log(spark, folder):
    """Counters of timings, each counted once, written as log lines, read back as text, and judged per port."""
    l = table(spark, folder, "latency_samples").where("cell_index is not null").dropDuplicates(["sample_id"])  # noqa: E741
    v = F.col("latency_ms")
    s = l.groupBy(F.expr("cell_index div 4").alias("port"), (F.col("cell_index") % 4).alias("queue"), "run_day").agg(F.count_if((v >= 0) & ~F.isnan(v)).alias("rx"), F.count_if(v.isNull()).alias("missed"), F.count_if(v < 0).alias("errors"))
    at = scratch_path(spark, "log")
    s.select(F.format_string("[port %d][queue %d] rx_packets: %d, missed: %d, errors: %d", "port", "queue", "rx", "missed", "errors").alias("value")).write.text(at)
    return netlog.validate(netlog.parse_counters(spark.read.text(at)), 0.01, 0.05).select("port", "rx_packets", F.round("missed_ratio", 9).alias("missed_ratio"), "good")


@query("""WITH p AS (SELECT user_id, event_id, event_type, CAST(ts AS DATE) AS day, lag(event_type) OVER w AS t0, lag(CAST(ts AS DATE)) OVER w AS d0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, t0 IS DISTINCT FROM event_type AS changed FROM p WHERE t0 IS DISTINCT FROM event_type OR d0 IS DISTINCT FROM day""")
def context_packets(spark, folder):
    """When a context packet is due: the setting changed, or a new day began."""
    e = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", F.to_date("ts").alias("day"))
    e = ordered.previous(e, ["user_id"], ["ts", "event_id"], {"event_type": "t0", "day": "d0"})
    changed = ~F.col("t0").eqNullSafe(F.col("event_type"))
    return e.where(changed | ~F.col("d0").eqNullSafe(F.col("day"))).select("user_id", "event_id", changed.alias("changed"))


@query("""SELECT l_orderkey, count(*) AS n_series, count(DISTINCT l_suppkey) AS n_sources, arg_min(l_shipdate, (l_linenumber, l_partkey, l_shipdate)) AS first_seen, sum(l_quantity) AS instances FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""")
def grouped_series(spark, folder):
    """Parts grouped under their whole: ignored classes dropped first, attributes of the first one seen."""
    l = table(spark, folder, "lineitem").where("l_returnflag <> 'R'")  # noqa: E741
    return l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_series"), F.countDistinct("l_suppkey").alias("n_sources"), F.min_by("l_shipdate", F.struct("l_linenumber", "l_partkey", "l_shipdate")).alias("first_seen"), F.sum("l_quantity").alias("instances"))


@query("""SELECT event_id, 'amount' AS field, CAST(value AS VARCHAR) AS content FROM events WHERE event_type = 'purchase' AND value IS NOT NULL UNION ALL SELECT event_id, 'key', CAST(json_extract(props, '$.k') AS VARCHAR) FROM events WHERE event_type IN ('click', 'view')""")
def sanitised_resources(spark, folder):
    """Per type of resource only the fields it may show; other types give nothing."""
    e = table(spark, folder, "events")
    shown = {"purchase": ("amount", F.col("value").cast("string")), "click": ("key", F.get_json_object("props", "$.k")), "view": ("key", F.get_json_object("props", "$.k"))}
    field, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (name, c) in shown.items():
        field, content = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(field), F.when(F.col("event_type") == kind, c).otherwise(content)
    return e.select("event_id", field.alias("field"), content.alias("content")).where("field is not null and (field <> 'amount' or content is not null)")


@query(f"""WITH {_GRID}, d AS (SELECT frame, 10 * log10(value + 1e-12) AS db FROM g), m AS (SELECT frame, median(db) AS med FROM d GROUP BY 1) SELECT frame, count(*) FILTER (WHERE db > med + 3) AS n_hit FROM d JOIN m USING (frame) GROUP BY 1""")
def three_db_detector(spark, folder):
    """Cells more than 3 dB above their frame's median."""
    d = grid(spark, folder).select("frame", (F.log10(F.col("value") + 1e-12) * 10).alias("db"))
    m = d.groupBy("frame").agg(F.percentile("db", F.lit(0.5)).alias("med"))
    return d.join(m, "frame").groupBy("frame").agg(F.count_if(F.col("db") > F.col("med") + 3).alias("n_hit"))


def _sobel(r: int, c: int) -> str:
    w = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
    cases = " ".join(f"WHEN a.d = {i} AND b.d = {j} THEN {{}}" for i in (-1, 0, 1) for j in (-1, 0, 1))
    return f"sum(n.value * CASE {cases} END)".format(*[(w[i][j] if c else w[j][i]) for i in range(3) for j in range(3)])


@query(f"""WITH {_GRID} SELECT m.frame, m."row", m.col, round(sqrt(power({_sobel(0, 1)}, 2) + power({_sobel(1, 0)}, 2)), 6) AS gradient FROM g m CROSS JOIN range(-1, 2) a(d) CROSS JOIN range(-1, 2) b(d) JOIN g n ON n.frame = m.frame AND n."row" = least(greatest(m."row" + a.d, 0), {N - 1}) AND n.col = least(greatest(m.col + b.d, 0), {N - 1}) GROUP BY 1, 2, 3""")
def edge_strength(spark, folder):
    """Sobel gradient with replicated edges, as two separable passes each."""
    g = grid(spark, folder)
    smooth, slope = [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0]
    g = g.withColumns({"sc": G.replicated(g, "row", 1, N, "value", smooth), "sr": G.replicated(g, "row", 1, N, "value", slope)})
    g = g.withColumns({"gx": G.replicated(g, "col", 1, N, "sc", slope), "gy": G.replicated(g, "col", 1, N, "sr", smooth)})
    return g.select("frame", "row", "col", F.round(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), 6).alias("gradient"))


@query("""SELECT doc_id, CAST(k AS INT) AS chunk_no, substring(text, CAST(k * 135 + 1 AS INT), 150) AS chunk FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text <> ''), unnest(range(0, greatest(1, ((length(text) - 16) // 135) + 1))) t(k)""")
def document_chunks(spark, folder):
    """Texts in stretches of 150 characters that overlap by 15."""
    d = table(spark, folder, "documents").where("text <> ''").select("doc_id", "text").distinct()
    last = F.greatest(F.floor((F.length("text") - 16) / 135), F.lit(0)).cast("int")
    return d.select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"), "text").select("doc_id", "chunk_no", F.expr("substring(text, chunk_no * 135 + 1, 150)").alias("chunk"))


@query("""SELECT detector, count(*) AS n, count(DISTINCT snippet_id) AS n_snippets FROM (SELECT DISTINCT m.detector, s.snippet_id, m.file_stem, m.frame_number, m.ann_idx FROM snippets s JOIN region_metrics m ON m.mask_present AND m.file_stem = s.stem AND m.frame_number = s.frame_number AND m.evaluated_at BETWEEN s.received_at AND s.received_at + INTERVAL 45 DAY) GROUP BY 1""")
def streamed_mask_join(spark, folder):
    """Snippets joined with the masks of their frame that come within 45 days after them, both as streams; what is older leaves the state."""
    utc = lambda c: F.to_timestamp(F.col(c).cast("string"))
    s = file_stream(spark, folder, "snippets").select("snippet_id", "stem", "frame_number", utc("received_at").alias("at")).withWatermark("at", "2 days")
    m = file_stream(spark, folder, "region_metrics").where("mask_present").select("detector", F.col("file_stem").alias("m_stem"), F.col("frame_number").alias("m_frame"), "ann_idx", utc("evaluated_at").alias("m_at")).withWatermark("m_at", "2 days")
    near = (F.col("stem") == F.col("m_stem")) & (F.col("frame_number") == F.col("m_frame")) & F.expr("m_at between at and at + interval 45 days")
    got = run_available(s.join(m, near).select("detector", "snippet_id", "m_stem", "m_frame", "ann_idx"), "append").distinct()
    return got.groupBy("detector").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("snippet_id").alias("n_snippets"))
