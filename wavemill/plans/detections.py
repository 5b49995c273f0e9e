"""Annotations, regions and detections: overlap joins, boxes, rules and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.operators import boxes as B
from wavemill.operators import intervals as I
from wavemill.operators import rules
from wavemill.operators.names import regions_once
from wavemill.operators.vectors import nearest
from wavemill.plans.registry import Registry
from wavemill.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

FRAME = 1 << 22
_CAP = "c AS (SELECT stem, max(n_samples) AS n, max(sample_rate) AS fs, max(center_freq_hz) AS fc FROM captures GROUP BY stem)"
_ANN = f"""{_CAP}, a AS (SELECT DISTINCT a.stem, ann_idx, greatest(sample_start, 0) AS s, CASE WHEN coalesce(sample_count, 0) = 0 THEN n ELSE least(sample_start + sample_count, n) END AS e, least(freq_lower_hz, freq_upper_hz) AS lo, greatest(freq_lower_hz, freq_upper_hz) AS hi, n, fs, fc
FROM annotations a JOIN c USING (stem) WHERE sample_start IS NOT NULL AND freq_lower_hz IS NOT NULL AND freq_upper_hz IS NOT NULL AND coalesce(sample_count, 0) >= 0), v AS (SELECT * FROM a WHERE s < e)"""


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Valid annotations, each once, cut to their capture: ``stem, ann_idx, s, e, lo, hi, n, fs, fc``."""
    c = table(spark, folder, "captures").groupBy("stem").agg(F.max("n_samples").alias("n"), F.max("sample_rate").alias("fs"), F.max("center_freq_hz").alias("fc"))
    a = table(spark, folder, "annotations").where("sample_start is not null and freq_lower_hz is not null and freq_upper_hz is not null and coalesce(sample_count, 0) >= 0")
    a = a.join(c, "stem").select(
        "stem", "ann_idx", F.greatest("sample_start", F.lit(0)).alias("s"),
        F.when(F.coalesce("sample_count", F.lit(0)) == 0, F.col("n")).otherwise(F.least(F.col("sample_start") + F.col("sample_count"), "n")).alias("e"),
        F.least("freq_lower_hz", "freq_upper_hz").alias("lo"), F.greatest("freq_lower_hz", "freq_upper_hz").alias("hi"), "n", "fs", "fc",
    )
    return a.where("s < e").dropDuplicates(["stem", "ann_idx"])


@query(f"""WITH {_ANN}, f AS (SELECT stem, k AS frame, k * {FRAME} AS fs0, least((k + 1) * {FRAME}, n) AS fe FROM c, unnest(range(0, (n + {FRAME} - 1) // {FRAME})) t(k))
SELECT f.stem, f.frame, count(*) AS n_annotations, sum(least(e, fe) - greatest(s, fs0))::BIGINT AS covered, min(greatest(s, fs0) - fs0)::BIGINT AS first_row FROM v JOIN f ON v.stem = f.stem AND s < fe AND e > fs0 GROUP BY 1, 2""")
def annotations_per_frame(spark, folder):
    """Ground truth clipped to fixed frames of each capture: an overlap join on frame buckets."""
    c = table(spark, folder, "captures").groupBy("stem").agg(F.max("n_samples").alias("n"))
    f = c.select("stem", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {FRAME}"))).alias("frame"), "n")
    f = f.select("stem", "frame", (F.col("frame") * FRAME).alias("fs0"), F.least((F.col("frame") + 1) * FRAME, F.col("n")).alias("fe"))
    j = I.overlap_join(annotations(spark, folder).select("stem", "s", "e"), f, ("s", "e"), ("fs0", "fe"), FRAME, ["stem"])
    low, high = F.greatest("s", "fs0"), F.least("e", "fe")
    return j.groupBy("stem", "frame").agg(F.count(F.lit(1)).alias("n_annotations"), F.sum(high - low).alias("covered"), F.min(low - F.col("fs0")).alias("first_row"))


@query(f"""WITH {_ANN}, m AS (SELECT *, max(e) OVER (PARTITION BY stem ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY stem ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT stem, min(s) + 1000 AS seg_start, max(e) - 1000 AS seg_stop FROM g GROUP BY stem, k HAVING max(e) - min(s) - 2000 >= 4096""")
def guarded_spans(spark, folder):
    """Merged annotated spans of each capture, shrunk by a guard at both ends, if long enough."""
    from wavemill.operators.dyadic import busy_and_gaps

    spans = busy_and_gaps(annotations(spark, folder), ["stem"], "s", "e", "n").where("seg_kind = 'busy'")
    return spans.select("stem", (F.col("seg_start") + 1000).alias("seg_start"), (F.col("seg_stop") - 1000).alias("seg_stop")).where("seg_stop - seg_start >= 4096")


@query(f"""WITH {_ANN}, m AS (SELECT *, max(e) OVER (PARTITION BY stem ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY stem ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
b AS (SELECT stem, n, min(s) AS s, max(e) AS e FROM g GROUP BY stem, n, k), w AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY stem ORDER BY s) AS before, lead(s) OVER (PARTITION BY stem ORDER BY s) AS after FROM b)
SELECT stem, before + 1000 AS gap_start, s - 1000 AS gap_stop FROM w WHERE s - before - 2000 >= 4096 UNION ALL SELECT stem, e + 1000, n - 1000 FROM w WHERE after IS NULL AND n - e - 2000 >= 4096""")
def noise_gaps(spark, folder):
    """Annotation-free stretches of each capture, shrunk by a guard, if long enough."""
    from wavemill.operators.dyadic import busy_and_gaps

    gaps = busy_and_gaps(annotations(spark, folder), ["stem"], "s", "e", "n").where("seg_kind = 'gap'")
    return gaps.select("stem", (F.col("seg_start") + 1000).alias("gap_start"), (F.col("seg_stop") - 1000).alias("gap_stop")).where("gap_stop - gap_start >= 4096")


@query(f"""WITH {_ANN}, x AS (SELECT *, (lo / fs + 0.5) * 512 AS a, (hi / fs + 0.5) * 512 AS b FROM v)
SELECT stem, ann_idx, CAST(greatest(floor(a), 0) AS BIGINT) AS col0, CAST(least(greatest(ceil(b), greatest(floor(a), 0) + 1), 512) AS BIGINT) AS col1, CAST(least(greatest(round_even(a, 0), 0), 511) AS BIGINT) AS nearest_col FROM x WHERE b > 0 AND a < 512""")
def frequency_columns(spark, folder):
    """Columns of 512 that an annotation covers: cut and raised, at least one; and the nearest one, halves to even."""
    a = annotations(spark, folder).withColumns({"a": (F.col("lo") / F.col("fs") + 0.5) * 512, "b": (F.col("hi") / F.col("fs") + 0.5) * 512}).where("b > 0 and a < 512")
    first = F.greatest(F.floor("a"), F.lit(0))
    return a.select("stem", "ann_idx", first.alias("col0"), F.least(F.greatest(F.ceil("b"), first + 1), F.lit(512)).alias("col1"), F.least(F.greatest(F.bround("a"), F.lit(0)), F.lit(511)).cast("long").alias("nearest_col"))



def plain_sql(c: str) -> str:
    """SQL of a capture's plain name: without folder, file ending, case and kind of separator."""
    s = f"regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '^.*[/\\\\]', '')"
    s = f"regexp_replace(lower({s}), '\\.sigmf([-_ ]?(meta|data))?$', '')"
    return f"regexp_replace(regexp_replace({s}, '[\\s\\-_.]+', '_', 'g'), '^_+|_+$', '', 'g')"


#: Regions by their key, capture and frame and ann_idx, however the names are spelled; what names no frame is told apart by its content.
_ONCE = f"""stems AS (SELECT DISTINCT stem FROM captures WHERE stem IS NOT NULL), spelled AS (SELECT {plain_sql('stem')} AS p, min(stem) AS meant FROM stems GROUP BY 1),
told AS (SELECT regions.* EXCLUDE (stem), coalesce(regexp_replace(frame_id, '#[^#]*$', ''), stem) AS told, CASE WHEN contains(frame_id, '#') THEN CAST(CAST(trim(split_part(frame_id, '#', -1)) AS BIGINT) AS VARCHAR) END AS frame FROM regions),
named AS (SELECT told.* EXCLUDE (frame_id), coalesce(stems.stem, spelled.meant, {plain_sql('told')}) AS capture FROM told LEFT JOIN stems ON stems.stem = told LEFT JOIN spelled ON spelled.p = {plain_sql('told')}),
once AS (SELECT DISTINCT ON (capture, frame, ann_idx, CASE WHEN frame IS NULL THEN (row0, row1, col0, col1, label, kind, attenuation_db, bandwidth_hz, length_samples, time_group) END) *, capture || coalesce('#' || frame, '') AS frame_id FROM named)"""
_ALL = f"{_ONCE}, r AS (SELECT * FROM once WHERE row0 < row1 AND col0 < col1)"
_REG = f"{_ONCE}, r AS (SELECT * FROM once WHERE frame IS NOT NULL AND row0 < row1 AND col0 < col1)"


def regions(spark: SparkSession, folder: str, framed: bool = True) -> DataFrame:
    """Regions that name their frame, each once however it is spelled; without ``framed`` also those that name their capture only."""
    r = regions_once(table(spark, folder, "regions").where("row0 < row1 and col0 < col1"), table(spark, folder, "captures"))
    r = r.where("frame is not null") if framed else r
    return r.select("frame_id", "capture", "ann_idx", "kind", "label", "bandwidth_hz", "length_samples", *B.SIDES)


@query(f"""WITH {_ALL} SELECT frame_id, ann_idx, round(least(greatest((col0 + col1) / 2 / 4096, 0), 1), 9) AS cx, round(least(greatest((row0 + row1) / 2 / 1024, 0), 1), 9) AS cy, round(least((col1 - col0) / 4096, 1), 9) AS w, round(least((row1 - row0) / 1024, 1), 9) AS h FROM r""")
def normalised_boxes(spark, folder):
    n = B.normalised(regions(spark, folder, framed=False), 1024, 4096)
    return n.select("frame_id", "ann_idx", *[F.round(c, 9).alias(c) for c in ("cx", "cy", "w", "h")])


@query(f"""WITH {_REG}, l AS (SELECT DISTINCT frame_id, ann_idx, row0, row1, col0, col1 FROM r WHERE kind = 'waveform'), o AS (SELECT * FROM r WHERE kind <> 'waveform'),
p AS (SELECT l.frame_id, l.ann_idx, greatest(least(l.row1, o.row1) - greatest(l.row0, o.row0), 0)::BIGINT * greatest(least(l.col1, o.col1) - greatest(l.col0, o.col0), 0) AS i, (l.row1 - l.row0)::BIGINT * (l.col1 - l.col0) AS a, (o.row1 - o.row0)::BIGINT * (o.col1 - o.col0) AS b FROM l LEFT JOIN o USING (frame_id))
SELECT frame_id, ann_idx, round(coalesce(max(i / (a + b - i)), 0), 9) AS best FROM p GROUP BY 1, 2""")
def best_iou_per_region(spark, folder):
    r = regions(spark, folder)
    b = B.best_iou(r.where("kind = 'waveform'"), r.where("kind <> 'waveform'"), ["frame_id"], "ann_idx")
    return b.select("frame_id", "ann_idx", F.round("best", 9).alias("best"))


@query(f"""WITH RECURSIVE {_REG}, b AS (SELECT frame_id, ann_idx, row0, row1, col0, col1, row_number() OVER (PARTITION BY frame_id ORDER BY length_samples DESC, ann_idx) AS k FROM r WHERE length_samples IS NOT NULL),
s AS (SELECT DISTINCT frame_id, 0::BIGINT AS k, []::STRUCT(a INT, r0 BIGINT, r1 BIGINT, c0 BIGINT, c1 BIGINT)[] AS kept FROM b UNION ALL
SELECT b.frame_id, b.k, CASE WHEN len(list_filter(kept, lambda x: greatest(least(x.r1, row1) - greatest(x.r0, row0) + 1, 0) * greatest(least(x.c1, col1) - greatest(x.c0, col0) + 1, 0) * 11
  >= (x.r1 - x.r0 + 1) * (x.c1 - x.c0 + 1) + (row1 - row0 + 1)::BIGINT * (col1 - col0 + 1))) = 0 THEN list_append(kept, {{'a': ann_idx, 'r0': row0::BIGINT, 'r1': row1::BIGINT, 'c0': col0::BIGINT, 'c1': col1::BIGINT}}) ELSE kept END FROM s JOIN b ON b.frame_id = s.frame_id AND b.k = s.k + 1),
e AS (SELECT frame_id, unnest(arg_max(kept, k)) AS x FROM s GROUP BY 1) SELECT frame_id, x.a AS ann_idx FROM e""")
def suppressed_regions(spark, folder):
    """Non-maximum suppression per frame, the longest regions first."""
    r = regions(spark, folder).groupBy("frame_id", "ann_idx").agg(F.max(F.struct("length_samples", *B.SIDES)).alias("r")).select("frame_id", "ann_idx", "r.*").where("length_samples is not null")
    return B.suppress(r, ["frame_id"], "ann_idx", "length_samples", 0.1).select("frame_id", "ann_idx")


@query(f"""WITH RECURSIVE {_REG}, s AS (SELECT 0 AS turn, frame_id, row_number() OVER (ORDER BY frame_id, ann_idx) AS id, row0, row1 - 1 AS row1, col0, col1 - 1 AS col1, 1::BIGINT AS n, TRUE AS moved FROM r UNION ALL
SELECT turn + 1, frame_id, target, min(row0), max(row1), min(col0), max(col1), sum(n)::BIGINT, bool_or(target <> id) FROM (SELECT a.turn, a.frame_id, a.id, a.row0, a.row1, a.col0, a.col1, a.n, min(b.id) AS target
  FROM (SELECT *, bool_or(moved) OVER (PARTITION BY frame_id) AS again FROM s) a JOIN s b ON a.again AND a.frame_id = b.frame_id AND a.row0 <= b.row1 + 4 AND b.row0 <= a.row1 + 4 AND a.col0 <= b.col1 + 16 AND b.col0 <= a.col1 + 16 GROUP BY ALL) GROUP BY turn, frame_id, target)
SELECT frame_id, row0, row1, col0, col1, n FROM s QUALIFY turn = max(turn) OVER (PARTITION BY frame_id)""")
def merged_regions(spark, folder):
    """Boxes of a frame that are within 4 rows and 16 columns of each other, merged until none are."""
    r = regions(spark, folder).select("frame_id", "ann_idx", "row0", (F.col("row1") - 1).alias("row1"), "col0", (F.col("col1") - 1).alias("col1")).withColumn("n", F.lit(1))
    return B.merge_close(r, ["frame_id"], 4, 16, "n")


@query(f"""WITH {_REG} SELECT frame_id, ann_idx, score, rank FROM (SELECT frame_id, ann_idx, round(1 / (1 + exp(-(bandwidth_hz / 1e6 - 2))), 9) AS score, row_number() OVER (PARTITION BY frame_id ORDER BY bandwidth_hz DESC, ann_idx, length_samples, row0, col0, label, kind) AS rank FROM r WHERE bandwidth_hz IS NOT NULL AND NOT isnan(bandwidth_hz)) WHERE rank <= 3 AND score >= 0.3""")
def top_regions(spark, folder):
    """The three widest regions of each frame, then those whose squashed score is high enough."""
    r = regions(spark, folder).where("bandwidth_hz is not null and not isnan(bandwidth_hz)")
    w = Window.partitionBy("frame_id").orderBy(F.desc("bandwidth_hz"), "ann_idx", "length_samples", "row0", "col0", "label", "kind")
    r = r.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return r.select("frame_id", "ann_idx", F.round(1 / (1 + F.exp(-(F.col("bandwidth_hz") / 1e6 - 2))), 9).alias("score"), "rank").where("score >= 0.3")


@query(f"""WITH {_ALL}, {_CAP}, j AS (SELECT r.*, c.* FROM r JOIN c ON c.stem = r.capture WHERE fc IS NOT NULL)
SELECT frame_id, ann_idx, row0, col0, label, kind, CAST(floor(row0 / 1024 * n) AS BIGINT) AS start_sample, CAST(least(ceil(row1 / 1024 * n), n) AS BIGINT) AS stop_sample, round(fc + (col0 / 4096 - 0.5) * fs, 3) AS low_hz, round(fc + (col1 / 4096 - 0.5) * fs, 3) AS high_hz FROM j""")
def physical_regions(spark, folder):
    """Boxes in samples and Hz of the capture their frame, or else their stem, names."""
    c = table(spark, folder, "captures").groupBy("stem").agg(F.max("n_samples").alias("n"), F.max("sample_rate").alias("fs"), F.max("center_freq_hz").alias("fc")).where("fc is not null")
    r = regions(spark, folder, framed=False).withColumnRenamed("capture", "stem").join(c, "stem")
    p = B.physical(r, 1024, 4096, F.col("n"), F.col("fc"), F.col("fs"))
    return p.select("frame_id", "ann_idx", "row0", "col0", "label", "kind", "start_sample", "stop_sample", F.round("low_hz", 3).alias("low_hz"), F.round("high_hz", 3).alias("high_hz"))


@query("""WITH s AS (SELECT * FROM snippets QUALIFY row_number() OVER (PARTITION BY snippet_id ORDER BY received_at, n_iq) = 1), x AS (SELECT snippet_id, list_filter(coalesce(annotations, []), lambda a: a.freq_upper_hz - a.freq_lower_hz >= 1e6) AS wide, coalesce(annotations, []) AS every FROM s)
SELECT snippet_id, len(every) AS n_all, len(wide) AS n_wide, round(list_max(list_transform(wide, lambda a: a.freq_upper_hz - a.freq_lower_hz)), 3) AS widest FROM x""")
def wide_annotations(spark, folder):
    """Detections of each snippet above a threshold, inside the array."""
    s = table(spark, folder, "snippets").groupBy("snippet_id").agg(F.min_by("annotations", F.struct("received_at", "n_iq")).alias("a"))
    every = F.coalesce("a", F.array())
    wide = F.filter(every, lambda a: a["freq_upper_hz"] - a["freq_lower_hz"] >= 1e6)
    return s.select("snippet_id", F.size(every).alias("n_all"), F.size(wide).alias("n_wide"), F.round(F.array_max(F.transform(wide, lambda a: a["freq_upper_hz"] - a["freq_lower_hz"])), 3).alias("widest"))


SELECTIONS = [
    {"name": "near_band", "conditions": {"center_freq_hz": 2.44e9, "stem": "overlay|dense"}},
    {"name": "quiet_lagoon", "conditions": {"stem": ["LAGOON", "quiet"], "datatype": "CF32_LE"}},
    {"name": "never_zero", "conditions": {"attenuation_db": 0, "datatype": "cf32"}},
    {"name": "loud", "conditions": {"attenuation_db": 15}},
]


@query("""WITH c AS (SELECT DISTINCT stem, center_freq_hz, attenuation_db, datatype FROM captures),
m AS (SELECT stem, 'near_band' AS selection FROM c WHERE center_freq_hz = 2.44e9 AND regexp_matches(stem, 'overlay|dense', 'i') UNION ALL SELECT stem, 'quiet_lagoon' FROM c WHERE contains(lower(stem), 'lagoon') AND contains(lower(stem), 'quiet') AND (lower(datatype) = 'cf32_le' OR regexp_matches(datatype, 'CF32_LE', 'i'))
UNION ALL SELECT stem, 'never_zero' FROM c WHERE regexp_matches(datatype, 'cf32', 'i') UNION ALL SELECT stem, 'loud' FROM c WHERE attenuation_db = 15)
SELECT stem, selection, split_part(stem, '_', 1) AS site FROM m QUALIFY row_number() OVER (PARTITION BY split_part(stem, '_', 1), selection ORDER BY stem) = 1""")
def selected_captures(spark, folder):
    """The first capture of each site that a selection rule matches."""
    c = table(spark, folder, "captures").select("stem", "center_freq_hz", "attenuation_db", "datatype").distinct().withColumn("site", F.split("stem", "_")[0])
    return rules.select(c, SELECTIONS, ["site"], ["stem"]).select("stem", "selection", "site")


_SIM = "q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.query, b.vec_id AS neighbour, q.label AS ql, b.label, round(list_cosine_similarity(q.e, CAST(b.embedding AS DOUBLE[])), 9) AS similarity FROM q JOIN embeddings b ON b.vec_id <> q.query), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM s)"


@query(f"WITH {_SIM} SELECT query, neighbour, rank, round(similarity, 6) AS similarity FROM t WHERE rank <= 5")
def nearest_vectors(spark, folder):
    e = table(spark, folder, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5).select("query", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_SIM} SELECT ql AS label, count(DISTINCT query) AS n_queries, round(count(DISTINCT CASE WHEN label = ql AND rank <= 5 THEN query END) / count(DISTINCT query), 9) AS hit_at_5, round(sum(CASE WHEN label = ql AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) / count(DISTINCT query), 6) AS gain FROM t WHERE rank <= 5 GROUP BY 1")
def retrieval_quality(spark, folder):
    """Share of queries with a neighbour of their own label among the first five, and the discounted gain."""
    e = table(spark, folder, "embeddings")
    top = nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    a = e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql"))
    b = e.select(F.col("vec_id").alias("neighbour"), "label")
    j = top.join(a, "query").join(b, "neighbour").withColumn("same", F.col("ql") == F.col("label"))
    per = j.groupBy(F.col("ql").alias("label"), "query").agg(F.max(F.col("same").cast("int")).alias("hit"), F.sum(F.when(F.col("same"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"))
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("hit"), 9).alias("hit_at_5"), F.round(F.avg("gain"), 6).alias("gain"))


@query("""SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS most, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS at_key FROM orders GROUP BY 1""")
def strongest_location(spark, folder):
    """Where the largest value of each class lies."""
    o = table(spark, folder, "orders")
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("at_key"))
