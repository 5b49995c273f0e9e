"""Grid operators over time-frequency tiles made from line items: 32 x 32 cells per supplier, value = summed quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators import grids as G
from wavemill.operators.metrics import quantiles
from wavemill.plans.registry import Registry
from wavemill.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

N = 32
_GRID = f"""v AS (SELECT l_suppkey AS frame, CAST(l_orderkey % {N} AS INT) AS "row", CAST(l_partkey % {N} AS INT) AS col, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
g AS (SELECT f.frame, r.k::INT AS "row", c.k::INT AS col, coalesce(v.value, 0) AS value FROM (SELECT DISTINCT l_suppkey AS frame FROM lineitem) f CROSS JOIN range({N}) r(k) CROSS JOIN range({N}) c(k) LEFT JOIN v ON v.frame = f.frame AND v."row" = r.k AND v.col = c.k)"""
_ROW, _COL = 'PARTITION BY frame, "row" ORDER BY col', 'PARTITION BY frame, col ORDER BY "row"'


def grid(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").where("l_suppkey is not null")  # noqa: E741
    cells = l.groupBy(F.col("l_suppkey").alias("frame"), F.pmod("l_orderkey", F.lit(N)).cast("int").alias("row"), F.pmod("l_partkey", F.lit(N)).cast("int").alias("col")).agg(F.sum("l_quantity").alias("value"))
    return G.dense(cells, l.select(F.col("l_suppkey").alias("frame")), N, N)


@query(f'WITH {_GRID}, a AS (SELECT frame, "row", col, avg(value) OVER ({_ROW} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM g) SELECT frame, "row", col, round(avg(x) OVER ({_COL} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS mean FROM a')
def box_mean(spark, folder):
    g = G.box_mean(G.box_mean(grid(spark, folder), "col", 2), "row", 1)
    return g.select("frame", "row", "col", F.round("value", 6).alias("mean"))


_W = G.gaussian_weights(1.2)
_R = len(_W) // 2


@query(
    f'WITH {_GRID}, s AS (SELECT frame, "row", avg(value) AS x FROM g GROUP BY 1, 2) SELECT s.frame, s."row", round(sum(n.x * o.w) / {sum(_W)!r}, 6) AS smooth FROM s CROSS JOIN (VALUES '
    + ", ".join(f"({k - _R}, {w!r})" for k, w in enumerate(_W))
    + f') o(d, w) JOIN s n ON n.frame = s.frame AND n."row" = least(greatest(s."row" + o.d, 0), {N - 1}) GROUP BY 1, 2'
)
def smoothed_row_means(spark, folder):
    """Row means, smoothed over rows with replicated edges: the reference level of each row."""
    rows = grid(spark, folder).groupBy("frame", "row").agg(F.avg("value").alias("x")).withColumn("col", F.lit(0))
    s = G.gaussian_smooth(rows, "row", 1.2, N, "x", "smooth")
    return s.select("frame", "row", F.round("smooth", 6).alias("smooth"))


def _stack(inner: str, *steps: tuple[str, str, int]) -> str:
    """SQL of separable minima and maxima, one common table each."""
    out, last = [], inner
    for i, (f, line, r) in enumerate(steps):
        out.append(f's{i} AS (SELECT frame, "row", col, {f}(value) OVER ({_ROW if line == "col" else _COL} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS value FROM {last})')
        last = f"s{i}"
    return ", ".join(out) + f' SELECT frame, "row", col, value FROM {last}'


_MASK = 'm AS (SELECT frame, "row", col, CASE WHEN value > 0 THEN 1 ELSE 0 END AS value FROM g)'


def mask(spark: SparkSession, folder: str, above: float = 0.0) -> DataFrame:
    return grid(spark, folder).select("frame", "row", "col", F.when(F.col("value") > above, 1).otherwise(0).alias("value"))


@query(f"WITH {_GRID}, {_MASK}, " + _stack("m", ("max", "col", 1)))
def dilated(spark, folder):
    return G.dilate(mask(spark, folder), "col", 1).select("frame", "row", "col", "value")


@query(f"WITH {_GRID}, {_MASK}, " + _stack("m", ("max", "row", 1), ("max", "col", 2), ("min", "row", 1), ("min", "col", 2), ("min", "row", 1), ("min", "col", 1), ("max", "row", 1), ("max", "col", 1)))
def closed_then_opened(spark, folder):
    return G.morphology(mask(spark, folder), [*G.closing(3, 5), *G.opening(3, 3)]).select("frame", "row", "col", "value")


@query(f"""WITH {_GRID}, {_MASK} SELECT m.frame, m."row", m.col, m.value = 1 AND sum(n.value) >= 3 AS persistent FROM m CROSS JOIN range(-2, 3) o(d) JOIN m n ON n.frame = m.frame AND n."row" = m."row" AND n.col = least(greatest(m.col + o.d, 0), {N - 1}) GROUP BY m.frame, m."row", m.col, m.value""")
def persistent_cells(spark, folder):
    m = mask(spark, folder).withColumn("set", F.col("value") == 1)
    return G.persistent(m, "col", 2, 3, N, "set", "persistent").select("frame", "row", "col", "persistent")


@query(f"""WITH {_GRID}, {_MASK} SELECT m.frame, m."row", m.col, sum(n.value) >= 5 AS smooth FROM m CROSS JOIN range(-1, 2) a(d) CROSS JOIN range(-1, 2) b(d) JOIN m n ON n.frame = m.frame AND n."row" = least(greatest(m."row" + a.d, 0), {N - 1}) AND n.col = least(greatest(m.col + b.d, 0), {N - 1}) GROUP BY 1, 2, 3""")
def majority_smoothed(spark, folder):
    m = mask(spark, folder).withColumn("set", F.col("value") == 1)
    return G.majority3(m, N, N, "set", "smooth").select("frame", "row", "col", "smooth")


@query(f"""WITH {_GRID}, b AS (SELECT frame, (("row" + 1) * 10 - 1) // {N} AS "row", ((col + 1) * 6 - 1) // {N} AS col, avg(value) AS value FROM g GROUP BY ALL), s AS (SELECT frame, min(value) AS lo, max(value) AS hi FROM b GROUP BY 1)
SELECT frame, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, CAST(floor(coalesce((value - lo) / nullif(hi - lo, 0), 0) * 255) AS INT) AS pixel FROM b JOIN s USING (frame)""")
def spectrogram_preview(spark, folder):
    return G.preview(G.downsample(grid(spark, folder), N, N, 10, 6))


@query(f"""WITH {_GRID} SELECT frame, "row", col, CAST(floor(sum(value) OVER (PARTITION BY frame, "row" // 5, col // 5) / 25) AS INT) AS pixel FROM g""")
def pixelated(spark, folder):
    return G.pixelate(grid(spark, folder), 5)


@query(f"""WITH {_GRID} SELECT g.frame, r.k::INT AS "row", c.k::INT AS col, max(g.value) AS value FROM g JOIN range(12) r(k) ON g."row" >= (r.k * {N}) // 12 AND g."row" < ((r.k + 1) * {N} + 11) // 12 JOIN range(48) c(k) ON g.col = (c.k * {N}) // 48 GROUP BY ALL""")
def resampled(spark, folder):
    """Rows shrink to 12 by the maximum, columns grow to 48 by the nearest."""
    return G.resample(grid(spark, folder), N, N, 12, 48)


@query(f"""WITH {_GRID} SELECT frame, least("row", {N - 1} - "row", col, {N - 1} - col) AS ring, count(*) AS n, round(avg(value), 6) AS mean FROM g GROUP BY 1, 2""")
def ring_profile(spark, folder):
    return G.rings(grid(spark, folder), N, N).select("frame", "ring", "n", F.round("mean", 6).alias("mean"))


@query(f"""WITH {_GRID}, r AS (SELECT frame, CASE WHEN least("row", {N - 1} - "row", col, {N - 1} - col) = 0 THEN value END AS edge, CASE WHEN least("row", {N - 1} - "row", col, {N - 1} - col) >= 4 THEN value END AS inner_value, value FROM g) SELECT frame, round(avg(edge) / avg(inner_value), 6) AS edge_ratio, round(stddev_pop(value) / avg(value), 6) AS variation FROM r GROUP BY 1""")
def flatness(spark, folder):
    ring = F.least("row", F.lit(N - 1) - F.col("row"), "col", F.lit(N - 1) - F.col("col"))
    g = grid(spark, folder).withColumn("ring", ring)
    return g.groupBy("frame").agg(F.round(F.avg(F.when(F.col("ring") == 0, F.col("value"))) / F.avg(F.when(F.col("ring") >= 4, F.col("value"))), 6).alias("edge_ratio"), F.round(F.stddev_pop("value") / F.avg("value"), 6).alias("variation"))


@query(f"""WITH {_GRID} SELECT "row", col, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS q90, round(avg(value), 6) AS mean FROM g GROUP BY 1, 2""")
def positional_template(spark, folder):
    """Per cell position the median, 90 % quantile and mean over frames."""
    g = grid(spark, folder)
    q = quantiles(g, ["row", "col"], "value", ["frame"], {"median": 0.5, "q90": 0.9})
    q = q.select("row", "col", F.round("median", 6).alias("median"), F.round("q90", 6).alias("q90"))
    return q.join(g.groupBy("row", "col").agg(F.round(F.avg("value"), 6).alias("mean")), ["row", "col"])


@query(f"""WITH {_GRID} SELECT frame, "row", round(avg(least(value, 40)), 6) AS capped_mean, round(avg(value) + 3 * stddev_pop(value), 6) AS floor, count(*) FILTER (WHERE value <> 0) AS n_set, max(value) AS most FROM g GROUP BY 1, 2""")
def row_statistics(spark, folder):
    return grid(spark, folder).groupBy("frame", "row").agg(
        F.round(F.avg(F.least("value", F.lit(40.0))), 6).alias("capped_mean"), F.round(F.avg("value") + 3 * F.stddev_pop("value"), 6).alias("floor"), F.count_if(F.col("value") != 0).alias("n_set"), F.max("value").alias("most")
    )


@query(f"""WITH {_GRID} SELECT "row", col, sum(CASE WHEN value >= 27 THEN value ELSE 0 END) AS total FROM g GROUP BY 1, 2""")
def threshold_sum(spark, folder):
    return grid(spark, folder).groupBy("row", "col").agg(F.sum(F.when(F.col("value") >= 27, F.col("value")).otherwise(0.0)).alias("total"))


def _box(r: int, c: int, name: str) -> str:
    near = f'n."row" BETWEEN g."row" - {r} AND g."row" + {r} AND n.col BETWEEN g.col - {c} AND g.col + {c}'
    return f"sum(n.value) FILTER (WHERE {near}) AS s{name}, count(*) FILTER (WHERE {near}) AS n{name}"


@query(f"""WITH {_GRID}, b AS (SELECT g.frame, g."row", g.col, g.value, {_box(2, 4, 't')}, {_box(1, 1, 'g')} FROM g JOIN g n ON n.frame = g.frame AND n."row" BETWEEN g."row" - 2 AND g."row" + 2 AND n.col BETWEEN g.col - 4 AND g.col + 4 GROUP BY ALL)
SELECT frame, "row", col, value > (nt - ng) * (power(1e-3, -1.0 / (nt - ng)) - 1) * ((st - sg) / (nt - ng)) AS hit FROM b""")
def cfar_detections(spark, folder):
    """Cell-averaging detection: a 5 x 9 box without the 3 x 3 around the cell."""
    return G.cfar(grid(spark, folder), N, N, (1, 1), (2, 4), 1e-3).select("frame", "row", "col", "hit")


@query(f"""WITH RECURSIVE {_GRID}, t AS (SELECT frame, "row" AS r, col AS c FROM g WHERE value > 60), n AS (SELECT frame, r, c, r * {N} + c AS id FROM t),
reach AS (SELECT frame, id, id AS seen FROM n UNION SELECT a.frame, a.id, b.id FROM reach a JOIN n m ON m.frame = a.frame AND m.id = a.seen JOIN n b ON b.frame = m.frame AND abs(b.r - m.r) + abs(b.c - m.c) = 1),
l AS (SELECT frame, id, min(seen) AS label FROM reach GROUP BY 1, 2)
SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY label) AS INT) AS component, min(r) AS row0, max(r) AS row1, min(c) AS col0, max(c) AS col1, count(*) AS pixel_count FROM l JOIN n USING (frame, id) GROUP BY frame, label""")
def labelled_components(spark, folder):
    """4-connected components of strong cells, by runs and minimum labels."""
    m = mask(spark, folder, 60.0).where("value = 1")
    c = G.label_components(m)
    return c.select("frame", "component", "row0", "row1", "col0", "col1", F.col("pixel_count").cast("long").alias("pixel_count"))


@query(f"""WITH {_GRID}, t AS (SELECT frame, "row", col, value > 30 AS a, value > 0 AND col % 2 = 0 AS b FROM g) SELECT frame, count(*) FILTER (WHERE a = b) / count(*) AS agreement, round(count(*) FILTER (WHERE a AND b) / greatest(1, count(*) FILTER (WHERE a OR b)), 9) AS iou, count(*) FILTER (WHERE a <> b) AS n_xor FROM t GROUP BY 1""")
def mask_agreement(spark, folder):
    g = grid(spark, folder).select("frame", (F.col("value") > 30).alias("a"), ((F.col("value") > 0) & (F.col("col") % 2 == 0)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return g.groupBy("frame").agg((F.count_if(a == b) / F.count(F.lit(1))).alias("agreement"), F.round(F.count_if(a & b) / F.greatest(F.lit(1), F.count_if(a | b)), 9).alias("iou"), F.count_if(a != b).alias("n_xor"))


@query(f"""WITH {_GRID}, a AS (SELECT frame, "row", col FROM g WHERE value > 30), b AS (SELECT frame, "row", col FROM g WHERE value > 0 AND col % 4 = 0) SELECT 'or' AS op, frame, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY frame UNION ALL SELECT 'and', frame, count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY frame UNION ALL SELECT 'minus', frame, count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY frame""")
def mask_set_operations(spark, folder):
    g = grid(spark, folder)
    a, b = g.where("value > 30").select("frame", "row", "col"), g.where("value > 0 and col % 4 = 0").select("frame", "row", "col")
    out = None
    for name, m in (("or", a.union(b).distinct()), ("and", a.intersect(b)), ("minus", a.subtract(b))):
        c = m.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "frame", "n")
        out = c if out is None else out.unionByName(c)
    return out


_SLOT = 4


@query(f"""WITH {_GRID}, k AS (SELECT "row", frame, sum(value) AS level, row_number() OVER (PARTITION BY "row" ORDER BY frame) AS k FROM g GROUP BY 1, 2), s AS (SELECT *, (k - 1) // {_SLOT} AS slot FROM k),
f AS (SELECT "row", slot, min(level) AS low FROM s GROUP BY 1, 2), p AS (SELECT a."row", a.slot, min(b.low) AS before FROM f a LEFT JOIN f b ON a."row" = b."row" AND b.slot BETWEEN a.slot - 7 AND a.slot - 1 GROUP BY 1, 2)
SELECT s."row", s.frame, least(min(level) OVER (PARTITION BY s."row", s.slot ORDER BY k ROWS UNBOUNDED PRECEDING), p.before, CASE WHEN s.slot < 7 THEN first_value(level) OVER (PARTITION BY s."row" ORDER BY k) END) AS noise_floor FROM s JOIN p ON p."row" = s."row" AND p.slot = s.slot""")
def dynamic_floor(spark, folder):
    """Noise floor per row: the running minimum of the current slot of frames and those of the seven full slots before, with the first level as seed until eight slots are full."""
    from wavemill.operators.floors import dynamic_floor as floor

    levels = grid(spark, folder).groupBy("row", "frame").agg(F.sum("value").alias("level"))
    return floor(levels, ["row"], ["frame"], "level", _SLOT, 8).select("row", "frame", F.col("floor").alias("noise_floor"))


@query(f"""WITH {_GRID}, t AS (SELECT frame, "row" - 4 AS "row", col - 8 AS col, least(greatest((value - 5) / 55, 0.0), 1.0) AS t FROM g WHERE "row" >= 4 AND "row" < 28 AND col >= 8 AND col < 24)
SELECT frame, "row", col, CAST(floor(least(greatest(1.5 - abs(4 * t - 3), 0), 1) * 255) AS INT) AS red, CAST(floor(least(greatest(1.5 - abs(4 * t - 2), 0), 1) * 255) AS INT) AS green, CAST(floor(least(greatest(1.5 - abs(4 * t - 1), 0), 1) * 255) AS INT) AS blue FROM t""")
def cropped_heat(spark, folder):
    """A cut-out in colours."""
    return G.heat(G.cropped(grid(spark, folder), (4, 28), (8, 24)), 5.0, 60.0)


@query(f"""WITH {_GRID}, u AS (SELECT frame, "row" AS r, col AS c, CAST(least(floor(value), 63) AS INT) AS v FROM g),
h AS (SELECT frame, r // 8 AS tr, c // 8 AS tc, v, count(*) AS n FROM u GROUP BY ALL), o AS (SELECT frame, tr, tc, sum(greatest(n - 2, 0)) AS excess FROM h GROUP BY ALL),
f AS (SELECT o.*, l.k AS v, excess // 64 + CASE WHEN excess % 64 > 0 AND l.k % greatest(64 // (excess % 64), 1) = 0 AND l.k // greatest(64 // (excess % 64), 1) < excess % 64 THEN 1 ELSE 0 END + least(coalesce(h.n, 0), 2) AS n FROM o CROSS JOIN range(64) l(k) LEFT JOIN h ON h.frame = o.frame AND h.tr = o.tr AND h.tc = o.tc AND h.v = l.k),
m AS (SELECT frame, tr, tc, v, least(round_even(sum(n) OVER (PARTITION BY frame, tr, tc ORDER BY v) * (63.0 / 64)::DOUBLE, 0), 63) AS y FROM f),
p AS (SELECT *, r / 8 - 0.5 AS fy, c / 8 - 0.5 AS fx FROM u), q AS (SELECT *, greatest(floor(fy), 0) AS top, least(floor(fy) + 1, 3) AS bottom, fy - floor(fy) AS wy, greatest(floor(fx), 0) AS l, least(floor(fx) + 1, 3) AS rt, fx - floor(fx) AS wx FROM p)
SELECT q.frame, q.r AS "row", q.c AS col, CAST(round_even((a.y * (1 - wx) + b.y * wx) * (1 - wy) + (c.y * (1 - wx) + d.y * wx) * wy, 0) AS INT) AS pixel FROM q
JOIN m a ON a.frame = q.frame AND a.v = q.v AND a.tr = q.top AND a.tc = q.l JOIN m b ON b.frame = q.frame AND b.v = q.v AND b.tr = q.top AND b.tc = q.rt
JOIN m c ON c.frame = q.frame AND c.v = q.v AND c.tr = q.bottom AND c.tc = q.l JOIN m d ON d.frame = q.frame AND d.v = q.v AND d.tr = q.bottom AND d.tc = q.rt""")
def equalised(spark, folder):
    """Contrast equalised in 4 x 4 tiles of 64 levels, at most twice an even share in each."""
    return G.equalised(grid(spark, folder), N, N, (4, 4), 2.0, 64)


@query(f"""WITH {_GRID}, k AS (SELECT r.k::INT AS tr, c.k::INT AS tc, (r.k - 15.5) / 24 AS y, (c.k - 15.5) / 24 AS x FROM range({N}) r(k) CROSS JOIN range({N}) c(k)), s AS (SELECT *, x * x + y * y AS r2 FROM k),
p AS (SELECT tr, tc, y * (1 + -0.18 * r2 + 0.05 * r2 * r2) * 24 + 15.5 AS sy, x * (1 + -0.18 * r2 + 0.05 * r2 * r2) * 24 + 15.5 AS sx FROM s)
SELECT g.frame, p.tr AS "row", p.tc AS col, round(sum(greatest(0, 1 - abs(sy - g."row")) * greatest(0, 1 - abs(sx - g.col)) * g.value), 6) AS value FROM p JOIN g ON abs(sy - g."row") < 1 AND abs(sx - g.col) < 1 GROUP BY ALL""")
def undistorted(spark, folder):
    """Barrel distortion of a lens taken out."""
    return G.undistorted(grid(spark, folder), N, N, 24.0, -0.18, 0.05).select("frame", "row", "col", F.round("value", 6).alias("value"))
