"""Chains of operators: the whole detector, cutting out signals, recordings written and read back, radar stages, and smaller reports."""

from __future__ import annotations

import cmath
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavemill.functions import scalar as S
from wavemill.operators import grids as G
from wavemill.operators import intervals as I
from wavemill.operators import metrics as M
from wavemill.operators import sampling
from wavemill.operators import signal as X
from wavemill.operators.floors import dynamic_floor
from wavemill.operators.names import regions_once
from wavemill.operators.nested import metadata_children
from wavemill.operators.vectors import nearest
from wavemill.plans.detections import _ANN, _ONCE, _REG, _SIM, FRAME, annotations, regions
from wavemill.plans.general import _P5_ROWS
from wavemill.plans.grids import _GRID, N, grid, mask
from wavemill.plans.metrics import _LAT, _METRICS, _latency, _metrics
from wavemill.plans.registry import Registry
from wavemill.plans.reports import tiled_rows
from wavemill.plans.signals import _H, _IQ, iq
from wavemill.plans.streams import retune_segments
from wavemill.session import scratch_path, within, written
from wavemill.sources import archives, packets, sigmf, traces
from wavemill.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

# --- the detector --------------------------------------------------------

_ROW, _COL = 'PARTITION BY frame, "row" ORDER BY col', 'PARTITION BY frame, col ORDER BY "row"'
_SIGMA, _CAP_DB, _BG, _SPAN, _SCORE, _FILL, _STRONG, _KEEP = 2.0, 6.0, (4, 3), 8.0, 0.58, 3.0, 60.0, (2, 3)
_W = G.gaussian_weights(_SIGMA)


def _smooth(name: str, source: str) -> str:
    taps = ", ".join(f"({k - len(_W) // 2}, {w!r})" for k, w in enumerate(_W))
    return f'{name} AS (SELECT s.frame, s."row", sum(n.m * o.w) / {sum(_W)!r} AS s FROM {source} s CROSS JOIN (VALUES {taps}) o(d, w) JOIN {source} n ON n.frame = s.frame AND n."row" = least(greatest(s."row" + o.d, 0), {N - 1}) GROUP BY 1, 2)'


def _around(name: str, source: str, value: str, rows: int, cols: int, least: int) -> str:
    """Cells with at least so many set ones in the box around them, the edge standing in for what is beyond."""

    def line(x: str, over: str, r: int) -> str:
        whole = f"({over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        near = [f"coalesce({f}({x}, {k}) OVER ({over}), {end}({x}) OVER {whole})" for k in range(1, r + 1) for f, end in (("lag", "first_value"), ("lead", "last_value"))]
        return " + ".join([x, *near])

    return f"""{name}_a AS (SELECT frame, "row", col, {value}::INT AS v FROM {source}), {name}_b AS (SELECT frame, "row", col, {line("v", _ROW, cols)} AS v FROM {name}_a), {name} AS (SELECT frame, "row", col, {line("v", _COL, rows)} >= {least} AS {value} FROM {name}_b)"""


def _steps(source: str, *steps: tuple[str, str, int]) -> str:
    out = []
    for i, (f, along, r) in enumerate(steps):
        out.append(f'w{i} AS (SELECT frame, "row", col, {f}(v) OVER ({_ROW if along == "col" else _COL} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM {f"w{i - 1}" if i else source})')
    return ", ".join(out)


@query(f"""WITH {_GRID}, d AS (SELECT frame, "row", col, log10(value + 1e-12) * 10 AS db FROM g), fl AS (SELECT "row", quantile_cont(db, 0.95) AS floor FROM d GROUP BY 1), m1 AS (SELECT frame, "row", avg(db) AS m FROM d GROUP BY 1, 2), {_smooth("s1", "m1")},
r1 AS (SELECT frame, avg(s) + 0.5 * (max(s) - avg(s)) AS ref FROM s1 GROUP BY 1), m2 AS (SELECT d.frame, "row", avg(least(db, ref + {_CAP_DB})) AS m FROM d JOIN r1 ON d.frame = r1.frame GROUP BY 1, 2), {_smooth("s2", "m2")},
r2 AS (SELECT frame, avg(s) + 0.5 * (max(s) - avg(s)) AS ref FROM s2 GROUP BY 1),
x AS (SELECT d.frame, d."row", col, db + least(greatest(ref - s, 0), 12) AS x FROM d JOIN s2 ON d.frame = s2.frame AND d."row" = s2."row" JOIN r2 ON r2.frame = d.frame),
b1 AS (SELECT *, avg(x) OVER ({_ROW} ROWS BETWEEN {_BG[0]} PRECEDING AND {_BG[0]} FOLLOWING) AS b FROM x), b2 AS (SELECT frame, "row", col, x, avg(b) OVER ({_COL} ROWS BETWEEN {_BG[1]} PRECEDING AND {_BG[1]} FOLLOWING) AS bg FROM b1),
c AS (SELECT b2.*, least(greatest((x - bg - 1.5) / {_SPAN}, 0), 1) AS score, coalesce(x > floor + {_FILL}, FALSE) AS full_, floor, x >= avg(bg) OVER (PARTITION BY frame, b2."row") + {_STRONG} AS strong FROM b2 LEFT JOIN fl ON fl."row" = b2."row"),
k AS (SELECT frame, "row", col, CASE WHEN full_ THEN greatest(score, least(greatest((x - floor) / {_SPAN}, 0), 1)) ELSE score END AS score, score >= {_SCORE} OR full_ AS hit, strong FROM c),
{_around("st", "k", "strong", 0, 1, 2)}, {_around("mj", "k", "hit", 1, 1, 5)}, i AS (SELECT frame, "row", col, hit::INT AS v FROM mj),
{_steps("i", ("min", "row", 1), ("min", "col", 3), ("max", "row", 1), ("max", "col", 3), ("max", "row", 2), ("max", "col", 10), ("min", "row", 2), ("min", "col", 10))}, o AS (SELECT frame, "row", col, v = 1 AS hit FROM w7), {_around("ps", "o", "hit", _KEEP[0], 0, _KEEP[1])}
SELECT frame, "row", col, round(k.score, 6) AS score, (o.hit AND ps.hit) OR (k.strong AND st.strong) AS hit FROM k JOIN o USING (frame, "row", col) JOIN ps USING (frame, "row", col) JOIN st USING (frame, "row", col)""")
def coherent_detections(spark, folder):
    """The coherent-power chain over each frame, with capped means, a floor for each row, strong cells brought back, and persistence."""
    g = grid(spark, folder)
    floors = M.quantiles(g.withColumn("db", F.log10(F.col("value") + 1e-12) * 10), ["row"], "db", ["frame", "col"], {"floor": 0.95})
    d = X.coherent_detector(g, N, N, sigma=_SIGMA, cap_db=_CAP_DB, background=_BG, span_db=_SPAN, score=_SCORE, floors=floors, fill_db=_FILL, strong_db=_STRONG, strong_cols=2, persistence=_KEEP)
    return d.select("frame", "row", "col", F.round("score", 6).alias("score"), "hit")


# --- cutting out signals -------------------------------------------------

_COMPONENTS = f"""t AS (SELECT frame, "row" AS r, col AS c FROM g WHERE value > 60), n AS (SELECT frame, r, c, r * {N} + c AS id FROM t),
reach AS (SELECT frame, id, id AS seen FROM n UNION SELECT a.frame, a.id, b.id FROM reach a JOIN n m ON m.frame = a.frame AND m.id = a.seen JOIN n b ON b.frame = m.frame AND abs(b.r - m.r) + abs(b.c - m.c) = 1),
l AS (SELECT frame, id, min(seen) AS label FROM reach GROUP BY 1, 2)"""
_BOXES = f"{_COMPONENTS}, box AS (SELECT frame, label, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM l JOIN n USING (frame, id) GROUP BY 1, 2 HAVING count(*) >= 2)"
#: A frame's samples in time: column by column of the grid.
_STREAM = f'q AS (SELECT frame, col * {N} + "row" AS t, value AS re, CAST((col % 2) * "row" AS DOUBLE) AS im FROM g)'


def _boxes(spark, folder):
    return G.label_components(mask(spark, folder, 60.0).where("value = 1"), min_pixels=2)


def _stream(spark, folder):
    return iq(spark, folder).select("frame", (F.col("col") * N + F.col("row")).cast("long").alias("t"), "re", "im")


@query(f"""WITH RECURSIVE {_GRID}, {_COMPONENTS} SELECT frame, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, CAST(dense_rank() OVER (PARTITION BY frame ORDER BY label) AS INT) AS component FROM l JOIN n USING (frame, id)""")
def component_map(spark, folder):
    """The component of every strong cell."""
    return G.label_map(mask(spark, folder, 60.0).where("value = 1"))


@query(f"""WITH RECURSIVE {_GRID}, {_BOXES}, {_STREAM}, iv AS (SELECT frame, c0 * {N} AS s, (c1 + 1) * {N} AS e FROM box), m AS (SELECT *, max(e) OVER (PARTITION BY frame ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
k AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY frame ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m), u AS (SELECT frame, k, min(s) AS s, max(e) AS e, count(*) AS members FROM k GROUP BY 1, 2)
SELECT u.frame, s::BIGINT AS start_sample, count(*) AS n_samples, members, round(sum(re * re + im * im), 4) AS energy FROM u JOIN q ON q.frame = u.frame AND t >= s AND t < e GROUP BY u.frame, s, e, members""")
def snipped_signals(spark, folder):
    """Signals cut out in time: components of the mask of at least two cells, as stretches of samples, those that touch made one, with the samples of each."""
    b = _boxes(spark, folder).select("frame", (F.col("col0") * N).cast("long").alias("s"), ((F.col("col1") + 1) * N).cast("long").alias("e"))
    merged = I.merge_touching(b, ["frame"], "s", "e")
    cut = X.time_slices(_stream(spark, folder), merged, ["frame"], "t", "s", "e", 8 * N)
    return cut.groupBy("frame", F.col("s").alias("start_sample"), "members").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.sum(S.abs2(F.col("re"), F.col("im"))), 4).alias("energy"))


@query(f"""WITH RECURSIVE {_GRID}, {_BOXES}, {_STREAM}, h AS (SELECT unnest(range({len(_H)})) AS k, unnest([{", ".join(repr(t) for t in _H)}]) AS t),
cut AS (SELECT box.frame, label, t - c0 * {N} AS o, ((r0 + r1 + 1) / 2 / {N} - 0.5) AS f, re, im FROM box JOIN q ON q.frame = box.frame AND t >= c0 * {N} AND t < (c1 + 1) * {N}),
mx AS (SELECT frame, label, o, re * cos(2 * pi() * f * o) + im * sin(2 * pi() * f * o) AS re, im * cos(2 * pi() * f * o) - re * sin(2 * pi() * f * o) AS im FROM cut),
y AS (SELECT frame, label, (o + k - {len(_H) // 2}) // 4 AS m, sum(h.t * re) AS re, sum(h.t * im) AS im, max(len_) AS len_ FROM (SELECT mx.*, max(o) OVER (PARTITION BY frame, label) AS len_ FROM mx) mx JOIN h ON o + k - {len(_H) // 2} >= 0 AND (o + k - {len(_H) // 2}) % 4 = 0 GROUP BY 1, 2, 3)
SELECT frame, CAST(label AS BIGINT) AS first_cell, count(*) AS n_out, round(sum(re * re + im * im), 3) AS energy FROM y WHERE m * 4 <= len_ GROUP BY 1, 2""")
def snipped_channels(spark, folder):
    """Signals cut out in time and frequency: each component's samples mixed down from its middle, filtered and decimated by 4."""
    r = G._labelled_runs(mask(spark, folder, 60.0).where("value = 1")).groupBy("frame", "label").agg(F.min("line").alias("row0"), F.max("line").alias("row1"), F.min("start").alias("col0"), F.max("stop").alias("col1"), F.sum(F.col("stop") - F.col("start") + 1).alias("n")).where("n >= 2")
    cell = F.shiftright("label", 32) * N + F.col("label").bitwiseAND(0xFFFFFFFF)
    b = r.select("frame", cell.alias("first_cell"), (F.col("col0") * N).cast("long").alias("s"), ((F.col("col1") + 1) * N).cast("long").alias("e"), ((F.col("row0") + F.col("row1") + 1) / 2 / N - 0.5).alias("f"))
    cut = written(X.time_slices(_stream(spark, folder), b, ["frame"], "t", "s", "e", 8 * N), "cut")
    y = X.filter_decimate(cut, ["frame", "first_cell"], "offset", "re", "im", _H, F.col("f"), 4)
    return y.groupBy("frame", "first_cell").agg(F.count(F.lit(1)).alias("n_out"), F.round(F.sum(S.abs2(F.col("re"), F.col("im"))), 3).alias("energy"))


# --- recordings ----------------------------------------------------------


def _headers(spark, folder):
    """Captures with their valid annotations, written as header files in the scratch folder and read back."""
    c = table(spark, folder, "captures").where("stem is not null").groupBy("stem").agg(*[F.max(x).alias(x) for x in ("sample_rate", "center_freq_hz", "datatype")])
    text = table(spark, folder, "annotations").select("stem", "ann_idx", "label", "kind", "sample_count").dropDuplicates(["stem", "ann_idx"])
    a = annotations(spark, folder).select("stem", "ann_idx", "s", "lo", "hi").join(text, ["stem", "ann_idx"])
    one = F.struct(F.col("s").alias("core:sample_start"), F.col("sample_count").alias("core:sample_count"), F.col("lo").alias("core:freq_lower_edge"), F.col("hi").alias("core:freq_upper_edge"), F.col("label").alias("core:label"), "kind")
    a = a.groupBy("stem").agg(F.collect_list(one).alias("anns"))  # a header holds all annotations of its capture
    at = scratch_path(spark, "headers")
    sigmf.write_files(sigmf.header_json(c.join(a, "stem", "left"), "anns"), at, ".sigmf-meta").write.format("noop").mode("overwrite").save()
    return sigmf.read_headers(spark, at)


@query("""SELECT stem, max(sample_rate) AS sample_rate, max(center_freq_hz) AS center_freq_hz, TRY_CAST(nullif(regexp_extract(stem, 'attenuation_dB_(\\d+)', 1), '') AS INT) AS attenuation_db, max(datatype) AS datatype FROM captures WHERE stem IS NOT NULL GROUP BY stem""")
def recording_headers(spark, folder):
    """Captures as header files, read back."""
    return sigmf.captures(_headers(spark, folder))


@query(f"""WITH {_ANN}, x AS (SELECT DISTINCT ON (stem, ann_idx) stem, ann_idx, label, kind, sample_count FROM annotations), j AS (SELECT v.stem, s, x.sample_count, lo, hi, label, kind FROM v JOIN x ON x.stem = v.stem AND x.ann_idx = v.ann_idx)
SELECT stem, CAST(row_number() OVER (PARTITION BY stem ORDER BY s, lo, label NULLS FIRST, hi, sample_count NULLS FIRST, kind NULLS FIRST) - 1 AS INT) AS ann_idx, s AS sample_start, sample_count, lo AS freq_lower_hz, hi AS freq_upper_hz, coalesce(label, 'UNLABELED') AS label, coalesce(kind, 'annotation') AS kind FROM j""")
def recording_annotations(spark, folder):
    """Annotations in header files, read back in order of their start."""
    return sigmf.annotations(_headers(spark, folder)).select("stem", "ann_idx", "sample_start", "sample_count", "freq_lower_hz", "freq_upper_hz", "label", "kind")


@query(f"""WITH {_GRID}, q AS (SELECT frame, "row" * {N} + col AS t, value AS re, CAST((col % 2) * "row" AS DOUBLE) AS im FROM g) SELECT frame::VARCHAR AS stem, t // 300 AS frame_number, (t // 300) * 300 AS sample_start, count(*)::INT AS n_read, 300 AS n_padded, sum(re) AS sum_i, sum(im) AS sum_q FROM q GROUP BY 1, 2, 3""")
def recording_frames(spark, folder):
    """Grids written as recordings of samples, read back as frames of 300 with the last one padded."""
    at = scratch_path(spark, "samples")
    long = iq(spark, folder).select(F.col("frame").cast("string").alias("stem"), (F.col("row") * N + F.col("col")).alias("at"), F.col("re").alias("i"), F.col("im").alias("q"))
    sigmf.write_samples(long, at).write.format("noop").mode("overwrite").save()
    sigmf.register(spark)
    f = spark.read.format("iq_frames").option("datatype", "cf32_le").option("frame_samples", 300).option("frames_per_partition", 64).load(at)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    stem = F.regexp_extract("path", r"([^/]*)\.sigmf-data$", 1)
    return f.select(stem.alias("stem"), "frame_number", "sample_start", "n_read", F.size("i").alias("n_padded"), total(F.col("i")).alias("sum_i"), total(F.col("q")).alias("sum_q"))


# --- radar and audio -----------------------------------------------------

_CHIRP = [cmath.exp(1j * math.pi * k * k / 8) for k in range(8)]
_HAM8 = [0.54 - 0.46 * math.cos(2 * math.pi * k / 7) for k in range(8)]
_NORM = math.sqrt(sum((abs(c) * h) ** 2 for c, h in zip(_CHIRP, _HAM8, strict=True)))
_WAVE = [c * h / _NORM for c, h in zip(_CHIRP, _HAM8, strict=True)]


@query(f"""WITH {_IQ}, w AS (SELECT * FROM (VALUES {", ".join(f"({k}, {c.real!r}, {c.imag!r})" for k, c in enumerate(_WAVE))}) w(k, wr, wi)), o AS (SELECT unnest(range({N})) AS m)
SELECT x.frame, x."row", CAST(o.m AS INT) AS m, round(sum(re * wr + im * wi), 6) + 0.0 AS re, round(sum(im * wr - re * wi), 6) + 0.0 AS im FROM o CROSS JOIN w JOIN x ON x.col = (o.m + k) % {N} GROUP BY 1, 2, 3""")
def pulse_compressed(spark, folder):
    """Matched filter of each line against a chirp of eight samples."""
    d = iq(spark, folder).groupBy("frame", "row").agg(F.sort_array(F.collect_list(F.struct("col", "re", "im"))).alias("s"))  # 32 samples a line
    p = X.pulse_compression(d.select("frame", "row", F.col("s.re").alias("re"), F.col("s.im").alias("im")), ["frame", "row"], "re", "im", _CHIRP)
    p = p.select("frame", "row", F.posexplode(F.arrays_zip("re", "im")).alias("m", "z"))
    return p.select("frame", "row", "m", (F.round("z.re", 6) + 0.0).alias("re"), (F.round("z.im", 6) + 0.0).alias("im"))


@query(f"""WITH {_IQ}, h AS (SELECT frame, col, "row" AS k, re * (0.54 - 0.46 * cos(2 * pi() * "row" / {N - 1})) AS re, im * (0.54 - 0.46 * cos(2 * pi() * "row" / {N - 1})) AS im FROM x)
SELECT frame, col, CAST(b.m AS INT) AS bin, round(sqrt(power(sum(re * cos(2 * pi() * b.m * k / {N}) + im * sin(2 * pi() * b.m * k / {N})), 2) + power(sum(im * cos(2 * pi() * b.m * k / {N}) - re * sin(2 * pi() * b.m * k / {N})), 2)), 5) AS amplitude FROM h CROSS JOIN range({N}) b(m) GROUP BY 1, 2, 3""")
def range_doppler(spark, folder):
    """Doppler spectrum of each range: Hamming window and transform over the lines of a frame."""
    d = iq(spark, folder).groupBy("frame", "col").agg(F.sort_array(F.collect_list(F.struct("row", "re", "im"))).alias("s"))  # 32 pulses a frame
    p = X.doppler(d.select("frame", "col", F.col("s.re").alias("re"), F.col("s.im").alias("im")), ["frame", "col"], "re", "im")
    p = p.select("frame", "col", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
    return p.select("frame", "col", "bin", F.round(F.sqrt(S.abs2(F.col("z.re"), F.col("z.im"))), 5).alias("amplitude"))


_UP, _DOWN = 2, 3
_AUDIO = X.lowpass(13, 0.5 / _DOWN)


@query(f"""WITH {_IQ}, p AS (SELECT frame, "row", col, lag(re) OVER w AS pr, lag(im) OVER w AS pi, re, im FROM x WINDOW w AS (PARTITION BY frame, "row" ORDER BY col)), d AS (SELECT frame, "row", col - 1 AS n, atan2(im * pr - re * pi, re * pr + im * pi) / pi() AS v FROM p WHERE pr IS NOT NULL),
h AS (SELECT unnest(range({len(_AUDIO)})) AS k, unnest([{", ".join(repr(t * _UP) for t in _AUDIO)}]) AS t), y AS (SELECT frame, "row", m.m, sum(t * v) AS v FROM range({(N - 2) * _UP // _DOWN + 1}) m(m) JOIN d ON abs(m.m * {_DOWN} - n * {_UP}) <= {len(_AUDIO) // 2} JOIN h ON k = m.m * {_DOWN} - n * {_UP} + {len(_AUDIO) // 2} GROUP BY 1, 2, 3)
SELECT frame, "row", CAST(m AS INT) AS m, CAST(trunc(round(least(greatest(v, -1), 1), 9) * 32767) AS INT) AS pcm FROM y""")
def pcm_audio(spark, folder):
    """Each line demodulated, resampled by 2/3 and as 16-bit samples."""
    d = X.phase_steps(iq(spark, folder), ["frame", "row"], "col", "re", "im").where("phase is not null")
    d = d.select("frame", "row", (F.col("col") - 1).alias("n"), (F.col("phase") / math.pi).alias("v"))
    y = X.polyphase(d, ["frame", "row"], "n", "v", _AUDIO, _UP, _DOWN)
    return y.select("frame", "row", "m", S.pcm16(F.round("value", 9)).alias("pcm"))


# --- masks and floors ----------------------------------------------------


@query(f"""WITH {_ANN}, f AS (SELECT stem, k AS frame, k * {FRAME} AS fs0, least((k + 1) * {FRAME}, n) AS fe FROM c, unnest(range(0, (n + {FRAME} - 1) // {FRAME})) t(k)),
j AS (SELECT v.stem, f.frame, ann_idx, (greatest(s, fs0) - fs0) * 16 // {FRAME} AS r0, ((least(e, fe) - fs0) * 16 + {FRAME} - 1) // {FRAME} AS r1, CAST(least(greatest(floor((lo / fs + 0.5) * 64), 0), 63) AS BIGINT) AS c0, CAST(least(greatest(ceil((hi / fs + 0.5) * 64), 0), 64) AS BIGINT) AS c1 FROM v JOIN f ON v.stem = f.stem AND s < fe AND e > fs0),
b AS (SELECT stem, frame, ann_idx, r0, greatest(r1, r0 + 1) AS r1, c0, greatest(c1, c0 + 1) AS c1 FROM j), rr AS (SELECT stem, frame, unnest(range(r0, r1)) AS r, c0, c1 FROM b), cc AS (SELECT DISTINCT stem, frame, r, unnest(range(c0, c1)) AS c FROM rr)
SELECT cc.stem, cc.frame, count(*) AS n_set, min(r) AS top, max(c) AS right_edge FROM cc GROUP BY 1, 2""")
def annotation_masks(spark, folder):
    """Annotations drawn into frames of 16 x 64 cells, each at least one cell high and wide, overlapping ones counted once."""
    c = table(spark, folder, "captures").groupBy("stem").agg(F.max("n_samples").alias("n"))
    f = c.select("stem", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {FRAME}"))).alias("frame"), "n")
    f = f.select("stem", "frame", (F.col("frame") * FRAME).alias("fs0"), F.least((F.col("frame") + 1) * FRAME, F.col("n")).alias("fe"))
    j = I.overlap_join(annotations(spark, folder).select("stem", "s", "e", "lo", "hi", "fs"), f, ("s", "e"), ("fs0", "fe"), FRAME, ["stem"])
    inside = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most))
    r0 = F.floor((F.greatest("s", "fs0") - F.col("fs0")) * 16 / FRAME)
    r1 = F.ceil((F.least("e", "fe") - F.col("fs0")) * 16 / FRAME)
    c0, c1 = inside(F.floor((F.col("lo") / F.col("fs") + 0.5) * 64), 63), inside(F.ceil((F.col("hi") / F.col("fs") + 0.5) * 64), 64)
    cells = j.select("stem", "frame", F.explode(F.sequence(r0, F.greatest(r1, r0 + 1) - 1)).alias("r"), c0.alias("c0"), F.greatest(c1, c0 + 1).alias("c1"))
    cells = cells.select("stem", "frame", "r", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("c")).distinct()
    return cells.groupBy("stem", "frame").agg(F.count(F.lit(1)).alias("n_set"), F.min("r").alias("top"), F.max("c").alias("right_edge"))


@query(f"""WITH {_GRID} SELECT frame, CAST("row" // 4 AS INT) AS "row", col, max(CASE WHEN value > 30 THEN 1 ELSE 0 END) AS value FROM g GROUP BY 1, 2, 3""")
def history_mask(spark, folder):
    """Masks with four rows made one, set where any of them is."""
    return G.downsample(mask(spark, folder, 30.0), N, N, N // 4, N, "max")


@query("""WITH c AS (SELECT user_id, event_id, ts, event_type, value, lag(event_type) OVER w AS before FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM c)
SELECT user_id, event_id, segment, min(value) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS noise_floor FROM s""")
def reseeded_floor(spark, folder):
    """Noise floor of each user, learned anew whenever the setting changes."""
    e = table(spark, folder, "events").where("value is not null")
    seg = retune_segments(spark, folder, e)
    e = e.select("user_id", "event_id", "ts", "value").join(seg, ["user_id", "event_id"])
    return dynamic_floor(e, ["user_id", "segment"], ["ts", "event_id"], "value", 4, 1 << 20).select("user_id", "event_id", "segment", F.col("floor").alias("noise_floor"))


# --- smaller reports -----------------------------------------------------


@query(f"""WITH {_REG}, f AS (SELECT DISTINCT frame_id FROM r), k AS (SELECT DISTINCT label FROM r WHERE label IS NOT NULL), h AS (SELECT frame_id, label, count(*) AS n, arg_min(row0, (ann_idx, row0, col0)) AS row0, arg_min(col0, (ann_idx, row0, col0)) AS col0 FROM r WHERE length_samples >= 10000 GROUP BY 1, 2)
SELECT f.frame_id, k.label, coalesce(n, 0) AS n, coalesce(h.row0, -1) AS row0, coalesce(h.col0, -1) AS col0 FROM f CROSS JOIN k LEFT JOIN h ON h.frame_id = f.frame_id AND h.label = k.label""")
def regions_by_label(spark, folder):
    """Regions long enough, split by label; a frame without any of a label has a box at -1 for it."""
    r = written(regions(spark, folder), "regions")
    labels = r.select("label").where("label is not null").distinct()
    if not within(labels, 1_000):
        raise ValueError("too many labels for a column of their own")
    known = F.array(*[F.lit(x["label"]) for x in labels.collect()]).cast("array<string>")
    every = r.select("frame_id").distinct().select("frame_id", F.explode(known).alias("label"))
    h = r.where("length_samples >= 10000").groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("row0", "col0"), F.struct("ann_idx", "row0", "col0")).alias("b"))
    return every.join(h, ["frame_id", "label"], "left").select("frame_id", "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("b.row0", F.lit(-1)).alias("row0"), F.coalesce("b.col0", F.lit(-1)).alias("col0"))


@query(f"""WITH {_LAT}, a AS (SELECT detector, device, sample_rate_hz, avg(v) AS mean FROM l JOIN latency_cells USING (cell_index) GROUP BY 1, 2, 3), f AS (SELECT detector, device, regr_slope(ln(mean), ln(sample_rate_hz)) AS s, regr_intercept(ln(mean), ln(sample_rate_hz)) AS b FROM a GROUP BY 1, 2)
SELECT detector, device, round(exp((ln(20) - b) / s) / 1e6, 3) AS rate_at_20_ms FROM f WHERE s > 0""")
def budget_crossing(spark, folder):
    """The sample rate (MHz) at which each fitted latency crosses 20 ms."""
    a = _latency(spark, folder).join(table(spark, folder, "latency_cells"), "cell_index").groupBy("detector", "device", "sample_rate_hz").agg(F.avg("v").alias("mean"))
    x, y = F.log("sample_rate_hz"), F.log("mean")
    f = a.groupBy("detector", "device").agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("b")).where("s > 0")
    return f.select("detector", "device", F.round(F.exp((math.log(20) - F.col("b")) / F.col("s")) / 1e6, 3).alias("rate_at_20_ms"))


@query(f"""WITH {_SIM}, k AS (SELECT label, count(*) - 1 AS others FROM embeddings GROUP BY 1), p AS (SELECT query, ql, min(rank) FILTER (WHERE label = ql) AS first, count(*) FILTER (WHERE label = ql) AS hits FROM t WHERE rank <= 10 GROUP BY 1, 2)
SELECT ql AS label, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(hits / greatest(others, 1)), 6) AS recall_at_10 FROM p JOIN k ON k.label = p.ql GROUP BY 1""")
def ranked_retrieval(spark, folder):
    """Mean reciprocal rank of the first neighbour of the query's own label, and the share of that label found, among ten."""
    e = table(spark, folder, "embeddings")
    top = nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    others = e.groupBy(F.col("label").alias("ql")).agg((F.count(F.lit(1)) - 1).alias("others"))
    j = top.join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(e.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour")
    own = F.col("label") == F.col("ql")
    p = j.groupBy("query", "ql").agg(F.min(F.when(own, F.col("rank"))).alias("first"), F.count_if(own).alias("hits")).join(others, "ql")
    return p.groupBy(F.col("ql").alias("label")).agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("hits") / F.greatest("others", F.lit(1))), 6).alias("recall_at_10"))


@query("""SELECT event_id, lpad(lower(hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(event_type || ':' || event_id) + 1), lambda k: ascii((event_type || ':' || event_id)[k])::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)), 16, '0') AS fingerprint FROM events WHERE event_type IS NOT NULL""")
def payload_fingerprints(spark, folder):
    """FNV-1a of each event's name, by which equal payloads are known."""
    e = table(spark, folder, "events").where("event_type is not null")
    return e.select("event_id", S.fnv1a(F.encode(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")), "UTF-8")).alias("fingerprint"))


@query("""WITH v AS (SELECT event_type, value AS x FROM events UNION ALL SELECT event_type, event_id % 100 FROM events) SELECT event_type, count(x) AS n, round(avg(x), 6) AS mean FROM v WHERE event_type IS NOT NULL GROUP BY 1""")
def utilisation_means(spark, folder):
    """Readings written as lines of comma-separated text in a folder per source, read back flat; what is no number is left out."""
    at = scratch_path(spark, "utilisation")
    line = F.concat_ws(", ", F.coalesce(F.col("value").cast("string"), F.lit("n/a")), (F.col("event_id") % 100).cast("string"), F.lit(""))
    table(spark, folder, "events").where("event_type is not null").select("event_type", line.alias("value")).write.partitionBy("event_type").text(at)
    x = spark.read.text(at).select(F.col("event_type").cast("string").alias("event_type"), F.explode(F.split("value", ",")).alias("x")).withColumn("x", F.trim("x").try_cast("double"))
    return x.groupBy("event_type").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


@query(f"""WITH {_METRICS}, a AS (SELECT * FROM m WHERE detector = 'energy_gate'), b AS (SELECT * FROM m WHERE detector = 'coherent_sum')
SELECT coalesce(a.file_stem, b.file_stem) AS file_stem, coalesce(a.frame_number, b.frame_number) AS frame_number, coalesce(a.ann_idx, b.ann_idx) AS ann_idx, round(a.coverage, 6) AS coverage_a, round(b.coverage, 6) AS coverage_b FROM a FULL JOIN b ON a.file_stem = b.file_stem AND a.frame_number = b.frame_number AND a.ann_idx = b.ann_idx""")
def artifact_manifest(spark, folder):
    """What either of two detectors has of each region, side by side, written as csv and read back."""
    m = _metrics(spark, folder)
    keys = ["file_stem", "frame_number", "ann_idx"]
    side = lambda d, name: m.where(F.col("detector") == d).select(*keys, F.round("coverage", 6).alias(name))
    both = side("energy_gate", "coverage_a").join(side("coherent_sum", "coverage_b"), keys, "full")
    at = scratch_path(spark, "manifest")
    both.write.option("header", True).csv(at)
    return spark.read.option("header", True).schema("file_stem string, frame_number long, ann_idx int, coverage_a double, coverage_b double").csv(at)


@query("""WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE user_id % 3 = 1) SELECT event_type, event_id, k AS row_no FROM n WHERE k % 5 = 0 AND k <= 100""")
def kept_previews(spark, folder):
    """Of one channel every fifth frame of each type is kept as a preview, at most twenty."""
    e = table(spark, folder, "events").withColumn("channel", (F.col("user_id") % 3).cast("int"))
    e = sampling.channel(e, "channel", 1).select("event_type", "ts", "event_id")
    return sampling.every_nth(e, ["event_type"], ["ts", "event_id"], 5, 20).select("event_type", "event_id", "row_no")


@query("""SELECT l_orderkey, count(*) AS n_slices, string_agg(CAST(greatest(least(trunc(l_quantity * 37.5 - 1024), 32767), -32768) AS INT)::VARCHAR, ',' ORDER BY l_shipdate, l_linenumber, l_partkey, l_quantity) AS voxels FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1""")
def series_volumes(spark, folder):
    """Slices of each series in order of their distance, rescaled and as 16-bit values."""
    l = table(spark, folder, "lineitem").where("l_quantity is not null")  # noqa: E741
    v = S.clamp(F.col("l_quantity") * 37.5 - 1024, -32768.0, 32767.0).cast("int")
    s = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_quantity", v.alias("v")))).alias("s"))  # the lines of an order
    return s.select("l_orderkey", F.size("s").cast("long").alias("n_slices"), F.array_join(F.transform("s", lambda x: x["v"].cast("string")), ",").alias("voxels"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
r AS (SELECT user_id, event_id, k, ms AS last, TRUE AS kept FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.ms - r.last > 86400000 THEN e.ms ELSE r.last END, e.ms - r.last > 86400000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id FROM r WHERE kept""")
def kept_stamps(spark, folder):
    """Events of each user without those within a day of the last one kept."""
    e = table(spark, folder, "events").where("ts is not null").select("user_id", "event_id", "ts", F.unix_millis(F.to_timestamp(F.col("ts").cast("string"))).alias("ms"))
    return traces.drop_repeats(e, ["user_id"], ["ts", "event_id"], "ms", 86_400_000).select("user_id", "event_id")


_PIXELS = [(4.0 * i, 3.0 + 4.0 * j) for i in range(8) for j in range(6)]


@query(f"""WITH {_IQ}, p AS (SELECT * FROM (VALUES {", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(_PIXELS))}) p(pixel, px, py)), d AS (SELECT DISTINCT frame, "row" FROM x), r AS (SELECT frame, "row", pixel, sqrt(power(px - "row", 2) + py * py) AS far FROM d CROSS JOIN p),
b AS (SELECT *, CAST(floor(far) AS INT) AS lo, far - floor(far) AS part FROM r WHERE floor(far) + 1 < {N}), e AS (SELECT b.frame, pixel, far, u.re * (1 - part) + v.re * part AS re, u.im * (1 - part) + v.im * part AS im FROM b JOIN x u ON u.frame = b.frame AND u."row" = b."row" AND u.col = lo JOIN x v ON v.frame = b.frame AND v."row" = b."row" AND v.col = lo + 1)
SELECT frame, pixel, round(sum(re * cos(4 * pi() * far / 0.7) - im * sin(4 * pi() * far / 0.7)), 5) AS re, round(sum(re * sin(4 * pi() * far / 0.7) + im * cos(4 * pi() * far / 0.7)), 5) AS im FROM e GROUP BY 1, 2""")
def back_projected(spark, folder):
    """An image of 48 pixels from each frame's lines as pulses along a track."""
    d = iq(spark, folder).groupBy("frame", "row").agg(F.sort_array(F.collect_list(F.struct("col", "re", "im"))).alias("s"))  # 32 samples a line
    b = X.back_project(d.select("frame", "row", F.col("s.re").alias("re"), F.col("s.im").alias("im")), ["frame"], "row", "re", "im", _PIXELS, 1.0, 1.0, 0.7)
    return b.select("frame", "pixel", F.round("re", 5).alias("re"), F.round("im", 5).alias("im"))


@query("""WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.query, q.label AS ql, b.vec_id AS neighbour, b.label, round(list_cosine_similarity(q.e, CAST(b.embedding AS DOUBLE[])), 9) AS similarity FROM q JOIN embeddings b ON b.vec_id <> q.query),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM s WHERE label = ql AND similarity >= 0.25), a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM s)
SELECT query, neighbour, rank, TRUE AS filtered FROM o WHERE rank <= 3 UNION ALL SELECT query, neighbour, rank, FALSE FROM a WHERE rank <= 3 AND query NOT IN (SELECT query FROM o)""")
def filtered_neighbours(spark, folder):
    """The nearest vectors of the query's own label that are near enough; for a query without any, the nearest of all."""
    e = table(spark, folder, "embeddings")
    q = e.where("vec_id % 100 = 0")
    own = written(nearest(e, q, "vec_id", "embedding", 3, 0.25, same="label"), "own")
    rest = nearest(e, q.join(own.select(F.col("query").alias("vec_id")), "vec_id", "left_anti"), "vec_id", "embedding", 3)
    take = lambda d, filtered: d.select("query", "neighbour", "rank", F.lit(filtered).alias("filtered"))
    return take(own, True).unionByName(take(rest, False))


@query("""SELECT user_id, string_agg(event_type || '/' || event_id || '.json', ':' ORDER BY event_type || '/' || event_id || '.json') AS paths, sum(length(props))::BIGINT AS n_bytes FROM events WHERE event_type IN ('purchase', 'click') AND props IS NOT NULL GROUP BY 1""")
def unzipped_members(spark, folder):
    """Each user's events packed into an archive, and the members of two kinds found in it again."""
    e = table(spark, folder, "events").where("event_type is not null and props is not null")
    one = F.struct(F.concat("event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").alias("text"))
    z = archives.packed(e.groupBy("user_id").agg(F.collect_list(one).alias("files")), "user_id", "files")  # an archive holds all files of its user
    return archives.matching_members(z, "user_id", "archive", "[pc]*/*.json").where("paths <> ''")


@query(f"""WITH {_GRID} SELECT frame, "row", sum(value) AS total FROM g GROUP BY 1, 2""")
def reassembled_rows(spark, folder):
    """Frames cut into tiles of ten rows, filled up, put together again without what was filled up."""
    t = tiled_rows(spark, folder)
    return t.select("frame", (F.col("tile") * 10 + F.col("tile_row")).cast("int").alias("row"), "total").where(F.col("row") < N)


@query(f"""{_P5_ROWS}, v AS (SELECT child_value FROM p5 WHERE child_kind = 'tested_version') SELECT child_value AS version, count(*) AS n FROM v GROUP BY 1""")
def tested_version_counts(spark, folder):
    """How often each version is among those an entry was tested with."""
    c = metadata_children(table(spark, folder, "project_metadata")).where("child_kind = 'tested_version'")
    return c.groupBy(F.col("child_value").alias("version")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_METRICS}, a AS (SELECT list(DISTINCT detector) AS every FROM m WHERE detector IS NOT NULL), f AS (SELECT file_stem, frame_number, list(DISTINCT detector) AS own FROM m GROUP BY 1, 2)
SELECT file_stem, frame_number, array_to_string(list_sort(list_filter(every, lambda d: NOT list_contains(coalesce(own, []), d))), ',') AS missing FROM f, a WHERE len(list_filter(every, lambda d: NOT list_contains(coalesce(own, []), d))) > 0""")
def missing_detectors(spark, folder):
    """Detectors that told nothing of a frame others told of."""
    m = _metrics(spark, folder)
    known = m.select("detector").where("detector is not null").distinct()
    if not within(known, 1_000):
        raise ValueError("too many detectors for an array")
    every = F.array(*[F.lit(x["detector"]) for x in known.collect()]).cast("array<string>")
    f = m.groupBy("file_stem", "frame_number").agg(F.collect_set("detector").alias("own"))  # at most all detectors
    return f.select("file_stem", "frame_number", F.array_join(F.sort_array(F.array_except(every, "own")), ",").alias("missing")).where("missing <> ''")


@query(f"""WITH {_ONCE}, r AS (SELECT * FROM once WHERE frame IS NOT NULL AND split = 'test') SELECT frame_id, count(*) AS n, count(DISTINCT label) AS n_labels, max(bandwidth_hz) AS widest FROM r GROUP BY 1""")
def held_out_regions(spark, folder):
    """Regions of each frame that the test split has."""
    r = regions_once(table(spark, folder, "regions"), table(spark, folder, "captures")).where("frame is not null and split = 'test'")
    return r.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("n_labels"), F.max("bandwidth_hz").alias("widest"))


@query(f"""WITH {_GRID} SELECT frame, "row", count(*) FILTER (WHERE value > 20) AS hot, max(value)::BIGINT AS most, CAST(arg_max(col, (value, -col)) AS BIGINT) AS at_col FROM g GROUP BY 1, 2""")
def pulse_words(spark, folder):
    """What is known of each line as words of a packet, and read from it again: cells above a level, the largest value, and where it is."""
    p = grid(spark, folder).groupBy("frame", "row").agg(F.count_if(F.col("value") > 20).alias("hot"), F.max("value").cast("long").alias("most"), F.max_by("col", F.struct("value", -F.col("col"))).cast("long").alias("at"))
    w = p.select("frame", "row", packets.words32(packets.encode32(F.array("hot", "most", "at"))).alias("w"))
    return w.select("frame", "row", *[F.col("w")[i].alias(n) for i, n in enumerate(("hot", "most", "at_col"))])


@query(f"""WITH {_GRID} SELECT frame, max(value) AS most, arg_max({{'r': "row", 'c': col}}, (value, -"row", -col)).r AS at_row, arg_max({{'r': "row", 'c': col}}, (value, -"row", -col)).c AS at_col FROM g GROUP BY 1""")
def peak_location(spark, folder):
    """Where each frame's largest cell lies, the first of equals."""
    g = grid(spark, folder).groupBy("frame").agg(F.max("value").alias("most"), F.max_by(F.struct("row", "col"), F.struct("value", -F.col("row"), -F.col("col"))).alias("at"))
    return g.select("frame", "most", F.col("at.row").alias("at_row"), F.col("at.col").alias("at_col"))
