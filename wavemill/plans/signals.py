"""Spectral and radar queries over the lines of the grid (32 samples each), and binary packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.functions import scalar as S
from wavemill.operators import signal as X
from wavemill.plans.grids import _GRID, N, grid
from wavemill.plans.registry import Registry
from wavemill.sources import packets
from wavemill.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

#: Lines of the grid as complex samples: the value, and the column's parity times the row.
_IQ = f'{_GRID}, x AS (SELECT frame, "row", col, value AS re, CAST((col % 2) * "row" AS DOUBLE) AS im FROM g)'
_DFT = f'd AS (SELECT a.frame, a."row", k.k, sum(a.re * cos(2 * pi() * k.k * a.col / {N}) + a.im * sin(2 * pi() * k.k * a.col / {N})) AS re, sum(a.im * cos(2 * pi() * k.k * a.col / {N}) - a.re * sin(2 * pi() * k.k * a.col / {N})) AS im FROM x a CROSS JOIN range({N}) k(k) GROUP BY 1, 2, 3)'


def iq(spark, folder):
    return grid(spark, folder).select("frame", "row", "col", F.col("value").alias("re"), ((F.col("col") % 2) * F.col("row")).cast("double").alias("im"))


def lines(spark, folder):
    s = iq(spark, folder).groupBy("frame", "row").agg(F.sort_array(F.collect_list(F.struct("col", "re", "im"))).alias("s"))  # 32 samples a line
    return s.select("frame", "row", F.col("s.re").alias("re"), F.col("s.im").alias("im"))


def bins(spark, folder):
    s = X.spectrum(lines(spark, folder), ["frame", "row"], "re", "im")
    z = s.select("frame", "row", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
    return z.select("frame", "row", "bin", F.col("z.re").alias("re"), F.col("z.im").alias("im"))


@query(f'WITH {_IQ}, {_DFT} SELECT frame, "row", CAST((k + {N // 2}) % {N} AS INT) AS bin, round(re * re + im * im, 4) / {N * N} AS psd FROM d')
def high_rate_psd(spark, folder):
    """Power spectrum of each line, the zero frequency in the middle."""
    return bins(spark, folder).select("frame", "row", "bin", (F.round(S.abs2(F.col("re"), F.col("im")), 4) / (N * N)).alias("psd"))


@query(f'WITH {_IQ}, {_DFT} SELECT frame, CAST((k + {N // 2}) % {N} AS INT) AS bin, CAST(trunc(least(greatest(round(10 * log10(sum(re * re + im * im) / {N * N} / 16 + 1e-12), 6), -128), 127)) AS INT) AS level FROM d GROUP BY 1, 2')
def low_rate_psd(spark, folder):
    """Power summed over a frame's lines, over a set number of averages, as whole dB."""
    p = bins(spark, folder).groupBy("frame", "bin").agg(F.sum(S.abs2(F.col("re"), F.col("im")) / (N * N)).alias("p"))
    return p.select("frame", "bin", S.clamp(F.round(S.to_db(F.col("p") / 16), 6), -128.0, 127.0).cast("int").alias("level"))


_H = X.lowpass(9, 0.12)
_STEP = 4


@query(f"""WITH {_IQ}, h AS (SELECT unnest(range({len(_H)})) AS k, unnest([{', '.join(repr(t) for t in _H)}]) AS t), m AS (SELECT frame, "row", col, re * cos(-2 * pi() * 0.1 * col) - im * sin(-2 * pi() * 0.1 * col) AS re, re * sin(-2 * pi() * 0.1 * col) + im * cos(-2 * pi() * 0.1 * col) AS im FROM x)
SELECT frame, "row", CAST(o.m AS INT) AS m, round(sum(h.t * m.re), 6) AS re, round(sum(h.t * m.im), 6) AS im FROM range({N // _STEP}) o(m) CROSS JOIN h JOIN m ON m.col = o.m * {_STEP} - h.k + {len(_H) // 2} GROUP BY 1, 2, 3""")
def down_converted(spark, folder):
    """Each line mixed down, filtered and decimated by 4."""
    d = X.filter_decimate(iq(spark, folder), ["frame", "row"], "col", "re", "im", _H, 0.1, _STEP)
    return d.select("frame", "row", "m", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query(f'WITH {_GRID} SELECT frame, "row", col, coalesce(lag(value) OVER w, 0) - 2 * value + coalesce(lead(value) OVER w, 0) AS cancelled FROM g WINDOW w AS (PARTITION BY frame, col ORDER BY "row")')
def three_pulse_canceller(spark, folder):
    return X.pulse_canceller(grid(spark, folder), ["frame", "col"], "row", "value").select("frame", "row", "col", "cancelled")


@query(f"""WITH {_GRID}, e AS (SELECT frame, "row", col, value, value > 20 AS hot, coalesce(lag(value > 20) OVER w, FALSE) AS before, last_value(value > 20) OVER (PARTITION BY frame, "row" ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS stays FROM g WINDOW w AS (PARTITION BY frame, "row" ORDER BY col)),
r AS (SELECT *, sum(CASE WHEN hot AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY frame, "row" ORDER BY col ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT frame, "row", min(col)::BIGINT AS low_bin, max(col)::BIGINT + 1 AS high_bin, CAST(floor((min(col) + max(col) + 1) / 2) AS BIGINT) AS zero_bin, max(value) AS max_amplitude, sum(value) AS sum_power, round(avg(value), 6) AS average_amplitude FROM r WHERE hot AND NOT stays GROUP BY frame, "row", k""")
def pulse_descriptors(spark, folder):
    p = X.pulses(grid(spark, folder), ["frame", "row"], "col", "value", 20.0)
    return p.select("frame", "row", F.col("low_bin").cast("long").alias("low_bin"), F.col("high_bin").cast("long").alias("high_bin"), "zero_bin", "max_amplitude", "sum_power", F.round("average_amplitude", 6).alias("average_amplitude"))


@query(f'WITH {_IQ}, p AS (SELECT frame, "row", col, re, im, lag(re) OVER w AS pr, lag(im) OVER w AS pi FROM x WINDOW w AS (PARTITION BY frame, "row" ORDER BY col)) SELECT frame, "row", col, round(atan2(im * pr - re * pi, re * pr + im * pi), 6) AS phase FROM p WHERE pr IS NOT NULL')
def demodulated(spark, folder):
    p = X.phase_steps(iq(spark, folder), ["frame", "row"], "col", "re", "im").where("phase is not null")
    return p.select("frame", "row", "col", F.round("phase", 6).alias("phase"))


@query("""SELECT event_id, round(value * cos(radians(user_id % 31 - 15)) * sin(radians(user_id % 360)), 6) AS x, round(value * cos(radians(user_id % 31 - 15)) * cos(radians(user_id % 360)), 6) AS y, round(value * sin(radians(user_id % 31 - 15)), 6) AS z FROM events WHERE value IS NOT NULL""")
def point_cloud(spark, folder):
    """Ranges and angles as points."""
    x, y, z = X.cartesian(F.col("value"), F.col("user_id") % 360, F.col("user_id") % 31 - 15)
    return table(spark, folder, "events").where("value is not null").select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


@query(f'WITH {_GRID} SELECT frame, "row", col, CAST(CASE WHEN col % 4 = 3 THEN least(value, 255) ELSE floor(power(least(value, 255) / 255, 1 / 2.2) * 255 + 0.5) END AS INT) AS pixel FROM g')
def gamma_corrected(spark, folder):
    """Four components a pixel, the last one alpha, which stays."""
    return grid(spark, folder).select("frame", "row", "col", S.gamma(F.col("value"), 1 / 2.2, 255, F.col("col") % 4 == 3).alias("pixel"))


@query(f"""WITH {_GRID}, n AS (SELECT frame, "row", value, row_number() OVER (PARTITION BY frame, "row" ORDER BY value DESC, col) AS k FROM g WHERE col >= 8), p AS (SELECT frame, "row", avg(value) AS peak FROM n WHERE k <= 2 GROUP BY 1, 2), q AS (SELECT frame, "row", avg(value) AS noise FROM g WHERE col < 8 GROUP BY 1, 2)
SELECT frame, "row", round(10 * log10(peak + 1e-12) - 10 * log10(noise + 1e-12), 6) AS snr_db FROM p JOIN q USING (frame, "row")""")
def snr_per_line(spark, folder):
    """Mean of the strongest samples of a band over the mean before it, in dB."""
    from pyspark.sql import Window

    g = grid(spark, folder)
    w = Window.partitionBy("frame", "row").orderBy(F.desc("value"), "col")
    peak = g.where("col >= 8").withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("frame", "row").agg(F.avg("value").alias("peak"))
    noise = g.where("col < 8").groupBy("frame", "row").agg(F.avg("value").alias("noise"))
    return peak.join(noise, ["frame", "row"]).select("frame", "row", F.round(S.to_db(F.col("peak")) - S.to_db(F.col("noise")), 6).alias("snr_db"))


@query("""SELECT event_id, CAST(event_id % 65536 AS INT) AS packet_id, 2 AS n, round((CASE WHEN user_id % 65536 >= 32768 THEN user_id % 65536 - 65536 ELSE user_id % 65536 END) / 32767.0, 9) AS i0, round(-(CAST(round(coalesce(value, 0)) AS BIGINT) % 30000) / 32767.0, 9) AS q0 FROM events""")
def packet_samples(spark, folder):
    """Events packed into binary packets and unpacked again."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.coalesce("value", F.lit(0.0)).alias("v"))
    q = -(F.round("v").cast("long") % 30000)
    p = e.select("event_id", packets.encode(F.col("event_id") % 65536, F.array(F.col("user_id"), q, F.lit(1).cast("long"), F.lit(-1).cast("long"))).alias("payload"))
    d = packets.decode(p, "payload")
    return d.select("event_id", "packet_id", F.size("samples").alias("n"), F.round(F.col("samples")[0]["i"], 9).alias("i0"), F.round(F.col("samples")[0]["q"], 9).alias("q0"))
