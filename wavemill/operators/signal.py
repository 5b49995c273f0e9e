"""Spectral and radar arithmetic.

Signals are arrays of samples, one row per line of a frame, for transforms
(NumPy over Arrow batches, a batch of lines at once), or in long form for what
windows and joins can say. Complex values are two columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_line(df: DataFrame, keys: list[str], re: str, im: str | None, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``f`` of each row's complex samples: ``keys, re, im`` (arrays). Lines of one length are given to ``f`` together, a row each.

    Null or empty arrays, and those with null samples, are left out.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    source = df.select(*keys, F.col(re).cast("array<double>").alias("_re"), (F.col(im).cast("array<double>") if im else F.transform(F.col(re), lambda _: F.lit(0.0))).alias("_im"))
    source = source.where((F.size("_re") > 0) & (F.size("_re") == F.size("_im")) & ~F.exists("_re", lambda x: x.isNull()) & ~F.exists("_im", lambda x: x.isNull()))
    schema = T.StructType([*(source.schema[k] for k in keys), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("re", "im"))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.num_columns - 2
            a, c = b.column(k), b.column(k + 1)
            n = np.diff(a.offsets.to_numpy())
            for size in np.unique(n):
                rows = pa.array(np.flatnonzero(n == size))
                y = f(a.take(rows).flatten().to_numpy().reshape(-1, size) + 1j * c.take(rows).flatten().to_numpy().reshape(-1, size))
                at = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                out = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(p).ravel())) for p in (y.real, y.imag)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(k)), *out], schema=arrow)

    return source.mapInArrow(run, schema)


def spectrum(df: DataFrame, keys: list[str], re: str, im: str | None = None, shift: bool = True) -> DataFrame:
    """Forward transform of each line: ``keys, re, im``, the zero frequency in the middle. Odd lengths can't be shifted."""

    def transform(x: np.ndarray) -> np.ndarray:
        if shift and x.shape[1] % 2 and x.shape[1] > 1:
            raise ValueError("a line of odd length has no middle to shift to")
        y = np.fft.fft(x, axis=1)
        return np.fft.fftshift(y, axes=1) if shift else y

    return per_line(df, keys, re, im, transform)


def pulse_compression(df: DataFrame, keys: list[str], re: str, im: str, waveform: list[complex]) -> DataFrame:
    """Matched filter: each line correlated (circularly) with the waveform under a Hamming window, scaled to unit energy."""
    w = np.array(waveform) * np.hamming(len(waveform))
    w = w / np.linalg.norm(w)

    def compress(x: np.ndarray) -> np.ndarray:
        if x.shape[1] < len(w):
            raise ValueError("a line is shorter than the waveform")
        return np.fft.ifft(np.fft.fft(x, axis=1) * np.conj(np.fft.fft(w, x.shape[1])), axis=1)

    return per_line(df, keys, re, im, compress)


def doppler(df: DataFrame, keys: list[str], re: str, im: str) -> DataFrame:
    """Hamming window and transform over the pulses in each row's arrays."""
    return per_line(df, keys, re, im, lambda x: np.fft.fft(x * np.hamming(x.shape[1]), axis=1))


def polyphase(df: DataFrame, keys: list[str], at: str, value: str, taps: list[float], up: int, down: int) -> DataFrame:
    """Resampled by ``up / down``, zero beyond the ends: ``keys, m, value``. The taps work at the higher rate; they are scaled by ``up``.

    Sample n has a part in outputs m with ``|m * down - n * up|`` within half the
    taps, so an aggregation by output adds them up, in part before the shuffle.
    """
    half = len(taps) // 2
    place = F.col(at) * up
    low, high = F.ceil(F.greatest(place - half, F.lit(0)) / down), F.floor((place + half) / down)
    sent = df.select(*keys, at, value, F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))).alias("m"))
    tap = F.element_at(F.array(*[F.lit(t * up) for t in taps]), (F.col("m") * down - F.col(at) * up + half + 1).cast("int"))
    out = sent.groupBy(*keys, "m").agg(F.sum(tap * F.col(value)).alias("value"))
    last = df.groupBy(*keys).agg(F.max(at).alias("_last"))
    return out.join(last, keys).where(F.col("m") * down <= F.col("_last") * up).drop("_last")


def lowpass(taps: int, cutoff: float) -> list[float]:
    """Taps of a Hamming-windowed sinc of unit gain; an even count gets one more, the cutoff (per sample) is kept within 1e-4 and 0.4999."""
    n = max(1, taps) | 1
    fc = min(max(cutoff, 1e-4), 0.4999)
    mid = n // 2
    h = [(2 * fc if i == mid else math.sin(2 * math.pi * fc * (i - mid)) / (math.pi * (i - mid))) * (0.54 - 0.46 * math.cos(2 * math.pi * i / max(1, n - 1))) for i in range(n)]
    return [x / sum(h) for x in h]


def filter_decimate(df: DataFrame, keys: list[str], at: str, re: str, im: str, taps: list[float], shift: float | Column, step: int) -> DataFrame:
    """Mix by ``-shift`` cycles a sample, filter with zero edges, keep every ``step``-th sample: ``keys, m, re, im``.

    Each sample is sent to the outputs it has a part in; one aggregation by
    output adds them up, in part before the shuffle.
    """
    half = len(taps) // 2
    angle = F.lit(-2 * math.pi) * (F.lit(shift) if isinstance(shift, float) else shift) * F.col(at)
    mixed = df.withColumns({"_r": F.col(re) * F.cos(angle) - F.col(im) * F.sin(angle), "_q": F.col(re) * F.sin(angle) + F.col(im) * F.cos(angle)})
    last = df.groupBy(*keys).agg(F.max(at).alias("_last"))
    reach = F.sequence(F.ceil(F.greatest(F.col(at) - half, F.lit(0)) / step).cast("int"), F.floor((F.col(at) + half) / step).cast("int"))
    low, high = F.ceil(F.greatest(F.col(at) - half, F.lit(0)) / step), F.floor((F.col(at) + half) / step)
    sent = mixed.select(*keys, at, "_r", "_q", F.explode(F.when(low <= high, reach)).alias("m"))
    h = F.array(*[F.lit(t) for t in taps])
    tap = F.element_at(h, (F.col("m") * step - F.col(at) + half + 1).cast("int"))
    out = sent.groupBy(*keys, "m").agg(F.sum(tap * F.col("_r")).alias("re"), F.sum(tap * F.col("_q")).alias("im"))
    return out.join(last, keys).where(F.col("m") * step <= F.col("_last")).drop("_last")


def time_slices(samples: DataFrame, slices: DataFrame, keys: list[str], at: str, start: str, stop: str, width: int = 4096) -> DataFrame:
    """The samples of each slice ``[start, stop)``, cut to where there are samples: all columns of both, and ``offset`` from the slice's first sample."""
    from wavemill.operators.intervals import overlap_join

    cut = slices.withColumn(start, F.greatest(F.col(start), F.lit(0).cast("long")))
    one = samples.withColumn("_after", F.col(at) + 1)
    return overlap_join(cut, one, (start, stop), (at, "_after"), width, keys).drop("_after").withColumn("offset", F.col(at) - F.col(start))


def pulse_canceller(df: DataFrame, keys: list[str], pulse: str, value: str) -> DataFrame:
    """Three-pulse canceller over neighbouring pulses, taps 1, -2, 1, zero beyond the ends: ``cancelled``."""
    w = Window.partitionBy(*keys).orderBy(pulse)
    z = F.lit(0.0)
    return df.withColumn("cancelled", F.coalesce(F.lag(value).over(w), z) - 2 * F.col(value) + F.coalesce(F.lead(value).over(w), z))


def pulses(df: DataFrame, keys: list[str], at: str, value: str, threshold: float) -> DataFrame:
    """Islands of ``value > threshold`` in each line: ``keys, low_bin, high_bin, zero_bin, max_amplitude, sum_power, average_amplitude``.

    A pulse that reaches the end of its line has no falling edge; its whole line
    then gives nothing, as edges can't be paired.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    marked = df.withColumn("_on", F.coalesce(F.col(value) > threshold, F.lit(False))).withColumn("_open", F.last("_on").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rise = F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), 1).otherwise(0)
    runs = marked.withColumn("_rise", rise).withColumn("_run", F.sum("_rise").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on and not _open")
    out = runs.groupBy(*keys, "_run").agg(F.min(at).alias("low_bin"), (F.max(at) + 1).alias("high_bin"), F.max(value).alias("max_amplitude"), F.sum(value).alias("sum_power"), F.avg(value).alias("average_amplitude"))
    return out.withColumn("zero_bin", F.floor((F.col("low_bin") + F.col("high_bin")) / 2)).drop("_run")


def phase_steps(df: DataFrame, keys: list[str], at: str, re: str, im: str) -> DataFrame:
    """Frequency demodulation: the angle of each sample times the conjugate of the one before, null for the first: ``phase``."""
    w = Window.partitionBy(*keys).orderBy(at)
    pr, pi = F.lag(re).over(w), F.lag(im).over(w)
    return df.withColumn("phase", F.atan2(F.col(im) * pr - F.col(re) * pi, F.col(re) * pr + F.col(im) * pi))


def back_project(pulses: DataFrame, keys: list[str], pulse: str, re: str, im: str, pixels: list[tuple[float, float]], spacing: float, bins_per_unit: float, wavelength: float) -> DataFrame:
    """Image formation: ``keys, pixel, re, im``, for each pixel the sum over all pulses of the echo at its range, turned back by its phase.

    Pulse p is sent from ``(p * spacing, 0)``; its samples are echoes by range,
    ``bins_per_unit`` of them a unit, read between two neighbours; ranges beyond
    give nothing. Pixels are a parameter, laid out beside each pulse; sums are
    formed in part before the shuffle.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pixel"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, (x, y) in enumerate(pixels)])).alias("p")
    far = F.hypot(F.col("p.x") - F.col(pulse) * spacing, F.col("p.y"))
    rows = pulses.select(*keys, re, im, pulse, each).select(*keys, re, im, F.col("p.pixel").alias("pixel"), far.alias("_r"), (far * bins_per_unit).alias("_b"))
    low = F.floor("_b").cast("int")
    part = F.col("_b") - low
    at = lambda c: F.get(c, low) * (1 - part) + F.get(c, low + 1) * part
    turn = F.lit(4 * math.pi / wavelength) * F.col("_r")
    rows = rows.where(low + 1 < F.size(re)).select(*keys, "pixel", at(re).alias("_re"), at(im).alias("_im"), turn.alias("_t"))
    return rows.groupBy(*keys, "pixel").agg(F.sum(F.col("_re") * F.cos("_t") - F.col("_im") * F.sin("_t")).alias("re"), F.sum(F.col("_re") * F.sin("_t") + F.col("_im") * F.cos("_t")).alias("im"))


def cartesian(distance: Column, azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """Range and angles in degrees as x, y, z."""
    a, e = F.radians(azimuth), F.radians(elevation)
    return distance * F.cos(e) * F.sin(a), distance * F.cos(e) * F.cos(a), distance * F.sin(e)


def _reference(means: DataFrame, share: float) -> DataFrame:
    """``frame, ref``: as far above the mean of a frame's smoothed row means, towards the highest, as told."""
    return means.groupBy("frame").agg((F.avg("s") + share * (F.max("s") - F.avg("s"))).alias("ref"))


def coherent_detector(
    grid: DataFrame, rows: int, cols: int, sigma: float = 12.0, reference: float = 0.75, max_boost: float = 12.0, cap_db: float | None = None, background: tuple[int, int] = (4, 3), floor_db: float = 1.5, span_db: float = 8.0, score: float = 0.58,
    floors: DataFrame | None = None, fill_db: float = 3.0, strong_db: float | None = None, strong_cols: int = 2, opened: tuple[int, int] = (3, 7), closed: tuple[int, int] = (5, 21), persistence: tuple[int, int] | None = None,
) -> DataFrame:
    """Power above its surroundings, per frame of ``frame, row (frequency), col (time), value (power)``: ``score`` and ``hit``.

    In dB; rows weaker than the frame's reference are raised by up to
    ``max_boost``; the reference lies between the mean and the highest of the
    smoothed row means, which with ``cap_db`` are taken again with all power cut
    off that far above the first reference. A centred box mean is the
    background; the excess over it, less ``floor_db`` and over ``span_db``, is the
    score. Cells more than ``fill_db`` above their row's floor (``floors``: ``row``,
    perhaps ``frame``, and ``floor``) are added. The mask is smoothed by a majority
    of nine, opened, closed, and kept where ``persistence`` (radius, least) finds
    enough set rows around. Cells ``strong_db`` above their row's mean background
    come back at the end, if ``strong_cols`` of them are near each other in time.
    """
    from wavemill.operators import grids as G

    g = grid.withColumn("db", F.log10(F.col("value") + 1e-12) * 10)
    share = min(max((reference - 0.5) / 0.5, 0.0), 1.0)
    smooth = lambda m: G.gaussian_smooth(m.withColumn("col", F.lit(0)), "row", sigma, rows, "m", "s")
    means = smooth(g.groupBy("frame", "row").agg(F.avg("db").alias("m")))
    ref = _reference(means, share)
    if cap_db is not None:
        capped = g.join(ref, "frame").groupBy("frame", "row").agg(F.avg(F.least("db", F.col("ref") + cap_db)).alias("m"))
        means = smooth(capped)
        ref = _reference(means, share)
    boost = means.join(ref, "frame").select("frame", "row", F.least(F.greatest(F.col("ref") - F.col("s"), F.lit(0.0)), F.lit(max_boost)).alias("boost"))
    g = g.join(boost, ["frame", "row"]).withColumn("x", F.col("db") + F.col("boost"))
    b = G.box_mean(G.box_mean(g, "col", background[0], "x", "bg"), "row", background[1], "bg", "bg")
    b = b.withColumn("score", F.least(F.greatest((F.col("x") - F.col("bg") - floor_db) / span_db, F.lit(0.0)), F.lit(1.0)))
    b = b.withColumn("set", F.col("score") >= score)
    if floors is not None:
        b = b.join(floors, [c for c in ("frame", "row") if c in floors.columns], "left")
        full = F.coalesce(F.col("x") > F.col("floor") + fill_db, F.lit(False))
        grade = F.least(F.greatest((F.col("x") - F.col("floor")) / span_db, F.lit(0.0)), F.lit(1.0))
        b = b.withColumns({"score": F.when(full, F.greatest("score", grade)).otherwise(F.col("score")), "set": F.col("set") | full})
    if strong_db is not None:
        own = F.avg("bg").over(Window.partitionBy("frame", "row"))
        b = b.withColumn("strong", F.col("x") >= own + strong_db)
        b = G.persistent(b, "col", strong_cols - 1, strong_cols, cols, "strong", "strong") if strong_cols > 1 else b
    else:
        b = b.withColumn("strong", F.lit(False))
    m = G.majority3(b, rows, cols, "set", "set").withColumn("hit", F.col("set").cast("int"))
    m = G.morphology(m, [*G.opening(*opened), *G.closing(*closed)], "hit").withColumn("hit", F.col("hit") == 1)
    if persistence is not None:
        m = G.persistent(m, "row", *persistence, rows, "hit", "hit")
    return m.select("frame", "row", "col", "score", (F.col("hit") | F.col("strong")).alias("hit"))
