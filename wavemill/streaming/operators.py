"""Streaming operators: windows, sessions, deduplication, and batches by count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(stream: DataFrame, time: str, late: str, length: str, keys: list[str], value: str) -> DataFrame:
    """Count, sum and maximum per window and key: ``window_start, keys, n, total, most``."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most")).select(F.col("w.start").alias("window_start"), *keys, "n", "total", "most")


def sliding(stream: DataFrame, time: str, late: str, length: str, slide: str, keys: list[str], value: str) -> DataFrame:
    """Least value over sliding windows: ``window_start, keys, least``."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, length, slide).alias("w"), *keys)
    return w.agg(F.min(value).alias("least")).select(F.col("w.start").alias("window_start"), *keys, "least")


def sessions(stream: DataFrame, time: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    """Bursts of a key, ended by a gap: a batch that is flushed when nothing more comes. ``session_start, session_end, keys, n``."""
    w = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys)
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def first_arrivals(stream: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """Each key once, repeats within the watermark dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def _in_time_order(stream: DataFrame, keys: list[str], row: str, time: str, value: str, late: str, schema: str, own: str, start: tuple, step: Callable[[tuple, np.ndarray, np.ndarray, np.ndarray, tuple, int], tuple[list[tuple], tuple, int | None]]) -> DataFrame:
    """Keyed state fed in order of time (milliseconds, ties by ``row``), however rows are spread over files and micro-batches.

    Rows wait in the state until the watermark has passed them, which bounds
    what waits by ``late``; those that come later still are dropped, as by any
    watermark. ``step`` gets the key, the times, rows and values that are due,
    the own state (columns ``own``, first ``start``) and the watermark, and gives
    rows of ``schema``, the new state, and a time at which to be called again
    though nothing comes (None: never).
    """
    fields = [f.split(" ")[0] for f in schema.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ms, rows, values, *mine = state.get if state.exists else ([], [], [], *start)
        waiting = [(np.asarray(ms, np.int64), np.asarray(rows, np.int64), np.asarray(values, float))]
        if not state.hasTimedOut:
            waiting += [(p["_ms"].to_numpy(np.int64), p["_row"].to_numpy(np.int64), p["_v"].to_numpy(float)) for p in parts]
        at, rows, values = (np.concatenate(x) for x in zip(*waiting, strict=True))
        mark = state.getCurrentWatermarkMs()
        due = at <= mark
        order = np.lexsort((rows[due], at[due]))
        out, mine, wake = step(key, at[due][order], rows[due][order], values[due][order], tuple(mine), mark)
        at, rows, values = at[~due], rows[~due], values[~due]
        calls = [int(at.min())] if len(at) else []
        calls += [wake] if wake is not None else []
        state.update((at.tolist(), rows.tolist(), values.tolist(), *mine))
        if calls:
            state.setTimeoutTimestamp(max(mark + 1, min(calls)))
        yield pd.DataFrame(out, columns=fields)

    s = stream.where(F.col(time).isNotNull() & F.col(value).isNotNull()).withWatermark(time, late)
    s = s.select(*keys, time, F.unix_millis(F.col(time).cast("timestamp")).alias("_ms"), F.col(row).cast("long").alias("_row"), F.col(value).cast("double").alias("_v"))
    return s.groupBy(*keys).applyInPandasWithState(run, schema, f"ms array<long>, rows array<long>, vals array<double>, {own}", "append", GroupStateTimeout.EventTimeTimeout)


def _kinds(stream: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in columns)


def count_batches(stream: DataFrame, channel: list[str], row: str, time: str, late: str, value: str, size: int, idle_ms: int) -> DataFrame:
    """Batches of ``size`` rows per channel in order of time: ``channel, batch_no, n, total, partial``.

    A batch that has waited longer than ``idle_ms`` for its next row is given out
    as it is, partial: when that row comes, or when the watermark shows that none
    came. A busy channel is spread by giving it several keys. Rows without a time
    or a value are left out.
    """

    def step(key: tuple, at: np.ndarray, rows: np.ndarray, values: np.ndarray, own: tuple, mark: int) -> tuple[list[tuple], tuple, int | None]:
        number, n, total, last = own
        out = []

        def give(partial: bool) -> None:
            nonlocal number, n, total
            out.append((*key, number, n, total, partial))
            number, n, total = number + 1, 0, 0.0

        breaks = np.flatnonzero(np.diff(at) > idle_ms) + 1
        for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(at)], strict=True):
            if a == b:
                continue
            if n and at[a] - last > idle_ms:
                give(True)
            while a < b:
                more = min(size - n, b - a)
                n, total, a = n + more, total + float(values[a : a + more].sum()), a + more
                if n == size:
                    give(False)
            last = int(at[b - 1])
        if n and mark > last + idle_ms:
            give(True)
        return out, (number, n, total, last), last + idle_ms + 1 if n else None

    schema = f"{_kinds(stream, channel)}, batch_no long, n long, total double, partial boolean"
    return _in_time_order(stream, channel, row, time, value, late, schema, "number long, n long, total double, last long", (0, 0, 0.0, 0), step)


def dead_zone(stream: DataFrame, key: str, row: str, time: str, late: str, value: str, zone: float) -> DataFrame:
    """``key, row, kept``: the last value that was more than ``zone`` away from the one kept before, in order of time. State per key: the kept value."""

    def step(k: tuple, at: np.ndarray, rows: np.ndarray, values: np.ndarray, own: tuple, mark: int) -> tuple[list[tuple], tuple, int | None]:
        (kept,) = own
        out = []
        for r, v in zip(rows.tolist(), values.tolist(), strict=True):
            if kept is None or abs(v - kept) > zone:
                kept = v
            out.append((k[0], r, kept))
        return out, (kept,), None

    return _in_time_order(stream, [key], row, time, value, late, f"{_kinds(stream, [key])}, {row} long, kept double", "kept double", (None,), step)


def reset_epochs(stream: DataFrame, key: str, row: str, time: str, late: str, value: str, floor: float) -> DataFrame:
    """``key, row, epoch, best``: a reading below ``floor`` means the sender has degraded and begins anew: a new epoch, whose best reading so far starts from it."""

    def step(k: tuple, at: np.ndarray, rows: np.ndarray, values: np.ndarray, own: tuple, mark: int) -> tuple[list[tuple], tuple, int | None]:
        epoch, best = own
        out = []
        for r, v in zip(rows.tolist(), values.tolist(), strict=True):
            if v < floor:
                epoch, best = epoch + 1, v
            else:
                best = v if best is None else max(best, v)
            out.append((k[0], r, epoch, best))
        return out, (epoch, best), None

    return _in_time_order(stream, [key], row, time, value, late, f"{_kinds(stream, [key])}, {row} long, epoch long, best double", "epoch long, best double", (0, None), step)
