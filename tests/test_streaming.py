import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.streaming import operators as S
from wavemill.streaming.runner import file_stream, run_available


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """300 readings, one a minute but for a pause, in six files that overlap in time."""
    at = tmp_path_factory.mktemp("streamed")
    rng = np.random.default_rng(12)
    v = rng.integers(0, 30, 300).tolist()
    rows = [(i, "a" if i % 3 else "b", 10**9 + i * 60 + (20_000 if i >= 200 else 0), float(x)) for i, x in enumerate(v)]
    order = sorted(range(300), key=lambda i: i + rng.integers(0, 60))  # up to an hour late
    for f in range(6):
        part = [rows[i] for i in order[f * 50 : f * 50 + 50]]
        spark.createDataFrame(part, "id long, k string, s long, v double").select("id", "k", F.timestamp_seconds("s").alias("at"), "v").coalesce(1).write.mode("append").parquet(f"{at}/f.parquet")
    return str(at), rows


LATE_S = 3 * 3600


def due(rows):
    mark = max(r[2] for r in rows) - LATE_S
    return sorted((r for r in rows if r[2] <= mark), key=lambda r: (r[2], r[0]))


def test_dead_zone_in_time_order_over_many_files(spark, files):
    at, rows = files
    for step in (1, 8):
        got = {(r.k, r.id): r.kept for r in run_available(S.dead_zone(file_stream(spark, at, "f", step), "k", "id", "at", f"{LATE_S} seconds", "v", 5.0), "append").collect()}
        want, last = {}, {}
        for i, k, _, v in due(rows):
            if k not in last or abs(v - last[k]) > 5:
                last[k] = v
            want[(k, i)] = last[k]
        assert got == want


def test_batches_and_idle_flush(spark, files):
    at, rows = files
    for step in (1, 8):
        got = sorted((r.k, r.batch_no, r.n, r.total, r.partial) for r in run_available(S.count_batches(file_stream(spark, at, "f", step), ["k"], "id", "at", f"{LATE_S} seconds", "v", 7, 600_000), "append").collect())
        want = []
        for k in "ab":
            own = [r for r in due(rows) if r[1] == k]
            batches, now = [], []
            for r in own:
                if now and r[2] - now[-1][2] > 600:
                    batches.append(now)
                    now = []
                now.append(r)
                if len(now) == 7:
                    batches.append(now)
                    now = []
            if now and max(x[2] for x in rows) - LATE_S > now[-1][2] + 600:
                batches.append(now)
            want += [(k, i, len(b), sum(x[3] for x in b), len(b) < 7) for i, b in enumerate(batches)]
        assert got == sorted(want) and any(w[4] for w in want)


def test_state_leaves_behind_the_watermark(spark, files):
    at, rows = files
    seen: list = []
    got = run_available(S.tumbling(file_stream(spark, at, "f", 1), "at", "1 hour", "10 minutes", ["k"], "v"), "update", ["window_start", "k"], seen)
    assert got.count() > 40 and seen[-1].stateOperators[0].numRowsTotal < 20 < max(p.stateOperators[0].numRowsTotal for p in seen) + 20
