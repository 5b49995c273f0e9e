import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.operators.dyadic import busy_and_gaps, dyadic_union
from wavemill.operators.occupancy import band_occupancy

INTERVALS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 63), st.integers(1, 64)).filter(lambda t: t[1] < t[2]), max_size=30)


@given(INTERVALS)
@settings(max_examples=150, deadline=None)
def test_union_is_the_set_of_covered_places(items):
    a = np.array(items, np.int64).reshape(-1, 3)
    g, lo, hi = dyadic_union(a[:, 0], a[:, 1], a[:, 2], 6)
    for k in range(3):
        covered = {x for e, s, t in items if e == k for x in range(s, t)}
        own = [(int(s), int(t)) for e, s, t in zip(g, lo, hi, strict=True) if e == k]
        assert {x for s, t in own for x in range(s, t)} == covered
        assert all(a[1] < b[0] for a, b in zip(sorted(own), sorted(own)[1:], strict=False))


def brute(rows):
    out = set()
    by = {}
    for k, s, t, n in rows:
        if None not in (k, s, t, n) and max(s, 0) < min(t, n):
            by.setdefault((k, n), set()).update(range(max(s, 0), min(t, n)))
    for (k, n), places in by.items():
        state, start = 0 in places, 0
        for x in range(1, n + 1):
            if x == n or (x in places) != state:
                out.add((k, "busy" if state else "gap", start, x))
                start, state = x, not state
    return out


def test_busy_and_gaps_with_small_cells(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(s), int(s + c), n) for k, n in (("a", 300), ("b", 64), ("c", 1000)) for s, c in zip(rng.integers(-20, n + 10, 25), rng.integers(0, n // 6, 25), strict=True)]
    rows += rows[:5] + [("d", 0, 50, 50), ("e", 49, 60, 50), ("f", 60, 70, 50), (None, 0, 5, 9), ("g", None, 4, 9), ("g", 1, None, 9), ("g", 1, 4, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, s long, t long, n long, _low string")
    for bits in (3, 5, 12):
        got = {tuple(r) for r in busy_and_gaps(df, ["k"], "s", "t", "n", bits).collect()}
        assert got == brute(rows)


def test_literal_case_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 10, 12)], "k string, s long, t long").selectExpr("*", "15L as n")
    got = sorted(tuple(r)[1:] for r in busy_and_gaps(df, ["k"], "s", "t", "n").collect())
    assert got == [("busy", 0, 8), ("busy", 10, 12), ("gap", 8, 10), ("gap", 12, 15)]
    assert busy_and_gaps(df.limit(0), ["k"], "s", "t", "n").count() == 0


ANN = "stem string, ann_idx int, sample_start long, sample_count long, freq_lower_hz double, freq_upper_hz double, band_id int, low string"


def test_band_occupancy_rules(spark):
    nan = float("nan")
    ann = [
        ("a", 0, 10, 5, 0.0, 10.0, 9, "x"), ("a", 0, 10, 5, 0.0, 10.0, 9, "x"),  # told twice
        ("a", 1, 15, 5, 10.0, 0.0, 9, "x"),  # touches; edges in the wrong order
        ("a", 2, 90, 0, 5.0, 6.0, 9, "x"),  # up to the end
        ("a", 3, 1, -1, 5.0, 6.0, 9, "x"), ("a", 4, None, 5, 5.0, 6.0, 9, "x"), ("a", 5, 1, 5, None, 6.0, 9, "x"), ("a", 6, 1, 5, nan, 6.0, 9, "x"),
        ("a", 7, -5, 7, 30.0, 31.0, 9, "x"), ("none", 8, 1, 5, 5.0, 6.0, 9, "x"), (None, 9, 1, 5, 5.0, 6.0, 9, "x"), ("a", 10, 100, 5, 5.0, 6.0, 9, "x"),
        ("a", 11, 95, 2**63 - 1, 5.0, 6.0, 9, "x"), ("a", 12, -(2**63), 5, 5.0, 6.0, 9, "x"),
    ]
    cap = spark.createDataFrame([("a", 100), ("a", 100), ("b", 50), (None, 7)], "stem string, n_samples long")
    bands = spark.createDataFrame([(1, 0.0, 20.0), (2, 20.0, 40.0), (3, 10.0, 12.0), (None, None, None)], "band_id int, band_lower_hz double, band_upper_hz double")
    got = sorted(tuple(r) for r in band_occupancy(spark.createDataFrame(ann, ANN), cap, bands).collect())
    assert got == [
        ("a", 1, "busy", 10, 20), ("a", 1, "busy", 90, 100), ("a", 1, "gap", 0, 10), ("a", 1, "gap", 20, 90),
        ("a", 2, "busy", 0, 2), ("a", 2, "gap", 2, 100),
    ]
    empty = spark.createDataFrame([], ANN)
    assert band_occupancy(empty, cap, bands).count() == 0


def test_many_bands_and_odd_ones(spark):
    """Over a thousand bands, among them one without width and one with its edges turned, against the rule itself."""
    rng = np.random.default_rng(1)
    ann = [(f"s{i % 3}", i, int(a), int(c), float(f), float(f + w), 0, "x") for i, (a, c, f, w) in enumerate(zip(rng.integers(0, 900, 30), rng.integers(1, 90, 30), rng.integers(-600, 600, 30), rng.integers(0, 300, 30), strict=True))]
    ann.append(("s0", 99, 5, 5, float("-inf"), float("inf"), 0, "x"))
    cap = spark.createDataFrame([(f"s{i}", 1000) for i in range(3)], "stem string, n_samples long")
    every = [(i, float(i - 500), float(i - 499.5)) for i in range(999)] + [(999, 7.0, 7.0), (1000, 9.0, 8.0), (1001, -2000.0, 2000.0)]
    for bands in (every, every[-4:], every[-3:-2]):
        got = band_occupancy(spark.createDataFrame(ann, ANN), cap, spark.createDataFrame(bands, "band_id int, band_lower_hz double, band_upper_hz double")).where("seg_kind = 'busy'").collect()
        want = {}
        for stem, _, start, count, low, high, _, _ in ann:
            for band, b_low, b_high in bands:
                if low < b_high and high > b_low:
                    want.setdefault((stem, band), set()).update(range(start, min(start + count, 1000)))
        have = {}
        for r in got:
            have.setdefault((r.stem, r.band_id), set()).update(range(r.seg_start, r.seg_stop))
        assert have == want
    assert band_occupancy(spark.createDataFrame(ann, ANN), cap, spark.createDataFrame([], "band_id int, band_lower_hz double, band_upper_hz double")).count() == 0


def test_very_long_intervals_are_a_few_pieces(spark):
    from wavemill.operators.dyadic import _tiers

    n = 10**12
    low, high = np.array([5, 0, 1 << 20, 7]), np.array([n, n, 3 << 20, 8])
    pieces = _tiers(low, high, 20)
    assert sum(len(p[0]) for p in pieces) <= 4 * 2 * 4
    covered = np.zeros(4, np.int64)
    for row, tier, a, b in pieces:
        np.add.at(covered, row, (b - a) << (0 if tier == 0 else 20 + 10 * (tier - 1)))
    assert covered.tolist() == (high - low).tolist()
    rows = [("a", 3, n, n), ("a", 10, 20, n), ("a", 1 << 33, (1 << 33) + 5, n), ("b", 5 << 20, 900 << 20, n), ("b", (4 << 20) + 9, (5 << 20) - 1, n), ("b", (899 << 20) + 3, (1 << 35) + 7, n), ("b", (1 << 36) + 3, (1 << 36) + 9, n), ("c", 1, 2, n), ("c", n - 1, n, n), ("c", 0, 1 << 62, n)]
    df = spark.createDataFrame(rows * 50, "k string, s long, t long, n long")
    got = sorted(tuple(r) for r in busy_and_gaps(df, ["k"], "s", "t", "n").collect())
    assert got == [
        ("a", "busy", 3, n), ("a", "gap", 0, 3),
        ("b", "busy", (4 << 20) + 9, (5 << 20) - 1), ("b", "busy", 5 << 20, (1 << 35) + 7), ("b", "busy", (1 << 36) + 3, (1 << 36) + 9),
        ("b", "gap", 0, (4 << 20) + 9), ("b", "gap", (5 << 20) - 1, 5 << 20), ("b", "gap", (1 << 35) + 7, (1 << 36) + 3), ("b", "gap", (1 << 36) + 9, n),
        ("c", "busy", 0, n),
    ]
