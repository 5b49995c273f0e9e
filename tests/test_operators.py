import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import scalar as S
from wavemill.operators import boxes as B
from wavemill.operators import grids as G
from wavemill.operators import intervals as I
from wavemill.operators import metrics as M
from wavemill.operators import ordered, rules, sampling
from wavemill.operators import signal as X
from wavemill.operators.vectors import nearest
from wavemill.sources import packets, traces


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, S.half_even(F.lit(2.5))) == 2 and one(spark, S.half_away(F.lit(1.5))) == 2
    assert one(spark, S.semver(F.lit("v1.2"))) == "1.2.0" and one(spark, S.semver(F.lit("x"))) is None
    assert one(spark, S.doubles(F.lit("1, 2.5"))) == [1.0, 2.5] and one(spark, S.doubles(F.lit("1,x"))) is None
    assert one(spark, S.attenuation_of(F.lit("a_attenuation_dB_15_v2"))) == 15 and one(spark, S.attenuation_of(F.lit("a"))) is None
    assert one(spark, S.saturating_add(F.lit(5), F.lit(9), 10)) == 10
    assert one(spark, S.quantise(F.lit(0.5), True)) == 128 and one(spark, S.quantise(F.lit(0.5), False)) == 127
    assert one(spark, S.fft_size(F.lit(100e6), 20e6, 1024)) == 4096
    assert one(spark, S.short_path(F.lit("replayer, visualizer"))) == "rep-vis"


def test_fingerprints_and_paths_that_look_alike(spark):
    assert [one(spark, S.fnv1a(F.lit(x))) for x in (b"", b"a", b"foobar", None)] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", None]
    assert one(spark, S.fnv1a(F.lit(b"foobar" * 9), 6)) == "85944171f73967e8"
    with pytest.raises(Exception, match="begin alike"):
        one(spark, S.short_path(F.lit("replayer, reporter")))
    assert one(spark, S.pcm16(F.lit(-1.5))) == -32767


def test_channels_and_previews(spark):
    df = spark.createDataFrame([(i, i % 2, i % 5 == 0) for i in range(20)], "t int, ch int, part boolean")
    assert sampling.channel(df, "ch", -1).count() == 20 and sampling.channel(df, "ch", 1, "part").count() == 8
    assert sorted(r.t for r in sampling.every_nth(df, ["ch"], ["t"], 3, 2).collect()) == [4, 5, 10, 11]


def test_radar_and_resampling_against_numpy(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(size=(3, 16)) + 1j * rng.normal(size=(3, 16))
    df = spark.createDataFrame([(i, [float(v) for v in z[i].real], [float(v) for v in z[i].imag]) for i in range(3)], "i int, re array<double>, im array<double>")
    chirp = [1, 1j, -1, 0.5]
    w = np.array(chirp) * np.hamming(4)
    w /= np.linalg.norm(w)
    for r in X.pulse_compression(df, ["i"], "re", "im", chirp).collect():
        assert np.allclose(np.array(r.re) + 1j * np.array(r.im), [sum(z[r.i][(m + k) % 16] * np.conj(w[k]) for k in range(4)) for m in range(16)])
    for r in X.doppler(df, ["i"], "re", "im").collect():
        assert np.allclose(np.array(r.re) + 1j * np.array(r.im), np.fft.fft(z[r.i] * np.hamming(16)))
    long = df.select("i", F.posexplode("re").alias("t", "v"))
    h = X.lowpass(13, 0.15)
    got = {(r.i, r.m): r.value for r in X.polyphase(long, ["i"], "t", "v", h, 2, 3).collect()}
    for i in range(3):
        up = np.zeros(31)
        up[::2] = z[i].real
        y = np.convolve(up, np.array(h) * 2, "same")[::3]
        assert np.allclose([got[(i, m)] for m in range(len(y))], y)


def test_slices_are_cut_to_the_samples(spark):
    samples = spark.range(10).selectExpr("'f' as f", "id as t", "cast(id as double) as x")
    slices = spark.createDataFrame([("f", -3, 2, 0), ("f", 8, 40, 1), ("f", 4, 4, 2), ("g", 0, 5, 3)], "f string, a long, b long, n int")
    got = sorted((r.n, r.t, r.offset) for r in X.time_slices(samples, slices, ["f"], "t", "a", "b", 4).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (1, 8, 0), (1, 9, 1)]


def test_small_components_and_their_map(spark):
    cells = [(0, 0), (0, 1), (2, 2), (4, 0), (4, 1), (5, 1)]
    m = spark.createDataFrame([(0, r, c) for r, c in cells], "frame long, row int, col int")
    assert sorted((r.row0, r.pixel_count, r.component) for r in G.label_components(m, 2).collect()) == [(0, 2, 1), (4, 3, 2)]
    assert sorted((r.row, r.col, r.component) for r in G.label_map(m).collect()) == [(0, 0, 1), (0, 1, 1), (2, 2, 2), (4, 0, 3), (4, 1, 3), (5, 1, 3)]
    assert sorted((r.row, r.component) for r in G.label_map(m, (1, 5)).collect()) == [(2, 1), (4, 2), (4, 2)]


def test_stride_keeps_multiples_and_checks(spark):
    df = spark.range(10).selectExpr("'c' as ch", "id as t")
    assert sorted(r.t for r in sampling.stride(df, ["ch"], ["t"], 3).collect()) == [2, 5, 8]
    with pytest.raises(ValueError):
        sampling.stride(df, ["ch"], ["t"], 0)
    assert sampling.stride(df.limit(0), ["ch"], ["t"], 3).count() == 0


def test_ordered_operations_across_chunks(spark):
    df = spark.range(50).selectExpr("case when id % 7 = 0 then null else 'k' end as k", "id as t", "(id * 37) % 11 as v", "case when id % 5 = 0 then id end as c")
    rows = [tuple(r) for r in df.orderBy("t").collect()]
    for key in (None, "k"):
        own = [r for r in rows if r[0] == key]
        same = F.col("k").eqNullSafe(F.lit(key))
        no = ordered.numbered(df, ["k"], ["t"], 6).where(same).orderBy("t").collect()
        assert [(r.t, r.row_no, r.n_rows) for r in no] == [(r[1], i + 1, len(own)) for i, r in enumerate(own)]
        run = ordered.running(df, ["k"], ["t"], "s", F.col("v"), "sum", 6).where(same).orderBy("t").collect()
        assert [r.s for r in run] == list(np.cumsum([r[2] for r in own]))
        most = ordered.running(df, ["k"], ["t"], "s", F.col("v"), "max", 6).where(same).orderBy("t").collect()
        assert [r.s for r in most] == list(np.maximum.accumulate([r[2] for r in own]))
        prev = ordered.previous(df, ["k"], ["t"], {"v": "p"}, 6).where(same).orderBy("t").collect()
        assert [r.p for r in prev] == [None, *[r[2] for r in own[:-1]]]
        known = ordered.last_known(df, ["k"], ["t"], "c", "known", 6).where(same).orderBy("t").collect()
        last, want = None, []
        for r in own:
            last = r[3] if r[3] is not None else last
            want.append(last)
        assert [r.known for r in known] == want


def test_intervals(spark):
    a = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 10, 12), ("a", None, 3), ("a", 4, 4)], "k string, s long, e long")
    m = I.merge_touching(a, ["k"], "s", "e")
    assert sorted((r.s, r.e, r.members) for r in m.collect()) == [(0, 8, 2), (10, 12, 1)]
    gaps = I.complement(m, ["k"], "s", "e", F.lit(0), F.lit(15)).collect()
    assert sorted((r.gap_start, r.gap_stop) for r in gaps) == [(8, 10), (12, 15)]
    b = spark.createDataFrame([("a", 4, 11), ("b", 0, 99)], "k string, u long, v long")
    j = I.overlap_join(a, b, ("s", "e"), ("u", "v"), 3, ["k"]).collect()
    assert sorted((r.s, r.e) for r in j) == [(0, 5), (5, 8), (10, 12)]


def test_trace_lines(spark):
    lines = spark.createDataFrame([("(a,100,200) -> (b,250,1500)",), ("noise",), ("(a,x,2)",)], "value string")
    t = traces.path_latency(traces.parse_traces(lines)).collect()
    assert sorted((r.path, r.latency_ms) for r in t if r.latency_ms) == [("a -> b", 1.4)]
    ops = {(r.op, r.next_op): r.mean_us for r in traces.operator_latency(traces.parse_traces(lines.limit(1))).collect()}
    assert ops == {("a", None): 100.0, ("b", None): 1250.0, ("a", "b"): 50.0}
    df = spark.createDataFrame([("p", i, s) for i, s in enumerate([0, 15, 25, 44, 46])], "path string, line long, stamp long")
    kept = traces.drop_repeats(df, ["path"], ["line"], "stamp", 20)
    assert sorted(r.stamp for r in kept.collect()) == [0, 25, 46]


def grid(spark, cells):
    return spark.createDataFrame([(0, r, c, float(v)) for (r, c), v in cells.items()], "frame long, row int, col int, value double")


def test_erode_then_dilate_removes_a_dot_and_components_need_sides(spark):
    g = grid(spark, {(r, c): (r, c) == (2, 2) for r in range(5) for c in range(5)})
    assert G.morphology(g, G.opening(3, 3)).agg(F.max("value")).first()[0] == 0
    cells = [(0, 0), (1, 0), (1, 1), (2, 2), (4, 4), (4, 3), (3, 4)]
    m = spark.createDataFrame([(0, r, c) for r, c in cells], "frame long, row int, col int")
    got = sorted((r.row0, r.row1, r.col0, r.col1, r.pixel_count) for r in G.label_components(m).collect())
    assert got == [(0, 1, 0, 1, 3), (2, 2, 2, 2, 1), (3, 4, 3, 4, 3)]


def test_pixelate_darkens_padded_edges(spark):
    g = grid(spark, {(r, c): 100 for r in range(5) for c in range(5)})
    p = {(r.row, r.col): r.pixel for r in G.pixelate(g, 4).collect()}
    assert p[(0, 0)] == 100 and p[(0, 4)] == 25 and p[(4, 4)] == 6


def test_suppression_is_greedy(spark):
    rng = np.random.default_rng(3)
    boxes = [(f, i, int(rng.integers(0, 9)), *(lambda r, c: (r, r + int(rng.integers(2, 12)), c, c + int(rng.integers(2, 12))))(*map(int, rng.integers(0, 25, 2)))) for f in range(3) for i in range(25)]
    df = spark.createDataFrame(boxes, "f long, b long, score long, row0 int, row1 int, col0 int, col1 int")
    got = {tuple(r)[:2] for r in B.suppress(df, ["f"], "b", "score", 0.2, 8).collect()}

    def iou(p, q):
        h, w = min(p[4], q[4]) - max(p[3], q[3]) + 1, min(p[6], q[6]) - max(p[5], q[5]) + 1
        inter = max(h, 0) * max(w, 0)
        size = lambda z: (z[4] - z[3] + 1) * (z[6] - z[5] + 1)
        return inter / (size(p) + size(q) - inter)

    want = set()
    for f in range(3):
        kept = []
        for b in sorted((x for x in boxes if x[0] == f), key=lambda x: (-x[2], x[1])):
            if all(iou(b, k) < 0.2 for k in kept):
                kept.append(b)
        want |= {(f, b[1]) for b in kept}
    assert got == want


def test_merging_reaches_a_fixed_point(spark):
    rng = np.random.default_rng(9)
    boxes = [(f, *(lambda r, c: (r, r + int(rng.integers(0, 3)), c, c + int(rng.integers(0, 3))))(*map(int, rng.integers(0, 40, 2)))) for f in range(3) for _ in range(20)]
    df = spark.createDataFrame([(*b, 1) for b in boxes], "f long, row0 int, row1 int, col0 int, col1 int, n int")
    got = sorted(tuple(r) for r in B.merge_close(df, ["f"], 1, 2, "n", 4).select("f", "row0", "row1", "col0", "col1", "n").collect())
    want = []
    for f in range(3):
        now = [[*b[1:], 1] for b in boxes if b[0] == f]
        again = True
        while again:
            again = False
            for i in range(len(now)):
                for j in range(i + 1, len(now)):
                    p, q = now[i], now[j]
                    if p[0] <= q[1] + 1 and q[0] <= p[1] + 1 and p[2] <= q[3] + 2 and q[2] <= p[3] + 2:
                        now[i] = [min(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), max(p[3], q[3]), p[4] + q[4]]
                        del now[j]
                        again = True
                        break
                if again:
                    break
        want += [(f, *b) for b in now]
    assert got == sorted(want)


def test_rules_ignore_empty_wishes_and_zero(spark):
    df = spark.createDataFrame([("s", 1, "CT Chest", 0.0), ("s", 2, "ct abdomen", 5.0), ("s", 3, None, 5.0)], "study string, n int, text string, x double")
    r = [{"name": "ct", "conditions": {"text": "^ct", "x": ""}}, {"name": "zero", "conditions": {"x": 0.0, "text": ["CT", "chest"]}}, {"name": "five", "conditions": {"x": 5}}]
    assert sorted((x.selection, x.n) for x in rules.select(df, r, ["study"], ["n"]).collect()) == [("ct", 1), ("five", 2), ("zero", 1)]
    assert sorted((x.selection, x.n) for x in rules.select(df, r, ["study"], ["n"], True).collect()) == [("ct", 1), ("ct", 2), ("five", 2), ("five", 3), ("zero", 1)]


def test_index_percentiles_and_thresholds(spark):
    df = spark.range(10).selectExpr("'a' as k", "cast(id as double) as v", "id as t", "id >= 6 as good")
    got = {r.pct: r.value for r in M.index_percentiles(df, ["k"], "v", ["t"], [0, 95, 100]).collect()}
    assert got == {0: 0.0, 95: 9.0, 100: 9.0}
    b = M.best_threshold(df, ["k"], "v", F.col("good"), [2.0, 5.5, 6.0, 8.0]).first()
    assert (b.threshold, b.f1) == (5.5, 1.0)


def test_nearest_vectors_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(100, None), (101, []), (102, [0.0] * 8), (103, [1.0] * 7)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = nearest(df, df.where("id % 20 = 0"), "id", "v", 3).collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = n @ n[q]
        s[q] = -9
        assert [r.neighbour for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == list(np.argsort(-s)[:3])


def test_queries_of_several_lengths(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [-1.0]), (3, [1.0, 0.0]), (4, [1.0, 1.0]), (5, [0.0, 1.0]), (6, [2.0, 0.0]), (7, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["query"], r["rank"]): r.neighbour for r in nearest(df, df.where("id in (0, 3, 7)"), "id", "v", 2).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (3, 1): 6, (3, 2): 4}
    df = df.withColumn("g", F.when(F.col("id") != 4, F.col("id") % 2))
    got = {(r["query"], r["rank"]): r.neighbour for r in nearest(df, df.where("id in (0, 3, 4, 7)"), "id", "v", 2, same="g").collect()}
    assert got == {(0, 1): 2, (3, 1): 5}


def test_components_of_wide_grids_keep_apart(spark):
    cells = [(0, 0, 1_000_000), (0, 1, 0), (0, 1, 2_000_000)]
    got = sorted((r.row0, r.col0, r.pixel_count) for r in G.label_components(spark.createDataFrame(cells, "frame long, row int, col int")).collect())
    assert got == [(0, 1_000_000, 1), (1, 0, 1), (1, 2_000_000, 1)]


def test_scratch_is_named_and_cleared(spark):
    import os

    from wavemill.session import clear_scratch, scratch_dir, written

    written(spark.range(3)).count()
    at = scratch_dir(spark)
    assert os.listdir(at) and clear_scratch(spark) > 0 and not [x for x in os.listdir(at) if x.startswith("stage-")]


def test_packets_round_trip(spark):
    df = spark.createDataFrame([(1, 7, [1, -2, 300, -32768]), (2, 65535, [5, 6, 7])], "id int, p long, v array<long>").select("id", packets.encode(F.col("p"), F.col("v")).alias("payload"))
    got = {r.id: (r.packet_id, [(round(s.i * 32767), round(s.q * 32767)) for s in r.samples]) for r in packets.decode(df, "payload").collect()}
    assert got == {1: (7, [(1, -2), (300, -32768)]), 2: (65535, [(5, 6)])}


def test_spectrum_and_filter_against_numpy(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(3, 16)) + 1j * rng.normal(size=(3, 16))
    df = spark.createDataFrame([(i, [float(v) for v in z[i].real], [float(v) for v in z[i].imag]) for i in range(3)] + [(8, None, None), (9, [], [])], "i int, re array<double>, im array<double>")
    got = {r.i: np.array(r.re) + 1j * np.array(r.im) for r in X.spectrum(df, ["i"], "re", "im").collect()}
    assert sorted(got) == [0, 1, 2] and all(np.allclose(got[i], np.fft.fftshift(np.fft.fft(z[i]))) for i in got)
    h = X.lowpass(5, 0.2)
    long = df.where("i < 3").select("i", F.posexplode(F.arrays_zip("re", "im")).alias("t", "z")).select("i", "t", "z.re", "z.im")
    out = {(r.i, r.m): complex(r.re, r.im) for r in X.filter_decimate(long, ["i"], "t", "re", "im", h, 0.1, 3).collect()}
    for i in range(3):
        y = np.convolve(z[i] * np.exp(-2j * np.pi * 0.1 * np.arange(16)), h, "same")[::3]
        assert np.allclose([out[(i, m)] for m in range(len(y))], y)


def test_coherent_detector_against_numpy(spark):
    rng = np.random.default_rng(4)
    p = rng.random((12, 20)) + 0.1
    p[4:8, 6:16] += 60
    g = grid(spark, {(r, c): p[r, c] for r in range(12) for c in range(20)})
    got = np.zeros((12, 20), bool)
    for r in X.coherent_detector(g, 12, 20, sigma=1.0, background=(8, 5), opened=(3, 3), closed=(3, 3)).collect():
        got[r.row, r.col] = r.hit
    assert got[5:7, 8:14].all() and not got[0].any() and not got[11].any()


def test_quantiles(spark):
    rng = np.random.default_rng(12)
    v = rng.integers(0, 30, 101).tolist()
    df = spark.createDataFrame([(i, "a" if i < 60 else "b", float(x)) for i, x in enumerate(v)] + [(500, "a", None)], "t long, k string, v double")
    got = {r.k: (r.x, r.y) for r in M.quantiles(df, ["k"], "v", ["t"], {"x": 0.5, "y": 0.93}).collect()}
    assert all(np.allclose(got[k], np.quantile(x, [0.5, 0.93])) for k, x in (("a", v[:60]), ("b", v[60:])))
    assert np.isclose(M.quantiles(df, [], "v", ["t"], {"x": 0.1}).first()["x"], np.quantile(v, 0.1))


def test_contrast_lens_crop_and_heat(spark):
    rng = np.random.default_rng(4)
    values = {f: rng.integers(0, 200, (8, 12)).astype(float) for f in ("a", "b")}
    rows = [(f, r, c, float(v[r, c])) for f, v in values.items() for r in range(8) for c in range(12)]
    g = spark.createDataFrame([(*x, "n") for x in rows], "frame string, row int, col int, value double, n string")

    def plain(v, down, across, clip, levels):
        v = np.minimum(v, levels - 1).astype(int)
        h, w = v.shape[0] // down, v.shape[1] // across
        limit, maps = max(1, int(clip * h * w / levels)), np.zeros((down, across, levels))
        for i in range(down):
            for j in range(across):
                n = np.bincount(v[i * h : i * h + h, j * w : j * w + w].ravel(), minlength=levels)
                over = int(np.maximum(n - limit, 0).sum())
                n = np.minimum(n, limit) + over // levels
                rest = over % levels
                for k in range(rest):
                    n[k * max(levels // rest, 1)] += 1
                maps[i, j] = np.minimum(np.round(np.cumsum(n) * ((levels - 1) / (h * w))), levels - 1)
        out = np.zeros(v.shape, int)
        for r in range(v.shape[0]):
            for c in range(v.shape[1]):
                y, x = r / h - 0.5, c / w - 0.5
                i, j = math.floor(y), math.floor(x)
                t, b, le, ri = max(i, 0), min(i + 1, down - 1), max(j, 0), min(j + 1, across - 1)
                m = maps[:, :, v[r, c]]
                out[r, c] = round((m[t, le] * (1 - (x - j)) + m[t, ri] * (x - j)) * (1 - (y - i)) + (m[b, le] * (1 - (x - j)) + m[b, ri] * (x - j)) * (y - i))
        return out

    for tiles, clip, levels in (((2, 3), 2.0, 256), ((4, 2), 1.0, 64), ((1, 1), 40.0, 16)):
        got = {(r.frame, r.row, r.col): r.pixel for r in G.equalised(g, 8, 12, tiles, clip, levels).collect()}
        for f, v in values.items():
            want = plain(v, *tiles, clip, levels)
            assert all(got[f, r, c] == want[r, c] for r in range(8) for c in range(12))
    with pytest.raises(ValueError):
        G.equalised(g, 8, 12, (3, 3))

    same = {(r.frame, r.row, r.col): r.value for r in G.undistorted(g, 8, 12, 10.0, 0.0, 0.0).collect()}
    assert same == {(f, r, c): v for f, r, c, v in rows}
    bent = {(r.frame, r.row, r.col): r.value for r in G.undistorted(g, 8, 12, 10.0, 0.5, 0.1).collect()}
    for f, v in values.items():
        padded = np.pad(v, 6)
        for r in range(8):
            for c in range(12):
                y, x = (r - 3.5) / 10, (c - 5.5) / 10
                grow = 1 + 0.5 * (y * y + x * x) + 0.1 * (y * y + x * x) ** 2
                y, x = y * grow * 10 + 3.5 + 6, x * grow * 10 + 5.5 + 6
                i, j = math.floor(y), math.floor(x)
                near = padded[i : i + 2, j : j + 2]
                assert abs(bent[f, r, c] - np.array([1 - y + i, y - i]) @ near @ np.array([1 - x + j, x - j])) < 1e-9
    assert bent["a", 0, 0] == 0

    cut = G.cropped(g, (2, 5), (10, 20))
    assert {(r.row, r.col) for r in cut.collect()} == {(r, c) for r in range(3) for c in range(2)}
    odd = spark.createDataFrame([("a", 0, i, v) for i, v in enumerate([None, float("nan"), -5.0, 10.0, 15.0, 99.0])], "frame string, row int, col int, value double")
    assert [(r.red, r.green, r.blue) for r in G.heat(odd, 0.0, 20.0).orderBy("col").collect()] == [(None,) * 3, (None,) * 3, (0, 0, 127), (127, 255, 127), (255, 127, 0), (127, 0, 0)]
    none = g.limit(0)
    assert G.equalised(none, 8, 12, (2, 3)).count() == G.undistorted(none, 8, 12, 10.0, 0.1, 0.0).count() == G.heat(cut.limit(0), 0.0, 1.0).count() == 0


def test_a_full_sink_tells_what_it_drops(spark):
    rows = [(c, i // 5 if c else None, i, 2 if i % 3 else None, "x") for c in (0, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "channel int, second int, i int, n_iq int, n_rows string")
    kept, account = sampling.shed(df, ["channel"], F.col("second"), ["i"], 3, {"lost": "n_iq"})
    assert {(r.channel, r.i) for r in kept.collect()} == {(0, i) for i in range(12)} | {(1, i) for i in range(12) if i % 5 < 3} and kept.columns == df.columns
    got = {(r.channel, r.period): (r.n_kept, r.n_dropped, r.lost) for r in account.collect()}
    assert got == {(0, None): (12, 0, 0), (1, 0): (3, 2, 2), (1, 1): (3, 2, 2), (1, 2): (2, 0, 0)}
    assert sampling.shed(df.limit(0), ["channel"], F.col("second"), ["i"], 3, {"lost": "n_iq"})[1].count() == 0
