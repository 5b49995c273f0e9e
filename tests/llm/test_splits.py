import numpy as np
import pytest

from wavemill.llm import splits as S


def union_find(records, edges):
    up = {r: r for r in records}

    def f(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first = {}
    for r, e in edges:
        if r is None or e is None:
            continue
        a, b = f(r), f(first.setdefault(e, r))
        up[max(a, b)] = min(a, b)
    return {r: f(r) for r in records}


def test_components_with_hot_entities_and_long_chains(spark, monkeypatch):
    rng = np.random.default_rng(6)
    records = [f"r{i:03d}" for i in range(200)]
    edges = [(f"r{i:03d}", "hot") for i in range(0, 60)] + [(f"r{i:03d}", f"c{j}") for i in range(70, 130) for j in (i, i + 1)]
    edges += [(f"r{int(a):03d}", f"x{int(b)}") for a, b in zip(rng.integers(130, 190, 50), rng.integers(0, 40, 50), strict=True)] + [("r000", "hot"), (None, "hot"), ("r199", None)]
    for degree in (10_000, 5):
        monkeypatch.setattr(S, "HOT_DEGREE", degree)
        got = S.components(spark.createDataFrame([(r,) for r in [*records, None]], "r string"), spark.createDataFrame(edges, "r string, e string"), "r", "e")
        assert {x.r: x.component for x in got.collect()} == union_find(records, edges)


def test_no_edges(spark):
    got = S.components(spark.createDataFrame([("a",), ("a",), ("b",)], "r string"), spark.createDataFrame([], "r string, e string"), "r", "e")
    assert sorted(tuple(x) for x in got.collect()) == [("a", "a"), ("b", "b")]


def test_assignment_keeps_units_whole_and_shares_near(spark):
    rng = np.random.default_rng(2)
    rows = [(f"u{i}", label, int(n)) for i in range(3000) for label, n in (("a", rng.integers(0, 6)), ("b", rng.integers(0, 3)))] + [("big", "a", 900), ("u1", None, 2), (None, "a", 5), ("none", "a", None)]
    df = spark.createDataFrame(rows, "u string, l string, n long")
    got = {r.u: r.split for r in S.assign(df, "u", "l", "n", {"train": 0.7, "val": 0.15, "test": 0.15}).collect()}
    assert set(got) == {r[0] for r in rows if r[0]}
    for label in ("a", "b"):
        total = sum(r[2] or 0 for r in rows if r[0] and r[1] == label)
        for s, share in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
            assert abs(sum(r[2] or 0 for r in rows if r[0] and r[1] == label and got[r[0]] == s) / total - share) < 0.03


def test_components_beyond_the_broadcast_bound(spark, monkeypatch):
    """Most records hear one label, which is then salted."""
    monkeypatch.setattr(S, "HOT_DEGREE", 5)
    monkeypatch.setattr(S, "within", lambda df, rows=0: False)
    records = [f"r{i:03d}" for i in range(120)]
    edges = [(f"r{i:03d}", f"c{j}") for i in range(100) for j in (i // 2, (i + 1) // 2 + 1000 * (i % 7 == 0))] + [(f"r{i:03d}", "hot") for i in range(30, 90)]
    got = S.components(spark.createDataFrame([(r,) for r in records], "r string"), spark.createDataFrame(edges, "r string, e string"), "r", "e")
    assert {x.r: x.component for x in got.collect()} == union_find(records, edges)


def test_placing_is_the_least_deviation_one_by_one():
    rng = np.random.default_rng(5)
    units = [(f"u{i}", {x: float(w) for x, w in zip("abc", rng.integers(0, 9, 3), strict=True) if w}) for i in range(40)]
    units = [(u, {**own, S.ALL: sum(own.values())}) for u, own in units if own]
    part = np.array([0.7, 0.15, 0.15])
    targets = {x: part * sum(own.get(x, 0) for _, own in units) for x in ("a", "b", "c", S.ALL)}
    got, have = S.place(units, targets)
    now = {x: [0.0] * 3 for x in targets}
    for u, own in sorted(units, key=lambda kv: (-kv[1][S.ALL], kv[0])):
        cost = lambda s: sum((now[x][s] + own.get(x, 0) - targets[x][s]) ** 2 / targets[x][s] - (now[x][s] - targets[x][s]) ** 2 / targets[x][s] for x in targets)  # noqa: B023, E731
        best = min(range(3), key=lambda s: (round(cost(s), 9), s))
        assert got[u] == best
        for x, w in own.items():
            now[x][best] += w
    assert all(np.allclose(have[x], now[x]) for x in targets)


def test_many_labels_and_shards(spark, monkeypatch):
    """Over 64 labels, each held near its shares, in many shards beside a unit with a third of everything."""
    monkeypatch.setattr(S, "SHARD_UNITS", 400)
    rng = np.random.default_rng(8)
    rows = [(f"u{i}", f"l{int(x)}", int(n)) for i in range(4000) for x, n in zip(rng.integers(0, 70, 2), rng.integers(1, 4, 2), strict=True)] + [("big", f"l{x}", 100) for x in range(70)]
    df = spark.createDataFrame(rows, "u string, l string, n long")
    shares = {"train": 0.7, "val": 0.15, "test": 0.15}
    chosen = S.assign(df, "u", "l", "n", shares).cache()
    assert chosen.count() == chosen.select("u").distinct().count() == 4001
    d = S.deviation(df, chosen, "u", "l", "n", shares).collect()
    assert len(d) == 71 * 3 and sum(r.n for r in d if r["all"]) == sum(r[2] for r in rows)
    assert all(abs(r.share - r.wanted) < (0.002 if r["all"] else 0.05) for r in d), sorted((abs(r.share - r.wanted), r.label) for r in d)[-3:]
    monkeypatch.setattr(S, "MOST_LABELS", 69)
    with pytest.raises(ValueError):
        S.assign(df, "u", "l", "n", shares)


CAP = "stem string, n_samples long"
REG = "frame_id string, stem string, ann_idx int, label string, time_group int, row0 int, row1 int, col0 int, col1 int, capture string"


def test_capture_groups_and_spellings(spark):
    cap = spark.createDataFrame([("a_1_attenuation_dB_5", 1), ("a_1_attenuation_dB_10_v2", 1), ("b_2_cal", 1), ("c_3_attenuation_dB_0", 1), ("c_3_attenuation_dB_0", 1), ("d", 1), (None, 1)], CAP)
    reg = [
        (None, " A-1-Attenuation-DB-5\t", 0, "x", 7, 0, 1, 0, 1, "z"), ("captures/set1/b_2_cal#4", None, 0, "x", 7, 0, 1, 0, 1, "z"), ("C_3_ATTENUATION_DB_0.SIGMF-DATA#1", None, 1, None, 0, 0, 1, 0, 1, "z"),
        ("d#1", "d", 1, "y", None, 0, 1, 0, 1, "z"), ("d#1", "d", 1, "y", None, 0, 1, 0, 1, "z"), ("zz#1", "zz", 1, "y", 7, 0, 1, 0, 1, "z"), ("./c_3_attenuation_db_0.sigmf-meta#3", None, 2, "x", 9, 0, 1, 0, 1, "z"),
    ]
    reg = spark.createDataFrame(reg, REG)
    got = {r.stem: r.component for r in S.capture_groups(cap, reg).collect()}
    low = "a_1_attenuation_dB_10_v2"
    assert got == {"a_1_attenuation_dB_5": low, low: low, "b_2_cal": low, "c_3_attenuation_dB_0": "c_3_attenuation_dB_0", "d": "d"}
    split = S.capture_splits(cap, reg).collect()
    assert len(split) == 5 and len({(r.group_stem, r.split) for r in split}) == 3
    assert sum(r.n for r in S.split_deviation(cap, reg).collect() if r["all"]) == 5
    assert S.capture_splits(cap, reg.limit(0)).count() == 5 and S.capture_groups(cap.limit(0), reg).count() == 0
