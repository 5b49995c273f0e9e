import math

import numpy as np
from pyspark.sql import functions as F

from wavemill.llm import percentiles as P


def frame(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", float(rng.integers(0, 40)) / 4, i % 4) for i in range(900)]
    rows += rows[::10]  # told again
    rows += [(9001, "hot", None, 0), (9002, "hot", math.nan, 0), (9003, "hot", -1.0, 0), (9004, None, 1.0, 0), (None, "g1", 2.0, 0), (None, "g1", 2.0, 0)]
    return spark.createDataFrame([(*r, "x") for r in rows], "id long, g string, v double, day int, value string"), rows


def values(rows):
    by, seen = {}, set()
    for i, g, v, _ in rows:
        if g is None or v is None or math.isnan(v) or v < 0 or (i is not None and i in seen):
            continue
        seen.add(i)
        by.setdefault(g, []).append(v)
    return {g: sorted(v) for g, v in by.items()}


def test_nearest_rank_and_interpolation(spark):
    df, rows = frame(spark)
    r = P.sorted_values(df, ["g"], "v", ["id"], F.col("v") >= 0, partitions=7)
    own = values(rows)
    got = {(x.g, x.pct): (x.value, x.n) for x in P.percentiles(r, ["g"], [0, 25, 50, 99, 100]).collect()}
    assert got == {(g, p): (v[max(0, -(-p * len(v) // 100) - 1)], len(v)) for g, v in own.items() for p in (0, 25, 50, 99, 100)}
    near = {(x.g, x.pct): x.value for x in P.quantiles(r, ["g"], [0, 25, 50, 99, 100]).collect()}
    assert all(abs(near[(g, p)] - np.percentile(v, p)) < 1e-9 for g, v in own.items() for p in (0, 25, 50, 99, 100))


def test_parts_put_together_are_the_whole(spark):
    df, rows = frame(spark)
    days = [P.reduced(P.sorted_values(df.where(F.col("day") == d), ["g"], "v", ["id"], F.col("v") >= 0), ["g"]) for d in range(4)]
    parts = days[0].unionByName(days[1]).unionByName(days[2]).unionByName(days[3])
    own = values(rows)
    got = {(x.g, x.pct): (x.value, x.n) for x in P.merged_percentiles(parts, ["g"], [1, 50, 100], partitions=5).collect()}
    assert got == {(g, p): (v[-(-p * len(v) // 100) - 1], len(v)) for g, v in own.items() for p in (1, 50, 100)}


def test_empty(spark):
    df, _ = frame(spark)
    r = P.sorted_values(df.limit(0), ["g"], "v", ["id"])
    assert P.percentiles(r, ["g"], [50]).count() == 0 and P.quantiles(r, ["g"], [50]).count() == 0
