import numpy as np

from wavemill.llm import leaks
from wavemill.llm.leaks import find_leaks, myers, words


def semi(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = np.random.default_rng(0)
    for m, n in ((8, 10), (1, 4), (5, 0), (12, 30)):
        p, t = rng.integers(0, 4, (200, m)), rng.integers(-1, 4, (200, n))
        want = [semi(list(a), [x if x >= 0 else None for x in b]) for a, b in zip(p.tolist(), t.tolist(), strict=True)]
        assert myers(p, t).tolist() == want


def test_words_ignore_spelling():
    assert words("Straße, ÉCOLE école; ＷＩＤＥ zero​width l'an x­y") == ["strasse", "ecole", "ecole", "wide", "zerowidth", "l", "an", "xy"]
    assert words(None) == words("") == words(" .,_ ") == []


def brute(docs, items, most):
    out = {}
    for d, t in docs:
        for i, q in items:
            w, v = words(t), words(q)
            if None in (d, i):
                continue
            for k in range(len(v) - 7):
                for at in range(len(w)):
                    for size in range(8 - most, 9 + most):
                        if at + size <= len(w):
                            e = lev(v[k : k + 8], w[at : at + size])
                            if e <= most:
                                out[(d, i)] = min(e, out.get((d, i), 9))
    return out


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps"]
    text = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, 5, n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(5, 14, 12))] + [(99, None), (None, text(9)), (98, "")]
    docs = [(d, text(int(n))) for d, n in enumerate(rng.integers(0, 30, 60))]
    for d, (i, t) in enumerate(items[:8]):
        w = t.split()
        docs.append((1000 + d, "x, " + " ".join(w[:4]).upper() + " ! " + " ".join(w[4:])))
        if len(w) > 9:
            docs += [(2000 + d, " ".join([*w[:5], "omega", *w[6:9]])), (3000 + d, " ".join([*w[:4], *w[5:9]])), (4000 + d, " ".join([*w[:4], "omega", *w[4:8]]))]
    docs += docs[:5] + [(None, items[0][1]), (5000, None), (5001, ""), (5002, text(4000))]
    item_df = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    doc_df = spark.createDataFrame([(*d, "y") for d in docs], "doc_id long, text string, distance string")
    small = [d for d in docs if d[0] != 5002]
    got = {(r.doc_id, r.item_id): r.distance for r in find_leaks(doc_df, item_df).where("doc_id <> 5002").collect()}
    assert got == brute(small, items, 1)
    exact = {k for k, v in got.items() if v == 0}
    assert exact == {(r.doc_id, r.item_id) for r in find_leaks(doc_df, item_df, max_edits=0).where("doc_id <> 5002").collect()}
    # Too many items to broadcast: a join on pieces gives the same.
    rows = lambda k: sorted(map(tuple, find_leaks(doc_df, item_df, max_edits=k).collect()))
    whole = {k: rows(k) for k in (0, 1, 3)}
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 20)
    assert {k: rows(k) for k in whole} == whole and whole[1]


def test_joined_and_empty(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "see " + " ".join(f"w{i}x{k}" for k in range(1, 9)) + " there") for i in range(7)], "doc_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 20)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in find_leaks(docs, items).collect()) == [(i, i, 0) for i in range(5)]
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0
