import math

import numpy as np
import pytest

from wavemill.llm import harm as H


def test_undisguised_words():
    plain = lambda t: [H.undisguise(w) for ws in H.split(t, [0] * 5) for w in ws]
    assert plain("p1g p4r451t35 іdіоt sexxxxx f\u200bi\u200bl\u200bt\u200bh p.o.r.n.o P a r a s i t e n IMBÉCILE") == ["pig", "parasites", "idiot", "sex", "filth", "porno", "parasiten", "imbecile"]
    assert H.key_of("vermin") == H.key_of("vremin") == H.key_of("vemrin") != H.key_of("vermen")
    assert plain("I have 3 cats in 2024.") == ["i", "have", "3", "cats", "in", "2024"]


def slow(text, terms, weights):
    """The same features, one document and one word at a time."""
    tally = [0] * 5
    parts = [[(H.undisguise(w, tally), H.key_of(H.undisguise(w))) for w in ws] for ws in H.split(text, tally)]
    n = sum(map(len, parts)) or 1
    by, hits, severity, swapped, you, near, every, best, low, total = dict.fromkeys(H.CATEGORIES, 0), 0, 0, 0, 0, 0.0, [], -5.0, 0.0, -5.0
    for ws in parts:
        keys = [k for _, k in ws]
        persons = [i for i, (w, _) in enumerate(ws) if w in H.SECOND_PERSONS]
        marked = [i for i, k in enumerate(keys) if k in terms or weights.get(k, 0.0) > 1.5]
        you += len(persons)
        for w, k in ws:
            hits += k in terms
            for t, c, s in terms.get(k, ()):
                by[c] += 1
                severity, swapped = max(severity, s), swapped + (t != w)
        near = max([near, *(1 / (1 + abs(a - b)) for a in persons for b in marked)])
        own = [weights.get(s, 0.0) for s in H._sequences(keys)]
        every += own
        total = max(total, sum(own) / math.sqrt(len(own)))
        if max(own) > best:
            best, low = max(own), min(own)
    top = sorted(every, reverse=True)[:5] or [0.0]
    size = len(text) or 1
    return [
        math.log1p(n), hits / n, severity, hits, *by.values(), top[0], top[1] if len(top) > 1 else 0.0, sum(top), sum(w > 1.5 for w in every) / (len(every) or 1), best, low, total, near, you / n,
        sum(map(str.isupper, text)) / (sum(map(str.isalpha, text)) or 1), sum(len(w) > 2 and w.isupper() for w in text.split()), text.count("!") / size * 100, sum(not c.isalnum() and not c.isspace() for c in text) / size, *tally, swapped,
    ]


def test_features_of_a_batch_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = ["you", "are", "an", "idiot", "1d10t", "idoit", "the", "cat", "Du", "FILTH", "sooooo", "іdіоt", "p o r n", "x!", "it's", "end.", "Why?", "ça", "𝔸", "\u200bhi\u200b"]
    terms = {H.key_of("idiot"): [("idiot", "abusive", 2), ("idiot", "hateful", 1)], H.key_of("filth"): [("filth", "sexual", 3)]}
    k = lambda *ws: " ".join(H.key_of(H.undisguise(w)) for w in ws)
    sequences = sorted({k("you"), k("cat"), k("you", "are"), k("are", "an"), k("an", "idiot"), k("you", "are", "an"), k("the", "cat", "idiot"), k("idiot", "the", "cat")})
    weights = rng.normal(size=(len(sequences), H.FOLDS + 1)) * 2
    texts = [" ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), int(rng.integers(0, 25)))) for _ in range(200)] + ["", " ", "...", "\u200b", "a" * 100_000, "you " * 3_000, "you an idiot"]
    folds = rng.integers(-1, H.FOLDS, len(texts))
    got = H.Featurer(H.Lexicon(terms, sequences, weights))(texts, folds)
    want = np.array([slow(t, terms, dict(zip(sequences, weights[:, f + 1], strict=True))) for t, f in zip(texts, folds, strict=True)])
    for i, name in enumerate(H.FEATURES):
        assert np.allclose(got[:, i], want[:, i]), name
    # The fifty-first marked word of a sentence is as near as it is.
    far = "idiot " * 60 + "and then much later you idiot"
    assert H.Featurer(H.Lexicon(terms, [], np.zeros((0, 1))))([far], np.array([-1]))[0, H.FEATURES.index("you_near")] == 0.5
    assert H.Featurer(H.Lexicon({}, [], np.zeros((0, 1))))([], np.zeros(0, int)).shape == (0, len(H.FEATURES))


def test_all_terms_count(spark):
    terms = spark.range(60_001).selectExpr("concat('w', id, 'x') as term", "'abusive' as category", "1 as severity")
    assert sum(map(len, H.given_terms(terms).values())) == 60_001
    with pytest.raises(ValueError):
        H.given_terms(terms, 60_000)


def corpus(spark):
    rng = np.random.default_rng(7)
    name = lambda: "N" + "".join("aeioulnrst"[i] for i in rng.integers(0, 10, 6))
    mild = ["The harbour of {} opens the market at noon.", "Report from {} says that the ferry is late.", "The dictionary of {} lists idiot with its origin.", "Does {} know why the roof leaks?"]
    bad = ["You are a worthless idiot, {}.", "Everyone knows what a pathetic scum you are, {}!", "You are a w0rthless 1diot, {}."]
    rows, labels, truth = [], [], {}
    for i in range(1500):
        hit = rng.random() < 0.2
        parts = [mild[int(rng.integers(4))].format(name()) for _ in range(int(rng.integers(1, 4)))] + ([bad[int(rng.integers(3))].format(name())] if hit else [])
        rng.shuffle(parts)
        rows.append((i, " ".join(parts), ["A-b", "a_B"][i % 2], "z"))
        truth[i] = hit
        if i < 1000:
            said = hit if rng.random() > 0.03 else not hit
            labels += [(i, "abusive" if said else "none", "r1"), (i, None, "r2")]
    rows += rows[:20] + [(5000, None, None, "z"), (5001, "", "", "z"), (None, "x", "y", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string"), spark.createDataFrame(labels, "doc_id long, category string, reader string"), truth


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    terms = spark.createDataFrame([("idiot", "abusive", 2), (None, "abusive", 1)], "term string, category string, severity int")
    s = H.scored(docs, labels, terms).cache()
    got = {r.doc_id: r.score for r in s.collect()}
    assert len(got) == 1502 and all(0 <= v <= 1 for v in got.values()) and got[5000] < 0.5 and got[5001] < 0.5
    held = [(got[i] >= H.THRESHOLD, truth[i]) for i in range(1000, 1500)]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    r = {x.source: x for x in H.rates(s).collect()}
    assert set(r) == {"a_b", None} and r["a_b"].n_docs == 1500 and abs(r["a_b"].rate - r["a_b"].n_harmful / 1500) < 1e-9


def test_verdicts_of_one_kind(spark):
    docs, labels, _ = corpus(spark)
    terms = spark.createDataFrame([], "term string, category string, severity int")
    with pytest.raises(ValueError):
        H.train(docs, labels.where("category = 'none'"), terms)
