import os

import pytest
from pyspark.sql import functions as F

from wavemill.llm import mixing as M
from wavemill.llm.queries import TOKENIZERS

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizer files here")

DOCS = "doc_id long, text string, source string, tokens string"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark):
    rows = [(i, "one two three four", ["Web Crawl", "web-crawl", " WEB_CRAWL "][i % 3], "x") for i in range(4000)]
    rows += [(10_000 + i, "one two three four", "tiny", "x") for i in range(100)] + [(20_000 + i, "one two", "unlisted", "x") for i in range(50)]
    rows += rows[:500] + [(None, "a b", "tiny", "x"), (30_000, None, "tiny", "x"), (30_001, "", "tiny", "x"), (30_002, "a", None, "x")]
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_copies(spark):
    targets = spark.createDataFrame([("web_crawl", 0.5, 1), ("tiny", 0.4, 3), ("absent", 0.1, 2), (None, 0.3, 1)], TARGETS)
    chosen, report = M.mix(docs(spark), targets, TOKENIZERS)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"web_crawl", "tiny", "absent"} and r["web_crawl"].n_docs == 4000 and r["tiny"].n_docs == 102
    assert r["tiny"].rate == 3.0 and r["absent"].share == 0 and abs(r["tiny"].share + r["web_crawl"].share - 1) < 1e-9
    c = chosen.groupBy("source").agg(F.max("copies").alias("m"), F.countDistinct("doc_id").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("copies") * F.col("tokens")).alias("t")).collect()
    assert all(x.n == x.k and x.t == r[x.source].used_tokens for x in c) and {x.source: x.m for x in c} == {"web_crawl": 1, "tiny": 3}


def test_totals_and_strict(spark):
    targets = spark.createDataFrame([("web_crawl", 3.0, 2), ("tiny", 1.0, 4)], TARGETS)
    _, report = M.mix(docs(spark), targets, TOKENIZERS, strict=True)
    r = {x.source: x for x in report.collect()}
    assert r["tiny"].rate == 4.0 and abs(r["web_crawl"].expected_share - 0.75) < 1e-9 and abs(r["web_crawl"].share - 0.75) < 0.03
    for total in (400, 3000, 10**9):
        chosen, report = M.mix(docs(spark), targets, TOKENIZERS, total_tokens=total)
        r = {x.source: x for x in report.collect()}
        most = sum(x.available_tokens * k for x, k in ((r["web_crawl"], 2), (r["tiny"], 4)))
        assert abs(sum(x.rate * x.available_tokens for x in r.values()) - min(total, most)) < 1
        assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, M.mix(docs(spark), targets, TOKENIZERS, total_tokens=total)[0].collect()))


def test_empty_and_useless_targets(spark):
    targets = spark.createDataFrame([("web_crawl", None, None), ("tiny", -1.0, 3)], TARGETS)
    assert M.mix(docs(spark), targets, TOKENIZERS)[0].count() == 0 and M.mix(docs(spark).limit(0), targets, TOKENIZERS)[1].count() == 2
    assert M.mix(docs(spark), targets.limit(0), TOKENIZERS)[0].count() == 0


def test_tokens_of_long_texts(spark, monkeypatch):
    texts = ["the quick brown fox " * 20_000, "x" * 250_000, "7" * 150_000, " " * 150_000, "a \n\n\n b\t\t c" * 9_000, "it's we'll " * 12_000 + "é…  ", "", None]
    got = {r.i: r.tokens for r in M.token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", F.col("i"), folder=TOKENIZERS).collect()}
    count = M._counter(TOKENIZERS, M.VOCABULARY)
    assert got == {i: count(t) if t else 0 for i, t in enumerate(texts)}
    monkeypatch.setattr(M, "STRETCH", 7)
    for t in ("letters and digits 123456789, 'll  two\n\n\nthree   ", "  x\n\n\ny 's't  ", "ab" * 50, "\n \n " * 9 + "z"):
        parts = list(M._stretches(t))
        assert "".join(parts) == t and sum(map(count, parts)) == count(t)


def test_records_come_as_often_as_taken(spark):
    targets = spark.createDataFrame([("web_crawl", 0.5, 1), ("tiny", 0.4, 3)], TARGETS)
    chosen, report = M.mix(docs(spark), targets, TOKENIZERS, strict=True)
    rows = M.records(docs(spark), chosen).cache()
    per = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    assert per == {r.source: r.used_tokens for r in report.collect()} and rows.count() == rows.select("doc_id", "copy_no").distinct().count()
    assert {r.doc_id for r in rows.where("text is null").collect()} == {30_000} and M.records(docs(spark), chosen.limit(0)).count() == 0


def spread(chosen, report, counted):
    """For each source how far its tokens are from those wanted, in standard deviations of independent draws."""
    each = counted.join(report.select("source", "rate"), "source").withColumn("p", F.col("rate") - F.floor("rate"))
    sd = {r.source: r.v**0.5 for r in each.groupBy("source").agg(F.sum(F.col("tokens") ** 2 * F.col("p") * (1 - F.col("p"))).alias("v")).collect()}
    return {r.source: (r.used_tokens - r.rate * r.available_tokens) / sd[r.source] for r in report.collect() if sd.get(r.source)}


def test_one_more_copy_is_drawn_by_itself(spark):
    targets = spark.createDataFrame([("web_crawl", 0.7, 2), ("tiny", 0.3, 7)], TARGETS)
    counted = docs(spark).where("doc_id is not null and text <> ''").select("doc_id", M.source_name(F.col("source")).alias("source"), F.lit(4).alias("tokens")).distinct()
    taken = {}
    for total, seed in ((6000, 0), (6000, 1), (9000, 0)):
        chosen, report = M.mix(docs(spark), targets, TOKENIZERS, total_tokens=total, seed=seed)
        rates = {r.source: r.rate for r in report.collect()}
        off = spread(chosen, report, counted)
        assert off and all(abs(x) < 5 for x in off.values())
        rows = chosen.collect()
        assert all(int(rates[r.source]) <= r.copies <= int(rates[r.source]) + 1 for r in rows)
        taken[total, seed] = {r.doc_id for r in rows if r.source == "web_crawl" and r.copies > int(rates["web_crawl"])}
    # Of a source, the documents drawn at a higher rest are more of the same; another seed draws others.
    assert taken[6000, 0] < taken[9000, 0] and taken[6000, 0] != taken[6000, 1]


def test_queries_want_every_share(spark, data):
    from wavemill.llm.queries import p7_mix, p7_shares

    report, chosen = p7_shares(spark, data), p7_mix(spark, data)
    r = [x for x in report.collect() if x.available_tokens and x.target_share]
    whole = sum(x.target_share for x in r)
    assert r and all(abs(x.expected_share - x.target_share / whole) < 1e-9 for x in r)
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", M.source_name(F.col("source")).alias("source"), "text").dropDuplicates(["doc_id"])
    counted = M.token_counts(documents, "text", F.col("doc_id"), F.col("source"), folder=TOKENIZERS)
    assert all(abs(x) < 5 for x in spread(chosen, report, counted).values())


def test_balanced_hits_every_share(spark, data):
    chosen, report = M.mix(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/mix_targets.parquet"), TOKENIZERS, strict=True, balanced=True)
    r = [x for x in report.collect() if x.available_tokens and x.target_share]
    whole = sum(x.target_share for x in r)
    assert r and all(abs(x.expected_share - x.target_share / whole) < 1e-9 for x in r)
    longest = chosen.agg(F.max("tokens")).first()[0]
    assert all(abs(x.used_tokens - x.rate * x.available_tokens) <= longest / 2 for x in r)
