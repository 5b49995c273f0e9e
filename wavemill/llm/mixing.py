"""Mix sources to target shares of all tokens.

Tokens are counted once per document and written with its source. Tokens per
source give each source's rate: how often its tokens are needed. A document is
taken ``floor(rate)`` times, and once more with the probability of the rest, by a
hash of its id and the seed: no order and no shuffle, and the same choice on every
run. A source's tokens then differ from those wanted by chance, the less so the
more documents it has; the shares reached are reported. Where few documents must
come nearer, ``balanced`` takes the first in hash order instead.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.ordered import running
from wavemill.session import small_side, written

VOCABULARY = "byte_bpe_50k.tiktoken"
_HASH_RANGE = 2**53
# Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _counter(folder: str, vocabulary: str) -> Callable[[str], int]:
    import tiktoken

    lines = Path(folder, vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


#: A long text is counted in stretches of about so many characters.
STRETCH = 100_000


def _stretches(text: str) -> Iterator[str]:
    """A text in parts whose tokens are together those of the whole: cut where the vocabulary's pattern cuts, and not after white space, whose cutting depends on what follows."""
    if len(text) <= STRETCH:
        yield text
        return
    import regex

    at = 0
    for m in regex.finditer(PATTERN, text):
        if m.end() - at >= STRETCH and not text[m.end() - 1].isspace():
            yield text[at : m.end()]
            at = m.end()
    if at < len(text):
        yield text[at:]


def token_counts(docs: DataFrame, text: str, *keep: Column, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``tokens`` of each document; null and empty texts have none."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("tokens", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(folder, vocabulary)
        for b in batches:
            n = [sum(map(count, _stretches(t.as_py()))) if t.is_valid else 0 for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], schema=arrow)

    return source.mapInArrow(run, schema)


def source_name(c: Column) -> Column:
    """A source's name without outer blanks, case and kind of separator; null if nothing remains."""
    s = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s\-_.]+", "_")
    return F.when(s != "", s)


def mix(docs: DataFrame, targets: DataFrame, folder: str, total_tokens: int | None = None, strict: bool = False, balanced: bool = False, seed: int = 0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The chosen documents and the shares reached.

    Chosen: ``doc_id, source, tokens, copies`` (at least 1). Shares: ``source,
    target_share, n_docs, available_tokens, rate, expected_share, used_docs,
    used_tokens, share``.

    A document counts once however often it was delivered (the same id); ids
    that are null, and sources that are null or not listed, aren't used. A
    listed source without tokens can't contribute: the others keep their
    proportions. The mixture has ``total_tokens``, or else as many as the listed
    sources have together. Sources whose limit keeps them from their share give
    all they may, ``max_repeats`` times each document, and the others fill up, in
    proportion to their shares, as far as their own limits go; the shares
    reached are reported. With ``strict`` the mixture is instead the largest one
    in which no source falls short, which the scarcest source decides. With
    ``balanced`` the copies beyond ``floor(rate)`` are not drawn but go to the first
    documents in hash order, so that a source misses its tokens by half a document
    at most, for a sort of all documents.
    A null or negative share or limit counts as 0, a source listed twice has the
    sum of the shares and the smaller limit. ``folder`` has the files of public
    tokenizers, at the same place on every executor.
    """
    once = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id"), source_name(F.col("source")).alias("source"), "text")
    wanted = targets.groupBy(source_name(F.col("source")).alias("source")).agg(
        F.coalesce(F.sum(F.greatest(F.col("target_share"), F.lit(0.0))), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.min("max_repeats"), F.lit(0)), F.lit(0)).cast("double").alias("most")
    )
    wanted = small_side(written(wanted.where("source is not null"), "targets"))
    listed = once.join(wanted.select("source"), "source", "left_semi")
    counted = token_counts(listed, "text", F.col("doc_id"), F.col("source"), folder=folder, vocabulary=vocabulary)
    counted = written(counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.source", "r.tokens"), "tokens")
    per = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").cast("double").alias("available"))
    rates = _rates(wanted.join(per, "source", "left").fillna(0, ["n_docs", "available"]), total_tokens, strict)
    rates = written(rates, "rates")
    rate = small_side(rates.select("source", "rate", "available"))
    rest = F.col("rate") - F.floor("rate")
    if balanced:
        counted = running(counted.withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id")), ["source"], ["_draw", "doc_id"], "_upto", F.col("tokens"))
        more = (F.col("_upto") - F.col("tokens") / 2 <= rest * F.col("available")) & (rest > 0)  # the middle of its tokens
    else:
        more = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_HASH_RANGE)) / F.lit(float(_HASH_RANGE)) < rest
    copies = F.floor("rate") + F.when(more, 1).otherwise(0)
    chosen = counted.join(rate, "source").select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")
    used = chosen.groupBy("source").agg(F.sum("copies").alias("used_docs"), F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"))
    whole = Window.partitionBy(F.lit(0))  # one row per listed source
    report = rates.join(used, "source", "left").fillna(0, ["used_docs", "used_tokens"])
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(whole).cast("double"), F.lit(0.0)), F.lit(0.0))
    report = report.withColumn("expected", F.col("rate") * F.col("available"))
    return chosen, report.select("source", "target_share", "n_docs", F.col("available").cast("long").alias("available_tokens"), "rate", share("expected").alias("expected_share"), "used_docs", "used_tokens", share("used_tokens").alias("share"))


def records(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The mixture itself, each record as often as it is taken: ``doc_id, copy_no`` (from 1), ``source, tokens, text``.

    Of a document delivered again with several texts, the least one comes out.
    """
    text = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    each = chosen.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    return each.join(text, "doc_id").select("doc_id", "copy_no", "source", "tokens", "text")


def _rates(sources: DataFrame, total: int | None, strict: bool) -> DataFrame:
    """With ``rate`` per source: its wanted tokens over those it has, at most its limit. One row per listed source passes through here."""
    able = F.col("available") * F.col("most")
    can = (F.col("target_share") > 0) & (able > 0)
    rows = sources.withColumn("limit", F.when(can, able / F.col("target_share")))  # the total at which the source is used up
    whole = Window.partitionBy(F.lit(0))
    if strict:
        wanted = F.min("limit").over(whole)
        return rows.withColumn("rate", F.when(can, F.least(F.col("target_share") * wanted / F.col("available"), F.col("most"))).otherwise(0.0)).drop("limit", "most")
    # Those used up first, in order of their limit: with level x a source gives min(able, share * x).
    first = whole.orderBy(F.col("limit").asc_nulls_last(), "source")
    below, here = first.rowsBetween(Window.unboundedPreceding, -1), first.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("able", F.when(can, able).otherwise(0.0)).withColumn("w", F.when(can, F.col("target_share")).otherwise(0.0))
    wanted = F.sum("available").over(whole) if total is None else F.lit(float(total))
    level = (wanted - F.coalesce(F.sum("able").over(below), F.lit(0.0))) / F.nullif(F.sum("w").over(here), F.lit(0.0))
    rows = rows.withColumn("level", level)
    final = F.min_by("level", F.when(F.col("level") <= F.col("limit"), F.struct("limit", "source"))).over(whole)
    rows = rows.withColumn("final", final)
    given = F.least("able", F.coalesce(F.col("w") * F.col("final"), F.col("able")))
    return rows.withColumn("rate", F.when(can, given / F.col("available")).otherwise(0.0)).drop("limit", "able", "w", "level", "final", "most")
