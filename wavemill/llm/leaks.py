"""Evaluation passages that occur in a corpus.

A passage is ``passage_words`` consecutive words of a test item. With a budget
of k word edits it is split into k + 1 pieces, of which one must survive
unchanged, so exact piece hits find every candidate; Myers' bit-parallel
distance then verifies each candidate against the words around its hit. Pieces
are taken at every place of an item, all of an item's passages being wanted.

The corpus is read once. Up to ``BLOCK_WORDS`` words of items, a count shows, go
out to all tasks as an index of pieces, and documents are searched in place: no
shuffle, no key that could run hot. More items than that are joined: pieces of
the documents, with the words around them, meet the items' pieces by what they
say, after those that no item has were left out. Distance 0 is an exact passage.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.session import written

PASSAGE_WORDS, MAX_EDITS = 8, 1
#: Most words of items that are broadcast.
BLOCK_WORDS = 500_000
CHUNK = 400_000

_WORD = re.compile(r"[^\W_]+")
# Characters that show nothing, beside marks and format characters.
_UNSEEN = "­͏ᅟᅠ឴឵⠀ㅤﾠ"


_folded: dict[str, str] = {}


def _fold_char(ch: str) -> str:
    """A character for comparison: composed, wide and accented forms are plain, invisible ones are gone."""
    if (known := _folded.get(ch)) is not None:
        return known
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold())
    plain = "".join(c for c in plain if unicodedata.category(c) not in ("Mn", "Me", "Mc", "Cf", "Cc") and c not in _UNSEEN or c in " \t\n\r\f\v")
    return _folded.setdefault(ch, plain)


def words(text: str | None) -> list[str]:
    """Stretches of letters and digits, without regard to case, accents, width, composition and invisible characters."""
    if not text:
        return []
    if text.isascii() and text.isprintable():
        return _WORD.findall(text.lower())
    return _WORD.findall("".join(map(_fold_char, text)).lower())


def myers(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern to any stretch of its text, over rows of word numbers; negative words in texts match nothing.

    One bit per pattern word; all rows advance together by one text word.
    """
    n, m = pattern.shape
    ones = np.int64((1 << m) - 1)
    pv, mv = np.full(n, ones), np.zeros(n, np.int64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    top = m - 1
    for j in range(text.shape[1]):
        eq = np.zeros(n, np.int64)
        for i in range(m):
            eq |= (pattern[:, i] == text[:, j]).astype(np.int64) << i
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & ones)
        mh = pv & xh
        score += (ph >> top & 1) - (mh >> top & 1)
        ph = (ph << 1) & ones
        mh = (mh << 1) & ones
        pv = (mh | (~(xv | ph) & ones)) & ones
        mv = ph & xv
        np.minimum(best, score, out=best)
    return best


class Pieces:
    """Item words by number, and where each piece occurs in the items."""

    def __init__(self, items: list[tuple[int, list[str]]], passage: int, edits: int) -> None:
        self.passage, self.edits, self.size = passage, edits, passage // (edits + 1)
        self.number: dict[str, int] = {}
        flat, self.item, offset = [], [], [0]
        for key, ws in items:
            if len(ws) >= passage:
                self.item.append(key)
                flat += [self.number.setdefault(w, len(self.number)) for w in ws]
                offset.append(len(flat))
        self.flat, self.offset = np.array(flat, np.int64), np.array(offset, np.int64)
        owner = np.repeat(np.arange(len(self.item)), np.diff(self.offset))
        self.ladder: list[np.ndarray] = []
        key = self._climb(self.flat, owner, True)
        at = np.flatnonzero(key >= 0)
        order = at[np.argsort(key[at], kind="stable")]
        self.at, self.owner = order, owner
        self.first = np.searchsorted(key[order], np.arange(key.max() + 2 if len(at) else 1))

    def _climb(self, numbers: np.ndarray, owner: np.ndarray, build: bool) -> np.ndarray:
        """Numbers of the pieces that begin at each place, -1 for none: word by word, (number so far, next word) gets a number of its own."""
        key = numbers.copy()
        for step in range(1, self.size):
            after = np.full(len(key), -1)
            if len(key) > step:
                good = (owner[step:] == owner[:-step]) & (key[:-step] >= 0) & (numbers[step:] >= 0)
                after[:-step] = np.where(good, key[:-step] * np.int64(len(self.number) + 1) + numbers[step:], -1)
            if build:
                self.ladder.append(np.unique(after[after >= 0]))
            known = self.ladder[step - 1]
            spot = np.searchsorted(known, after)
            hit = (after >= 0) & (spot < len(known))
            hit[hit] = known[spot[hit]] == after[hit]
            key = np.where(hit, spot, -1)
        return key

    def find(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For pieces found in the texts and verified: text, item, distance, place of the passage in the item."""
        get = self.number.get
        lengths = np.array([len(t) for t in texts], np.int64)
        numbers = np.fromiter((get(w, -1) for t in texts for w in t), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(texts)), lengths)
        begin = np.cumsum(lengths) - lengths
        key = self._climb(numbers, owner, False)
        places = np.flatnonzero(key >= 0)
        count = self.first[key[places] + 1] - self.first[key[places]]
        ends = np.cumsum(count)
        start = 0
        while start < len(places):  # a bounded number of candidates at a time
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK)))
            p, c = places[start:stop], count[start:stop]
            inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            where = np.repeat(p, c)
            yield self._verify(numbers, owner, begin, lengths, where, self.at[np.repeat(self.first[key[p]], c) + inner])
            start = stop

    def _verify(self, numbers: np.ndarray, owner: np.ndarray, begin: np.ndarray, lengths: np.ndarray, where: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        item = self.owner[at]
        got = []
        for piece in range(self.edits + 1):  # the hit is this piece of a passage
            start = at - piece * self.size
            fits = (start >= self.offset[item]) & (start + self.passage <= self.offset[item + 1])
            i, s, d = item[fits], start[fits], where[fits]
            pattern = self.flat[s[:, None] + np.arange(self.passage)]
            window = d[:, None] - piece * self.size - self.edits + np.arange(self.passage + 2 * self.edits)
            doc = owner[d]
            inside = (window >= begin[doc][:, None]) & (window < (begin + lengths)[doc][:, None])
            text = np.where(inside, numbers[np.clip(window, 0, max(0, len(numbers) - 1))], -1)
            distance = myers(pattern, text)
            good = distance <= self.edits
            got.append((doc[good], i[good], distance[good], (s - self.offset[i])[good]))
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _split_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """``i, w``: the words of each item, each different text once; ids and texts that are null give nothing."""
    arrow = pa.schema([("i", pa.int64()), ("w", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words(t.as_py()) for t in b.column(1)], pa.list_(pa.string()))], schema=arrow)

    own = items.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    return written(own.mapInArrow(run, "i long, w array<string>"), "items")


def _joined(source: DataFrame, items: DataFrame, passage: int, edits: int) -> DataFrame:
    """``d, i, distance, place`` by a join on pieces, for any number of items."""
    size = passage // (edits + 1)
    before, after = (passage - size) + edits, (passage - size) + edits
    places = F.sequence(F.lit(0), F.size("w") - size)
    owned = items.where(F.size("w") >= passage).select("i", "w", F.explode(places).alias("at"))
    owned = owned.select("i", "at", F.expr(f"slice(w, at + 1, {size})").alias("piece"), "w")
    # A passage with this piece at each of its places, as far as the item goes.
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda k: F.struct(k.alias("nth"), (F.col("at") - k * size).alias("start"))), lambda x: (x["start"] >= 0) & (x["start"] + passage <= F.size("w")))
    owned = owned.select("i", "piece", "w", F.inline(starts)).select("i", "piece", "nth", F.col("start").alias("place"), F.expr(f"slice(w, start + 1, {passage})").alias("passage"))
    known = owned.select("piece").distinct()
    arrow = pa.schema([("d", pa.int64()), ("piece", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ds, ps, ns = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ws = [None] * before + words(t.as_py()) + [None] * after
                for at in range(before, len(ws) - after - size + 1):
                    ds.append(d)
                    ps.append(ws[at : at + size])
                    ns.append(ws[at - before : at + size + after])
                    if len(ds) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ds, ps, ns), arrow, strict=True)], schema=arrow)
                        ds, ps, ns = [], [], []
            if ds:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ds, ps, ns), arrow, strict=True)], schema=arrow)

    hits = source.mapInArrow(pieces, "d long, piece array<string>, near array<string>").join(known, "piece", "left_semi")
    pairs = hits.join(owned, "piece").select("d", "i", "place", "nth", "near", "passage")
    out = pa.schema([("d", pa.int64()), ("i", pa.int64()), ("distance", pa.int32()), ("place", pa.int32())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            both = pa.concat_arrays([b.column(5).flatten(), b.column(4).flatten()]).dictionary_encode()
            n = b.num_rows * passage
            codes = both.indices.fill_null(-1).to_numpy()
            near = codes[n:].reshape(b.num_rows, -1)
            nth = b.column(3).to_numpy()
            # From ``edits`` words before where the passage would begin to as many after its end.
            first = before - nth * size - edits
            window = np.take_along_axis(near, first[:, None] + np.arange(passage + 2 * edits), axis=1)
            distance = myers(codes[:n].reshape(b.num_rows, passage).astype(np.int64), window.astype(np.int64))
            good = distance <= edits
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good)), pa.array(distance[good].astype(np.int32)), b.column(2).filter(pa.array(good)).cast(pa.int32())], schema=out)

    return pairs.mapInArrow(verify, "d long, i long, distance int, place int")


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", passage_words: int = PASSAGE_WORDS, max_edits: int = MAX_EDITS) -> DataFrame:
    """``doc_id, item_id, distance, passages``: documents with a passage of an item, with at most ``max_edits`` word edits.

    ``distance`` is that of the best passage, 0 for an exact one, ``passages``
    the number of the item's passages found. Whole texts are searched; a row
    delivered again changes nothing. Null ids and texts, and items shorter than
    a passage, give nothing. Ids are whole numbers.
    """
    if not 0 <= max_edits < passage_words <= 60:
        raise ValueError("a passage has 1 to 60 words, more than the edits allowed")
    spark = docs.sparkSession
    arrow = pa.schema([("d", pa.int64()), ("i", pa.int64()), ("distance", pa.int32()), ("place", pa.int32())])
    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    split = _split_items(items, item_id, text)
    if (split.agg(F.sum(F.size("w"))).first()[0] or 0) > BLOCK_WORDS:
        found = _joined(source, split, passage_words, max_edits)
    else:
        index = Pieces([(r["i"], r["w"]) for r in split.where(F.size("w") >= passage_words).orderBy("i").collect()], passage_words, max_edits)
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = shared.value
            names = np.array(pieces.item, np.int64)
            if not len(names):
                return
            for b in batches:
                ids, texts = b.column(0).to_numpy(), b.column(1)
                at = 0
                while at < len(ids):
                    own, size = [], 0
                    first = at
                    while at < len(ids) and (not own or size < CHUNK):
                        own.append(words(texts[at].as_py()))
                        size += len(own[-1])
                        at += 1
                    for doc, item, distance, place in pieces.find(own):
                        # the best distance of each passage
                        order = np.lexsort((distance, place, item, doc))
                        doc, item, distance, place = doc[order], item[order], distance[order], place[order]
                        new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1])] if len(doc) else np.zeros(0, bool)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[first + doc[new]]), pa.array(names[item[new]]), pa.array(distance[new].astype(np.int32)), pa.array(place[new].astype(np.int32))], schema=arrow)

        found = source.mapInArrow(run, "d long, i long, distance int, place int")
    each = found.groupBy("d", "i", "place").agg(F.min("distance").alias("distance"))
    out = each.groupBy("d", "i").agg(F.min("distance").alias("distance"), F.count(F.lit(1)).alias("passages"))
    return out.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "distance", "passages")
