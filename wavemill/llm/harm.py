"""Scores for abusive, hateful and sexual text.

Gradient-boosted trees over dense features of each document, calibrated by
isotonic regression. The features are lexicon densities (the given terms, and
word sequences weighed by how much more often readers marked documents that have
them), the nearness of second persons to such words, capitals, punctuation, and
rates of the ways words are disguised. Words are compared in an undisguised
form, whose inner letters are sorted, so that swapped letters make no difference.

Only readers' verdicts are learned from: a bounded sample of labelled documents,
``LABELLED_DOCS`` by hash, all of them where there are fewer. No document is
scored by its own verdict: the sample is cut into folds, sequences are weighed
without the fold of the document they are used on, and of two sets of trees, each
from one half of the folds, a document gets the one that hasn't seen it, any
other document the mean of both. Those unseen margins are what calibration is
fitted on. Every document is scored, whole, without a shuffle; the terms, at most ``MOST_TERMS``, and the sequences found in
the sample are broadcast. Features are computed for a batch of documents at
once, each different word being looked at once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.session import small_side, within, written

LABELLED_DOCS = 100_000
MOST_TERMS = 500_000
ROWS_PER_TASK = 25_000
FOLDS = 10
LONGEST = 3  # words in a weighed sequence
MIN_DOCS = 3
THRESHOLD = 0.5
CATEGORIES = ("abusive", "hateful", "sexual")

# Letters of other scripts and digits or signs that stand for Latin letters, and second persons.
LOOKALIKES = str.maketrans("аеорсухікмтвнѕјԁԛһɡӏѵαοερτυνικ", "aeopcyxikmtbhsjdqhglvaoeptuvik")
STAND_INS = str.maketrans("013457@$!|+€", "oieastasiite")
SECOND_PERSONS = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros vuestro eres voi vostro tuo tua sei".split()
)

_WORD = re.compile(r"[^\W_]+(?:[*@$!|+€]+[^\W_]+)*", re.UNICODE)
_SPREAD = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-_*·])(?:[^\W\d_]\1)+[^\W\d_](?![^\W_])")
_LONG_RUN = re.compile(r"(.)\1{2,}")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if unicodedata.category(c) != "Mn")


def undisguise(word: str, tally: list[int] | None = None) -> str:
    """A word's plain form: lower case without accents, look-alikes, stand-ins and stretched letters. ``tally`` counts what was done."""
    w = _plain(word)
    plain = w.translate(LOOKALIKES)
    if plain != w and tally:
        tally[1] += 1
    if not plain.isalpha() and any(c.isalpha() for c in plain):
        letters = plain.translate(STAND_INS).replace("*", "")
        if tally and letters != plain:
            tally[2] += 1
        plain = letters
    short = _LONG_RUN.sub(r"\1", plain)
    if tally and short != plain:
        tally[4] += 1
    return short


def key_of(word: str) -> str:
    """Words with the same ends and the same letters between them have one key; doubled letters count once."""
    w = re.sub(r"(.)\1", r"\1", word)
    return w if len(w) < 4 else w[0] + "".join(sorted(w[1:-1])) + w[-1]


def split(text: str, tally: list[int]) -> list[list[str]]:
    """Per sentence its words as written. ``tally`` counts invisible characters, and words spread out by separators, which are joined."""
    seen = text
    if not text.isascii():
        seen = "".join(c for c in text if unicodedata.category(c) != "Cf")
        tally[0] += len(text) - len(seen)

    def join(m: re.Match) -> str:
        tally[3] += 1
        return re.sub(r"[ .\-_*·]", "", m[0])

    parts = (_WORD.findall(part) for part in _SENTENCE.split(_SPREAD.sub(join, seen)))
    return [p for p in parts if p]


_keys: dict[str, str] = {}


def _key(word: str) -> str:
    """The key of a word as written, remembered."""
    if (k := _keys.get(word)) is None:
        if len(_keys) > 500_000:
            _keys.clear()
        k = _keys[word] = key_of(undisguise(word))
    return k


def _sequences(keys: list[str]) -> Iterator[str]:
    for n in range(1, LONGEST + 1):
        for i in range(len(keys) - n + 1):
            yield " ".join(keys[i : i + n])


FEATURES = (
    "words", "term_density", "term_severity", "terms", "abusive", "hateful", "sexual", "weight_max", "weight_second", "weight_top5", "weighty_share",
    "sentence_best", "sentence_low", "sentence_total", "you_near", "you_density", "capitals", "shouted", "exclaimed", "punctuation", "invisible", "lookalike", "stand_in", "spread_out", "stretched", "swapped",
)
#: Texts of a batch are taken together up to so many characters.
BATCH_CHARS = 2_000_000


class Lexicon:
    """Terms by key (plain word, category, severity), and sequences with a row of weights each, one per fold left out (the first: none)."""

    def __init__(self, terms: dict[str, list[tuple[str, str, int]]], sequences: list[str], weights: np.ndarray) -> None:
        self.terms = terms
        self.weights = np.vstack([weights.reshape(len(sequences), -1) if len(sequences) else np.zeros((0, FOLDS + 1)), np.zeros((1, FOLDS + 1))]).astype(np.float64)  # the last row: no sequence
        self.number: dict[str, int] = {}
        split_up = [s.split(" ") for s in sequences]
        for ws in split_up:
            for w in ws:
                self.number.setdefault(w, len(self.number))
        self.size = len(self.number) + 1
        none = len(sequences)
        self.one = np.full(self.size, none, np.int64)
        pairs: dict[int, int] = {}
        triples: list[tuple[int, int, int]] = []
        for row, ws in enumerate(split_up):
            ids = [self.number[w] for w in ws]
            if len(ids) == 1:
                self.one[ids[0]] = row
            else:
                code = ids[0] * self.size + ids[1]
                if len(ids) == 2:
                    pairs[code] = row
                else:
                    pairs.setdefault(code, none)
                    triples.append((code, ids[2], row))
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_row = np.array([pairs[c] for c in self.pair.tolist()], np.int64)
        coded = sorted((int(np.searchsorted(self.pair, c)) * self.size + w, row) for c, w, row in triples)
        self.triple = np.array([c for c, _ in coded], np.int64)
        self.triple_row = np.array([r for _, r in coded], np.int64)

    def word(self, word: str) -> tuple[float, ...]:
        """Of a word as written: number, term, severity, how many of each category, swapped, second person, look-alike, stand-in, stretched."""
        tally = [0] * 5
        plain = undisguise(word, tally)
        key = key_of(plain)
        found = self.terms.get(key, ())
        by = [sum(c == x for _, x, _ in found) for c in CATEGORIES]
        return (self.number.get(key, -1), bool(found), max((s for _, _, s in found), default=0), *by, sum(t != plain for t, _, _ in found), plain in SECOND_PERSONS, tally[1], tally[2], tally[4])


def _find(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The place of each code in a sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return np.where(table[at] == codes, at, -1)


class Featurer:
    """Features of many texts at once, for one task."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.known: dict[str, int] = {}
        self.rows: list[tuple[float, ...]] = []
        self.kinds = np.full(0x110000, 255, np.uint8)  # of a character: 1 upper case, 2 letter, 4 mark; 255 not yet seen

    def _characters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Capitals, letters, and marks of each text."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        for c in np.unique(codes[self.kinds[codes] == 255]).tolist():
            ch = chr(c)
            self.kinds[c] = ch.isupper() + 2 * ch.isalpha() + 4 * (not ch.isalnum() and not ch.isspace())
        kind = self.kinds[codes]
        ends = np.cumsum([len(t) for t in texts])
        upto = lambda bit: np.r_[0, np.cumsum((kind & bit) > 0)]
        return tuple(np.diff(np.r_[0, upto(bit)[ends]]) for bit in (1, 2, 4))

    def __call__(self, texts: list[str], folds: np.ndarray) -> np.ndarray:
        """A row of ``FEATURES`` for each text; ``folds``: whose documents to leave out of the weights, -1 for none."""
        n = len(texts)
        out = np.zeros((n, len(FEATURES)))
        if not n:
            return out
        upper, letters, marks = self._characters(texts)
        size = np.maximum([len(t) for t in texts], 1)
        flat, lengths, owner = [], [], []
        if len(self.known) > 500_000:
            self.known, self.rows = {}, []
        for d, t in enumerate(texts):
            tally = [0] * 5
            for ws in split(t, tally):
                flat += ws
                lengths.append(len(ws))
                owner.append(d)
            out[d, 20], out[d, 23] = tally[0], tally[3]
            out[d, 17] = sum(1 for w in t.split() if w.isupper() and len(w) > 2) if upper[d] > 2 else 0
            out[d, 18] = t.count("!") / size[d] * 100
        out[:, 16], out[:, 19] = upper / np.maximum(letters, 1), marks / size
        known = self.known
        for w in flat:
            if w not in known:
                known[w] = len(self.rows)
                self.rows.append(self.lexicon.word(w))
        of_sentence = np.array(owner, np.int64)  # whose each sentence is
        sentence = np.repeat(np.arange(len(lengths)), lengths)
        doc = of_sentence[sentence]
        words = np.bincount(doc, minlength=n)
        out[:, 0] = np.log1p(np.maximum(words, 1))
        out[:, 11], out[:, 13] = -5.0, -5.0
        if not len(flat):
            return out
        of_word = np.array(self.rows)[np.fromiter((known[w] for w in flat), np.int64, len(flat))]
        total = lambda c: np.bincount(doc, of_word[:, c], n)
        hits = total(1)
        out[:, 1], out[:, 3] = hits / np.maximum(words, 1), hits
        np.maximum.at(out[:, 2], doc, of_word[:, 2])
        for c, f in ((3, 4), (4, 5), (5, 6), (6, 25), (8, 21), (9, 22), (10, 24)):
            out[:, f] = total(c)
        out[:, 15] = total(7) / np.maximum(words, 1)

        # Weights of all sequences of up to three words inside sentences.
        lex, fold = self.lexicon, folds[doc] + 1
        number = of_word[:, 0].astype(np.int64)
        one = lex.weights[lex.one[number], fold]  # -1 is the last place, which no word has
        weights, where = [one], [sentence]
        same = sentence[1:] == sentence[:-1]
        begin = np.flatnonzero(same)
        pair = _find(lex.pair, np.where((number[begin] >= 0) & (number[begin + 1] >= 0), number[begin] * lex.size + number[begin + 1], -1))
        none = len(lex.weights) - 1
        row = lambda table, at: np.append(table, none)[at]
        weights.append(lex.weights[row(lex.pair_row, pair), fold[begin]])
        where.append(sentence[begin])
        third = np.flatnonzero(same[begin[begin < len(same) - 1] + 1]) if len(same) > 1 else np.zeros(0, np.int64)
        start = begin[third]
        triple = _find(lex.triple, np.where((pair[third] >= 0) & (number[start + 2] >= 0), pair[third] * lex.size + number[start + 2], -1))
        weights.append(lex.weights[row(lex.triple_row, triple), fold[start]])
        where.append(sentence[start])
        w, at = np.concatenate(weights), np.concatenate(where)
        m = len(lengths)
        count, mean = np.bincount(at, minlength=m), np.bincount(at, w, m)
        best, low = np.full(m, -np.inf), np.full(m, np.inf)
        np.maximum.at(best, at, w)
        np.minimum.at(low, at, w)
        mean = mean / np.sqrt(count)
        np.maximum.at(out[:, 13], of_sentence, mean)
        order = np.lexsort((np.arange(m), -best, of_sentence))  # the first of a document's best sentences
        first = order[np.r_[True, of_sentence[order][1:] != of_sentence[order][:-1]]]
        out[of_sentence[first], 11], out[of_sentence[first], 12] = best[first], low[first]
        by = of_sentence[at]
        order = np.lexsort((-w, by))
        ranked, by = w[order], by[order]
        nth = np.arange(len(by)) - np.searchsorted(by, by)
        out[by[nth == 0], 7] = ranked[nth == 0]
        out[by[nth == 1], 8] = ranked[nth == 1]
        out[:, 9] = np.bincount(by[nth < 5], ranked[nth < 5], n)
        out[:, 10] = np.bincount(by, ranked > 1.5, n) / np.maximum(np.bincount(by, minlength=n), 1)

        # How near a second person is to a marked word of its sentence: to the next one on either side.
        persons, marked = np.flatnonzero(of_word[:, 7] > 0), np.flatnonzero((of_word[:, 1] > 0) | (one > 1.5))
        if len(persons) and len(marked):
            right = np.searchsorted(marked, persons)
            for side in (right - 1, right):
                ok = (side >= 0) & (side < len(marked))
                p, q = persons[ok], marked[side[ok]]
                ok = sentence[p] == sentence[q]
                np.maximum.at(out[:, 14], doc[p[ok]], 1 / (1 + np.abs(p[ok] - q[ok])))
        return out


def _keyed(docs: DataFrame) -> DataFrame:
    """The sequences of each labelled document, each once: ``positive, fold, seq``."""
    arrow = pa.schema([("positive", pa.int32()), ("fold", pa.int32()), ("seq", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, positive, fold in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = sorted({s for ws in split(text or "", [0] * 5) for s in _sequences([_key(w) for w in ws])})
                yield pa.RecordBatch.from_arrays([pa.array([positive] * len(own), pa.int32()), pa.array([fold] * len(own), pa.int32()), pa.array(own, pa.string())], schema=arrow)

    return docs.select("text", "positive", "fold").mapInArrow(run, "positive int, fold int, seq string")


def _with_features(docs: DataFrame, keep: list[str], lexicon: Lexicon) -> DataFrame:
    """``keep`` and ``x``; a document's ``fold`` is left out of the weights, all are used where it is null."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    source = docs.select(*keep, F.coalesce(F.col("fold"), F.lit(-1)).cast("int").alias("_fold"), F.coalesce("text", F.lit("")).alias("_text"))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("x", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurer = Featurer(shared.value)
        for b in batches:
            k = b.num_columns
            folds, texts = b.column(k - 2).to_numpy(), b.column(k - 1).to_pylist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= BATCH_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                x = featurer(texts[at:stop], folds[at:stop])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, stop - at) for c in b.columns[: k - 2]), lists], schema=arrow)
                at = stop

    return source.mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED_DOCS) -> DataFrame:
    """``doc_id, text, positive, weight, fold`` of documents with a verdict; the readers' majority counts, a tie doesn't. A reader's repeated verdict counts once."""
    read = labels.where("doc_id is not null and category is not null").select("doc_id", F.lower(F.trim("category")).alias("category"), "reader").distinct()
    share = read.groupBy("doc_id").agg(F.avg((F.col("category") != "none").cast("double")).alias("share"))
    votes = share.where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("positive"), F.abs(2 * F.col("share") - 1).alias("weight"))
    votes = small_side(written(votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "votes"), most)
    texts = docs.where("text is not null").select(F.col("doc_id"), "text").join(votes, "doc_id")
    texts = texts.groupBy("doc_id", "positive", "weight").agg(F.min("text").alias("text"))
    return texts.withColumn("fold", F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(FOLDS)).cast("int"))


@dataclass
class Scorer:
    """``halves``: trees by the later and by the earlier half of the folds, each for documents of the other half."""

    lexicon: Lexicon
    folds: DataFrame
    halves: tuple[GBTClassificationModel, GBTClassificationModel]
    calibration: IsotonicRegressionModel

    def score(self, docs: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and ``score``, the calibrated probability, of every row; a null or empty text has none of the marks. ``docs`` has a ``doc_id``, by which a labelled one is known."""
        x = _with_features(docs.join(self.folds, "doc_id", "left"), [*keep, "fold"], self.lexicon)
        x = _margins(x.select(*keep, "fold", array_to_vector("x").alias("features")), self.halves)
        return self.calibration.transform(x).select(*keep, F.col("calibrated").alias("score"))


def _margins(x: DataFrame, halves: tuple[GBTClassificationModel, GBTClassificationModel]) -> DataFrame:
    """``margin`` by the trees that haven't seen a document, the mean of both where its ``fold`` is null."""
    for name, model in zip(("_first", "_second"), halves, strict=True):
        x = model.transform(x).select(*x.columns, vector_to_array("rawPrediction")[1].alias(name))
    margin = F.when(F.col("fold") < FOLDS // 2, F.col("_first")).when(F.col("fold").isNotNull(), F.col("_second")).otherwise((F.col("_first") + F.col("_second")) / 2)
    return x.withColumn("margin", margin)


def _fit(x: DataFrame, sizes: dict, folds: list[int], trees: int, depth: int, seed: int) -> GBTClassificationModel:
    n = [max(1, sum(v for (q, f), v in sizes.items() if q == p and f in folds)) for p in (0, 1)]
    rows = x.where(F.col("fold").isin(folds)).withColumn("weight", F.col("weight") * F.when(F.col("positive") == 1, math.sqrt(n[0] / n[1])).otherwise(1.0))
    return GBTClassifier(featuresCol="features", labelCol="positive", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.15, subsamplingRate=0.8, minInstancesPerNode=4, seed=seed).fit(rows)


def given_terms(terms: DataFrame, most: int = MOST_TERMS) -> dict[str, list[tuple[str, str, int]]]:
    """The listed words by key, all of them; a longer list than ``most`` is an error."""
    rows = terms.where("term is not null").select("term", F.coalesce("category", F.lit("abusive")).alias("c"), F.coalesce("severity", F.lit(1)).alias("s")).distinct()
    if not within(rows, most):
        raise ValueError(f"more than {most} terms")
    given: dict[str, list[tuple[str, str, int]]] = {}
    for r in rows.orderBy("term", "c", "s").collect():
        for w in (undisguise(x) for x in _WORD.findall(r["term"])):
            given.setdefault(key_of(w), []).append((w, r["c"], int(r["s"])))
    return given


def train(docs: DataFrame, labels: DataFrame, terms: DataFrame, most: int = LABELLED_DOCS, trees: int = 40, depth: int = 4, seed: int = 7) -> Scorer:
    """Fit the sequences' weights, the trees of both halves of the folds, and the calibration on the margins of documents that the trees haven't seen.

    Null terms and labels are left out. Where a half lacks verdicts of a kind,
    nothing can be learned and a ValueError says so.
    """
    given = given_terms(terms)
    known = written(labelled(docs, labels, most), "labelled")
    sizes = {(r["positive"], r["fold"]): r["count"] for r in known.groupBy("positive", "fold").count().collect()}
    halves = (list(range(FOLDS // 2, FOLDS)), list(range(FOLDS // 2)))
    if not all(any(sizes.get((p, f), 0) for f in folds) for p in (0, 1) for folds in halves):
        raise ValueError("verdicts of both kinds are needed, in both halves of the sample")
    counts = _keyed(known).groupBy("seq").agg(
        *[F.sum(F.when((F.col("fold") == f) & (F.col("positive") == p), 1).otherwise(0)).alias(f"n{p}_{f}") for p in (0, 1) for f in range(FOLDS)]
    )
    every = sum((F.col(f"n{p}_{f}") for p in (0, 1) for f in range(FOLDS)), F.lit(0))
    table = counts.where(every >= MIN_DOCS).orderBy("seq").toPandas()  # of the bounded sample: at least MIN_DOCS of its documents have each
    weights = np.zeros((len(table), FOLDS + 1))
    for column in range(FOLDS + 1):
        used = [f for f in range(FOLDS) if f != column - 1]
        n = [sum(table[f"n{p}_{f}"].to_numpy(float) for f in used) for p in (0, 1)]
        whole = [sum(v for (q, f), v in sizes.items() if q == p and f in used) for p in (0, 1)]
        w = np.log((n[1] + 0.3) / (whole[1] + 1)) - np.log((n[0] + 0.3 * max(1.0, whole[0] / max(1, whole[1]))) / (whole[0] + 1))
        weights[:, column] = np.where((n[0] + n[1] >= 2) & (np.abs(w) > 0.2), w, 0.0)
    use = (weights != 0).any(axis=1)
    lexicon = Lexicon(given, table["seq"][use].tolist(), weights[use])
    spread = known.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    x = written(_with_features(spread, ["positive", "weight", "fold"], lexicon), "features").select("positive", "weight", "fold", array_to_vector("x").alias("features"))
    # The fits are many small jobs over a bounded sample: few tasks each.
    x = x.coalesce(max(2, sum(sizes.values()) // ROWS_PER_TASK))
    with ThreadPoolExecutor(2) as pool:  # two fits of many small jobs each
        models = tuple(pool.map(lambda folds: _fit(x, sizes, folds, trees, depth, seed), halves))
    held = _margins(x, models).select(F.col("positive").cast("double").alias("label"), "weight", "margin")
    iso = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(held)
    return Scorer(lexicon, F.broadcast(known.select("doc_id", "fold").distinct()), models, iso)  # at most ``most`` rows


def scored(docs: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, source, score`` of every document; of a document delivered again the higher score, and the least of its source spellings. A null id is left out."""
    from wavemill.llm.mixing import source_name

    rows = docs.where("doc_id is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    got = train(docs, labels, terms).score(rows, "doc_id", "source")
    return got.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("score").alias("score"))


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source (null: none named): ``n_docs, n_harmful, rate, mean_score``."""
    hit = (F.col("score") >= threshold).cast("long")
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(hit).alias("n_harmful"), F.avg(hit).alias("rate"), F.avg("score").alias("mean_score"))
