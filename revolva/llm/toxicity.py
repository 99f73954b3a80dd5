"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings that are much more frequent among toxic
documents. Words are compared by their letters alone, so that signs put between letters do
not hide them, and once more with digits and signs read as the letters they stand for.
Features of a document are the densities and weights of lexicon words, how near one stands
to a second-person word, the rates of capitals, of punctuation and of obfuscated words.

The bounded sample of labelled documents is dealt into ``PARTS`` parts, near copies together. The features
that trees and calibration learn from are measured on each part with a lexicon of the other
parts, and the calibration is fitted on parts that the trees have not seen. Scores use the
lexicon of all parts.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revolva.llm import labelled, text
from revolva.llm.session import prepare, stored

#: Labelled documents of each class that are learned, at most.
PER_CLASS = 3000
#: Entries of the lexicon, at most.
LEXICON = 20_000
THRESHOLD = 0.3
#: Parts of the sample; the last quarter calibrates.
PARTS = 8
#: How much more frequent among toxic documents an entry is, and in how many documents at least.
RATIO, SUPPORT, SUPPORT_SHARE = 8.0, 3, 0.004
TREES, DEPTH = 20, 3

# Second-person words, and letters that digits and signs stand for.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tuyo tus".split()
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "l"}

FEATURES = [
    "strongest", "second", "weight_density", "hits", "hit_density", "near_second_person", "hidden_hits",
    "capitals", "capital_words", "calls", "punctuation", "obfuscated", "size",
]
_BEGINNINGS = (4, 5, 6, 7, 8)
_U = np.uint64
_SEEN = 1 << 20

_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_READ = np.arange(256, dtype=np.uint8)
for _sign, _letter in STANDS_FOR.items():
    _READ[ord(_sign)] = ord(_letter)


def _folded(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin letters of two bytes that begin with 0xC3."""
    out = raw.copy()
    out[_UPPER[raw]] += 32
    if len(raw) > 1:
        accent = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][accent] += 32
    return out


class Words:
    """Words of a piece: bounds, text of each, and hashes of their letters."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        apart = text.SPACES[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds] = True
        inside = ~apart
        starts = np.flatnonzero(inside & np.concatenate([[True], apart[:-1]]) | inside & edge[:-1]) if len(raw) else np.zeros(0, np.int64)
        ends = np.flatnonzero(inside & np.concatenate([apart[1:], [True]]) | inside & edge[1:]) + 1 if len(raw) else starts
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, bounds)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        lower = _folded(raw)
        self.plain, self.letters, *self.beginnings = self._hashes(lower, _LETTER[raw], _BEGINNINGS)
        read = _READ[lower]
        self.read, _ = self._hashes(read, _LETTER[read], ())

    def _hashes(self, raw: np.ndarray, letter: np.ndarray, beginnings) -> list[np.ndarray]:
        """Hash of each word's letters, how many they are, hash of its first letters (0 if it has no more)."""
        place = np.concatenate([[0], np.cumsum(letter)])
        kept = raw[letter]
        powers, inverses = text._tables(len(kept) + 1)
        total = np.zeros(len(kept) + 1, _U)
        np.cumsum(text._EXACT[kept] * powers[: len(kept)], out=total[1:])
        a, b = place[self.starts], place[self.ends]
        back = inverses[a]
        out = [np.where(b > a, text.mix((total[b] - total[a]) * back), _U(0)), b - a]
        for k in beginnings:
            cut = np.minimum(a + k, b)
            out.append(np.where(b - a > k, text.mix((total[cut] - total[a]) * back + _U(k)), _U(0)))
        return out


def word_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)])).plain[0]


class Lexicon:
    """Hashes of words and beginnings with the logarithm of how much more toxic they are."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order].astype(_U), weights[order].astype(float)
        self.maybe = np.zeros(_SEEN, bool)
        self.maybe[self.hashes & _U(_SEEN - 1)] = True
        self.second = np.sort(np.array([word_hash(w) for w in SECOND_PERSON], _U))

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        """Weight of each hash, 0 if it is no entry."""
        out = np.zeros(len(hashes))
        at = np.flatnonzero(self.maybe[hashes & _U(_SEEN - 1)])
        if len(at) and len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[place] == hashes[at], self.weights[place], 0)
        return out


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=float)])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(column), len(FEATURES)))
    for row, end, raw, bounds in text.pieces(column):
        w = Words(raw, bounds)
        count = np.maximum(np.diff(w.first), 1)
        size = np.maximum(np.diff(bounds), 1)
        open_ = np.maximum.reduce([lexicon.weigh(h) for h in (w.plain, *w.beginnings)])
        hidden = np.where(open_ > 0, 0, np.where(w.read != w.plain, lexicon.weigh(w.read), 0))
        weight = open_ + hidden
        hit = np.flatnonzero(weight > 0)
        strongest, second, near = (np.zeros(end - row) for _ in range(3))
        order = np.lexsort((-weight[hit], w.text[hit]))
        ranked, owner = weight[hit][order], w.text[hit][order]
        lead = np.arange(len(owner)) - np.searchsorted(owner, owner)
        strongest[owner[lead == 0]] = ranked[lead == 0]
        second[owner[lead == 1]] = ranked[lead == 1]
        place = np.minimum(np.searchsorted(lexicon.second, w.plain), len(lexicon.second) - 1)
        person = np.flatnonzero(lexicon.second[place] == w.plain)
        if len(person) and len(hit):
            at = np.searchsorted(person, hit)
            for neighbour in (np.maximum(at - 1, 0), np.minimum(at, len(person) - 1)):
                other = person[neighbour]
                closeness = np.where(w.text[other] == w.text[hit], 1 / (1 + np.abs(other - hit)), 0)
                np.maximum.at(near, w.text[hit], closeness)
        letters, upper = _per_text(_LETTER[raw], bounds), _per_text(_UPPER[raw], bounds)
        uppers = np.concatenate([[0], np.cumsum(_UPPER[raw])])
        loud = (uppers[w.ends] - uppers[w.starts] == w.letters) & (w.letters > 1)
        hits = _per_text(weight > 0, w.first)
        mixed = (w.read != w.plain) & (w.letters > 0)
        calls = (raw == ord("!")) | (raw == ord("?"))
        out[row:end] = np.stack(
            [
                strongest, second, _per_text(weight, w.first) / count, np.log1p(hits), hits / count, near,
                _per_text(hidden > 0, w.first) / count, upper / np.maximum(letters, 1), _per_text(loud, w.first) / count,
                _per_text(calls, bounds) / size, _per_text(text.PUNCTUATION[raw] & ~text.SPACES[raw], bounds) / size,
                _per_text(mixed, w.first) / count, np.log1p(np.diff(w.first)),
            ],
            axis=1,
        )
    return out


def _grouped(batches):
    """The sample with a key that near copies of a text share: the least hash of three words."""
    for batch in batches:
        keys: list[int] = []
        for row, end, raw, bounds in text.pieces(batch.column(2)):
            w = Words(raw, bounds)
            for i in range(end - row):
                runs = text.shingles(w.plain[w.first[i] : w.first[i + 1]], 3)
                keys.append(int(runs.min() >> _U(1)) if len(runs) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["doc_id", "label", "text", "copies"])


def _entries(batches):
    """Each document's words and beginnings, once."""
    for batch in batches:
        labels, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        hashes, owner = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for row, end, raw, bounds in text.pieces(batch.column(2)):
            w = Words(raw, bounds)
            for i in range(end - row):
                own = slice(w.first[i], w.first[i + 1])
                every = np.unique(np.concatenate([w.plain[own], *(b[own] for b in w.beginnings)]))
                hashes.append(every[every != 0])
                owner.append(np.full(len(hashes[-1]), row + i))
        rows = np.concatenate(owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(hashes).astype(np.int64)), pa.array(labels[rows], pa.int32()), pa.array(copies[rows], pa.int64())],
            ["entry", "label", "copies"],
        )


class Counts:
    """How many texts of each label and part hold each entry; near copies of a text count once."""

    def __init__(self, hashes: np.ndarray, bad: np.ndarray, good: np.ndarray, toxic: np.ndarray, clean: np.ndarray):
        self.hashes, self.bad, self.good, self.toxic, self.clean = hashes, bad, good, toxic, clean

    def lexicon(self, without: int | None = None) -> Lexicon:
        """Entries that are frequent enough among the toxic texts of all parts but one."""
        parts = np.arange(PARTS) != (-1 if without is None else without)
        bad, good = self.bad[:, parts].sum(1), self.good[:, parts].sum(1)
        toxic, clean = self.toxic[parts].sum(), self.clean[parts].sum()
        weight = np.log((bad + 0.5) / (toxic + 1) / ((good + 0.5) / (clean + 1)))
        chosen = (bad >= max(SUPPORT, round(SUPPORT_SHARE * int(toxic)))) & (weight >= np.log(RATIO))
        return Lexicon(self.hashes[chosen], weight[chosen])


def count_entries(sample: DataFrame, most: int = LEXICON) -> Counts:
    """Counts of the ``most`` entries that are most toxic in a bounded sample (label, text, copies)."""
    each = sample.select("label", "copies", "text").mapInArrow(_entries, "entry long, label int, copies long")
    part = F.pmod("copies", F.lit(PARTS))
    here = [F.count_if((F.col("label") == label) & (part == k)).alias(f"n{label}_{k}") for label in (1, 0) for k in range(PARTS)]
    # One shuffle: texts are told apart and counted where their entry is.
    counts = each.repartition("entry").distinct().groupBy("entry").agg(*here)
    bad, good = (reduce(Column.__add__, [F.col(f"n{label}_{k}") for k in range(PARTS)]) for label in (1, 0))
    rows = counts.where(bad >= SUPPORT).orderBy(F.desc((bad + 0.5) / (good + 0.5)), "entry").limit(most).collect()
    sizes = {(r.label, r.part): r["count"] for r in sample.groupBy("label", part.alias("part")).count().collect()}
    table = np.array([r[1:] for r in rows], np.int64).reshape(len(rows), 2 * PARTS)
    held = lambda label: np.array([sizes.get((label, k), 0) for k in range(PARTS)])
    return Counts(np.array([r.entry for r in rows], np.int64).astype(_U), table[:, :PARTS], table[:, PARTS:], held(1), held(0))


def _measured(batches, lexicon, place: int):
    for batch in batches:
        x = features(batch.column(place), lexicon.value)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(place)), flat], [*batch.schema.names[:place], "features"])


class Model:
    """Lexicon, trees and calibration; ``constant`` if the sample has one class only."""

    def __init__(self, lexicon: Lexicon, trees=None, calibration=None, constant: float | None = None):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant


def _vectors(rows: DataFrame, lexicon: Lexicon, *columns: str) -> DataFrame:
    spark = rows.sparkSession
    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*columns).dtypes)
    measure = partial(_measured, lexicon=spark.sparkContext.broadcast(lexicon), place=len(columns))
    measured = rows.select(*columns, "text").mapInArrow(measure, f"{schema}, features array<double>")
    return measured.withColumn("features", array_to_vector("features"))


def train(documents: DataFrame, labels: DataFrame, learnable: Column, per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` documents of each label."""
    prepare(documents.sparkSession)
    chosen = labelled.texts(documents, labelled.sample(labels, "toxic", learnable, per_class))
    rows = stored(chosen.mapInArrow(_grouped, "doc_id long, label int, text string, copies long"), "sample")
    part = F.pmod("copies", F.lit(PARTS))
    counts = count_entries(rows)
    lexicon = counts.lexicon()
    parts = [_vectors(rows.where(part == k), counts.lexicon(k), "doc_id", "label", "copies") for k in range(PARTS)]
    measured = stored(reduce(DataFrame.unionByName, parts).coalesce(2), "measured").withColumn("label", F.col("label").cast("double"))
    late = PARTS * 3 // 4
    fitted, rest = measured.where(part < late), measured.where(part >= late)
    classes = {r.label for r in fitted.select("label").distinct().collect()}
    if len(classes) < 2:
        return Model(lexicon, constant=max(classes, default=0.0))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, minInstancesPerNode=2).fit(fitted)
    judged = trees.transform(rest).select("label", vector_to_array("probability")[1].alias("chance"))
    calibration = None
    if len({r.label for r in judged.select("label").distinct().collect()}) == 2:
        calibration = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="calibrated").fit(judged)
    return Model(lexicon, trees, calibration)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row (doc_id, text), from the whole text alone.

    A null or empty text has no words and is scored as such. A null doc_id stays null, a
    repeated row is a row again, an empty table gives no rows. Other columns are ignored.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model.constant is not None:
        return docs.select("doc_id", F.lit(model.constant).alias("score"))
    judged = model.trees.transform(_vectors(docs, model.lexicon, "doc_id"))
    judged = judged.select("doc_id", vector_to_array("probability")[1].alias("chance"))
    if model.calibration is None:
        return judged.withColumnRenamed("chance", "score")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated")))
    return model.calibration.transform(judged).select("doc_id", score.alias("score"))
