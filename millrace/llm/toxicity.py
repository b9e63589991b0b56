"""Toxicity by class-conditional Kneser-Ney models of words and word pairs.

A toxic and an ordinary model are counted on a bounded sample of labelled texts, an
expression once a text, so that a repeated line does not outweigh a text. Both back off
to one shared model, the words' continuation counts (distinct words before them) over
both classes, with one leftover mass, the larger of theirs: a rare expression has the
same probability in both, and unequal sample sizes are no evidence. Discounts are those
of each class for counts of one, two and three or more: of words by leaving one text
out against the shared model, of pairs by the counts of counts.

A text has two features: the excess of its words' log-likelihood ratio, and of its
pairs' over their words', above MARGIN nats (smaller ratios are the classes' unlike
mixture of languages and topics), each divided by the number of tokens plus EXTRA. Their
logistic curve has no negative slope and is fitted on all sample rows, each scored by
models that have not counted it, at the labels' true share.

Rows: null and empty texts have no evidence and get the curve's base score; repeated
rows give one row each; without labels of both kinds every score is 0 (nothing is known
to be toxic); an empty table gives an empty one. Only id and text are inputs of a score;
other columns may clash. Labels other than 0 and 1 are no labels; an id with both, and a
null id, teach nothing. Texts of any length are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import pairwise, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .sampling import fit_rising, sample_by_labels, squash

#: Sampled texts for each label, and parts of the sample for fitting the curve.
PER_LABEL, FOLDS = 2500, 3
#: Log-ratio that a word or pair must exceed, and tokens added to the length.
MARGIN, EXTRA = 1.0, 50
#: Discounts tried, of counts of one, two and three or more.
TRIED = ((0.5, 0.7, 0.8, 0.9, 0.95, 0.99), (0.8, 1.2, 1.6, 1.9, 1.98), (1.0, 1.5, 2.0, 2.5, 2.9))

#: ASCII letters in lower case, digits and bytes of other scripts stay; the rest separates.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def counted_discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney's discounts of counts 0, 1, 2 and more, from the counts of counts."""
    c = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6).astype(float)
    y = c[1] / max(c[1] + 2 * c[2], 1.0)
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * c[k + 1] / c[k] if c[k] else 0.75 * k
        out.append(min(max(d, 0.1 * k), 0.95 * k))
    return np.array(out)


def kept(n: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    """What counts keep after their discount."""
    return n - discounts[np.minimum(n, 3).astype(np.int64)]


def held_out_discounts(n: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The tried discounts under which occurrences are likeliest when each is left out of its count.

    n: a class's counts; shared: the words' probability in the shared model without one occurrence.
    """
    cells, times = np.unique(np.column_stack([n, shared]), axis=0, return_counts=True)
    n, shared, total = cells[:, 0], cells[:, 1], (cells[:, 0] * times).sum()
    best, chosen = -math.inf, np.zeros(4)
    for d in product(*TRIED):
        d = np.array([0.0, *d])
        rest = 1 - (times * kept(n, d)).sum() / total
        likely = (times * n * np.log(np.maximum(kept(n - 1, d) / total + rest * shared, 1e-300))).sum()
        if likely > best:
            best, chosen = likely, d
    return chosen


class KneserNey:
    """log P_toxic - log P_ordinary of words, and of pairs beyond their second word's, above MARGIN."""

    def __init__(self, texts: Iterable[tuple[int, list[bytes]]]):
        vocabulary: dict[bytes, int] = {b"": 0}  # the start of a text
        single, pair = ([], []), ([], [])
        for label, w in texts:
            ids = np.array([0, *(vocabulary.setdefault(x, len(vocabulary)) for x in w)], np.int64)
            single[label].append(np.unique(ids[1:]))
            pair[label].append(np.unique(ids[:-1] << 32 | ids[1:]))
        names, size = list(vocabulary), len(vocabulary)
        n = [np.bincount(np.concatenate(s) if s else np.zeros(0, np.int64), minlength=size).astype(float) for s in single]
        pairs = [np.unique(np.concatenate(p), return_counts=True) if p else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for p in pair]

        before = np.bincount(np.union1d(pairs[0][0], pairs[1][0]) & 0xFFFFFFFF, minlength=size).astype(float)
        total, d = max(before.sum(), 1.0), counted_discounts(before[before > 0])
        unseen = (total - kept(before, d).sum()) / total / size
        self.shared = kept(before, d) / total + unseen

        discounts = [held_out_discounts(c[c > 0], kept(np.maximum(before[c > 0] - 1, 0), d) / total + unseen) if c.any() else np.zeros(4) for c in n]
        left = [kept(c, x) for c, x in zip(n, discounts)]
        rest = max(1 - k.sum() / max(c.sum(), 1.0) for k, c in zip(left, n))
        #: P(word) of the ordinary and the toxic model.
        self.single = [(1 - rest) * k / max(k.sum(), 1e-12) + rest * self.shared for k in left]
        ratio = np.log(self.single[1] / self.single[0])

        keep, seen, of = [], [], []
        for keys, c in pairs:
            k = kept(c.astype(float), counted_discounts(c))
            keep.append(np.bincount(keys >> 32, k, minlength=size)), seen.append(np.bincount(keys >> 32, c, minlength=size)), of.append(k)
        with np.errstate(divide="ignore", invalid="ignore"):
            gone = np.maximum(*(np.where(s > 0, 1 - k / s, 1.0) for k, s in zip(keep, seen)))  # 1 where a class does not know the word before
        keys = pairs[1][0]
        a, b = keys >> 32, keys & 0xFFFFFFFF

        def after(label: int) -> np.ndarray:
            """P(b | a) of the toxic pairs."""
            at = np.minimum(np.searchsorted(pairs[label][0], keys), max(len(pairs[label][0]) - 1, 0))
            has = pairs[label][0][at] == keys if len(pairs[label][0]) else np.zeros(len(keys), bool)
            own = np.where(has, of[label][at], 0.0) if len(of[label]) else np.zeros(len(keys))
            return (1 - gone[a]) * own / np.maximum(keep[label][a], 1e-12) + gone[a] * self.single[label][b]

        beyond = np.log(after(1) / after(0)) - ratio[b]
        self.names = vocabulary
        self.word = {names[i]: float(ratio[i] - MARGIN) for i in np.flatnonzero(ratio > MARGIN)}
        self.pair = {(names[a[i]], names[b[i]]): float(beyond[i] - MARGIN) for i in np.flatnonzero(beyond > MARGIN)}

    def slim(self) -> KneserNey:
        """Without what only the counting needs."""
        del self.names, self.single, self.shared
        return self


def evidence(model: KneserNey, w: list[bytes]) -> tuple[float, float]:
    """The words' and the pairs' excess log-likelihood ratio, by tokens."""
    size = len(w) + EXTRA
    of_words = sum(map(model.word.get, w, [0.0] * len(w)))
    of_pairs = sum(map(model.pair.get, pairwise([b"", *w]), [0.0] * len(w)))
    return of_words / size, of_pairs / size


def feature(model: KneserNey, w: list[bytes]) -> float:
    """Both excesses together."""
    return sum(evidence(model, w))


def judged(fitted: tuple[KneserNey, list[float]], text: bytes) -> float:
    model, (of_words, of_pairs, base) = fitted
    x, y = evidence(model, words(text))
    return squash(of_words * x + of_pairs * y + base)


def fit(docs: DataFrame, labels: DataFrame, held_out, id_col: str, text_col: str, label_col: str, per_label: int):
    """The models and the curve, or None where the labels do not show both classes."""
    rows, share = sample_by_labels(docs, labels, held_out, label_col, id_col, text_col, per_label)
    one: dict[bytes, bytes] = {}  # equal words are one object
    sample = [(label, [one.setdefault(x, x) for x in words((text or "").encode())]) for _, label, text in rows]
    del rows
    place, fold = [0, 0], []
    for label, _ in sample:  # every fold has its part of both labels
        fold.append(place[label] % FOLDS)
        place[label] += 1
    if not all(place):
        return None
    x = np.zeros((len(sample), 2))
    for k in range(FOLDS):
        others = [r for r, f in zip(sample, fold) if f != k]
        if len({label for label, _ in others}) == 2:
            model = KneserNey(others).slim()
            for i, f in enumerate(fold):
                if f == k:
                    x[i] = evidence(model, sample[i][1])
    scale = x.std(0) + 1e-9
    curve = fit_rising(x / scale, np.array([label for label, _ in sample], float), share)
    return KneserNey(sample).slim(), [float(curve[0] / scale[0]), float(curve[1] / scale[1]), curve[2]]


def score(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, per_label: int = PER_LABEL) -> DataFrame:
    """id, held_out, score, predicted for every row. held_out: a boolean column of the id; its rows teach nothing."""
    fitted = fit(docs, labels, held_out, id_col, text_col, label_col, per_label)
    shipped = docs.sparkSession.sparkContext.broadcast(fitted)  # bounded by the sample's size

    def run(batches):
        common.let_go()
        fitted = shipped.value
        for batch in common.slices(batches):
            out = [judged(fitted, t) if fitted else 0.0 for t in common.texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64())], names=[id_col, "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col, held_out.alias("held_out")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, per_label: int = PER_LABEL) -> DataFrame:
    """The rows, with all their columns, whose score stays below the threshold; all labels teach."""
    fitted = fit(docs, labels, F.lit(False), id_col, text_col, label_col, per_label)
    if fitted is None:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        common.let_go()
        for batch in common.slices(batches):
            texts = common.texts_of(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([judged(shipped.value, t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(common.documents(spark, sf_dir), labels, common.remainder("doc_id", 4) == 2)
