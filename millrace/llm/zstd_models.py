"""Two compression classifiers: text quality and language.

Both build one raw-content zstandard dictionary per class from a bounded sample of
labelled texts and compress every whole text with each; the class whose dictionary
makes the text smallest explains it best.

* Quality: the size difference of the bad and the good dictionary, normalised by both
  sizes and by the text's length, goes through a logistic curve fitted on sample rows
  that are in neither dictionary, at the labels' true share.
* Language: the smallest size wins; the score is a soft-min over sizes per byte, and
  `rejected` marks texts whose two best sizes are within `margin` of each other.

Rows: null and empty texts are scored as no bytes (quality: the curve at zero;
language: `und`, score 0); texts without a letter are `und`; ties between languages go
to the first name in sorted order; repeated rows give one row each; without any
labelled row quality is 0.5 and language `und`; an empty table gives an empty one. Only
the named columns are read, so others may clash. A null or unlearned label is no label;
an id with both quality labels, or a null id, teaches nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .sampling import fit_logistic, labelled_sample, sample_by_labels, squash

#: Bytes of one dictionary; the sampled texts share it evenly, with so many bytes each at least.
DICT_BYTES = 512 * 1024
SHARE_BYTES = 64
LEVEL = 6
#: Size differences in hundredths count up to here, so that copies of a dictionary text do not bend the curve.
FAR = 4.0
#: Sampled texts for each label: the first part fills dictionaries, the rest calibrates.
PER_LABEL = 1600
#: Relative size difference of the best two languages below which a text is rejected.
MARGIN = 0.01

_LETTER = regex.compile(r"\p{L}")


def build_dictionary(texts: list[bytes], most: int = DICT_BYTES) -> bytes:
    """Raw content: an even share of each sampled text, from a place that moves on from text to text.

    What short texts leave of their share goes to longer ones; no text is left out.
    """
    share, room = [0] * len(texts), most
    for left, i in zip(range(len(texts), 0, -1), sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        share[i] = min(len(texts[i]), max(room // left, SHARE_BYTES))
        room -= share[i]
    parts = []
    for i, (text, n) in enumerate(zip(texts, share)):
        at = i * 7919 % max(1, len(text) - n)
        parts.append(text[at:at + n])
    return b"\n".join(reversed(parts))


class Sizer:
    """Compressed sizes of a text under each class's dictionary."""

    def __init__(self, dictionaries: list[bytes], level: int = LEVEL):
        self.tools = []
        for content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if d is not None:
                d.precompute_compress(level=level)
            self.tools.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: bytes) -> list[int]:
        return [len(c.compress(text)) for c in self.tools]


def size_difference(sizes: list[int], n_bytes: int) -> tuple[float, float]:
    """bad - good as hundredths of both sizes and of the text: above zero where the good dictionary fits better."""
    bad, good = sizes
    of_sizes, of_text = 100 * (bad - good) / (bad + good), 100 * (bad - good) / max(n_bytes, 1)
    return min(max(of_sizes, -FAR), FAR), min(max(of_text, -FAR), FAR)


def quality(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, per_label: int = PER_LABEL) -> DataFrame:
    """id, held_out, score, predicted. held_out: a boolean column; its rows teach nothing."""
    docs = docs.select(id_col, text_col)
    rows, share = sample_by_labels(docs, labels, held_out, label_col, id_col, text_col, per_label)
    sample = [(label, (text or "").encode()) for _, label, text in rows]
    by = {k: [t for label, t in sample if label == k] for k in (0, 1)}
    dictionaries, curve = [b"", b""], None
    if all(by.values()):
        cut = {k: max(1, len(v) // 2) for k, v in by.items()}
        dictionaries = [build_dictionary(by[k][:cut[k]]) for k in (0, 1)]
        sizer = Sizer(dictionaries)
        rest = [(size_difference(sizer(t), len(t)), k) for k in (0, 1) for t in by[k][cut[k]:] or by[k]]
        x, y = np.array([r[0] for r in rest]), np.array([r[1] for r in rest], float)
        curve = [float(w) for w in fit_logistic(x, y, share)]

    def run(batches):
        sizer = Sizer(dictionaries)
        for batch in common.slices(batches):
            texts = common.texts_of(batch.column(1))
            scores = [0.5] * len(texts)
            if curve is not None:
                differences = [size_difference(sizer(t), len(t)) for t in texts]
                scores = [squash(curve[0] * a + curve[1] * b + curve[2]) for a, b in differences]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], names=[id_col, "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col, held_out.alias("held_out")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def language(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = PER_LABEL, margin: float = MARGIN) -> DataFrame:
    """id, held_out, lang_pred, score, rejected."""
    train = docs.select(id_col, text_col, F.col(lang_col).alias("_lang")).where(~held_out & F.col("_lang").isNotNull() & F.col(text_col).isNotNull())
    sample = labelled_sample(train, "_lang", id_col, text_col, per_label)
    names = sorted({r[1] for r in sample})
    dictionaries = [build_dictionary([r[2].encode() for r in sample if r[1] == name]) for name in names]

    def judge(text: str | None, sizer: Sizer) -> tuple[str, float, bool]:
        if not text or not names or not _LETTER.search(text):
            return "und", 0.0, True
        raw = text.encode()
        sizes = sizer(raw)
        best = min(range(len(names)), key=sizes.__getitem__)
        rate = 200.0 / len(raw) if len(raw) > 200 else 1.0
        score = 1 / sum(math.exp(-min(rate * (s - sizes[best]), 50.0)) for s in sizes)
        second = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] * 2)
        return names[best], score, second - sizes[best] < margin * second

    def run(batches):
        sizer = Sizer(dictionaries)
        for batch in common.slices(batches):
            out = [judge(t, sizer) for t in batch.column(1).to_pylist()]
            cols = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=[id_col, "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, held_out.alias("held_out")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def query_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(common.documents(spark, sf_dir), labels, common.remainder("doc_id", 5) == 0)


def query_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(common.documents(spark, sf_dir), common.remainder("doc_id", 3) == 1)
