"""Toxicity by class-conditional Kneser-Ney models.

Two models of words, toxic and ordinary, learn from all labelled rows.  A word's count in a class
is the number of its texts (a word that one text repeats tells little), and

    p_class(w) = max(n_class(w) - DISCOUNT, 0) / N_class + left_class * p_shared(w)
    p_shared(w) = max(n(w) - D, 0) / N + D * words / N * p_characters(w)

with ``left`` what the discounts leave.  Below the classes the counts are shared, first of words, then
of characters (``char_models``), so that a rare expression, one of ``DISCOUNT`` texts or fewer in either
class, has the same shares under both and gives no verdict of its own.  A text's features are its
log-likelihood ratio per character and, as a few expressions decide in a long text, the parts of it
above a few thresholds of the words' ratios, per character.  A logistic curve over their square roots,
fitted on three rows in ten, which its models have not seen, gives the score; at last the models learn
from all rows.

Rows are counted, and the curve is fitted, by Spark.  What leaves it are words beyond ``DISCOUNT`` texts and
n-grams of characters, which grow with the vocabulary and not with the rows.  Null, empty and letterless
texts have features 0 and the score of such texts.  Repeated rows score alike.  Very long texts are
scored whole.  Without rows of both labels every score is the share of toxic ones (0 without any).  An
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S
from .char_models import CharModel, Words, count_grams

ORDER = 5
DISCOUNT = 2.0  # texts that are taken from a word's count in a class
ABOVE = (1, 2, 3, 4, 6)  # bits of a word's ratio
RIDGE = 1e-1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, label, n): texts of a round that hold a word, of (label, text)."""
    for batch in batches:
        data, off = S.byte_view(batch.column(1))
        label = batch.column(0).to_numpy()
        for i, j in S.rounds(off):
            words = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            size = max(1, len(words.distinct))
            held = np.unique(words.text * size + words.which)  # once for each text
            kind, n = np.unique(held % size * 2 + label[i:j][held // size], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.distinct[kind // 2].view(np.int64)), pa.array((kind % 2).astype(np.int32)), pa.array(n)], ["word", "label", "n"]
            )


class Models:
    """The log2 ratio of words' probabilities, toxic to ordinary."""

    def __init__(self, words: np.ndarray, n: np.ndarray, total: np.ndarray, distinct: int, once: int, twice: int, characters: CharModel):
        """``n``: texts with each word of ``words`` (sorted), by class; of all words, listed here or
        not: ``total`` by class, how many there are, and how many are in one and in two texts."""
        self.words, self.characters = words, characters
        kept = np.maximum(n - DISCOUNT, 0) / total
        d = once / (once + 2 * twice) if once and twice else 0.5
        self.kept = np.vstack([kept, np.zeros(2)])  # the last row: words that are not listed
        self.shared = np.append(np.maximum(n.sum(axis=1) - d, 0) / total.sum(), 0.0)
        self.left, self.spelled = 1 - kept.sum(axis=0), d * distinct / total.sum()

    def ratios(self, words: Words, some: np.ndarray) -> np.ndarray:
        """Of the chosen distinct words of a round; one column."""
        hashes = words.distinct[some]
        at = np.searchsorted(self.words, hashes)
        inside = np.flatnonzero(at < len(self.words))
        at[inside[self.words[at[inside]] != hashes[inside]]] = len(self.words)
        out = np.full((len(some), 1), np.log2(self.left[1] / self.left[0]))
        listed = np.flatnonzero(at < len(self.words))
        if len(listed):
            spelled = np.exp2(self.characters.word_scores(*words.spelled(some[listed]))[:, 0].astype(np.float64))
            shared = self.shared[at[listed]] + self.spelled * spelled
            p = np.log2(self.kept[at[listed]] + self.left * shared[:, None])
            out[listed, 0] = p[:, 1] - p[:, 0]
        return out


def learn(rows: DataFrame) -> Models | None:
    """Models of rows (label, text); none without words of both labels."""
    by_label = [F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    counts = rows.select(F.col("label").cast("long"), "text").mapInArrow(_counted, "word long, label int, n long").groupBy("word").agg(*by_label)
    counts = S.materialize(counts, "words")
    t = counts.agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("distinct"),
        F.count_if(F.expr("n0 + n1 = 1")).alias("once"), F.count_if(F.expr("n0 + n1 = 2")).alias("twice"),
    ).first()
    if not t.n0 or not t.n1:
        return None
    listed = counts.where(F.greatest("n0", "n1") > DISCOUNT).toArrow()
    word = listed.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    n = np.column_stack([listed.column(c).to_numpy() for c in ("n0", "n1")]).astype(np.float64)
    characters = CharModel(count_grams(rows.withColumn("all", F.lit("all")), "all", ORDER), ORDER)
    S.discard(counts)
    return Models(word[order], n[order], np.array([t.n0, t.n1], np.float64), t.distinct, t.once, t.twice, characters)


def features(model: Models, memory: S.Remembered, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    words = Words(data, off)
    ratio = memory.get(words.distinct, lambda some: model.ratios(words, some))[words.which, 0].astype(np.float64)
    n = np.maximum(S.segment_sums((words.end - words.start + 1).astype(np.float64), words.first), 1)
    parts = [ratio, *(np.maximum(ratio - t, 0) for t in ABOVE)]
    x = np.stack([S.segment_sums(p, words.first) / n for p in parts], axis=1)
    return np.sign(x) * np.sqrt(np.abs(x))


def logistic(rows: DataFrame, n: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights (first the constant) of a ridge logistic curve over ``n`` rows (label, x)."""
    curve = LogisticRegression(featuresCol="x", labelCol="label", regParam=ridge / n, maxIter=200)
    curve = curve.fit(rows.select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("x")))
    return np.array([curve.intercept, *curve.coefficients.toArray()])


class Detector:
    def __init__(self, model: Models | None, curve=None, share: float = 0.0):
        self.model, self.curve, self.share = model, curve, share

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id and features of (doc_id, text)."""
        memory = S.Remembered(1)
        for batch in batches:
            data, off = S.byte_view(batch.column(1))
            for i, j in S.rounds(off):
                x = features(self.model, memory, data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "x"]
                )

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if self.curve is None:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, self.share))], ["doc_id", "score"])
            return
        w = self.curve
        for batch in self.rows(batches):
            x = batch.column(1).values.to_numpy().reshape(batch.num_rows, -1)
            score = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", key: str = "doc_id") -> Detector:
    """Learns from all texts (key, text) that have a label (key, label) of 0 or 1."""
    rows = labels.select(F.col(key).alias("key"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return Detector(None, None, share)
    known = docs.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text")).join(rows.hint("merge"), "key")
    known = S.materialize(known.withColumn("curve", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(10)) < 3), "known")
    models = learn(known.where("not curve"))
    if models is None:
        return Detector(None, None, share)
    detector = Detector(models, None, share)
    seen = S.materialize(known.where("curve").select(F.col("label").cast("long"), "text").mapInArrow(detector.rows, "label long, x array<double>"), "curve")
    toxic, n = seen.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not toxic or toxic == n:
        return Detector(None, None, share)
    detector.curve = logistic(seen, n)
    detector.model = learn(known)
    return detector


def score(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        detector.__call__, "doc_id long, score double"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(S.crc_mod("doc_id", 5) != 0)
    detector = fit(docs.where(S.crc_mod("doc_id", 5) != 0), labels)
    return score(docs, detector).select(
        "doc_id", (S.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
