"""Language identification by interpolated Kneser-Ney character models.

One model for each language, learnt from a bounded sample of labelled rows (``SAMPLE_DOCS`` of each
language in expectation, chosen by a hash of the id; the rows' number in the corpus only sets the
sampling rate).  The n-gram shares and back-off weights of all languages lie in sorted hash arrays
(see ``char_models``), a few megabytes whatever the corpus.  A text's cross-entropy under a language
is its words' negative log-probability per character; the least one decides.

Calibrated rejection: a first model learns without ``HELD`` of the sample and scores those rows.  How far
a text's least cross-entropy lies over the mean of its language, in the language's standard deviations,
is its excess; the limit is the excess that at most ``FALSE_REJECTS`` of texts like those exceed (by
rank among the held-out rows; the largest where these are too few to tell), and ``SLACK`` bits a
character more, as longer tails than the sample's are no other language.  ``accepted`` is false beyond
it, or if there is no letter; such text is unlike every language learnt.  At last the model learns from
the whole sample.  With fewer than two held-out rows nothing with a letter is rejected.

Null, empty or letterless text: ``und``, score 0, not accepted.  Ties: the first language by name.
Very long texts are scored whole.  Without any learnable row every text is ``und``.  An empty table
gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S
from .char_models import ORDER, CharModel, Words, count_grams

SAMPLE_DOCS = 300
HELD = 0.3  # share of the sample that sets the limits
FALSE_REJECTS = 0.005
SLACK = 1.0
SHARPNESS = 8.0  # of the score: odds against a language, in powers of two, for each bit a character more


def sampled(rows: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows of each label, by a hash of the key; the labels' counts set the rates."""
    rate = F.least(F.lit(1.0), F.lit(float(most)) / F.col("count"))
    # a written table, so that its size decides how it is joined
    counts = S.materialize(rows.groupBy(label).count().select(label, rate.alias("__rate")), "rates")
    return rows.join(counts, label).where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.col("__rate") * (1 << 30)).select(*rows.columns)


def entropies(model: CharModel, memory: S.Remembered, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits per character of each text under each class, and the characters counted."""
    words = Words(data, off)
    scores = memory.get(words.distinct, lambda some: model.word_scores(*words.spelled(some)))[words.which]
    n = S.segment_sums((words.end - words.start + 1).astype(np.float64), words.first)
    bits = np.stack([-S.segment_sums(scores[:, c].astype(np.float64), words.first) for c in range(scores.shape[1])], axis=1)
    return bits / np.maximum(n, 1)[:, None], n


class Identifier:
    def __init__(self, model: CharModel | None, limit: np.ndarray | None):
        self.model, self.limit = model, limit

    def memory(self) -> S.Remembered | None:
        return S.Remembered(len(self.model.labels)) if self.model else None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = self.memory()
        for batch in batches:
            yield from self.predicted(batch.column(0), batch.column(1), memory)

    def predicted(self, names: pa.Array, texts: pa.Array, memory: S.Remembered | None) -> Iterator[pa.RecordBatch]:
        data, off = S.byte_view(texts)
        for i, j in S.rounds(off):
            part = data[off[i] : off[j]]
            if not self.model:
                pred, score, ok = ["und"] * (j - i), np.zeros(j - i), np.zeros(j - i, bool)
            else:
                h, n = entropies(self.model, memory, part, off[i : j + 1] - off[i])
                best = h.argmin(axis=1)
                low = h[np.arange(len(h)), best]
                score = 1 / np.exp2(-SHARPNESS * (h - low[:, None])).sum(axis=1)
                for t in np.flatnonzero((n > 0) & ~_ascii_letters(part, off[i : j + 1] - off[i])):
                    if not any(c.isalpha() for c in (texts[i + int(t)].as_py() or "")):
                        n[t] = 0  # only signs beyond ASCII
                ok = (n > 0) & (low <= self.limit[best])
                pred = [self.model.labels[b] if k else "und" for b, k in zip(best, n, strict=True)]
                score = np.where(n > 0, score, 0.0)
            yield pa.RecordBatch.from_arrays([names.slice(i, j - i), pa.array(pred, pa.string()), pa.array(score), pa.array(ok)], ["doc_id", "lang_pred", "score", "accepted"])


def _ascii_letters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    low = S.lower_bytes(data)
    return S.segment_sums(((low >= 97) & (low <= 122)).astype(np.int64), off) > 0


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER, key: str = "doc_id") -> Identifier:
    """Learns from rows whose text and language are known."""
    rows = labelled.select(key, F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna(subset=["text", "lang"])
    held = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1000)) < int(1000 * HELD)
    sample = S.materialize(sampled(rows, "lang", SAMPLE_DOCS, key).withColumn("held", held), "sample")
    counts = count_grams(sample, "lang", order)
    if counts.empty:
        return Identifier(None, None)
    model = CharModel(counts, order)
    return Identifier(model, limits(sample, model.labels, order))


def limits(sample: DataFrame, labels: list[str], order: int = ORDER) -> np.ndarray:
    """The largest cross-entropy that is accepted, by language; ``sample``: (text, lang, held)."""
    limit = np.full(len(labels), np.inf)
    counts = count_grams(sample.where("not held"), "lang", order)
    if counts.empty:
        return limit
    model = CharModel(counts, order)

    def least(batches):
        memory = S.Remembered(len(model.labels))
        for batch in batches:
            data, off = S.byte_view(batch.column("text"))
            for i, j in S.rounds(off):
                h, n = entropies(model, memory, data[off[i] : off[j]], off[i : j + 1] - off[i])
                keep = n > 0
                best = pa.array([model.labels[b] for b in h.argmin(axis=1)[keep]], pa.string())
                yield pa.RecordBatch.from_arrays([best, pa.array(h.min(axis=1)[keep])], ["best", "bits"])

    seen = sample.where("held").select("text").mapInArrow(least, "best string, bits double").toArrow().to_pandas()
    if len(seen) < 2:
        return limit
    of = seen.groupby("best").bits
    whole = seen.bits.std(ddof=0)
    mean, spread = of.mean(), of.std(ddof=0).where(of.size() > 9, whole) + 1e-9
    excess = np.sort(((seen.bits - seen.best.map(mean)) / seen.best.map(spread)).to_numpy())
    rank = min(len(excess), math.ceil((len(excess) + 1) * (1 - FALSE_REJECTS)))
    for k, label in enumerate(labels):
        at, wide = (mean[label], spread[label]) if label in mean.index else (mean.max(), spread.max())
        limit[k] = at + excess[rank - 1] * wide + SLACK
    return limit


def identify(docs: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of each row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        identifier.__call__, "doc_id long, lang_pred string, score double, accepted boolean"
    )


def accepted(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns kept, in the pass that reads them."""
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = identifier.memory()
        for batch in batches:
            found = [b.column("accepted") for b in identifier.predicted(batch.column(text), batch.column(text), memory)]
            yield batch.filter(pa.chunked_array(found, pa.bool_()).combine_chunks())

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    identifier = fit(docs.where(S.crc_mod("doc_id", 4) != 2))
    return identify(docs, identifier).select("doc_id", (S.crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
