"""Quality classification by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words.  Every passage is encoded (shares of character
kinds, word lengths, repetition), standardised and passed through a small layer; gated attention,

    a_i = softmax over the bag of w . (tanh(V h_i) * sigmoid(U h_i)),

weighs the passages, and the weighed sum of their representations is scored.  Only documents have
labels: the weights, encoder layer, attention and scorer are learnt together from them.

Training reads a bounded sample of labelled rows (``SAMPLE_ROWS`` of each label in expectation, by a
hash of the id), in the order of that hash until the rows of a label hold ``SAMPLE_PASSAGES`` passages.
Of each row that is drawn every passage is learnt from, and scoring reads every passage.  Null, empty and wordless texts are one passage of zeros.  Repeated rows score
alike.  Without rows of both labels every score is the share of label 1 (0 without any).  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shared as S

PASSAGE = 64
SAMPLE_ROWS, SAMPLE_PASSAGES = 1500, 50_000  # of each label
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY = 400, 0.02, 1e-4
SEED = 3

_KIND = np.full(256, 6, np.uint8)  # other signs
for _k, _span in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:'\"()-")):
    _KIND[[ord(c) for c in _span]] = _k
_KIND[[ord(c) for c in "!?"]] = 7
_KIND[128:] = 8
KINDS = 9
WIDTH = KINDS + 8


def encode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, text after text, and the passages before each text."""
    start, end, first = S.word_bounds(data, off)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(n_pass)])
    a = np.repeat(first[:-1], n_pass) + S.ramp(n_pass) * PASSAGE  # first word of each passage
    b = np.minimum(a + PASSAGE, np.repeat(first[1:], n_pass))
    words = (b - a).astype(np.float64)
    x = np.zeros((len(a), WIDTH), np.float32)
    full = np.flatnonzero(words > 0)
    if not len(full):
        return x, bounds
    lo, hi = start[a[full]], end[b[full] - 1]
    size = np.maximum(hi - lo, 1).astype(np.float64)
    kind = _KIND[data]
    for k in range(KINDS):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        x[full, k] = (total[hi] - total[lo]) / size
    length = (end - start).astype(np.float64)
    low = S.lower_bytes(data)
    word = S.range_hash(S.prefix_hash(low), start, end)
    again = np.zeros(len(word))
    again[1:] = word[1:] == word[:-1]
    again2 = np.zeros(len(word))
    again2[2:] = word[2:] == word[:-2]
    passage = np.repeat(np.arange(len(a)), (b - a).clip(0))
    order = np.lexsort((word, passage))
    new = np.ones(len(word))
    new[1:] = (word[order][1:] != word[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order], new, len(a))
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    order = np.lexsort((word, text_of))
    once = np.ones(len(word))
    once[1:] = (word[order][1:] != word[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
    fresh = np.empty(len(word))
    fresh[order] = once  # first time in the text
    capital, sign = kind[start] == 1, (kind[end - 1] == 6) | (kind[end - 1] == 7)

    def mean(v):
        total = np.concatenate([[0], np.cumsum(v)])
        return (total[b[full]] - total[a[full]]) / words[full]

    x[full, KINDS] = np.log1p(mean(length))
    x[full, KINDS + 1] = np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)) / 8
    x[full, KINDS + 2] = mean(again)
    x[full, KINDS + 3] = mean(again2)
    x[full, KINDS + 4] = distinct[full] / words[full]
    x[full, KINDS + 5] = mean(fresh)
    x[full, KINDS + 6] = mean(capital)
    x[full, KINDS + 7] = mean(sign)
    return x, bounds


class Attention:
    """The network: parameters, a forward pass over bags, and its gradients."""

    def __init__(self, width: int, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.mean, self.spread = np.zeros(width, np.float32), np.ones(width, np.float32)
        shapes = {"w1": (width, HIDDEN), "b1": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (r.normal(0, s[0] ** -0.5, s) if k not in ("b1", "d") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict:
        p = self.p
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.maximum(x @ p["w1"] + p["b1"], 0)
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["w"]
        size = np.diff(bounds)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bounds[:-1]), size))
        a = e / np.repeat(np.add.reduceat(e, bounds[:-1]), size)
        z = np.add.reduceat(a[:, None] * h, bounds[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["d"][0], "size": size}

    def gradients(self, f: dict, bounds: np.ndarray, slope: np.ndarray) -> dict:
        """``slope``: of the loss by each bag's logit."""
        p, size = self.p, f["size"]
        dz = np.repeat(slope[:, None] * p["c"], size, axis=0)
        dh = f["a"][:, None] * dz
        da = (f["h"] * dz).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, bounds[:-1]), size))
        both = de[:, None] * p["w"]
        dt, dg = both * f["g"] * (1 - f["t"] ** 2), both * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["v"].T + dg @ p["u"].T) * (f["h"] > 0)
        return {
            "w1": f["x"].T @ dh, "b1": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg,
            "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ slope, "d": np.array([slope.sum()]),
        }

    def train(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, steps: int = STEPS) -> None:
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + np.float32(1e-3)
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            f = self.forward(x, bounds)
            slope = ((1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) * weight).astype(np.float32)
            for k, d in self.gradients(f, bounds, slope).items():
                d = d + DECAY * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = S.byte_view(batch.column("text"))
        for i, j in S.rounds(off):
            x, bounds = encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
            flat = pa.ListArray.from_arrays(pa.array(bounds * WIDTH, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("label").slice(i, j - i), flat], ["id", "label", "x"])


class Scorer:
    def __init__(self, net: Attention | None, share: float):
        self.net, self.share = net, share

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = S.byte_view(batch.column(1))
            for i, j in S.rounds(off):
                score, most = np.full(j - i, self.share), np.zeros(j - i, np.int64)
                if self.net:
                    x, bounds = encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    f = self.net.forward(x, bounds)
                    score = 1 / (1 + np.exp(-np.clip(f["logit"].astype(np.float64), -30, 30)))
                    order = np.lexsort((f["a"], np.repeat(np.arange(j - i), f["size"])))
                    most = order[bounds[1:] - 1] - bounds[:-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array(most)], ["doc_id", "score", "top_passage"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", key: str = "doc_id") -> Scorer:
    """Learns from texts (key, text) and their labels (key, label) of 0 or 1.  Labels are sampled
    first, so the side that meets the texts has a bounded size and is broadcast."""
    rows = labels.select(F.col(key).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return Scorer(None, share)
    rate = F.when(F.col("label") == 1, min(1.0, SAMPLE_ROWS / counts[1])).otherwise(min(1.0, SAMPLE_ROWS / counts[0]))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate * (1 << 30))
    sample = docs.select(F.col(key).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    bags = sample.mapInArrow(_bags, "id long, label int, x array<float>")
    drawn = W.partitionBy("label").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id", F.xxhash64("x"))
    bags = bags.withColumn("before", F.sum(F.size("x")).over(drawn.rowsBetween(W.unboundedPreceding, -1)))
    bags = bags.where(F.coalesce("before", F.lit(0)) < SAMPLE_PASSAGES * WIDTH).select("id", "label", "x")
    bags = bags.toArrow().sort_by([("id", "ascending"), ("label", "ascending")]).combine_chunks()
    y = bags.column("label").to_numpy().astype(np.float32)
    if not 0 < y.sum() < len(y):
        return Scorer(None, share)
    x = bags.column("x").combine_chunks() if isinstance(bags.column("x"), pa.ChunkedArray) else bags.column("x")
    bounds = (np.asarray(x.offsets) - np.asarray(x.offsets)[0]) // WIDTH
    net = Attention(WIDTH)
    net.train(x.flatten().to_numpy().reshape(-1, WIDTH), bounds, y)
    net.p["d"] = net.p["d"] + np.float32(np.log(share / (1 - share)))  # trained with both labels of equal weight
    return Scorer(net, share)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, top_passage): the passage that the attention weighs most."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        scorer.__call__, "doc_id long, score double, top_passage long"
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(S.crc_mod("doc_id", 4) != 2)
    scorer = fit(docs, labels)
    return score(docs, scorer).select(
        "doc_id", (S.crc_mod("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "top_passage"
    )


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
