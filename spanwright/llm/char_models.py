"""Interpolated Kneser-Ney character models of words, in sorted hash arrays.

Characters are UTF-8 code units, lower case.  A word is a run of letters; its characters and its
end are predicted from up to ``ORDER - 1`` characters before, none earlier than the word's start:

    p_k(c | h) = max(count(hc) - D, 0) / count(h) + D * types(h) / count(h) * p_{k-1}(c | h')

Counts of the highest order, and of n-grams at a word's start, are occurrences; those of lower
orders are the number of different characters before the n-gram.  Several classes share the arrays:
one sorted array of 64-bit n-gram hashes with a column of discounted shares for each class, and one
of context hashes with the columns of back-off weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

ORDER = 5
_START, _END = 1, 2
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes (ASCII and Latin-1 letters) and which of them belong to words."""
    low = S.lower_bytes(data)
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 0x20
    return low, _LETTER[low]


class Words:
    """Words of a round of texts: bounds, hashes, and which text each belongs to."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.bytes, inside = letters(data)
        self.start, self.end, self.first = S.word_bounds(self.bytes, off, inside)
        self.hash = S.range_hash(S.prefix_hash(self.bytes), self.start, self.end)
        self.distinct, self.index, self.which = np.unique(self.hash, return_index=True, return_inverse=True)
        self.text = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def spelled(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the chosen distinct words, each with its start and end marker, and their bounds."""
        start, size = self.start[self.index[some]], (self.end - self.start)[self.index[some]]
        bounds = np.concatenate([[0], np.cumsum(size + 2)])
        out = np.full(int(bounds[-1]), _END, np.uint8)
        out[bounds[:-1]] = _START
        out[np.repeat(bounds[:-1] + 1, size) + S.ramp(size)] = self.bytes[np.repeat(start, size) + S.ramp(size)]
        return out, bounds


def grams(symbols: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-grams that end at each predicted symbol and of their contexts, and where
    the symbols are; only where k - 1 symbols of the word come before."""
    place = np.arange(len(symbols)) - np.repeat(bounds[:-1], np.diff(bounds))
    at = np.flatnonzero(place >= max(1, k - 1))
    sums = S.prefix_hash(symbols)
    return S.range_hash(sums, at - k + 1, at + 1), S.range_hash(sums, at - k + 1, at), at


def _counter(order: int, label: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = S.byte_view(batch.column("text"))
            group = np.array(batch.column(label).to_pylist(), object)
            for i, j in S.rounds(off):
                words = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for name in set(group[i:j]):
                    mine = words.which[np.isin(words.text, np.flatnonzero(group[i:j] == name))]
                    some, times = np.unique(mine, return_counts=True)
                    symbols, bounds = words.spelled(some)
                    owner = np.repeat(np.arange(len(some)), np.diff(bounds))
                    sums = S.prefix_hash(symbols)
                    for k in range(1, order + 1):
                        gram, context, at = grams(symbols, bounds, k)
                        rest = S.range_hash(sums, at - k + 2, at + 1)
                        first = symbols[at - k + 1] == _START
                        frame = pd.DataFrame({"gram": gram.view(np.int64), "context": context.view(np.int64), "rest": rest.view(np.int64), "first": first, "n": times[owner[at]]})
                        frame = frame.groupby(["gram", "context", "rest", "first"], as_index=False).n.sum()
                        yield pa.RecordBatch.from_pandas(frame.assign(label=str(name), k=np.int32(k))[["label", "k", "gram", "context", "rest", "first", "n"]], preserve_index=False)

    return run


def count_grams(docs: DataFrame, label: str, order: int = ORDER) -> pd.DataFrame:
    """N-gram counts by class: columns label, k, gram, context, rest, first, n."""
    rows = docs.select("text", F.col(label).cast("string").alias(label)).mapInArrow(
        _counter(order, label), "label string, k int, gram long, context long, rest long, first boolean, n long"
    )
    return rows.groupBy("label", "k", "gram", "context", "rest", "first").agg(F.sum("n").alias("n")).toArrow().to_pandas()


class CharModel:
    """``log2`` probabilities of words under each class."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER, shared_below: int = 0):
        """Orders below ``shared_below`` pool the counts of all classes."""
        self.labels = sorted(counts.label.unique())
        self.order = order
        self.levels = []
        for k in range(1, order + 1):
            own = counts[counts.k == k]
            up = counts[counts.k == k + 1]
            columns = []
            for label in self.labels:
                mine = own if k < shared_below else own[own.label == label]
                mine = mine.groupby("gram").agg(context=("context", "first"), first=("first", "first"), n=("n", "sum"))
                if k < order:  # how many different characters come before
                    more = (up if k < shared_below else up[up.label == label]).drop_duplicates("gram").groupby("rest").size()
                    seen = more.reindex(mine.index).fillna(0).to_numpy()
                    mine["n"] = np.where(mine["first"], mine["n"], np.maximum(seen, 1))
                n = mine.n.to_numpy(float)
                ones, twos = (n == 1).sum(), (n == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                total = mine.groupby("context").n.agg(["sum", "size"])
                share = np.maximum(n - d, 0) / total["sum"].reindex(mine.context).to_numpy()
                columns.append((mine.index.to_numpy(), share, total.index.to_numpy(), (d * total["size"] / total["sum"]).to_numpy()))
            grams_, contexts = (np.unique(np.concatenate([c[i] for c in columns]).astype(np.int64).view(np.uint64)) for i in (0, 2))
            a, w = np.zeros((len(grams_), len(columns)), np.float32), np.ones((len(contexts), len(columns)), np.float32)
            for c, (g, share, h, weight) in enumerate(columns):
                a[np.searchsorted(grams_, g.astype(np.int64).view(np.uint64)), c] = share
                w[np.searchsorted(contexts, h.astype(np.int64).view(np.uint64)), c] = weight
            self.levels.append((grams_, a, contexts, w))

    def word_scores(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        p = np.full((len(symbols), len(self.labels)), 1 / 256, np.float32)
        for k, (grams_, a, contexts, w) in enumerate(self.levels, 1):
            gram, context, at = grams(symbols, bounds, k)
            i, j = np.searchsorted(contexts, context), np.searchsorted(grams_, gram)
            i, j = np.minimum(i, len(contexts) - 1), np.minimum(j, len(grams_) - 1)
            q = p[at] * np.where((contexts[i] == context)[:, None], w[i], 1)
            p[at] = q + np.where((grams_[j] == gram)[:, None], a[j], 0)
        p[bounds[:-1]] = 1  # the start marker is given
        return np.add.reduceat(np.log2(p), bounds[:-1], axis=0) if len(bounds) > 1 else np.zeros((0, len(self.labels)), np.float32)
