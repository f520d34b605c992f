"""Helpers of the operators: shared-folder tables, Arrow text buffers, hashing, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.tables import collected, discard, new_folder, recorded, remove, shared_dir  # noqa: F401

#: Bytes of text that are handled by one round of numpy calls; a longer text is a round of its own.
CHUNK_BYTES = 1 << 19
#: Texts in a round at most: 12 bits of a 64-bit sort key name the text, 52 hold the hash.
CHUNK_DOCS = 1 << 12
HASH_BITS = 52


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows where the session has Spark's own number: texts are long, and a
    batch is in memory a few times, in the JVM and in its Python worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later stages restart from files.  The
    shuffle files of a round stay on the executors' disks until the driver's heap is next collected
    and Spark's cleaner sees that nothing refers to them, so that is asked for here."""
    out = tables.written(df, label)
    collected(df.sparkSession)
    return out


def crc_mod(col: str, mod: int):
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each text starts; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count:  # a null may cover bytes: close them up
        size = np.where(np.asarray(col.is_null()), 0, np.diff(off))
        keep = np.repeat(off[:-1], size) + ramp(size)
        return data[keep], np.concatenate([[0], np.cumsum(size)])
    return data[off[0] : off[-1]], off - off[0]


def ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. size-1 for each size, one after the other."""
    sizes = np.asarray(sizes, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def rounds(off: np.ndarray, most: int = CHUNK_BYTES, docs: int = CHUNK_DOCS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``most`` bytes and ``docs`` texts at most; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, min(i + docs, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, min(j, n)
        i = min(j, n)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _UNBASE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OTHER = mix(np.arange(256, dtype=np.uint64), 99)  # values of bytes for a second, independent hash


def prefix_hash(data: np.ndarray, other: bool = False) -> np.ndarray:
    """Running polynomial sums: the hash of any range is one difference and one product."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_OTHER[data] if other else data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, off: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (or runs of ``inside``), and the words
    before each text."""
    if inside is None:
        inside = ~_SEPARATOR[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cut = off[(off > 0) & (off < len(data))]
        before[cut] = False
        after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``; empty ranges give 0."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sliding_min(keyed: np.ndarray, wide: int) -> np.ndarray:
    """The minimum of each window of ``wide`` values, from running minima of runs of that length."""
    n = len(keyed)
    full = np.full(-(-n // wide) * wide, np.iinfo(keyed.dtype).max, keyed.dtype)
    full[:n] = keyed
    runs = full.reshape(-1, wide)
    push = np.minimum.accumulate(runs, axis=1).reshape(-1)
    pop = np.minimum.accumulate(runs[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = max(0, n - wide + 1)
    return np.minimum(pop[:m], push[wide - 1 : wide - 1 + m])


class Remembered:
    """Rows of numbers by 64-bit key, kept in a Python worker from one round of words to the next;
    when full, keys that were met once or long ago go."""

    def __init__(self, width: int, most: int = 1 << 19):
        self.width, self.most = width, most
        self.keys, self.rows, self.hits = np.zeros(0, np.uint64), np.zeros((0, width), np.float32), np.zeros(0, np.int32)

    def get(self, keys: np.ndarray, make) -> np.ndarray:
        """Rows of distinct sorted ``keys``; ``make(indices)`` gives those of unknown ones."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty((len(keys), self.width), np.float32)
        out[known] = self.rows[place[known]]
        self.hits[place[known]] += 1
        fresh = np.flatnonzero(~known)
        if len(fresh):
            out[fresh] = make(fresh)
            if len(self.keys) + len(fresh) > self.most:
                stay = self.hits > 1
                if stay.sum() > self.most // 2:
                    stay[:] = False
                self.keys, self.rows, self.hits = self.keys[stay], self.rows[stay], self.hits[stay] // 2
            place = np.searchsorted(self.keys, keys[fresh])
            self.keys = np.insert(self.keys, place, keys[fresh])
            self.rows = np.insert(self.rows, place, out[fresh], axis=0)
            self.hits = np.insert(self.hits, place, 0)
        return out


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that links reach.  Alternating large and small
    stars; each round is written to the shared folder.  A node with very many links is only ever
    aggregated (map side first) or joined, never gathered."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "links")
    state = _digest(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        nxt = materialize(small, "links")
        discard(e)
        e, was, state = nxt, state, _digest(nxt)
        if state == was:
            break
    # every edge is now (node, root)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
