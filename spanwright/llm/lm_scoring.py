"""LM scoring by online logistic context mixing over the bits of words and of phrases.

A text is a sequence of bits.  First comes its *class* (one of a few kinds of training text, by
language where that is known, each with a model of its own), then its tokens:

* Where a token has three words before it, these are its *phrase context*: one bit says whether the
  next token is the one that always followed there in the training texts, with a probability that an
  adaptive map gives for how often it did.  The text's end is such a token, so after any words the probabilities of all words and the end
  add up to 1.  Every phrase context of the corpus meets all others like it: lists of them, packed in
  ``PACKED`` bytes each, are dealt once by parts of the context's hash, and what comes back are only
  those that foretell something, so no table of phrases is written, shuffled or joined.
* Otherwise the word is one of the text's own earlier words, or it is spelled; how often it is the
  former is learnt online along the text.
* A spelled word's bytes are written in a prefix code of their frequencies.  Each bit is predicted in
  ``CONTEXTS`` hashed contexts (one to three bytes before it and the word's whole beginning, in the
  class and over all classes), from how often 0 and 1 followed there.  The predictions are mixed in
  the logistic domain by weights that a gate chooses (how much is known about the word's beginning,
  and the place in the word), and an adaptive map from mixed prediction and depth refines the result.

Weights and map are learnt online in every task over its part of all training words, each batch
predicted before it is learnt, an occurrence of each word left out, and averaged by an aggregation.

A training text is scored by what the others say: its own phrases are taken out of the counts
(``own``), so a text that occurs twice stands apart from one that occurs once.

Null and empty texts: just the end.  Very long texts are one round each.  Equal texts score alike.
Repeated ids are rows of their own.  An empty table gives no rows; without training rows all counts
are 0.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S

CLASSES = 4  # kinds of training text that have a model of their own; one more for all others
ORDERS = (1, 2, 3)  # bytes before a bit's byte
#: log2 of the slots of each context's table: the orders' and the whole beginning's, one of each for
#: each class, and the whole beginning's over all classes.
BITS = (14, 17, 18, 19, 20)
CONTEXTS = len(BITS)
BLOCKS = 1024  # parts in which bit counts are summed
WORDS_A_TASK = 1 << 19  # distinct words whose bits one task counts
WORDS_AT_ONCE = 1 << 12  # words whose bits are in memory at a time
FREQUENT = 1 << 18  # words whose counts are sent to all tasks; those of the rest are joined
PHRASE = 3  # words of a phrase context
SURE = 8  # a phrase's count beyond which its bit's probability no longer changes
#: Bytes of a phrase context at most: context 6, next token 3 (two that differ look the same once in 2^24), cost 3 (its highest bit: own), step from the
#: text of the one before 2.  The steps and the highest byte of costs are nearly always the same few: these are compressed.
PACKED = 14
LISTED = 1 << 19  # phrase contexts that a task holds before it deals them out
PART_BYTES = 6 << 20  # of text whose phrases are one part, about a million
COST = 1 << 13  # steps of a bit of a cost; 23 bits hold that of 1e-300
PRIOR = 0.3
GATES = 12
LEVELS = 33  # of the adaptive map, over the mixed prediction from -8 to 8
DEPTHS = 16
OWN_WORD, OWN_WORD_WEIGHT = 0.05, 30  # share of the text's earlier words at its start, and its weight in words
END = np.uint64(0x0123456789ABCDEF)  # the hash that stands for a text's end
_SEPARATOR, _STOP = 0x20, 0x03
_U = np.uint64
_SLOTS = np.array([1 << b for b in BITS])
_OWN = int(_SLOTS[:-1].sum())  # slots of a class
_BASE = np.concatenate([[0], np.cumsum(_SLOTS[:-1])[:-1]])
_ALL = _OWN * (CLASSES + 1)  # where the slots over all classes begin
_SIZE = _ALL + int(_SLOTS[-1])


class Texts:
    """Words of a round of texts, lower case, with hashes, counts by distinct word, and spelling."""

    def __init__(self, data: np.ndarray, off: np.ndarray, distinct: bool = True):
        self.bytes = S.lower_bytes(data)
        self.start, self.end, self.first = S.word_bounds(self.bytes, off)
        self.hash = S.range_hash(S.prefix_hash(self.bytes), self.start, self.end)
        if distinct:
            self.distinct, self.index, self.which = np.unique(self.hash, return_index=True, return_inverse=True)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens (a text's words and its end) that a phrase context stands before, its hash, and theirs."""
        n = np.maximum(np.diff(self.first) - PHRASE + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        at = self.first[text] + PHRASE + S.ramp(n)
        total = sum((self.hash[at - k] * _U(0x9E3779B97F4A7C15 * (2 * k + 5) & (2**64 - 1)) for k in range(1, PHRASE + 1)), np.zeros(len(at), _U))
        total = S.mix(total, 71)
        then = np.where(at == self.first[text + 1], END, np.append(self.hash, END)[at])
        return at + text, total, then

    def spelled(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, size = self.start[self.index[some]], (self.end - self.start)[self.index[some]]
        bounds = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(start, size) + S.ramp(size)], bounds


def with_separators(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(bounds)
    out_bounds = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(out_bounds[-1]), _SEPARATOR, np.uint8)
    out[np.repeat(out_bounds[:-1], size) + S.ramp(size)] = data[np.repeat(bounds[:-1], size) + S.ramp(size)]
    return out, out_bounds


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code word and length of each byte by its frequency; bytes that never came have one too."""
    heap = [(float(n) + 1e-3, i, [i]) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    size = np.zeros(256, np.int64)
    made = 256
    while len(heap) > 1:
        (n, _, x), (m, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        size[x + y] += 1
        heapq.heappush(heap, (n + m, made, x + y))
        made += 1
    code, at, last = np.zeros(256, np.int64), 0, 0
    for i in np.lexsort((np.arange(256), size)):
        at <<= int(size[i]) - last
        code[i], last = at, int(size[i])
        at += 1
    return code, size


class Bits:
    """The binary decisions of spelled words, one after the other."""

    def __init__(self, code: tuple[np.ndarray, np.ndarray], symbols: np.ndarray, bounds: np.ndarray, kind: np.ndarray):
        words, size = code
        length = size[symbols]
        self.bounds = np.concatenate([[0], np.cumsum(length)])[bounds]  # of the words
        owner = np.repeat(np.arange(len(symbols)), length)
        self.depth = S.ramp(length)
        left = np.repeat(length, length) - self.depth
        value = np.repeat(words[symbols], length)
        self.bit = (value >> (left - 1)) & 1
        node = ((1 << self.depth) | (value >> left)).astype(_U) * _U(0x9E3779B97F4A7C15)
        at = np.arange(len(symbols))
        place = at - np.repeat(bounds[:-1], np.diff(bounds))
        self.place = np.repeat(np.minimum(place, 2), length)
        sums = S.prefix_hash(symbols)
        context = [S.range_hash(sums, at - np.minimum(place, k), at) + _U(k) for k in ORDERS] + [S.range_hash(sums, at - place, at) + _U(99)]
        start = np.repeat(np.repeat(kind, np.diff(bounds)) * _OWN, length)
        self.at = np.empty((CONTEXTS, len(owner)), np.int64)
        for c, bits in enumerate(BITS):
            h = context[min(c, CONTEXTS - 2)][owner] ^ node
            slot = ((h * _U(0xD6E8FEB86659FD93)) >> _U(64 - bits)).astype(np.int64)
            self.at[c] = slot + (start + _BASE[c] if c < CONTEXTS - 1 else _ALL)


class Mixer:
    """Stretched predictions of all slots, gated weights and the adaptive map."""

    def __init__(self, code: tuple[np.ndarray, np.ndarray], table: np.ndarray):
        self.code = code
        known = table[0] + table[1]
        self.stretch = np.clip(np.log((table[1] + PRIOR) / (table[0] + PRIOR)), -9, 9).astype(np.float16)
        self.known = np.searchsorted([1, 4, 32], known, "right").astype(np.uint8)
        self.weights = np.zeros((GATES, CONTEXTS + 1), np.float32)
        self.weights[:, :CONTEXTS] = (0.1, 0.15, 0.25, 0.3, 0.2)
        self.map = np.zeros((DEPTHS, LEVELS), np.float32)  # added in the logistic domain

    def mixed(self, bits: Bits, x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gate = known * np.int64(3) + bits.place
        weights = self.weights[gate]
        s = weights[:, CONTEXTS].copy()
        for c in range(CONTEXTS):
            s += weights[:, c] * x[c]
        return np.clip(s, -9, 9), gate

    @staticmethod
    def level(s: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(s, -8, 8) + 8) * ((LEVELS - 1) / 16)).astype(np.int64)

    def word_scores(self, symbols: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """log2 probability of each spelled word in its class."""
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(bounds) - 1, WORDS_AT_ONCE):
            edges = bounds[i : i + WORDS_AT_ONCE + 1]
            out.append(self._scored(symbols[edges[0] : edges[-1]], edges - edges[0], kind[i : i + WORDS_AT_ONCE]))
        return np.concatenate(out)

    def _scored(self, symbols: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> np.ndarray:
        bits = Bits(self.code, symbols, bounds, kind)
        s, _ = self.mixed(bits, [self.stretch[at].astype(np.float32) for at in bits.at], self.known[bits.at[CONTEXTS - 2]])
        s += self.map[np.minimum(bits.depth, DEPTHS - 1), self.level(s)]
        cost = np.logaddexp(0, np.where(bits.bit == 1, -s, s))
        return (-np.add.reduceat(cost, bits.bounds[:-1]) / np.log(2)).astype(np.float32)


def _in_order(batches: Iterator[pa.RecordBatch], batch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Spelled words of a task, ``batch`` at a time: symbols, bounds, class and count."""
    for part in batches:
        for i in range(0, part.num_rows, batch):
            some = part.slice(i, batch)
            yield *with_separators(*S.byte_view(some.column("word"))), some.column("kind").to_numpy().astype(np.int64), some.column("n").to_numpy().astype(np.float64)


def _symbol_counts(batches):
    total, pairs = np.zeros(256), np.zeros((CLASSES + 1, 1 << 16))
    for symbols, bounds, kind, n in _in_order(batches, 4 * WORDS_AT_ONCE):
        weight = np.repeat(n, np.diff(bounds))
        total += np.bincount(symbols, weight, 256)
        before = np.concatenate([[_SEPARATOR], symbols[:-1]]).astype(np.int64)
        before[bounds[:-1]] = _SEPARATOR
        at = (np.repeat(kind, np.diff(bounds)) << 16) | (before << 8) | symbols
        pairs += np.bincount(at, weight, pairs.size).reshape(pairs.shape)
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([np.concatenate([total, pairs.ravel()]).tobytes()], pa.binary())], ["block", "counts"])


def _bit_counts(code):
    def run(batches):
        table = np.zeros(2 * _SIZE, np.float32)
        some = False
        for symbols, bounds, kind, n in _in_order(batches, WORDS_AT_ONCE):
            some = True
            bits = Bits(code, symbols, bounds, kind)
            weight = np.repeat(n, np.diff(bits.bounds)).astype(np.float32)
            for at in bits.at:
                np.add.at(table, at + bits.bit * _SIZE, weight)
        if some:
            for k, part in enumerate(np.array_split(table.reshape(2, -1), BLOCKS, axis=1)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.ascontiguousarray(part).tobytes()], pa.binary())], ["block", "counts"])

    return run


def _summed(kind):
    def run(table: pa.Table) -> pa.Table:
        total = 0.0
        for v in table.column("counts"):
            total = total + np.frombuffer(v.as_buffer(), kind).astype(np.float64)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.astype(kind).tobytes()], pa.binary())})

    return run


def _learnt(sent):
    """Online: batches of words, each predicted, then learnt from.  One row of weights with their
    mass, and of the map's hits, for each task."""

    def run(batches):
        code, table = sent.value
        mixer = Mixer(code, table)
        second = np.full((GATES, CONTEXTS + 1), 1e-3)
        all_mass = np.zeros(GATES)
        hits, sums = np.zeros((DEPTHS, LEVELS)), np.zeros((DEPTHS, LEVELS))
        for turn, (symbols, bounds, kind, n) in enumerate(_in_order(batches, 1 << 10)):
            bits = Bits(code, symbols, bounds, kind)
            # one occurrence of the word itself is left out of the counts
            n0, n1 = (np.maximum(table[v][bits.at] - (bits.bit == v), 0) for v in (0, 1))
            x = np.clip(np.log((n1 + PRIOR) / (n0 + PRIOR)), -9, 9)
            s, gate = mixer.mixed(bits, x, np.searchsorted([1, 4, 32], (n0 + n1)[CONTEXTS - 2], "right"))
            weight = np.repeat(n, np.diff(bits.bounds))
            error = (bits.bit - 1 / (1 + np.exp(-s))) * weight
            mass = np.bincount(gate, weight, GATES)
            slope = np.stack([np.bincount(gate, error * (x[c] if c < CONTEXTS else 1), GATES) for c in range(CONTEXTS + 1)], axis=1)
            slope /= np.maximum(mass, 1e-9)[:, None]
            second = 0.98 * second + 0.02 * slope**2
            mixer.weights += (0.02 / (1 + 0.01 * turn) * slope / np.sqrt(second)).astype(np.float32)
            all_mass += mass
            at = np.minimum(bits.depth, DEPTHS - 1) * LEVELS + mixer.level(s)
            hits += np.bincount(at, weight, hits.size).reshape(hits.shape)
            sums += np.bincount(at, weight * bits.bit, hits.size).reshape(hits.shape)
        out = np.concatenate([(mixer.weights * all_mass[:, None]).ravel(), all_mass, hits.ravel(), sums.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([out.tobytes()], pa.binary())], ["block", "counts"])

    return run


def fit(words: DataFrame) -> tuple[Mixer, np.ndarray]:
    """The model of the counted words (word, kind, n), and each class's log2 of byte after byte."""
    spark = words.sparkSession
    blocks = lambda rows, kind: rows.groupBy("block").applyInArrow(_summed(kind), "block long, counts binary").toArrow()
    tasks = -(-words.count() // WORDS_A_TASK)
    words = words.repartition(max(1, tasks), "hash")
    stats = blocks(words.mapInArrow(_symbol_counts, "block long, counts binary"), np.float64)
    stats = np.frombuffer(stats.column("counts")[0].as_buffer(), np.float64) if stats.num_rows else np.zeros(256 + (CLASSES + 1 << 16))
    code = prefix_code(stats[:256])
    pairs = stats[256:].reshape(CLASSES + 1, 256, 256) + 0.01
    pairs = np.log2(pairs / pairs.sum(axis=2, keepdims=True)).reshape(CLASSES + 1, -1).T.astype(np.float32)

    table = np.zeros((2, _SIZE), np.float32)
    edges = np.cumsum([0, *(p.shape[1] for p in np.array_split(table, BLOCKS, axis=1))])
    found = blocks(words.mapInArrow(_bit_counts(code), "block long, counts binary"), np.float32)
    for k, raw in zip(found.column("block").to_pylist(), found.column("counts"), strict=True):
        table[:, edges[k] : edges[k + 1]] = np.frombuffer(raw.as_buffer(), np.float32).reshape(2, -1)
    mixer = Mixer(code, table)
    sent = spark.sparkContext.broadcast((code, table))
    learnt = blocks(words.repartition(max(1, 4 * tasks), "hash").mapInArrow(_learnt(sent), "block long, counts binary"), np.float64)
    sent.destroy()
    if learnt.num_rows:
        weights, mass, hits, sums = np.split(np.frombuffer(learnt.column("counts")[0].as_buffer(), np.float64), np.cumsum([GATES * (CONTEXTS + 1), GATES, DEPTHS * LEVELS]))
        seen = mass > 0
        mixer.weights[seen] = (weights.reshape(GATES, -1)[seen] / mass[seen, None]).astype(np.float32)
        middle = 1 / (1 + np.exp(-(np.arange(LEVELS) * 16 / (LEVELS - 1) - 8)))
        share = (sums.reshape(DEPTHS, -1) + 40 * middle) / (hits.reshape(DEPTHS, -1) + 40)
        mixer.map = (np.log(share / (1 - share)) - np.log(middle / (1 - middle))).astype(np.float32)
    return mixer, pairs


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = S.byte_view(batch.column("text"))
        kinds = batch.column("kind").to_numpy()
        for i, j in S.rounds(off, 2 * S.CHUNK_BYTES, 1 << 20):
            t = Texts(data[off[i] : off[j]], off[i : j + 1] - off[i])
            pair = t.which * (CLASSES + 1) + np.repeat(kinds[i:j], np.diff(t.first))
            pair, n = np.unique(pair, return_counts=True)
            some, kind = pair // (CLASSES + 1), pair % (CLASSES + 1)
            spelled, bounds = t.spelled(some)
            words = pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(spelled.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.distinct[some].view(np.int64)), pa.array(kind.astype(np.int32)), words.cast(pa.binary()), pa.array(n)], ["hash", "kind", "word", "n"]
            )


def count_words(texts: DataFrame) -> DataFrame:
    """(hash, kind, word, n) over all texts (text, kind); one row of the END hash for their ends."""
    words = texts.select("text", "kind").mapInArrow(_counted, "hash long, kind int, word binary, n long")
    ends = texts.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    ends = ends.select(F.lit(int(END)).alias("hash"), F.lit(0).alias("kind"), F.lit(bytes([_STOP])).alias("word"), "n")
    return words.groupBy("hash", "kind").agg(F.min("word").alias("word"), F.sum("n").alias("n")).unionByName(ends)


class Phrases:
    """Phrase contexts of rounds of texts, each with its text, next token and p, as rows (part, first, kind,
    list): the part of the corpus that the context's hash is in, the first text's row, and what the
    list is: asked, and counted where the text is its own (0), only asked (1), only counted (2)."""

    def __init__(self, parts: int, kind: int):
        self.parts, self.kind = parts, kind
        self.held: list[tuple[np.ndarray, ...]] = []
        self.first = self.rows = self.n = 0

    def add(self, row: int, texts: int, owner: np.ndarray, context: np.ndarray, then: np.ndarray, p: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
        """Texts whose rows are numbered from ``row`` on; lists that are full."""
        if self.rows and self.rows + texts > 1 << 16:
            yield from self.flush()
        if not self.rows:
            self.first = row
        cost = np.maximum(np.rint(-np.log2(p) * COST), 0).astype(np.uint32) | own[owner].astype(np.uint32) << np.uint32(23)
        part = ((context >> _U(32)) * _U(self.parts) >> _U(32)).astype(np.int64)
        self.held.append((part, (owner + self.rows).astype("<u2"), context.astype("<u8"), then.astype("<u4"), cost.astype("<u4")))
        self.rows, self.n = self.rows + texts, self.n + len(part)
        if self.n >= LISTED:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if self.n:
            part, *columns = (np.concatenate(x) for x in zip(*self.held, strict=True))
            order = np.argsort(part.astype(np.uint16) if self.parts <= 1 << 16 else part, kind="stable")
            part = part[order]
            text, context, then, cost = (x[order] for x in columns)
            context, then, cost = (x.view(np.uint8).reshape(len(part), -1) for x in (context, then, cost))
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                step = np.diff(text[a:b], prepend=np.uint16(0)).astype("<u2").view(np.uint8).reshape(-1, 2)
                few = pa.compress(b"".join(x.tobytes() for x in (step[:, 0], step[:, 1], cost[a:b, 2])), "zstd", asbytes=True)
                yield int(part[a]), self.first, self.kind, b"".join([np.int32(b - a).astype("<i4").tobytes(), *(x[a:b, :size].tobytes() for x, size in ((context, 6), (then, 3), (cost, 2))), few])
        self.held, self.rows, self.n = [], 0, 0


def unpacked(lists: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Row, context, next token, cost, own and kind of each phrase context of (first, kind, list)."""
    out = []
    for first, kind, raw in lists:
        n, at, columns = int(np.frombuffer(raw, "<i4", 1)[0]), 4, []
        few = np.frombuffer(pa.decompress(memoryview(raw)[4 + 11 * n :], 3 * n, "zstd", asbytes=True), np.uint8).reshape(3, n)
        for size, wide in ((6, 8), (3, 4), (2, 4)):
            x = np.zeros((n, wide), np.uint8)
            x[:, :size] = np.frombuffer(raw, np.uint8, size * n, at).reshape(n, size)
            columns.append(x)
            at += size * n
        columns[-1][:, 2] = few[2]
        context, then, cost = (x.reshape(-1).view(f"<u{x.shape[1]}") for x in columns)
        text = np.cumsum(few[0] + few[1].astype(np.int64) * 256)
        out.append((first + text, context, then, (cost & np.uint32(COST * 1024 - 1)).astype(np.int32), cost >> np.uint32(23) > 0, np.full(n, kind, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def answers(lists: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Of all phrase contexts of a part those that foretell something, by row: row, how often another
    text's phrase said so (1 to SURE), and the cost of the next token if that was foretold, else -1.
    Then the hits and misses that contexts of each such number have among the counted."""
    row, context, then, cost, own, kind = unpacked(lists)
    order = np.argsort(context)
    row, context, then, cost, own, kind = (x[order] for x in (row, context, then, cost, own, kind))
    head = np.concatenate([[True], context[1:] != context[:-1]])
    start, of = np.flatnonzero(head), np.cumsum(head) - 1
    counted = (kind == 2) | ((kind == 0) & own)
    n = np.add.reduceat(counted.astype(np.int64), start)
    lo = np.minimum.reduceat(np.where(counted, then, np.uint32(2**32 - 1)), start)
    hi = np.maximum.reduceat(np.where(counted, then, np.uint32(0)), start)
    sure = lo == hi
    known = np.minimum(n - 1, SURE)
    twice = n > 1
    hits = np.bincount(known[twice & sure], n[twice & sure], SURE + 1)
    misses = np.bincount(known[twice & ~sure], np.where(n == 2, 2, 1)[twice & ~sure], SURE + 1)
    # of two occurrences with different words, each is foretold wrongly by the other
    left = n[of] - own
    told = (kind != 2) & (left > 0) & (sure[of] | (own & (n[of] == 2)))
    cost = np.where(sure[of] & (then == lo[of]), cost, -1)
    told = np.flatnonzero(told)
    told = told[np.argsort(row[told])]
    return row[told], np.minimum(left[told], SURE), cost[told], hits, misses


def _listed(parts: int):
    """Lists of the phrase contexts of training texts that are not scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row = Phrases(parts, 2), 0
        for batch in batches:
            data, off = S.byte_view(batch.column("text"))
            for i, j in S.rounds(off):
                t = Texts(data[off[i] : off[j]], off[i : j + 1] - off[i], False)
                at, context, then = t.phrases()
                owner = np.searchsorted(t.first + np.arange(len(t.first)), at, "right") - 1
                yield from map(_packed, held.add(row, j - i, owner, context, then, np.ones(len(at)), np.ones(j - i, bool)))
                row += j - i
        yield from map(_packed, held.flush())

    return run


_ROW = "row long, doc_id long, n_tokens long, hits long, base double, score double, n_bytes long, n_phrases long, rare array<long>"
_DEALT = f"part int, first long, kind int, list binary, {_ROW}"
_ANSWERED = f"{_ROW}, answers binary, told array<double>"
_ROW_TYPES = {"row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "hits": pa.int64(), "base": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64(), "n_phrases": pa.int64(), "rare": pa.list_(pa.int64())}
_LIST_TYPES = {"part": pa.int32(), "first": pa.int64(), "kind": pa.int32(), "list": pa.binary()}
_ANSWER_TYPES = {"answers": pa.binary(), "told": pa.list_(pa.float64())}


def _batch(types: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    """Rows of some of the columns; the others are null."""
    n = len(next(iter(columns.values())))
    made = {k: x if isinstance(x, pa.Array) else pa.array(x) for k, x in columns.items()}
    return pa.RecordBatch.from_arrays([made[k].cast(t) if k in made else pa.nulls(n, t) for k, t in types.items()], list(types))


def _packed(x: tuple) -> pa.RecordBatch:
    part, first, kind, raw = x
    return _batch(_LIST_TYPES | _ROW_TYPES, part=[part], first=[first], kind=[kind], list=pa.array([raw], pa.binary()))


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: those of texts as they are, those of lists answered part by part."""
    types = _ROW_TYPES | _ANSWER_TYPES
    part, held = None, []

    def answered() -> Iterator[pa.RecordBatch]:
        row, state, cost, hits, misses = answers(held)
        yield _batch(types, answers=pa.array([packed_answers(row, state, cost)], pa.binary()), told=[[*hits.tolist(), *misses.tolist()]])

    for batch in batches:
        listed = batch.column("list").is_valid()
        rows = batch.filter(batch.column("list").is_null())
        if rows.num_rows:
            yield _batch(types, **{k: rows.column(k) for k in _ROW_TYPES})
        batch = batch.filter(listed)
        lists = batch.column("list")
        for i, (k, *x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "first", "kind")), strict=True)):
            if held and k != part:
                yield from answered()
                held = []
            part = k
            held.append((*x, lists[i].as_buffer()))
    if held:
        yield from answered()


def packed_answers(row: np.ndarray, state: np.ndarray, cost: np.ndarray) -> bytes:
    """Sorted rows as steps, state and cost, byte by byte of each, compressed."""
    columns = (np.diff(row, prepend=0).astype("<i8"), state.astype("u1"), cost.astype("<i4"))
    planes = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(row), -1).T).tobytes() for x in columns)
    return np.int64(len(row)).astype("<i8").tobytes() + pa.compress(planes, "zstd", asbytes=True)


def unpacked_answers(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    planes = np.frombuffer(pa.decompress(memoryview(raw)[8:], 13 * n, "zstd", asbytes=True), np.uint8).reshape(13, n)
    row, cost = (np.ascontiguousarray(planes[a:b].T).reshape(-1) for a, b in ((0, 8), (9, 13)))
    return np.cumsum(row.view("<i8")), planes[8], cost.view("<i4")


def _corrected(foretells: list[float]):
    """What the answers add to the log10 probabilities of rows' texts, and how many were foretold."""
    p = np.array(foretells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("answers"):
                row, state, cost = unpacked_answers(raw.as_buffer())
                if not len(row):
                    continue
                hit, h = cost >= 0, p[state]
                more = np.log10(np.where(hit, h * np.exp2(np.maximum(cost, 0) / COST) + 1 - h, 1 - h))  # (h + (1 - h) p) / p, or 1 - h
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                columns = (row[start], np.add.reduceat(more, start), np.add.reduceat(hit.astype(np.int64), start))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "more_score", "n_foretold"])

    return run


def phrase_map(told: DataFrame) -> list[float]:
    """How likely a phrase that came n times (0 to SURE) with one word foretells the next: each of
    its occurrences, and one of those of phrases with several words, is asked of the others.  From rows
    of the parts' hits and misses, ``told``."""
    sums = told.select(F.posexplode("told").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    sums = {r.k: r.x for r in sums.collect()}  # 2 * SURE + 2 rows at most
    hits, misses = ([sums.get(k + d, 0.0) for k in range(SURE + 1)] for d in (0, SURE + 1))
    return [0.0] + [(h + 0.5) / (h + m + 1.0) for h, m in zip(hits[1:], misses[1:], strict=True)]


class Frequent:
    """Counts of the most frequent words and of the texts' end: sorted hashes, counts, all tokens."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(known)
        self.known, self.counts, self.total = known[order], counts[order], total

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[place] == hashes, self.counts[place], 0)


class Tokens:
    """Tokens of a round of texts (each text's words, then its end): the probability of each, and the
    counts of those that are frequent."""

    def __init__(self, model: Model, t: Texts):
        n_words = np.diff(t.first)
        self.first = t.first + np.arange(len(t.first))
        text = np.repeat(np.arange(len(n_words)), n_words)
        at = np.arange(len(t.hash)) + text
        self.at = at  # of the words
        # the class: by byte after byte, of each distinct word once
        quick = model.quick.get(t.distinct, lambda some: model.pair_scores(*with_separators(*t.spelled(some))))
        by_class = np.stack([S.segment_sums(quick[t.which, k].astype(np.float64), t.first) for k in range(quick.shape[1])], axis=1) + model.prior
        kind = by_class.argmax(axis=1)
        self.kind_cost = model.prior[kind] - np.log2(np.exp2(model.prior).sum())
        pair = t.which * np.int64(CLASSES + 1) + kind[text]
        present = np.zeros(len(t.distinct) * (CLASSES + 1), bool)
        present[pair] = True
        which = (np.cumsum(present) - 1)[pair]
        pair = np.flatnonzero(present)
        word, k = pair // (CLASSES + 1), pair % (CLASSES + 1)
        key = S.mix(t.distinct[word] + k.astype(_U), 61)
        order = np.argsort(key)
        spelled = np.empty(len(pair))
        spelled[order] = model.memory.get(key[order], lambda some: model.mixer.word_scores(*with_separators(*t.spelled(word[order[some]])), k[order[some]])[:, None])[:, 0]
        # the text's own words: of the words before, the share that are this one
        same = text * (len(t.distinct) + 1) + t.which
        by = np.argsort(same, kind="stable")
        same = same[by]
        new = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(same) else np.zeros(0, np.int64)
        before = np.zeros(len(by))
        before[by] = np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by))))
        position = S.ramp(n_words)
        earlier, p = before / np.maximum(position, 1), np.exp2(spelled[which])
        # their share of the mixture is learnt along the text
        won = OWN_WORD * earlier / ((1 - OWN_WORD) * p + OWN_WORD * earlier + 1e-300)
        total = np.concatenate([[0], np.cumsum(won)])
        share = (OWN_WORD * OWN_WORD_WEIGHT + total[:-1] - np.repeat(total[t.first[:-1]], n_words)) / (OWN_WORD_WEIGHT + position)
        share = np.where(position > 0, share, 0)
        self.p = np.full(int(self.first[-1]), model.end)
        self.p[at] = np.maximum((1 - model.end) * ((1 - share) * p + share * earlier), 1e-300)
        self.count = np.full(len(self.p), model.frequent.of(np.array([END]))[0])
        self.known = model.frequent.of(t.distinct)[t.which]
        self.count[at] = self.known


class Model:
    """What every task holds: of a size that does not hang on the corpus."""

    def __init__(self, mixer: Mixer, pairs: np.ndarray, prior: np.ndarray, frequent: Frequent, end: float):
        self.mixer, self.pairs, self.prior, self.frequent, self.end = mixer, pairs, prior, frequent, end

    def begin(self) -> Model:
        self.quick, self.memory = S.Remembered(CLASSES + 1, 1 << 18), S.Remembered(1)
        return self

    def pair_scores(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros((0, CLASSES + 1), np.float32)
        before = np.concatenate([[_SEPARATOR], symbols[:-1]]).astype(np.int64)
        before[bounds[:-1]] = _SEPARATOR
        return np.add.reduceat(self.pairs[(before << 8) | symbols], bounds[:-1], axis=0)


def frequent_words(words: DataFrame, total: int, most: int = FREQUENT) -> Frequent:
    """At most ``most`` words: as many steps of the counts' logarithm, from above, as hold no more."""
    steps = words.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().orderBy(F.desc("step")).collect()
    held, least = 0, 1 << 20
    for r in steps:
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r["step"]
    rows = words.where((F.floor(F.log2("n") * 8) >= least) | (F.col("hash") == int(END))).select("hash", "n").toArrow()
    return Frequent(rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy(), total)


def _scored(sent, parts: int, kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value.begin()
        row = TaskContext.get().partitionId() << 40
        held = Phrases(parts, kind)
        for batch in batches:
            data, off = S.byte_view(batch.column("text"))
            own = batch.column("own").to_numpy(zero_copy_only=False)
            for i, j in S.rounds(off):
                t = Texts(data[off[i] : off[j]], off[i : j + 1] - off[i])
                tokens = Tokens(model, t)
                base = S.segment_sums(np.log10(tokens.count + 1.0), tokens.first)
                hits = S.segment_sums((tokens.count > 0).astype(np.int64), tokens.first)
                at, context, follows = t.phrases()
                owner = np.searchsorted(tokens.first, at, "right") - 1
                rare = np.flatnonzero(tokens.known == 0)
                n = j - i
                ends = np.searchsorted(rare, t.first).astype(np.int32)
                score = S.segment_sums(np.log10(tokens.p), tokens.first) + tokens.kind_cost * np.log10(2)
                rows = _batch(
                    _LIST_TYPES | _ROW_TYPES, part=-1 - (row + np.arange(n)) % (1 << 16), row=row + np.arange(n), doc_id=batch.column("doc_id").slice(i, n), n_tokens=np.diff(tokens.first),
                    hits=hits, base=base, score=score, n_bytes=np.diff(off[i : j + 1]), n_phrases=np.bincount(owner, minlength=n), rare=pa.ListArray.from_arrays(pa.array(ends), pa.array(t.hash[rare].view(np.int64))),
                )
                yield rows
                yield from map(_packed, held.add(row, n, owner, context, follows, tokens.p[at], own[i:j]))
                row += n
        yield from map(_packed, held.flush())

    return run


def lm_scores(docs: DataFrame, training: DataFrame, own: Column | None = None, class_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", inside: bool = False) -> DataFrame:
    """Scores of every row of ``docs`` by a model of ``training``: n_tokens, n_known, train_tokens,
    base_score and score (log10), bits_per_byte (of the text's UTF-8 bytes), and how many phrase
    contexts it has and how many foretold the next word.  ``own`` is true for rows that are also in
    ``training``; with ``inside``, ``training`` is just these rows, whose phrases are then listed once.
    ``class_col`` of training holds the texts' kinds, of which the commonest count."""
    text = F.col(text_col).cast("string").alias("text")
    kind = F.lit(CLASSES)
    counts: list[int] = []
    if class_col:
        most = training.groupBy(F.col(class_col).cast("string").alias("c")).count().where("c is not null").orderBy(F.desc("count"), "c").limit(CLASSES).collect()
        for k, r in enumerate(most):
            kind = F.when(F.col(class_col).cast("string") == r.c, k).otherwise(kind)
            counts.append(r["count"])
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text, F.coalesce(own if own is not None else F.lit(False), F.lit(False)).alias("own"))
    training = training.select(text, kind.alias("kind"))
    by_kind = S.materialize(count_words(training), "words")
    words = by_kind.groupBy("hash").agg(F.sum("n").alias("n"))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = by_kind.where(F.col("hash") == int(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    prior = np.log2(np.array(counts + [0] * (CLASSES - len(counts)) + [max(0, ends - sum(counts))]) + 0.5)
    mixer, pairs = fit(by_kind)
    model = Model(mixer, pairs, prior, frequent_words(words, total), (ends + 0.5) / (total + 1.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    parts = 1 + sum(t.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] for t in ([docs] if inside else [docs, training])) // PART_BYTES
    dealt = docs.mapInArrow(_scored(sent, parts, 0 if inside else 1), _DEALT)
    if not inside:
        dealt = dealt.unionByName(training.select("text").mapInArrow(_listed(parts), _DEALT))
    S.collected(docs.sparkSession)
    found = S.materialize(dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_answered, _ANSWERED), "answers")
    sent.destroy()

    foretells = phrase_map(found.where("told is not null"))
    phrases = found.where("answers is not null").select("answers").mapInArrow(_corrected(foretells), "row long, more_score double, n_foretold long")
    phrases = phrases.groupBy("row").agg(F.sum("more_score").alias("more_score"), F.sum("n_foretold").alias("n_foretold"))
    rows = found.where("n_tokens is not null").drop("answers", "told")
    asked = rows.select("row", F.explode("rare").alias("hash")).join(words, "hash").groupBy("row")
    asked = asked.agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("n").alias("more_hits"))
    out = rows.drop("rare").join(asked, "row", "left").join(phrases, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_tokens", (F.col("hits") + F.coalesce("more_hits", zero)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        "score", (-F.col("score") / float(np.log10(2)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
        "n_phrases", F.coalesce("n_foretold", zero).alias("n_foretold"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learnt = S.crc_mod("doc_id", 7) != 2
    scored = lm_scores(docs, docs.where(learnt), learnt, "lang", inside=True)
    return scored.select(
        "doc_id", (S.crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte", "n_phrases", "n_foretold"
    )


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLES: dict[str, str] = {}
