"""Packing token streams into sequences by order-preserving dynamic programming.

The documents of a task follow each other in order as one stream of token ids (a document's ids,
then ``END``).  ``f(i)``, the least cost of a packing whose last window ends before token ``i``, is

    f(i) = penalty(i) + min over j in [i - size, i - size + slack] of f(j) + padding(i - j)

with ``padding = size - (i - j)`` and ``penalty`` 0 at a document end, small at a sentence end, larger
elsewhere.  A window never pads more than the largest penalty, since it may be filled and cut there
instead, so ``slack`` is that penalty.  ``f(j) + j`` has to be minimised over a sliding range of
``j``: the monotone queue of that range is kept in blocks of ``size - slack`` positions, within which
no state depends on another, so a block is one step of numpy.  The end of a stream is cut into
sequences of power-of-two lengths, which need no padding.

Each task packs its own streams: nothing is shuffled, and a lost task is simply run again.
Null and empty texts hold just END.  A very long text goes on through many sequences.  Repeated ids
and texts are packed as they come.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S

SIZE = 1024
END = 0
#: Cost, in tokens of padding, of a cut at a sentence end and of one inside a sentence.
SENTENCE_CUT, INNER_CUT = 2, 6
#: Tokens that are packed together at least, before the rest is cut at powers of two.
STREAM_TOKENS = 1 << 19
#: Pieces of text whose ids are remembered at most, for each Python worker.
KNOWN = 1 << 18


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Last bytes of the UTF-8 forms of white space beyond ASCII, and ASCII white space: no cut after these.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), 0x20]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


@lru_cache(1)
def _id_bytes(path: str) -> np.ndarray:
    """Bytes that each id stands for: its byte-level spelling has a character for each byte."""
    vocab = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker: later tasks find the pieces that earlier ones met."""
    return Encoder(path)


class Encoder:
    """Ids of texts.  The byte-level pre-tokens never span from a visible character into white
    space, so a text may be cut there and the pieces encoded on their own, each distinct one once.
    A special string that a text spells is one id, as the tokenizer says; it has no white space."""

    def __init__(self, path: str):
        self.path = path
        self.hash, self.at, self.size, self.hits = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def _keep(self, mask: np.ndarray):
        size = self.size[mask]
        self.ids = self.ids[np.repeat(self.at[mask], size) + S.ramp(size)]
        self.hash, self.size, self.hits, self.at = self.hash[mask], size, self.hits[mask] // 2, np.cumsum(size) - size

    def _learn(self, fresh: np.ndarray, pieces: list[bytes], hits: np.ndarray):
        if len(self.hash) + len(fresh) > KNOWN:  # pieces met once or long ago go
            self._keep(self.hits > 2)
            if len(self.hash) > KNOWN // 2:
                self._keep(np.zeros(len(self.hash), bool))
        # pieces that begin with white space and end in a visible character may be encoded in one go:
        # joining makes no new pre-token; white space at a piece's end would run on into the next
        lead = np.array([p[:1].isspace() and not _NO_CUT[p[-1]] for p in pieces], bool)
        order = np.concatenate([np.flatnonzero(lead), np.flatnonzero(~lead)])
        n = int(lead.sum())
        joined = [b"".join(pieces[k] for k in order[i : min(i + 512, n)]) for i in range(0, n, 512)] + [pieces[k] for k in order[n:]]
        got = _tokenizer(self.path).encode_batch([j.decode("utf-8", "replace") for j in joined], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
        ends = np.cumsum([len(pieces[k]) for k in order])
        upto = np.searchsorted(np.cumsum(_id_bytes(self.path)[ids]), ends, "right")
        size = np.diff(upto, prepend=0)
        at = len(self.ids) + upto - size
        self.ids = np.concatenate([self.ids, ids])
        keys = np.concatenate([self.hash, fresh[order]])
        where = np.argsort(keys)
        self.hash = keys[where]
        self.at, self.size, self.hits = (np.concatenate(x)[where] for x in ((self.at, at), (self.size, size), (self.hits, hits[order])))

    def _unknown(self, keys: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.hash, keys), max(0, len(self.hash) - 1))
        return self.hash[place] != keys if len(self.hash) else np.ones(len(keys), bool)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END; each text's count; whether a sentence may end
        after an id."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = _WHITE[data[1:]] & ~_NO_CUT[data[:-1]]
        cut[off] = True
        edge = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
        start, end = edge, np.append(edge[1:], len(data)) if len(edge) else edge
        key = S.range_hash(S.prefix_hash(data), start, end)
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        new = self._unknown(distinct)
        if new.any():
            raw = data.tobytes()
            self._learn(distinct[new], [raw[start[i] : end[i]] for i in first[new]], np.zeros(int(new.sum()), np.int64))
            new = self._unknown(distinct)
            if new.any():  # pieces that made room
                self._learn(distinct[new], [raw[start[i] : end[i]] for i in first[new]], np.zeros(int(new.sum()), np.int64))
        place = np.searchsorted(self.hash, distinct)
        self.hits[place] += np.bincount(which, minlength=len(distinct))
        size, at = self.size[place][which], self.at[place][which]
        text = np.searchsorted(off, start, "right") - 1  # of each piece
        per_text = np.bincount(text, size, len(off) - 1).astype(np.int64) + 1
        ids = np.full(int(per_text.sum()), END, np.uint32)
        before = np.cumsum(size) - size
        target = np.repeat(before + text, size) + S.ramp(size)  # each earlier text has one END
        ids[target] = self.ids[np.repeat(at, size) + S.ramp(size)]
        stop = np.zeros(len(ids), bool)
        last = before + text + size - 1
        ends = (size > 0) & _STOP[data[np.maximum(end - 1, 0)]] if len(start) else np.zeros(0, bool)
        if len(start):
            nl = np.append(data[start[1:]] == 10, False) & (size > 0)
            ends |= nl
        stop[last[ends]] = True
        return ids, per_text, stop


def sliding_argmin(values: np.ndarray, wide: int) -> np.ndarray:
    """Where the first minimum of each window of ``wide`` values is: the monotone queue as two
    stacks, the running minima from the right end of each run of ``wide`` values and from the left
    end of the next, whose tops are compared."""
    n = len(values)
    bits = max(1, n.bit_length())
    full = -(-n // wide) * wide
    keyed = np.full(full, np.iinfo(np.int64).max, np.int64)
    keyed[:n] = (values << bits) | np.arange(n)
    runs = keyed.reshape(-1, wide)
    push = np.minimum.accumulate(runs, axis=1).reshape(-1)
    pop = np.minimum.accumulate(runs[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - wide + 1
    return np.minimum(pop[:m], push[wide - 1 : wide - 1 + m]) & ((1 << bits) - 1)


def cuts(penalty: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Window ends (token counts) of the cheapest packing of a stream; after the last one less than
    ``size`` tokens are left.  ``penalty[i]``: cost of a cut before token ``i``."""
    n = len(penalty) - 1
    slack = min(int(penalty.max()), size // 2) if n > 0 else 0
    big = np.int64(1) << np.int64(40)
    g = np.full(n + 1 + size, big, np.int64)  # g[size + j] = f(j) + j; states before the start cost too much
    g[size] = 0
    back = np.zeros(n + 1, np.int32)
    for lo in range(size - slack, n + 1, size - slack):
        hi = min(lo + size - slack, n + 1)
        at = np.arange(lo, hi)
        j = lo + sliding_argmin(g[lo : hi + slack], slack + 1) - size
        back[lo:hi] = at - j
        value = g[j + size]
        g[lo + size : hi + size] = np.where(value >= big, big, penalty[lo:hi] + size + value)
    tail = np.arange(max(0, n - size + 1), n + 1)
    left = INNER_CUT * np.bitwise_count(n - tail).astype(np.int64)
    i = int(tail[np.argmin(g[tail + size] - tail + left)])
    out = []
    while i > 0:
        out.append(i)
        i -= int(back[i])
    return np.array(out[::-1], np.int64)


def _rest(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _packer(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        base = TaskContext.get().partitionId() << 33
        made = 0
        waiting: list[tuple] = []
        held = 0

        def flush():
            nonlocal waiting, held, made
            ids = np.concatenate([w[1] for w in waiting])
            counts = np.concatenate([w[2] for w in waiting])
            stop = np.concatenate([w[3] for w in waiting])
            names = pa.concat_arrays([w[0] for w in waiting])
            waiting, held = [], 0
            ends = np.cumsum(counts)
            penalty = np.full(len(ids) + 1, INNER_CUT, np.int64)
            penalty[1:][stop] = SENTENCE_CUT
            penalty[ends] = 0
            penalty[0] = 0
            windows = cuts(penalty, size)
            done = int(windows[-1]) if len(windows) else 0
            edges = np.concatenate([[0], windows, done + np.cumsum(_rest(len(ids) - done))]).astype(np.int64)
            starts = ends - counts
            piece = np.union1d(edges[:-1], starts)
            after = np.append(piece[1:], len(ids))
            doc = np.searchsorted(ends, piece, "right")
            seq = np.searchsorted(edges, piece, "right") - 1
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(piece.tolist(), after.tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(doc)), pa.array(piece - starts[doc]), pa.array(after - piece), pa.array(crc, pa.int64()),
                    pa.array(counts[doc]), pa.array(base + made + seq), pa.array(piece - edges[seq]),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            made += len(edges) - 1
            return out

        for batch in batches:
            data, off = S.byte_view(batch.column(1))
            for i, j in S.rounds(off):
                ids, counts, stop = words.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                waiting.append((batch.column(0).slice(i, j - i), ids, counts, stop))
                held += len(ids)
                if held >= STREAM_TOKENS:
                    yield flush()
        if waiting:
            yield flush()

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece: ``length`` ids of a document from ``start`` on, at ``offset`` of a sequence
    of at most ``size`` (a power of two)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_packer(tokenizer or default_tokenizer(), size), PIECES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
