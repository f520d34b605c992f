"""Cross-tokenizer alignment: which tokens of one vocabulary lie over which of another.

Both tokenizers spell the same bytes, so a text's alignment is the merge of two sorted lists, the byte
offsets where A tokens end and where B tokens end.  **Merge path**: over the two lists of a round of
texts a binary search on each of many equally spaced diagonals finds how many A ends and how many B
ends lie before it, which divides the merge into independent pieces of equal work (:func:`merge_path`).
A piece merges its own ends and emits an overlap (a link of an A and a B token) for each distinct end;
ends of both kinds at one offset cut groups, and the running count of cuts, carried from piece to
piece, stitches the groups that lie over a boundary.

A text's links are then weighed by how often the corpus links their two ids.  A task gathers the
distinct pairs of a block of texts (BLOCK_BYTES, or one longer text); pairs are summed map side first,
and come back to the blocks they are in by one join on the pair, which each block names once, so that
no pair is a hot key however common it is.  Only blocks, of bounded size, meet in one task.

Texts are cut where a space follows a visible character: no token of either vocabulary reaches over
such a place (:func:`_cuttable`, checked for B when it is loaded), so each distinct stretch is encoded once
for each worker.  A null or empty text has no tokens, nor has one that a tokenizer does not spell
byte for byte (a text with U+2581, which B writes as a space).  Repeated and null ids keep their rows.
A very long text is a block of its own.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing
from . import shared as S

#: Bytes of text in a block at most, unless one text alone has more.
BLOCK_BYTES = 1 << 20
#: Ends that a piece of the merge holds.
PIECE = 1 << 14
#: Stretches of text whose ids are remembered at most, for each Python worker.
KNOWN = 1 << 17
SPACE = "▁"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _cuttable(pieces: list[str]) -> bool:
    """Whether no piece has the mark of a space after another character."""
    return not any(SPACE in p.lstrip(SPACE) for p in pieces)


class Tokenizers:
    """Ids of stretches by both tokenizers, remembered by a 64-bit hash of the stretch."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab()
        self.len_a = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.len_a[i] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if not _cuttable(names):
            raise ValueError("a piece of the second vocabulary goes on after a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.lone_space = self.b.piece_to_id(SPACE)
        self._clear()

    def _clear(self):
        self.hash = np.zeros(0, np.uint64)
        self.good = np.zeros(0, bool)
        self.at, self.size = np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]

    def _encode_b(self, stretches: list[bytes]) -> list[list[int]]:
        """B puts a space before what it encodes, so the stretch's own first one is left off; nothing
        at all would get none."""
        ids = self.b.encode([s[1:].decode() for s in stretches], num_threads=1)
        return [x if len(s) > 1 else [self.lone_space] for x, s in zip(ids, stretches, strict=True)]

    def _spells(self, ids: list[int], text: bytes) -> bool:
        return b"".join([self.bytes_b[i] for i in ids]) == text

    def _learn(self, keys: np.ndarray, stretches: list[bytes], joins: np.ndarray):
        """``joins``: stretches that end in a visible character, which may be encoded in one go."""
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        n = int(joins.sum())
        runs = [order[i : min(i + 512, n)] for i in range(0, n, 512)] + [order[i : i + 1] for i in range(n, len(order))]
        joined = [b"".join([stretches[k] for k in run]) for run in runs]
        wide = np.array([len(stretches[k]) for k in order], np.int64)
        good = np.ones(len(order), bool)
        ids_a = np.concatenate([np.array(e.ids, np.int32) for e in self.a.encode_batch([j.decode() for j in joined], add_special_tokens=False)])
        got, done = [], 0
        for run, text, ids in zip(runs, joined, self._encode_b(joined), strict=True):
            if not self._spells(ids, text):
                each = self._encode_b([stretches[k] for k in run])
                fine = [self._spells(x, stretches[k]) for x, k in zip(each, run, strict=True)]
                good[done : done + len(run)] = fine
                # what is not spelled out gets as many empty ids as it has bytes, to keep the count
                ids = [i for x, k, ok in zip(each, run, fine, strict=True) for i in (x if ok else [-1] * len(stretches[k]))]
            got.append(np.array(ids, np.int32))
            done += len(run)
        ids_b = np.concatenate(got)
        ends = np.cumsum(wide)
        at, size = [], []
        for k, (ids, length) in enumerate(((ids_a, self.len_a), (ids_b, np.append(self.len_b, 1)))):
            upto = np.searchsorted(np.cumsum(length[ids]), ends, "right")
            n_ids = np.diff(upto, prepend=0)
            at.append(len(self.ids[k]) + upto - n_ids)
            size.append(n_ids)
            self.ids[k] = np.concatenate([self.ids[k], ids])
        keys = np.concatenate([self.hash, keys[order]])
        where = np.argsort(keys)
        self.hash, self.good = keys[where], np.concatenate([self.good, good])[where]
        self.at = np.concatenate([self.at, np.stack(at, axis=1)])[where]
        self.size = np.concatenate([self.size, np.stack(size, axis=1)])[where]

    def _unknown(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.ones(len(keys), bool)
        return self.hash[np.minimum(np.searchsorted(self.hash, keys), len(self.hash) - 1)] != keys

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of texts that each begin with a space: which are spelled out by both, and for A and B the
        ids of those, and how many each text has."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = (data[1:] == 0x20) & ~packing._NO_CUT[data[:-1]]
        cut[off] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(data)) if len(start) else start
        keys, first, which = np.unique(S.range_hash(S.prefix_hash(data), start, end), return_index=True, return_inverse=True)
        new = self._unknown(keys)
        if len(self.hash) + int(new.sum()) > KNOWN:
            self._clear()
            new[:] = True
        if new.any():
            raw = data.tobytes()
            a, b = start[first[new]], end[first[new]]
            self._learn(keys[new], [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], ~packing._NO_CUT[data[b - 1]])
        place = np.searchsorted(self.hash, keys)[which]
        text = np.searchsorted(off, start, "right") - 1  # of each stretch
        bad = np.bincount(text[~self.good[place]], minlength=len(off) - 1) > 0
        keep = ~bad[text]
        place, text = place[keep], text[keep]
        ids, counts = [], []
        for k in range(2):
            size = self.size[place, k]
            ids.append(self.ids[k][np.repeat(self.at[place, k], size) + S.ramp(size)])
            counts.append(np.bincount(text, size, len(off) - 1).astype(np.int64))
        return ~bad & (np.diff(off) > 0), ids, counts


@lru_cache(1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizers(path_a, path_b)


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted ``a`` and of the sorted ``b`` are among the first 0, piece, 2 piece, .. of
    their merge (equal values: ``a`` first): a binary search on each diagonal, all at once."""
    diagonal = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        taken = np.zeros(len(mid), bool)
        taken[open_] = a[mid[open_]] <= b[diagonal[open_] - mid[open_] - 1]
        low, high = np.where(open_ & taken, mid + 1, low), np.where(open_ & ~taken, mid, high)
    return low, diagonal - low


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (an A and a B token each) of tokens that end at ``a`` and ``b``, and the group of each A and
    each B token.  Pieces are merged on their own; what is carried is the last end and the cuts so far."""
    at_a, at_b = merge_path(a, b, piece)
    link_a, link_b = [], []
    group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    cuts, last = 0, -1
    for i, j, k, m in zip(at_a[:-1].tolist(), at_b[:-1].tolist(), at_a[1:].tolist(), at_b[1:].tolist(), strict=True):
        ends = np.concatenate([a[i:k], b[j:m]])
        order = np.argsort(ends, kind="stable")  # two sorted runs: one merge
        ends = ends[order]
        from_a = order < k - i
        same = np.diff(ends, prepend=last) == 0  # a B token that ends with the A token before it
        before = np.cumsum(from_a) - from_a
        fresh = ~same
        link_a.append(i + before[fresh])
        link_b.append(j + (np.arange(len(ends)) - before)[fresh])
        group = cuts + np.cumsum(same) - same
        group_a[i:k], group_b[j:m] = group[from_a], group[~from_a]
        cuts += int(same.sum())
        last = int(ends[-1]) if len(ends) else last
    none = [np.zeros(0, np.int64)]
    return np.concatenate(link_a or none), np.concatenate(link_b or none), group_a, group_b


@lru_cache(1)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    wide = len(str(n))
    text = np.zeros((n, wide), np.uint8)
    size = np.zeros(n, np.int64)
    for i in range(n):
        s = str(i).encode()
        text[i, : len(s)], size[i] = np.frombuffer(s, np.uint8), len(s)
    return text, size


def spelled_groups(ids: list[np.ndarray], groups: list[np.ndarray], counts: list[np.ndarray]) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` for each text: the ids of its groups, A before B."""
    n_a, n_b = len(ids[0]), len(ids[1])
    n = int(groups[0][-1]) + 1 if n_a else 0
    of_a, of_b = np.bincount(groups[0], minlength=n), np.bincount(groups[1], minlength=n)
    token, mark = np.empty(n_a + n_b, np.int64), np.empty(n_a + n_b, np.uint8)
    place = np.arange(n_a) + (np.cumsum(of_b) - of_b)[groups[0]]
    token[place] = ids[0]
    mark[place] = np.where(np.append(groups[0][1:] == groups[0][:-1], False) if n_a else [], ord(","), ord("|"))
    place = np.arange(n_b) + np.cumsum(of_a)[groups[1]]
    token[place] = ids[1]
    mark[place] = np.where(np.append(groups[1][1:] == groups[1][:-1], False) if n_b else [], ord(","), ord(";"))
    text, size = _decimals(1 << 16)
    if len(token) and token.max() >= len(size):
        text, size = _decimals(int(token.max()) + 1)
    both = counts[0] + counts[1]
    last = np.cumsum(both)[both > 0] - 1
    wide = size[token] + 1
    wide[last] -= 1
    start = np.cumsum(wide) - wide
    out = np.empty(int(wide.sum()), np.uint8)
    for d in range(text.shape[1]):
        has = size[token] > d
        out[start[has] + d] = text[token[has], d]
    marked = np.ones(len(token), bool)
    marked[last] = False
    out[(start + size[token])[marked]] = mark[marked]
    bounds = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(both)])]
    return pa.LargeStringArray.from_buffers(len(both), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, links binary, pairs array<long>, times array<long>"


def _aligner(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            data, off = S.byte_view(batch.column(1))
            for i, j in S.rounds(off, BLOCK_BYTES):
                yield block(batch.column(0).slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i], base + made)
                made += 1

    def block(names, data, off, number) -> pa.RecordBatch:
        size = np.diff(off)
        spaced = np.full(len(data) + int((size > 0).sum()), 0x20, np.uint8)
        lead = np.cumsum(size > 0)  # spaces before each text's own bytes
        spaced[np.arange(len(data)) + np.repeat(lead, size)] = data
        known = tokenizers(path_a, path_b)
        _, ids, counts = known.encode(spaced, off + np.concatenate([[0], lead]))
        ends = [np.cumsum(length[x]) for length, x in zip((known.len_a, known.len_b), ids, strict=True)]
        link_a, link_b, group_a, group_b = overlaps(*ends)
        doc_of = np.repeat(np.arange(len(size)), counts[0])
        n_links = np.bincount(doc_of[link_a], minlength=len(size))
        cut = np.zeros(len(group_a), bool)
        if len(cut):
            cut[0], cut[1:] = True, np.diff(group_a) > 0
        n_groups = np.bincount(doc_of[cut], minlength=len(size))
        pair = (ids[0][link_a].astype(np.int64) << 32) | ids[1][link_b]
        distinct, which, times = np.unique(pair, return_inverse=True, return_counts=True)
        # in order within each text, in 16 bits where that is enough: small when written
        kind = np.uint16 if len(distinct) <= 1 << 16 else np.uint32
        which = which[np.argsort(doc_of[link_a] * len(distinct) + which)] if len(which) else which
        packed = which.astype(kind)
        edge = np.concatenate([[0], np.cumsum(n_links)]) * packed.itemsize
        links = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())
        first = np.zeros(len(size), np.int32)
        first[:1] = len(distinct)
        bounds = pa.array(np.concatenate([[0], np.cumsum(first)]).astype(np.int32))
        gone = np.arange(len(size)) > 0
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int64)), mask=pa.array(gone)) for x in (distinct, times)]
        return pa.RecordBatch.from_arrays(
            [names, *(pa.array(x.astype(np.int64)) for x in (*counts, n_groups, n_links)), spelled_groups(ids, [group_a, group_b], counts), pa.array(np.full(len(size), number)), links, *lists],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "block", "links", "pairs", "times"],
        )

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: tokens, groups (their ids spelled out), links, and for :func:`weigh` the block
    that it is in, its links as places in the block's list of pairs, and, in the block's first row, that
    list and how often each pair occurs there."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_aligner(*(paths or default_tokenizers())), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of the whole corpus by pair (A id << 32 | B id), and whether no pair of
    the same B id has more.  B ids are a vocabulary, so their maxima are few."""
    listed = aligned.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = S.materialize(listed.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.withColumn("b", counts["pair"].bitwiseAND(0xFFFFFFFF)).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def weigh(aligned: DataFrame) -> DataFrame:
    """``aligned`` (a written table: blocks are named by tasks), with n_best and count_sum instead of the
    columns of its blocks."""
    counts = pair_counts(aligned)
    asked = aligned.where("pairs is not null").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("pos", "pair"))
    # the counts are the smaller side, and each block asks once: no sort, no hot key
    told = asked.join(counts.hint("shuffle_hash"), "pair").select("of_block", F.col("pos").cast("long").alias("pos"), "count", "best")
    docs = aligned.drop("pairs", "times")
    keep = [f for f in docs.schema.fields if f.name not in ("block", "links")]
    names = [f.name for f in keep]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("pos").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
        links = left.column("links").combine_chunks()
        links = links.cast(pa.large_binary()) if not isinstance(links, pa.ChunkedArray) else pa.concat_arrays(links.chunks).cast(pa.large_binary())
        n = left.column("n_links").to_numpy()
        raw, _ = S.byte_view(links)
        at = raw.view(np.uint16 if len(raw) == 2 * n.sum() else np.uint32) if len(raw) else np.zeros(0, np.uint16)
        bounds = np.concatenate([[0], np.cumsum(n)])
        sums = [S.segment_sums(x[at], bounds) for x in (best, count)]
        return left.select(names).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in keep] + ["n_best long", "count_sum long"])
    return docs.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(one, schema)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("")
    rows = weigh(S.materialize(rows.withColumn("groups_sha256", digest).drop("groups"), "aligned"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
