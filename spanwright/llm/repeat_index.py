"""Removal of long repeats by run-length Burrows-Wheeler indexes of aligned contexts.

A string of ``LENGTH`` bytes that starts twice has, in both places, the same anchor: of its k-grams
(``GRAM`` bytes) the one of least hash, the last of equal ones.  So the corpus needs no suffix array
of its own: all places of one anchor form a group, with the ``LENGTH - GRAM`` bytes before the anchor
and ``LENGTH`` bytes from its start on as context, and a repeat shows inside one group.

1. Each distinct text (by its MD5) gives rows (anchor, 128 bits of hash of the context, text, position).
2. A context that occurs in two places repeats as a whole.  Only groups with two different contexts
   go on, with one place of each context.
3. The contexts of a group, aligned at the anchor, get a positional Burrows-Wheeler transform: at
   each column they are ordered by what stands before, read backwards.  The column's symbols in that
   order are held as runs, and their match lengths are streamed: inside a run a neighbour's match
   grows by one, and only at the sampled run ends is it found anew, from the least length between
   two runs of a symbol.  A context whose match with a neighbour reaches LENGTH repeats there, byte
   for byte; its matching statistic is the larger of its two neighbours'.
4. A group of more than ``GROUP`` contexts is not indexed in one task.  Its strings' starts are halved
   again and again; at each step contexts part by the bytes that all strings of a half have in common
   (128 bits of hash), and contexts equal in all bytes of a half are one from there on.  Each step is
   a join over all tasks, and nine steps come to single starts.
5. Spans meet their texts again; texts that occur twice and are long enough go whole.

Null and empty texts: nothing to remove.  Texts shorter than LENGTH are left alone.  Matches never
cross texts, but both places may be in one text and overlap.  Repeated rows are copies, whatever
their ids.  A very long text is handled in overlapping parts.  An empty table gives no rows.  Extra
columns are ignored, or kept (:func:`with_kept`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared as S

LENGTH = 400
GRAM = 100
LEFT = LENGTH - GRAM
_PLACE = 27  # bits of a sort key that hold a position; texts beyond are cut into overlapping parts
PART = 1 << 26
#: Contexts that are indexed together at least, and in one group at most.
INDEXED, GROUP = 4096, 1 << 14
_U = np.uint64


def anchors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions of the anchors of all strings of LENGTH bytes within the texts."""
    found = []
    for lo in range(0, max(len(data) - LENGTH + 1, 0), PART):
        piece = data[lo : lo + PART + LENGTH - 1]
        sums = S.prefix_hash(piece)
        at = np.arange(len(piece) - GRAM + 1)
        h = S.range_hash(sums, at, at + GRAM)
        keyed = ((h >> _U(_PLACE + 1)) << _U(_PLACE)).astype(np.int64) | ((1 << _PLACE) - 1 - at)
        least = S.sliding_min(keyed, LEFT + 1)
        valid = np.ones(len(least), bool)
        start = np.arange(lo, lo + len(least))
        text = np.searchsorted(off, start, "right") - 1 if len(off) < 64 else np.repeat(np.arange(len(off) - 1), np.diff(off))[lo : lo + len(least)]
        valid = start + LENGTH <= off[text + 1]
        found.append(lo + (1 << _PLACE) - 1 - (np.unique(least[valid]) & ((1 << _PLACE) - 1)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()  # of this task
    for batch in batches:
        data, off = S.byte_view(batch.column("text"))
        names = batch.column("t").to_pylist()
        for i, j in S.rounds(off, docs=1 << 20):
            fresh = np.zeros(j - i, bool)
            for k, t in enumerate(names[i:j]):
                fresh[k] = t not in seen
                seen.add(t)
            part, edges = data[off[i] : off[j]], off[i : j + 1] - off[i]
            at = anchors(part, edges)
            text = np.searchsorted(edges, at, "right") - 1
            at, text = at[fresh[text]], text[fresh[text]]
            lo, hi = np.maximum(edges[text], at - LEFT), np.minimum(edges[text + 1], at + LENGTH)
            sums = S.prefix_hash(part)
            gram = S.range_hash(sums, at, at + GRAM)
            context = [S.mix(S.range_hash(x, lo, hi) + (at - lo).astype(_U), 51) for x in (sums, S.prefix_hash(part, True))]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.view(np.int64)) for x in (gram, *context)), batch.column("t").slice(i, j - i).take(pa.array(text)), pa.array(at - edges[text]), pa.array((hi - at).astype(np.int32))],
                ["anchor", "context", "context2", "t", "pos", "after"],
            )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, wanted = batch.column("text"), batch.column("wanted")
        for i in range(batch.num_rows):
            raw = texts[i].as_buffer()
            rows = wanted.slice(i, 1).flatten()
            pos = rows.field("pos").to_numpy()
            left = np.minimum(pos, LEFT)
            data = memoryview(raw)
            cut = pa.array([bytes(data[p - q : min(len(data), p + LENGTH)]) for p, q in zip(pos.tolist(), left.tolist(), strict=True)], pa.binary())
            names = batch.column("t").take(pa.array(np.full(len(pos), i)))
            yield pa.RecordBatch.from_arrays([rows.field("anchor"), names, *(rows.field(k) for k in ("pos", "whole", "crowded")), cut], ["anchor", "t", "pos", "whole", "crowded", "bytes"])


def aligned_repeats(group: np.ndarray, left: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each context (of sorted ``group``, its anchor ``left`` bytes in) and each of the LEFT + 1
    places where a string may start, counted from LEFT bytes before the anchor: whether that string
    of LENGTH bytes also stands there in another context of the group."""
    n, columns = len(texts), LEFT + LENGTH
    grid = np.full((columns, n), -1, np.int16)  # -1: outside the text
    size = np.array([len(x) for x in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(n), size)
    grid[S.ramp(size) + np.repeat(LEFT - left, size), owner] = flat
    head = np.concatenate([[True], group[1:] != group[:-1]])
    order = np.arange(n)
    length = np.zeros(n, np.int32)  # match with the one before, up to the last column
    out = np.zeros((n, LEFT + 1), bool)
    number = np.cumsum(head) - 1  # of the group; groups keep their places
    for column in range(columns):
        symbol = grid[column][order]
        start = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | head[1:]]))  # of the runs
        run = symbol[start].astype(np.int64) + number[start] * 512
        by = np.argsort(run, kind="stable")
        ends = np.append(start[1:], n)
        if not np.array_equal(by, np.arange(len(start))):
            # a run that now follows another of its symbol: the least length from that one's end on
            size = (ends - start)[by]
            fresh = length + 1
            same = np.flatnonzero(run[by][1:] == run[by][:-1]) + 1
            fresh[start] = 0
            if len(same):
                a, b = ends[by[same - 1]], start[by[same]] + 1
                fresh[start[by[same]]] = np.minimum.reduceat(length, np.column_stack([a, np.minimum(b, n - 1)]).ravel())[::2] + 1
                last = b >= n  # reduceat has no end beyond the array
                for k in np.flatnonzero(last):
                    fresh[start[by[same[k]]]] = length[a[k] : n].min() + 1
            place = np.repeat(start[by], size) + S.ramp(size)
            order, length = order[place], fresh[place]
            symbol = symbol[place]
        else:
            length = length + 1
            length[start] = 0
        length[symbol < 0] = 0
        if column >= LENGTH - 1:
            hit = length >= LENGTH
            if hit.any():
                hit[:-1] |= hit[1:].copy()
                out[order[hit], column - LENGTH + 1] = True
    return out


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, text and position: spans of contexts that repeat in part.  A place that
    comes again (equal rows of one id) counts once."""
    held: list[pa.RecordBatch] = []
    last = None

    def indexed(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        anchor, pos = table.column("anchor").to_numpy(), table.column("pos").to_numpy()
        hits = aligned_repeats(anchor, np.minimum(pos, LEFT), table.column("bytes").to_pylist())
        hits[table.column("whole").to_numpy(zero_copy_only=False)] = False  # removed already
        edge = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, after = np.nonzero(edge == -1)
        base = pos[row] - LEFT
        return pa.RecordBatch.from_arrays([table.column("t").combine_chunks().take(pa.array(row)), pa.array(base + first), pa.array(base + after - 1 + LENGTH)], ["t", "start", "end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        name = S.byte_view(batch.column("t"))[0].reshape(-1, 16).view(np.int64)
        place = np.stack([batch.column("anchor").to_numpy(), name[:, 0], name[:, 1], batch.column("pos").to_numpy()])
        new = np.concatenate([[last is None or bool((place[:, 0] != last).any())], (place[:, 1:] != place[:, :-1]).any(axis=0)])
        last = place[:, -1]
        if not new.all():
            batch = batch.filter(pa.array(new))
        held.append(batch)
        if sum(b.num_rows for b in held) >= INDEXED:
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
            if cut:
                yield indexed(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield indexed(pa.Table.from_batches(held))


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts and the starts ``lo`` to ``hi`` of strings (columns): hashes of the bytes that all
    these strings share, and of all bytes of any of them (null where the text ends before)."""
    for batch in batches:
        rows = [batch.column(k).to_pylist() for k in ("pos", "lo", "hi", "bytes")]
        inner, outer = [], []
        for pos, lo, hi, raw in zip(*rows, strict=True):
            skip = LEFT - min(pos, LEFT)  # columns before the text's first byte
            a, b, c, d = lo - skip, hi - skip, lo + LENGTH - skip, hi + LENGTH - skip
            inside = b >= 0 and c <= len(raw)
            inner.append(hashlib.blake2b(raw[b:c], digest_size=16).digest() if inside else None)
            outer.append(hashlib.blake2b(raw[a:d], digest_size=16).digest() if inside and a >= 0 and d <= len(raw) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inner, pa.binary()), pa.array(outer, pa.binary())], [*batch.schema.names, "inner", "outer"])


def crowded_spans(contexts: DataFrame) -> DataFrame:
    """(t, start, end) of strings that repeat among the contexts (anchor, t, pos, bytes) of large groups."""
    spans = None
    rows = contexts.select("anchor", "t", "pos", F.lit(0).alias("lo"), F.lit(LEFT).alias("hi"), "bytes").dropDuplicates(["anchor", "t", "pos"])
    schema = "anchor long, t binary, pos long, lo int, hi int, bytes binary, inner binary, outer binary"
    place = F.struct("t", "pos")
    while True:
        rows = S.materialize(rows.mapInArrow(_halves, schema).where("inner is not null"), "halves")
        if rows.isEmpty():
            break
        same = rows.where("outer is not null").groupBy("anchor", "lo", "outer").agg(F.count("pos").alias("n"), F.min(place).alias("one")).where("n > 1")
        rows = rows.join(same, ["anchor", "lo", "outer"], "left")
        found = rows.where("n > 1").select("t", (F.col("pos") - LEFT + F.col("lo")).alias("start"), (F.col("pos") - LEFT + F.col("hi") + LENGTH).alias("end"))
        found = S.materialize(found, "halved")
        spans = found if spans is None else spans.unionByName(found)
        # one of equal ones goes on, where others share the inner bytes
        rows = rows.where(F.col("n").isNull() | (F.col("one") == place)).where("lo < hi").drop("n", "one", "outer")
        many = rows.groupBy("anchor", "lo", "inner").agg(F.count("pos").alias("n")).where("n > 1")
        rows = rows.join(many.drop("n"), ["anchor", "lo", "inner"]).drop("inner")
        middle = F.expr("int((lo + hi) div 2)")
        halves = F.array(F.struct("lo", middle.alias("hi")), F.struct((middle + 1).alias("lo"), "hi"))
        rows = rows.withColumn("half", F.explode(halves)).select("anchor", "t", "pos", "half.lo", "half.hi", "bytes")
    return spans if spans is not None else contexts.sparkSession.createDataFrame([], "t binary, start long, end long")


_KEPT = "__bytes long, __removed long, __spans long, __sha256 string, __kept binary"


def _kept(text_col: str, names: list[str]):
    """Rows with what is left of their texts; ``__copied`` and ``__runs`` say what goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(text_col).cast(pa.string()), []
            copies, spans = batch.column("__copied").to_pylist(), batch.column("__runs")
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                n = len(raw)
                if copies[i] and n >= LENGTH:
                    runs = [(0, n)]
                elif spans[i].is_valid and len(spans[i]):
                    rows = spans.slice(i, 1).flatten()
                    a, b = rows.field("start").to_numpy(), rows.field("end").to_numpy()
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.concatenate([[True], a[1:] > b[:-1]])
                    runs = list(zip(a[new].tolist(), b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)].tolist(), strict=True))
                else:
                    runs = []
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                kept = b"".join(kept)
                out.append((n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*names, "__bytes", "__removed", "__spans", "__sha256", "__kept"]
            )

    return run


def with_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``__bytes``, ``__removed``, ``__spans``, ``__sha256``, ``__kept``: the
    text without the bytes that a string of LENGTH bytes covers which also starts elsewhere."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("t"))
    rows = S.materialize(texts.select("doc_id", "t", F.octet_length("text").alias("n")), "rows")
    classes = S.materialize(rows.groupBy("t").agg(F.count("n").alias("copies"), F.min("doc_id").alias("rep")), "texts")

    long_texts = texts.where(F.octet_length("text") >= LENGTH).select("t", "text")
    places = S.materialize(long_texts.mapInArrow(_anchor_rows, "anchor long, context long, context2 long, t binary, pos long, after int"), "anchors")
    place, context = F.struct("t", "pos"), ["anchor", "context", "context2"]
    contexts = places.groupBy(*context).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    contexts = contexts.select(*context, "lo", (F.col("lo") != F.col("hi")).alias("whole"))
    crowds = contexts.groupBy("anchor").agg(F.count("context").alias("kinds"), F.max("whole").alias("any")).where("kinds > 1 or any")
    contexts = S.materialize(contexts.join(crowds, "anchor"), "contexts")
    whole = places.join(contexts.where("whole").select(*context), context).select("t", "pos", "after").distinct()
    whole = whole.select("t", F.greatest(F.lit(0), F.col("pos") - LEFT).alias("start"), (F.col("pos") + F.col("after")).alias("end"))

    crowded = F.col("kinds") > GROUP
    wanted = contexts.where("kinds > 1").select("lo.t", F.struct("anchor", "lo.pos", "whole", crowded.alias("crowded")).alias("w"))
    wanted = wanted.groupBy("t").agg(F.collect_list("w").alias("wanted")).join(classes.select("t", F.col("rep").alias("rep_id")), "t")
    wanted = wanted.withColumnRenamed("t", "rep_t")
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("t") == F.col("rep_t")))
    cut = found.select("t", "text", "wanted").mapInArrow(_cut_out, "anchor long, t binary, pos long, whole boolean, crowded boolean, bytes binary")
    spread = cut.where("not crowded").repartition("anchor").sortWithinPartitions("anchor", "t", "pos")
    spans = whole.unionByName(spread.mapInArrow(_matched, "t binary, start long, end long"))
    if not contexts.where(crowded).isEmpty():
        spans = spans.unionByName(crowded_spans(cut.where("crowded")))
    spans = spans.groupBy("t").agg(F.collect_list(F.struct("start", "end")).alias("__runs"))
    spans = S.materialize(spans, "spans")
    S.discard(places, contexts)

    copied = classes.where("copies > 1").select("t", F.lit(True).alias("__copied"))
    about = rows.select("doc_id", "t").distinct().join(copied, "t", "left").join(spans, "t", "left")
    about = about.withColumn("__copied", F.coalesce("__copied", F.lit(False))).withColumnRenamed("doc_id", "__id").withColumnRenamed("t", "__t")
    named = docs.withColumn("__h", F.unhex(F.md5(text)))
    joined = named.join(about, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__t")))
    columns = list(dict.fromkeys([*docs.columns, text_col]))
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_KEPT).fields])
    return joined.select(*columns, "__copied", "__runs").mapInArrow(_kept(text_col, docs.columns), schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_kept(rows).selectExpr("doc_id", "__bytes n_bytes", "__removed n_removed", "__spans n_spans", "__sha256 kept_sha256", "__kept kept")


def op9_repeat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


QUERIES = {"op9_repeat_index": op9_repeat_index}
ORACLES: dict[str, str] = {}
