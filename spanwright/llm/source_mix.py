"""Mixing sources to target weights by blocks, slots and index permutations.

Each source's words, its texts laid end to end, are packed into blocks of ``BLOCK`` words.  The mix
has as many slots for a source as its target asks for, dealt over output shards by multinomial draws
conditioned on the sources' totals (multivariate hypergeometric), down a binary tree whose nodes
have seeds of their own, so any task can draw its shards alone and reruns agree.  The i-th slot of a
source reads block ``permutation(i mod blocks)`` of pass ``i div blocks``; the permutation is a
keyed Feistel network, walked until it falls among the blocks.  Slots and blocks are joined by index.

Targets: sources in code point order, null last, weigh 1, 2, 3, 1, ..; they share all words of the
corpus, but none more than ``REPEATS`` times its own, and the excess is shared again by weight.  As a
pass reads each block once, no text is taken more than REPEATS times.

A hot source is spread by a hash of the id: offsets come from sums by (source, salt).  The table of
sources, one row each, is the only thing on the driver.  Null text: size 0.  Texts without words are
never taken.  Very long texts span many blocks.  Repeated rows are laid out each on its own.  An
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared as S

BLOCK = 32
SHARD = 4096  # slots of an output shard
REPEATS = 3
WEIGHTS = (1, 2, 3)
SALTS = 1024
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, each at most ``repeats`` times its size."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total >= repeats * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. n-1 puts each index."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for turn in range(4):
            left, right = right, left ^ (S.mix(right + np.uint64(key * 8 + turn & (2**64 - 1)), 41) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def split(counts: np.ndarray, take: int, seed: tuple) -> np.ndarray:
    """How many of ``take`` slots drawn without return fall to each source: one hypergeometric draw
    for each source from what the ones before left."""
    random = np.random.default_rng(seed)
    out, total, left = np.zeros_like(counts), int(counts.sum()), take
    for i, own in enumerate(map(int, counts)):
        rest = total - own
        if total < 10**9:
            n = int(random.hypergeometric(own, rest, left)) if total else 0
        else:  # beyond numpy's range the same draw by its normal limit
            share = own / total
            spread = (left * share * (1 - share) * (total - left) / (total - 1)) ** 0.5
            n = int(min(max(round(left * share + spread * random.standard_normal()), left - rest, 0), own, left))
        out[i], total, left = n, rest, left - n
    return out


def shard_counts(counts: np.ndarray, lo: int, hi: int, seed: int = SEED, size: int = SHARD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots before it, its slots) by source, of shards lo .. hi-1."""
    total = int(counts.sum())
    shards = -(-total // size)

    def down(a: int, b: int, before: np.ndarray, here: np.ndarray):
        if b <= lo or a >= hi:
            return
        if b - a == 1:
            yield a, before, here
            return
        middle = (a + b) // 2
        left = split(here, min(middle * size, total) - a * size, (seed, a, b))
        yield from down(a, middle, before, left)
        yield from down(middle, b, before + left, here - left)

    if shards:
        yield from down(0, shards, np.zeros_like(counts), counts)


def _slots(counts: np.ndarray, blocks: np.ndarray, per_task: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0).to_pylist():
                for shard, before, here in shard_counts(counts, group * per_task, (group + 1) * per_task):
                    source = np.repeat(np.arange(len(counts)), here)
                    index = np.repeat(before, here) + S.ramp(here)
                    turn, rest = index // blocks[source], index % blocks[source]
                    block = np.empty(len(index), np.int64)
                    for s in np.unique(source):
                        for t in np.unique(turn[source == s]):
                            mine = (source == s) & (turn == t)
                            block[mine] = permuted(rest[mine], int(blocks[s]), SEED * 1_000_003 + int(s) * 64 + int(t))
                    place = np.random.default_rng((SEED, 1, shard)).permutation(len(index))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(index), shard)), pa.array(place), pa.array(source), pa.array(turn), pa.array(block)],
                        ["shard", "slot", "source_no", "pass", "block"],
                    )

    return run


def layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, list[dict]]:
    """Rows (row, doc_id, hash of the text, source_no, size, start) and the sources: name, size, target, blocks, slots."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col).cast("string")).alias("h"),
    )
    rows = S.materialize(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS))).withColumn("row", F.monotonically_increasing_id()), "sizes")
    found = [(r[0], r[1]) for r in rows.groupBy("source").agg(F.sum("size")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    aim = targets([n for _, n in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))])
    sources = []
    for i, ((name, n), t) in enumerate(zip(found, aim, strict=True)):
        blocks = -(-n // BLOCK)
        sources.append({"no": i, "name": name, "size": n, "target": t, "blocks": blocks, "slots": min(REPEATS * blocks, round(t * blocks / n)) if n else 0})
    names = docs.sparkSession.createDataFrame([(s["no"], s["name"], s["size"], s["target"]) for s in sources], "source_no long, source string, source_size long, target double")
    rows = rows.join(names.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")), "inner").drop("name")
    rows = rows.repartition("salt")
    inner = W.partitionBy("salt", "source_no").orderBy("doc_id", "h", "row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    sums = rows.groupBy("source_no", "salt").agg(F.sum("size").alias("n"))
    outer = W.partitionBy("source_no").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(outer), F.lit(0))).drop("n")
    rows = rows.join(sums, ["source_no", "salt"]).withColumn("start", F.col("base") + F.col("within"))
    return S.materialize(rows.select("row", "doc_id", "h", "source_no", "size", "source_size", "target", "start"), "layout"), sources


def mixture(rows: DataFrame, sources: list[dict]) -> DataFrame:
    """The mix: one row for each part of a text in a slot: shard, slot, source_no, pass, row, doc_id, h,
    ``first`` word in the text and ``words``."""
    spark = rows.sparkSession
    counts = np.array([s["slots"] for s in sources], np.int64)
    blocks = np.array([max(1, s["blocks"]) for s in sources], np.int64)
    shards = -(-int(counts.sum()) // SHARD)
    per_task = max(1, shards // 4096)
    groups = -(-shards // per_task)
    parts = max(1, min(groups, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    slots = spark.range(0, groups, 1, parts).mapInArrow(_slots(counts, blocks, per_task), "shard long, slot long, source_no long, pass long, block long")
    pieces = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}"))))
    pieces = pieces.withColumn("first", F.greatest(F.lit(0), F.expr(f"block * {BLOCK} - start")))
    pieces = pieces.withColumn("words", F.least("size", F.expr(f"(block + 1) * {BLOCK} - start")) - F.col("first"))
    # both sides grow with the corpus, whatever their size is estimated to be: never a broadcast
    return slots.hint("merge").join(pieces.select("row", "doc_id", "h", "source_no", "block", "first", "words"), ["source_no", "block"])


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources = layout(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = mixture(rows, sources).groupBy("row").agg(F.sum("words").alias("taken"))
    out = rows.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


QUERIES = {"op7_source_mix": op7_source_mix}
ORACLES: dict[str, str] = {}
