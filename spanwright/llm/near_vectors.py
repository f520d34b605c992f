"""Nearest neighbours by inner product: stable projections, a kd-tree, and a chi-square stopping test.

Inner products become distances by one more coordinate: a vector x gets sqrt(M^2 - |x|^2), with M the
largest norm, a query, scaled to norm M, gets 0; then d^2 = 2 M^2 - 2 q.x.  Both are projected by a few
Gaussian directions (2-stable: a projected squared distance is d^2 times a chi-square variable of
``dims`` degrees).  A kd-tree over the projections gives a query its projected neighbours in growing
order, leaf by leaf, in rounds; those whose projected squared distance is at most t * b^2 are verified
by their true inner product, where b is the distance of the query's k-th best so far and t the
``confidence`` quantile of chi-square; when the next leaf is further than that, the test holds and the
search stops: a true neighbour is then left out with a chance of 1 - confidence at most.

The tree's upper levels are cells, which are spread over the cluster (their bounds come from a bounded
sample, SAMPLE rows; every row is in a cell), its lower ones are built in the task that has the cell.
A query is searched in its own cell first; the bound found there says which other cells the test still
asks for, and only to those it is sent.  Queries meet a cell in chunks, so no task holds all queries.

Equal vectors are one point: a group of copies of any size keeps the k + 1 smallest ids, as no result
can name more, and queries of one vector are searched once.

Vectors that are null, empty, all zero, or hold a null, a NaN or an infinity take no part, nor do rows
without an id.  Only vectors of one length are compared with each other.  Repeated rows count once; rows
of one id and several vectors are one neighbour for each vector, and no neighbours of each other.  With
fewer candidates than k all are returned.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared as S

K = 20
#: Rows whose id this number divides are the queries.
EVERY = 20
#: Projected dimensions, and the chance at which the stopping test holds.
DIMS, CONFIDENCE = 8, 0.975
#: Points of a cell about, cells at most, rows of the sample at most that bounds them, and rows of a leaf.
CELL, CELLS, SAMPLE, LEAF = 1 << 12, 1 << 14, 1 << 18, 64
#: Queries that meet a cell in one task about, and those that are searched side by side.
CHUNK, SIDE_BY_SIDE = 1 << 13, 256
SEED = 11


@lru_cache(4)
def chi_square_quantile(p: float, dims: int) -> float:
    """Of an even number of degrees of freedom, whose tail is a finite sum."""
    if dims % 2:
        raise ValueError("the number of projected dimensions must be even")

    def tail(x):
        return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))

    low, high = 0.0, 1.0
    while tail(high) > 1 - p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > 1 - p else (low, mid)
    return high


@lru_cache(8)
def _directions(length: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length + 1, dims))


def _project(x: np.ndarray, norm: float, dims: int, seed: int, query: bool) -> np.ndarray:
    g = _directions(x.shape[1], dims, seed)
    size = (x * x).sum(axis=1)
    if query:
        return (x * (norm / np.sqrt(size))[:, None]) @ g[:-1]
    return x @ g[:-1] + np.sqrt(np.maximum(norm * norm - size, 0))[:, None] * g[-1]


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrices of the rows of each length."""
    sizes = np.diff(col.offsets.to_numpy())
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, _matrix(col.take(pa.array(rows)))


def _splits(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and values of a complete kd-tree's inner nodes: medians along the widest axis."""
    axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    nodes = [np.arange(len(points))]
    for level in range(depth):
        below = []
        for k, rows in enumerate(nodes):
            at = (1 << level) - 1 + k
            if len(rows):
                part = points[rows]
                axis[at] = np.argmax(part.max(axis=0) - part.min(axis=0))
                value[at] = np.median(part[:, axis[at]])
            right = points[rows, axis[at]] > value[at]
            below += [rows[~right], rows[right]]
        nodes = below
    return axis, value


def _descend(points: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] > value[node])
    return node - len(axis)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree, halved along the widest axis."""
    out, nodes = [], [np.arange(len(points))]
    while nodes:
        rows = nodes.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        part = points[rows]
        along = part[:, np.argmax(part.max(axis=0) - part.min(axis=0))]
        order = np.argpartition(along, len(rows) // 2)
        nodes += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def _box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes: a lower bound for all that is in a box."""
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[:, k] - q[:, k, None], q[:, k, None] - high[:, k]), 0)
        out += gap * gap
    return out


def search_cell(x: np.ndarray, q: np.ndarray, bound: np.ndarray, norm: float, k: int, dims: int, confidence: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q`` with rows of ``x`` and their inner products, at least the k best of each query if they
    are above its ``bound`` (a k-th best inner product known before, or -inf), but for those that the
    test leaves out; ties with the k-th are all there."""
    t = chi_square_quantile(confidence, dims)
    y = _project(x, norm, dims, seed, False)
    leaves = _leaves(y)
    low, high = (np.stack([f(y[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
    near = [x[rows] for rows in leaves]
    flat = [(y[rows], (y[rows] ** 2).sum(axis=1)) for rows in leaves]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(q), SIDE_BY_SIDE):
        part = q[start : start + SIDE_BY_SIDE]
        size = np.sqrt((part * part).sum(axis=1))
        scale = norm / size
        z = _project(part, norm, dims, seed, True)
        far = _box_distance(z, low, high)
        order = np.argsort(far, axis=1, kind="stable")
        best = np.full((len(part), k), -np.inf)
        kth = bound[start : start + SIDE_BY_SIDE].copy()
        slack = 1e-9 * norm * size  # inner products of one pair may differ by rounding
        done, step = 0, 4
        while done < len(leaves):
            turn = order[:, done : done + step]
            done, step = done + step, step * 2
            # within a round, leaves are taken one by one for all queries that have them in it
            owner = np.repeat(np.arange(len(part)), turn.shape[1])
            leaf = turn.ravel()
            by = np.argsort(leaf, kind="stable")
            owner, leaf = owner[by], leaf[by]
            edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=len(leaves)))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                n, rows = leaf[a], owner[a:b]
                limit = t * np.maximum(2 * norm * norm - 2 * kth[rows] * scale[rows], 0) * (1 + 1e-9) + 1e-12 * norm * norm
                asked = far[rows, n] <= limit
                if not asked.any():
                    continue
                rows, limit = rows[asked], limit[asked]
                points, squares = flat[n]
                zr = z[rows]
                projected = (zr * zr).sum(axis=1)[:, None] + squares - 2 * zr @ points.T
                keep = projected <= limit[:, None]
                if not keep.any():
                    continue
                score = np.where(keep, part[rows] @ near[n].T, -np.inf)
                best[rows] = np.partition(np.concatenate([best[rows], score], axis=1), -k, axis=1)[:, -k:]
                kth[rows] = np.maximum(kth[rows], best[rows].min(axis=1))
                hit, col = np.nonzero(score >= (kth[rows] - slack[rows])[:, None])
                found.append((start + rows[hit], leaves[n][col]))
            if not (far[np.arange(len(part)), order[:, min(done, len(leaves) - 1)]] <= t * (2 * norm * norm - 2 * kth * scale) * (1 + 1e-9) + 1e-12 * norm * norm).any():
                break
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    of, to = (np.concatenate([f[c] for f in found]) for c in range(2))
    score = np.empty(len(of))
    for i in range(0, len(of), 1 << 16):  # one way of summing, so that equal vectors have equal products
        score[i : i + (1 << 16)] = (q[of[i : i + (1 << 16)]] * x[to[i : i + (1 << 16)]]).sum(axis=1)
    return of, to, score


def _best(of: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's first k by score and id, in that order."""
    order = np.lexsort((ids, -score, of))
    first = np.flatnonzero(np.diff(of[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[nth < k]


def _searcher(norm: float, k: int, dims: int, confidence: float, seed: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """``left``: points (vec, ids) of a cell; ``right``: queries (query, qvec, bound)."""
        names = right.column("query").to_numpy() if right.num_rows else np.zeros(0, np.int64)
        of, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            x, q = _matrix(left.column("vec")), _matrix(right.column("qvec"))
            of, to, score = search_cell(x, q, right.column("bound").to_numpy(), norm, k, dims, confidence, seed)
            held = left.column("ids").combine_chunks()
            bounds = held.offsets.to_numpy()
            copies = np.diff(bounds)[to]
            ids = held.values.to_numpy()[np.repeat(bounds[:-1][to], copies) + S.ramp(copies)]
            of, score = np.repeat(of, copies), np.repeat(score, copies)
            pick = _best(of, ids, score, k)
            of, ids, score = of[pick], ids[pick], score[pick]
        edge = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(names)))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids)], ["minus", "vec_id"])
        return pa.table({"query": pa.array(names), "found": pa.ListArray.from_arrays(pa.array(edge), pairs)})

    return run


FOUND = "query long, found array<struct<minus: double, vec_id: long>>"


def _placer(column: int, norm: float, dims: int, seed: int, query: bool, tree: tuple[np.ndarray, np.ndarray], boxed: bool = False):
    """Adds each row's cell, and the projection where ``boxed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, y = np.zeros(batch.num_rows, np.int32), np.zeros((batch.num_rows, dims))
            for rows, x in _by_length(batch.column(column)):
                y[rows] = _project(x, norm, dims, seed, query)
                cell[rows] = _descend(y[rows], *tree)
            more = [pa.array(cell)] + [pa.array(y[:, c]) for c in range(dims if boxed else 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "cell", *[f"y{c}" for c in range(dims if boxed else 0)]])

    return run


def _asker(norm: float, dims: int, confidence: float, seed: int, boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], chunks: int, cells: int):
    """From (query, qvec, bound, length, cell) a row for each further cell that the test asks for; ``chunk``
    numbers queries whose own cells are near each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = chi_square_quantile(confidence, dims)
        for batch in batches:
            bound, home = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            chunk = (home.astype(np.int64) * chunks // cells).astype(np.int32)
            for rows, q in _by_length(batch.column(1)):
                cell, low, high = boxes[q.shape[1]]
                far = _box_distance(_project(q, norm, dims, seed, True), low, high)
                limit = t * np.maximum(2 * norm * norm - 2 * bound[rows] * norm / np.sqrt((q * q).sum(axis=1)), 0) * (1 + 1e-9) + 1e-12 * norm * norm
                row, to = np.nonzero((far <= limit[:, None]) & (cell != home[rows, None]))
                for i in range(0, len(row), 1000):
                    at = rows[row[i : i + 1000]]
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns[:4], pa.array(cell[to[i : i + 1000]]), pa.array(chunk[at])], [*batch.schema.names, "chunk"])

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, each once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite).where(F.exists("vec", lambda x: x != 0))


def _norm(squared: float) -> float:
    return math.sqrt(squared) * (1 + 1e-12)


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = SEED, cell_rows: int = CELL
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest that the search finds of each row whose id
    ``every`` divides, by inner product, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    out = "query_id long, rank int, vec_id long, score double"
    # of each distinct vector the k + 1 smallest ids; the limit of the rank is applied before the shuffle too
    nth = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    points = rows.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    points = S.materialize(points, "points")
    squared = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, most = points.agg(F.count("ids"), F.max(squared)).first()
    if not n:
        return spark.createDataFrame([], out)
    norm = _norm(most)
    depth = max(0, min(math.ceil(math.log2(n / cell_rows)), int(math.log2(CELLS)))) if n > cell_rows else 0
    tree = np.zeros(0, np.int64), np.zeros(0)
    if depth:
        share = min(1.0, min(SAMPLE, 64 << depth) / n)
        flat = _placer(0, norm, dims, seed, False, tree, True)
        names = [f"y{c}" for c in range(dims)]
        sample = points.select("vec").sample(share, seed).limit(SAMPLE).mapInArrow(flat, T.StructType([points.schema["vec"], T.StructField("cell", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])).select(*names)
        tree = _splits(sample.toPandas().to_numpy(), depth)
    at = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), *[T.StructField(f"y{c}", T.DoubleType()) for c in range(dims)]])
    cells = S.materialize(points.mapInArrow(_placer(0, norm, dims, seed, False, tree, True), at).withColumn("length", F.size("vec")), "cells")
    box = cells.groupBy("length", "cell").agg(*[f(f"y{c}").alias(f"{name}{c}") for c in range(dims) for f, name in ((F.min, "low"), (F.max, "high"))]).toPandas()
    boxes = {int(length): (part["cell"].to_numpy(np.int32), part[[f"low{c}" for c in range(dims)]].to_numpy(), part[[f"high{c}" for c in range(dims)]].to_numpy()) for length, part in box.groupby("length")}
    cells = cells.select("length", "cell", "vec", "ids")
    # queries of one vector are searched once
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "vec").distinct()
    queries = asked.groupBy(F.col("vec").alias("qvec")).agg(F.min("id").alias("query"))
    place = T.StructType([T.StructField("query", T.LongType()), T.StructField("qvec", points.schema["vec"].dataType), T.StructField("cell", T.IntegerType())])
    queries = S.materialize(queries.select("query", "qvec").mapInArrow(_placer(1, norm, dims, seed, True, tree), place).withColumn("length", F.size("qvec")), "queries")
    searcher = _searcher(norm, k + 1, dims, confidence, seed)
    home = queries.select(F.col("length").alias("of_length"), F.col("cell").alias("of_cell"), "query", "qvec", F.lit(float("-inf")).alias("bound"))
    first = S.materialize(cells.groupBy("length", "cell").cogroup(home.groupBy("of_length", "of_cell")).applyInArrow(searcher, FOUND), "first")
    parts = first
    if depth:
        bound = F.when(F.size("found") > k, -F.element_at("found", k + 1)["minus"]).otherwise(float("-inf"))
        known = queries.join(first.select("query", bound.alias("bound")), "query").select("query", "qvec", "bound", "length", "cell")
        known = S.materialize(known, "known")
        asker = _asker(norm, dims, confidence, seed, boxes, max(1, math.ceil(known.count() / CHUNK)), 1 << depth)
        more = known.mapInArrow(asker, T.StructType([*known.schema.fields, T.StructField("chunk", T.IntegerType())]))
        # the cells that each chunk of queries asks for
        wanted = more.select("length", "cell", "chunk").distinct()
        met = cells.join(wanted, ["length", "cell"])
        again = more.select(F.col("length").alias("of_length"), F.col("cell").alias("of_cell"), F.col("chunk").alias("of_chunk"), "query", "qvec", "bound")
        second = met.groupBy("length", "cell", "chunk").cogroup(again.groupBy("of_length", "of_cell", "of_chunk")).applyInArrow(searcher, FOUND)
        parts = first.unionByName(second.where("size(found) > 0"))
        # a list for each cell at most, each of k + 1
        parts = parts.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    named = asked.join(queries.select("query", F.col("qvec").alias("vec")), "vec").select("id", "query")
    hits = named.join(parts, "query").withColumn("found", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("id")), 1, k))
    hits = hits.select(F.col("id").alias("query_id"), F.posexplode("found").alias("pos", "f"))
    return hits.select("query_id", (F.col("pos") + 1).alias("rank"), "f.vec_id", (-F.col("f.minus")).alias("score"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_near_vectors": op13_near_vectors}
ORACLES: dict[str, str] = {}
