"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words (lower case, split at ASCII white space) give one hash per k words; of each window
of ``window`` consecutive k-gram hashes the smallest is chosen, the rightmost of equal ones, and its
word position is kept.  Any run of ``k + window - 1`` words that two texts share leaves a common
fingerprint.  A choice is one long: 33 bits of hash, then ``2**30 - 1 - position``, so that the
smaller long is also the rightmost of equal hashes; a string holds fewer than 2**30 words.

The sliding minimum doubles its width (1, 2, 4, .. windows), one linear pass for each doubling, so a
long text costs time in proportion to its length.

Null text: empty.  Texts without words have the empty fingerprint, and two empty ones are alike (1).
Texts shorter than k words or than a window have one fingerprint.  Equal texts have equal
fingerprints.  Repeated ids are ordered by the hash of their text; null ids follow after all others.  Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K = 5
WINDOW = 16  # a power of two
_LAST = (1 << 30) - 1
#: Rows of a range of ids, and ranges at most: the ranges' first ids are the only data broadcast.
RANGE_ROWS, RANGES = 20_000, 1 << 16


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: the chosen (hash, position) longs of column ``text``, in text order."""
    tmp = f"__{out}"
    cols = df.columns
    df = df.withColumn(tmp, F.expr(f"filter(split(lower(coalesce({text}, '')), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"))
    df = df.withColumn(tmp, F.expr(f"transform({tmp}, w -> xxhash64(w))"))
    gram = ", ".join(f"get({tmp}, i + {j})" for j in range(k))
    df = df.withColumn(
        tmp,
        F.expr(
            f"if(size({tmp}) = 0, cast(array() as array<bigint>), transform(sequence(0, greatest(size({tmp}) - {k}, 0)),"
            f" i -> shiftleft(shiftrightunsigned(xxhash64({gram}), 31), 30) + ({_LAST} - i)))"
        ),
    )
    df = df.withColumn(f"{tmp}n", F.size(tmp))
    width = 1
    while width < window:
        df = df.withColumn(tmp, F.expr(f"zip_with({tmp}, slice({tmp}, {width + 1}, {tmp}n), (x, y) -> least(x, y))"))
        width *= 2
    # windows that overhang the end are dropped, but for a text of less than one window
    df = df.withColumn(out, F.expr(f"array_distinct(slice({tmp}, 1, if({tmp}n = 0, 0, greatest({tmp}n - {window - 1}, 1))))"))
    return df.select(*[c for c in cols if c != out], out)


def shown(fp: str) -> Column:
    """``hash:position`` in hexadecimal, joined by blanks."""
    return F.expr(f"array_join(transform({fp}, v -> concat(lower(hex(shiftright(v, 30))), ':', lower(hex({_LAST} - (v & {_LAST}))))), ' ')")


def hashes(fp: str) -> Column:
    return F.expr(f"array_distinct(transform({fp}, v -> shiftright(v, 30)))")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def id_ranges(docs: DataFrame, id_col: str) -> Column:
    """The range of ids a row is in, 0 and up, of about RANGE_ROWS rows each."""
    n = docs.count()
    parts = min(RANGES, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS)))
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else None
    bounds = []
    if n and at is not None:
        bounds = docs.agg(F.percentile_approx(id_col, at, F.lit(max(10_000, 10 * parts)))).first()[0] or []
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = ",".join(f"{b}L" for b in bounds[::step])
    every = ",".join(f"{b}L" for b in bounds)
    before = f"size(filter(array({coarse}), b -> b <= {id_col}))"
    return F.expr(
        f"if({before} = 0, 0, ({before} - 1) * {step} + size(filter(slice(array({every}), ({before} - 1) * {step} + 1, {step}), b -> b <= {id_col})))"
    )


def with_next(docs: DataFrame, id_col: str, carried: list[str], add: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``next_<c>`` of each carried column: the value of the row that follows by descending
    id; after the last comes the first.  One shuffle: rows go by range of ids, and each range also
    gets the first row of the range below it.  ``add`` adds columns once those first rows are there, so that
    it works on each row once."""
    ranged = docs.withColumn("__range", id_ranges(docs, id_col))
    order = F.xxhash64(carried[0])
    # the first row of a range: the greatest id, null only where there is no other, then the least hash
    heads = ranged.groupBy("__range").agg(F.max(F.struct(F.col(id_col).alias("id"), F.bitwise_not(order).alias("h"))).alias("__head"))
    # at most RANGES rows from here on: one task, and small enough to broadcast
    down = W.orderBy(F.desc("__range"))
    heads = heads.select(
        F.col("__head.id").alias("__head"), F.bitwise_not("__head.h").alias("__hash"),
        F.coalesce(F.lag("__range").over(down), F.first("__range").over(W.orderBy("__range"))).alias("__to"),
    )
    guests = ranged.join(F.broadcast(heads), ranged[id_col].eqNullSafe(heads["__head"]) & (order == heads["__hash"]))
    guests = guests.withColumn("__range", F.col("__to")).drop("__head", "__hash", "__to").dropDuplicates(["__range"])
    rows = ranged.withColumn("__guest", F.lit(False)).unionByName(guests.withColumn("__guest", F.lit(True)))
    if add is not None:
        rows = add(rows)
    after = W.partitionBy("__range").orderBy("__guest", F.desc(id_col), order)
    for c in carried:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(after))
    return rows.where("not __guest").drop("__range", "__guest")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the last half (rounded down) of its code
    points replaced by as many first ones of the next text; with their likenesses."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts, "doc_id", ["text", "fp"], lambda rows: with_fingerprint(rows, "text", "fp"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 2)), left(next_text, int(n_chars div 2)))"))
    rows = rows.select("doc_id", "n_chars", "edited", "fp", "next_fp")
    rows = with_fingerprint(rows, "edited", "edited_fp")
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "edited_fp",
        hashes("fp").alias("h"), hashes("edited_fp").alias("he"), hashes("next_fp").alias("hn"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"),
        likeness("h", "he").alias("near_edited"), likeness("h", "hn").alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_fingerprints": op4_fingerprints}
ORACLES: dict[str, str] = {}
