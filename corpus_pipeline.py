"""The training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``:

1. language: documents that no learnt language model accepts go; the rest keep their rows;
2. near_duplicates: of each group that links of Jaccard 0.8 over five-word shingles reach, the
   document of the smallest id stays (one of equal rows), and texts without words stay;
3. repeats: bytes of strings of 400 bytes that also stand elsewhere are cut out, and a text that is
   nothing but such strings goes;
4. mix: each source comes near its target weight; a row is what one pass of the mix takes of a text;
5. packing: the pieces of the texts in sequences of at most 1024 tokens.

Any stage may get an empty table, null texts, repeated rows and further columns, which pass through.
"""

from __future__ import annotations

import threading

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm import jaccard_join, language_id, packing, repeat_index, shared, source_mix


_left = threading.local()  # of each thread: tables that its stage before wrote on its way, by corpus


def _alone(stage):
    """The stage, which first removes what the one before left: its result has been written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.small_batches(spark)
        left = vars(_left).setdefault(f"{spark.sparkContext.applicationId} {sf_dir}", [])
        shared.remove(spark, left)
        left.clear()
        with shared.recorded(left):
            return stage(spark, docs, sf_dir)

    return run


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").where(shared.crc_mod("doc_id", 4) != 2)
    return language_id.accepted(docs, language_id.fit(known))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    kept = repeat_index.with_kept(docs).where("__removed < __bytes or __bytes = 0")
    # a cut inside a character leaves bytes that are no text: they become replacement characters
    text = F.when(F.col("__removed") == 0, F.col("text")).otherwise(F.expr("make_valid_utf8(cast(__kept as string))"))
    return kept.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*columns)


def _taken(batches):
    """Texts of the words ``[first, first + words)`` of each listed part, joined by blanks."""
    for batch in batches:
        data, off = shared.byte_view(batch.column("text"))
        names = [n for n in batch.schema.names if n not in ("text", "__parts")]
        for i, j in shared.rounds(off):
            part = data[off[i] : off[j]]
            start, end, first = shared.word_bounds(part, off[i : j + 1] - off[i])
            raw, out, parts = part.tobytes(), [], batch.column("__parts").slice(i, j - i)
            for t in range(j - i):
                rows = parts.slice(t, 1).flatten()
                a, n = rows.field("first").to_numpy(), rows.field("words").to_numpy()
                pieces = []
                for k in np.argsort(a, kind="stable"):
                    w = first[t] + a[k]
                    pieces.append(raw[start[w] : end[w + n[k] - 1]])
                out.append(b" ".join(pieces).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, j - i) for n in names), pa.array(out, pa.string())], [*names, "text"])


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, sources = source_mix.layout(docs)
    parts = source_mix.mixture(rows, sources).groupBy("doc_id", "h", "row", "pass").agg(F.collect_list(F.struct("first", "words")).alias("__parts"))
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    once = docs.withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "__h"])
    parts = parts.select(F.col("doc_id").alias("__id"), F.col("h").alias("__hash"), "__parts")
    joined = once.join(parts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash"))).select(*rest, "text", "__parts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema) + ", text string"
    mixed = joined.mapInArrow(_taken, schema)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", _alone(_language)),
    ("jaccard_join", _alone(_near_duplicates)),
    ("repeat_index", _alone(_repeats)),
    ("source_mix", _alone(_mix)),
    ("packing", _alone(_packing)),
]

#: Kneser-Ney models, pseudorandom permutations and a tokenizer are beyond SQL: tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), name)
    return docs
