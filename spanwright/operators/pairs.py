"""Joins whose result is as large as the pairs of their groups, which may be far more than their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize

#: Pairs that one part of a key makes, about.
PAIRS = 10_000_000


def paired(rows: DataFrame, known: DataFrame, on: list[str], most: int = PAIRS) -> DataFrame:
    """The inner join of ``rows`` and ``known`` on the columns ``on``, to be the last step of its query or to be
    followed by filters only.  Both sides are written, as they are counted and then joined, and dealt into a fixed
    number of tasks, as their size says little about that of the result.  A key that makes more than ``most``
    pairs is cut: its ``rows`` are dealt into parts by their hash and its ``known`` go to each part, so there are
    never more copies of these than pairs."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, known = materialize(rows, "rows"), materialize(known, "known")
    many = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_l")).join(known.groupBy(*on).agg(F.count(F.lit(1)).alias("_r")), on)
    many = many.where(F.col("_l") * F.col("_r") > most).select(*on, F.least(F.ceil(F.col("_l") * F.col("_r") / most), F.col("_l")).cast("int").alias("_parts"))
    many = materialize(many, "many")
    key = list(on)
    if not many.isEmpty():
        # arrays may come in another order when a task runs again
        own = [c for c, kind in rows.dtypes if c not in on and not kind.startswith(("array", "map"))]
        rows = rows.join(many, on, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.expr(f"cast(pmod(xxhash64({', '.join(own)}), _parts) as int)"))).drop("_parts")
        known = known.join(many, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        key.append("_part")
    return rows.repartition(parts, *key).join(known.repartition(parts, *key).hint("merge"), key).drop("_part")


#: Rows that one file has at most where its tables are dealt by file.
ROWS = 1_000_000


#: Whether a join asks for tables that are dealt by all of its keys, and not by one of them.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def by_source(tables: list[DataFrame], run) -> DataFrame:
    """``run(*tables)``, whose joins and groups all have ``source`` among their keys, written, with each table
    dealt by it once, so that nothing is shuffled between them.  Files of more than ``ROWS`` rows in all go by
    the finer keys of ``run`` itself, spread over the tasks; there are few of them."""
    spark = tables[0].sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = tables[0].select("source")
    for other in tables[1:]:
        rows = rows.unionByName(other.select("source"))
    large = materialize(rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROWS).select("source"), "large")
    some = not large.isEmpty()
    plain = [t.join(F.broadcast(large), "source", "left_anti") for t in tables] if some else tables
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        out = materialize(run(*[t.repartition(parts, "source") for t in plain]), "by_source")
    finally:
        spark.conf.set(_ALL_KEYS, before)
    return out.unionByName(materialize(run(*[t.join(F.broadcast(large), "source", "left_semi") for t in tables]), "large_by_source")) if some else out
