"""Ordered scans of keyed rows, however many rows a key has.

A key with more rows than a task should have is cut along its order into segments of about that many;
each segment is scanned on its own, and what the segments before it end with is carried in.  Keys with
more than one n-th of all rows are fewer than n, so their bounds fit in a broadcast table whatever the
data; all other keys are one segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segmented(rows: DataFrame, key: str, order: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``_segment``, which ascends with ``order`` (a number) within each key.  Two passes over
    key and order: counts by key, map side first, and quantiles of the keys that have most."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    heavy = counts.where(F.col("_n") * parts > total).select(F.col(key).alias("_key"))  # fewer than ``parts`` keys
    share = [i / parts for i in range(1, parts)] or [0.5]
    cuts = rows.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_key"))).groupBy("_key").agg(F.array_distinct(F.percentile_approx(order, F.array(*map(F.lit, share)), 10_000)).alias("_cuts"))
    cut = rows.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_key")), "left")
    segment = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(order))), F.lit(0))
    return cut.withColumn("_segment", F.when(F.col("_cuts").isNull(), 0).otherwise(segment)).drop("_key", "_cuts")


def carried(rows: DataFrame, key: str, tail: Column, combine) -> DataFrame:
    """(key, _segment, _carry) of the second and later segments of cut keys: ``combine`` (an aggregate over a
    window, in order of the segments before) of what ``tail`` (an aggregate) gives for each of them.  There
    are no more rows than segments."""
    tails = rows.groupBy(key, "_segment").agg(tail.alias("_tail"))
    cut = tails.where("_segment > 0").select(F.col(key).alias("_k")).distinct()
    tails = tails.join(F.broadcast(cut), F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    before = W.partitionBy(key).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    return tails.select(F.col(key).alias("_k"), F.col("_segment").alias("_s"), combine("_tail").over(before).alias("_carry"))


def with_carry(rows: DataFrame, key: str, carry: DataFrame) -> DataFrame:
    """``rows`` with ``_carry``, null in first segments."""
    return rows.join(F.broadcast(carry), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_segment") == F.col("_s")), "left").drop("_k", "_s")
