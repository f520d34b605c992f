"""Multi-version tables: a log (key, revision, seq, deleted, value) read as of a revision.

Aggregates with map-side combination where only the newest row of a key counts, ordered scans by
segments (:mod:`.segments`) where its history does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segments import carried, segmented, with_carry


def drop_noop_deletes(log: DataFrame) -> DataFrame:
    """A delete of a key that was never put is no row; later deletes are tombstones.  Comes before
    :func:`compact_same_revision`: a put and a delete in one revision still make the key known.  Puts
    stay where they are; deletes meet each key's first put, which is aggregated map side first."""
    puts = log.where("not deleted")
    first = puts.groupBy("key").agg(F.min(F.struct("revision", "seq")).alias("_first"))
    known = log.where("deleted").join(first, "key").where(F.struct("revision", "seq") > F.col("_first"))
    return puts.unionByName(known.drop("_first"))


def compact_same_revision(log: DataFrame) -> DataFrame:
    """Of several rows of one key at one revision the last (by seq) stays."""
    best = F.max_by(F.struct("seq", "deleted", "value"), "seq").alias("r")
    return log.groupBy("key", "revision").agg(best).select("key", "revision", "r.seq", "r.deleted", "r.value")


def heads(log: DataFrame) -> DataFrame:
    """The newest live value of each key (key, revision, value)."""
    newest = F.max_by(F.struct("revision", "deleted", "value"), F.struct("revision", "seq")).alias("r")
    return log.groupBy("key").agg(newest).where("not r.deleted").select("key", "r.revision", "r.value")


def latest(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Heads of the given keys."""
    return heads(log.join(keys.select("key"), "key", "left_semi"))


def snapshot_at(log: DataFrame, revision: int) -> DataFrame:
    """Every key alive at ``revision``."""
    return heads(log.where(F.col("revision") <= revision))


def as_of_join(probes: DataFrame, log: DataFrame) -> DataFrame:
    """Probes (key, at, ..) with ``value``: of the newest version with revision <= at, null if that is
    a tombstone or there is none.  Versions and places asked for meet in ordered windows, by segments of
    keys that have very many; the last version of a segment is carried into the next.  Probes of one place
    ask once."""
    version = log.select("key", F.col("revision").alias("at"), F.struct("deleted", "value").alias("v"), F.col("seq").alias("s"))
    asked = probes.select("key", "at").distinct().select("key", "at", F.lit(None).cast(version.schema["v"].dataType).alias("v"), F.lit(None).cast("bigint").alias("s"))
    both = segmented(version.withColumn("_probe", F.lit(False)).unionByName(asked.withColumn("_probe", F.lit(True))), "key", "at")
    tail = F.max_by("v", F.when(~F.col("_probe"), F.struct("at", "s")))
    carry = carried(both, "key", tail, lambda c: F.last(c, ignorenulls=True))
    order = W.partitionBy("key", "_segment").orderBy(F.col("at"), F.col("v").isNull(), F.col("s")).rowsBetween(W.unboundedPreceding, 0)
    seen = with_carry(both.withColumn("w", F.last("v", ignorenulls=True).over(order)).where("_probe").select("key", "at", "_segment", "w"), "key", carry)
    found = seen.withColumn("w", F.coalesce("w", "_carry")).select("key", "at", F.when(~F.col("w.deleted"), F.col("w.value")).alias("value"))
    extra = [c for c in probes.columns if c not in ("key", "at")]
    return probes.join(found, ["key", "at"]).select("key", "at", *extra, "value")


def assign_revisions(events: DataFrame, order: str = "seq") -> DataFrame:
    """``revision`` 1, 2, .. over all rows by ``order``: rows are ranged by it, counted by range, and
    numbered within each range from where the one before ends; no task sees all rows."""
    spark = events.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = events.agg(F.percentile_approx(order, F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5)))).first()[0] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(cut))]) if cut else F.array().cast("array<bigint>")
    ranged = events.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(order))))
    counts = ranged.groupBy("_range").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(W.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_nth", within).join(F.broadcast(before), "_range").withColumn("revision", F.col("_before") + F.col("_nth")).drop("_range", "_nth", "_before")


def vacuum(log: DataFrame, oldest_in_use: int) -> DataFrame:
    """Drops a version if a newer one of its key is no younger than ``oldest_in_use``, and a
    surviving tombstone if nothing older is left below it.  Younger versions stay where they are; of
    the others each key's newest is aggregated map side first, so a hot key is never gathered."""
    young = log.where(F.col("revision") > oldest_in_use)
    last = F.max_by(F.struct(*[c for c in log.columns if c != "key"]), F.struct("revision", "seq")).alias("r")
    old = log.where(F.col("revision") <= oldest_in_use).groupBy("key").agg(last).where("not r.deleted").select("key", "r.*")
    return young.unionByName(old.select(*log.columns))


def stale_index_rows(index: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of an index whose key has no live head."""
    return index.join(heads(log).select("key"), "key", "left_anti")


def changed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources (source, change) whose contents differ between two tables (source, contents)."""
    a = old.select("source", F.sha2(F.col("contents").cast("binary"), 256).alias("a"))
    b = new.select("source", F.sha2(F.col("contents").cast("binary"), 256).alias("b"))
    both = a.join(b, "source", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("source", F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").otherwise("CHANGED").alias("change"))


def in_search_scope(df: DataFrame, visible: DataFrame | None) -> DataFrame:
    """Rows whose source is visible; without a scope all rows."""
    return df if visible is None else df.join(visible.select("source"), "source", "left_semi")


def replace_contribution(current: DataFrame, new: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """A source's rows in ``new`` replace all that it declared before; a source listed in ``sources``
    (source) that has none there declares nothing any more."""
    told = new.select("source") if sources is None else new.select("source").unionByName(sources.select("source"))
    return current.join(told.distinct(), "source", "left_anti").unionByName(new)
