"""The edit feed as Structured Streaming: events (seq, event, uri, version, changes) of open, change
and close become versions of texts, newest texts, and diagnostics that follow the edits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.segments import carried, segmented, with_carry
from ..sources.tables import exists, materialize, replace_in_buckets

EVENTS = "seq long, event string, uri string, version int, changes array<string>"


def edit_stream(events: DataFrame) -> DataFrame:
    """Version rows (source, revision, version, contents) of open and change events: of several
    changes the last counts, an event without one is ignored."""
    kept = events.where("event in ('OPEN', 'CHANGE') and size(changes) > 0")
    return kept.select(F.col("uri").alias("source"), F.col("seq").alias("revision"), "version", F.element_at("changes", -1).alias("contents"))


class InOrder(StatefulProcessor):
    """Per source the newest revision and its text.  Rows of a batch are taken in order of ``seq``; one that
    is older than what is held is late (an equal revision replaces) and goes out as such, not into the
    state.  ``every``: all kept rows go out, else only the newest.  A state that no row has met for
    ``expire_ms`` is dropped by a timer.  The rows of a source in one batch, which the trigger bounds, are
    handled as arrays."""

    def __init__(self, every: bool, expire_ms: int | None):
        self.every, self.expire_ms = every, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("newest", "revision long, contents string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        revision = frame["revision"].to_numpy()
        before = self.held.get()[0] if self.held.exists() else np.iinfo(np.int64).min
        top = np.maximum.accumulate(np.concatenate([[before], revision]))
        late = revision < top[:-1]
        kept = frame[~late]
        if len(kept):
            last = kept.iloc[-1]
            self.held.update((int(last["revision"]), last["contents"]))
        if self.expire_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        out = pd.concat([kept if self.every else kept.tail(1), frame[late]])
        yield out[["source", "revision", "seq", "contents"]].assign(late=[False] * (len(out) - int(late.sum())) + [True] * int(late.sum()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def heads_stream(versions: DataFrame, every: bool = False, expire_ms: int | None = None) -> DataFrame:
    """Keyed state over (source, revision, contents, and seq where rows do not arrive by revision): after each
    batch the newest row of each source that has one, and the rows that came late.  A close leaves the
    text.  Run it with ``stateful`` in :func:`run_batches`, but with ``expire_ms``, whose timers make batches
    without data too, with a trigger that goes on until the query is stopped."""
    rows = versions if "seq" in versions.columns else versions.withColumn("seq", F.col("revision"))
    rows = rows.select("source", "revision", "seq", "contents")
    return rows.groupBy("source").transformWithStateInPandas(
        statefulProcessor=InOrder(every, expire_ms), outputStructType="source string, revision long, seq long, contents string, late boolean", outputMode="update", timeMode="None" if expire_ms is None else "ProcessingTime"
    )


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", stateful: bool = False) -> None:
    """Runs a stream over what is there; a micro-batch is the barrier at which analysis may read.  The state
    store of ``stateful`` streams is chosen for this stream alone; its files are under ``checkpoint``."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    if stateful:
        conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
        query.awaitTermination()
    finally:
        if stateful:
            conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)


def split_late(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with two outputs: kept rows and late ones, by batch, so that one that runs again replaces
    itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.where("not late").drop("late").write.mode("overwrite").parquet(f"{path}/kept/batch={batch_id}")
        batch.where("late").drop("late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        batch.unpersist()

    return each


def append_versions(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each batch to the version log in a folder of its own, so that a batch that
    runs again replaces itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each


def diagnostics_stream(events: DataFrame, checkpoint: str, path: str, facts: Callable[[DataFrame], DataFrame], diagnose: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 16) -> None:
    """Keeps diagnostics up to date over batches of edits.

    A batch appends its versions to the log in ``path`` and is then a barrier: it reads the log as of its own
    last revision, whatever has been appended since.  ``facts`` turns newest texts (source, contents) into rows
    (source, kind DECLARES or WANTS, name, start_at, end_at), which replace what those sources had in the
    table of facts, bucket by bucket.  Sources that want a name which an edited one declares, or did before,
    depend on it; for them and the edited ones ``diagnose`` (their wants, all that is declared) is run
    again, and the full list of each (source, version, start_at, end_at, code, message) is published.  A closed source gets a row
    without diagnostics and version.  A batch that runs again leaves the same tables."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
        batch = spark.read.schema(batch.schema).parquet(f"{path}/log/batch={batch_id}")
        at = batch.agg(F.max("seq")).first()[0]
        if at is None:
            return
        told = batch.select(F.col("uri").alias("source")).distinct()
        log = spark.read.schema(batch.schema).parquet(*[f"{path}/log"]).where(F.col("seq") <= at).withColumnRenamed("uri", "source").join(told, "source", "left_semi")
        last = log.groupBy("source").agg(F.max_by(F.struct("event", "version"), "seq").alias("e"), F.max_by(F.element_at("changes", -1), F.when(F.size("changes") > 0, F.col("seq"))).alias("contents"))
        last = materialize(last.select("source", "e.event", "e.version", "contents"), "edited")
        fresh = materialize(facts(last.where("contents is not null").select("source", "contents")), "facts")
        where, seen = f"{path}/facts", f"{path}/published"
        before = spark.read.parquet(where).drop("bucket") if exists(spark, where) else fresh.limit(0)
        names = fresh.unionByName(before.join(told, "source", "left_semi")).where("kind = 'DECLARES'").select("name").distinct()
        asking = before.where("kind = 'WANTS'").join(names, "name", "left_semi").select("source")
        names = materialize(asking.unionByName(told).distinct(), "asking")
        replace_in_buckets(where, fresh, last.select("source"), buckets)
        every = spark.read.schema(fresh.schema).parquet(where)
        found = diagnose(every.where("kind = 'WANTS'").join(names, "source", "left_semi"), every.where("kind = 'DECLARES'"))
        old = spark.read.parquet(seen).drop("bucket") if exists(spark, seen) else None
        state = last.select("source", "event", "version")
        if old is not None:  # dependants keep the version that they were published with
            kept = old.groupBy("source").agg(F.max_by(F.struct("event", "version"), "batch").alias("e")).select("source", "e.*").join(names, "source", "left_semi")
            state = state.unionByName(kept.join(last, "source", "left_anti"))
        shown = state.join(found, "source", "left")
        gone = [F.when(F.col("event") != "CLOSE", F.col(c)).alias(c) for c in ("version", *[c for c in found.columns if c != "source"])]
        rows = materialize(shown.select("source", "event", *gone, F.lit(batch_id).alias("batch")), "published")
        replace_in_buckets(seen, rows, rows.select("source"), buckets)

    run_batches(events, checkpoint, each)


def late_policy(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, revision, seq, ..) in order of arrival (seq): those that come in ascending revisions
    (an equal one replaces), and those that come late, which are dropped.  A key with very many rows is
    scanned by segments, into which the highest revision so far is carried."""
    cut = segmented(log, "key", "seq")
    carry = carried(cut, "key", F.max("revision"), F.max)
    before = W.partitionBy("key", "_segment").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = with_carry(cut.withColumn("_before", F.max("revision").over(before)), "key", carry)
    rows = rows.withColumn("_late", F.col("revision") < F.coalesce(F.greatest("_before", "_carry"), "revision")).drop("_before", "_carry", "_segment")
    return rows.where(~F.col("_late")).drop("_late"), rows.where(F.col("_late")).drop("_late")


def snapshots_stream(events: DataFrame, checkpoint: str, path: str) -> None:
    """A barrier for each batch: its versions are written to the log first, and the analysis then
    reads the log as of the batch's last revision, whatever has been appended since."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
        at = batch.agg(F.max("revision")).first()[0]
        if at is None:
            return
        log = spark.read.parquet(f"{path}/log").where(F.col("revision") <= at)
        newest = log.groupBy("source").agg(F.max_by("contents", "revision").alias("contents"), F.max("revision").alias("revision"))
        newest.withColumn("as_of", F.lit(at)).write.mode("overwrite").parquet(f"{path}/snapshots/batch={batch_id}")

    run_batches(edit_stream(events), checkpoint, each)
