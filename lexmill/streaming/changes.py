"""File-change feeds as streams: duplicates, counts per minute, late rows and the current version of each file."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from lexmill.operators.index import has_index, open_index, update_index
from lexmill.operators.maintain import latest
from lexmill.operators.symbols import shared_folder

LATE = "24 hours"


def read_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def drop_duplicates(changes: DataFrame, keys: tuple[str, ...] = ("filename", "ts")) -> DataFrame:
    """Each change of a file at a time once within the lateness bound; state older than that is dropped."""
    return changes.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(list(keys))


def file_states(changes: DataFrame) -> DataFrame:
    """A stream of file states: after each micro-batch a row for each file it touches, with the newest change so far (ts,
    then event_id) and the number of changes seen. The state of a file is these three numbers."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, event, seen = state.get if state.exists else (-1, -1, 0)
        for rows in batches:
            newest, event = max([(newest, event), *zip(rows["micros"].tolist(), rows["event_id"].tolist(), strict=True)])
            seen += len(rows)
        state.update((int(newest), int(event), int(seen)))
        yield pd.DataFrame({"filename": [key[0]], "micros": [newest], "event_id": [event], "n_seen": [seen]})

    rows = changes.select("filename", F.unix_micros("ts").alias("micros"), F.col("event_id").cast("long").alias("event_id"))
    return rows.groupBy("filename").applyInPandasWithState(advance, "filename string, micros long, event_id long, n_seen long", "micros long, event_id long, seen long", "update", GroupStateTimeout.NoTimeout)


def last_states(changes: DataFrame) -> DataFrame:
    """The last state of each file after a run over what is there."""
    spark = changes.sparkSession
    path = f"{shared_folder(spark)}/states-{uuid.uuid4()}"
    run_to_end(file_states(changes), "update", lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    rows = spark.read.parquet(path)
    return rows.groupBy("filename").agg(F.max_by(F.struct("micros", "event_id", "n_seen"), "n_seen").alias("s")).select("filename", "s.*")


def per_minute(changes: DataFrame) -> DataFrame:
    """Changes per project in tumbling windows of 60 seconds."""
    grouped = changes.withWatermark("ts", LATE).groupBy(F.window("ts", "60 seconds").alias("w"), "project_root")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "project_root", "n")


def split_late(changes: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the last day, and the rows for the slow path."""
    bound = F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 24 HOURS")
    return changes.where(F.col("ts") >= bound), changes.where(F.col("ts") < bound)


def current_versions(changes: DataFrame) -> DataFrame:
    """The newest change of each file that is no delete."""
    return latest(changes, "filename", "ts", "event_id").where("op <> 'delete'")


def apply_changes(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The newest row of each file of the state and a micro-batch; older changes than the stored one are ignored."""
    rows = batch if state is None else state.unionByName(batch)
    return latest(rows, "filename", "ts", "event_id")


def run_to_end(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> DataFrame | None:
    """Run a stream over what is there. The rows go to Parquet in `folder` and come back as a DataFrame, or to `each`.

    A run with the same `folder` goes on where the last one ended.
    """
    spark = stream.sparkSession
    base = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def replay(changes: DataFrame, folder: str | None = None, parts: int = 64) -> DataFrame:
    """Final state of a change stream. The state lies in `parts` parts by file name; a micro-batch is merged into the
    parts it touches and their new versions are written beside the old ones, so others are not written again.

    Which version of a part counts is written beside the data too, after it: a run that is cut off in a batch starts that batch
    again from the versions before it, whatever the cut one left.
    """
    spark = changes.sparkSession
    base = folder or f"{shared_folder(spark)}/versions-{uuid.uuid4()}"
    part = F.pmod(F.xxhash64("filename"), F.lit(parts)).cast("int")

    def newest(session: SparkSession, before: int | None) -> dict[int, str]:
        rows = _read_or_none(session, f"{base}/pointers")
        if rows is None:
            return {}
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return {r["part"]: f"{base}/version={r['batch']}/part={r['part']}" for r in rows.groupBy("part").agg(F.max("batch").alias("batch")).collect()}  # `parts` rows

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("part", part)
        touched = [r[0] for r in rows.select("part").distinct().collect()]  # at most `parts` numbers
        before = newest(session, number)
        known = [before[p] for p in touched if p in before]
        state = session.read.option("basePath", base).parquet(*known).select(rows.columns) if known else None
        apply_changes(state, rows).write.mode("overwrite").partitionBy("part").parquet(f"{base}/version={number}")
        session.createDataFrame([(p,) for p in touched], "part int").coalesce(1).write.mode("overwrite").parquet(f"{base}/pointers/batch={number}")

    run_to_end(changes, each=merge, folder=base)
    left = newest(spark, None)
    if not left:
        return spark.createDataFrame([], changes.schema)
    return spark.read.option("basePath", base).parquet(*left.values()).select(changes.columns).where("op <> 'delete'")


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def index_changes(changes: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], folder: str, shards: int | None = None) -> None:
    """Run a change stream into the stored index at `path`; `make` gives the entities (with filename) of changed files.

    Each micro-batch is one segment of the index, named after the batch: entities of the files it touches go, those of files that
    are there afterwards come, and the newest change of each file (ts, then event_id) is stored with it, so late
    changes are ignored, also after a delete. A batch that was committed is not applied again; one that was cut off is written
    anew. A run with the same `folder` goes on where the last one ended.
    """

    def commit(batch: DataFrame, number: int) -> None:
        session, name = batch.sparkSession, f"{folder} {number}"
        index = open_index(session, path) if has_index(session, path) else None
        if index is not None and name in index.batches:
            return
        newest = apply_changes(None, batch)
        gone = None
        if index is not None:
            known = index.table("versions").join(newest.select("filename"), "filename", "left_semi")
            known = known.groupBy("filename").agg(F.max(F.struct("ts", "event_id")).alias("known"))
            newest = newest.join(known, "filename", "left").where(F.col("known").isNull() | (F.struct("ts", "event_id") > F.col("known"))).drop("known")
            gone = index.entities().join(newest.select("filename"), "filename", "left_semi").select("id")
        update_index(make(newest.where("op <> 'delete'")), path, gone, name, shards, beside={"versions": newest.select("filename", "ts", "event_id")})

    run_to_end(changes, each=commit, folder=folder)


class _Watched(StatefulProcessor):
    """Per file: the newest change and the number of changes. A file without a change for `quiet` milliseconds of event time is
    given out for verification once, and its state is dropped."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [StructField(c, LongType()) for c in ("micros", "event_id", "seen")]
        self.state = handle.getValueState("newest", StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, event, seen = self.state.get() if self.state.exists() else (-1, -1, 0)
        for batch in rows:
            newest, event = max([(newest, event), *zip(batch["micros"].tolist(), batch["event_id"].tolist(), strict=True)])
            seen += len(batch)
        self.state.update((int(newest), int(event), int(seen)))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(newest // 1000 + self.quiet, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, event, seen = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"filename": [key[0]], "micros": [newest], "event_id": [event], "n_seen": [seen], "due_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def quiet_files(changes: DataFrame, hours: int = 24) -> DataFrame:
    """A stream of files that had no change for `hours` of event time: filename, micros and event_id of the newest change, n_seen
    (changes since the file was last given out), due_ms (when it fell due). State does not outlive that time.

    Needs a state store with timers: `spark.sql.streaming.stateStore.providerClass` must name the RocksDB provider.
    """
    rows = changes.select("filename", "ts", F.unix_micros("ts").alias("micros"), F.col("event_id").cast("long").alias("event_id"))
    rows = rows.withWatermark("ts", "0 seconds")
    return rows.groupBy("filename").transformWithStateInPandas(_Watched(hours * 3_600_000), "filename string, micros long, event_id long, n_seen long, due_ms long", "append", "EventTime")
