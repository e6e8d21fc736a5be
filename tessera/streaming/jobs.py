"""Description jobs as a stream: a state machine for each job, and upserts of what it emits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.schema import MAX_ATTEMPTS


def next_state(status: str | None, attempts: int, kind: str, max_attempts: int = MAX_ATTEMPTS) -> tuple[str | None, int]:
    if kind == "enqueue":
        return "pending", 0
    if kind == "claim" and status == "pending":
        return "processing", attempts + 1
    if status == "processing" and kind == "done":
        return "done", attempts
    if status == "processing" and kind == "fail":
        return ("failed" if attempts >= max_attempts else "pending"), attempts
    return status, attempts


def job_stream(events: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """(key, status, attempts) after each micro-batch, for the jobs that it touched."""
    key_type = events.schema[key].dataType.simpleString()

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for e in rows[kind]:
            status, attempts = next_state(status, attempts, e)
        state.update((status, attempts))
        if status is not None:
            yield pd.DataFrame({key: [k[0]], "status": [status], "attempts": [attempts]})

    return events.select(key, *order, kind).groupBy(key).applyInPandasWithState(fold, f"{key} {key_type}, status string, attempts long", "status string, attempts long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """Counts by event-time window, closed when the watermark passes."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", width), by).agg(F.count("*").alias("n"))


def upserts(path: str, key: list[str], version: str = "batch_id"):
    """A foreachBatch sink that appends each batch's rows once, under its id; read_latest() gives the table."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.dropDuplicates(key).withColumn(version, F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/{version}={batch_id}")

    return write


def read_latest(spark, path: str, key: list[str], version: str = "batch_id") -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in (*key, version)]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("last")).select(*key, "last.*")


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "update") -> None:
    """Works off what has arrived, then stops."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_forever(stream: DataFrame, sink, checkpoint: str, every: str = "5 seconds", mode: str = "update") -> StreamingQuery:
    """Polls for what arrives until the returned query is stopped."""
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def apply_stream(changes: DataFrame, apply, checkpoint: str) -> None:
    """Works off a stream of change records (status, path, old_path, content): each micro-batch is one call of apply(changes, contents).

    Of several records for a path in a batch all count as changes, and the last content by `at` is the
    path's. A batch that is repeated after a failure applies again and leaves the same tables.
    """

    def write(rows: DataFrame, _: int) -> None:
        last = rows.filter("content is not null").groupBy(F.col("path").alias("file_path")).agg(F.max_by("content", "at").alias("content"))
        apply(rows.select("status", "path", "old_path").distinct(), last)

    run_available(changes, write, checkpoint, "append")
