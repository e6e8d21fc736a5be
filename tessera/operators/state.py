"""State tables: description jobs, drift between stores, repair candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import shortened
from tessera.schema import COLLECTIONS, MAX_ATTEMPTS


def fold_jobs(events: DataFrame, key: str, order: list[str], kind: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(key, status, attempts) after events enqueue, claim, fail and done.

    Enqueueing resets a job. A claim of a pending job makes it processing and counts an attempt; a
    failure ends it at max_attempts and else makes it pending again; done ends it. Events that a job's
    state has no use for change nothing. A job is the fold of its own events, sorted as an array.
    """
    state = "struct<status:string,attempts:bigint>"
    make = lambda status, attempts: F.struct(F.lit(status).alias("status"), attempts.cast("long").alias("attempts"))

    def step(s, e):
        k = e[kind]
        return (
            F.when(k == "enqueue", make("pending", F.lit(0)))
            .when((k == "claim") & (s["status"] == "pending"), make("processing", s["attempts"] + 1))
            .when((k == "fail") & (s["status"] == "processing") & (s["attempts"] >= max_attempts), make("failed", s["attempts"]))
            .when((k == "fail") & (s["status"] == "processing"), make("pending", s["attempts"]))
            .when((k == "done") & (s["status"] == "processing"), make("done", s["attempts"]))
            .otherwise(s)
        )

    log = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, kind))).alias("log"))
    end = F.aggregate("log", F.lit(None).cast(state), step)
    return log.select(key, end.alias("end")).filter("end is not null").select(key, "end.*")


def claim(jobs: DataFrame, batch: int) -> DataFrame:
    """The next pending jobs, oldest first, as processing."""
    return jobs.filter("status = 'pending'").orderBy("enqueued_at", "chunk_id").limit(batch).withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1})


def released(jobs: DataFrame, now, lease_seconds: int) -> DataFrame:
    """Jobs with claims older than a lease pending again."""
    old = (F.col("status") == "processing") & (F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(lease_seconds)))
    return jobs.withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


def soft_deleted(files: DataFrame, gone: DataFrame) -> DataFrame:
    mark = gone.select("file_path").distinct().withColumn("__gone", F.lit(True))
    met, hit = files.join(mark, "file_path", "left"), F.col("__gone").isNotNull()
    empty = F.array().cast("array<string>")
    return met.withColumns({"status": F.when(hit, "deleted").otherwise(F.col("status")), "chunk_ids": F.when(hit, empty).otherwise(F.col("chunk_ids")), "dirty": ~hit & F.col("dirty")}).drop("__gone")


def intents(files: DataFrame, operation: str, kind: str, state: str) -> DataFrame:
    """Log entries (operation_id, at, state, kind, file_path, error) of one operation on each of some files (file_path, maybe error)."""
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    return files.select(
        F.concat_ws(":", F.lit(operation), "file_path").alias("operation_id"), F.current_timestamp().alias("at"), F.lit(state).alias("state"), F.lit(kind).alias("kind"), "file_path", shortened(error).alias("error"))


def described(jobs: DataFrame, outcomes: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Claimed jobs after a worker's outcomes (chunk_id, found, description, error): what was not found is done, an empty description is a failure."""
    met = jobs.join(outcomes.select("chunk_id", "found", "description", F.col("error").alias("__error")), "chunk_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    good = ~F.col("found") | (F.coalesce("description", F.lit("")) != "")
    status = F.when(good, "done").when(F.col("attempts") >= max_attempts, "failed").otherwise("pending")
    error = F.when(~good, shortened(F.coalesce("__error", F.lit("empty description"))))
    return met.withColumns({"status": status, "error": error}).select(*dict.fromkeys([*jobs.columns, "error"]))


def open_intents(log: DataFrame) -> DataFrame:
    """Operations of an intent log (operation_id, at, state, ...) whose last entry is neither done nor failed."""
    rest = [c for c in log.columns if c != "operation_id"]
    last = log.groupBy("operation_id").agg(F.max_by(F.struct(*rest), F.struct("at", "state")).alias("last")).select("operation_id", "last.*")
    return last.filter("state not in ('done', 'failed')")


def stamped(written: DataFrame) -> DataFrame:
    """Rows of the file index for files that were indexed just now: no longer dirty."""
    return written.withColumns({"dirty": F.lit(False), "indexed_at": F.current_timestamp()})


def drift(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual) where the counts of two stores differ; a key missing from one counts 0 there."""
    a = expected.groupBy(key).agg(F.count("*").alias("expected"))
    b = actual.groupBy(key).agg(F.count("*").alias("actual"))
    both = a.join(b, key, "full").na.fill(0, ["expected", "actual"])
    return both.filter("expected != actual")


def repair_candidates(files: DataFrame, failed: int = 100, dirty: int = 200) -> DataFrame:
    """The oldest failed and dirty files, each up to a bound of its own, with the reason."""
    fault = F.when(F.col("status") == "failed", "failed").when(F.col("dirty"), "dirty")
    first = lambda reason, most: files.withColumn("reason", fault).filter(F.col("reason") == reason).orderBy("indexed_at", "file_path").limit(most)
    return first("failed", failed).unionByName(first("dirty", dirty))


def sample_files(files: DataFrame, fraction: float, most: int, seed: int = 0) -> DataFrame:
    """A repeatable sample: the files of least hash, a fraction of all but one at least, and `most` at most."""
    kept = F.md5(F.concat(F.lit(f"{seed}:"), F.col("file_path").cast("string")).cast("binary"))
    n = min(most, max(1, int(files.count() * fraction)))
    return files.withColumn("__kept", kept).orderBy("__kept", "file_path").limit(n).drop("__kept")


def collection_counts(points: DataFrame) -> DataFrame:
    """Points of each named collection, 0 for those without."""
    names = points.sparkSession.createDataFrame([(c,) for c in COLLECTIONS], "collection string")
    return names.join(points.groupBy("collection").agg(F.count("*").alias("n")), "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"))
