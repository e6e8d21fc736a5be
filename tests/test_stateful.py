import time

from tessera.operators import state
from tessera.streaming import jobs, stateful

KIND = "job string, at int, kind string"


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def until(found, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if (got := found()) is not None:
            return got
        time.sleep(0.5)
    raise AssertionError("not in time")


def test_claims_run_out_and_a_restart_goes_on(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    told: list = []
    land(spark, src, [("lost", 1, "enqueue"), ("lost", 2, "claim"), ("good", 1, "enqueue"), ("good", 2, "claim"), ("good", 3, "done"), ("idle", 1, "enqueue")], KIND)
    stream = lambda lease: stateful.leased_jobs(spark.readStream.schema(KIND).parquet(src), "job", ["at"], "kind", lease)
    sink = lambda df, _: told.extend(map(tuple, df.collect()))
    query = jobs.run_forever(stream(4), sink, log, "1 second")
    try:
        assert set(until(lambda: told[:3] if len(told) >= 3 else None)) == {("lost", "processing", 1, False), ("good", "done", 1, False), ("idle", "pending", 0, False)}
        until(lambda: True if ("lost", "pending", 1, True) in told else None)
    finally:
        query.stop()
    # another query over the same checkpoint: the released job is claimed again, and ends in time
    land(spark, src, [("lost", 3, "claim"), ("idle", 2, "claim"), ("lost", 4, "done")], KIND)
    told.clear()
    query = jobs.run_forever(stream(4), sink, log, "1 second")
    try:
        until(lambda: True if ("idle", "pending", 1, True) in told else None)
    finally:
        query.stop()
    assert ("lost", "done", 2, False) in told and not any(r[0] == "lost" and r[3] for r in told)
    last = {r[0]: r[1:3] for r in told} | {"good": ("done", 1)}
    events = spark.read.parquet(src)
    folded = {r["job"]: (r["status"], r["attempts"]) for r in state.fold_jobs(events, "job", ["at"], "kind").collect()}
    # the batch fold knows no time: it differs in the job whose claim ran out, and in what a release made possible
    assert folded["good"] == last["good"] and folded["idle"] == ("processing", 1) and last["idle"] == ("pending", 1)


def test_name_deltas_over_batches(spark, tmp_path):
    src, log, schema = str(tmp_path / "in"), str(tmp_path / "log"), "file_path string, names array<string>, at int"
    told: list = []
    for rows, want in (
        ([("a.ts", ["f", "g"], 1), ("b.ts", ["h"], 1)], {("a.ts", "f", "came"), ("a.ts", "g", "came"), ("b.ts", "h", "came")}),
        ([("a.ts", ["x"], 2), ("a.ts", ["g", "k"], 3), ("c.ts", None, 2)], {("a.ts", "f", "went"), ("a.ts", "k", "came")}),
        ([("a.ts", None, 4), ("b.ts", ["h"], 4)], {("a.ts", "g", "went"), ("a.ts", "k", "went")}),
    ):
        land(spark, src, rows, schema)
        told.clear()
        jobs.run_available(stateful.name_deltas(spark.readStream.schema(schema).parquet(src), ["at"]), lambda df, _: told.extend(map(tuple, df.collect())), log, "append")
        assert set(told) == want and len(told) == len(want)
