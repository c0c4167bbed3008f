"""Hand-written cases of the queue: error codes, retries, leases, retention, and a lease whose timer fires."""

import time

import pytest

from timbral.streaming import jobs

ITEMS = "item_id long, run_id long, content long, version string, state string, attempts int, error_code string, finished_at string"
NOW = "2024-03-01T12:00:00Z"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEMS)


def by_id(df):
    return {r.item_id: r for r in df.collect()}


@pytest.mark.parametrize(
    ("code", "attempts", "state", "stage"),
    [
        (None, 1, "complete", None),
        ("not_found", 1, "pending", "read"),
        ("access_denied", 2, "pending", "read"),
        ("io_error", 3, "failed", "read"),
        ("source_changed", 1, "pending", "read"),
        ("not_file", 2, "pending", "read"),
        ("unsupported_format", 1, "failed", "decode"),
        ("unsupported_channels", 1, "failed", "decode"),
        ("empty_audio", 1, "failed", "decode"),
        ("invalid_audio", 1, "failed", "decode"),
        ("extractor_failure", 1, "failed", "extract"),
        ("sample_missing", 1, "failed", "queue"),
        ("content_changed", 1, "failed", "queue"),
        ("analysis_version_changed", 1, "failed", "queue"),
    ],
)
def test_each_error_code(spark, code, attempts, state, stage):
    done = jobs.finish(items(spark, (1, 7, 5, "v1", "running", attempts, None, None), (2, 7, 6, "v1", "complete", 1, None, "2024-01-01T00:00:00Z")), spark.createDataFrame([(1, code), (2, "io_error")], "item_id long, code string"), NOW)
    found = by_id(done.withColumn("stage", jobs.stage(done["error_code"])))
    one = found[1]
    assert (one.state, one.attempts) == (state, attempts)
    assert (one.run_id, one.error_code, one.finished_at, one.stage) == ((None, None, None, None) if state == "pending" else (7, code, NOW, stage))
    assert found[2].state == "complete" and found[2].error_code is None


def test_claim_supersedes_other_versions(spark):
    rows = [(1, None, 1, "v0", "pending", 0, None, None), (2, None, 2, "v1", "pending", 1, None, None), (3, None, 3, "v1", "pending", 0, None, None), (9, None, 4, "v0", "pending", 0, None, None), (4, 3, 5, "v0", "failed", 2, "io_error", "x")]
    found = by_id(jobs.claim(items(spark, *rows), 50, "v1", NOW, 1, horizon=8))
    assert [(k, found[k].state, found[k].run_id, found[k].attempts) for k in sorted(found)] == [(1, "superseded", 50, 0), (2, "running", 50, 2), (3, "pending", None, 0), (4, "failed", 3, 2), (9, "superseded", 50, 0)]
    assert found[1].error_code == found[9].error_code == "analysis_version_changed" and found[9].finished_at == NOW


def test_leases_end_at_sixty_seconds(spark):
    runs = spark.createDataFrame([(1, "running", "2024-03-01T11:59:01Z"), (2, "running", "2024-03-01T11:59:00Z"), (3, "complete", "2024-03-01T11:00:00Z")], "run_id long, state string, heartbeat_at string").selectExpr("*", "heartbeat_at AS started_at", "CAST(NULL AS STRING) AS finished_at")
    assert [r.run_id for r in jobs.live_runs(runs, NOW).collect()] == [1]
    assert {r.run_id: (r.state, r.finished_at) for r in jobs.interrupted_runs(runs, NOW).collect()} == {1: ("running", None), 2: ("interrupted", NOW), 3: ("complete", None)}
    held = [(k, k, k, "v1", "running", 2, "io_error", None) for k in (1, 2, 3, 4)] + [(5, 2, 5, "v1", "complete", 1, None, NOW)]
    found = by_id(jobs.reconcile(items(spark, *held), runs, NOW))
    assert {k: (r.state, r.run_id, r.attempts, r.error_code) for k, r in found.items()} == {1: ("running", 1, 2, "io_error"), 2: ("pending", None, 2, None), 3: ("pending", None, 2, None), 4: ("pending", None, 2, None), 5: ("complete", 2, 1, None)}


def test_retention(spark):
    old, young = "2024-01-31T11:59:59Z", "2024-01-31T12:00:00Z"
    rows = [(k, 1, k, "v1", state, 1, None, at) for k, (state, at) in enumerate([(s, t) for s in ("complete", "cancelled", "superseded", "failed", "orphaned", "pending") for t in (old, young, None)])]
    ended, busy = spark.createDataFrame([(1, "complete")], "run_id long, state string"), spark.createDataFrame([(1, "complete"), (2, "running")], "run_id long, state string")
    assert {k for k in range(18)} - by_id(jobs.prune(items(spark, *rows), ended, NOW)).keys() == {0, 3, 6}
    assert len(by_id(jobs.prune(items(spark, *rows), busy, NOW))) == 18
    assert [tuple(r) for r in jobs.prune_counts(items(spark, *rows), ended, NOW).collect()] == [(1, 1, 1, 3, False)]
    assert [tuple(r) for r in jobs.prune_counts(items(spark, *rows), busy, NOW).collect()] == [(0, 0, 0, 0, True)]
    assert [tuple(r) for r in jobs.prune_counts(items(spark), ended.limit(0), NOW).collect()] == [(0, 0, 0, 0, False)]


def test_retry_cancel_and_revive(spark):
    rows = [(1, 7, 1, "v1", "failed", 3, "io_error", NOW), (2, 7, 2, "v1", "orphaned", 1, "sample_missing", NOW), (3, 7, 3, "v2", "failed", 1, "io_error", NOW), (4, 7, 4, "v1", "cancelled", 0, None, NOW), (5, 7, 5, "v1", "complete", 1, None, NOW)]
    found = by_id(jobs.retry_failed(items(spark, *rows), "v1"))
    assert {k: (r.state, r.attempts, r.run_id, r.error_code) for k, r in found.items() if k < 3} == {1: ("pending", 0, None, None), 2: ("pending", 0, None, None)}
    assert [found[k].state for k in (3, 4, 5)] == ["failed", "cancelled", "complete"]
    contents = spark.createDataFrame([(k,) for k in (1, 4, 5, 6)], "content long")
    revived = by_id(jobs.enqueue(items(spark, *rows), contents, "v1"))
    assert (revived[4].state, revived[4].run_id) == ("pending", None) and revived[1].state == "failed" and (revived[6].content, revived[6].state, revived[6].run_id) == (6, "pending", None)
    gone = by_id(jobs.cancel_pending(jobs.enqueue(items(spark, *rows), contents, "v1"), 9, "v1", NOW))
    assert {k for k, r in gone.items() if (r.state, r.run_id) == ("cancelled", 9)} == {4, 6}


def test_a_lease_timer_fires(spark, tmp_path):
    """A run that beats on lives; one that falls silent is interrupted by its timer; late and foreign beats change nothing."""
    source, schema = tmp_path / "beats", "run_id long, kind string, owner string, at string"
    source.mkdir()

    def send(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"w{n}"))
        part = next((tmp_path / f"w{n}").glob("part-*"))
        part.rename(source / f"{n}.json")

    send(0, [(1, "start", "a", "t00"), (2, "start", "b", "t01"), (3, "start", "c", "t02"), (3, "end", "x", "t03"), (3, "end", "c", "t04"), (4, "beat", "d", "t05")])
    query = jobs.lease_stream(spark.readStream.schema(schema).json(str(source)), seconds=6).writeStream.format("memory").queryName("leases").outputMode("append").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        found = lambda: {tuple(r) for r in spark.table("leases").collect()}
        first = {(1, "running", "t00"), (2, "running", "t01"), (3, "running", "t02"), (3, "complete", "t04")}
        until = time.time() + 90
        n = 1
        while time.time() < until and (2, "interrupted", "t01") not in found():
            send(n, [(1, "beat", "a", f"t{10 + n}"), (1, "end", "z", "t99")])
            n += 1
            time.sleep(2)
        assert found() == first | {(2, "interrupted", "t01")}
        send(n, [(2, "beat", "b", "t90"), (1, "end", "a", "t91")])
        while time.time() < until and (1, "complete", "t91") not in found():
            time.sleep(1)
        assert found() == first | {(2, "interrupted", "t01"), (1, "complete", "t91")}
    finally:
        query.stop()
