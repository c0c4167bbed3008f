"""The work queue as tables: enqueue, claims, leases, requeue, counts, and the same steps on a stream of items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timbral.functions.durable import durable
from timbral.schemas import JOB_STATES

LEASE_SECONDS = 60
HEARTBEAT_SECONDS = 15
# Errors that a later attempt may not meet, and those that end an item at once, with the stage that each belongs to.
RETRYABLE = ("not_found", "access_denied", "io_error", "source_changed", "not_file")
TERMINAL = {
    "unsupported_format": "decode",
    "unsupported_channels": "decode",
    "empty_audio": "decode",
    "invalid_audio": "decode",
    "extractor_failure": "extract",
    "sample_missing": "queue",
    "content_changed": "queue",
    "analysis_version_changed": "queue",
}
STAGES = dict.fromkeys(RETRYABLE, "read") | TERMINAL
# States whose items a later prune may delete, and after how many days; states that an operator may retry.
PRUNABLE, PRUNE_DAYS = ("complete", "cancelled", "superseded"), 30
REVIVABLE = ("failed", "orphaned")
#: What an item that is pending again no longer has.
CLEARED = ("run_id", "error_code", "finished_at")
_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def is_retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*RETRYABLE), F.lit(False))


def stage(code: Column) -> Column:
    """The stage that an error belongs to; null for a code that is none of the queue's."""
    return F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))[code]


def finished_state(code: Column, attempts: Column, most: int) -> Column:
    """complete without an error; pending again while it is retryable and attempts are left; else failed."""
    return F.when(code.isNull(), "complete").when(is_retryable(code) & (attempts < most), "pending").otherwise("failed")


def _changed(items: DataFrame, when: Column, **values: Column) -> DataFrame:
    """items with new values where a condition holds; helper columns are dropped by the caller."""
    return items.withColumns({name: F.when(when, value).otherwise(F.col(name)) for name, value in values.items()})


def _cleared(items: DataFrame) -> dict[str, Column]:
    return {name: F.lit(None).cast(items.schema[name].dataType) for name in CLEARED if name in items.columns}


def state_counts(items: DataFrame, by: str) -> DataFrame:
    """by, one count for each state (zeros included), and remaining: pending and running."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in JOB_STATES]
    return items.groupBy(by).agg(*counts).withColumn("remaining", F.col("pending") + F.col("running"))


def scope_counts(items: DataFrame, run: int, version: str) -> DataFrame:
    """state and n over the items of a run, or pending ones of its version."""
    return items.where((F.col("run_id") == run) | ((F.col("state") == "pending") & (F.col("version") == version))).groupBy("state").agg(F.count("*").alias("n"))


def progress(counts: DataFrame) -> DataFrame:
    """counts with percent done, 0 to 100; null where there is nothing to do."""
    done = F.col("complete") + F.col("failed")
    all_ = done + F.col("remaining")
    percent = F.when(all_ > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.round(100 * done / all_).cast("int"))))
    return counts.withColumn("percent", percent)


def _bound(ends: Column, place: Column, n: int) -> Column:
    """How many of n sorted ends are less than place, found by halves."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(ends, at + step - 1) < place, F.lit(False)), at + step).otherwise(at))


def number_rows(rows: DataFrame, key: str, each: int = 500_000) -> DataFrame:
    """rows with _nth: 1, 2, ... in the order of their key, which is unique, without one task that sees them all.

    Quantiles of the key - of the first six bytes of a text - cut the rows into
    parts of about each rows; a part is numbered by itself, on top of the rows of
    the parts before it.  The rows are computed once, as is their cut.
    """
    rows = durable(rows)
    parts = max(1, -(-rows.count() // each))
    place = F.col(key)
    if rows.schema[key].dataType.simpleString() == "string":
        place = F.conv(F.rpad(F.hex(F.substring(place.cast("binary"), 1, 6)), 12, "0"), 16, 10)
    cut = rows.withColumn("_place", place.cast("double"))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    ends = cut.agg(F.percentile_approx("_place", shares, 100 * parts).alias("_ends"))
    cut = cut.crossJoin(F.broadcast(ends)).withColumn("_part", _bound(F.col("_ends"), F.col("_place"), len(shares))).drop("_ends", "_place")
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = counts.select("_part", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    within = cut.withColumn("_within", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    return within.join(F.broadcast(before), "_part").withColumn("_nth", F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def enqueue(items: DataFrame, contents: DataFrame, version: str) -> DataFrame:
    """items with a pending one for each content that has none at the version; a cancelled one is pending again, as new. Running it twice changes nothing."""
    mine = contents.select("content").distinct()
    asked = items.join(mine.withColumn("_asked", F.lit(True)), "content", "left")
    again = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("version") == version) & (F.col("state") == "cancelled")
    kept = _changed(asked, again, attempts=F.lit(0), **_cleared(items)).withColumn("state", F.when(again, "pending").otherwise(F.col("state"))).select(*items.columns)
    new = mine.join(items.where(F.col("version") == version).select("content"), "content", "left_anti")
    top = items.agg(F.coalesce(F.max("item_id"), F.lit(0)).alias("_top"))
    numbered = number_rows(new, "content").crossJoin(F.broadcast(top)).withColumn("item_id", F.col("_top") + F.col("_nth"))
    row = {"version": F.lit(version), "state": F.lit("pending"), "attempts": F.lit(0)} | _cleared(items)
    return kept.unionByName(numbered.withColumns(row).select(*items.columns))


def claim(items: DataFrame, run: int, version: str, now: str, n: int, horizon: int | None = None) -> DataFrame:
    """items with the first n pending ones up to a horizon running and their attempt counted.

    Pending items of other versions are superseded before, whatever their place, and credited to the run.
    """
    pending = F.col("state") == "pending"
    old = pending & (F.col("version") != version)
    fit = items.where(pending & (F.col("version") == version))
    first = (fit if horizon is None else fit.where(F.col("item_id") <= horizon)).orderBy("item_id").limit(n).select("item_id", F.lit(True).alias("_mine"))
    joined = items.join(F.broadcast(first), "item_id", "left")  # n rows
    mine = F.coalesce("_mine", F.lit(False))
    me = F.lit(run).cast(items.schema["run_id"].dataType)
    gone = _changed(joined, old, run_id=me, finished_at=F.lit(now), error_code=F.lit("analysis_version_changed"))
    taken = _changed(gone, mine, run_id=me, attempts=F.col("attempts") + 1)
    return taken.withColumn("state", F.when(old, "superseded").when(mine, "running").otherwise(F.col("state"))).select(*items.columns)


def finish(items: DataFrame, results: DataFrame, now: str, most: int = 3) -> DataFrame:
    """items with the results (item_id, code) of running ones applied; one that is tried again loses its claim and its error."""
    joined = items.join(results.select("item_id", F.col("code").alias("_code"), F.lit(True).alias("_done")), "item_id", "left")
    ended = F.coalesce("_done", F.lit(False)) & (F.col("state") == "running")
    state = finished_state(F.col("_code"), F.col("attempts"), most)
    told = _changed(joined.withColumn("_new", F.when(ended, state)), ended, finished_at=F.lit(now), error_code=F.col("_code"))
    back = _changed(told, F.col("_new") == "pending", **_cleared(items))
    return back.withColumn("state", F.coalesce("_new", "state")).select(*items.columns)


def _age(now: str) -> Column:
    return F.unix_timestamp(F.lit(now), _TEXT) - F.unix_timestamp("heartbeat_at", _TEXT)


def live_runs(runs: DataFrame, now: str) -> DataFrame:
    """Running runs whose heartbeat is younger than the lease, oldest first."""
    return runs.where((F.col("state") == "running") & (_age(now) < LEASE_SECONDS)).orderBy("started_at", "run_id")


def interrupted_runs(runs: DataFrame, now: str) -> DataFrame:
    """runs with running ones whose lease has ended interrupted and finished now."""
    dead = (F.col("state") == "running") & (_age(now) >= LEASE_SECONDS)
    return _changed(runs.withColumn("_dead", dead), F.col("_dead"), finished_at=F.lit(now), state=F.lit("interrupted")).drop("_dead")


def reconcile(items: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """items with running ones of runs that aren't live pending again; their attempts stay, claim and error go."""
    live = interrupted_runs(runs, now).where("state = 'running'").select("run_id", F.lit(True).alias("_live"))
    joined = items.join(live, "run_id", "left")
    lost = (F.col("state") == "running") & F.col("_live").isNull()
    return _changed(joined.withColumn("_lost", lost), F.col("_lost"), state=F.lit("pending"), **_cleared(items)).select(*items.columns)


def retry_failed(items: DataFrame, version: str) -> DataFrame:
    """items with the version's failed and orphaned ones pending, as new."""
    again = (F.col("version") == version) & F.col("state").isin(*REVIVABLE)
    return _changed(items.withColumn("_again", again), F.col("_again"), state=F.lit("pending"), attempts=F.lit(0), **_cleared(items)).drop("_again")


def cancel_pending(items: DataFrame, run: int, version: str, now: str) -> DataFrame:
    """items with the version's pending ones cancelled by a run."""
    gone = (F.col("version") == version) & (F.col("state") == "pending")
    me = F.lit(run).cast(items.schema["run_id"].dataType)
    return _changed(items.withColumn("_gone", gone), F.col("_gone"), state=F.lit("cancelled"), run_id=me, finished_at=F.lit(now)).drop("_gone")


def _prunable(now: str) -> Column:
    cutoff = F.date_format(F.to_timestamp(F.lit(now), _TEXT) - F.expr(f"INTERVAL {PRUNE_DAYS} DAYS"), _TEXT)
    return F.col("state").isin(*PRUNABLE) & F.coalesce(F.col("finished_at") < cutoff, F.lit(False))


def _busy(runs: DataFrame) -> DataFrame:
    return F.broadcast(runs.agg(F.coalesce(F.bool_or(F.col("state") == "running"), F.lit(False)).alias("_busy")))


def prune(items: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """items without complete, cancelled and superseded ones that finished before the retention; nothing goes while any run is running."""
    return items.crossJoin(_busy(runs)).where(F.col("_busy") | ~_prunable(now)).select(*items.columns)


def prune_counts(items: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """One row: how many items prune() deletes of each state, in all, and whether it waits for a run to end."""
    counts = items.where(_prunable(now)).agg(*(F.count_if(F.col("state") == s).alias(s) for s in PRUNABLE)).crossJoin(_busy(runs))
    each = {s: F.when(F.col("_busy"), 0).otherwise(F.col(s)) for s in PRUNABLE}
    return counts.withColumns(each).withColumns({"total": sum((F.col(s) for s in PRUNABLE), F.lit(0)), "deferred": F.col("_busy")}).drop("_busy")


def recent_runs(runs: DataFrame, most: int = 32) -> DataFrame:
    """The latest runs of a bounded registry."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(most)


def retried_role(failures: DataFrame) -> DataFrame:
    """run_id and the one role of all its failures, else null."""
    return failures.groupBy("run_id").agg(F.when(F.count_distinct("role") == 1, F.max("role")).alias("role"))


LEASE_STATE = "owner string, beat string, ended string"
LEASE_RESULT = "run_id long, state string, heartbeat_at string"


def lease_stream(beats: DataFrame, seconds: float = LEASE_SECONDS) -> DataFrame:
    """run_id, state, heartbeat_at: a row when a run starts, ends, or is interrupted because its lease's timer fires.

    beats: a stream of run_id, kind (start, beat, end), owner, at.  Each start
    and each beat of the run's owner winds the timer up again.  A beat of
    another owner, or of a run that has ended, changes nothing.  A run's state
    is three texts, whatever its number of beats.
    """

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, beat, ended = state.get if state.exists else (None, None, None)
        out = []
        if state.hasTimedOut:
            ended = "interrupted"
            out.append((key[0], ended, beat))
        else:
            rows = pd.concat(list(frames)).sort_values("at", kind="stable")
            for kind, who, at in zip(rows["kind"], rows["owner"], rows["at"], strict=True):
                if kind == "start" and owner is None:
                    owner, beat = who, at
                    out.append((key[0], "running", at))
                elif who != owner or ended is not None:
                    continue
                elif kind == "beat":
                    beat = at
                elif kind == "end":
                    beat, ended = at, "complete"
                    out.append((key[0], ended, at))
        state.update((owner, beat, ended))
        if ended is None and owner is not None:
            state.setTimeoutDuration(int(1000 * seconds))
        yield pd.DataFrame(out, columns=["run_id", "state", "heartbeat_at"])

    return beats.groupBy("run_id").applyInPandasWithState(apply, LEASE_RESULT, LEASE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def drain(source: DataFrame, step, checkpoint: str) -> StreamingQuery:
    """Run step(batch, id) on everything that a streaming source has, then stop; a restart goes on after the last whole batch."""
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_in_queue(items: DataFrame) -> DataFrame:
    """Each run's first pending item."""
    order = Window.partitionBy("run_id").orderBy("item_id")
    return items.where("state = 'pending'").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
