"""The log of outcomes: auditioned, selected, rejected and removed, with its refusals, for a batch and for a stream.

A submission is judged by what stands before it: the created events of the log,
the palettes, and what was active in them at the time.  Two keys decide, so two
passes do: the events of a candidate in a palette are walked in order, a live
selection being all that is carried on, and a client's id answers again if an
event with it was created.  Which of a client's submissions that is depends on
the walk; the two passes are repeated until nothing changes, each time at least
one event further, and mostly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timbral.functions.durable import durable

# Kinds of events, the modes of a ranking, the longest id, and what makes two events the same one.
KINDS = ("auditioned", "selected", "rejected", "removed")
MODES = ("dsp-only", "jev-only", "hybrid")
MOST_ID = 128
IDENTITY = ("event_type", "project_id", "palette_id", "palette_revision", "run_id", "candidate_id", "ranking_version", "mode", "candidate_analysis_version", "removes_event_id")
IDS = ("project_id", "palette_id", "run_id", "candidate_id", "ranking_version", "candidate_analysis_version")
SUBMISSION = "event_id long, client_event_id string, event_type string, project_id string, palette_id string, palette_revision long, run_id string, candidate_id string, ranking_version string, mode string, candidate_analysis_version string, removes_event_id long"
#: A created event: a submission, a removal's with the identity of the selection that it ends.
LOG = SUBMISSION
RESULT = "event_id long, code string, created boolean, answer_event_id long"


def _id_fits(c: Column) -> Column:
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= MOST_ID) & ~c.rlike(r"[/\\\s\p{Cntrl}\p{Z}]"), F.lit(False))


def malformed(s: DataFrame) -> Column:
    """Whether a submission is none: bad ids, an unknown kind or mode, a removal with more than the selection it names."""
    removal = F.col("event_type") == "removed"
    bare = reduce(lambda a, b: a & b, (F.col(name).isNull() for name in IDENTITY if name not in ("event_type", "removes_event_id")))
    whole = reduce(lambda a, b: a & b, (_id_fits(F.col(name)) for name in IDS)) & F.coalesce(F.col("palette_revision") >= 0, F.lit(False)) & F.coalesce(F.col("mode").isin(*MODES), F.lit(False)) & F.col("removes_event_id").isNull()
    shape = F.when(removal, bare & F.coalesce(F.col("removes_event_id") >= 1, F.lit(False))).otherwise(whole)
    return ~(_id_fits(F.col("client_event_id")) & F.coalesce(F.col("event_type").isin(*KINDS), F.lit(False)) & shape)


#: Tables of fewer rows than this are broadcast.
SMALL = 100_000


def _unset(key: str) -> Column:
    """key, or where it is null a number that no event has and every row has for itself: rows without a key are spread over all tasks."""
    return F.coalesce(key, -F.col("event_id") - 1)


def _active(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows with active: whether the last change of (key_palette, key_candidate) up to the event was one that set it; null where a row is refused at once."""
    key = ["key_palette", "key_candidate"]
    marks = changes.select(F.col("palette_id").alias(key[0]), F.col("candidate_id").alias(key[1]), F.col("at").alias("event_id"), F.lit(0).alias("_turn"), F.col("active").alias("_set"))
    asked = rows.where("at_once IS NULL").select(*key, "event_id", F.lit(1).alias("_turn"), F.lit(None).cast("boolean").alias("_set"))
    order = Window.partitionBy(*key).orderBy("event_id", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = marks.unionByName(asked).withColumn("active", F.coalesce(F.last("_set", ignorenulls=True).over(order), F.lit(False))).where("_turn = 1")
    return rows.join(state.select("event_id", "active"), "event_id", "left")


def _walk(rows: DataFrame) -> DataFrame:
    """event_id, verdict, live of the rows (key_palette, key_candidate, event_id, event_type, active, removes_event_id, live).

    live is the selection in force before a key's first row, in the result the
    one before each row.  A task reads its rows as a stream, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, live = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key_palette", "key_candidate", "event_id", "event_type", "active", "removes_event_id", "live")]
            verdicts, before = [], []
            for palette, candidate, event, kind, active, names, held in zip(*columns, strict=True):
                if (palette, candidate) != key:
                    key, live = (palette, candidate), held
                before.append(live)
                if kind == "selected":
                    verdicts.append("selection_not_in_palette" if not active else "created" if live is None else "again")
                    live = event if active and live is None else live
                elif kind == "removed":
                    verdicts.append("not_live" if names != live else "removal_not_reflected" if active else "created")
                    live = None if verdicts[-1] == "created" else live
                else:
                    verdicts.append("outcome_conflict" if kind == "rejected" and live is not None else "created")
            yield pa.RecordBatch.from_pydict({"event_id": batch.column("event_id"), "verdict": pa.array(verdicts, pa.string()), "live": pa.array(before, pa.int64())})

    key = ["key_palette", "key_candidate"]
    return rows.repartition(*key).sortWithinPartitions(*key, "event_id").mapInArrow(run, "event_id long, verdict string, live long")


def judge(submissions: DataFrame, projects: DataFrame, palettes: DataFrame, changes: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """event_id, code, created, answer_event_id: the refusal of each submission or null, and the event that answers it.

    submissions: SUBMISSION, event_id being its place in the log; projects:
    project_id; palettes: palette_id, project_id, revision; changes: palette_id,
    candidate_id, at (an event_id), active: what a palette's slot gained or lost
    before the event of that number; log: LOG, the events created before.
    """
    spark = submissions.sparkSession
    before = spark.createDataFrame([], LOG) if log is None else log.select(*spark.createDataFrame([], LOG).columns)
    named = before.unionByName(submissions.select(*before.columns).where(~malformed(submissions))).where("event_type = 'selected'")
    targets = named.select(F.col("event_id").alias("_target"), F.col("palette_id").alias("_palette"), F.col("candidate_id").alias("_candidate"))
    removal = F.col("event_type") == "removed"
    rows = submissions.withColumn("_bad", malformed(submissions)).join(targets, (_unset("removes_event_id") == F.col("_target")) & (F.col("_target") < F.col("event_id")), "left")
    known = durable(projects.select(F.col("project_id").alias("_project")).distinct())
    # few projects have many events each, so that a shuffle by project would bring them to few tasks
    rows = rows.join(F.broadcast(known) if known.count() < SMALL else known, F.col("project_id") == F.col("_project"), "left")
    owners = palettes.select(F.col("palette_id").alias("_known"), F.col("project_id").alias("_owner"), F.col("revision").alias("_revision"))
    spread = F.coalesce("palette_id", F.concat(F.lit(" "), F.col("event_id").cast("string")))  # no id has a blank
    rows = rows.join(owners, spread == F.col("_known"), "left")
    at_once = (
        F.when(F.col("_bad"), "invalid_outcome")
        .when(removal, F.when(F.col("_target").isNull(), "unknown_selection"))
        .when(F.col("_project").isNull(), "unknown_project")
        .when(F.col("_known").isNull(), "unknown_palette")
        .when(F.col("_owner") != F.col("project_id"), "cross_project_reference")
        .when(F.col("palette_revision") > F.col("_revision"), "unknown_palette_revision")
    )
    keyed = rows.select("event_id", "client_event_id", *IDENTITY, at_once.alias("at_once"), F.coalesce("_palette", "palette_id").alias("key_palette"), F.coalesce("_candidate", "candidate_id").alias("key_candidate"))
    gone = before.where("event_type = 'removed'").select(F.col("removes_event_id").alias("event_id"))
    live = before.where("event_type = 'selected'").join(gone, "event_id", "left_anti").groupBy(F.col("palette_id").alias("key_palette"), F.col("candidate_id").alias("key_candidate")).agg(F.min("event_id").alias("live"))
    ready = durable(_active(keyed, changes).join(live, ["key_palette", "key_candidate"], "left"))
    same = ["client_event_id", *IDENTITY]
    old = before.select("event_id", *same)

    def stands(created: DataFrame) -> DataFrame:
        """event_id, prior, again: the created event that has a submission's client id already, and whether it is the same."""
        first = old.unionByName(created.select("event_id", *same)).select(F.col("event_id").alias("prior"), *(F.col(c).alias(f"_{c}") for c in same))
        pairs = ready.where("at_once IS NULL OR at_once <> 'invalid_outcome'").join(first, (F.col("client_event_id") == F.col("_client_event_id")) & (F.col("prior") < F.col("event_id")))
        equal = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY))
        twin = F.when(removal, (F.col("_event_type") == "removed") & F.col("removes_event_id").eqNullSafe(F.col("_removes_event_id"))).otherwise(equal)
        return pairs.groupBy("event_id").agg(F.min("prior").alias("prior"), F.min_by(twin, "prior").alias("again"))

    answered = durable(stands(ready.where("at_once IS NULL")))
    while True:
        free = ready.where("at_once IS NULL").join(answered, "event_id", "left_anti")
        walked = durable(_walk(free.select("key_palette", "key_candidate", "event_id", "event_type", "active", "removes_event_id", "live")))
        created = ready.join(walked.where("verdict = 'created'").select("event_id"), "event_id", "left_semi")
        now = durable(stands(created))
        if now.exceptAll(answered).isEmpty() and answered.exceptAll(now).isEmpty():
            break
        answered = now
    selections = old.where("event_type = 'selected'").select("event_id").unionByName(created.where("event_type = 'selected'").select("event_id")).select(F.col("event_id").alias("_selection"), F.lit(True).alias("_stood"))
    found = ready.join(walked.withColumnRenamed("live", "_live"), "event_id", "left").join(answered, "event_id", "left").join(selections, _unset("removes_event_id") == F.col("_selection"), "left")
    refused = F.when(F.col("verdict") == "not_live", F.when(F.col("_stood"), "outcome_conflict").otherwise("unknown_selection")).when(~F.col("verdict").isin("created", "again"), F.col("verdict"))
    # a client's id answers before anything but the form is looked at
    code = F.when(F.col("at_once") == "invalid_outcome", F.col("at_once")).when(F.col("prior").isNotNull(), F.when(~F.col("again"), "idempotency_conflict")).otherwise(F.coalesce("at_once", refused))
    made = F.col("prior").isNull() & F.coalesce(F.col("verdict") == "created", F.lit(False)) & F.col("at_once").isNull()
    answer = F.when(F.col("prior").isNotNull(), F.col("prior")).when(made, F.col("event_id")).when(F.col("verdict") == "again", F.col("_live"))
    return found.select("event_id", code.alias("code"), made.alias("created"), F.when(code.isNull() | (code == "idempotency_conflict"), answer).alias("answer_event_id"))


def created_events(submissions: DataFrame, results: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """LOG rows of the created submissions; a removal has the identity of the selection that it ends."""
    rows = submissions.join(results.where("created").select("event_id"), "event_id", "left_semi")
    all_ = submissions if log is None else log.select(*submissions.columns).unionByName(submissions)
    filled = [c for c in IDENTITY if c not in ("event_type", "removes_event_id")]
    ends = all_.where("event_type = 'selected'").select(F.col("event_id").alias("_selection"), *(F.col(c).alias(f"_{c}") for c in filled))
    joined = rows.join(ends, _unset("removes_event_id") == F.col("_selection"), "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in filled else F.col(c) for c in submissions.columns))


def live_selections(log: DataFrame) -> DataFrame:
    """Created selections that no removal names."""
    gone = log.where("removes_event_id is not null").select(F.col("removes_event_id").alias("event_id"))
    return log.where("event_type = 'selected'").join(gone, "event_id", "left_anti")


def history(log: DataFrame, after: int | None = None, size: int = 50, **equal) -> DataFrame:
    """The next size events after a cursor that have the given values; a list stands for any of its values."""
    rows = log if after is None else log.where(F.col("event_id") > after)
    for name, value in equal.items():
        rows = rows.where(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return rows.orderBy("event_id").limit(size)


def stream(submissions: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], folder: str, checkpoint: str) -> StreamingQuery:
    """judge() on a stream: folder/results gets every answer, folder/log the created events, a part for each batch.

    tables gives projects, palettes and changes as they stand when a batch runs.
    The log is the state.  A batch that runs again after a failure judges by the
    parts of earlier batches alone and writes its own part anew.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [c.split()[0] for c in SUBMISSION.split(", ")]
        rows = batch.select(*columns)
        log = earlier(spark, f"{folder}/log", LOG).where(F.col("batch") < number).drop("batch")
        answers = judge(rows, *tables(), log).persist()
        created_events(rows, answers, log).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        answers.write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
        answers.unpersist()

    return submissions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def earlier(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parts of a folder as one table with batch; no rows where none is written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def retained(log: DataFrame, cutoff: str, days: int = 14) -> DataFrame:
    """Created selections with retained: still selected days after the selection; null (censored) where the log ends before. Specified behaviour."""
    gone = log.where("removes_event_id is not null").select(F.col("removes_event_id").alias("event_id"), F.col("happened_at").alias("removed_at"))
    when = lambda c: F.to_timestamp(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    until = when(F.col("happened_at")) + F.expr(f"INTERVAL {days} DAYS")
    kept = F.when(when(F.col("removed_at")) < until, False).when(until <= when(F.lit(cutoff)), True)
    return log.where("event_type = 'selected'").join(gone, "event_id", "left").select("event_id", "project_id", "candidate_id", kept.alias("retained"))
