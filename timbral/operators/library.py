"""Browsing a stored library: joins, analysis states, pages, counts, lookups and table changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.schemas import MEASURES, ROLES

# -- joins


def pivot_features(features: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each sample and version: 19 measures, two confidences and the key. One aggregation, then one join on the same keys."""
    on = ["sample_id", "analysis_version"]
    pick = lambda n, c: F.max(F.when(F.col("measurement") == n, F.col(c)))
    wide = features.groupBy(*on).agg(*(pick(n, "value").alias(n) for n in MEASURES), *(pick(n, "confidence").alias(f"{n}_confidence") for n in ("fundamental", "tempo")), F.count_distinct("measurement").alias("n_measures"))
    named = keys.select(*on, F.col("tonic").alias("key_tonic"), F.col("mode").alias("key_mode"), F.col("confidence").alias("key_confidence"))
    return wide.join(named, on, "left")


def complete_features(pivoted: DataFrame) -> DataFrame:
    """Only samples with every measure; an incomplete set is refused."""
    return pivoted.where(F.col("n_measures") == len(MEASURES))


def analysis_state(current: Column, other: Column, pending: Column, failed: Column) -> Column:
    """current > stale > pending > failed > absent, over existence flags of left joins."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(current), "current").when(yes(other), "stale").when(yes(pending), "pending").when(yes(failed), "failed").otherwise("absent")


def retrieval_state(current: Column, other: Column) -> Column:
    """current, stale or absent."""
    return F.when(F.coalesce(current, F.lit(False)), "current").when(F.coalesce(other, F.lit(False)), "stale").otherwise("absent")


def with_states(samples: DataFrame, analysed: DataFrame, items: DataFrame, version: str) -> DataFrame:
    """samples(content) with state and retrieval_state. analysed: content, version; items: content, version, state. Flags are aggregated before the join, so no row fans out."""
    have = analysed.groupBy("content").agg(F.bool_or(F.col("version") == version).alias("is_current"), F.bool_or(F.col("version") != version).alias("is_other"))
    work = items.where(F.col("version") == version).groupBy("content").agg(F.bool_or(F.col("state").isin("pending", "running")).alias("is_pending"), F.bool_or(F.col("state") == "failed").alias("is_failed"))
    joined = samples.join(have, "content", "left").join(work, "content", "left")
    state = analysis_state(F.col("is_current"), F.col("is_other"), F.col("is_pending"), F.col("is_failed"))
    return joined.select(*samples.columns, state.alias("state"), retrieval_state(F.col("is_current"), F.col("is_other")).alias("retrieval_state"))


def pending_analysis(samples: DataFrame, analysed: DataFrame, items: DataFrame, version: str) -> DataFrame:
    """Contents that are neither missing, analysed at the version, nor in its queue; the first path of each."""
    here = samples.where("file_status <> 'missing'")
    left = here.join(analysed.where(F.col("version") == version).select("content").distinct(), "content", "left_anti")
    left = left.join(items.where(F.col("version") == version).select("content").distinct(), "content", "left_anti")
    return left.groupBy("content").agg(F.min_by("sample_id", F.struct("path_key", "sample_id")).alias("sample_id"))


def referenced(samples: DataFrame, *tables: DataFrame) -> DataFrame:
    """samples whose sample_id any of the tables has."""
    ids = tables[0].select("sample_id")
    for t in tables[1:]:
        ids = ids.unionByName(t.select("sample_id"))
    return samples.join(ids.distinct(), "sample_id", "left_semi")


def orphaned_items(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Running items whose run is not running."""
    return items.where("state = 'running'").join(runs.where("state = 'running'").select("run_id"), "run_id", "left_anti")


def last_error(items: DataFrame) -> DataFrame:
    """content and the error code of its latest item that has one."""
    return items.where("error_code is not null").groupBy("content").agg(F.max_by("error_code", "item_id").alias("error_code"))


def latest_version(versions: DataFrame) -> DataFrame:
    """sample_id and its latest version: created last, then least version."""
    order = Window.partitionBy("sample_id").orderBy(F.col("created_at").desc(), "version")
    return versions.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


# -- filters and pages


def in_roles(samples: DataFrame, roles: list[str] | None, page: bool) -> DataFrame:
    """Rows of some roles. An empty list is no filter for a page, and no rows for retrieval."""
    if not roles:
        return samples if page or roles is None else samples.where("false")
    return samples.where(F.col("role").isin(*roles))


def search(samples: DataFrame, text: str) -> DataFrame:
    """Rows whose filename holds text, without regard to case."""
    return samples.where(F.instr(F.lower("filename"), text.lower()) > 0) if text else samples


def under(samples: DataFrame, root: str) -> DataFrame:
    """Rows below a path."""
    return samples.where(F.col("path_key").startswith(root.rstrip("/") + "/"))


def page(samples: DataFrame, key: str, after=None, size: int = 50) -> DataFrame:
    """The next size rows by key after a cursor, each with has_more. One more row is read, and no offset."""
    if not 1 <= size <= 200:
        raise ValueError("a page has 1 to 200 rows")
    rest = samples if after is None else samples.where(F.col(key) > F.lit(after))
    more = rest.orderBy(key).limit(size + 1)
    placed = more.withColumn("_n", F.row_number().over(Window.orderBy(key)))
    return placed.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")


def normal_tags(tags: Column) -> Column:
    """Lower case, trimmed, 1 to 64 characters, first of equals."""
    low = F.transform(tags, lambda t: F.lower(F.trim(t)))
    return F.array_distinct(F.filter(low, lambda t: F.length(t).between(1, 64)))


def without_paths(samples: DataFrame) -> DataFrame:
    """A projection that shows no path."""
    return samples.drop("original_path", "path_key", "local_path", "relative_path")


# -- counts


def role_counts(samples: DataFrame) -> DataFrame:
    """role and n for every role, zeros included."""
    roles = samples.sparkSession.createDataFrame([(r,) for r in ROLES], "role string")
    found = samples.groupBy("role").agg(F.count("*").alias("n"))
    return roles.join(found, "role", "left").select("role", F.coalesce("n", F.lit(0)).alias("n"))


def library_totals(samples: DataFrame) -> DataFrame:
    """total and folders: distinct parent folders of path_key."""
    folder = F.regexp_extract("path_key", r"^(.*)/[^/]*$", 1)
    return samples.agg(F.count("*").alias("total"), F.count_distinct(folder).alias("folders"))


def collapse(rows: DataFrame) -> DataFrame:
    """One row for each content: the sample of least path_key, and how many rows, stale and absent ones it stands for."""
    return rows.groupBy("content").agg(
        F.min_by("sample_id", "path_key").alias("sample_id"), F.count("*").alias("n_rows"), F.count_if(F.col("state") == "stale").alias("n_stale"), F.count_if(F.col("state") == "absent").alias("n_absent")
    )


# -- changes: a table's next state from its rows and a batch


def insert_new(table: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """table and the batch's rows whose key it lacks (the first of equals by the batch's own order column seq, if it has one)."""
    if "seq" in batch.columns:
        batch = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("_n = 1").drop("_n", "seq")
    else:
        batch = batch.dropDuplicates(key)
    return table.unionByName(batch.join(table.select(*key), key, "left_anti"))


def upsert(table: DataFrame, batch: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """table with the batch's last row of each key in place of its own."""
    newest = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n", order)
    return table.join(newest.select(*key), key, "left_anti").unionByName(newest)


def delete_cascade(parent: DataFrame, children: list[DataFrame], gone: DataFrame, key: str) -> list[DataFrame]:
    """parent and its children without the rows whose key is in gone."""
    ids = gone.select(key).distinct()
    return [t.join(ids, key, "left_anti") for t in (parent, *children)]


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def sample_detail(samples: DataFrame, analysed: DataFrame, items: DataFrame, version: str) -> DataFrame:
    """samples with state, the version's analysis and queue item, and all stored versions.

    analysis_version is told of a current analysis only; analyzed_at is the end of
    the version's complete item, so an analysis stored without one has none.
    Contents are met once each, whatever their number of paths.
    """
    fields = ["item_id", "state", "attempts", "error_code", "finished_at"]
    mine = items.where(F.col("version") == version).groupBy("content").agg(F.max_by(F.struct(*fields), "item_id").alias("_item"))
    stored = analysed.groupBy("content").agg(F.array_sort(F.collect_set("version")).alias("stored_versions"))
    named = with_states(samples, analysed, items, version).drop("retrieval_state").join(mine, "content", "left").join(stored, "content", "left")
    told = {
        "analysis_version": F.when(F.col("state") == "current", F.lit(version)),
        "analyzed_at": F.when(F.col("_item.state") == "complete", F.col("_item.finished_at")),
        "attempts": F.col("_item.attempts"),
        "error_code": F.col("_item.error_code"),
        "stored_versions": F.coalesce("stored_versions", F.array().cast("array<string>")),
    }
    return named.withColumns(told).drop("_item")
