"""Stored records: versions, lookups, dispositions, precedence of judgments, and checks of a stored normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.functions.documents import struct_digest
from timbral.operators.retrieval import SPACE
from timbral.schemas import CANDIDATE_ROLES

# How an item was completed, how many versions are listed, and why a dimension may be inactive.
DISPOSITIONS = ("analyzed", "reused")
MOST_VERSIONS = 8
INACTIVE = ("insufficient_population", "zero_variance")


def disposition_counts(items: DataFrame, by: str) -> DataFrame:
    """by, and how many of its complete items were analyzed, reused, or say neither."""
    known = F.col("disposition").isin(*DISPOSITIONS)
    counts = [F.count_if(F.col("disposition") == d).alias(d) for d in DISPOSITIONS]
    return items.where("state = 'complete'").groupBy(by).agg(*counts, F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown"))


def prevailing_outcomes(outcomes: DataFrame) -> DataFrame:
    """The outcome that counts for each request: a live run's before a double's, then that of the later run and the later row.

    outcomes: request_id, source (interface or double), run (its place), seq, and
    other columns.  A null source is no live run.
    """
    order = F.struct(F.coalesce(F.col("source") == "interface", F.lit(False)).alias("live"), "run", "seq")
    rest = F.struct(*(c for c in outcomes.columns if c != "request_id"))
    return outcomes.groupBy("request_id").agg(F.max_by(rest, order).alias("o")).select("request_id", "o.*")


def listed_versions(analyses: DataFrame, most: int = MOST_VERSIONS) -> DataFrame:
    """sample_id, versions (the newest first, most of them) and truncated. analyses: sample_id, version, created_at."""
    newest = Window.partitionBy("sample_id").orderBy(F.col("created_at").desc(), "version")
    first = analyses.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= most + 1)  # one more tells that there are more
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", "version")))), lambda v: v["version"])
    return first.groupBy("sample_id").agg(listed.alias("versions"), (F.count("*") > most).alias("truncated"))


def looked_up(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """asked(key) with found, and the row of the least sample_id that has the key: by id, by path or by content."""
    wanted = asked.select(key).distinct()
    value = F.struct(*(c for c in rows.columns if c != key))
    held = rows.join(wanted, key, "left_semi").groupBy(key).agg(F.min_by(value, "sample_id").alias("r"))
    return wanted.join(held, key, "left").select(key, F.col("r").isNotNull().alias("found"), "r.*")


def normalization_problem(place: Column, dimension: Column, transform: Column, n: Column, mean: Column, std: Column, inactive: Column) -> Column:
    """The first rule that an entry of a stored normalization breaks, or null. place: its number among the entries, from 0."""
    names = F.array(*(F.lit(x) for x in SPACE))
    transforms = F.create_map(*(F.lit(x) for pair in SPACE.items() for x in pair))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(dimension.isin(*SPACE)), "unknown_dimension")
        .when(no(F.get(names, place) == dimension), "wrong_order")
        .when(no(transforms[dimension] == transform), "wrong_transform")
        .when(no(n >= 0), "wrong_count")
        .when(inactive.isNull() & ~(finite(mean) & finite(std)), "statistics_missing")
        .when(inactive.isNotNull() & (~inactive.isin(*INACTIVE) | mean.isNotNull() | std.isNotNull()), "wrong_inactive_entry")
    )


def normalization_id(entries: DataFrame, by: list[str]) -> DataFrame:
    """by and the content identity of each normalization: the digest of its entries in order."""
    entry = F.struct("place", "dimension", "transform", "n", "mean", "std", "inactive_reason")
    return entries.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("dimensions")).select(*by, struct_digest("dimensions").alias("normalization_id"))


def analysis_version(descriptors: DataFrame, fields: list[str]) -> DataFrame:
    """descriptors with version, the digest of the named fields, and problem where a version that they state is another one."""
    made = descriptors.withColumn("version", struct_digest(*fields))
    if "stated" not in descriptors.columns:
        return made
    return made.withColumn("problem", F.when(F.col("stated").isNotNull() & (F.col("stated") != F.col("version")), "descriptor_mismatch"))


def split_members(partitions: DataFrame) -> DataFrame:
    """sample_id and partition of split manifests, whose members may be under sample_ids, members or samples; ids in several partitions are a problem."""
    names = [c for c in ("sample_ids", "members", "samples") if c in partitions.columns]
    listed = partitions.select("partition", F.explode(F.coalesce(*names)).alias("sample_id"))
    return listed.groupBy("sample_id").agg(F.min("partition").alias("partition"), F.when(F.count_distinct("partition") > 1, "several_partitions").alias("problem"))


def import_problems(batch: DataFrame, samples: DataFrame) -> DataFrame:
    """batch(path_key, content) with decision: insert, re-path (a known content at a new path), same, or why it is refused.

    A path that holds another content, and a content that the batch brings at
    several paths, are refused.
    """
    by_path = samples.select("path_key", F.col("content").alias("_held"))
    by_content = samples.groupBy("content").agg(F.min("path_key").alias("_path"))
    several = F.count("*").over(Window.partitionBy("content")) > 1
    joined = batch.withColumn("_several", several).join(by_path, "path_key", "left").join(by_content, "content", "left")
    decision = (
        F.when(F.col("_held") == F.col("content"), "same")
        .when(F.col("_held").isNotNull(), "path_conflict")
        .when(F.col("_several"), "duplicate_content")
        .when(F.col("_path").isNotNull(), "re-path")
        .otherwise("insert")
    )
    return joined.select(*batch.columns, decision.alias("decision"))


def representatives(excluded: DataFrame, expected: DataFrame) -> DataFrame:
    """role, tag, category, place, path of the first record of each expected group of files that couldn't be read; null where there is none.

    excluded: place, role, reason, tag (of the file's format), path; expected:
    role, tag, category.  A reason that speaks of padding is one of bounds.
    """
    failed = excluded.where(F.col("role").isin("kick", "bass") & F.col("reason").startswith("read_validation_failed:"))
    category = F.when(F.col("reason").contains("padding"), "bounds").otherwise("encoding")
    first = failed.groupBy("role", "tag", category.alias("category")).agg(F.min_by(F.struct("place", "path"), "place").alias("r"))
    return expected.join(first, ["role", "tag", "category"], "left").select("role", "tag", "category", "r.place", "r.path")


def run_keys(runs: DataFrame, identity: list[str]) -> DataFrame:
    """runs with run_key, the digest of all that decides a run's result, and others: the keys of other runs of its data set and split, sorted."""
    keyed = runs.withColumn("run_key", struct_digest(*identity))
    same = ["dataset_version", "split_manifest_digest"]
    groups = keyed.groupBy(*same).agg(F.array_sort(F.collect_set("run_key")).alias("_keys")).withColumnsRenamed({c: f"_{c}" for c in same})
    joined = keyed.join(groups, F.col(same[0]).eqNullSafe(F.col(f"_{same[0]}")) & F.col(same[1]).eqNullSafe(F.col(f"_{same[1]}")))
    return joined.select(*runs.columns, "run_key", F.array_remove("_keys", F.col("run_key")).alias("others"))


def normalization_record_problem(stored: DataFrame, entries: DataFrame, version: str, roles: tuple[str, ...] = CANDIDATE_ROLES) -> DataFrame:
    """record, code and why: the first rule that a stored normalization breaks as a whole, or nulls.

    stored: record, representation_version, candidate_roles (an array); entries:
    record and the columns of normalization_problem(), a row for each dimension.
    The version and the roles come first, then a dimension named twice, an
    unknown one, and a list that is not the declared one in order, and at last
    the entries themselves, in their order.
    """
    names = F.array(*(F.lit(x) for x in SPACE))
    problem = normalization_problem(*(F.col(c) for c in ("place", "dimension", "transform", "n", "mean", "std", "inactive_reason")))
    own = F.array_sort(F.collect_list(F.struct("place", "dimension")))
    lists = entries.withColumn("problem", problem).groupBy("record").agg(F.transform(own, lambda e: e["dimension"]).alias("named"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("place"))).alias("entry"))
    joined = stored.join(lists, "record", "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    why = (
        F.when(~F.col("representation_version").eqNullSafe(F.lit(version)), "other_version")
        .when(~F.col("candidate_roles").eqNullSafe(F.array(*map(F.lit, roles))), "other_roles")
        .when(F.size(F.array_distinct("named")) < F.size("named"), "repeated_dimension")
        .when(F.exists("named", lambda d: ~F.array_contains(names, d)), "unknown_dimension")
        .when(F.col("named") != names, "not_the_declared_list")
        .otherwise(F.col("entry"))
    )
    code = F.when(F.col("why") == "unknown_dimension", "unknown_dimension").when(F.col("why").isNotNull(), "invalid_normalization")
    return joined.select("record", why.alias("why")).select("record", code.alias("code"), "why")
