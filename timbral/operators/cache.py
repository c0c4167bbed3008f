"""The decision cache: lookup with miss reasons, storage, eviction by budget, invalidation, statistics and version pins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbral.operators.library import insert_new

MOST_PAYLOAD = 64 * 1024


def lookup(asked: DataFrame, held: DataFrame, versions: list[int], payload_schema: str) -> DataFrame:
    """asked(cache_key, ...) with hit, miss_reason (absent, version_unsupported, cache_corrupt) and the payload as a struct."""
    joined = asked.join(held.select("cache_key", "schema_version", "payload"), "cache_key", "left")
    # a document that does not parse has every field null and its text in _bad
    parsed = F.from_json("payload", f"{payload_schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    reason = F.when(F.col("schema_version").isNull(), "absent").when(~F.col("schema_version").isin(*versions), "version_unsupported").when(F.col("parsed._bad").isNotNull() | F.col("parsed").isNull(), "cache_corrupt")
    found = joined.withColumn("parsed", parsed).withColumn("miss_reason", reason)
    return found.select(*asked.columns, F.col("miss_reason").isNull().alias("hit"), "miss_reason", F.when(F.col("miss_reason").isNull(), F.col("parsed")).alias("decision"))


def survivors(entries: DataFrame, most_entries: int, most_size: int, by: str | None = None) -> DataFrame:
    """Entries that stay when the oldest are deleted until both budgets hold.

    Counted from the newest back, an entry stays while it and all newer ones fit.
    by: a column whose values, say shards, have a budget each.  The hours of
    created_at cut the entries into parts: the sums of whole hours are a small
    table, and only an hour's own entries are summed one after the other.
    """
    keys = [by] if by else []
    hour = F.substring(F.col("created_at").cast("string"), 1, 13)
    cut = entries.withColumn("_hour", hour)
    sums = cut.groupBy(*keys, "_hour").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    newer = Window.partitionBy(*keys).orderBy(F.col("_hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_hour", *(F.coalesce(F.sum(c).over(newer), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_size")))
    own = Window.partitionBy(*keys, "_hour").orderBy(F.col("created_at").desc(), F.col("cache_key").desc()).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in [*keys, "_hour"]))
    named = before.select(*(F.col(c).alias(f"{c}_of") for c in [*keys, "_hour"]), "_n_before", "_size_before")
    summed = cut.withColumn("_n", F.count("*").over(own)).withColumn("_size", F.sum("size").over(own)).join(named, same)
    fits = (F.col("_n_before") + F.col("_n") <= most_entries) & (F.col("_size_before") + F.col("_size") <= most_size)
    return summed.where(fits).select(*entries.columns)


def store(entries: DataFrame, batch: DataFrame) -> DataFrame:
    """entries with the batch's new keys: only judged or abstained outcomes with a payload within the limit; a held key is not replaced."""
    good = batch.where(F.col("state").isin("judged", "abstained") & (F.octet_length("payload") <= MOST_PAYLOAD)).drop("state")
    return insert_new(entries, good, ["cache_key"])


def invalidate(entries: DataFrame, keys: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """entries without the given keys and candidates."""
    out = entries
    for gone, name in ((keys, "cache_key"), (candidates, "candidate_id")):
        if gone is not None:
            out = out.join(gone.select(name).distinct(), name, "left_anti")
    return out


def stats(entries: DataFrame) -> DataFrame:
    """entries, judgments, candidates, total_size (characters; 0 if empty), oldest and newest."""
    return entries.agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("kind") == "judgment").alias("judgments"),
        F.count_if(F.col("kind") == "candidate").alias("candidates"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def pin_versions(pins: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """pins(key..., model_version, observations) with the runs that were not cancelled and saw one version added up; the last version stands."""
    seen = runs.where(~F.col("cancelled") & (F.size("model_versions") == 1)).select(*key, F.col("model_versions")[0].alias("model_version"), F.lit(1).cast("long").alias("observations"), F.col("seq"))
    both = pins.select(*key, "model_version", "observations", F.lit(-1).cast("long").alias("seq")).unionByName(seen)
    return both.groupBy(*key).agg(F.max_by("model_version", "seq").alias("model_version"), F.sum("observations").alias("observations"))
