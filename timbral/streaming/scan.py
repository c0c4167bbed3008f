"""Reconciling a scan with the stored library: what was added, modified, moved, duplicated, or has gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """path_key, sample_id and code of every path on either side.

    stored: sample_id, path_key, sha.  scanned: path_key, sha (null: could not
    be read), supported.  Codes: unchanged, modified, moved (one vanished path
    of the same content for each new one, in path order), duplicate (content
    that the library has elsewhere, or an earlier new path), added, missing,
    inaccessible, unsupported.  One full outer join by path and one by content
    rank; nothing is collected.
    """
    old = stored.select("path_key", "sample_id", F.col("sha").alias("old_sha"))
    new = scanned.select("path_key", F.col("sha").alias("new_sha"), "supported", F.lit(True).alias("seen"))
    met = old.join(new, "path_key", "full_outer")
    seen, known = F.coalesce("seen", F.lit(False)), F.col("sample_id").isNotNull()
    kind = (
        F.when(seen & ~F.coalesce("supported", F.lit(True)), "unsupported")
        .when(seen & F.col("new_sha").isNull(), "inaccessible")
        .when(seen & known, F.when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("modified"))
        .when(seen, "new")
        .otherwise("missing")
    )
    placed = met.withColumn("kind", kind).withColumn("sha", F.when(F.col("kind") == "missing", F.col("old_sha")).otherwise(F.col("new_sha")))
    rank = F.row_number().over(Window.partitionBy("kind", "sha").orderBy("path_key"))
    ranked = placed.withColumn("nth", F.when(F.col("kind").isin("new", "missing"), rank))
    gone = ranked.where("kind = 'missing'").select("sha", "nth", F.col("sample_id").alias("from_id"))
    fresh = ranked.where("kind = 'new'").select(F.col("path_key"), "sha", "nth")
    here = placed.where("kind in ('unchanged', 'modified')").select("sha").distinct().withColumn("held", F.lit(True))
    moved = fresh.join(gone, ["sha", "nth"], "left").join(here, "sha", "left")
    code = F.when(F.col("from_id").isNotNull(), "moved").when(F.col("held") | (F.col("nth") > 1), "duplicate").otherwise("added")
    named = moved.select("path_key", F.col("from_id").alias("sample_id"), code.alias("code"))
    taken = moved.where("from_id is not null").select(F.col("from_id").alias("sample_id"))
    rest = placed.where("kind <> 'new'").select("path_key", "sample_id", F.col("kind").alias("code"))
    left = rest.where("code = 'missing'").join(taken, "sample_id", "left_anti").select("path_key", "sample_id", "code")
    return named.unionByName(rest.where("code <> 'missing'")).unionByName(left)


def applied(stored: DataFrame, scanned: DataFrame, found: DataFrame) -> DataFrame:
    """The stored library after the scan: paths, contents and file_status; an unreadable path's row is missing."""
    good = scanned.select("path_key", F.col("sha").alias("new_sha"))
    rows = found.where("code <> 'duplicate' and code <> 'unsupported'").join(good, "path_key", "left").join(stored.select("sample_id", F.col("sha").alias("old_sha")), "sample_id", "left")
    rows = rows.where("sample_id is not null or code = 'added'")
    status = F.when(F.col("code").isin("missing", "inaccessible"), "missing").otherwise("available")
    return rows.select("sample_id", "path_key", F.coalesce("new_sha", "old_sha").alias("sha"), status.alias("file_status"))
