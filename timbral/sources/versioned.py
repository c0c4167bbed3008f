"""A table in a folder whose versions are committed one at a time: a writer that read an older version is refused.

A writer stages its files beside the others and then claims the next version by
creating a marker file that must not exist yet, which a file system does for one
writer only.  Files of a refused writer are never part of any version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has committed since this one read the table."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def latest(spark: SparkSession, folder: str) -> int:
    """The last committed version; 0 before the first."""
    system, where = _files(spark, f"{folder}/versions")
    if not system.exists(where):
        return 0
    return max((int(f.getPath().getName()) for f in system.listStatus(where)), default=0)


def read(spark: SparkSession, folder: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version, of the last one by default."""
    version = latest(spark, folder) if version is None else version
    if not version:
        return spark.createDataFrame([], schema)
    data = spark.read.text(f"{folder}/versions/{version:08d}").first()["value"]
    return spark.read.schema(schema).parquet(f"{folder}/{data}")


def commit(df: DataFrame, folder: str, seen: int) -> int:
    """Write df as version seen + 1; Conflict if that exists already."""
    spark = df.sparkSession
    data = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{data}")
    system, marker = _files(spark, f"{folder}/versions/{seen + 1:08d}")
    try:
        out = system.create(marker, False)
    except Exception as error:
        if latest(spark, folder) <= seen:
            raise
        staged = _files(spark, f"{folder}/{data}")
        staged[0].delete(staged[1], True)
        raise Conflict(f"version {seen + 1} of {folder} has another writer") from error
    out.write(bytearray(data.encode()))
    out.close()
    return seen + 1


def change(spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """Commit step(rows), judged again on the newer rows whenever another writer was first."""
    for left in range(tries - 1, -1, -1):
        seen = latest(spark, folder)
        try:
            return commit(step(read(spark, folder, schema, seen)), folder, seen)
        except Conflict:
            if not left:
                raise
    raise AssertionError


def analysis_problems(batch: DataFrame, samples: DataFrame, versions: DataFrame) -> DataFrame:
    """batch with code: why an analysis may not be stored for its sample, or null.

    batch: sample_id, content, version, descriptor_digest (null: the version must
    be known already); samples: sample_id, content as they are now; versions:
    version, digest.  An analysis is of a content: the sample must still have it.
    """
    now = samples.select(F.col("sample_id").alias("_id"), F.col("content").alias("_content"))
    known = versions.select(F.col("version").alias("_version"), F.col("digest").alias("_digest"))
    joined = batch.join(now, F.col("sample_id") == F.col("_id"), "left").join(known, F.col("version") == F.col("_version"), "left")
    told = F.col("descriptor_digest")
    code = (
        F.when(F.col("_id").isNull(), "unknown_sample")
        .when(~F.col("content").eqNullSafe(F.col("_content")), "invalid_content_identity")
        .when(told.isNull() & F.col("_version").isNull(), "unknown_analysis_version")
        .when(told.isNotNull() & (told != F.col("version")), "invalid_sample")
        .when(F.col("_version").isNotNull() & (F.col("_digest") != F.col("version")), "analysis_version_mismatch")
    )
    return joined.select(*batch.columns, code.alias("code"))


def with_analyses(features: DataFrame, batch: DataFrame, samples: DataFrame, versions: DataFrame) -> DataFrame:
    """features with the batch's storable analyses in place of those of the same sample and version; samples stay as they are."""
    good = analysis_problems(batch, samples, versions).where("code IS NULL").drop("code")
    rest = features.join(good.select("sample_id", "version").distinct(), ["sample_id", "version"], "left_anti")
    return rest.unionByName(good.select(*features.columns))
