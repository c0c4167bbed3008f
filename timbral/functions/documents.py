"""JSON documents: strict parsing, canonical text and digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict_parse(text: str):
    """A JSON document without repeated keys and without NaN or infinities; ValueError otherwise."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("duplicate_key")
        return out

    def constant(name):
        raise ValueError("not_finite")

    found = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    json.dumps(found, allow_nan=False)  # 1e999 is an infinity, too
    return found


def canonical(value) -> str:
    """Sorted keys, no spaces, ASCII only, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def _problem(text: str | None) -> str | None:
    if text is None:
        return "missing"
    try:
        strict_parse(text)
    except json.JSONDecodeError:
        return "invalid_json"
    except ValueError as e:
        return str(e) if str(e) in ("duplicate_key", "not_finite") else "not_finite"
    except RecursionError:
        return "invalid_json"
    return None


@F.pandas_udf(T.StringType())
def json_problem(text: pd.Series) -> pd.Series:
    """Why a text is no strict JSON document, or null."""
    return text.map(_problem)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """A strict document in canonical form; null for others."""
    return text.map(lambda t: canonical(strict_parse(t)) if _problem(t) is None else None)


@F.pandas_udf(T.StringType())
def json_digest(text: pd.Series) -> pd.Series:
    """SHA-256 of a strict document's canonical form; null for others."""
    return text.map(lambda t: digest(strict_parse(t)) if _problem(t) is None else None)


def struct_digest(*columns: str) -> Column:
    """Digest of named columns as one document, nulls included."""
    return json_digest(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def palette_hash(items: DataFrame, contexts: DataFrame, version: str = "palette-hash-v1") -> DataFrame:
    """palette_id and palette_hash, the identity of what each palette of contexts selects.

    items: palette_id, slot, sample_id, role of what is active; contexts:
    palette_id, tempo, tempo_confidence, tempo_reason, tonic, mode,
    key_confidence, key_reason, genre, genre_reason.  Revisions, times and
    removed items are no part of it.
    """
    rows = items.groupBy("palette_id").agg(F.array_sort(F.collect_list(F.struct("slot", "sample_id", "role"))).alias("items"))
    none = F.array().cast("array<struct<slot: string, sample_id: string, role: string>>")
    held = contexts.join(rows, "palette_id", "left").withColumn("items", F.coalesce(F.col("items").cast("array<struct<slot: string, sample_id: string, role: string>>"), none))
    reason = lambda name: F.col(name).alias("unavailable_reason")
    context = F.struct(
        F.struct(F.col("tempo").alias("value"), F.col("tempo_confidence").alias("confidence"), reason("tempo_reason")).alias("tempo"),
        F.struct("tonic", "mode", F.col("key_confidence").alias("confidence"), reason("key_reason")).alias("key"),
        F.struct(F.col("genre").alias("value"), reason("genre_reason")).alias("genre"),
    )
    named = held.withColumns({"context": context, "palette_hash_version": F.lit(version)})
    return named.select("palette_id", struct_digest("palette_hash_version", "palette_id", "items", "context").alias("palette_hash"))


def run_id(columns: list[str]) -> Column:
    """A run's id: the digest of everything that decides its result."""
    return F.concat(F.lit("run-"), struct_digest(*columns))


def dataset_version(members: DataFrame, policy: str) -> DataFrame:
    """One row: the digest of a data set's policy and members. Members are digested by group first, so no task holds them all."""
    key = F.sha2(F.concat_ws("\n", "sample_id", "sha", "role"), 256)
    groups = members.select(key.alias("key")).groupBy(F.substring("key", 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("key")), ""), 256).alias("sha"))
    return groups.agg(F.sha2(F.concat(F.lit(policy + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha"))), lambda x: x["sha"]), "")), 256).alias("version"))
