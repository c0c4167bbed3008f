"""Answers of the recommendation service as their reader takes them: the closed code that refuses one, or its candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbral.sources.json_files import Value

# The schemas' version, and the keys that a run's blocks must have.
SCHEMA = "1.0"
COUNTS = ("eligible", "excluded", "shortlisted", "scored", "unscored", "requested", "returned")
EVIDENCE = ("interface", "double", "unavailable", "cache", "cache_errors")


def _unit(v: Value) -> Column:
    return F.coalesce(v.number().between(0.0, 1.0), F.lit(False))


def batch_problem(answer: Column) -> Column:
    """unsupported_schema, stale_revision, malformed_response, or null.

    Ranks count from 1 without a gap, candidates are named once, scores lie from
    0 to 1, and alternatives are candidates of the batch.
    """
    d = Value(F.try_parse_json(answer))
    batch, run = d.at("recommendation"), d.at("run")
    results, alternatives = batch.at("results"), batch.at("alternatives")
    ids = F.transform(results.items(), lambda c: Value(c).at("candidate_id").text())

    def sound(c: Column, k: Column) -> Column:
        one = Value(c)
        return one.is_object() & F.coalesce(one.at("rank").number() == k + 1, F.lit(False)) & _unit(one.at("compatibility")) & _unit(one.at("confidence")) & one.at("warnings").is_list() & one.at("jev_judgments").is_list()

    good = F.forall(F.transform(results.items(), sound), lambda x: x) & F.forall(ids, lambda i: i.isNotNull()) & (F.size(F.array_distinct(ids)) == F.size(ids))
    named = F.forall(F.transform(alternatives.items(), lambda a: Value(a).text()), lambda a: F.coalesce(F.array_contains(ids, a), F.lit(False)))
    blocks = run.at("counts").holds(*COUNTS) & run.at("evidence").holds(*EVIDENCE) & run.at("retrieval").holds("limit_reason") & (run.at("ranking").at("jev_status").kind == "STRING")
    failed = d.at("error").is_object() | d.at("error").is_list()
    return (
        F.when(~d.is_object() | ~d.at("api_schema").equals(SCHEMA), "unsupported_schema")
        .when(failed, F.when(d.at("error").at("code").equals("revision_conflict"), "stale_revision").otherwise("malformed_response"))
        .when(~batch.is_object() | ~batch.at("schema_version").equals(SCHEMA), "unsupported_schema")
        .when(~run.is_object() | ~blocks | ~results.is_list() | ~alternatives.is_list() | ~(good & named), "malformed_response")
    )


def current_revision(answer: Column) -> Column:
    """The revision that a stale answer names; null if it names none."""
    return Value(F.try_parse_json(answer)).at("error").at("details").at("current_revision").number().cast("long")


def candidates(answers: DataFrame, column: str = "answer") -> DataFrame:
    """The other columns of answers, and rank, candidate_id, compatibility, confidence of the candidates of sound ones."""
    rest = [c for c in answers.columns if c != column]
    kind = "recommendation struct<results: array<struct<candidate_id: string, rank: double, compatibility: double, confidence: double>>>"
    rows = answers.where(batch_problem(F.col(column)).isNull()).select(*rest, F.explode(F.from_json(column, kind)["recommendation"]["results"]).alias("r"))
    return rows.select(*rest, F.col("r.rank").cast("int").alias("rank"), "r.candidate_id", "r.compatibility", "r.confidence")
