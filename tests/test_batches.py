"""Answers of the service, each rule once; files that have changed since they were recorded."""

import copy
import json

from pyspark.sql import functions as F

from timbral.operators import batches, dataset

CANDIDATE = {"candidate_id": "a", "rank": 1, "compatibility": 0.5, "confidence": 1, "warnings": [], "jev_judgments": []}
GOOD = {
    "api_schema": "1.0",
    "recommendation": {"schema_version": "1.0", "results": [CANDIDATE, CANDIDATE | {"candidate_id": "b", "rank": 2.0}], "alternatives": ["b"]},
    "run": {"counts": dict.fromkeys(batches.COUNTS, 1), "evidence": dict.fromkeys(batches.EVIDENCE, 0), "retrieval": {"limit_reason": None}, "ranking": {"jev_status": "absent"}},
}


def but(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for p in path[:-1]:
        at = at[p]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


RESULTS = ("recommendation", "results")
BAD, OLD = "malformed_response", "unsupported_schema"
CASES = [
    (json.dumps(GOOD), None),
    (but(RESULTS, []).replace('["b"]', "[]"), None),
    (but(("recommendation", "alternatives"), []), None),
    (but((*RESULTS, 0, "extra"), 1), None),
    ("{", OLD),
    ("[]", OLD),
    (but(("api_schema",), 1.0), OLD),
    (but(("api_schema",), "2.0"), OLD),
    (but(("recommendation", "schema_version"), "0"), OLD),
    (but(("recommendation",), None), OLD),
    (but(("error",), {"code": "revision_conflict", "details": {"current_revision": 4}}), "stale_revision"),
    (but(("error",), {"code": "revision_conflict"}), "stale_revision"),
    (but(("error",), {"code": "internal_error"}), BAD),
    (but(("error",), "text"), None),
    (but(("run",), ...), BAD),
    (but(("run", "counts", "returned"), ...), BAD),
    (but(("run", "evidence"), []), BAD),
    (but(("run", "retrieval", "limit_reason"), ...), BAD),
    (but(("run", "ranking", "jev_status"), None), BAD),
    (but(RESULTS, {}), BAD),
    (but(("recommendation", "alternatives"), None), BAD),
    (but((*RESULTS, 1), "b"), BAD),
    (but((*RESULTS, 1, "rank"), 3), BAD),
    (but((*RESULTS, 1, "rank"), "2"), BAD),
    (but((*RESULTS, 1, "candidate_id"), "a"), BAD),
    (but((*RESULTS, 0, "candidate_id"), 5), BAD),
    (but((*RESULTS, 0, "compatibility"), 1.01), BAD),
    (but((*RESULTS, 0, "confidence"), -0.1), BAD),
    (but((*RESULTS, 0, "confidence"), None), BAD),
    (but((*RESULTS, 0, "confidence"), True), BAD),
    (but((*RESULTS, 0, "warnings"), ...), BAD),
    (but((*RESULTS, 0, "jev_judgments"), "x"), BAD),
    (but(("recommendation", "alternatives"), ["b", "c"]), BAD),
    (but(("recommendation", "alternatives"), [1]), BAD),
]


def test_each_rule(spark):
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CASES)], "n int, answer string")
    found = {r.n: (r.code, r.current) for r in df.select("n", batches.batch_problem(F.col("answer")).alias("code"), batches.current_revision(F.col("answer")).alias("current")).collect()}
    assert {k: code for k, (code, _) in found.items()} == {k: want for k, (_, want) in enumerate(CASES)}
    assert found[10][1] == 4 and found[11][1] is None
    assert {tuple(r) for r in batches.candidates(df.where("n = 0")).collect()} == {(0, 1, "a", 0.5, 1.0), (0, 2, "b", 0.5, 1.0)}


def test_records_of_changed_files(spark):
    records = spark.createDataFrame([("s", f"p{k}", group, role, "x", "m") for k, (group, role) in enumerate([("selected", "kick")] * 5 + [("reserves", "kick"), ("selected", "bass")])], "source string, path string, group string, role string, sha256 string, metadata string")
    found = spark.createDataFrame([("s", "p0", "x", "m", None), ("s", "p1", "y", "n", None), ("s", "p2", "x", "n", None), ("s", "p3", None, None, "io_error"), ("t", "p4", "x", "m", None), ("s", "p5", "x", "m", None), ("s", "p6", "x", None, None)], "source string, path string, sha256 string, metadata string, error string")
    checked = dataset.revalidated(records, found)
    assert {r.path: r.error for r in checked.collect()} == {"p0": None, "p1": "stale_fingerprint", "p2": "stale_metadata", "p3": "io_error", "p4": "not_found", "p5": None, "p6": "stale_metadata"}
    assert {tuple(r) for r in dataset.verified_shortfall(checked, 3).collect()} == {("kick", 1, 2), ("bass", 0, 3)}
