"""Split manifests and assignments in each form, sample details, run keys, representatives and arms."""

import hashlib
import json

from timbral.operators import evaluation as ev
from timbral.operators import library, records
from timbral.sources import json_files


def test_split_manifests(spark):
    cases = {
        "plain": ({"held_out": {"kicks": ["a", "b"], "bass": ["c"]}, "tuning": {"kicks": ["d"], "basses": ["e"]}}, {("held_out", "kick", 0, "a"), ("held_out", "kick", 1, "b"), ("held_out", "bass", 0, "c"), ("tuning", "kick", 0, "d"), ("tuning", "bass", 0, "e")}),
        "names": ({"held-out": {"kicks": [], "basses": ["c"]}, "tune": 3}, {("held_out", "bass", 0, "c")}),
        "tuning": ({"heldout": {"kicks": ["a"], "bass": []}, "tuning": {"kicks": [1], "bass": ["e"]}}, {("held_out", "kick", 0, "a"), ("tuning", "bass", 0, "e")}),
        "first": ({"held_out": {"kicks": ["a"], "bass": []}, "heldout": {"kicks": ["x"], "bass": ["y"]}}, {("held_out", "kick", 0, "a")}),
        "no part": ({"kept": {"kicks": ["a"], "bass": ["b"]}}, set()),
        "no basses": ({"held_out": {"kicks": ["a"]}}, set()),
        "no kicks": ({"held_out": {"bass": ["a"]}}, set()),
        "empty name": ({"held_out": {"kicks": [""], "bass": []}}, set()),
        "a list": ({"held_out": ["a"]}, set()),
    }
    df = spark.createDataFrame([(k, json.dumps(d)) for k, (d, _) in cases.items()] + [("broken", "{")], "name string, document string")
    found = {}
    for r in json_files.split_rows(df).collect():
        found.setdefault(r.name, set()).add((r.partition, r.role, r.place, r.sample_id))
    assert found == {k: want for k, (_, want) in cases.items() if want}


def test_assignments(spark):
    cases = {
        "map": ({"p": ["e1", "e2"], "q": []}, {("p", 0, "e1"), ("p", 1, "e2")}),
        "list": ([{"pair_id": "p", "evaluators": ["e1"]}, {"pair_id": "q", "evaluators": ["e2"], "more": 1}, {"pair_id": "p", "evaluators": ["e3"]}], {("p", 0, "e3"), ("q", 0, "e2")}),
        "no list": ({"p": "e1"}, set()),
        "a number": ({"p": ["e1"], "q": [2]}, set()),
        "no pair": ([{"pair_id": "", "evaluators": ["e1"]}], set()),
        "no evaluators": ([{"pair_id": "p"}], set()),
        "text": ("p", set()),
        "nothing": (None, set()),
    }
    df = spark.createDataFrame([(k, json.dumps({"assignments": d})) for k, (d, _) in cases.items()], "name string, document string")
    found = {}
    for r in json_files.assignment_rows(df).collect():
        found.setdefault(r.name, set()).add((r.pair_id, r.place, r.evaluator))
    assert found == {k: want for k, (_, want) in cases.items() if want}


def test_sample_details(spark):
    samples = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "sample_id long, content string")
    analysed = spark.createDataFrame([("a", "v1"), ("a", "v0"), ("b", "v0")], "content string, version string")
    items = spark.createDataFrame([(1, "a", "v1", "complete", 1, None, "t1"), (2, "b", "v1", "failed", 3, "io_error", "t2"), (3, "c", "v0", "complete", 1, None, "t3"), (4, "d", "v1", "pending", 0, None, None)], "item_id long, content string, version string, state string, attempts int, error_code string, finished_at string")
    found = {r.sample_id: (r.state, r.analysis_version, r.analyzed_at, r.attempts, r.error_code, r.stored_versions) for r in library.sample_detail(samples, analysed, items, "v1").collect()}
    assert found == {1: ("current", "v1", "t1", 1, None, ["v0", "v1"]), 2: ("stale", None, None, 3, "io_error", ["v0"]), 3: ("absent", None, None, None, None, []), 4: ("pending", None, None, 0, None, [])}


def test_run_keys(spark):
    rows = [(1, "d", "s", "r1"), (2, "d", "s", "r2"), (3, "d", "s", "r1"), (4, "d", None, "r1"), (5, "e", "s", "r1")]
    found = {r.run: r for r in records.run_keys(spark.createDataFrame(rows, "run int, dataset_version string, split_manifest_digest string, ranking_version string"), ["dataset_version", "split_manifest_digest", "ranking_version"]).collect()}
    key = lambda d, s, r: hashlib.sha256(json.dumps({"dataset_version": d, "split_manifest_digest": s, "ranking_version": r}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert all(found[n].run_key == key(*rest) for n, *rest in rows)
    assert {n: len(r.others) for n, r in found.items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0} and found[1].others == [found[2].run_key]


def test_representatives(spark):
    rows = [(5, "kick", "read_validation_failed: tag", 7, "x"), (3, "kick", "read_validation_failed: tag", 7, "y"), (1, "kick", "duplicate_content", 7, "z"), (2, "bass", "read_validation_failed: padding", 7, "w"), (0, "pad", "read_validation_failed: tag", 7, "v"), (4, "kick", "read_validation_failed: tag", None, "u")]
    excluded = spark.createDataFrame(rows, "place int, role string, reason string, tag int, path string")
    expected = spark.createDataFrame([("kick", 7, "encoding"), ("bass", 7, "encoding"), ("bass", 7, "bounds")], "role string, tag int, category string")
    assert {tuple(r) for r in records.representatives(excluded, expected).collect()} == {("kick", 7, "encoding", 3, "y"), ("bass", 7, "encoding", None, None), ("bass", 7, "bounds", 2, "w")}


def test_arms(spark):
    cases = [
        (("random", 5, True, "none", 0, 0, 3), None),
        (("hybrid", 5, True, "live", 9, 4, 3), None),
        (("hybrid", 5, True, "live", 0, 0, 3), None),
        (("random", 0, False, "none", 0, 0, 0), "no_held_out_query"),
        (("random", 5, False, "none", 0, 0, 0), "no_analysis_manifests"),
        (("jev-only", 5, True, "none", 0, 0, 0), "no_live_jev_outcomes"),
        (("hybrid", 5, True, "none", 9, 0, 0), "no_live_jev_outcomes"),
        (("hybrid", 5, True, "live", 9, 0, 0), "hybrid_fell_back_to_dsp"),
        (("dsp-only", 5, True, "none", 9, 0, 0), "no_eligible_query"),
    ]
    df = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "n int, arm string, queries int, analyses boolean, evidence string, scored int, hybrid_scored int, eligible_queries int")
    assert {r.n: (r.status, r.status_reason) for r in ev.arm_status(df).collect()} == {k: ("insufficient" if why else "evaluated", why) for k, (_, why) in enumerate(cases)}
    sources = spark.createDataFrame([(1, "double"), (1, "interface"), (2, "double"), (2, None)], "run int, source string")
    assert {tuple(r) for r in ev.evidence_sources(sources).collect()} == {(1, 1, "live"), (2, 0, "none")}
