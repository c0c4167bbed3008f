"""Strict documents in files, the reference of recall, and a table with two writers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from timbral.operators import evaluation as ev
from timbral.sources import json_files, versioned

PAIRS = [{"pair_id": "p1", "kick_sample_id": "k", "bass_sample_id": "b"}, {"pair_id": "p2", "kick_sample_id": "k", "bass_sample_id": "c"}]
LIST = {"schema_version": "1.0", "dataset_version": "v", "split_manifest_digest": "sha256:" + "0" * 64, "sampler_seed": "s", "assignment_seed": "a", "pairs": PAIRS}
RATING = dict.fromkeys(json_files.RATING) | {"pair_id": "p1", "kick_sample_id": "k", "bass_sample_id": "b", "presentation_index": 0, "rating": "good", "skip": False}
EXPORT = {"schema_version": "1.0", "session": {"session_id": "s1", "evaluator_id": "e1"}, "ratings": [RATING]}
MISMATCH = "schema_mismatch:pair_list"


@pytest.mark.parametrize("kind", ["list", "export"])
def test_each_rule(spark, tmp_path, kind):
    text = json.dumps
    lists = [
        (text(LIST), None),
        (text(LIST | {"more": 1}), MISMATCH),
        (text({k: v for k, v in LIST.items() if k != "pairs"}), MISMATCH),
        ("[]", MISMATCH),
        ("{", MISMATCH),
        (text(LIST)[:-1] + ', "pairs": []}', MISMATCH),
        (text(LIST).replace('"v"', "NaN"), MISMATCH),
        (b"\xff" + text(LIST).encode(), MISMATCH),
        (text(LIST | {"schema_version": 1.0}), MISMATCH + ".schema_version"),
        (text(LIST | {"dataset_version": " "}), MISMATCH + ".dataset_version"),
        (text(LIST | {"split_manifest_digest": "sha256:" + "G" * 64}), "split_manifest_digest_invalid:pair_list.split_manifest_digest"),
        (text(LIST | {"split_manifest_digest": "sha256:" + "0" * 64 + "\n"}), "split_manifest_digest_invalid:pair_list.split_manifest_digest"),
        (text(LIST | {"sampler_seed": None}), MISMATCH + ".sampler_seed"),
        (text(LIST | {"assignment_seed": 3}), MISMATCH + ".assignment_seed"),
        (text(LIST | {"pairs": {}}), MISMATCH + ".pairs"),
        (text(LIST | {"pairs": []}), MISMATCH + ".pairs"),
        (text(LIST | {"pairs": [*PAIRS, 7]}), MISMATCH + ".pairs"),
        (text(LIST | {"pairs": [PAIRS[0] | {"x": 1}]}), MISMATCH + ".pairs"),
        (text(LIST | {"pairs": [PAIRS[0] | {"pair_id": "a b"}]}), MISMATCH + ".pairs.pair"),
        (text(LIST | {"pairs": [PAIRS[0] | {"kick_sample_id": ""}]}), MISMATCH + ".pairs.pair"),
    ]
    bad = lambda **x: text(EXPORT | {"ratings": [RATING, RATING | x]})
    exports = [
        (text(EXPORT), None),
        (text(EXPORT | {"ratings": []}), None),
        (bad(rating=None), None),
        (text(EXPORT | {"x": 1}), "malformed_export:fields"),
        (text(EXPORT | {"schema_version": "2"}), "malformed_export:version"),
        (text(EXPORT | {"session": []}), "malformed_export:session"),
        (text(EXPORT | {"ratings": {}}), "malformed_export:session"),
        (text(EXPORT | {"session": {"session_id": "s", "evaluator_id": ""}}), "malformed_export:ids"),
        (bad(rating="great"), "malformed_export:rating"),
        (bad(rating=1), "malformed_export:rating"),
        (bad(skip=None), "malformed_export:rating"),
        (bad(presentation_index="0"), "malformed_export:rating"),
        (bad(presentation_index=0.5), "malformed_export:rating"),
        (bad(pair_id=" "), "malformed_export:rating"),
        (bad(extra=1), "malformed_export:rating"),
    ]
    cases, problem = (lists, json_files.pair_list_problem) if kind == "list" else (exports, json_files.export_problem)
    for k, (data, _) in enumerate(cases):
        (tmp_path / f"{k:03d}.json").write_bytes(data if isinstance(data, bytes) else data.encode())
    files = json_files.read(spark, str(tmp_path))
    got = {int(r.path.rsplit("/", 1)[1][:3]): r for r in files.select("*", problem(F.col("document")).alias("problem")).collect()}
    assert {k: r.problem for k, r in got.items()} == {k: want for k, (_, want) in enumerate(cases)}
    assert got[0].digest == "sha256:" + hashlib.sha256(cases[0][0].encode()).hexdigest()
    if kind == "list":
        assert {(r.pair_id, r.kick, r.bass) for r in json_files.pairs_of(files).collect()} == {("p1", "k", "b"), ("p2", "k", "c")}
    else:
        assert {(r.session_id, r.place, r.label) for r in json_files.ratings_of(files).collect()} == {("s1", 0, "good"), ("s1", 1, None)}


def test_recall_reference(spark):
    pairs = spark.createDataFrame([("p1", "k", "b"), ("p2", "k", "c"), ("p3", "k", "d"), ("p4", "k", "d"), ("p5", "m", "b"), ("p6", "n", "e")], "pair_id string, kick string, bass string")
    rows = [("p1", "e1", "s1", 0, "good", False), ("p1", "e2", "s2", 0, "excellent", False), ("p1", "e1", "s3", 0, "poor", False)]  # e1's first stands; the lower middle is good
    rows += [("p2", "e1", "s1", 1, "good", False), ("p2", "e1", "s2", 1, "good", False)]  # one evaluator
    rows += [("p3", "e1", "s1", 2, "good", False), ("p3", "e2", "s2", 2, "good", False), ("p4", "e1", "s1", 3, "poor", False), ("p4", "e2", "s2", 3, "good", False)]  # the later pair of the two decides
    rows += [("p5", "e1", "s1", 4, "good", True), ("p5", "e2", "s2", 4, "good", False), ("p5", "e3", "s4", 0, None, False)]
    rows += [("p6", "e1", "s1", 5, "excellent", False), ("p6", "e2", "s2", 5, "good", False), ("p6", "e3", "s4", 1, "poor", False), ("p9", "e1", "s1", 6, "good", False)]
    ratings = spark.createDataFrame(rows, "pair_id string, evaluator_id string, session_id string, place int, label string, skipped boolean")
    assert {r.query: (r.declared, r.positive) for r in ev.recall_reference(pairs, ratings).collect()} == {"k": (["b", "c", "d"], ["b"]), "m": (["b"], []), "n": (["e"], ["e"])}


FEATURES = "sample_id string, version string, value double"


def test_of_two_writers_one_is_refused(spark, tmp_path):
    folder = str(tmp_path)
    row = lambda *rows: spark.createDataFrame(list(rows), FEATURES)
    assert versioned.latest(spark, folder) == 0 and versioned.read(spark, folder, FEATURES).count() == 0
    assert versioned.commit(row(("a", "v1", 1.0)), folder, 0) == 1
    seen = versioned.latest(spark, folder)
    first, second = (versioned.read(spark, folder, FEATURES, seen).unionByName(row((name, "v1", 2.0))) for name in "bc")
    assert versioned.commit(first, folder, seen) == 2
    with pytest.raises(versioned.Conflict):
        versioned.commit(second, folder, seen)
    assert {r.sample_id for r in versioned.read(spark, folder, FEATURES).collect()} == {"a", "b"}
    assert {r.sample_id for r in versioned.read(spark, folder, FEATURES, 1).collect()} == {"a"}
    assert len(list((tmp_path / "data").iterdir())) == 2
    # a change is judged again on what the other writer has left
    raced = []

    def step(rows):
        if not raced:
            raced.append(versioned.commit(rows.unionByName(row(("x", "v1", 9.0))), folder, 2))
        return rows.unionByName(row(("y", "v1", 3.0)))

    assert versioned.change(spark, folder, FEATURES, step) == 4
    assert {r.sample_id for r in versioned.read(spark, folder, FEATURES).collect()} == {"a", "b", "x", "y"}


def test_analyses_of_contents_that_have_changed(spark):
    samples = spark.createDataFrame([("a", "c1"), ("b", "c2"), ("d", None)], "sample_id string, content string")
    versions = spark.createDataFrame([("v1", "v1"), ("v2", "other")], "version string, digest string")
    rows = [("a", "c1", "v1", None), ("b", "c1", "v1", None), ("z", "c1", "v1", None), ("d", "c4", "v1", None), ("a", "c1", "v9", None), ("a", "c1", "v9", "v9"), ("a", "c1", "v9", "v8"), ("b", "c2", "v2", "v2")]
    batch = spark.createDataFrame(rows, "sample_id string, content string, version string, descriptor_digest string").withColumn("value", F.lit(5.0))
    found = {tuple(r)[:4]: r.code for r in versioned.analysis_problems(batch, samples, versions).collect()}
    assert found == dict(zip(rows, [None, "invalid_content_identity", "unknown_sample", "invalid_content_identity", "unknown_analysis_version", None, "invalid_sample", "analysis_version_mismatch"], strict=True))
    features = spark.createDataFrame([("a", "v1", 1.0), ("b", "v1", 2.0)], FEATURES)
    assert {tuple(r) for r in versioned.with_analyses(features, batch, samples, versions).collect()} == {("a", "v1", 5.0), ("b", "v1", 2.0), ("a", "v9", 5.0)}
