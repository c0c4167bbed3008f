"""Hand-written cases of verdicts, flipped gates, sessions, eligibility, file names and palettes' identities."""

import hashlib
import json

from pyspark.sql import functions as F

from timbral.functions import documents
from timbral.operators import dataset
from timbral.operators import evaluation as ev


def test_verdicts(spark):
    cases = [
        ((0.7, 0.1, 0.9, True, False), "supported"),
        ((0.6, 0.1, 0.9, True, False), "supported"),
        ((0.7, 0.0, 0.9, True, False), "inconclusive"),
        ((0.7, -0.1, 0.9, True, False), "inconclusive"),
        ((0.59, 0.1, 0.9, True, False), "inconclusive"),
        ((0.3, 0.1, 0.59, True, False), "not supported"),
        ((0.3, 0.1, 0.6, True, False), "inconclusive"),
        ((0.7, 0.1, 0.9, True, True), "inconclusive"),
        ((0.3, 0.1, 0.5, True, True), "inconclusive"),
        ((0.7, 0.1, 0.9, False, True), "insufficient"),
        ((None, 0.1, 0.9, True, False), "insufficient"),
        ((0.7, None, None, True, True), "insufficient"),
    ]
    df = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "n int, value double, low double, high double, met boolean, unsure boolean")
    got = {r.n: r.v for r in df.select("n", ev.verdict(F.col("value"), F.col("low"), F.col("high"), F.lit(0.6), F.col("met"), F.col("unsure")).alias("v")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_flipped_gates(spark):
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 0.9), ("c", 1.0, None)], "gate string, minimum double, value double")
    out = spark.createDataFrame([(g, e, v) for g in "abc" for e, v in ((1, 1.2), (2, 0.99), (3, None))], "gate string, left_out int, value double")
    assert {tuple(r) for r in ev.flipped(points, out).collect()} == {("a", 2), ("a", 3), ("b", 1), ("b", 3), ("c", 1), ("c", 2)}


def test_sessions(spark):
    def answer(session, index, seq, label="good", skipped=False, recognised=False, completed=True, pair="p"):
        return session, index, seq, pair, skipped, recognised, completed, label

    rows = [answer(1, k, k) for k in range(4)] + [answer(1, 4, 5, recognised=True), answer(1, 0, 9, "poor"), answer(1, 1, 10, skipped=True), answer(1, 2, 11, completed=False), answer(1, 3, 12, "great")]
    rows += [answer(2, 0, 1, recognised=True), answer(2, 1, 2), answer(2, 0, 3)]  # the correction takes the recognition back
    rows += [answer(3, 0, 1, recognised=True), answer(3, 1, 2, recognised=True), answer(3, 2, 3)]  # 2 of 9 planned, 2 of 3 answered
    rows += [answer(4, 0, 1)] + [answer(5, 0, 1), answer(5, 1, 2, pair=None)]
    answers = spark.createDataFrame(rows, "session_id long, presentation_index long, seq long, pair_id string, skipped boolean, recognised boolean, completed boolean, label string")
    sessions = spark.createDataFrame([(1, 5, None), (2, 3, "desk"), (3, 9, "desk"), (4, 5, "dry-run 7"), (5, 9, ""), (6, 0, None)], "session_id long, planned int, monitoring string")
    found = {r.session_id: (r.effective, r.recognised, r.counted, r.reason) for r in ev.session_verdicts(answers, sessions).collect()}
    assert found == {1: (5, 1, True, None), 2: (2, 0, True, None), 3: (3, 2, False, "recognised_rate_above_maximum"), 4: (1, 0, False, "tooling_session"), 5: (2, 0, True, None), 6: (0, 0, True, None)}
    assert {tuple(r) for r in ev.valid_ratings(answers, sessions).collect()} == {(1, 9, "p", 0.0), (2, 2, "p", 2.0), (2, 3, "p", 2.0), (5, 1, "p", 2.0)}


def test_eligibility(spark):
    orders = spark.createDataFrame([("x", q, i, None if q == 4 and i > 1 else 1.0) for q in (1, 3, 4) for i in (1, 2, 3)], "arm string, query long, item long, score double")
    medians = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (3, 1, 2), (4, 1, 1), (4, 2, 1), (4, 3, 1)], "query long, item long, rating int")
    asked = spark.createDataFrame([(1, None), (2, None), (3, None), (4, None), (5, "unknown_role")], "query long, filter_error string")
    found = {r.query: (r["items"], r.rated, r.scored, r.reason) for r in ev.eligibility(orders, medians, asked).collect()}
    assert found == {1: (3, 2, 2, None), 2: (0, 0, 0, "no_eligible_candidate_set"), 3: (3, 1, 1, "rated_subset_below_minimum_ratings"), 4: (3, 3, 1, "scored_share_below_minimum"), 5: (0, 0, 0, "filter_error")}


def test_names_and_rules_of_files(spark):
    names = {"a/Kick_1.wav": "kick", "Kicks/x.wav": "", "a/Bass Drum.wav": "kick,bass", "bassdrum.wav": "kick,bass", "808 boom.wav": "bass", "a/sub_01.wav": "bass", "subway.wav": "", "my-sub.wav": "bass", "kick.v2.bass.wav": "kick,bass", "x.kick": "", ".kick": "kick"}
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r.path: r.h for r in df.select("path", F.array_join(dataset.role_hints(F.col("path")), ",").alias("h")).collect()} == names
    closed = {"Demo/a.wav": True, "a/my_preview.wav": True, "misc": True, "a/Demos/b.wav": False, "miscellany/x.wav": False, "x/demo.one.wav": True}
    df = spark.createDataFrame([(n,) for n in closed], "path string")
    assert {r.path: r.c for r in df.select("path", dataset.restricted(F.col("path")).alias("c")).collect()} == closed
    rules = spark.createDataFrame([("s", "category", "K", "kick", "r2", "a"), ("s", "category", "K/deep", "kick", "r1", "b"), ("s", "file", "K/x.wav", "bass", "r3", "c"), ("t", "category", "K", "bass", "r4", "d"), ("s", "category", "f.wav", "bass", "r5", "e")], "source string, kind string, path string, role string, rule_id string, subtype string")
    files = spark.createDataFrame([("s", "K/deep/y.wav"), ("s", "K/x.wav"), ("s", "Kick/y.wav"), ("t", "K/z.wav"), ("s", "f.wav")], "source string, path string")
    found = {(r.source, r.path): tuple(r)[2:] for r in dataset.role_evidence(files, rules).collect()}
    none = (None, None, None, None)
    assert found == {("s", "K/deep/y.wav"): ("kick", "trusted_category", "r1", "b", None), ("s", "K/x.wav"): (*none, "conflicting_role_evidence"), ("s", "Kick/y.wav"): (*none, "unconfirmed_role"), ("t", "K/z.wav"): ("bass", "trusted_category", "r4", "d", None), ("s", "f.wav"): (*none, "unconfirmed_role")}


def test_palette_identity(spark):
    """All that a palette selects is in its hash, and nothing else."""
    columns = "palette_id string, tempo double, tempo_confidence double, tempo_reason string, tonic string, mode string, key_confidence double, key_reason string, genre string, genre_reason string"
    base = ("p", 120.0, 0.9, None, "C", "major", 0.8, None, "döb", None)
    items = [("p", "kick", "k", "kick"), ("p", "bass", "b", "bass")]

    def hashed(context=base, rows=items):
        return documents.palette_hash(spark.createDataFrame(rows, "palette_id string, slot string, sample_id string, role string"), spark.createDataFrame([context], columns)).first().palette_hash

    document = {
        "palette_hash_version": "palette-hash-v1",
        "palette_id": "p",
        "items": [{"slot": "bass", "sample_id": "b", "role": "bass"}, {"slot": "kick", "sample_id": "k", "role": "kick"}],
        "context": {"tempo": {"value": 120.0, "confidence": 0.9, "unavailable_reason": None}, "key": {"tonic": "C", "mode": "major", "confidence": 0.8, "unavailable_reason": None}, "genre": {"value": "döb", "unavailable_reason": None}},
    }
    assert hashed() == hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest() == hashed(rows=items[::-1])
    changed = [base[:k] + (x,) + base[k + 1 :] for k, x in enumerate(("q", 121.0, 0.8, "r", "D", "minor", 0.9, "r", "dub", "r")) if k]
    others = {hashed(c) for c in changed} | {hashed(rows=items[:1]), hashed(rows=[items[0], ("p", "bass", "b", "sub-bass")]), hashed(rows=[])}
    assert len(others) == 12 and hashed() not in others
