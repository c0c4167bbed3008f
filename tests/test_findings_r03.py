"""Cases of the third round's findings."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from timbral.operators import dataset
from timbral.operators import judgments as jd
from timbral.operators import preflight, ranking, retrieval
from timbral.plans import state_queries as sq
from timbral.sources import json_files
from timbral.streaming import jobs, outcomes


def test_a_claim_counts_only_what_it_changed(spark, tmp_path, monkeypatch):
    """run 999 has held items before."""
    rows = [(k, 999, k, "v1", state, 1, None, None) for k, state in enumerate(("complete", "running", "pending", "failed"))]
    items = spark.createDataFrame(rows, "item_id long, run_id long, content long, version string, state string, attempts int, error_code string, finished_at string")
    monkeypatch.setattr(sq, "_items", lambda *_: items)
    assert sorted((r.state, r.n, r.mine) for r in sq.all_claimed(spark, "").collect()) == [("complete", 1, 0), ("failed", 1, 0), ("running", 2, 1)]


def test_entries_of_one_place_repeat_nothing(spark):
    """only what has a later place than the first whole entry repeats it."""
    rows = [(1, 5, "a", True), (1, 5, "a", True), (1, 5, "a", False), (1, 6, "a", False)]
    entries = spark.createDataFrame(rows, "run long, place long, sample_id string, whole boolean").withColumns({"status": F.lit("complete"), "version": F.lit("v1")})
    found = preflight.analysis_entries(entries).collect()
    assert sorted((r.place, r.problem or "") for r in found) == [(5, ""), (5, ""), (5, "analysis_entry_incomplete"), (6, "duplicate_analysis_entry")]


def test_counts_of_questions_need_no_row_for_each(spark):
    """10^12 pairs of sides are counted by their kinds."""
    says = F.struct(*(F.struct(F.when(F.col("id") % 2 == 0, "x").alias("code"), F.array().cast("array<string>").alias("evidence"), F.when(F.col("id") % 2 == 0, F.array(F.lit("g"))).otherwise(F.array().cast("array<string>")).alias("withheld")).alias(d) for d in jd.DIMENSIONS))
    side = spark.range(1_000_000).select(F.col("id").alias("sample_id"), says.alias("says"))
    found = {(r.dimension, r.unavailable): (r.n, r.withheld) for r in jd.question_counts(side, side, jd.SongFacts(tempo=110.0, tempo_confidence=0.9, tonic="C", mode="major", key_confidence=0.9, genre="g")).collect()}
    assert found["texture", None] == (250_000_000_000, 0)
    assert found["texture", "x"] == (750_000_000_000, 1_000_000_000_000)


def test_events_that_name_nothing_are_spread(spark):
    """Rows without a key do not meet in one task of a join by it."""
    rows = spark.range(1000).select((F.col("id") + 1).alias("event_id"), F.lit(None).cast("long").alias("removes_event_id"))
    sizes = rows.repartition(4, outcomes._unset("removes_event_id")).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 400


def test_the_draw_is_the_least_hashes_whatever_the_bound(spark, monkeypatch):
    """a bound that is too low is raised; the rows are those of a plain sort."""
    names = lambda letter, n: [f"{letter}{k}" for k in range(n)]
    table = lambda found: spark.createDataFrame([(x,) for x in found * 2], "identity string")
    sha = lambda *parts: (hashlib.sha256("\n".join(("s", "v", *parts)).encode()).hexdigest(), parts[-1])
    want = {(q, k, b) for q in sorted(names("k", 9), key=lambda q: sha("query", q))[:4] for k, b in enumerate(sorted(names("b", 800), key=lambda b: sha("pair", q, b))[:5])}
    for near in (20, 1.5):
        monkeypatch.setattr(dataset, "NEAR", near)
        assert {tuple(r) for r in dataset.hashed_pairs(table(names("k", 9)), table(names("b", 800)), "s", "v", 4, 5).collect()} == want
    few = dataset.hashed_pairs(table(names("k", 2)), table(names("b", 3)), "s", "v", 4, 5).collect()
    assert len(few) == 6


def test_parts_are_found_by_halves(spark):
    """a row's part takes a look at some of the ends, not at all of them; ends may repeat."""
    for ends in ([0.5], [1.0, 2.0], [1.0, 2.0, 2.0, 5.0, 9.0], [float(k) for k in range(300)]):
        rows = spark.range(-1, 400).withColumn("x", F.col("id") / 2).select("x", jobs._bound(F.array(*map(F.lit, ends)), F.col("x"), len(ends)).alias("n")).collect()
        assert all(r["n"] == sum(e < r["x"] for e in ends) for r in rows)


def test_documents_are_parsed_once(spark):
    """a check names the parsed document many times, but reads it once; what was refused still is."""
    rows = [("{", "fields"), ("[]", "fields"), ('{"schema_version":"1.0","session":{},"ratings":3}', "session"), ('{"schema_version":"1.0","session":{},"ratings":[]}', "ids"), ('{"schema_version":"1.0","session":{"session_id":"s","evaluator_id":"e"},"ratings":[7]}', "rating"), ('{"schema_version":"1.0","session":{"session_id":"s","evaluator_id":"e"},"ratings":[]}', None)]
    table = spark.createDataFrame(rows, "document string, want string")
    for problem in (json_files.export_problem, json_files.pair_list_problem):
        plan = table.select(problem(F.col("document")).alias("p"))._jdf.queryExecution().analyzed().toString()
        assert plan.splitlines()[0].count("parseJson") + plan.splitlines()[0].count("parse_json") == 1, plan[:600]
    assert all(r.p == (r.want and f"malformed_export:{r.want}") for r in table.select("want", json_files.export_problem(F.col("document")).alias("p")).collect())


def test_the_best_are_cut_before_they_are_shuffled(spark):
    """each task keeps a kick's first rows; rows without a score have no rank."""
    rows = spark.createDataFrame([(k, s, None if s == 9 else float(s % 4)) for k in range(3) for s in range(10)], "kick_id int, sample_id int, compatibility double")
    found = ranking.best(rows, 4)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in ranking.rank(rows).where("rank <= 4").collect()}


def _sides(spark, kicks, candidates):
    """Samples with unknown and extreme values, ties and more equal candidates than a shortlist has, and normals of which one is inactive."""
    rng = random.Random(7)
    names = list(retrieval.SPACE)

    def rows(n, first):
        out = []
        for k in range(n):
            values = [None if rng.random() < 0.3 else rng.choice((1.0, 2.5, 7.0)) for _ in names]
            if k % 7 == 0:
                values = [2.5] * len(names)
            if k % 11 == 3:
                values = [None] * 9 + values[9:]
            if k % 13 == 5:
                values[-1] = rng.choice((1e30, float("nan"), float("inf")))
            out.append((first + k, 0.9, *values))
        return spark.createDataFrame(out, "sample_id long, fundamental_confidence double, " + ", ".join(f"{x} double" for x in names))

    fitted = spark.createDataFrame([(x, 9, 0.5 + k, 1.5, "zero_variance" if k == 4 else None) for k, x in enumerate(names)], "dimension string, n long, mean double, std double, inactive_reason string")
    return rows(kicks, 0), rows(candidates, 1000), fitted


def _found(df):
    return sorted(map(repr, df.collect()))


def test_nearest_holds_each_kicks_first_positions(spark, monkeypatch):
    """cells of any size give the shortlist of all pairs; most pairs are never rows."""
    columns = ["kick_id", "sample_id", "similarity", "unavailable_reason", "coverage", "n_common", "position"]
    for kicks, candidates, cell in ((23, 700, (5, 100)), (9, 130, (100, 1000)), (4, 30, (3, 7))):
        k, c, fitted = _sides(spark, kicks, candidates)
        monkeypatch.setattr(retrieval, "CELL", cell)
        monkeypatch.setattr(retrieval, "HELD", 3)
        for digits in (None, 2):
            every = retrieval.similarities(k, c, fitted)
            every = every if digits is None else every.withColumn("similarity", F.round("similarity", digits))
            near = retrieval.nearest(k, c, fitted, 50, digits).cache()
            assert _found(retrieval.shortlist(near, 50).select(columns)) == _found(retrieval.shortlist(every, 50).select(columns))
            assert near.count() < 0.9 * kicks * candidates or candidates < 300 or digits


def test_cutoff_evidence_of_nearest_names_every_tie(spark, monkeypatch):
    """ties are found among what was searched and its copies, not by a second pass over all pairs."""
    monkeypatch.setattr(retrieval, "CELL", (5, 100))
    for candidates in (700, 40):
        k, c, fitted = _sides(spark, 23, candidates)
        for digits in (None, 2):
            every = retrieval.similarities(k, c, fitted)
            every = every if digits is None else every.withColumn("similarity", F.round("similarity", digits))
            found = _found(retrieval.cutoff_evidence(retrieval.nearest(k, c, fitted, 51, digits), 50, c))
            assert found == _found(retrieval.cutoff_evidence(every, 50))
            assert candidates < 300 or any(x.count(",") > 60 for x in found)


def test_sessions_are_repaired_as_a_stream(spark, monkeypatch):
    """F8: a task reads its sessions from sorted batches, which cut them anywhere; no group is a call of its own."""
    rng = random.Random(3)
    rows = [(s, k, k + 1, rng.choice([None, "a", "b", "c"]) if rng.random() < 0.5 else "a") for s in [None, *range(60)] for k in range(rng.randint(1, 12) if s != 7 else 150)]
    df = spark.createDataFrame(rows, "session long, pair_id long, position int, kick string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        shown = dataset.repair_order(df)
        found = shown.collect()
        assert "FlatMapGroupsInPandas" not in shown._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for s in [None, *range(60)]:
        own = [r for r in rows if r[0] == s]
        codes = {k: n for n, k in enumerate(dict.fromkeys(r[3] for r in own))}
        monkeypatch.setattr(dataset, "SHORT", 0)
        want += [(s, own[x][1], at + 1, own[x][3]) for at, x in enumerate(dataset.repaired(np.array([codes[r[3]] for r in own])))]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def _scored_sides(spark):
    """Kicks, candidates and judgments with unknown facts, unreliable keys and many equal scores."""
    rng = random.Random(11)
    numbers = ("transient_strength", "transient_position", "attack", "decay", "fundamental", "fundamental_confidence", "key_confidence", *ranking.BANDS)

    def rows(n, first):
        sides = []
        for k in range(n):
            values = [None if rng.random() < 0.12 else rng.choice((0.0, 0.25, 0.9, 1.0)) for _ in numbers]
            if k % 5 == 0:
                values = [None] * 4 + values[4:-1] + [None]
            sides.append((first + k, "v1", rng.choice((None, "C", "F#", "B")), "major", *values))
        return spark.createDataFrame(sides, "sample_id long, analysis_version string, key_tonic string, key_mode string, " + ", ".join(f"{x} double" for x in numbers))

    said = [(100 + c, d, rng.choice((None, *ranking.LABEL_SCORES)), rng.choice((0.5, 0.9))) for c in range(300) for d in ranking.DIMENSIONS if c % 3 and rng.random() < 0.8]
    return rows(21, 0), rows(300, 100), spark.createDataFrame(said, "candidate_id long, dimension string, label string, confidence double")


def test_leaders_hold_each_kicks_first_ranks(spark, monkeypatch):
    """ranks 2 to 4 and what a batch has in common need no row for each pair."""
    monkeypatch.setattr(ranking, "CELL", (5, 80))
    monkeypatch.setattr(ranking, "HELD", 2)
    kicks, candidates, judgments = (x.cache() for x in _scored_sides(spark))
    for said in (judgments, judgments.where("label is null")):
        ranked = ranking.rank(ranking.score_hybrid(ranking.score_baseline(ranking.pair_with(kicks, candidates)), said)).cache()
        flags = ranking.batch_flags(kicks, candidates, said).cache()
        near = ranking.leaders(kicks, candidates, said, flags, 4).cache()
        assert near.count() < 0.3 * kicks.count() * candidates.count()
        few = ranking.best(ranking.score_hybrid(ranking.score_baseline(ranking.pair_up(near, kicks, candidates)), said, flags=flags), 4)
        assert _found(few.select("kick_id", "sample_id", "rank", "mode", "jev_status", "uncertain")) == _found(ranked.where("rank <= 4").select("kick_id", "sample_id", "rank", "mode", "jev_status", "uncertain"))
        assert _found(ranking.alternatives(few, flags)) == _found(ranking.alternatives(ranked))


def test_what_a_batch_has_in_common_comes_from_kinds(spark):
    """the flags of a kick's batch are known before its pairs are made."""
    kicks, candidates, judgments = (x.cache() for x in _scored_sides(spark))
    for said in (judgments, judgments.where("label is null"), judgments.where("candidate_id < 0")):
        scored = ranking.score_baseline(ranking.pair_with(kicks, candidates))
        flags = ranking.batch_flags(kicks, candidates, said)
        found = ranking.score_hybrid(scored, said, flags=flags)
        assert _found(found) == _found(ranking.score_hybrid(scored, said))


def _odd_sides(spark):
    """_scored_sides() with values that are no numbers or endless, a kick that comes twice, an id that is unknown and a second version."""
    kicks, candidates, judgments = _scored_sides(spark)
    odd = lambda side, n: F.when(side % n == 3, float("nan")).when(side % n == 4, float("inf"))
    kicks = kicks.withColumn("decay", F.coalesce(odd(F.col("sample_id"), 9), "decay"))
    candidates = candidates.withColumn("transient_position", F.coalesce(odd(F.col("sample_id"), 13), "transient_position")).withColumn("analysis_version", F.when(F.col("sample_id") % 6 > 0, "v1").when(F.col("sample_id") % 12 > 0, "v0"))
    candidates = candidates.withColumn("band_high", F.when(F.col("sample_id") % 17 == 0, float("nan")).otherwise(F.col("band_high")))
    return kicks.unionByName(kicks.where("sample_id = 7")), candidates.unionByName(candidates.where("sample_id = 101").withColumn("sample_id", F.lit(None).cast("long"))), judgments


def test_every_pair_is_ranked_without_a_row_to_sort(spark, monkeypatch):
    """scores and ranks of all pairs come from cells of arrays, and are those of rows and a window."""
    kicks, candidates, judgments = (x.cache() for x in _odd_sides(spark))
    rounded = lambda df, names: df.withColumns({n: F.round(n, 9) for n in names})
    scored = ranking.score_baseline(ranking.pair_with(kicks, candidates)).cache()
    base = ("kick_id", "sample_id", *ranking.FITS, *(f"{n}_reason" for n in ranking.FITS), "compatibility", "confidence", "unscored_code", "rank")
    both = ("kick_id", "sample_id", "compatibility", "confidence", "uncertain", "warnings", "mode", "jev_status", "rank")
    for cell, at_once in (((8, 1000), 700), ((100, 1000), 1), ((6, 90), 1 << 18)):
        monkeypatch.setattr(ranking, "RANKED", cell)
        monkeypatch.setattr(ranking, "SCORED", at_once)
        found = ranking.rank_baseline(kicks, candidates)
        assert ("Window" in found._jdf.queryExecution().executedPlan().toString()) == (cell[1] < 300)
        assert _found(found.select(*base)) == _found(ranking.rank(scored).select(*base))
        found = ranking.rank_baseline(kicks, candidates, 9)
        assert _found(found.select(*base)) == _found(ranking.rank(rounded(scored, (*ranking.FITS, "compatibility", "confidence"))).select(*base))
        for said in (judgments, judgments.where("label is null"), judgments.where("candidate_id < 0")) if at_once == 700 else (judgments,):
            flags = ranking.batch_flags(kicks, candidates, said).cache()
            want = ranking.score_hybrid(scored, said).cache()
            assert _found(ranking.rank_hybrid(kicks, candidates, said, flags).select(*both)) == _found(ranking.rank(want).select(*both))
            assert _found(ranking.rank_hybrid(kicks, candidates, said, flags, 9).select(*both)) == _found(ranking.rank(rounded(want, ("compatibility", "confidence"))).select(*both))


def test_rounding_of_arrays_is_that_of_columns(spark):
    """halves of the decimal text go away from zero, whatever the product with 10^9 makes of them."""
    rng = random.Random(5)
    values = [0.0, -0.0, 0.5e-9, -0.5e-9, 2.5e-9, 1e-320, 8388607.123456789, 123456.0000000005, 1e15 + 0.5, 1e30, -1e308, float("nan"), float("inf"), float("-inf")]
    values += [rng.randrange(10**9) * 1e-9 + sign * 5e-10 for _ in range(500) for sign in (-1, 1)] + [float(f"{rng.choice('-0')}0.{rng.randrange(10**9):09}5") for _ in range(500)] + [rng.uniform(-5, 5) for _ in range(500)]
    table = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    want = [r.x for r in table.select("k", F.round("v", 9).alias("x")).orderBy("k").collect()]
    assert list(map(repr, ranking._rounded(np.array([values]), 9)[0].tolist())) == list(map(repr, want))


def test_sides_of_questions_meet_as_texts(spark, monkeypatch):
    """what a side says is sorted and escaped once; a question only joins texts, in tasks by the number of candidates."""
    monkeypatch.setattr(jd, "SPREAD", 3)
    names = [*jd.MEASURES, "fundamental_confidence", "tempo_confidence", "key_confidence"]
    rng = random.Random(2)
    rows = [(k, rng.choice(('ki"ck', "bass\\")), rng.choice((None, "C", "F#")), "major", *(rng.choice((None, 0.0, 0.25, 0.9, 1e-05)) for _ in names)) for k in range(12)]
    table = spark.createDataFrame(rows, "sample_id long, role string, key_tonic string, key_mode string, " + ", ".join(f"{n} double" for n in names))
    kicks, candidates = jd.side_facts(table, "kick").cache(), jd.side_facts(table, "candidate").cache()
    pairs = kicks.withColumnsRenamed({"sample_id": "kick_id", "says": "kick_says"}).crossJoin(candidates.withColumnsRenamed({"sample_id": "candidate_id", "says": "candidate_says"}))
    for song in (None, jd.SongFacts(110.0, 0.9, genre='dub "é"\\')):
        found = jd.all_questions(kicks, candidates, song)
        assert found.rdd.getNumPartitions() >= 4
        columns = ("kick_id", "candidate_id", "dimension", "unavailable", "withheld", "question_id")
        want = jd.questions(pairs, song).withColumn("withheld", F.array_join("withheld", ";"))
        assert _found(found.select(*columns)) == _found(want.select(*columns))
        said = jd.song_facts(song)
        facts = {r.sample_id: r.says for r in kicks.collect()}, {r.sample_id: r.says for r in candidates.collect()}
        for r in want.where("question_id is not null").collect():
            own = [side[n][r.dimension] for side, n in zip(facts, (r.kick_id, r.candidate_id), strict=True)]
            lists = [sorted([*own[0][x], *own[1][x], *said[r.dimension][at]]) for at, x in ((1, "evidence"), (2, "withheld"))]
            whole = f'{{"dimension": "{r.dimension}", "evidence": {jd.json.dumps(lists[0], ensure_ascii=False)}, "prompt_version": "questions-v1", "withheld": {jd.json.dumps(lists[1], ensure_ascii=False)}}}'
            assert r.question_id == "q-" + hashlib.sha256(whole.encode()).hexdigest()
