"""Queries over whole tables reach every row, session and evaluator."""

from timbral.plans import registry

SF = "/root/testdata/sf0.01"


def test_probabilities_of_every_row(spark):
    assert registry.queries()["X20_X21_all_probabilities"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_claim_counts_every_item(spark):
    from timbral.sources import views

    found = registry.queries()["T3_L9_all_claim"](spark, SF).collect()
    assert sum(r.n for r in found) == views.job_items(spark, SF).count()
    assert {r.state for r in found if r.mine} == {"running", "superseded"}  # what a run supersedes is credited to it
    assert sum(r.mine for r in found if r.state == "running") == 20


def test_counts_of_every_session(spark):
    found = registry.queries()["G25_each_session_counts"](spark, SF).collect()
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert len(found) == events.select("user_id").distinct().count()
    assert sum(r.answered + r.skipped for r in found) == events.count()


def test_an_evaluator_beyond_the_fifth_flips_a_gate(spark):
    from timbral.operators import evaluation as ev

    rows = [(1, 1, e, r, e) for e, r in ((1, 0), (2, 0), (3, 2), (9, 2), (10, 2))] + [(1, 2, e, 3, e) for e in (1, 2)] + [(1, 3, e, 2, e) for e in (9, 10)]
    ratings = spark.createDataFrame(rows, "query long, item long, evaluator long, rating int, seq long")
    got = {(r.left_out, r.item): (r.rating, r.raters) for r in ev.left_out_medians(ratings).collect()}
    assert got == {(1, 1): (2, 4), (2, 1): (2, 4), (3, 1): (0, 4), (9, 1): (0, 4), (10, 1): (0, 4)}
    whole = {}
    for out in (1, 2, 3, 9, 10):
        for item in (1, 2, 3):
            left = sorted(r[3] for r in rows if r[1] == item and r[2] != out)
            if len(left) >= 2:
                whole[out, item] = (left[(len(left) - 1) // 2], len(left))
    assert got.items() <= whole.items()
    means = {r.left_out: round(r["mean"], 9) for r in ev.left_out_means(ratings).collect()}
    want = {}
    for (out, _), (rating, _) in whole.items():
        want.setdefault(out, []).append(rating)
    assert means == {out: round(sum(x) / len(x), 9) for out, x in want.items()}
    assert means[9] == 1.5 and means[3] > 1.5


def test_every_evaluator_is_left_out(spark):
    found = registry.queries()["G16_leave_each_out"](spark, SF).select("left_out").distinct().count()
    assert found == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().count()
