"""Evaluation of rankings against human ratings: medians, arm metrics, lifts, agreement, recall, verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.operators.dataset import seeded_twister

# Sizes of the recall curve, the top-k size, and the latency percentiles.
CURVE = (5, 10, 20, 50, 100)
TOP = 10
RECOGNISED_MOST = 0.20
SCORED_LEAST = 0.50
RATED_LEAST = 2
# Labels that are ratings, and how the description of a session that only tries the tools begins.
RATING_LABELS = {"poor": 0.0, "acceptable": 1.0, "good": 2.0, "excellent": 3.0}
TOOLING = "dry-run"
#: Resamples of a bootstrap in one task.
_RESAMPLES = 250


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def first_ratings(ratings: DataFrame) -> DataFrame:
    """Each evaluator's first rating of an item of a query; the least of those given at once."""
    return ratings.groupBy("query", "item", "evaluator").agg(F.min_by("rating", F.struct("seq", "rating")).alias("rating"))


def last_answers(answers: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each key's last answer."""
    value = F.struct(*[c for c in answers.columns if c not in key])
    return answers.groupBy(*key).agg(F.max_by(value, order).alias("v")).select(*key, "v.*")


def item_medians(ratings: DataFrame, least: int = 2) -> DataFrame:
    """query, item, rating (the lower of the middle two) and raters, of items with enough evaluators."""
    found = first_ratings(ratings).groupBy("query", "item").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rating)").alias("rating"), F.count("*").alias("raters"))
    return found.where(F.col("raters") >= least).withColumn("rating", F.col("rating").cast("int"))


def arm_orders(scores: DataFrame) -> DataFrame:
    """scores(arm, query, item, score) with position: scored rows by score and item, then the unscored by item."""
    order = Window.partitionBy("arm", "query").orderBy(F.col("score").isNull(), F.col("score").desc_nulls_last(), "item")
    return scores.withColumn("position", F.row_number().over(order))


def query_metrics(orders: DataFrame, medians: DataFrame, top: int = TOP) -> DataFrame:
    """arm, query and: n rated and scored items, decided pairs, pairwise accuracy, top-1 margin, top-k mean, rating mean.

    A pair counts if its ratings differ; an item without a score is in no
    metric.  Accuracy needs a decided pair, the margin three items and the
    top-k mean two.
    """
    rated = orders.join(medians.select("query", "item", "rating"), ["query", "item"]).where("score is not null")
    place = Window.partitionBy("arm", "query").orderBy("position")
    rated = rated.withColumn("place", F.row_number().over(place))
    row = F.struct("place", "rating")
    lists = rated.groupBy("arm", "query").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count("*").alias("n"), F.avg("rating").alias("rating_mean"))
    # a query's rated items are a closed, short list; its pairs never leave the row
    later = lambda r: F.filter("rows", lambda s: s["place"] > r["place"])
    total = lambda test: F.aggregate(F.transform("rows", lambda r: F.size(F.filter(later(r), lambda s: test(r, s)))), F.lit(0), lambda a, b: a + b)
    decided = total(lambda r, s: r["rating"] != s["rating"])
    right = total(lambda r, s: r["rating"] > s["rating"])
    with_pairs = lists.withColumn("decided_pairs", decided).withColumn("right_pairs", right)
    rest = F.aggregate(F.slice("rows", 2, 1_000_000), F.lit(0.0), lambda a, r: a + r["rating"])
    best = F.aggregate(F.slice("rows", 1, top), F.lit(0.0), lambda a, r: a + r["rating"])
    return with_pairs.select(
        "arm",
        "query",
        "n",
        "decided_pairs",
        ratio(F.col("right_pairs"), F.col("decided_pairs")).alias("pairwise_accuracy"),
        F.when(F.col("n") >= 3, F.element_at("rows", 1)["rating"] - rest / (F.col("n") - 1)).alias("top1_margin"),
        F.when(F.col("n") >= 2, best / F.least(F.col("n"), F.lit(top))).alias("topk_mean"),
        "rating_mean",
    )


def eligibility(orders: DataFrame, medians: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """arm, query, items, rated, scored, and the first reason that keeps the query out, or null.

    queries: query and filter_error of all that were asked, so that one without
    items is seen, too; without it, those that have items.
    """
    joined = orders.join(medians.select("query", "item", "rating"), ["query", "item"], "left")
    counted = joined.groupBy("arm", "query").agg(F.count("*").alias("items"), F.count("rating").alias("rated"), F.count_if(F.col("rating").isNotNull() & F.col("score").isNotNull()).alias("scored"))
    if queries is None:
        counted = counted.withColumn("filter_error", F.lit(None).cast("string"))
    else:
        asked = queries.select("query", "filter_error").crossJoin(F.broadcast(orders.select("arm").distinct()))  # a handful of arms
        counted = asked.join(counted, ["arm", "query"], "left").na.fill(0, ["items", "rated", "scored"])
    share = ratio(F.col("scored"), F.col("rated"))
    reason = (
        F.when(F.col("filter_error").isNotNull(), "filter_error")
        .when(F.col("items") == 0, "no_eligible_candidate_set")
        .when(F.col("rated") < RATED_LEAST, "rated_subset_below_minimum_ratings")
        .when(share < SCORED_LEAST, "scored_share_below_minimum")
    )
    return counted.withColumn("reason", reason).select("arm", "query", "items", "rated", "scored", "reason")


def arm_summary(metrics: DataFrame, eligible: DataFrame) -> DataFrame:
    """arm, queries, the mean of each metric over eligible queries that have it, and the pooled unscored share."""
    fit = metrics.join(eligible.where("reason is null").select("arm", "query"), ["arm", "query"])
    means = fit.groupBy("arm").agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in ("pairwise_accuracy", "top1_margin", "topk_mean", "rating_mean")))
    pooled = eligible.where("reason is null").groupBy("arm").agg(ratio(F.sum(F.col("rated") - F.col("scored")), F.sum("rated")).alias("unscored_share"))
    return means.join(pooled, "arm")


def paired_lifts(metrics: DataFrame, metric: str) -> DataFrame:
    """a, b, query and a's metric minus b's, for each ordered pair of arms and query that both have it for."""
    own = metrics.where(F.col(metric).isNotNull()).select("arm", "query", metric)
    left, right = own.select(F.col("arm").alias("a"), "query", F.col(metric).alias("x")), own.select(F.col("arm").alias("b"), "query", F.col(metric).alias("y"))
    return left.join(right, "query").where("a <> b").select("a", "b", "query", (F.col("x") - F.col("y")).alias("lift"))


def agreement(ratings: DataFrame) -> DataFrame:
    """evaluator, n, mean absolute deviation and exact share against the others' first ratings of the same items."""
    first = first_ratings(ratings)
    # per item and value counts stand for all ordered pairs; no pair of evaluators is made
    values = first.groupBy("query", "item", "rating").agg(F.count("*").alias("n"))
    table = values.groupBy("query", "item").agg(F.collect_list(F.struct("rating", "n")).alias("values"), F.sum("n").alias("raters"))
    joined = first.join(table, ["query", "item"]).where("raters >= 2")
    away = F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + F.abs(v["rating"] - F.col("rating")) * v["n"])
    same = F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + F.when(v["rating"] == F.col("rating"), v["n"] - 1).otherwise(0))
    rows = joined.select("evaluator", away.alias("away"), same.alias("same"), (F.col("raters") - 1).alias("others"))
    return rows.groupBy("evaluator").agg(F.sum("others").alias("n"), ratio(F.sum("away"), F.sum("others")).alias("mean_deviation"), ratio(F.sum("same"), F.sum("others")).alias("exact_share"))


def left_out_medians(ratings: DataFrame) -> DataFrame:
    """left_out, query, item, rating and raters: the median without each evaluator, of the items that this evaluator has rated.

    Items that an evaluator has not rated keep their median over all, so every
    evaluator is left out with one row for each rating.
    """
    first = first_ratings(ratings)
    values = first.groupBy("query", "item", "rating").agg(F.count("*").alias("n"))
    table = values.groupBy("query", "item").agg(F.sort_array(F.collect_list(F.struct("rating", "n"))).alias("values"), F.sum("n").alias("all"))
    others = F.transform("values", lambda v: F.struct(v["rating"].alias("rating"), (v["n"] - F.when(v["rating"] == F.col("own"), 1).otherwise(0)).alias("n")))
    joined = first.withColumnRenamed("rating", "own").join(table, ["query", "item"]).where("all > 2 and evaluator is not null").withColumn("others", others).withColumn("raters", F.col("all") - 1)
    # the lower of the middle two: the first value up to which half of the raters are counted
    upto = F.transform("others", lambda v, k: F.struct(v["rating"].alias("rating"), F.aggregate(F.slice("others", 1, k + 1), F.lit(0).cast("long"), lambda a, o: a + o["n"]).alias("upto")))
    middle = F.filter(upto, lambda v: v["upto"] * 2 >= F.col("raters"))[0]["rating"]
    return joined.select(F.col("evaluator").alias("left_out"), "query", "item", middle.cast("int").alias("rating"), "raters")


def left_out_means(ratings: DataFrame) -> DataFrame:
    """left_out and mean, over all items, of the medians without each evaluator; no row where no item is left."""
    first, rated = first_ratings(ratings), item_medians(ratings)
    total = rated.agg(F.coalesce(F.sum("rating"), F.lit(0)).alias("total"), F.count("*").alias("items"))
    own = first.where("evaluator is not null").select("query", "item", F.col("evaluator").alias("left_out")).join(rated, ["query", "item"], "left")
    was = own.groupBy("left_out").agg(F.coalesce(F.sum("rating"), F.lit(0)).alias("was"), F.count("rating").alias("n_was"))
    now = left_out_medians(ratings).groupBy("left_out").agg(F.sum("rating").alias("now"), F.count("*").alias("n_now"))
    rows = was.join(now, "left_out", "left").crossJoin(F.broadcast(total)).withColumn("n", F.col("items") - F.col("n_was") + F.coalesce("n_now", F.lit(0)))
    return rows.where("n > 0").select("left_out", ratio(F.col("total") - F.col("was") + F.coalesce("now", F.lit(0)), F.col("n")).alias("mean"))


def identical_orders(orders: DataFrame) -> DataFrame:
    """arm, queries in which another arm has the very same order; both arms are credited."""
    lists = orders.groupBy("arm", "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "item"))), lambda x: x["item"]).alias("items"))
    keyed = lists.select("arm", "query", F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), 256).alias("order"))
    shared = keyed.groupBy("query", "order").agg(F.collect_set("arm").alias("arms")).where(F.size("arms") > 1)
    return shared.select("query", F.explode("arms").alias("arm")).groupBy("arm").agg(F.count("*").alias("queries"))


def latencies(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, p50 and p95, by linear interpolation."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"))


def recall_curve(positions: DataFrame, positives: DataFrame) -> DataFrame:
    """size, found, positives and recall for each size of CURVE, added up over queries with positives among what was supplied.

    positions: query, item, position of what was supplied; positives: query, item.
    """
    hits = positions.join(positives.select("query", "item").distinct(), ["query", "item"])
    sums = hits.agg(F.count("*").alias("positives"), *(F.count_if(F.col("position") <= k).alias(f"at_{k}") for k in CURVE))
    rows = F.array(*(F.struct(F.lit(k).alias("size"), F.col(f"at_{k}").alias("found"), F.col("positives")) for k in CURVE))
    return sums.select(F.explode(rows).alias("r")).select("r.size", "r.found", "r.positives", ratio(F.col("r.found"), F.col("r.positives")).alias("recall"))


def misses(positives: DataFrame, returned: DataFrame, supplied: DataFrame, library: DataFrame) -> DataFrame:
    """query, item and why a positive is not in the shortlist: cut, filter_excluded or missing_from_library."""
    left = positives.join(returned.select("query", "item"), ["query", "item"], "left_anti")
    joined = left.join(supplied.select("query", "item", F.lit(True).alias("was_supplied")), ["query", "item"], "left").join(library.select("item", F.lit(True).alias("known")).distinct(), "item", "left")
    why = F.when(F.col("known").isNull(), "missing_from_library").when(F.col("was_supplied").isNull(), "filter_excluded").otherwise("cut")
    return joined.select("query", "item", why.alias("why"))


def verdict(value: Column, low: Column, high: Column, minimum: float, met: Column, unsure: Column | None = None) -> Column:
    """supported, not supported, inconclusive or insufficient.

    Without the evidence, a value or an interval: insufficient; if something
    else makes the gate unsure: inconclusive; supported if the value reaches the
    minimum and the interval lies above 0; not supported if the whole interval
    is below the minimum.
    """
    unsure = F.lit(False) if unsure is None else F.coalesce(unsure, F.lit(False))
    return (
        F.when(~F.coalesce(met, F.lit(False)) | value.isNull() | low.isNull(), "insufficient")
        .when(unsure, "inconclusive")
        .when((value >= minimum) & (low > 0), "supported")
        .when(high < minimum, "not supported")
        .otherwise("inconclusive")
    )


def point_class(value: Column, minimum: Column) -> Column:
    """On which side of a minimum a point estimate is."""
    return F.when(value.isNull(), "absent").when(value >= minimum, "meets_minimum").otherwise("below_minimum")


def flipped(points: DataFrame, left_out: DataFrame) -> DataFrame:
    """gate, left_out: the evaluators without whom a gate's point changes sides.

    points: gate, minimum, value over all ratings; left_out: gate, left_out, value without one evaluator.
    """
    both = left_out.select("gate", "left_out", F.col("value").alias("_without")).join(points, "gate")
    return both.where(point_class(F.col("_without"), F.col("minimum")) != point_class(F.col("value"), F.col("minimum"))).select("gate", "left_out")


def bootstrap_means(values: DataFrame, by: list[str], seed: str, resamples: int = 10_000, order: str = "query", most: int = 1 << 20) -> DataFrame:
    """by, n, mean, low and high: a 95 % percentile interval of the mean under seeded resampling of a group's values.

    values: by, order and value, a row for each query; null values don't count.
    Resample k draws n values, with replacement, from the group's list in the
    order of the column order, by seeded_twister(seed, group, k).  Resamples are
    dealt out, a task for each batch of them; each has the group's list, since a
    draw may be any value.  A list of more than most values is an error.
    """
    groups = values.where("value is not null").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "value"))).alias("rows"), F.avg("value").alias("mean"), F.count("*").alias("n"))
    fits = F.when(F.col("n") > most, F.raise_error(F.concat(F.lit("a bootstrap over more values than "), F.lit(most)))).otherwise(F.transform("rows", lambda x: x["value"].cast("double")))
    lists = groups.select(*by, "n", "mean", fits.alias("rows"))

    @F.pandas_udf("array<double>")
    def draws(name: pd.Series, rows: pd.Series, batch: pd.Series) -> pd.Series:
        out = []
        for key, x, first in zip(name, rows, batch, strict=True):
            found = []
            for k in range(first, min(first + _RESAMPLES, resamples)):
                pick, total = seeded_twister(seed, key, k).randrange, 0.0
                for _ in range(len(x)):
                    total += x[pick(len(x))]
                found.append(total / len(x))
            out.append(found)
        return pd.Series(out)

    batches = lists.select(*by, "rows", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(_RESAMPLES))).alias("batch"))
    dealt = batches.repartition(*by, "batch")
    means = dealt.select(*by, F.explode(draws(F.concat_ws("|", *by), "rows", "batch")).alias("m")).groupBy(*by).agg(F.percentile("m", [0.025, 0.975]).alias("ends"))
    return lists.drop("rows").join(means, by).select(*by, "n", "mean", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))


def counts_by_session(answers: DataFrame, planned: int) -> DataFrame:
    """session_id, answered, skipped, recognised, failed, and next_index, the least index of the plan without an answer: null where all are."""
    index = F.col("presentation_index")
    done = F.collect_set(F.when(index.between(0, planned - 1), index.cast("long")))  # planned values at most
    counts = answers.groupBy("session_id").agg(F.count_if(~F.col("skipped")).alias("answered"), F.count_if("skipped").alias("skipped"), F.count_if("recognised").alias("recognised"), F.count_if(~F.col("completed")).alias("failed"), done.alias("done"))
    plan = F.array(*(F.lit(k).cast("long") for k in range(planned)))
    return counts.withColumn("next_index", F.array_min(F.array_except(plan, "done"))).drop("done")


def effective_answers(answers: DataFrame) -> DataFrame:
    """The last record of each presentation of a session; corrections replace what they correct."""
    rest = F.struct(*[c for c in answers.columns if c not in ("session_id", "presentation_index")])
    told = answers.where("presentation_index IS NOT NULL")
    return told.groupBy("session_id", "presentation_index").agg(F.max_by(rest, "seq").alias("v")).select("session_id", "presentation_index", "v.*")


def session_verdicts(answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, planned, effective, recognised, counted and reason of each session (session_id, planned, monitoring).

    A session that tries the tools doesn't count, nor one whose evaluator
    recognised more than the allowed share of the presentations planned.
    """
    found = effective_answers(answers).groupBy("session_id").agg(F.count("*").alias("effective"), F.count_if("recognised").alias("recognised"))
    joined = sessions.select("session_id", "planned", "monitoring").join(found, "session_id", "left").na.fill(0, ["effective", "recognised"])
    share = ratio(F.col("recognised"), F.col("planned"))
    reason = F.when(F.coalesce(F.col("monitoring").startswith(TOOLING), F.lit(False)), "tooling_session").when(share > RECOGNISED_MOST, "recognised_rate_above_maximum")
    return joined.select("session_id", "planned", "effective", "recognised", reason.isNull().alias("counted"), reason.alias("reason"))


def valid_ratings(answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, seq, pair_id, rating of what counts: effective, not recognised nor skipped, played to the end, with a label, in a session that counts."""
    good = session_verdicts(answers, sessions).where("counted").select("session_id")
    scores = F.create_map(*(F.lit(x) for pair in RATING_LABELS.items() for x in pair))
    kept = effective_answers(answers).where("NOT coalesce(recognised, false) AND skipped = false AND completed AND pair_id IS NOT NULL").withColumn("rating", scores[F.col("label")])
    return kept.where("rating IS NOT NULL").join(good, "session_id").select("session_id", "seq", "pair_id", "rating")


def repeated_elsewhere(answers: DataFrame) -> DataFrame:
    """evaluator and pair_id that were answered in more than one session."""
    return answers.groupBy("evaluator", "pair_id").agg(F.count_distinct("session_id").alias("sessions")).where("sessions > 1")


def recall_reference(pairs: DataFrame, ratings: DataFrame, positive: tuple[str, ...] = ("good", "excellent")) -> DataFrame:
    """query, declared, positive: of each kick the basses that it was paired with, and those that enough evaluators found good.

    pairs: pair_id, kick, bass; ratings: pair_id, evaluator_id, session_id,
    place, label, skipped.  Skipped and unlabelled ratings, and those of pairs
    that the list doesn't have, say nothing; of an evaluator's ratings of a pair
    the first stands.  No ranking is read.
    """
    scores = F.create_map(*(F.lit(x) for pair in RATING_LABELS.items() for x in pair))
    told = ratings.where("NOT skipped").withColumn("rating", scores[F.col("label")]).where("rating IS NOT NULL")
    known = told.join(pairs.select("pair_id").distinct(), "pair_id", "left_semi")
    seen = known.select(F.col("pair_id").alias("query"), F.lit(0).alias("item"), F.col("evaluator_id").alias("evaluator"), F.col("rating").cast("int").alias("rating"), F.struct("session_id", "place").alias("seq"))
    liked = item_medians(seen, RATED_LEAST).where(F.col("rating").isin(*(int(RATING_LABELS[n]) for n in positive))).select(F.col("query").alias("pair_id"), F.lit(True).alias("liked"))
    # a kick and a bass that several pairs name are judged by the last of them
    one = pairs.groupBy("kick", "bass").agg(F.max("pair_id").alias("pair_id")).join(liked, "pair_id", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("liked"), F.col("bass"))))
    return one.groupBy(F.col("kick").alias("query")).agg(F.array_sort(F.collect_list("bass")).alias("declared"), found.alias("positive"))


# The arms that need outcomes of a live service, the source of such outcomes, and why an arm isn't evaluated.
LIVE_ARMS, LIVE = ("jev-only", "hybrid"), "interface"
NO_QUERY, NO_ANALYSES, NO_LIVE, FELL_BACK, NOT_ELIGIBLE = "no_held_out_query", "no_analysis_manifests", "no_live_jev_outcomes", "hybrid_fell_back_to_dsp", "no_eligible_query"


def evidence_sources(outcomes: DataFrame) -> DataFrame:
    """run, live (outcomes of a live source) and evidence (live or none). outcomes: run, source; the one that prevails for each request."""
    live = F.count_if(F.coalesce(F.col("source") == LIVE, F.lit(False)))
    return outcomes.groupBy("run").agg(live.alias("live")).withColumn("evidence", F.when(F.col("live") > 0, "live").otherwise("none"))


def arm_status(arms: DataFrame) -> DataFrame:
    """arms with status (evaluated, insufficient) and the first reason of an insufficient one.

    arms: arm, queries, analyses (whether manifests are there), evidence,
    scored and hybrid_scored (a mode's count of scored candidates), eligible_queries.
    """
    reason = (
        F.when(F.coalesce("queries", F.lit(0)) == 0, NO_QUERY)
        .when(~F.coalesce("analyses", F.lit(False)), NO_ANALYSES)
        .when(F.col("arm").isin(*LIVE_ARMS) & (F.coalesce("evidence", F.lit("none")) != "live"), NO_LIVE)
        .when((F.col("arm") == "hybrid") & (F.coalesce("scored", F.lit(0)) > 0) & (F.coalesce("hybrid_scored", F.lit(0)) == 0), FELL_BACK)
        .when(F.coalesce("eligible_queries", F.lit(0)) == 0, NOT_ELIGIBLE)
    )
    return arms.withColumns({"status": F.when(reason.isNull(), "evaluated").otherwise("insufficient"), "status_reason": reason})
