"""Registered queries of evaluation, each with SQL that states the same rules anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.operators import evaluation as ev
from timbral.operators import preflight
from timbral.sources import json_files, views
from timbral.sources.views import RATINGS_CTE, read


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return views.ratings(spark, d)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Three arms over the rated items; one leaves items without a score."""
    base = _ratings(spark, d).groupBy("query", "item").agg(F.round(F.avg("price"), 6).alias("p"), F.round(F.avg("discount"), 6).alias("q"))
    arms = F.array(
        F.struct(F.lit("price").alias("arm"), F.col("p").alias("score")),
        F.struct(F.lit("discount").alias("arm"), F.when(F.col("item") % 3 != 0, F.col("q")).alias("score")),
        F.struct(F.lit("copy").alias("arm"), F.when(F.col("query") % 2 == 0, F.col("p")).otherwise(F.col("q")).alias("score")),
    )
    return base.select("query", "item", F.explode(arms).alias("a")).select("a.arm", "query", "item", "a.score")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return ev.arm_orders(_scores(spark, d))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return ev.query_metrics(_orders(spark, d), ev.item_medians(_ratings(spark, d)))


def medians(spark: SparkSession, d: str) -> DataFrame:
    return ev.item_medians(_ratings(spark, d))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("arm", "query", "item", "position")


def _rounded(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


MEANS = ("pairwise_accuracy", "top1_margin", "topk_mean", "rating_mean")


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_metrics(spark, d), MEANS)


def eligibility(spark: SparkSession, d: str) -> DataFrame:
    """All arms and queries; one in 23 failed in its filter, and one in 19 has no candidate left."""
    asked = spark.range(300).select(F.col("id").alias("query"), F.when(F.col("id") % 23 == 1, "unknown_role").alias("filter_error"))
    return ev.eligibility(_orders(spark, d).where("query % 19 <> 2"), ev.item_medians(_ratings(spark, d), 3), asked)


def summary(spark: SparkSession, d: str) -> DataFrame:
    rated = ev.item_medians(_ratings(spark, d))
    found = ev.arm_summary(ev.query_metrics(_orders(spark, d), rated), ev.eligibility(_orders(spark, d), rated))
    return _rounded(found, (*MEANS, "unscored_share"))


def lifts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.paired_lifts(_metrics(spark, d), "topk_mean"), ("lift",))


def agreement(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.agreement(_ratings(spark, d)), ("mean_deviation", "exact_share"))


def each_left_out(spark: SparkSession, d: str) -> DataFrame:
    return ev.left_out_medians(_ratings(spark, d))


def identical(spark: SparkSession, d: str) -> DataFrame:
    return ev.identical_orders(_orders(spark, d))


def latencies(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return _rounded(ev.latencies(e, ["event_type"], "value"), ("p50", "p95"))


def recall(spark: SparkSession, d: str) -> DataFrame:
    placed = _orders(spark, d).where("arm = 'price'")
    positive = ev.item_medians(_ratings(spark, d)).where("rating >= 2").select("query", "item")
    return _rounded(ev.recall_curve(placed, positive), ("recall",))


def misses(spark: SparkSession, d: str) -> DataFrame:
    placed = _orders(spark, d).where("arm = 'price'")
    supplied = placed.where("item % 7 <> 0")
    returned = supplied.where("position <= 10")
    known = spark.range(18).withColumnRenamed("id", "item")
    return ev.misses(ev.item_medians(_ratings(spark, d)).where("rating >= 2").select("query", "item"), returned, supplied, known).groupBy("why").agg(F.count("*").alias("n"))


GATES = {"topk_mean": (0.5, 1.5, 1.7), "top1_margin": (-0.5, 0.02, 0.5)}


def _gates(metric: str) -> F.Column:
    return F.array(*(F.lit(g) for g in GATES[metric]))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each arm's metrics against gates: the mean, an interval of the queries' own percentiles, and evidence from 250 queries on."""
    rows = []
    for metric in GATES:
        stats = _metrics(spark, d).groupBy("arm").agg(F.count(metric).alias("n"), F.round(F.avg(metric), 9).alias("value"), *(F.round(F.percentile(metric, q), 9).alias(name) for name, q in (("low", 0.3), ("high", 0.7))))
        rows.append(stats.select("arm", F.lit(metric).alias("metric"), "n", "value", "low", "high", F.explode(_gates(metric)).alias("minimum")))
    every = rows[0].unionByName(rows[1])
    unsure = (F.col("arm") == "copy") & (F.col("minimum") < 0)
    gate = lambda met: ev.verdict(F.col("value"), F.col("low"), F.col("high"), F.col("minimum"), met, unsure)
    return every.select("arm", "metric", "minimum", gate(F.col("n") >= 250).alias("verdict"), gate(F.col("n") >= 100_000).alias("too_few"))


def bootstrap_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The same gates with the bootstrap's intervals."""
    found = bootstrap(spark, d).select("arm", "n", "mean", "low", "high", F.explode(_gates("topk_mean")).alias("minimum"))
    return found.select("arm", "minimum", ev.verdict(F.col("mean"), F.col("low"), F.col("high"), F.col("minimum"), F.col("n") >= 250).alias("verdict"))


def all_flipped(spark: SparkSession, d: str) -> DataFrame:
    """Evaluators without whom the mean of all medians changes sides of a gate; one gate is that mean itself."""
    mean = ev.item_medians(_ratings(spark, d)).agg(F.avg("rating").alias("value"))
    names = {"half": F.lit(0.5), "one": F.lit(1.0), "mean": F.col("value"), "two": F.lit(2.0)}
    points = mean.select("value", F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), m.alias("minimum")) for g, m in names.items()))).alias("g")).select("g.gate", "g.minimum", "value")
    out = ev.left_out_means(_ratings(spark, d)).select("left_out", F.col("mean").alias("value"), F.explode(F.array(*(F.lit(g) for g in names))).alias("gate"))
    return ev.flipped(points, out)


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return ev.bootstrap_means(_metrics(spark, d).select("arm", "query", F.col("topk_mean").alias("value")), ["arm"], "seed-1")


def each_session(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    answers = e.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 60).alias("presentation_index"), (F.col("event_type") == "view").alias("skipped"), (F.col("event_type") == "click").alias("recognised"), (F.col("event_type") != "error").alias("completed"))
    return ev.counts_by_session(answers, 60)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        F.col("user_id").alias("session_id"), (F.col("user_id") % 10).alias("evaluator"), (F.col("event_id") % 400).alias("pair_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("skipped"), (F.col("event_type") == "click").alias("recognised"),
        (F.col("event_type") != "error").alias("completed"), F.when(F.col("event_id") % 13 > 0, F.col("event_type")).alias("label"),
    )


LABELS = ("poor", "acceptable", "good", "excellent", "great")


def _rated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records of sessions of up to 40 presentations, some corrected later, and the sessions: some try the tools."""
    e = read(spark, d, "events")
    label = F.element_at(F.array(*(F.lit(x) for x in LABELS)), (F.col("event_id") % 5 + 1).cast("int"))
    answers = e.select(
        F.col("user_id").alias("session_id"), (F.col("event_id") % 40).alias("presentation_index"), F.col("event_id").alias("seq"), F.concat(F.lit("p"), F.col("event_id") % 400).alias("pair_id"), (F.col("event_type") == "view").alias("skipped"), ((F.col("event_type") == "error") & (F.col("user_id") % 3 > 0)).alias("recognised"),
        (F.col("event_type") != "signup").alias("completed"), F.when(F.col("event_id") % 13 > 0, label).alias("label"),
    )
    sessions = e.select("user_id").distinct().select(F.col("user_id").alias("session_id"), F.lit(40).alias("planned"), F.when(F.col("user_id") % 11 == 0, "dry-run of the desk").when(F.col("user_id") % 11 != 1, "headphones").alias("monitoring"))
    return answers, sessions


def valid(spark: SparkSession, d: str) -> DataFrame:
    return ev.valid_ratings(*_rated(spark, d))


def session_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return ev.session_verdicts(*_rated(spark, d))


def elsewhere(spark: SparkSession, d: str) -> DataFrame:
    return ev.repeated_elsewhere(_answers(spark, d))


def last_answers(spark: SparkSession, d: str) -> DataFrame:
    return ev.last_answers(_answers(spark, d).select("session_id", "pair_id", "seq", "label"), ["session_id", "pair_id"], "seq")


PROTOCOL = "protocol-1"


def _inputs(spark: SparkSession, d: str) -> preflight.Inputs:
    """Forty runs over the orders; run 1 to 24 each have one fault of their inputs."""
    runs = spark.range(40).withColumnRenamed("id", "run")
    r = F.col("run")
    name = F.explode(F.array(*(F.lit(x) for x in (*preflight.SINGLE, "analysis_manifest", "analysis_manifest")))).alias("name")
    at = lambda **faults: reduce(lambda a, b: a | b, ((F.col("name") == k) & (r == v) for k, v in faults.items()))
    gone = at(protocol=1, split_manifest=3, pair_list=5, assignment=10, analysis_manifest=18, dataset=23)
    bad = at(split_manifest=4, pair_list=6, assignment=11, analysis_manifest=17, dataset=22)
    documents = runs.select("run", name).select("run", "name", (~gone).alias("present"), F.when(bad, "schema_mismatch").alias("problem"), F.when(F.col("name") == "protocol", F.when(r == 2, "protocol-0").otherwise(PROTOCOL)).alias("version"), F.concat(F.lit("sha256:"), (r + F.when((F.col("name") == "pair_list") & (r == 7), 1).otherwise(0)).cast("string")).alias("digest"))
    key = F.col("o_orderkey")
    o = read(spark, d, "orders").select((F.col("o_custkey") % 40).alias("run"), key.alias("pair_id"), F.concat(F.lit("k"), key % 97).alias("kick"), F.concat(F.lit("b"), key % 89).alias("bass"), "o_custkey").where(~r.isin(5, 6) & ~((r == 13) & (key % 50 > 0)))
    pairs = o.select("run", F.col("pair_id").alias("place"), "pair_id", "kick", "bass")
    samples = spark.range(97).select(F.concat(F.lit("k"), "id").alias("sample_id"), F.lit("kick").alias("role"), "id").unionByName(spark.range(89).select(F.concat(F.lit("b"), "id").alias("sample_id"), F.when(F.col("id") % 2 == 0, "bass").otherwise("sub-bass").alias("role"), "id"))
    every = samples.crossJoin(F.broadcast(runs))
    selected = every.where(~r.isin(22, 23) & ~((r == 8) & (F.col("sample_id") == "k5"))).select("run", F.col("id").alias("place"), "sample_id", "role", F.when((r == 24) & (F.col("id") < 3), "synthetic").otherwise("real_library_sample").alias("provenance"))
    reserves = runs.select("run", F.lit("r1").alias("sample_id"))
    members = every.where(~((r == 9) & (F.col("sample_id") == "b7")) & ~r.isin(3, 4)).select("run", F.lit("held_out").alias("partition"), "sample_id")
    raters = F.explode(F.array(F.lit("e1"), F.lit("e2"))).alias("evaluator")
    assignments = pairs.where(~r.isin(10, 11) & ~((r == 12) & (F.col("pair_id") % 40 == 3))).select("run", "pair_id", raters)
    sessions = runs.where("run <> 15").select("run", F.explode(F.array(*(F.lit(k) for k in range(5)))).alias("session_id")).select("run", "session_id", F.concat(F.lit("e"), F.col("session_id") + 1).alias("evaluator"), (F.col("session_id") < 4).alias("valid"), (F.col("session_id") < 3).alias("counted"), (F.col("session_id") == 3).alias("tooling"), F.col("session_id").alias("recognised"), ((r == 14) & (F.col("session_id") == 4)).alias("public"))
    rated = o.select("run", "pair_id", "o_custkey", F.explode(F.array(*(F.lit(k) for k in range(5)))).alias("session_id")).where("(pair_id + session_id * 3) % 4 > 1 AND run <> 15")
    ratings = rated.select("run", "session_id", F.concat(F.lit("e"), F.col("session_id") + 1).alias("evaluator"), F.when((r == 16) & (F.col("pair_id") % 100 == 2), -F.col("pair_id")).otherwise(F.col("pair_id")).alias("pair_id"))
    twice = F.explode(F.array(F.lit(0), F.lit(1))).alias("again")
    entries = every.where(~r.isin(17, 18) & ~((r == 19) & (F.col("sample_id") == "b11"))).select("run", "sample_id", "id", twice).where("again = 0 OR id % 10 = 0").select("run", (F.col("id") * 2 + F.col("again")).alias("place"), "sample_id", F.when((F.col("id") % 10 == 0) & (F.col("again") == 0), "error").otherwise("complete").alias("status"), F.when((r == 21) & (F.col("id") == 4), "v2").otherwise("v1").alias("version"), F.lit(True).alias("whole"))
    queries = pairs.select("run", F.col("kick").alias("query")).distinct().withColumn("eligible", F.substring("query", 2, 9).cast("int") % 5 > 0)
    return preflight.Inputs(documents, pairs, selected, reserves, members, assignments, sessions, ratings, entries, queries)


def preflight_findings(spark: SparkSession, d: str) -> DataFrame:
    return preflight.findings(preflight.summary(_inputs(spark, d)), PROTOCOL)


def accounting(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(preflight.accounting(preflight.summary(_inputs(spark, d))), ("pair_coverage",))


def pool(spark: SparkSession, d: str) -> DataFrame:
    i = _inputs(spark, d)
    return preflight.pool_counts(i.selected, i.reserves).withColumn("provenance", F.to_json("provenance"))


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A pair list and exports of ratings as JSON texts, made of the orders and lineitems; every customer's list, every supplier's export."""
    o = read(spark, d, "orders")
    entry = F.struct(F.concat(F.lit("p-"), "o_orderkey").alias("pair_id"), F.concat(F.lit("k-"), F.col("o_custkey") % 30).alias("kick_sample_id"), F.concat(F.lit("b-"), F.col("o_orderkey") % 23).alias("bass_sample_id"))
    kind = F.col("o_custkey") % 12
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("pairs"))
    rows = lists.select("o_custkey", F.to_json("pairs").alias("p"), kind.alias("kind"))
    digest = F.when(F.col("kind") == 3, "sha256:12").otherwise(F.concat(F.lit("sha256:"), F.lit("0" * 64)))
    told = F.concat(
        F.lit('{"schema_version":'), F.when(F.col("kind") == 1, F.lit("1.0")).otherwise(F.lit('"1.0"')), F.lit(',"dataset_version":"'), F.when(F.col("kind") == 2, " ").otherwise("v1"), F.lit('","split_manifest_digest":"'), digest,
        F.lit('","sampler_seed":"s","assignment_seed":'), F.when(F.col("kind") == 4, "null").otherwise('"a"'), F.lit(',"pairs":'), F.when(F.col("kind") == 5, "[]").when(F.col("kind") == 6, '[{"pair_id":"p"}]').when(F.col("kind") == 7, '[{"pair_id":"p","kick_sample_id":"","bass_sample_id":"b"}]').otherwise(F.col("p")),
        F.when(F.col("kind") == 8, F.lit(',"more":1}')).when(F.col("kind") == 9, F.lit(',"pairs":[]}')).when(F.col("kind") == 10, F.lit("")).otherwise(F.lit("}")),
    )
    documents = rows.select(F.col("o_custkey").alias("name"), told.alias("document"))
    li = read(spark, d, "lineitem")
    label = F.element_at(F.array(*(F.lit(x) for x in ("poor", "acceptable", "good", "excellent"))), (F.col("l_quantity").cast("int") % 4 + 1).cast("int"))
    rating = F.struct(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("presentation_index"), F.concat(F.lit("p-"), "l_orderkey").alias("pair_id"), F.lit("k").alias("kick_sample_id"), F.lit("b").alias("bass_sample_id"), F.when(F.col("l_linenumber") != 4, label).alias("rating"), (F.col("l_linenumber") == 5).alias("skip"),
        F.lit(None).cast("string").alias("skip_reason"), F.lit(False).alias("recognised"), F.lit(True).alias("playback_completed"), F.lit("t").alias("responded_at"), F.lit(None).cast("string").alias("correction_of"),
    )
    session = F.struct(F.concat(F.lit("s-"), "l_suppkey").alias("session_id"), F.concat(F.lit("e-"), F.col("l_suppkey") % 25).alias("evaluator_id"))
    each = li.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(rating)).alias("ratings"))
    version = F.when(F.col("l_suppkey") % 20 == 7, "0.9").otherwise("1.0")
    exports = each.select(F.col("l_suppkey").alias("name"), F.to_json(F.struct(version.alias("schema_version"), session.alias("session"), "ratings"), {"ignoreNullFields": "false"}).alias("document"))
    return documents, exports


def list_problems(spark: SparkSession, d: str) -> DataFrame:
    documents, exports = _lists(spark, d)
    lists = documents.select(F.lit("pair_list").alias("kind"), "name", json_files.pair_list_problem(F.col("document")).alias("problem"))
    return lists.unionByName(exports.select(F.lit("export").alias("kind"), "name", json_files.export_problem(F.col("document")).alias("problem")))


def _reference(spark: SparkSession, d: str) -> DataFrame:
    documents, exports = _lists(spark, d)
    return ev.recall_reference(json_files.pairs_of(documents), json_files.ratings_of(exports))


def recall_reference(spark: SparkSession, d: str) -> DataFrame:
    return _reference(spark, d).select("query", F.array_join("declared", ",").alias("declared"), F.array_join("positive", ",").alias("positive"))


def reference_curve(spark: SparkSession, d: str) -> DataFrame:
    """The recall of an order of the declared basses against the reference's positives."""
    found = _reference(spark, d)
    placed = found.select("query", F.posexplode("declared").alias("at", "item")).select("query", "item", (F.col("at") + 1).alias("position"))
    return _rounded(ev.recall_curve(placed, found.select("query", F.explode("positive").alias("item"))), ("recall",))


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    """Split manifests and assignments of each customer as JSON texts, under each of the names and forms; some malformed."""
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.array_sort(F.collect_list(F.concat(F.lit("s"), "o_orderkey"))).alias("ids"))
    k = F.col("name") % 8
    text = F.to_json("ids")
    held = F.concat(F.lit('{"kicks":'), text, F.when(k == 1, ',"basses":').when(k == 2, ',"low":').otherwise(',"bass":'), F.when(k == 3, '[""]').otherwise("[]"), F.lit("}"))
    split = F.concat(F.lit('{"'), F.when(k == 4, "held-out").when(k == 5, "heldout").when(k == 6, "kept").otherwise("held_out"), F.lit('":'), held, F.lit(',"tune":{"kicks":["t1"],"bass":3}}'))
    pairs = F.array_join(F.transform("ids", lambda i: F.when(k % 2 == 0, F.concat(F.lit('"'), i, F.lit('":["e1","e2"]'))).otherwise(F.concat(F.lit('{"pair_id":"'), i, F.lit('","evaluators":["e1","e2"]}')))), ",")
    assigned = F.concat(F.lit('{"assignments":'), F.when(k == 7, "null").when(k % 2 == 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(F.concat(F.lit("["), pairs, F.when(k == 5, ',{"pair_id":"x"}').when(k == 3, ',{"pair_id":"s-last","evaluators":["e3"]},{"pair_id":"s-last","evaluators":["e4"]}').otherwise(""), F.lit("]"))), F.lit("}"))
    return o.select("name", split.alias("split"), assigned.alias("assigned"))


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    m = _manifests(spark, d)
    splits = json_files.split_rows(m.select("name", F.col("split").alias("document"))).select("name", F.concat_ws("/", "partition", "role").alias("part"), "sample_id")
    assigned = json_files.assignment_rows(m.select("name", F.col("assigned").alias("document"))).select("name", "evaluator", "pair_id")
    return splits.unionByName(assigned.select("name", F.col("evaluator").alias("part"), F.col("pair_id").alias("sample_id")))


def arm_statuses(spark: SparkSession, d: str) -> DataFrame:
    """The four arms of each customer's run, whose outcomes are its orders."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.when(F.col("o_orderkey") % 5 == 0, "interface").when(F.col("o_orderkey") % 5 < 4, "double").alias("source"))
    k = F.col("run")
    runs = ev.evidence_sources(o).select("run", "evidence", "live", (k % 7).alias("queries"), (k % 5 > 0).alias("analyses"), (k % 6).alias("scored"), (k % 4).alias("hybrid_scored"), (k % 3).alias("eligible_queries"))
    arms = runs.withColumn("arm", F.explode(F.array(*(F.lit(a) for a in ("random", "dsp-only", "jev-only", "hybrid")))))
    return ev.arm_status(arms).select("run", "arm", "live", "status", "status_reason")


def entry_problems(spark: SparkSession, d: str) -> DataFrame:
    """Entries of manifests made of lineitems: repeated samples, unfinished ones, some that can't be read."""
    rows = read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), F.col("l_partkey").alias("sample_id"), F.when(F.col("l_linenumber") == 3, "pending").otherwise("complete").alias("status"), F.lit("v1").alias("version"), (F.col("l_quantity") > 10).alias("whole"), F.col("l_extendedprice").alias("price"))
    found = preflight.analysis_entries(rows)
    return found.groupBy("run", "problem").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("samples"), F.sum("place").alias("places"))


_REFERENCE_SQL = """op AS (SELECT 'p-' || o_orderkey AS pair_id, 'k-' || o_custkey % 30 AS kick, 'b-' || o_orderkey % 23 AS bass FROM orders WHERE o_custkey % 12 IN (0, 11)),
orr AS (SELECT 'p-' || l_orderkey AS pair_id, 'e-' || l_suppkey % 25 AS evaluator, CAST(l_quantity AS INTEGER) % 4 AS rating, 's-' || l_suppkey AS session_id, l_orderkey * 10 + l_linenumber AS place FROM lineitem WHERE l_linenumber NOT IN (4, 5) AND l_suppkey % 20 <> 7),
fr AS (SELECT pair_id, evaluator, arg_min(rating, (session_id, place, (['poor', 'acceptable', 'good', 'excellent'])[rating + 1])) AS rating FROM orr WHERE pair_id IN (SELECT pair_id FROM op) GROUP BY ALL), md AS (SELECT pair_id, quantile_disc(rating, 0.5) AS rating FROM fr GROUP BY pair_id HAVING count(*) >= 2),
ref AS (SELECT kick AS query, bass, coalesce((SELECT rating >= 2 FROM md WHERE md.pair_id = m.pair_id), false) AS liked FROM (SELECT kick, bass, max(pair_id) AS pair_id FROM op GROUP BY ALL) m)"""
_RUNS_SQL = """rn AS (SELECT range AS run FROM range(40)), o AS (SELECT o_custkey % 40 AS run, o_orderkey AS pair_id, 'k' || o_orderkey % 97 AS kick, 'b' || o_orderkey % 89 AS bass FROM orders WHERE o_custkey % 40 NOT IN (5, 6) AND NOT (o_custkey % 40 = 13 AND o_orderkey % 50 > 0)),
sm AS (SELECT 'k' || i AS sample_id, 'kick' AS role, i FROM range(97) t(i) UNION ALL SELECT 'b' || i, CASE WHEN i % 2 = 0 THEN 'bass' ELSE 'sub-bass' END, i FROM range(89) t(i)),
p AS (SELECT o.*, CASE WHEN run IN (22, 23) OR run = 8 AND kick = 'k5' THEN 'unknown_sample_id' WHEN run IN (3, 4) OR run = 9 AND bass = 'b7' THEN 'pair_not_held_out' END AS wrong, CASE WHEN run IN (10, 11) OR run = 12 AND pair_id % 40 = 3 THEN 0 ELSE 2 END AS assigned FROM o),
bp AS (SELECT run, count(*) AS sampled_pairs, count(DISTINCT kick) AS sampled_queries, count(wrong) AS n_wrong, arg_min(wrong, pair_id) AS code, min(CASE WHEN wrong IS NOT NULL THEN pair_id END) AS wrong_pair,
  count(*) FILTER (WHERE assigned < 2 AND wrong IS DISTINCT FROM 'unknown_sample_id') AS n_short, min(CASE WHEN assigned < 2 AND wrong IS DISTINCT FROM 'unknown_sample_id' THEN pair_id END) AS short_pair FROM p GROUP BY run),
us AS (SELECT DISTINCT run, kick AS sample_id FROM o UNION SELECT DISTINCT run, bass FROM o),
bu AS (SELECT run, count(*) AS used_samples, count(*) FILTER (WHERE run IN (17, 18) OR run = 19 AND sample_id = 'b11') AS missing_analysis_entries, count(*) FILTER (WHERE NOT (run IN (22, 23) OR run = 8 AND sample_id = 'k5')) AS dataset_records,
  count(*) FILTER (WHERE run = 24 AND CAST(sample_id[2:] AS INTEGER) < 3) AS synthetic_fixture_records, count(*) FILTER (WHERE run = 21 AND sample_id[2:] = '4') AS v2 FROM us GROUP BY run),
rt AS (SELECT run, s, CASE WHEN run = 16 AND pair_id % 100 = 2 THEN -pair_id ELSE pair_id END AS pair_id FROM o, range(3) t(s) WHERE (pair_id + s * 3) % 4 > 1 AND run <> 15),
rp AS (SELECT run, pair_id, count(*) AS n, count(DISTINCT s) AS raters FROM rt GROUP BY ALL),
br AS (SELECT run, CAST(sum(n) AS BIGINT) AS valid_ratings, count(*) AS rated, count(*) FILTER (WHERE pair_id < 0) AS unsampled, count(*) FILTER (WHERE raters >= 2) AS rated_pairs, count(*) FILTER (WHERE raters >= 2 AND pair_id >= 0) AS rated_pairs_sampled FROM rp GROUP BY run),
su AS (SELECT rn.run, coalesce(sampled_pairs, 0) AS sampled_pairs, coalesce(sampled_queries, 0) AS sampled_queries, coalesce(n_wrong, 0) AS n_wrong, code, wrong_pair, coalesce(n_short, 0) AS n_short, short_pair, coalesce(used_samples, 0) AS used_samples,
  coalesce(missing_analysis_entries, 0) AS missing_analysis_entries, coalesce(dataset_records, 0) AS dataset_records, coalesce(synthetic_fixture_records, 0) AS synthetic_fixture_records, coalesce(v2, 0) AS v2, coalesce(valid_ratings, 0) AS valid_ratings, coalesce(rated, 0) AS rated,
  coalesce(unsampled, 0) AS unsampled, coalesce(rated_pairs, 0) AS rated_pairs, coalesce(rated_pairs_sampled, 0) AS rated_pairs_sampled FROM rn LEFT JOIN bp USING (run) LEFT JOIN bu USING (run) LEFT JOIN br USING (run))"""
_FINDINGS_SQL = f"""WITH {_RUNS_SQL}, u AS (SELECT *, run NOT IN (3, 4, 5, 6) AS usable FROM su), f AS (
SELECT run, 1 AS nth, 'protocol_document' AS "check", CASE run WHEN 1 THEN 'protocol_document_missing' WHEN 2 THEN 'protocol_version_mismatch' ELSE 'ok' END AS code, CASE run WHEN 1 THEN 'absent' WHEN 2 THEN 'protocol-0' ELSE 'protocol-1' END AS observed, NULL AS detail FROM u
UNION ALL SELECT run, 2, 'split_manifest', CASE run WHEN 3 THEN 'split_manifest_missing' WHEN 4 THEN 'schema_mismatch' ELSE 'ok' END, CASE run WHEN 3 THEN 'absent' WHEN 4 THEN 'present but malformed' ELSE 'sha256:' || run END, NULL FROM u
UNION ALL SELECT run, 3, 'pair_list', CASE run WHEN 5 THEN 'pair_list_missing' WHEN 6 THEN 'schema_mismatch' WHEN 7 THEN 'split_manifest_digest_mismatch' ELSE 'ok' END, CASE run WHEN 5 THEN 'absent' WHEN 6 THEN 'present but malformed' WHEN 7 THEN 'sha256:8' ELSE 'sha256:' || run END, NULL FROM u
UNION ALL SELECT run, 4, 'pair_membership', CASE WHEN run IN (3, 5) THEN 'missing_prerequisite' WHEN usable AND n_wrong > 0 THEN code ELSE 'ok' END, CASE WHEN run IN (3, 5) THEN '0 of 0 pairs checkable' WHEN usable AND n_wrong > 0 THEN n_wrong || ' of ' || sampled_pairs || ' pairs violate it' ELSE sampled_pairs || ' of ' || sampled_pairs || ' pairs held-out' END, CASE WHEN usable AND n_wrong > 0 THEN CAST(wrong_pair AS VARCHAR) END FROM u
UNION ALL SELECT run, 5, 'evaluator_assignment', CASE WHEN run = 10 THEN 'assignment_missing' WHEN run = 11 THEN 'schema_mismatch' WHEN n_short > 0 AND usable THEN 'pair_unassigned' ELSE 'ok' END, CASE WHEN run = 10 THEN 'absent' WHEN run = 11 THEN 'present but malformed' WHEN n_short > 0 AND usable THEN n_short || ' of ' || sampled_pairs || ' pairs short' ELSE sampled_pairs || ' of ' || sampled_pairs || ' pairs assigned' END, CASE WHEN run NOT IN (10, 11) AND n_short > 0 AND usable THEN CAST(short_pair AS VARCHAR) END FROM u
UNION ALL SELECT run, 6, 'pair_counts', CASE WHEN sampled_pairs < 300 OR q < 60 THEN 'pair_counts_below_minimum' ELSE 'ok' END, CASE WHEN sampled_pairs < 300 OR q < 60 THEN sampled_pairs || ' of 300 sampled pairs; ' || q || ' of 60 query kicks' ELSE sampled_pairs || ' sampled pairs; ' || q || ' query kicks' END, NULL FROM (SELECT *, CASE WHEN usable THEN sampled_queries ELSE 0 END AS q FROM u)
UNION ALL SELECT run, 7, 'rated_pairs', CASE WHEN run = 14 THEN 'public_rating_source' WHEN run = 15 THEN 'ratings_missing' WHEN unsampled > 0 THEN 'rated_pair_not_sampled' ELSE 'ok' END, CASE WHEN run = 14 THEN 'a ratings source is public' WHEN run = 15 THEN '0 sessions, 0 rated pairs' WHEN unsampled > 0 THEN unsampled || ' of ' || rated || ' rated pairs outside the pair list' ELSE rated || ' of ' || rated || ' rated pairs sampled' END, NULL FROM u
UNION ALL SELECT run, 8, 'analysis_manifests', CASE WHEN run = 17 THEN 'schema_mismatch' WHEN run = 18 THEN 'analysis_manifest_missing' WHEN missing_analysis_entries > 0 THEN 'missing_analysis_entry' WHEN v2 > 0 THEN 'multiple_analysis_versions' ELSE 'ok' END,
  CASE WHEN run = 17 THEN '2 of 2 declared analysis manifests are present but malformed' WHEN run = 18 THEN '2 of 2 declared analysis manifests are absent' WHEN missing_analysis_entries > 0 THEN missing_analysis_entries || ' of ' || used_samples || ' used samples unresolved' WHEN v2 > 0 THEN 'v1, v2' ELSE CASE WHEN used_samples > 0 THEN 'v1' ELSE '' END || ' over ' || used_samples || ' used samples' END, NULL FROM u
UNION ALL SELECT run, 9, 'dataset_provenance', CASE WHEN run = 22 THEN 'schema_mismatch' WHEN run = 23 THEN 'dataset_missing' WHEN synthetic_fixture_records > 0 THEN 'synthetic_fixture_record' ELSE 'ok' END, CASE WHEN run = 22 THEN 'present but malformed' WHEN run = 23 THEN 'absent' WHEN synthetic_fixture_records > 0 THEN synthetic_fixture_records || ' of ' || dataset_records || ' used records are not real_library_sample' ELSE dataset_records || ' used records' END, NULL FROM u)
SELECT *, CASE WHEN code = 'ok' THEN 'ok' WHEN observed = 'absent' OR code IN ('missing_prerequisite', 'ratings_missing', 'analysis_manifest_missing') THEN 'missing' WHEN code = 'schema_mismatch' THEN 'malformed' WHEN nth = 6 THEN 'below_minimum' ELSE 'inconsistent' END AS status FROM f"""

_FIRST = f"{RATINGS_CTE}, firsts AS (SELECT query, item, evaluator, arg_min(rating, (seq, rating)) AS rating FROM v_ratings GROUP BY ALL)"
_MEDIAN = f"{_FIRST}, medians AS (SELECT query, item, CAST(quantile_disc(rating, 0.5) AS INTEGER) AS rating, count(*) AS raters FROM firsts GROUP BY ALL HAVING count(*) >= 2)"
_ORDERS = f"""{_MEDIAN}, base AS (SELECT query, item, round(avg(price), 6) AS p, round(avg(discount), 6) AS q FROM v_ratings GROUP BY ALL),
scores AS (SELECT 'price' AS arm, query, item, p AS score FROM base UNION ALL SELECT 'discount', query, item, CASE WHEN item % 3 <> 0 THEN q END FROM base
  UNION ALL SELECT 'copy', query, item, CASE WHEN query % 2 = 0 THEN p ELSE q END FROM base),
orders_ AS (SELECT *, row_number() OVER (PARTITION BY arm, query ORDER BY score IS NULL, score DESC NULLS LAST, item) AS position FROM scores)"""
_METRICS = f"""{_ORDERS}, rated AS (SELECT o.arm, o.query, o.item, m.rating, row_number() OVER (PARTITION BY arm, o.query ORDER BY position) AS place FROM orders_ o JOIN medians m ON o.query = m.query AND o.item = m.item WHERE score IS NOT NULL),
decided AS (SELECT a.arm, a.query, count(*) AS n, count(*) FILTER (WHERE a.rating > b.rating) AS good FROM rated a JOIN rated b ON a.arm = b.arm AND a.query = b.query AND a.place < b.place AND a.rating <> b.rating GROUP BY ALL),
per AS (SELECT arm, query, count(*) AS n, avg(rating) AS rating_mean, max(CASE WHEN place = 1 THEN rating END) AS best, sum(CASE WHEN place > 1 THEN rating END) AS rest, sum(CASE WHEN place <= 10 THEN rating END) AS top FROM rated GROUP BY ALL),
metrics AS (SELECT p.arm, p.query, p.n, CAST(coalesce(d.n, 0) AS INTEGER) AS decided_pairs, CAST(d.good AS DOUBLE) / d.n AS pairwise_accuracy, CASE WHEN p.n >= 3 THEN best - CAST(rest AS DOUBLE) / (p.n - 1) END AS top1_margin,
  CASE WHEN p.n >= 2 THEN CAST(top AS DOUBLE) / least(p.n, 10) END AS topk_mean, rating_mean FROM per p LEFT JOIN decided d ON p.arm = d.arm AND p.query = d.query)"""


def _eligible(least: int) -> str:
    return f"""el AS (SELECT o.arm, o.query, count(*) AS items, count(m.rating) AS rated, count(*) FILTER (WHERE m.rating IS NOT NULL AND score IS NOT NULL) AS scored
  FROM orders_ o LEFT JOIN (SELECT * FROM medians WHERE raters >= {least}) m ON o.query = m.query AND o.item = m.item GROUP BY ALL),
eligible AS (SELECT *, CASE WHEN rated < 2 THEN 'rated_subset_below_minimum_ratings' WHEN CAST(scored AS DOUBLE) / rated < 0.5 THEN 'scored_share_below_minimum' END AS reason FROM el)"""


_ANSWERS = "a AS (SELECT user_id AS session_id, user_id % 10 AS evaluator, event_id % 400 AS pair_id, event_id AS seq, event_type = 'view' AS skipped, event_type = 'click' AS recognised, event_type <> 'error' AS completed, CASE WHEN event_id % 13 > 0 THEN event_type END AS label FROM events)"
_RATED = """r AS (SELECT user_id AS session_id, event_id % 40 AS presentation_index, event_id AS seq, 'p' || event_id % 400 AS pair_id, event_type = 'view' AS skipped, event_type = 'error' AND user_id % 3 > 0 AS recognised, event_type <> 'signup' AS completed,
  CASE WHEN event_id % 13 > 0 THEN (['poor', 'acceptable', 'good', 'excellent', 'great'])[event_id % 5 + 1] END AS label FROM events),
eff AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session_id, presentation_index ORDER BY seq DESC) = 1),
ses AS (SELECT session_id, CAST(40 AS INTEGER) AS planned, count(*) AS effective, count(*) FILTER (WHERE recognised) AS recognised, CASE WHEN session_id % 11 = 0 THEN 'tooling_session' WHEN count(*) FILTER (WHERE recognised) > 8 THEN 'recognised_rate_above_maximum' END AS reason FROM eff GROUP BY session_id)"""


def _verdict(least: int) -> str:
    return f"CASE WHEN n < {least} THEN 'insufficient' WHEN arm = 'copy' AND minimum < 0 THEN 'inconclusive' WHEN value >= minimum AND low > 0 THEN 'supported' WHEN high < minimum THEN 'not supported' ELSE 'inconclusive' END"


QUERIES = {
    "G11_J12_item_medians": (medians, f"WITH {_MEDIAN} SELECT * FROM medians"),
    "R15_arm_orders": (orders, f"WITH {_ORDERS} SELECT arm, query, item, CAST(position AS INTEGER) AS position FROM orders_"),
    "G13_J13_W12_query_metrics": (metrics, f"WITH {_METRICS} SELECT arm, query, n, decided_pairs, round(pairwise_accuracy, 9) AS pairwise_accuracy, round(top1_margin, 9) AS top1_margin, round(topk_mean, 9) AS topk_mean, round(rating_mean, 9) AS rating_mean FROM metrics"),
    "R16_query_eligibility": (
        eligibility,
        f"""WITH {_ORDERS}, o AS (SELECT * FROM orders_ WHERE query % 19 <> 2), c AS (SELECT o.arm, o.query, count(*) AS items, count(m.rating) AS rated, count(*) FILTER (WHERE m.rating IS NOT NULL AND score IS NOT NULL) AS scored
  FROM o LEFT JOIN (SELECT * FROM medians WHERE raters >= 3) m ON o.query = m.query AND o.item = m.item GROUP BY ALL),
a AS (SELECT v.arm, q.query, coalesce(items, 0) AS items, coalesce(rated, 0) AS rated, coalesce(scored, 0) AS scored FROM range(300) q(query) CROSS JOIN (VALUES ('price'), ('discount'), ('copy')) v(arm) LEFT JOIN c ON c.arm = v.arm AND c.query = q.query)
SELECT *, CASE WHEN query % 23 = 1 THEN 'filter_error' WHEN items = 0 THEN 'no_eligible_candidate_set' WHEN rated < 2 THEN 'rated_subset_below_minimum_ratings' WHEN CAST(scored AS DOUBLE) / rated < 0.5 THEN 'scored_share_below_minimum' END AS reason FROM a""",
    ),
    "G14_arm_summary": (
        summary,
        f"""WITH {_METRICS}, {_eligible(2)}, s AS (SELECT m.arm, count(*) AS queries, round(avg(pairwise_accuracy), 9) AS pairwise_accuracy, round(avg(top1_margin), 9) AS top1_margin, round(avg(topk_mean), 9) AS topk_mean, round(avg(rating_mean), 9) AS rating_mean
FROM metrics m JOIN eligible e ON m.arm = e.arm AND m.query = e.query WHERE reason IS NULL GROUP BY m.arm) SELECT s.*, round(CAST(u.a AS DOUBLE) / u.b, 9) AS unscored_share FROM s JOIN (SELECT arm, sum(rated - scored) AS a, sum(rated) AS b FROM eligible WHERE reason IS NULL GROUP BY arm) u USING (arm)""",
    ),
    "R18_J14_paired_lifts": (lifts, f"WITH {_METRICS} SELECT a.arm AS a, b.arm AS b, a.query, round(a.topk_mean - b.topk_mean, 9) AS lift FROM metrics a JOIN metrics b ON a.query = b.query AND a.arm <> b.arm WHERE a.topk_mean IS NOT NULL AND b.topk_mean IS NOT NULL"),
    "G15_rater_agreement": (
        agreement,
        f"WITH {_FIRST} SELECT a.evaluator, count(*) AS n, round(avg(abs(a.rating - b.rating)), 9) AS mean_deviation, round(avg(CASE WHEN a.rating = b.rating THEN 1.0 ELSE 0.0 END), 9) AS exact_share FROM firsts a JOIN firsts b ON a.query = b.query AND a.item = b.item AND a.evaluator <> b.evaluator GROUP BY a.evaluator",
    ),
    "G18_identical_orders": (identical, f"WITH {_ORDERS}, l AS (SELECT arm, query, list(item ORDER BY position) AS items FROM orders_ GROUP BY ALL) SELECT arm, count(*) AS queries FROM l x WHERE EXISTS (SELECT 1 FROM l y WHERE y.query = x.query AND y.arm <> x.arm AND y.items = x.items) GROUP BY arm"),
    "G12_G19_latency_percentiles": (latencies, "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY event_type"),
    "G20_recall_curve": (recall, f"WITH {_ORDERS}, h AS (SELECT o.position FROM orders_ o JOIN medians m ON o.query = m.query AND o.item = m.item WHERE arm = 'price' AND m.rating >= 2) SELECT size, (SELECT count(*) FROM h WHERE position <= size) AS found, (SELECT count(*) FROM h) AS positives, round((SELECT count(*) FROM h WHERE position <= size) / CAST((SELECT count(*) FROM h) AS DOUBLE), 9) AS recall FROM (VALUES (5), (10), (20), (50), (100)) v(size)"),
    "D2_D3_misses": (
        misses,
        f"""WITH {_ORDERS}, s AS (SELECT * FROM orders_ WHERE arm = 'price' AND item % 7 <> 0), pos AS (SELECT query, item FROM medians WHERE rating >= 2)
SELECT why, count(*) AS n FROM (SELECT CASE WHEN item >= 18 THEN 'missing_from_library' WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.query = pos.query AND s.item = pos.item) THEN 'filter_excluded' ELSE 'cut' END AS why FROM pos
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query = pos.query AND s.item = pos.item AND position <= 10)) GROUP BY why""",
    ),
    "R17_verdicts": (
        verdicts,
        f"""WITH {_METRICS}, t AS (SELECT arm, 'topk_mean' AS metric, unnest([0.5, 1.5, 1.7]) AS minimum, count(topk_mean) AS n, round(avg(topk_mean), 9) AS value, round(quantile_cont(topk_mean, 0.3), 9) AS low, round(quantile_cont(topk_mean, 0.7), 9) AS high FROM metrics GROUP BY arm
  UNION ALL SELECT arm, 'top1_margin', unnest([-0.5, 0.02, 0.5]), count(top1_margin), round(avg(top1_margin), 9), round(quantile_cont(top1_margin, 0.3), 9), round(quantile_cont(top1_margin, 0.7), 9) FROM metrics GROUP BY arm)
SELECT arm, metric, CAST(minimum AS DOUBLE) AS minimum, {_verdict(250)} AS verdict, {_verdict(100000)} AS too_few FROM t""",
    ),
    "R17_bootstrap_verdicts": (bootstrap_verdicts, None),
    "G17_bootstrap_means": (bootstrap, None),
    "R23_preflight_findings": (preflight_findings, _FINDINGS_SQL),
    "G24_accounting": (
        accounting,
        f"""WITH {_RUNS_SQL} SELECT run, CASE WHEN run IN (22, 23) THEN 0 WHEN run = 8 THEN 96 ELSE 97 END AS pool_kicks, CASE WHEN run IN (22, 23) THEN 0 ELSE 89 END AS pool_basses, CASE WHEN run IN (22, 23) THEN 0 WHEN run = 8 THEN 185 ELSE 186 END AS pool_records, CASE WHEN run IN (22, 23) THEN 0 ELSE 1 END AS pool_reserves,
  sampled_pairs, sampled_queries, (SELECT count(DISTINCT kick) FROM o WHERE o.run = su.run AND CAST(kick[2:] AS INTEGER) % 5 > 0) AS eligible_queries, rated_pairs, rated_pairs_sampled, rated_pairs AS multi_rated_pairs, valid_ratings, CASE WHEN run = 15 THEN 0 ELSE 3 END AS counted_evaluators, CASE WHEN run = 15 THEN 0 ELSE 5 END AS sessions,
  CASE WHEN run = 15 THEN 0 ELSE 1 END AS tooling_sessions, CASE WHEN run = 15 THEN 0 ELSE 2 END AS excluded_sessions, CASE WHEN run = 15 THEN 0 ELSE 10 END AS recognised_ratings, CASE WHEN run IN (17, 18) THEN 0 WHEN run = 19 THEN 185 ELSE 186 END AS analysed_samples, used_samples, missing_analysis_entries, dataset_records, synthetic_fixture_records,
  CASE WHEN sampled_pairs > 0 THEN round(CAST(rated_pairs AS DOUBLE) / sampled_pairs, 9) END AS pair_coverage FROM su""",
    ),
    "M14_manifest_rows": (
        manifest_rows,
        """WITH o AS (SELECT o_custkey AS name, o_custkey % 8 AS k, 's' || o_orderkey AS id FROM orders), n AS (SELECT DISTINCT name, k FROM o)
SELECT name, 'held_out/kick' AS part, id AS sample_id FROM o WHERE k NOT IN (2, 3, 6) UNION ALL SELECT name, 'tuning/kick', 't1' FROM n WHERE k NOT IN (2, 3, 6)
UNION ALL SELECT name, e, id FROM (SELECT DISTINCT * FROM o), (VALUES ('e1'), ('e2')) v(e) WHERE k NOT IN (5, 7) UNION ALL SELECT name, 'e4', 's-last' FROM n WHERE k = 3""",
    ),
    "M25_arm_status": (
        arm_statuses,
        """WITH r AS (SELECT o_custkey AS run, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS live FROM orders GROUP BY 1), a AS (SELECT * FROM r, (VALUES ('random'), ('dsp-only'), ('jev-only'), ('hybrid')) v(arm)),
w AS (SELECT *, CASE WHEN run % 7 = 0 THEN 'no_held_out_query' WHEN run % 5 = 0 THEN 'no_analysis_manifests' WHEN arm IN ('jev-only', 'hybrid') AND live = 0 THEN 'no_live_jev_outcomes' WHEN arm = 'hybrid' AND run % 6 > 0 AND run % 4 = 0 THEN 'hybrid_fell_back_to_dsp' WHEN run % 3 = 0 THEN 'no_eligible_query' END AS status_reason FROM a)
SELECT run, arm, live, CASE WHEN status_reason IS NULL THEN 'evaluated' ELSE 'insufficient' END AS status, status_reason FROM w""",
    ),
    "S13_document_problems": (
        list_problems,
        """SELECT 'pair_list' AS kind, name, (['schema_mismatch:pair_list.schema_version', 'schema_mismatch:pair_list.dataset_version', 'split_manifest_digest_invalid:pair_list.split_manifest_digest', 'schema_mismatch:pair_list.assignment_seed', 'schema_mismatch:pair_list.pairs', 'schema_mismatch:pair_list.pairs', 'schema_mismatch:pair_list.pairs.pair',
  'schema_mismatch:pair_list', 'schema_mismatch:pair_list', 'schema_mismatch:pair_list'])[name % 12] AS problem FROM (SELECT DISTINCT o_custkey AS name FROM orders) UNION ALL SELECT 'export', name, CASE WHEN name % 20 = 7 THEN 'malformed_export:version' END FROM (SELECT DISTINCT l_suppkey AS name FROM lineitem)""",
    ),
    "M20_recall_reference": (recall_reference, f"WITH {_REFERENCE_SQL} SELECT query, string_agg(bass, ',' ORDER BY bass) AS declared, coalesce(string_agg(CASE WHEN liked THEN bass END, ',' ORDER BY bass), '') AS positive FROM ref GROUP BY query"),
    "M20_G20_reference_curve": (reference_curve, f"""WITH {_REFERENCE_SQL}, h AS (SELECT liked, row_number() OVER (PARTITION BY query ORDER BY bass) AS position FROM ref), n AS (SELECT count(*) FILTER (WHERE liked) AS n FROM h)
SELECT size, (SELECT count(*) FROM h WHERE liked AND position <= size) AS found, n.n AS positives, round((SELECT count(*) FROM h WHERE liked AND position <= size) / CAST(n.n AS DOUBLE), 9) AS recall FROM (VALUES (5), (10), (20), (50), (100)) v(size), n"""),
    "M16_pool_counts": (pool, """SELECT run, CASE WHEN run = 8 THEN 96 ELSE 97 END AS pool_kicks, 89 AS pool_basses, CASE WHEN run = 8 THEN 185 ELSE 186 END AS pool_records, CASE run WHEN 8 THEN '{"real_library_sample":185}' WHEN 24 THEN '{"real_library_sample":180,"synthetic":6}' ELSE '{"real_library_sample":186}' END AS provenance, 1 AS pool_reserves FROM range(40) t(run) WHERE run NOT IN (22, 23)"""),
    "M15_analysis_entries": (
        entry_problems,
        """WITH e AS (SELECT l_suppkey % 5 AS run, l_orderkey * 10 + l_linenumber AS place, l_partkey AS sample_id, l_quantity > 10 AS whole FROM lineitem WHERE l_linenumber <> 3),
f AS (SELECT *, (SELECT min(place) FROM e x WHERE x.run = e.run AND x.sample_id = e.sample_id AND x.whole) AS first FROM e)
SELECT run, CASE WHEN place > first THEN 'duplicate_analysis_entry' WHEN NOT whole THEN 'analysis_entry_incomplete' END AS problem, count(*) AS n, count(DISTINCT sample_id) AS samples, CAST(sum(place) AS BIGINT) AS places FROM f GROUP BY 1, 2""",
    ),
    "G25_each_session_counts": (
        each_session,
        """WITH e AS (SELECT user_id AS session_id, event_id % 60 AS i, event_type FROM events), s AS (SELECT session_id, count(*) FILTER (WHERE event_type <> 'view') AS answered, count(*) FILTER (WHERE event_type = 'view') AS skipped,
count(*) FILTER (WHERE event_type = 'click') AS recognised, count(*) FILTER (WHERE event_type = 'error') AS failed FROM e GROUP BY session_id),
n AS (SELECT session_id, min(r.i) AS next_index FROM s, range(60) r(i) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session_id = s.session_id AND e.i = r.i) GROUP BY session_id) SELECT s.*, next_index FROM s LEFT JOIN n USING (session_id)""",
    ),
    "M17_valid_ratings": (valid, f"WITH {_RATED} SELECT session_id, seq, pair_id, CASE label WHEN 'poor' THEN 0.0 WHEN 'acceptable' THEN 1.0 WHEN 'good' THEN 2.0 WHEN 'excellent' THEN 3.0 END AS rating FROM eff WHERE NOT recognised AND NOT skipped AND completed AND label IS NOT NULL AND label <> 'great' AND session_id IN (SELECT session_id FROM ses WHERE reason IS NULL)"),
    "M17_session_verdicts": (session_verdicts, f"WITH {_RATED} SELECT session_id, planned, effective, recognised, reason IS NULL AS counted, reason FROM ses"),
    "M18_repeated_elsewhere": (elsewhere, f"WITH {_ANSWERS} SELECT evaluator, pair_id, count(DISTINCT session_id) AS sessions FROM a GROUP BY ALL HAVING count(DISTINCT session_id) > 1"),
    "D5_S14_last_answers": (last_answers, f"WITH {_ANSWERS} SELECT session_id, pair_id, seq, label FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pair_id ORDER BY seq DESC) AS n FROM a) WHERE n = 1"),
}

#: Every evaluator is left out.
_EACH = f"{_FIRST}, outs AS (SELECT x.e AS left_out, query, item, CAST(quantile_disc(rating, 0.5) AS INTEGER) AS rating, count(*) AS raters FROM firsts, (SELECT DISTINCT evaluator AS e FROM firsts) x WHERE evaluator <> x.e GROUP BY ALL HAVING count(*) >= 2)"
QUERIES |= {
    "G16_leave_each_out": (each_left_out, f"WITH {_EACH} SELECT * FROM outs WHERE EXISTS (SELECT 1 FROM firsts f WHERE f.evaluator = left_out AND f.query = outs.query AND f.item = outs.item)"),
    "G16_R17_all_flipped_gates": (
        all_flipped,
        f"""WITH {_EACH}, m AS (SELECT avg(rating) AS m FROM (SELECT quantile_disc(rating, 0.5) AS rating FROM firsts GROUP BY query, item HAVING count(*) >= 2)), lo AS (SELECT left_out, avg(rating) AS m FROM outs GROUP BY left_out),
g AS (SELECT 'half' AS gate, 0.5 AS minimum, m FROM m UNION ALL SELECT 'one', 1.0, m FROM m UNION ALL SELECT 'mean', m, m FROM m UNION ALL SELECT 'two', 2.0, m FROM m)
SELECT gate, left_out FROM g, lo WHERE (lo.m >= minimum) <> (g.m >= minimum)""",
    ),
}
