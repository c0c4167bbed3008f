"""Registered queries of stored records, each with SQL that states the same rules anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.operators import batches, dataset, records, retrieval
from timbral.plans.ranking_queries import _FIT, _fitted
from timbral.sources import versioned, views
from timbral.sources.views import CONTENT_CTE, JOBS_CTE, LIBRARY_CTE, read


def dispositions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("content") % 3 == 0, "reused").when(F.col("content") % 3 == 1, "analyzed")
    return records.disposition_counts(views.job_items(spark, d).withColumn("disposition", kind), "run_id")


def prevailing(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    source = F.when(F.col("event_type") == "purchase", "interface").when(F.col("event_type") != "error", "double")
    rows = e.select((F.col("event_id") % 1500).alias("request_id"), source.alias("source"), (F.col("user_id") % 20).alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("outcome"))
    return records.prevailing_outcomes(rows)


def versions(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_partkey").alias("sample_id"), (F.col("l_suppkey") % 40).alias("version")).agg(F.max("l_shipdate").alias("created_at"))
    return records.listed_versions(rows).withColumn("versions", F.array_join(F.transform("versions", lambda v: v.cast("string")), ","))


def lookups(spark: SparkSession, d: str) -> DataFrame:
    """By content: the documents' contents, of which the even samples are stored, and one that nobody has."""
    held = views.content(spark, d).select("sample_id", "sha", "role")
    asked = held.select("sha").unionByName(spark.range(1).select(F.lit("none").alias("sha")))
    return records.looked_up(held.where("sample_id % 2 = 0"), asked, "sha")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """The fitted normalization, and copies of it with one entry spoilt."""
    order = F.array(*(F.lit(n) for n in retrieval.SPACE))
    transforms = F.create_map(*(F.lit(x) for pair in retrieval.SPACE.items() for x in pair))
    fitted = _fitted(spark, d)
    place = (F.array_position(order, F.col("dimension")) - 1).cast("int")
    active = F.col("inactive_reason").isNull()
    rows = fitted.select(place.alias("place"), "dimension", transforms[F.col("dimension")].alias("transform"), "n", F.when(active, F.round("mean", 9)).alias("mean"), F.when(active, F.round("std", 9)).alias("std"), "inactive_reason")
    copies = rows.select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("record"), "*")
    spoilt = lambda k: (F.col("record") == k) & (F.col("place") == k)
    return copies.select(
        "record",
        F.when(spoilt(1), 9).otherwise(F.col("place")).alias("place"),
        F.when(spoilt(2), "colour").otherwise(F.col("dimension")).alias("dimension"),
        F.when(spoilt(3), "cubed").otherwise(F.col("transform")).alias("transform"),
        F.when(spoilt(4), -1).otherwise(F.col("n")).alias("n"),
        F.when(spoilt(5), F.lit(None)).otherwise(F.col("mean")).alias("mean"),
        "std",
        F.when(spoilt(6), "unknown_reason").otherwise(F.col("inactive_reason")).alias("inactive_reason"),
    )


def normalization_problems(spark: SparkSession, d: str) -> DataFrame:
    problem = records.normalization_problem(*(F.col(c) for c in ("place", "dimension", "transform", "n", "mean", "std", "inactive_reason")))
    return _entries(spark, d).select("record", "place", problem.alias("problem")).where("problem is not null")


def normalization_records(spark: SparkSession, d: str) -> DataFrame:
    """Normalizations as wholes: the copies with a spoilt entry, and seven more with a wrong frame or list."""
    first = _entries(spark, d).where("record = 0").drop("record")
    name = F.when((F.col("record") == 9) & (F.col("place") == 2), next(iter(retrieval.SPACE))).when((F.col("record") == 10) & (F.col("place") == 2), "colour").otherwise(F.col("dimension"))
    more = first.select(F.explode(F.sequence(F.lit(7), F.lit(13))).alias("record"), "*").withColumn("dimension", name)
    swapped = F.when(F.col("record") != 12, F.col("place")).when(F.col("place") == 0, 1).when(F.col("place") == 1, 0).otherwise(F.col("place"))
    kept = more.where("NOT (record = 11 AND place = 13) AND record <> 13").withColumn("place", swapped.cast("int"))
    stored = spark.range(14).select(F.col("id").cast("int").alias("record"), F.when(F.col("id") == 7, "space-0").otherwise("space-1").alias("representation_version"), F.when(F.col("id") == 8, F.array(F.lit("bass"))).otherwise(F.array(F.lit("bass"), F.lit("sub-bass"))).alias("candidate_roles"))
    return records.normalization_record_problem(stored, _entries(spark, d).unionByName(kept), "space-1")


def imports(spark: SparkSession, d: str) -> DataFrame:
    """A batch against the stored half of a library: known paths, moved, new and twice brought contents."""
    lib = views.library(spark, d).select("sample_id", F.concat("path_key", F.lit("#"), "sample_id").alias("path_key"), F.concat(F.lit("c"), F.col("sample_id") % 1500).alias("content"))
    stored = lib.where("sample_id % 3 = 0")
    batch = lib.where("sample_id % 5 < 3").select(F.when(F.col("sample_id") % 7 == 0, F.concat("path_key", F.lit("/new"))).otherwise(F.col("path_key")).alias("path_key"), F.when(F.col("sample_id") % 11 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    return records.import_problems(batch, stored).groupBy("decision").agg(F.count("*").alias("n"), F.count_distinct("path_key").alias("paths"))


def splits(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    lists = o.groupBy(F.concat(F.lit("p"), F.col("o_custkey") % 5).alias("partition")).agg(F.collect_set(F.col("o_orderkey") % 900).alias("members"))
    return records.split_members(lists.withColumn("sample_ids", F.when(F.col("partition") == "p1", F.col("members"))).withColumn("members", F.when(F.col("partition") != "p1", F.col("members"))))


def analysis_problems(spark: SparkSession, d: str) -> DataFrame:
    """Analyses of documents, some of which have other contents by now, are gone, or name a version that isn't registered or doesn't fit its descriptor."""
    docs = views.content(spark, d)
    n = F.col("sample_id")
    batch = docs.select("sample_id", F.when(n % 7 == 0, "old").otherwise(F.col("sha")).alias("content"), F.when(n % 11 == 0, "v9").when(n % 13 == 0, "v2").otherwise("v1").alias("version"), F.when(n % 5 == 0, F.when(n % 3 == 0, "v8").when(n % 11 == 0, "v9").when(n % 13 == 0, "v2").otherwise("v1")).alias("descriptor_digest"))
    versions = spark.createDataFrame([("v1", "v1"), ("v2", "other")], "version string, digest string")
    found = versioned.analysis_problems(batch, docs.where("sample_id % 17 > 0").select("sample_id", F.col("sha").alias("content")), versions)
    return found.select("sample_id", "version", "code")


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    """Records of a data set and their files as they are now: some changed, some with other metadata, some unreadable, some gone."""
    docs = views.content(spark, d)
    n = F.col("sample_id")
    path = F.concat(F.lit("f/"), n.cast("string"))
    records = docs.select("source", path.alias("path"), F.when(n % 4 == 0, "reserves").otherwise("selected").alias("group"), F.when(F.col("role") == "kick", "kick").otherwise("bass").alias("role"), F.col("sha").alias("sha256"), F.lit("48000/2").alias("metadata"))
    found = docs.where("sample_id % 9 > 0").select("source", path.alias("path"), F.when(n % 10 != 7, F.when(n % 8 == 1, F.reverse("sha")).otherwise(F.col("sha"))).alias("sha256"), F.when(n % 6 == 1, "44100/2").otherwise("48000/2").alias("metadata"), F.when(n % 10 == 7, "invalid_audio").alias("error"))
    return dataset.revalidated(records, found)


def revalidated(spark: SparkSession, d: str) -> DataFrame:
    return _recorded(spark, d).select("source", "path", "error")


def shortfalls(spark: SparkSession, d: str) -> DataFrame:
    return dataset.verified_shortfall(_recorded(spark, d), 400)


def diagnosed(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems as files that couldn't be read, and the groups of which one is to be looked at; one group has none."""
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    reason = F.when(n % 6 == 0, "duplicate_content").when(n % 6 == 1, "read_validation_failed: padding").otherwise("read_validation_failed: tag")
    role = F.when(F.col("l_suppkey") % 3 == 0, "kick").when(F.col("l_suppkey") % 3 == 1, "bass").otherwise("sub-bass")
    excluded = read(spark, d, "lineitem").select((n * 100 + F.col("l_partkey") % 100).alias("place"), role.alias("role"), reason.alias("reason"), (F.col("l_partkey") % 4).alias("tag"), F.concat(F.lit("f/"), F.col("l_partkey")).alias("path"))
    expected = spark.createDataFrame([("kick", 1, "encoding"), ("kick", 2, "bounds"), ("bass", 1, "encoding"), ("bass", 3, "bounds"), ("kick", 7, "encoding")], "role string, tag long, category string")
    return records.representatives(excluded, expected).select("role", "tag", "category", "place")


def run_keys(spark: SparkSession, d: str) -> DataFrame:
    """Runs of few data sets and splits: each one's key, and how many others are of its kind."""
    k = F.col("o_orderkey")
    runs = read(spark, d, "orders").select(k.alias("run"), F.concat(F.lit("d"), k % 9).alias("dataset_version"), F.when(k % 4 > 0, F.concat(F.lit("s"), k % 4)).alias("split_manifest_digest"), F.concat(F.lit("r"), k % 5).alias("ranking_version"))
    found = records.run_keys(runs, ["ranking_version", "dataset_version", "split_manifest_digest"])
    return found.select("run", "run_key", F.size("others").alias("others"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """name and an answer of up to twenty candidates for each part's suppliers, with one fault or none."""
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), "l_linenumber", "l_partkey")
    kind = F.col("name") % 16
    one = F.struct(
        F.when((kind == 3) & (F.col("at") == 0), "same").when(kind == 3, "same").otherwise(F.concat(F.lit("c"), F.col("at").cast("string"))).alias("candidate_id"), (F.col("at") + F.when((kind == 4) & (F.col("at") == F.col("n") - 1), 2).otherwise(1)).cast("int").alias("rank"),
        F.when((kind == 5) & (F.col("at") == 0), F.lit(1.5)).otherwise(F.lit(0.5)).alias("compatibility"), F.lit(1).alias("confidence"), F.array().cast("array<string>").alias("warnings"), F.when(kind != 6, F.array().cast("array<string>")).alias("jev_judgments"),
    )
    sizes = li.groupBy("name").agg(F.count("*").alias("n"))
    results = sizes.select("name", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at")).groupBy("name").agg(F.max("n").alias("n"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", one.alias("r")))), lambda x: x["r"])).alias("results"))
    counts = F.lit('{"eligible":1,"excluded":1,"shortlisted":1,"scored":1,"unscored":0,"requested":1' + '%s}')
    block = F.concat(F.lit('{"counts":'), F.replace(counts, F.lit("%s"), F.when(kind == 8, "").otherwise(',"returned":1')), F.lit(',"evidence":{"interface":1,"double":0,"unavailable":0,"cache":0,"cache_errors":0},"retrieval":{'), F.when(kind == 9, "").otherwise('"limit_reason":null'), F.lit('},"ranking":{"jev_status":'), F.when(kind == 10, "null").otherwise('"absent"'), F.lit("}}"))
    batch = F.concat(F.lit('{"schema_version":'), F.when(kind == 11, '"1.1"').otherwise('"1.0"'), F.lit(',"results":'), F.when(kind == 12, "{}").otherwise(F.col("results")), F.lit(',"alternatives":'), F.when(kind == 13, '["none"]').otherwise("[]"), F.lit("}"))
    error = F.when(kind == 1, '"error":{"code":"revision_conflict","details":{"current_revision":7}},').when(kind == 2, '"error":{"code":"internal_error"},').otherwise("")
    whole = F.concat(F.lit('{"api_schema":'), F.when(kind == 14, "1.0").otherwise('"1.0"'), F.lit(","), error, F.lit('"recommendation":'), batch, F.lit(',"run":'), F.when(kind == 7, "null").otherwise(block), F.when(kind == 15, "").otherwise("}"))
    return results.select("name", "n", whole.alias("answer"))


def batch_problems(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("name", batches.batch_problem(F.col("answer")).alias("code"), batches.current_revision(F.col("answer")).alias("current"))


def batch_candidates(spark: SparkSession, d: str) -> DataFrame:
    return batches.candidates(_answers(spark, d)).groupBy("name").agg(F.max("n").alias("n"), F.count("*").alias("candidates"), F.max("rank").alias("last"), F.sum("compatibility").alias("total"))


_TRANSFORMS = ", ".join(f"('{n}', {k}, '{t}')" for k, (n, t) in enumerate(retrieval.SPACE.items()))
_IMPORT = f"""WITH {LIBRARY_CTE}, lib AS (SELECT sample_id, path_key || '#' || sample_id AS path_key, 'c' || sample_id % 1500 AS content FROM v_library),
batch AS (SELECT path_key || CASE WHEN sample_id % 7 = 0 THEN '/new' ELSE '' END AS path_key, content || CASE WHEN sample_id % 11 = 0 THEN 'x' ELSE '' END AS content FROM lib WHERE sample_id % 5 < 3),
held AS (SELECT * FROM lib WHERE sample_id % 3 = 0)"""

_RECORDED = f"""{CONTENT_CTE}, rec AS (SELECT sample_id AS n, source, 'f/' || sample_id AS path, CASE WHEN sample_id % 4 = 0 THEN 'reserves' ELSE 'selected' END AS grp, CASE WHEN role = 'kick' THEN 'kick' ELSE 'bass' END AS role,
  CASE WHEN sample_id % 9 = 0 THEN 'not_found' WHEN sample_id % 10 = 7 THEN 'invalid_audio' WHEN sample_id % 8 = 1 AND reverse(sha) <> sha THEN 'stale_fingerprint' WHEN sample_id % 6 = 1 THEN 'stale_metadata' END AS error FROM v_content)"""

QUERIES = {
    "R13_normalization_records": (
        normalization_records,
        """SELECT CAST(record AS INTEGER) AS record, CASE WHEN why IN ('unknown_dimension') THEN 'unknown_dimension' WHEN why IS NOT NULL THEN 'invalid_normalization' END AS code, why FROM (VALUES (0, NULL), (1, 'not_the_declared_list'), (2, 'unknown_dimension'), (3, 'wrong_transform'), (4, 'wrong_count'), (5, 'statistics_missing'), (6, 'wrong_inactive_entry'),
  (7, 'other_version'), (8, 'other_roles'), (9, 'repeated_dimension'), (10, 'unknown_dimension'), (11, 'not_the_declared_list'), (12, 'not_the_declared_list'), (13, 'not_the_declared_list')) v(record, why)""",
    ),
    "M22_representatives": (
        diagnosed,
        """WITH x AS (SELECT (l_orderkey * 10 + l_linenumber) AS n, l_partkey, CASE l_suppkey % 3 WHEN 0 THEN 'kick' WHEN 1 THEN 'bass' ELSE 'sub-bass' END AS role FROM lineitem),
f AS (SELECT role, l_partkey % 4 AS tag, CASE WHEN n % 6 = 1 THEN 'bounds' ELSE 'encoding' END AS category, min(n * 100 + l_partkey % 100) AS place FROM x WHERE n % 6 > 0 AND role <> 'sub-bass' GROUP BY ALL)
SELECT e.role, e.tag, e.category, place FROM (VALUES ('kick', 1, 'encoding'), ('kick', 2, 'bounds'), ('bass', 1, 'encoding'), ('bass', 3, 'bounds'), ('kick', 7, 'encoding')) e(role, tag, category) LEFT JOIN f ON f.role = e.role AND f.tag = e.tag AND f.category = e.category""",
    ),
    "M19_run_keys": (
        run_keys,
        """WITH r AS (SELECT o_orderkey AS run, 'd' || o_orderkey % 9 AS dv, CASE WHEN o_orderkey % 4 > 0 THEN '"s' || o_orderkey % 4 || '"' ELSE 'null' END AS sd, 'r' || o_orderkey % 5 AS rv FROM orders),
k AS (SELECT *, sha256('{"dataset_version":"' || dv || '","ranking_version":"' || rv || '","split_manifest_digest":' || sd || '}') AS run_key FROM r)
SELECT run, run_key, CAST((SELECT count(DISTINCT j.run_key) FROM k j WHERE j.dv = k.dv AND j.sd = k.sd) - 1 AS INTEGER) AS others FROM k""",
    ),
    "M3_analysis_problems": (
        analysis_problems,
        f"""WITH {CONTENT_CTE}, b AS (SELECT sample_id AS n, CASE WHEN sample_id % 11 = 0 THEN 'v9' WHEN sample_id % 13 = 0 THEN 'v2' ELSE 'v1' END AS version FROM v_content)
SELECT n AS sample_id, version, CASE WHEN n % 17 = 0 THEN 'unknown_sample' WHEN n % 7 = 0 THEN 'invalid_content_identity' WHEN n % 5 <> 0 AND version = 'v9' THEN 'unknown_analysis_version' WHEN n % 5 = 0 AND n % 3 = 0 THEN 'invalid_sample' WHEN version = 'v2' THEN 'analysis_version_mismatch' END AS code FROM b""",
    ),
    "M21_revalidated": (revalidated, f"WITH {_RECORDED} SELECT source, path, error FROM rec"),
    "M21_shortfall": (shortfalls, f"WITH {_RECORDED}, v AS (SELECT role, count(*) AS n FROM rec WHERE grp = 'selected' AND error IS NULL GROUP BY role) SELECT r.role, coalesce(n, 0) AS verified, greatest(400 - coalesce(n, 0), 0) AS shortfall FROM (VALUES ('kick'), ('bass')) r(role) LEFT JOIN v USING (role)"),
    "M23_batch_problems": (
        batch_problems,
        """WITH a AS (SELECT l_orderkey AS name, l_orderkey % 16 AS kind, count(*) AS n FROM lineitem GROUP BY 1)
SELECT name, CASE WHEN kind IN (11, 14, 15) THEN 'unsupported_schema' WHEN kind = 1 THEN 'stale_revision' WHEN kind IN (2, 4, 5, 6, 7, 8, 9, 10, 12, 13) OR kind = 3 AND n > 1 THEN 'malformed_response' END AS code, CASE WHEN kind = 1 THEN 7 END AS current FROM a""",
    ),
    "M23_candidates": (batch_candidates, "SELECT l_orderkey AS name, count(*) AS n, count(*) AS candidates, CAST(count(*) AS INTEGER) AS last, count(*) * 0.5 AS total FROM lineitem WHERE l_orderkey % 16 = 0 GROUP BY 1 UNION ALL SELECT l_orderkey, 1, 1, 1, 0.5 FROM lineitem WHERE l_orderkey % 16 = 3 GROUP BY 1 HAVING count(*) = 1"),
    "G3_disposition_counts": (dispositions, f"WITH {JOBS_CTE} SELECT run_id, count(*) FILTER (WHERE content % 3 = 1) AS analyzed, count(*) FILTER (WHERE content % 3 = 0) AS reused, count(*) FILTER (WHERE content % 3 = 2) AS \"unknown\" FROM v_jobs WHERE state = 'complete' GROUP BY run_id"),
    "D9_prevailing_outcomes": (
        prevailing,
        """WITH r AS (SELECT event_id % 1500 AS request_id, CASE WHEN event_type = 'purchase' THEN 'interface' WHEN event_type <> 'error' THEN 'double' END AS source, user_id % 20 AS run, event_id AS seq, event_type AS outcome FROM events)
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(source = 'interface', false) DESC, run DESC, seq DESC) AS k FROM r) WHERE k = 1""",
    ),
    "L8_listed_versions": (
        versions,
        """WITH a AS (SELECT l_partkey AS sample_id, l_suppkey % 40 AS version, max(l_shipdate) AS created_at FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY created_at DESC, version) AS nth FROM a)
SELECT sample_id, string_agg(version, ',' ORDER BY nth) FILTER (WHERE nth <= 8) AS versions, count(*) > 8 AS truncated FROM n GROUP BY sample_id""",
    ),
    "F11_content_lookup": (
        lookups,
        f"""WITH {CONTENT_CTE}, h AS (SELECT sha, min(sample_id) AS sample_id, arg_min(role, sample_id) AS role FROM v_content WHERE sample_id % 2 = 0 GROUP BY sha), a AS (SELECT DISTINCT sha FROM v_content UNION SELECT 'none')
SELECT a.sha, h.sample_id IS NOT NULL AS found, h.sample_id, h.role FROM a LEFT JOIN h ON a.sha IS NOT DISTINCT FROM h.sha AND a.sha IS NOT NULL""",
    ),
    "R13_normalization_problems": (
        normalization_problems,
        f"""WITH {_FIT}, t(dimension, place, transform) AS (VALUES {_TRANSFORMS}), e AS (SELECT r.record, t.place, n.inactive_reason FROM normals n JOIN t USING (dimension), range(7) r(record))
SELECT record, CASE WHEN record = 1 THEN 9 ELSE place END AS place, CASE record WHEN 1 THEN 'wrong_order' WHEN 2 THEN 'unknown_dimension' WHEN 3 THEN 'wrong_transform' WHEN 4 THEN 'wrong_count' WHEN 5 THEN 'statistics_missing' WHEN 6 THEN 'wrong_inactive_entry' END AS problem
FROM e WHERE record > 0 AND place = record AND (record <> 5 OR inactive_reason IS NULL)""",
    ),
    "M2_import_decisions": (
        imports,
        f"""{_IMPORT}, j AS (SELECT b.*, h.content AS held, (SELECT min(path_key) FROM held x WHERE x.content = b.content) AS known, count(*) OVER (PARTITION BY b.content) > 1 AS several FROM batch b LEFT JOIN held h ON h.path_key = b.path_key)
SELECT CASE WHEN held = content THEN 'same' WHEN held IS NOT NULL THEN 'path_conflict' WHEN several THEN 'duplicate_content' WHEN known IS NOT NULL THEN 're-path' ELSE 'insert' END AS decision, count(*) AS n, count(DISTINCT path_key) AS paths FROM j GROUP BY ALL""",
    ),
    "M14_split_members": (splits, "SELECT o_orderkey % 900 AS sample_id, min('p' || o_custkey % 5) AS partition, CASE WHEN count(DISTINCT o_custkey % 5) > 1 THEN 'several_partitions' END AS problem FROM orders GROUP BY 1"),
}
