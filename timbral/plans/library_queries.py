"""Registered queries of the library, its data sets and the cache, each with SQL that states the same rules anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.operators import cache, dataset, library
from timbral.sources import views
from timbral.sources.views import CONTENT_CTE, JOBS_CTE, LIBRARY_CTE, read


def _content_samples(spark: SparkSession, d: str) -> DataFrame:
    """content (n % 997), sample_id, path_key, file_status over documents."""
    docs = read(spark, d, "documents")
    status = F.when(F.col("doc_id") % 11 == 0, "missing").otherwise("available")
    return docs.select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 499).alias("content"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path_key"), status.alias("file_status"))


def _analysed(spark: SparkSession, d: str) -> DataFrame:
    return views.job_items(spark, d).where("state = 'complete' and content % 3 <> 0").select("content", "version").distinct()


_SAMPLES = "c_samples AS (SELECT doc_id AS sample_id, doc_id % 499 AS content, source || '/' || doc_id AS path_key, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'available' END AS file_status FROM documents)"
_ANALYSED = "analysed AS (SELECT DISTINCT content, version FROM v_jobs WHERE state = 'complete' AND content % 3 <> 0)"


def states(spark: SparkSession, d: str) -> DataFrame:
    return library.with_states(_content_samples(spark, d), _analysed(spark, d), views.job_items(spark, d), "v1").select("sample_id", "state", "retrieval_state")


def sample_details(spark: SparkSession, d: str) -> DataFrame:
    found = library.sample_detail(_content_samples(spark, d), _analysed(spark, d), views.job_items(spark, d), "v1")
    return found.withColumn("stored_versions", F.array_join("stored_versions", ","))


def pending(spark: SparkSession, d: str) -> DataFrame:
    return library.pending_analysis(_content_samples(spark, d), _analysed(spark, d).where("content % 3 = 1"), views.job_items(spark, d).where("item_id % 50 = 0"), "v1")


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    rows = library.with_states(_content_samples(spark, d), _analysed(spark, d), views.job_items(spark, d), "v1")
    return library.collapse(rows.withColumn("state", F.col("retrieval_state")))


def referenced(spark: SparkSession, d: str) -> DataFrame:
    li, e = read(spark, d, "lineitem"), read(spark, d, "events")
    return library.referenced(views.library(spark, d), li.where("l_quantity > 49").select(F.col("l_partkey").alias("sample_id")), e.where("event_type = 'error'").select((F.col("event_id") % 5000).alias("sample_id"))).select("sample_id", "role")


def roles_page(spark: SparkSession, d: str) -> DataFrame:
    return library.page(library.in_roles(library.search(views.library(spark, d), "E"), ["bass", "kick"], page=True), "sample_id", after=100, size=40).select("sample_id", "filename", "role", "has_more")


def empty_roles(spark: SparkSession, d: str) -> DataFrame:
    lib = views.library(spark, d)
    rows = library.in_roles(lib, [], page=True).select("sample_id", F.lit("page").alias("kind")).unionByName(library.in_roles(lib, [], page=False).select("sample_id", F.lit("retrieval").alias("kind")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def scoped(spark: SparkSession, d: str) -> DataFrame:
    return library.without_paths(library.under(views.library(spark, d), "brand#11")).select("sample_id", "filename", "role")


def counts(spark: SparkSession, d: str) -> DataFrame:
    return library.role_counts(views.library(spark, d).where("role <> 'kick'"))


def totals(spark: SparkSession, d: str) -> DataFrame:
    return library.library_totals(views.library(spark, d))


def last_errors(spark: SparkSession, d: str) -> DataFrame:
    return library.last_error(views.job_items(spark, d))


def versions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("sample_id"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("version"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    return library.latest_version(rows.distinct())


def tags(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.split(F.concat_ws("|", F.concat(F.lit(" "), "p_type"), F.lower("p_type"), "p_brand", F.lit(" "), F.upper("p_brand")), r"\|").alias("tags"))
    return rows.select("sample_id", F.array_join(library.normal_tags(F.col("tags")), ",").alias("tags"))


def upserted(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    batch = read(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("id"), F.col("l_quantity").cast("int").alias("v"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("int")).alias("seq"))
    return library.upsert(table, batch, ["id"])


def inserted(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    batch = read(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("id"), F.col("l_quantity").cast("int").alias("v"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("int")).alias("seq"))
    return library.insert_new(table, batch, ["id"])


def cascaded(spark: SparkSession, d: str) -> DataFrame:
    orders, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    parent, child = library.delete_cascade(orders.select(F.col("o_orderkey").alias("id")), [li.select(F.col("l_orderkey").alias("id"))], orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), "id")
    return parent.agg(F.count("*").alias("parents")).crossJoin(child.agg(F.count("*").alias("children")))


def repeated(spark: SparkSession, d: str) -> DataFrame:
    return library.duplicates(views.content(spark, d), ["sha"])


def admitted_files(spark: SparkSession, d: str) -> DataFrame:
    return dataset.admit_files(views.content(spark, d).withColumn("priority", F.col("source"))).select("sample_id", "decision")


def selected_files(spark: SparkSession, d: str) -> DataFrame:
    files = dataset.admit_files(views.content(spark, d).withColumn("priority", F.col("source"))).where("decision = 'kept'")
    return dataset.select_per_role(files).select("sample_id", "role", "selected")


def role_summary(spark: SparkSession, d: str) -> DataFrame:
    return dataset.role_summary(dataset.admit_files(views.content(spark, d).withColumn("priority", F.col("source"))), 100)


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """source, path: names that hint at a role, at both or at none, and folders that are closed to use."""
    folder = F.element_at(F.array(*(F.lit(x) for x in ("Drums/Kicks", "Low/Bass", "Low/808s", "Misc", "My-Demo Pack", "demonstration"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    name = F.element_at(F.array(*(F.lit(x) for x in ("Kick 01.wav", "bass_drum.wav", "Sub-A.wav", "subtle.wav", "808.WAV", "pad.kick.wav", "Bass.wav"))), (F.col("p_size") % 7 + 1).cast("int"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_brand").alias("source"), F.concat(folder, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(" "), name).alias("path"))


def role_hints(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("sample_id", F.array_join(dataset.role_hints(F.col("path")), ",").alias("hints"), dataset.restricted(F.col("path")).alias("restricted"))


def role_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Rules of folders for all sources, one of them in conflict below, and of single files."""
    files = _paths(spark, d)
    folders = spark.createDataFrame([("Drums", "kick", "r2", "drum"), ("Drums/Kicks", "kick", "r1", "one-shot"), ("Low", "bass", "r3", "synth"), ("Low/808s", "sub-bass", "r4", "long")], "path string, role string, rule_id string, subtype string")
    rules = files.select("source").distinct().crossJoin(F.broadcast(folders)).select("source", F.lit("category").alias("kind"), "path", "role", "rule_id", "subtype")
    single = files.where("sample_id % 5 = 0").select("source", F.lit("file").alias("kind"), "path", F.when(F.col("sample_id") % 10 == 0, "bass").otherwise("kick").alias("role"), F.lit("r0").alias("rule_id"), F.lit("hand").alias("subtype"))
    return dataset.role_evidence(files, rules.unionByName(single))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), (F.col("o_custkey") % 50).alias("session"), (F.col("o_custkey") % 7).alias("kick"))


def presentation(spark: SparkSession, d: str) -> DataFrame:
    return dataset.seeded_order(_pairs(spark, d), "seed-1").select("session", "pair_id", "position")


def adjacent(spark: SparkSession, d: str) -> DataFrame:
    return dataset.collisions(dataset.seeded_order(_pairs(spark, d), "seed-1"))


def repaired(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a session: after the repair no more kicks meet themselves than must."""
    pairs = read(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("session"), F.when(F.col("o_custkey") % 3 == 0, F.least(F.col("o_orderkey") % 9, F.lit(3))).otherwise(F.col("o_orderkey") % 4).alias("kick"))
    shown = dataset.repair_order(dataset.seeded_order(pairs, "seed-1"))
    sizes = shown.groupBy("session").agg(F.count("*").alias("pairs"), F.count_distinct("position").alias("positions"), F.sum("pair_id").alias("ids"))
    return dataset.collisions(shown).join(sizes, "session")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All kicks and all basses."""
    lib = views.library(spark, d).withColumn("identity", F.concat(F.lit("id-"), F.col("sample_id").cast("string")))
    return lib.where("role = 'kick'"), lib.where("role <> 'kick'")


def hashed_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dataset.hashed_pairs(*_sides(spark, d), "seed-1", "v1")


def covered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of the draw from a third of the basses and of its repair: how many of them have no slot."""
    kicks, basses = _sides(spark, d)
    basses = basses.where("sample_id % 3 = 0")
    drawn = dataset.hashed_pairs(kicks, basses, "seed-1", "v1")
    served = dataset.cover_basses(drawn, basses, "seed-1", "v1")
    return dataset.coverage(drawn, basses).withColumn("step", F.lit("drawn")).unionByName(dataset.coverage(served, basses).withColumn("step", F.lit("covered")))


def random_arm(spark: SparkSession, d: str) -> DataFrame:
    return dataset.random_arm(views.ratings(spark, d).select("query", "item").distinct(), "seed-1")


def held_back(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_pool(views.library(spark, d), "seed-1", 25).select("sample_id", "pool")


def assignment(spark: SparkSession, d: str) -> DataFrame:
    return dataset.balanced_assignment(_pairs(spark, d), 9, 2, "seed-1")


def bad_pairs(spark: SparkSession, d: str) -> DataFrame:
    samples = views.library(spark, d).select("sample_id", "role", (F.col("size") % 3).alias("rate"))
    pairs = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"), F.col("l_partkey").alias("kick_id"), (F.col("l_suppkey") * 21).alias("bass_id"))
    return dataset.pair_problems(pairs, samples)


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, d, "events")
    answers = e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 60).alias("presentation_index"), (F.col("event_id") % 60 + F.when(F.col("event_id") % 41 == 0, 1).otherwise(0)).alias("pair_id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("label"), (F.col("event_id") % 4 == 1).alias("skipped"), (F.col("event_id") % 3 == 0).alias("correction"), (F.col("user_id") % 2 == 0).alias("finished"),
    )
    return answers, answers.select("session_id").distinct().crossJoin(spark.range(58).select(F.col("id").alias("presentation_index"), F.col("id").alias("pair_id")))


def violations(spark: SparkSession, d: str) -> DataFrame:
    return dataset.session_violations(*_answers(spark, d))


def evicted(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("event_id").alias("cache_key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.char_length("props").alias("size"), F.col("event_type").alias("kind"))
    return cache.survivors(rows, 700, 20_000, by="kind").select("cache_key")


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return cache.stats(read(spark, d, "events").select(F.col("event_id").alias("cache_key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.char_length("props").alias("size"), F.when(F.col("event_type") == "view", "candidate").otherwise("judgment").alias("kind")))


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ask"), (F.col("l_partkey") * 3).alias("cache_key"))
    held = read(spark, d, "events").select(F.col("event_id").alias("cache_key"), (F.col("event_id") % 3 + 1).alias("schema_version"), F.when(F.col("event_id") % 10 > 0, F.col("props")).otherwise("{").alias("payload"))
    return cache.lookup(asked, held, [1, 2], "page string").select("ask", "hit", "miss_reason")


_SHA = "sha256('seed-1' || chr(10) || {0})"
_PAIRS_SQL = "p AS (SELECT o_orderkey AS pair_id, o_custkey % 50 AS session, o_custkey % 7 AS kick FROM orders)"
_ORDER = f"o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {_SHA.format('session || chr(10) || pair_id')}, pair_id) AS position FROM p)"
_ADMIT = "a AS (SELECT *, source AS priority, count(DISTINCT role) OVER (PARTITION BY sha) AS n_roles, row_number() OVER (PARTITION BY sha ORDER BY source, sample_id) AS nth FROM v_content), f AS (SELECT *, CASE WHEN n_roles > 1 THEN 'conflict' WHEN nth > 1 THEN 'duplicate' ELSE 'kept' END AS decision FROM a)"
_BATCH = "t AS (SELECT p_partkey AS id, p_size AS v FROM part), b AS (SELECT l_partkey * 2 AS id, CAST(l_quantity AS INTEGER) AS v, (l_orderkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS INTEGER) AS seq FROM lineitem)"
_STATES = f"""{JOBS_CTE}, {_SAMPLES}, {_ANALYSED},
flags AS (SELECT s.*, EXISTS (SELECT 1 FROM analysed a WHERE a.content = s.content AND version = 'v1') AS cur, EXISTS (SELECT 1 FROM analysed a WHERE a.content = s.content AND version <> 'v1') AS old,
  EXISTS (SELECT 1 FROM v_jobs j WHERE j.content = s.content AND version = 'v1' AND state IN ('pending', 'running')) AS pend, EXISTS (SELECT 1 FROM v_jobs j WHERE j.content = s.content AND version = 'v1' AND state = 'failed') AS fail FROM c_samples s),
states AS (SELECT *, CASE WHEN cur THEN 'current' WHEN old THEN 'stale' WHEN pend THEN 'pending' WHEN fail THEN 'failed' ELSE 'absent' END AS state, CASE WHEN cur THEN 'current' WHEN old THEN 'stale' ELSE 'absent' END AS retrieval_state FROM flags)"""

_PATHS = """paths AS (SELECT p_partkey AS sample_id, p_brand AS source, p_partkey || ' ' || (['Kick 01.wav', 'bass_drum.wav', 'Sub-A.wav', 'subtle.wav', '808.WAV', 'pad.kick.wav', 'Bass.wav'])[p_size % 7 + 1] AS name,
  (['Drums/Kicks', 'Low/Bass', 'Low/808s', 'Misc', 'My-Demo Pack', 'demonstration'])[p_partkey % 6 + 1] || '/' || p_partkey || ' ' || (['Kick 01.wav', 'bass_drum.wav', 'Sub-A.wav', 'subtle.wav', '808.WAV', 'pad.kick.wav', 'Bass.wav'])[p_size % 7 + 1] AS path FROM part)"""


def _drawn(only: str = "") -> str:
    return f"""sk AS (SELECT 'id-' || sample_id AS query FROM v_library WHERE role = 'kick' ORDER BY sha256('seed-1' || chr(10) || 'v1' || chr(10) || 'query' || chr(10) || 'id-' || sample_id), 'id-' || sample_id LIMIT 60),
sb AS (SELECT 'id-' || sample_id AS bass FROM v_library WHERE role <> 'kick'{only}),
drawn AS (SELECT query, bass, row_number() OVER (PARTITION BY query ORDER BY sha256('seed-1' || chr(10) || 'v1' || chr(10) || 'pair' || chr(10) || query || chr(10) || bass), bass) - 1 AS slot FROM sk, sb QUALIFY slot < 5)"""


_DETAIL = f"""{_STATES}, it AS (SELECT content, arg_max({{'state': state, 'attempts': attempts, 'error_code': error_code, 'finished_at': finished_at}}, item_id) AS i FROM v_jobs WHERE version = 'v1' GROUP BY content), sv AS (SELECT content, string_agg(version, ',' ORDER BY version) AS stored_versions FROM analysed GROUP BY content)"""

QUERIES = {
    "M5_sample_details": (
        sample_details,
        f"""WITH {_DETAIL} SELECT s.sample_id, s.content, s.path_key, s.file_status, s.state, CASE WHEN s.state = 'current' THEN 'v1' END AS analysis_version, CASE WHEN i.state = 'complete' THEN i.finished_at END AS analyzed_at, i.attempts AS attempts, i.error_code AS error_code, coalesce(stored_versions, '') AS stored_versions
FROM states s LEFT JOIN it ON it.content = s.content LEFT JOIN sv ON sv.content = s.content""",
    ),
    "F16_F17_J2_analysis_states": (states, f"WITH {_STATES} SELECT sample_id, state, retrieval_state FROM states"),
    "J4_W8_pending_analysis": (
        pending,
        f"""WITH {JOBS_CTE}, {_SAMPLES}, {_ANALYSED} SELECT content, arg_min(sample_id, (path_key, sample_id)) AS sample_id FROM c_samples s WHERE file_status <> 'missing'
AND NOT EXISTS (SELECT 1 FROM analysed a WHERE a.content = s.content AND version = 'v1' AND content % 3 = 1) AND NOT EXISTS (SELECT 1 FROM v_jobs j WHERE j.content = s.content AND version = 'v1' AND item_id % 50 = 0) GROUP BY content""",
    ),
    "G10_collapse": (collapsed, f"WITH {_STATES} SELECT content, arg_min(sample_id, path_key) AS sample_id, count(*) AS n_rows, count(*) FILTER (WHERE retrieval_state = 'stale') AS n_stale, count(*) FILTER (WHERE retrieval_state = 'absent') AS n_absent FROM states GROUP BY content"),
    "J3_J7_D1_referenced": (referenced, f"WITH {LIBRARY_CTE} SELECT sample_id, role FROM v_library WHERE sample_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) OR sample_id IN (SELECT event_id % 5000 FROM events WHERE event_type = 'error')"),
    "F8_F9_L3_page": (roles_page, f"WITH {LIBRARY_CTE}, m AS (SELECT * FROM v_library WHERE role IN ('bass', 'kick') AND instr(lower(filename), 'e') > 0 AND sample_id > 100 ORDER BY sample_id LIMIT 41) SELECT sample_id, filename, role, (SELECT count(*) FROM m) > 40 AS has_more FROM m ORDER BY sample_id LIMIT 40"),
    "F8_empty_role_list": (empty_roles, "SELECT 'page' AS kind, count(*) AS n FROM part"),
    "F10_F13_scope_without_paths": (scoped, f"WITH {LIBRARY_CTE} SELECT sample_id, filename, role FROM v_library WHERE starts_with(path_key, 'brand#11/')"),
    "G1_role_counts": (counts, f"WITH {LIBRARY_CTE} SELECT r.role, count(l.sample_id) AS n FROM (VALUES ('kick'), ('bass'), ('sub-bass')) r(role) LEFT JOIN (SELECT * FROM v_library WHERE role <> 'kick') l USING (role) GROUP BY r.role"),
    "G1_library_totals": (totals, f"WITH {LIBRARY_CTE} SELECT count(*) AS total, count(DISTINCT regexp_extract(path_key, '^(.*)/[^/]*$', 1)) AS folders FROM v_library"),
    "W7_last_error": (last_errors, f"WITH {JOBS_CTE} SELECT content, arg_max(error_code, item_id) AS error_code FROM v_jobs WHERE error_code IS NOT NULL GROUP BY content"),
    "W6_latest_version": (versions, "SELECT sample_id, version, created_at FROM (SELECT l_partkey AS sample_id, 'v' || l_linenumber AS version, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, 'v' || l_linenumber) AS n FROM lineitem) WHERE n = 1"),
    "F19_normal_tags": (tags, "SELECT p_partkey AS sample_id, lower(p_type) || ',' || lower(p_brand) AS tags FROM part"),
    "D7_upsert": (upserted, f"WITH {_BATCH}, n AS (SELECT id, arg_max(v, seq) AS v FROM b GROUP BY id) SELECT coalesce(n.id, t.id) AS id, coalesce(n.v, t.v) AS v FROM t FULL JOIN n ON n.id = t.id"),
    "D6_insert_new": (inserted, f"WITH {_BATCH}, n AS (SELECT id, arg_min(v, seq) AS v FROM b GROUP BY id) SELECT id, v FROM t UNION ALL SELECT id, v FROM n WHERE id NOT IN (SELECT id FROM t)"),
    "M7_delete_cascade": (cascaded, "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS parents, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS children"),
    "D8_duplicates": (repeated, f"WITH {CONTENT_CTE} SELECT sha, count(*) AS n FROM v_content GROUP BY sha HAVING count(*) > 1"),
    "D4_admit_files": (admitted_files, f"WITH {CONTENT_CTE}, {_ADMIT} SELECT sample_id, decision FROM f"),
    "W4_select_per_role": (selected_files, f"WITH {CONTENT_CTE}, {_ADMIT} SELECT sample_id, role, row_number() OVER (PARTITION BY role ORDER BY priority, sample_id) <= 100 AS selected FROM f WHERE decision = 'kept'"),
    "G21_role_summary": (role_summary, f"WITH {CONTENT_CTE}, {_ADMIT} SELECT role, count(*) AS candidates, count(*) FILTER (WHERE decision = 'kept') AS kept, count(*) FILTER (WHERE decision = 'conflict') AS conflicts, greatest(100 - count(*) FILTER (WHERE decision = 'kept'), 0) AS shortfall FROM f GROUP BY role"),
    "F14_role_hints": (
        role_hints,
        f"""WITH {_PATHS}, h AS (SELECT sample_id, path, lower(regexp_replace(name, '\\.[^.]+$', '')) AS n FROM paths)
SELECT sample_id, concat_ws(',', CASE WHEN n LIKE '%kick%' OR regexp_matches(n, 'bass[ _-]?drum') THEN 'kick' END, CASE WHEN n LIKE '%bass%' OR n LIKE '%808%' OR regexp_matches(n, '(^|[ _-])sub([ _-]|$)') THEN 'bass' END) AS hints,
  len(list_filter(string_split(path, '/'), lambda x: regexp_matches(lower(x), '(^|[ ._-])(demo|preview|misc)([ ._-]|$)'))) > 0 AS restricted FROM h""",
    ),
    "F14_role_evidence": (
        role_evidence,
        f"""WITH {_PATHS}, hits AS (SELECT source, path, 'kick' AS role, 'trusted_category' AS method, 'r2' AS rule_id, 'drum' AS subtype FROM paths WHERE path LIKE 'Drums/%' UNION ALL SELECT source, path, 'kick', 'trusted_category', 'r1', 'one-shot' FROM paths WHERE path LIKE 'Drums/Kicks/%'
  UNION ALL SELECT source, path, 'bass', 'trusted_category', 'r3', 'synth' FROM paths WHERE path LIKE 'Low/%' UNION ALL SELECT source, path, 'sub-bass', 'trusted_category', 'r4', 'long' FROM paths WHERE path LIKE 'Low/808s/%'
  UNION ALL SELECT source, path, CASE WHEN sample_id % 10 = 0 THEN 'bass' ELSE 'kick' END, 'reviewed_mapping', 'r0', 'hand' FROM paths WHERE sample_id % 5 = 0),
g AS (SELECT source, path, count(DISTINCT role) AS roles, arg_min({{'role': role, 'method': method, 'rule_id': rule_id, 'subtype': subtype}}, rule_id) AS r FROM hits GROUP BY source, path)
SELECT p.source, p.path, CASE WHEN roles = 1 THEN r.role END AS role, CASE WHEN roles = 1 THEN r.method END AS method, CASE WHEN roles = 1 THEN r.rule_id END AS rule_id, CASE WHEN roles = 1 THEN r.subtype END AS subtype,
  CASE WHEN roles > 1 THEN 'conflicting_role_evidence' WHEN roles IS NULL THEN 'unconfirmed_role' END AS problem FROM paths p LEFT JOIN g ON g.source = p.source AND g.path = p.path""",
    ),
    "X14_R20_seeded_order": (presentation, f"WITH {_PAIRS_SQL}, {_ORDER} SELECT session, pair_id, CAST(position AS INTEGER) AS position FROM o"),
    "W10_collisions": (adjacent, f"WITH {_PAIRS_SQL}, {_ORDER}, l AS (SELECT session, kick = lag(kick) OVER (PARTITION BY session ORDER BY position) AS same FROM o) SELECT session, count(*) FILTER (WHERE same) AS collisions FROM l GROUP BY session"),
    "R20_repaired_order": (
        repaired,
        """WITH p AS (SELECT o_orderkey, o_custkey AS session, CASE WHEN o_custkey % 3 = 0 THEN least(o_orderkey % 9, 3) ELSE o_orderkey % 4 END AS kick FROM orders), k AS (SELECT session, kick, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT session, max(n) AS most FROM k GROUP BY session)
SELECT p.session, count(*) AS pairs, count(*) AS positions, CAST(sum(o_orderkey) AS BIGINT) AS ids, greatest(2 * max(most) - count(*) - 1, 0) AS collisions FROM p JOIN m USING (session) GROUP BY p.session""",
    ),
    "R19_hashed_pairs": (hashed_pairs, f"WITH {LIBRARY_CTE}, {_drawn()} SELECT query, CAST(slot AS INTEGER) AS slot, bass FROM drawn"),
    "R19_coverage": (
        covered_pairs,
        f"""WITH {LIBRARY_CTE}, {_drawn(' AND sample_id % 3 = 0')}, c AS (SELECT count(DISTINCT query) AS queries, count(*) AS pairs, (SELECT count(*) FROM sb) AS basses, count(DISTINCT bass) AS seen FROM drawn)
SELECT 'drawn' AS step, queries, pairs, basses, basses - seen AS uncovered FROM c UNION ALL SELECT 'covered', queries, pairs, basses, greatest(basses - pairs, 0) FROM c""",
    ),
    "X15_R15_random_arm": (random_arm, None),
    "R19_pool_split": (held_back, f"WITH {LIBRARY_CTE} SELECT sample_id, CASE WHEN row_number() OVER (PARTITION BY role ORDER BY {_SHA.format('sample_id')}, sample_id) <= 25 THEN 'held_back' ELSE 'tuning' END AS pool FROM v_library"),
    "R19_balanced_assignment": (assignment, f"WITH {_PAIRS_SQL} SELECT pair_id, CAST((CAST('0x' || substr({_SHA.format('pair_id')}, 1, 12) AS BIGINT) % 9 + s) % 9 AS INTEGER) AS evaluator FROM p, (VALUES (0), (1)) v(s)"),
    "R21_pair_problems": (
        bad_pairs,
        f"""WITH {LIBRARY_CTE}, p AS (SELECT l_orderkey * 10 + l_linenumber AS pair_id, l_partkey AS kick_id, l_suppkey * 21 AS bass_id FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY kick_id, bass_id ORDER BY pair_id) AS nth FROM p),
j AS (SELECT n.*, k.role AS kr, b.role AS br, k.size % 3 AS k_rate, b.size % 3 AS b_rate FROM n LEFT JOIN v_library k ON k.sample_id = kick_id LEFT JOIN v_library b ON b.sample_id = bass_id)
SELECT pair_id, problem FROM (SELECT pair_id, CASE WHEN nth > 1 THEN 'duplicate' WHEN kr IS NULL OR br IS NULL THEN 'unknown_sample' WHEN kr <> 'kick' OR br = 'kick' THEN 'role_mismatch' WHEN k_rate <> b_rate THEN 'rate_mismatch' END AS problem FROM j) WHERE problem IS NOT NULL""",
    ),
    "R22_session_violations": (
        violations,
        """WITH a AS (SELECT user_id AS session_id, event_id AS seq, event_id % 60 AS pi, event_id % 60 + CASE WHEN event_id % 41 = 0 THEN 1 ELSE 0 END AS pair_id,
  CASE WHEN event_type <> 'view' THEN event_type END AS label, event_id % 4 = 1 AS skipped, event_id % 3 = 0 AS correction, user_id % 2 = 0 AS finished FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY session_id, pi ORDER BY seq) - 1 AS seen, count(*) FILTER (WHERE NOT correction) OVER (PARTITION BY session_id, pi ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answered FROM a),
v AS (SELECT session_id, seq, unnest([CASE WHEN pi >= 58 THEN 'unknown_presentation' END, CASE WHEN pi < 58 AND pi <> pair_id THEN 'pair_mismatch' END, CASE WHEN skipped AND label IS NOT NULL THEN 'skipped_with_label' END,
  CASE WHEN NOT skipped AND label IS NULL THEN 'answer_without_label' END, CASE WHEN correction AND seen = 0 THEN 'correction_of_nothing' END, CASE WHEN NOT correction AND answered > 0 THEN 'duplicate_answer' END]) AS violation FROM w)
SELECT session_id, seq, violation FROM v WHERE violation IS NOT NULL
UNION ALL SELECT session_id, NULL, 'finished_with_open_presentations' FROM a WHERE finished GROUP BY session_id HAVING count(DISTINCT CASE WHEN pi < 58 THEN pi END) < 58""",
    ),
    "W5_Q11_cache_eviction": (
        evicted,
        """WITH r AS (SELECT event_id AS cache_key, event_type AS kind, count(*) OVER w AS n, sum(length(props)) OVER w AS size FROM events WINDOW w AS (PARTITION BY event_type ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%SZ') DESC, event_id DESC ROWS UNBOUNDED PRECEDING))
SELECT cache_key FROM r WHERE n <= 700 AND size <= 20000""",
    ),
    "G4_Q11_cache_stats": (
        cache_stats,
        "SELECT count(*) AS entries, count(*) FILTER (WHERE event_type <> 'view') AS judgments, count(*) FILTER (WHERE event_type = 'view') AS candidates, CAST(coalesce(sum(length(props)), 0) AS BIGINT) AS total_size, min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS oldest, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS newest FROM events",
    ),
    "J17_Q10_cache_lookup": (
        cache_lookup,
        "SELECT l_orderkey * 10 + l_linenumber AS ask, e.event_id IS NOT NULL AND e.event_id % 3 < 2 AND e.event_id % 10 > 0 AS hit, CASE WHEN e.event_id IS NULL THEN 'absent' WHEN e.event_id % 3 = 2 THEN 'version_unsupported' WHEN e.event_id % 10 = 0 THEN 'cache_corrupt' END AS miss_reason FROM lineitem LEFT JOIN events e ON e.event_id = l_partkey * 3",
    ),
}
