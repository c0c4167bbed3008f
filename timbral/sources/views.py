"""Deterministic stand-ins for a sample library, made from general tables.

The test tables hold no audio.  Each view below maps one of them onto the shape
that an operator reads, as a DataFrame and, with the same rules, as SQL text for
an independent check.  Only built-in expressions are used; all filters and
column choices reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbral.schemas import BANDS, MEASURES, TONICS

#: measure: (place in the embedding, factor, offset, largest value)
SPEC: dict[str, tuple[int, float, float, float]] = {
    "fundamental": (1, 1000.0, 30.0, 1e9),
    "spectral_centroid": (2, 8000.0, 100.0, 1e9),
    "spectral_rolloff": (3, 12000.0, 200.0, 1e9),
    "rms": (4, 0.5, 0.0, 1e9),
    "peak": (5, 0.9, 0.0, 1e9),
    "crest_factor": (6, 20.0, 1.0, 1e9),
    "loudness": (7, 200.0, -60.0, 1e9),
    "transient_strength": (8, 4.0, 0.0, 1.0),
    "transient_position": (9, 500.0, 0.0, 1e9),
    "attack": (10, 100.0, 0.0, 1e9),
    "decay": (11, 800.0, 0.0, 1e9),
    "tempo": (12, 400.0, 60.0, 1e9),
} | {band: (13 + k, 0.5, 0.0, 1.0) for k, band in enumerate(BANDS)}
#: A coordinate this small is an unknown measure.
UNKNOWN = 0.02
VERSION = "v1"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _x(place: int) -> F.Column:
    return F.abs(F.col("embedding")[place - 1].cast("double"))


def _wide_columns() -> list[F.Column]:
    out = []
    for name, (place, factor, offset, top) in SPEC.items():
        out.append(F.when(_x(place) > UNKNOWN, F.least(_x(place) * factor + offset, F.lit(top))).alias(name))
    out.append(F.lit(None).cast("double").alias("stereo_width"))
    for name, place in (("fundamental", 19), ("tempo", 20)):
        out.append(F.when(_x(SPEC[name][0]) > UNKNOWN, F.least(_x(place) * 3.0 + 0.6, F.lit(1.0))).alias(f"{name}_confidence"))
    known = _x(21) > UNKNOWN
    tonic = F.array(*(F.lit(t) for t in TONICS))[(F.floor(_x(21) * 100.0) % 12).cast("int")]
    out.append(F.when(known, tonic).alias("key_tonic"))
    out.append(F.when(known, F.when(F.col("embedding")[21].cast("double") > 0, "major").otherwise("minor")).alias("key_mode"))
    out.append(F.when(known, F.least(_x(23) * 3.0 + 0.6, F.lit(1.0))).alias("key_confidence"))
    return out


def wide_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sample: id, role, version, availability, frames, 19 measures, confidences and key."""
    label = F.col("label")
    role = F.when(label == 0, "kick").when(label <= 4, "bass").otherwise("sub-bass")
    version = F.when(F.col("vec_id") % 17 == 0, "v0").otherwise(VERSION)
    state = F.when(F.col("vec_id") % 10 == 3, "missing").when(F.col("vec_id") % 10 == 7, "unreadable").when(F.col("vec_id") % 25 != 4, "available")
    frames = F.when(F.col("embedding")[23].cast("double").between(0.0, 0.005), 0).otherwise(48000).cast("long")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), role.alias("role"), version.alias("analysis_version"), state.alias("availability"), frames.alias("frame_count"), *_wide_columns())


def _sql_x(place: int) -> str:
    return f"abs(CAST(embedding[{place}] AS DOUBLE))"


def _sql_wide() -> str:
    parts = [f"CASE WHEN {_sql_x(p)} > {UNKNOWN} THEN least({_sql_x(p)} * CAST({f} AS DOUBLE) + CAST({o} AS DOUBLE), CAST({t} AS DOUBLE)) END AS {n}" for n, (p, f, o, t) in SPEC.items()]
    parts.append("CAST(NULL AS DOUBLE) AS stereo_width")
    for name, place in (("fundamental", 19), ("tempo", 20)):
        parts.append(f"CASE WHEN {_sql_x(SPEC[name][0])} > {UNKNOWN} THEN least({_sql_x(place)} * CAST(3.0 AS DOUBLE) + CAST(0.6 AS DOUBLE), CAST(1.0 AS DOUBLE)) END AS {name}_confidence")
    tonics = ", ".join(f"'{t}'" for t in TONICS)
    parts.append(f"CASE WHEN {_sql_x(21)} > {UNKNOWN} THEN ([{tonics}])[CAST(floor({_sql_x(21)} * CAST(100.0 AS DOUBLE)) AS BIGINT) % 12 + 1] END AS key_tonic")
    parts.append(f"CASE WHEN {_sql_x(21)} > {UNKNOWN} THEN CASE WHEN embedding[22] > 0 THEN 'major' ELSE 'minor' END END AS key_mode")
    parts.append(f"CASE WHEN {_sql_x(21)} > {UNKNOWN} THEN least({_sql_x(23)} * CAST(3.0 AS DOUBLE) + CAST(0.6 AS DOUBLE), CAST(1.0 AS DOUBLE)) END AS key_confidence")
    return ",\n  ".join(parts)


#: The same view as a common table expression.
SAMPLES_CTE = f"""v_samples AS (
SELECT vec_id AS sample_id, CASE WHEN label = 0 THEN 'kick' WHEN label <= 4 THEN 'bass' ELSE 'sub-bass' END AS role,
  CASE WHEN vec_id % 17 = 0 THEN 'v0' ELSE '{VERSION}' END AS analysis_version,
  CASE WHEN vec_id % 10 = 3 THEN 'missing' WHEN vec_id % 10 = 7 THEN 'unreadable' WHEN vec_id % 25 <> 4 THEN 'available' END AS availability,
  CAST(CASE WHEN CAST(embedding[24] AS DOUBLE) BETWEEN 0.0 AND 0.005 THEN 0 ELSE 48000 END AS BIGINT) AS frame_count,
  {_sql_wide()}
FROM embeddings)"""


def long_features(wide: DataFrame) -> DataFrame:
    """Stored form: a row for each sample and measure, with a reason for each unknown value."""
    confident = {"fundamental", "tempo"}
    entries = [
        F.struct(
            F.lit(name).alias("measurement"),
            F.lit(unit).alias("unit"),
            F.col(name).alias("value"),
            F.when(F.col(name).isNull(), "not_implemented" if name == "stereo_width" else "below_floor").alias("unavailable_reason"),
            (F.col(f"{name}_confidence") if name in confident else F.lit(None).cast("double")).alias("confidence"),
        )
        for name, (unit, _, _) in MEASURES.items()
    ]
    return wide.select("sample_id", "analysis_version", F.explode(F.array(*entries)).alias("m")).select("sample_id", "analysis_version", "m.*")


def stored_keys(wide: DataFrame) -> DataFrame:
    reason = F.when(F.col("key_tonic").isNull(), "insufficient_duration")
    return wide.select("sample_id", "analysis_version", F.col("key_tonic").alias("tonic"), F.col("key_mode").alias("mode"), F.col("key_confidence").alias("confidence"), reason.alias("unavailable_reason"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_id, dimension, label (null: abstained), confidence: some candidates have none for some dimensions."""
    from timbral.schemas import DIMENSIONS, LABEL_SCORES

    labels = F.array(*(F.lit(x) for x in LABEL_SCORES))
    rows = []
    for k, dimension in enumerate(DIMENSIONS):
        x = _x(25 + k)
        label = F.when(x > 0.03, labels[(F.floor(x * 100.0) % 5).cast("int")])
        rows.append(F.struct(F.lit(dimension).alias("dimension"), label.alias("label"), F.least(x * 4.0 + 0.5, F.lit(1.0)).alias("confidence"), (x > 0.01).alias("asked")))
    wide = read(spark, sf_dir, "embeddings").where("label > 0")
    return wide.select(F.col("vec_id").alias("candidate_id"), F.explode(F.array(*rows)).alias("j")).select("candidate_id", "j.*").where("asked").drop("asked")


def _judgments_cte() -> str:
    from timbral.schemas import DIMENSIONS, LABEL_SCORES

    labels = ", ".join(f"'{x}'" for x in LABEL_SCORES)
    parts = [
        f"SELECT vec_id AS candidate_id, '{d}' AS dimension, CASE WHEN {_sql_x(25 + k)} > 0.03 THEN ([{labels}])[CAST(floor({_sql_x(25 + k)} * CAST(100.0 AS DOUBLE)) AS BIGINT) % 5 + 1] END AS label, "
        f"least({_sql_x(25 + k)} * CAST(4.0 AS DOUBLE) + CAST(0.5 AS DOUBLE), CAST(1.0 AS DOUBLE)) AS confidence FROM embeddings WHERE label > 0 AND {_sql_x(25 + k)} > 0.01"
        for k, d in enumerate(DIMENSIONS)
    ]
    return "v_judgments AS (\n" + "\nUNION ALL\n".join(parts) + ")"


JUDGMENTS_CTE = _judgments_cte()


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, item, evaluator, rating (0..3), seq: ratings in the order that they were given."""
    li = read(spark, sf_dir, "lineitem")
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    return li.select((F.col("l_orderkey") % 300).alias("query"), (F.col("l_partkey") % 20).alias("item"), F.col("l_suppkey").alias("evaluator"), (F.col("l_quantity").cast("int") % 4).alias("rating"), seq, F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))


RATINGS_CTE = """v_ratings AS (
SELECT l_orderkey % 300 AS query, l_partkey % 20 AS item, l_suppkey AS evaluator, CAST(l_quantity AS INTEGER) % 4 AS rating,
  l_orderkey * 10 + l_linenumber AS seq, l_extendedprice AS price, l_discount AS discount FROM lineitem)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, happened_at (UTC text), project_id, candidate_id, event_type; a removal names the selection before it in its project and candidate."""
    kinds = F.create_map(*(F.lit(x) for pair in (("click", "auditioned"), ("purchase", "selected"), ("error", "removed"), ("signup", "rejected")) for x in pair))
    e = read(spark, sf_dir, "events")
    return e.where("event_type <> 'view'").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("happened_at"), F.col("user_id").alias("project_id"), (F.col("event_id") % 7).alias("candidate_id"), kinds[F.col("event_type")].alias("event_type"), F.col("value")
    )


OUTCOMES_CTE = """v_outcomes AS (
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS happened_at, user_id AS project_id, event_id % 7 AS candidate_id,
  CASE event_type WHEN 'click' THEN 'auditioned' WHEN 'purchase' THEN 'selected' WHEN 'error' THEN 'removed' WHEN 'signup' THEN 'rejected' END AS event_type, value
FROM events WHERE event_type <> 'view')"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions of the outcome log (timbral.streaming.outcomes.SUBMISSION) with happened_at; every refusal occurs among them."""
    n, user = F.col("event_id") + 1, F.col("user_id")
    kinds = F.create_map(*(F.lit(x) for pair in (("click", "auditioned"), ("purchase", "selected"), ("error", "removed"), ("signup", "rejected"), ("view", "auditioned")) for x in pair))
    e = read(spark, sf_dir, "events").select(n.alias("n"), user.alias("u"), (n % 3).alias("c"), kinds[F.col("event_type")].alias("kind"), "ts")
    mine = Window.partitionBy("u", "c").orderBy("n")
    same = Window.partitionBy("u", "c", "kind").orderBy("n")
    selected = F.last(F.when(F.col("kind") == "selected", F.col("n")), ignorenulls=True).over(mine.rowsBetween(Window.unboundedPreceding, -1))
    removal = F.col("kind") == "removed"
    names = F.when(removal, F.when(F.col("n") % 11 == 0, F.col("n") - 1).otherwise(F.coalesce("selected", F.lit(1).cast("long"))))
    told = lambda value: F.when(~removal, value)
    project = F.when(F.col("n") % 53 == 1, "proj-none").otherwise(F.concat(F.lit("proj-"), ((F.col("u") + F.when(F.col("n") % 61 == 1, 1).otherwise(0)) % 20).cast("string")))
    palette = F.when(F.col("n") % 59 == 1, "pal-none").otherwise(F.concat(F.lit("pal-"), F.col("u").cast("string")))
    client = F.when(F.col("n") % 71 == 1, "no id").otherwise(F.concat(F.lit("c-"), F.when(F.col("n") % 13 == 0, F.coalesce("again", "n")).when(F.col("n") % 17 == 0, F.coalesce("other", "n")).otherwise(F.col("n")).cast("string")))
    e = e.withColumns({"selected": selected, "again": F.lag("n").over(same), "other": F.lag("n").over(Window.partitionBy("u").orderBy("n"))})
    return e.select(
        F.col("n").alias("event_id"),
        client.alias("client_event_id"),
        F.col("kind").alias("event_type"),
        told(project).alias("project_id"),
        told(palette).alias("palette_id"),
        told(F.when(F.col("n") % 67 == 1, 99).otherwise(1)).cast("long").alias("palette_revision"),
        told(F.lit("run-1")).alias("run_id"),
        told(F.concat(F.lit("cand-"), F.col("c").cast("string"))).alias("candidate_id"),
        told(F.lit("ranking-1")).alias("ranking_version"),
        told(F.when(F.col("n") % 73 == 1, "other").otherwise("hybrid")).alias("mode"),
        told(F.lit("v1")).alias("candidate_analysis_version"),
        names.alias("removes_event_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("happened_at"),
    )


def outcome_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects, palettes, and what palettes gained (before most selections) and lost (before most removals)."""
    e = read(spark, sf_dir, "events")
    palettes = e.select("user_id").distinct().select(F.concat(F.lit("pal-"), F.col("user_id").cast("string")).alias("palette_id"), F.concat(F.lit("proj-"), (F.col("user_id") % 20).cast("string")).alias("project_id"), F.lit(3).cast("long").alias("revision"))
    n = F.col("event_id") + 1
    gained, lost = (F.col("event_type") == "purchase") & (n % 5 > 0), (F.col("event_type") == "error") & (n % 7 > 0)
    changes = e.where(gained | lost).select(F.concat(F.lit("pal-"), F.col("user_id").cast("string")).alias("palette_id"), F.concat(F.lit("cand-"), (n % 3).cast("string")).alias("candidate_id"), n.alias("at"), gained.alias("active"))
    return palettes.select("project_id").distinct(), palettes, changes


#: submissions() and, as of each, whether its candidate is active; both as SQL.
SUBMISSIONS_CTE = """ev AS (SELECT event_id + 1 AS n, user_id AS u, (event_id + 1) % 3 AS c, CASE event_type WHEN 'purchase' THEN 'selected' WHEN 'error' THEN 'removed' WHEN 'signup' THEN 'rejected' ELSE 'auditioned' END AS kind, ts FROM events),
ew AS (SELECT *, last_value(CASE WHEN kind = 'selected' THEN n END IGNORE NULLS) OVER (PARTITION BY u, c ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS selected,
  lag(n) OVER (PARTITION BY u, c, kind ORDER BY n) AS again, lag(n) OVER (PARTITION BY u ORDER BY n) AS other FROM ev),
v_submissions AS (SELECT n AS event_id, CASE WHEN n % 71 = 1 THEN 'no id' ELSE 'c-' || CASE WHEN n % 13 = 0 THEN coalesce(again, n) WHEN n % 17 = 0 THEN coalesce(other, n) ELSE n END END AS client, kind,
  CASE WHEN kind <> 'removed' THEN CASE WHEN n % 53 = 1 THEN 'proj-none' ELSE 'proj-' || (u + CASE WHEN n % 61 = 1 THEN 1 ELSE 0 END) % 20 END END AS project, CASE WHEN kind <> 'removed' THEN CASE WHEN n % 59 = 1 THEN 'pal-none' ELSE 'pal-' || u END END AS palette,
  CASE WHEN kind <> 'removed' THEN CASE WHEN n % 67 = 1 THEN 99 ELSE 1 END END AS revision, CASE WHEN kind <> 'removed' THEN 'cand-' || c END AS candidate, CASE WHEN kind <> 'removed' THEN CASE WHEN n % 73 = 1 THEN 'other' ELSE 'hybrid' END END AS mode,
  CASE WHEN kind = 'removed' THEN CASE WHEN n % 11 = 0 THEN n - 1 ELSE coalesce(selected, 1) END END AS names, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS happened_at FROM ew),
ch AS (SELECT 'pal-' || user_id AS palette, 'cand-' || (event_id + 1) % 3 AS candidate, event_id + 1 AS moment, event_type = 'purchase' AS active FROM events WHERE event_type = 'purchase' AND (event_id + 1) % 5 > 0 OR event_type = 'error' AND (event_id + 1) % 7 > 0)"""


def job_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, run_id, content, version, state, attempts, error_code, finished_at."""
    e = read(spark, sf_dir, "events")
    state = F.element_at(F.array(*(F.lit(s) for s in ("pending", "running", "complete", "failed", "cancelled", "superseded", "orphaned"))), (F.col("event_id") % 7 + 1).cast("int"))
    error = F.when(F.col("event_id") % 7 == 3, F.when(F.col("value") > 50, "io_error").otherwise("invalid_audio"))
    return e.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("run_id"), (F.col("event_id") % 997).alias("content"), F.when(F.col("event_id") % 2 == 0, "v1").otherwise("v2").alias("version"), state.alias("state"), (F.col("event_id") % 4).cast("int").alias("attempts"), error.alias("error_code"), F.when(F.col("event_id") % 7 > 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("finished_at"))


JOBS_CTE = """v_jobs AS (
SELECT event_id AS item_id, user_id AS run_id, event_id % 997 AS content, CASE WHEN event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS version,
  (['pending','running','complete','failed','cancelled','superseded','orphaned'])[event_id % 7 + 1] AS state, CAST(event_id % 4 AS INTEGER) AS attempts,
  CASE WHEN event_id % 7 = 3 THEN CASE WHEN value > 50 THEN 'io_error' ELSE 'invalid_audio' END END AS error_code,
  CASE WHEN event_id % 7 > 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS finished_at
FROM events)"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, filename, path_key, role, size of a browsable library."""
    role = F.when(F.col("p_type").like("PROMO%"), "kick").when(F.col("p_size") % 2 == 0, "bass").otherwise("sub-bass")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("filename"), F.concat(F.lower("p_brand"), F.lit("/"), F.lower("p_name")).alias("path_key"), role.alias("role"), F.col("p_size").alias("size"))


LIBRARY_CTE = """v_library AS (
SELECT p_partkey AS sample_id, p_name AS filename, lower(p_brand) || '/' || lower(p_name) AS path_key,
  CASE WHEN p_type LIKE 'PROMO%' THEN 'kick' WHEN p_size % 2 = 0 THEN 'bass' ELSE 'sub-bass' END AS role, p_size AS size FROM part)"""


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, sha, role (from lang), source: files by content."""
    role = F.when(F.col("lang") == "en", "kick").when(F.col("lang") == "fr", "bass").otherwise("sub-bass")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.sha2("text", 256).alias("sha"), role.alias("role"), "source")


CONTENT_CTE = """v_content AS (
SELECT doc_id AS sample_id, sha256(text) AS sha, CASE WHEN lang = 'en' THEN 'kick' WHEN lang = 'fr' THEN 'bass' ELSE 'sub-bass' END AS role, source
FROM documents)"""
