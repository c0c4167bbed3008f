"""Registered queries of admission, retrieval and ranking, each with SQL that states the same rules anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.functions.durable import durable
from timbral.operators import admission, ranking, retrieval
from timbral.operators.library import pivot_features
from timbral.schemas import BANDS, DIMENSIONS, LABEL_SCORES, MEASURES, TONICS
from timbral.sources import views
from timbral.sources.views import JUDGMENTS_CTE, SAMPLES_CTE

SONG = admission.Song(tempo=110.0, tonic="C", mode="major")
POLICY = admission.Policy(tempo_lock=True, exact_key_lock=True)
DIGITS = 9


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return views.wide_samples(spark, d)


def _kicks(spark: SparkSession, d: str) -> DataFrame:
    """The query set: the admissible kicks of the current version."""
    return admission.admissible_kick(_wide(spark, d)).where(f"analysis_version = '{views.VERSION}'")


def _admitted(spark: SparkSession, d: str) -> DataFrame:
    return admission.admit(_wide(spark, d).where("role <> 'kick'"), F.lit(-1), POLICY, SONG)


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    return _admitted(spark, d).where("eligible").where(f"analysis_version = '{views.VERSION}'")


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fit(retrieval.population(_wide(spark, d), views.VERSION))


def pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = _wide(spark, d)
    return pivot_features(views.long_features(wide), views.stored_keys(wide)).select("sample_id", "analysis_version", *MEASURES, "fundamental_confidence", "tempo_confidence", "key_tonic", "key_mode", "key_confidence")


def admit(spark: SparkSession, d: str) -> DataFrame:
    return _admitted(spark, d).select("sample_id", F.array_join("reasons", ",").alias("reasons"), "eligible")


def tally(spark: SparkSession, d: str) -> DataFrame:
    return admission.exclusion_tally(_admitted(spark, d))


def kicks(spark: SparkSession, d: str) -> DataFrame:
    return _kicks(spark, d).select("sample_id")


def mask_counts(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.mask_counts(retrieval.population(_wide(spark, d), views.VERSION))


def fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d).select("dimension", "n", F.round("mean", DIGITS).alias("mean"), F.round("std", DIGITS).alias("std"), "inactive_reason")


def _nearest(spark: SparkSession, d: str, size: int) -> DataFrame:
    return retrieval.nearest(_kicks(spark, d), _eligible(spark, d), _fitted(spark, d), size, DIGITS)


def shortlist(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.shortlist(_nearest(spark, d, retrieval.SHORTLIST[1])).select("kick_id", "sample_id", "position", "similarity", "unavailable_reason", F.round("coverage", DIGITS).alias("coverage"))


def cutoff(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cutoff_evidence(durable(_nearest(spark, d, 51)), 50, _eligible(spark, d)).withColumn("tied", F.array_join("tied", ","))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    scored = ranking.score_baseline(ranking.pair_with(_kicks(spark, d), _eligible(spark, d)))
    return scored.withColumn("compatibility", F.round("compatibility", DIGITS))


def baseline(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.rank_baseline(_kicks(spark, d), _eligible(spark, d), DIGITS)
    return ranked.select("kick_id", "sample_id", *ranking.FITS, *(f"{n}_reason" for n in ranking.FITS), "compatibility", "confidence", "unscored_code", "rank")


def _hybrid(spark: SparkSession, d: str, judgments: DataFrame) -> DataFrame:
    sides = _kicks(spark, d), _eligible(spark, d)
    return ranking.rank_hybrid(*sides, judgments, durable(ranking.batch_flags(*sides, judgments)), DIGITS)


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, views.judgments(spark, d)).select("kick_id", "sample_id", "compatibility", "confidence", "uncertain", F.array_join("warnings", ",").alias("warnings"), "mode", "jev_status", "rank")


def hybrid_without_judgments(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, views.judgments(spark, d).where("label is null")).select("kick_id", "sample_id", "compatibility", "mode", "jev_status", "rank")


def alternatives(spark: SparkSession, d: str) -> DataFrame:
    sides, judgments = (_kicks(spark, d), _eligible(spark, d)), views.judgments(spark, d)
    flags = durable(ranking.batch_flags(*sides, judgments))
    scored = ranking.score_baseline(ranking.pair_up(ranking.leaders(*sides, judgments, flags, 4), *sides)).withColumn("compatibility", F.round("compatibility", DIGITS))
    hybrid = ranking.score_hybrid(scored, judgments, flags=flags).withColumn("compatibility", F.round("compatibility", DIGITS))
    return ranking.alternatives(ranking.best(hybrid, 4), flags).select("kick_id", F.array_join("alternatives", ",").alias("alternatives"))


def evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    """G23, over ranked ids only: how many have a judgment for each dimension."""
    ranked = ranking.best(_scored(spark, d), 10).select(F.col("sample_id").alias("candidate_id"))
    return views.judgments(spark, d).join(ranked, "candidate_id").groupBy("dimension", F.when(F.col("label").isNull(), "abstained").otherwise("judged").alias("state")).agg(F.count("*").alias("n"))


def top(spark: SparkSession, d: str, limit: int = 10) -> DataFrame:
    """The flagship: admission, fit, shortlist, baseline and hybrid ranking, the best of each kick."""
    from timbral.plans.recommend import recommend

    found = recommend(_kicks(spark, d), _wide(spark, d).where("role <> 'kick'"), views.judgments(spark, d), views.VERSION, POLICY, SONG, limit, digits=DIGITS)
    return found.select("kick_id", "sample_id", F.round("compatibility", DIGITS).alias("compatibility"), "mode", "rank")


# -- the same rules as SQL

_REASONS = """list_filter([
  CASE WHEN role NOT IN ('bass', 'sub-bass') THEN 'wrong_role' END,
  CASE coalesce(availability, 'unknown') WHEN 'missing' THEN 'file_missing' WHEN 'unreadable' THEN 'file_unreadable' WHEN 'unknown' THEN 'availability_unknown' END,
  CASE WHEN frame_count = 0 THEN 'empty_audio' END, CASE WHEN peak = 0 THEN 'silent_audio' END, CASE WHEN peak IS NULL THEN 'unusable_analysis' END,
  CASE WHEN rms > peak AND (peak = 0 OR abs(rms - peak) > 1e-12 * greatest(rms, peak)) THEN 'inconsistent_analysis' END,
  CASE WHEN tempo_confidence >= 0.8 AND abs(tempo - 110.0) > 0.05 * 110.0 THEN 'tempo_mismatch' END,
  CASE WHEN key_confidence >= 0.8 AND (key_tonic <> 'C' OR key_mode <> 'major') THEN 'key_mismatch' END], lambda x: x IS NOT NULL)"""
_SOUND = "frame_count > 0 AND peak > 0 AND NOT coalesce(rms > peak AND abs(rms - peak) > 1e-12 * greatest(rms, peak), false)"
_ADMITTED = f"{SAMPLES_CTE},\nadmitted AS (SELECT *, {_REASONS} AS reasons FROM v_samples WHERE role <> 'kick')"
_BASE = f"""{_ADMITTED},
kicks AS (SELECT * FROM v_samples WHERE role = 'kick' AND availability = 'available' AND analysis_version = 'v1' AND {_SOUND}),
eligible AS (SELECT * FROM admitted WHERE len(reasons) = 0 AND analysis_version = 'v1')"""


def _value(name: str) -> str:
    x = f"CASE WHEN coalesce(fundamental_confidence >= 0.8, false) THEN {name} END" if name == "fundamental" else name
    kind = retrieval.SPACE[name]
    return f"CASE WHEN ({x}) > 0 THEN log2({x}) END" if kind == "log2_hz" else f"CASE WHEN ({x}) >= 0 THEN ln(1 + ({x})) END" if kind == "log1p_ms" else x


def _coords(table: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT sample_id, '{n}' AS dimension, {_value(n)} AS v, {'coalesce(fundamental_confidence >= 0.8, false) AND ' if n == 'fundamental' else ''}{n} IS NOT NULL AS usable FROM {table}" for n in retrieval.SPACE)


_FIT = f"""{_BASE},
coords AS ({_coords("v_samples")}),
pop AS (SELECT c.* FROM coords c JOIN v_samples s USING (sample_id) WHERE s.role <> 'kick' AND s.analysis_version = 'v1'),
fitted AS (SELECT dimension, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM pop GROUP BY dimension),
normals AS (SELECT *, CASE WHEN n < 2 THEN 'insufficient_population' WHEN std < 1e-9 THEN 'zero_variance' END AS inactive_reason FROM fitted)"""
_PAIRS = f"""{_FIT},
z AS (SELECT c.sample_id, c.dimension, (c.v - n.mean) / n.std AS z FROM coords c JOIN normals n USING (dimension) WHERE n.inactive_reason IS NULL),
active AS (SELECT count(*) AS active FROM normals WHERE inactive_reason IS NULL),
joined AS (SELECT k.sample_id AS kick_id, e.sample_id, count(zk.z) AS kick_known, count(zk.z + ze.z) AS n_common,
  sum((zk.z - ze.z) * (zk.z - ze.z)) AS squares
  FROM kicks k, eligible e, z zk, z ze WHERE zk.sample_id = k.sample_id AND ze.sample_id = e.sample_id AND zk.dimension = ze.dimension GROUP BY ALL),
judged AS (SELECT *, n_common / CAST(active AS DOUBLE) AS coverage,
  CASE WHEN kick_known / CAST(active AS DOUBLE) < 0.5 THEN 'kick_dimensions_insufficient' WHEN n_common / CAST(active AS DOUBLE) < 0.5 THEN 'insufficient_common_dimensions' END AS unavailable_reason
  FROM joined, active),
pairs AS (SELECT kick_id, sample_id, unavailable_reason, coverage, CASE WHEN unavailable_reason IS NULL THEN round(1 / (1 + sqrt(squares / n_common)), 9) END AS similarity FROM judged),
placed AS (SELECT *, row_number() OVER (PARTITION BY kick_id ORDER BY similarity IS NULL, similarity DESC NULLS LAST, sample_id) AS position FROM pairs)"""


def _side(s: str, names: tuple[str, ...]) -> str:
    return "(0.0 + " + " + ".join(f"{s}.{n}" for n in names) + ")"


def _tonal(s: str, name: str) -> str:
    return f"WHEN {s}.key_tonic IS NULL THEN '{name}_key_unknown' WHEN {s}.key_confidence < 0.8 THEN '{name}_key_unreliable' WHEN {s}.fundamental IS NOT NULL AND NOT coalesce({s}.fundamental_confidence >= 0.8, false) THEN '{name}_f0_unreliable'"


_TONICS = "[" + ", ".join(f"'{t}'" for t in TONICS) + "]"
_APART = f"abs(list_position({_TONICS}, k.key_tonic) - list_position({_TONICS}, c.key_tonic))"
_SCORED = f"""{_BASE},
fits AS (SELECT k.sample_id AS kick_id, c.sample_id, c.analysis_version <> k.analysis_version AS version_warning,
  CASE WHEN {_side("k", BANDS)} IS NULL THEN 'kick_band_unknown' WHEN {_side("c", BANDS)} IS NULL THEN 'candidate_band_unknown'
    WHEN {_side("k", BANDS)} = 0 THEN 'kick_band_energy_zero' WHEN {_side("c", BANDS)} = 0 THEN 'candidate_band_energy_zero' END AS frequency_reason,
  CASE WHEN {_side("k", BANDS)} + {_side("c", BANDS)} IS NOT NULL THEN 1 - least({_side("k", BANDS[:2])} / {_side("k", BANDS)}, {_side("c", BANDS[:2])} / {_side("c", BANDS)}) END AS frequency,
  CASE WHEN k.transient_strength IS NULL THEN 'kick_transient_strength_unknown' WHEN k.attack IS NULL THEN 'kick_attack_unknown' WHEN k.decay IS NULL THEN 'kick_decay_unknown'
    WHEN c.transient_position IS NULL THEN 'candidate_transient_position_unknown' END AS transient_reason,
  CASE WHEN c.transient_position IS NOT NULL THEN 1 - (1 - CASE WHEN k.attack + k.decay <= 0 THEN 1.0 ELSE least(c.transient_position, k.attack + k.decay) / (k.attack + k.decay) END) * k.transient_strength END AS transient,
  CASE {_tonal("k", "kick")} {_tonal("c", "candidate")} END AS tonal_reason,
  CAST(([1.00, 0.10, 0.30, 0.75, 0.85, 0.95, 0.10])[CAST(least({_APART}, 12 - {_APART}) + 1 AS BIGINT)] AS DOUBLE) AS interval
  FROM kicks k, eligible c),
named AS (SELECT * EXCLUDE (interval), CASE WHEN tonal_reason IS NULL THEN interval END AS tonal FROM fits),
weighed AS (SELECT *, CASE WHEN frequency IS NULL THEN 0 ELSE CAST(3 AS DOUBLE) / 7 END + CASE WHEN transient IS NULL THEN 0 ELSE CAST(2 AS DOUBLE) / 7 END + CASE WHEN tonal IS NULL THEN 0 ELSE CAST(2 AS DOUBLE) / 7 END AS confidence,
  coalesce(frequency * (CAST(3 AS DOUBLE) / 7), 0) + coalesce(transient * (CAST(2 AS DOUBLE) / 7), 0) + coalesce(tonal * (CAST(2 AS DOUBLE) / 7), 0) AS total FROM named),
scored AS (SELECT *, CASE WHEN confidence > 0 THEN round(total / confidence, 9) END AS compatibility FROM weighed),
ranked AS (SELECT *, CASE WHEN compatibility IS NOT NULL THEN row_number() OVER (PARTITION BY kick_id ORDER BY compatibility DESC NULLS LAST, sample_id) END AS rank FROM scored)"""
_LABELS = "CASE label " + " ".join(f"WHEN '{x}' THEN CAST({v} AS DOUBLE)" for x, v in LABEL_SCORES.items()) + " END"
_EV = ",\n  ".join(f"max(CASE WHEN dimension = '{x}' THEN {_LABELS} END) AS s_{x}, max(CASE WHEN dimension = '{x}' THEN confidence END) AS c_{x}" for x in DIMENSIONS)
_H = {x: (f"CASE WHEN {x} IS NOT NULL AND s_{x} IS NOT NULL THEN ({x} + s_{x}) / 2 ELSE coalesce({x}, s_{x}) END" if x in ranking.FITS else f"s_{x}") for x in ranking.HYBRID_WEIGHTS}
_WARN = ", ".join([f"CASE WHEN abs({x} - s_{x}) > 0.5 THEN 'dimension_disagreement:{x}' END" for x in ranking.FITS] + ["CASE WHEN NOT usable THEN 'candidate_no_jev_evidence' END", "CASE WHEN h_confidence < 0.6 THEN 'low_coverage' END"] + [f"CASE WHEN s_{x} IS NOT NULL AND c_{x} < 0.8 THEN 'low_jev_confidence:{x}' END" for x in ranking.HYBRID_WEIGHTS])


def _hybrid_sql(source: str) -> str:
    return f"""{_SCORED},
{JUDGMENTS_CTE},
said AS (SELECT candidate_id, {_EV} FROM v_judgments {source} GROUP BY candidate_id),
joint AS (SELECT s.*, j.*, {" OR ".join(f"s_{x} IS NOT NULL" for x in _H)} AS usable, {" AND ".join(f"s_{x} IS NOT NULL" for x in _H)} AS complete,
  {", ".join(f"{e} AS h_{x}" for x, e in _H.items())} FROM scored s LEFT JOIN said j ON j.candidate_id = s.sample_id),
summed AS (SELECT *, {" + ".join(f"CASE WHEN h_{x} IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST({w} AS DOUBLE) END" for x, w in ranking.HYBRID_WEIGHTS.items())} AS h_confidence,
  {" + ".join(f"coalesce(h_{x} * CAST({w} AS DOUBLE), CAST(0 AS DOUBLE))" for x, w in ranking.HYBRID_WEIGHTS.items())} AS h_total,
  {" OR ".join(f"coalesce(s_{x} IS NOT NULL AND c_{x} < 0.8, false)" for x in _H)} AS weak FROM joint),
flags AS (SELECT kick_id, bool_or(usable) AS any_usable, bool_and(complete) FILTER (WHERE h_confidence > 0) AS all_complete FROM summed GROUP BY kick_id),
h AS (SELECT s.*, any_usable, CASE WHEN any_usable THEN 'hybrid' ELSE 'dsp-only' END AS mode,
  CASE WHEN NOT any_usable THEN 'jev_absent' WHEN all_complete THEN 'jev_present' ELSE 'jev_partial' END AS jev_status,
  CASE WHEN any_usable THEN CASE WHEN h_confidence > 0 THEN round(h_total / h_confidence, 9) END ELSE compatibility END AS hc,
  CASE WHEN any_usable THEN h_confidence ELSE confidence END AS hconf,
  CASE WHEN any_usable THEN h_confidence < 0.6 OR weak ELSE confidence < 0.6 END AS uncertain,
  CASE WHEN any_usable THEN list_aggregate(list_filter([{_WARN}], lambda x: x IS NOT NULL), 'string_agg', ',') END AS warnings
  FROM summed s JOIN flags USING (kick_id)),
hr AS (SELECT *, CASE WHEN hc IS NOT NULL THEN row_number() OVER (PARTITION BY kick_id ORDER BY hc DESC NULLS LAST, sample_id) END AS hrank FROM h)"""


_HYBRID = _hybrid_sql("")
_TOP = f"""{_PAIRS.replace("WITH", "")},
{_SCORED[len(_BASE) + 2:]},
{_HYBRID[len(_SCORED) + 2:].replace("FROM scored s LEFT", "FROM (SELECT s.* FROM scored s JOIN placed p USING (kick_id, sample_id) WHERE p.position <= 100) s LEFT").replace("round(h_total / h_confidence, 9)", "h_total / h_confidence")}"""

QUERIES = {
    "R14_J9_L2_flagship_recommend": (top, f"WITH {_TOP} SELECT kick_id, sample_id, round(hc, 9) AS compatibility, mode, CAST(hrank AS INTEGER) AS rank FROM hr WHERE hrank <= 10"),
    "J1_pivot_features": (pivot, f"WITH {SAMPLES_CTE} SELECT sample_id, analysis_version, {', '.join(MEASURES)}, fundamental_confidence, tempo_confidence, key_tonic, key_mode, key_confidence FROM v_samples"),
    "F1_F6_admission": (admit, f"WITH {_ADMITTED} SELECT sample_id, coalesce(list_aggregate(reasons, 'string_agg', ','), '') AS reasons, len(reasons) = 0 AS eligible FROM admitted"),
    "F7_exclusion_tally": (tally, f"WITH {_ADMITTED} SELECT code, count(*) AS n FROM (SELECT unnest(reasons) AS code FROM admitted) GROUP BY code"),
    "F4_F18_admissible_kicks": (kicks, f"WITH {_BASE} SELECT sample_id FROM kicks"),
    "G7_X1_X2_mask_counts": (mask_counts, f"WITH {_FIT} SELECT dimension, count(v) AS known, count(*) FILTER (WHERE usable AND v IS NULL) AS domain_rejected FROM pop GROUP BY dimension"),
    "G8_G9_fit_normalization": (fit, f"WITH {_FIT} SELECT dimension, n, round(mean, 9) AS mean, round(std, 9) AS std, inactive_reason FROM normals"),
    "R12_J9_J10_X3_X5_W2_L1_shortlist": (shortlist, f"WITH {_PAIRS} SELECT kick_id, sample_id, CAST(position AS INTEGER) AS position, similarity, unavailable_reason, round(coverage, 9) AS coverage FROM placed WHERE position <= 100"),
    "W11_cutoff_evidence": (
        cutoff,
        f"""WITH {_PAIRS}, ends AS (SELECT kick_id, count(*) AS n FROM placed GROUP BY kick_id),
last AS (SELECT e.kick_id, e.n, p.similarity AS last_similarity, p.sample_id AS last_id, x.sample_id AS first_excluded_id FROM ends e
  JOIN placed p ON p.kick_id = e.kick_id AND p.position = least(e.n, 50) LEFT JOIN placed x ON x.kick_id = e.kick_id AND x.position = 51)
SELECT kick_id, last_similarity, last_id, first_excluded_id,
  coalesce((SELECT string_agg(p.sample_id, ',' ORDER BY p.sample_id) FROM placed p WHERE p.kick_id = last.kick_id AND p.similarity = last.last_similarity), CAST(last_id AS VARCHAR)) AS tied,
  least(n, 50) AS returned, CASE WHEN n > 50 THEN 'shortlist_size' ELSE 'eligible_exhausted' END AS limit_reason FROM last""",
    ),
    "R1_R4_W1_G22_X7_baseline": (
        baseline,
        f"WITH {_SCORED} SELECT kick_id, sample_id, round(frequency, 9) AS frequency, round(transient, 9) AS transient, round(tonal, 9) AS tonal, frequency_reason, transient_reason, tonal_reason, compatibility, round(confidence, 9) AS confidence, CASE WHEN compatibility IS NULL THEN 'insufficient_evidence' END AS unscored_code, CAST(rank AS INTEGER) AS rank FROM ranked",
    ),
    "R6_R10_J11_hybrid": (hybrid, f"WITH {_HYBRID} SELECT kick_id, sample_id, hc AS compatibility, round(hconf, 9) AS confidence, uncertain, coalesce(warnings, '') AS warnings, mode, jev_status, CAST(hrank AS INTEGER) AS rank FROM hr"),
    "R8_hybrid_fallback": (hybrid_without_judgments, f"WITH {_hybrid_sql('WHERE label IS NULL')} SELECT kick_id, sample_id, hc AS compatibility, mode, jev_status, CAST(hrank AS INTEGER) AS rank FROM hr"),
    "L7_J16_alternatives": (alternatives, f"WITH {_HYBRID}, o AS (SELECT kick_id, bool_or(uncertain) AS open FROM hr WHERE hrank IS NOT NULL GROUP BY kick_id) SELECT kick_id, CASE WHEN open THEN coalesce((SELECT string_agg(sample_id, ',' ORDER BY hrank) FROM hr WHERE hr.kick_id = o.kick_id AND hrank BETWEEN 2 AND 4), '') ELSE '' END AS alternatives FROM o"),
    "G23_evidence_sources": (evidence_sources, f"WITH {_SCORED}, {JUDGMENTS_CTE} SELECT dimension, CASE WHEN label IS NULL THEN 'abstained' ELSE 'judged' END AS state, count(*) AS n FROM v_judgments j JOIN ranked r ON r.sample_id = j.candidate_id WHERE rank <= 10 GROUP BY ALL"),
}
