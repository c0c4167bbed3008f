"""Explicit schemas, closed vocabularies and validation of sample-library records.

Nothing is inferred from data: readers get these types, and rows that break a
rule are found by predicates rather than by failing casts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"

# Roles, judgment dimensions, labels and their scores, weakest first.
ROLES = ("kick", "bass", "sub-bass")
CANDIDATE_ROLES = ("bass", "sub-bass")
DIMENSIONS = ("frequency", "transient", "tonal", "rhythmic", "texture", "arrangement")
LABEL_SCORES = {"very-poor": 0.0, "poor": 0.25, "neutral": 0.5, "good": 0.75, "excellent": 1.0}
TONICS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
BANDS = ("band_sub", "band_bass", "band_low_mid", "band_mid", "band_high_mid", "band_high")
JOB_STATES = ("pending", "running", "complete", "failed", "cancelled", "superseded", "orphaned")
AVAILABILITY = ("available", "missing", "unreadable", "unknown")

# Each measure's unit, least and largest value (None: unbounded).
MEASURES: dict[str, tuple[str, float | None, float | None]] = {
    "fundamental": ("Hz", 0.0, None),
    "spectral_centroid": ("Hz", 0.0, None),
    "spectral_rolloff": ("Hz", 0.0, None),
    "rms": ("linear", 0.0, None),
    "peak": ("linear", 0.0, None),
    "crest_factor": ("ratio", 1.0, None),
    "loudness": ("LUFS", None, None),
    "transient_strength": ("normalized", 0.0, 1.0),
    "transient_position": ("ms", 0.0, None),
    "attack": ("ms", 0.0, None),
    "decay": ("ms", 0.0, None),
    "stereo_width": ("normalized", 0.0, 1.0),
    "tempo": ("BPM", 0.0, None),
} | {band: ("ratio", 0.0, 1.0) for band in BANDS}

RELIABLE = 0.80

_S, _L, _D, _I, _B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MEASUREMENT = _row(name=_S, value=_D, unit=_S, unavailable_reason=_S, confidence=_D)
KEY = _row(tonic=_S, mode=_S, confidence=_D, unavailable_reason=_S)
AUDIO = _row(local_path=_S, sample_rate_hz=_L, channels=_L, frame_count=_L, duration_ms=_D)
SAMPLE = _row(sample_id=_S, role=_S, schema_version=_S, analysis_version=_S, audio=AUDIO, features=_row(measurements=T.ArrayType(MEASUREMENT), key=KEY))
JUDGMENT = _row(
    question_id=_S, dimension=_S, label=_S, probabilities=T.ArrayType(_row(label=_S, probability=_D)), confidence=_D, model_version=_S, prompt_version=_S, unavailable_reason=_S
)
SAMPLES = _row(sample_id=_S, content_sha256=_S, role=_S, original_path=_S, path_key=_S, filename=_S, pack_id=_S, file_status=_S, sample_rate_hz=_L, channels=_L, frame_count=_L, duration_ms=_D)
FEATURES = _row(sample_id=_S, analysis_version=_S, measurement=_S, unit=_S, value=_D, unavailable_reason=_S, confidence=_D)
KEYS = _row(sample_id=_S, analysis_version=_S, tonic=_S, mode=_S, confidence=_D, unavailable_reason=_S)
OUTCOMES = _row(event_id=_L, client_event_id=_S, event_type=_S, project_id=_S, palette_id=_S, candidate_id=_S, run_id=_S, palette_revision=_L, removes_event_id=_L)
JOB_ITEMS = _row(item_id=_L, run_id=_S, sample_id=_S, analysis_version=_S, state=_S, attempts=_I, error_code=_S)


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def nonblank(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def known_or_reason(value: Column, reason: Column) -> Column:
    """A value without a reason, or a reason without a value."""
    return value.isNull() == reason.isNotNull()


#: Measures that are never 0 and are known with a confidence only.
POSITIVE = ("fundamental", "tempo")


def measurement_problem(name: Column, value: Column, unit: Column, reason: Column, confidence: Column) -> Column:
    """The first rule that a measurement breaks, or null."""
    units = F.create_map(*(F.lit(x) for n, (u, _, _) in MEASURES.items() for x in (n, u)))
    low = F.create_map(*(F.lit(x) for n, (_, a, _) in MEASURES.items() if a is not None for x in (n, a)))
    high = F.create_map(*(F.lit(x) for n, (_, _, b) in MEASURES.items() if b is not None for x in (n, b)))
    return (
        F.when(~F.coalesce(name.isin(*MEASURES), F.lit(False)), "unknown_measurement")
        .when(~F.coalesce(units[name] == unit, F.lit(False)), "wrong_unit")
        .when(~known_or_reason(value, reason), "value_and_reason")
        .when(value.isNotNull() & ~finite(value), "not_finite")
        .when(value < low[name], "below_range")
        .when(value > high[name], "above_range")
        .when(name.isin(*POSITIVE) & (value <= 0), "not_positive")
        .when(value.isNull() & confidence.isNotNull(), "confidence_of_unknown")
        .when(name.isin(*POSITIVE) & value.isNotNull() & confidence.isNull(), "confidence_missing")
        .when(confidence.isNotNull() & ~confidence.between(0.0, 1.0), "confidence_range")
    )


def feature_problems(features: DataFrame) -> DataFrame:
    """sample_id, analysis_version, measurement and problem of each stored measurement that breaks a rule, and sets that lack one."""
    problem = measurement_problem(F.col("measurement"), F.col("value"), F.col("unit"), F.col("unavailable_reason"), F.col("confidence"))
    rows = features.select("sample_id", "analysis_version", "measurement", problem.alias("problem")).where("problem is not null")
    short = (
        features.groupBy("sample_id", "analysis_version")
        .agg(F.count_distinct("measurement").alias("n"))
        .where(F.col("n") != len(MEASURES))
        .select("sample_id", "analysis_version", F.lit(None).cast("string").alias("measurement"), F.lit("incomplete_features").alias("problem"))
    )
    return rows.unionByName(short)
