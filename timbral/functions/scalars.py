"""Scalar rules as column expressions; pandas UDFs only for text that must match a Python format or Unicode rule."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbral.schemas import LABEL_SCORES, TONICS

# -- numbers


def midi(hz: Column) -> Column:
    """The nearest MIDI note, halves up."""
    return F.floor(F.lit(69) + F.lit(12) * F.log2(hz / 440.0) + 0.5)


def cents(a: Column, b: Column) -> Column:
    return F.lit(1200.0) * F.log2(a / b)


def db_to_factor(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def factor_to_db(factor: Column) -> Column:
    return F.when(factor > 0, F.lit(20.0) * F.log10(factor))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def percent(x: Column) -> Column:
    """0..1 as a whole percent, halves up."""
    return F.floor(x * 100 + 0.5).cast("int")


# -- text


@F.pandas_udf(T.StringType())
def shown(x: pd.Series) -> pd.Series:
    """Three decimals, rounded as Python does (half to even on the exact binary value)."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.3f}")


@F.pandas_udf(T.StringType())
def exact(x: pd.Series) -> pd.Series:
    """The shortest text that reads back as the same double."""
    return x.map(lambda v: None if pd.isna(v) else repr(float(v)))


@F.pandas_udf(T.StringType())
def path_key(path: pd.Series) -> pd.Series:
    """NFC, case-folded, with forward slashes: equal for paths that a file system may not tell apart."""
    return path.map(lambda p: None if p is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", p.replace("\\", "/")).casefold()))


def filename(path: Column) -> Column:
    """The part after the last slash of either kind."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def pack_of(path: Column) -> Column:
    """The first folder of a relative path; null for a bare file."""
    return F.when(path.rlike(r"[/\\]"), F.regexp_extract(path, r"^([^/\\]+)", 1))


def audio_name_problem(name: Column, size: Column) -> Column:
    """Why a file can't be auditioned, or null: its name, extension or size (64 MiB at most)."""
    return (
        F.when(name.isNull() | (F.length(F.trim(name)) == 0) | name.rlike(r"[/\\\x00]") | name.isin(".", ".."), "invalid_name")
        .when(~F.lower(name).endswith(".wav"), "unsupported_extension")
        .when(size > 64 * 1024 * 1024, "too_large")
    )


def is_run_id(x: Column) -> Column:
    return x.rlike(r"^run-[0-9a-f]{64}$")


def is_content_id(x: Column) -> Column:
    return x.rlike(r"^sha256:[0-9a-f]{64}$")


def is_digest(x: Column) -> Column:
    return x.rlike(r"^[0-9a-f]{64}$")


def id_prefix(x: Column) -> Column:
    """The first 12 characters, with an ellipsis if there are more."""
    return F.when(F.length(x) > 12, F.concat(F.substring(x, 1, 12), F.lit("…"))).otherwise(x)


def label_text(label: Column) -> Column:
    """A label as it is shown: words, the first with a capital."""
    words = F.regexp_replace(label, "-", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1000))


# -- parsing what a user types


def parse_tempo(text: Column) -> Column:
    """A number from 20 to 400, or null."""
    x = F.trim(text).try_cast("double")
    return F.when(x.between(20.0, 400.0), x)


def parse_key(text: Column) -> Column:
    """struct(tonic, mode) of texts such as "C# minor" or "am"; flats are their sharps; null if it is none."""
    pattern = r"(?i)^\s*([a-g])([#♯b♭]?)\s*(maj(?:or)?|min(?:or)?|m)?\s*$"
    letter, sign, mode = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    base = F.array_position(F.array(*(F.lit(t) for t in TONICS)), F.upper(letter)) - 1
    moved = base + F.when(sign.isin("#", "♯"), 1).when(sign.isin("b", "♭"), -1).otherwise(0)
    tonic = F.array(*(F.lit(t) for t in TONICS))[F.pmod(moved, F.lit(12)).cast("int")]
    minor = F.lower(mode).startswith("min") | (F.lower(mode) == "m")
    return F.when(text.rlike(pattern), F.struct(tonic.alias("tonic"), F.when(minor, "minor").otherwise("major").alias("mode")))


def parse_genre(text: Column) -> Column:
    """Trimmed with single spaces, at most 64 characters; null if nothing is left."""
    x = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(x).between(1, 64), x)


# -- cursors


def encode_cursor(value: Column) -> Column:
    """A versioned, URL-safe cursor."""
    return F.translate(F.base64(F.concat(F.lit('{"after":'), value.cast("string"), F.lit(',"v":1}')).cast("binary")), "+/=", "-_")


def decode_cursor(cursor: Column) -> Column:
    """The value of a cursor; null unless it is one that encode_cursor gives."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    raw = F.when(plain.rlike(r"^[A-Za-z0-9+/]+$") & (F.length(plain) % 4 != 1), padded)
    value = F.regexp_extract(F.unbase64(raw).cast("string"), r'^\{"after":(-?\d+),"v":1\}$', 1).try_cast("long")
    return F.when(encode_cursor(value) == cursor, value)


# -- probabilities of labels


def probability_problem(probabilities: Column, label: Column) -> Column:
    """The first rule that a judgment's probabilities break, or null: each label once, finite and from 0 to 1, sum 1 within 1e-6, the label's the largest."""
    names = F.transform(probabilities, lambda p: p["label"])
    values = F.transform(probabilities, lambda p: p["probability"])
    complete = (F.size(names) == len(LABEL_SCORES)) & (F.array_sort(names) == F.array(*(F.lit(x) for x in sorted(LABEL_SCORES))))
    sound = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0.0, 1.0))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    own = F.element_at(F.filter(probabilities, lambda p: p["label"] == label), 1)["probability"]
    return (
        F.when(~complete, "labels_incomplete")
        .when(~sound, "probability_range")
        .when(F.abs(total - 1.0) > 1e-6, "probability_sum")
        .when(own < F.array_max(values), "label_not_most_probable")
    )


def canonical_order(probabilities: Column) -> Column:
    """Probabilities in the order of the labels, weakest first."""
    return F.array(*(F.element_at(F.filter(probabilities, _labelled(name)), 1) for name in LABEL_SCORES))


def _labelled(name: str):
    return lambda p: p["label"] == name


def expected_score(probabilities: Column) -> Column:
    scores = F.create_map(*(F.lit(x) for pair in LABEL_SCORES.items() for x in pair))
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + scores[p["label"]] * p["probability"])


# -- time


def utc_text(ts: Column) -> Column:
    """UTC text to the second (under a UTC session)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cutoff_text(ts: Column, seconds: int) -> Column:
    return utc_text(ts - F.expr(f"INTERVAL {seconds} SECONDS"))
