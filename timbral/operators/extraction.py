"""Measures of audio files: rules over the block summaries of timbral.sources.wav, and incremental runs.

A known value has no reason and an unknown one has one.  Everything here is
built-in expressions; the arrays that they fold have 10 to 200 numbers for each
second of audio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbral.schemas import BANDS, MEASURES, TONICS
from timbral.sources.wav import EDGES, ENVELOPE_RATE, LOUDNESS_RATES, NEAR_CENTS, PITCH_RATES, summaries

# Loudness offset and gates; envelope thresholds and the tolerance of comparisons with them.
OFFSET, ABSOLUTE_GATE, RELATIVE_GATE = -0.691, -70.0, -10.0
ONSET, RISE, SECOND = 0.1, 0.9, 0.5
ROUNDING = 8 * 2.0**-52
# Shares of frames with a pitch, seconds and pitch classes that a key needs, fit and lead of the best key, and the
# published Krumhansl-Kessler ratings of the twelve tones in a major and a minor key, from the tonic on.
STEADY, KEY_SHARE, KEY_SECONDS, KEY_CLASSES, CLASS_SHARE = 0.80, 0.60, 4, 5, 0.05
KEY_FIT, KEY_LEAD, SURE_LEAD = 0.80, 0.10, 0.30
RATINGS = {
    "major": (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88),
    "minor": (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17),
}


def _silent() -> Column:
    return F.col("peak") == 0

def _level(energy: Column) -> Column:
    return F.lit(OFFSET) + 10 * F.log10(energy) + 20 * F.log10("blocks_peak")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _loudness() -> tuple[Column, Column]:
    """Integrated loudness: blocks over the absolute gate set the relative one; reasons in the order silence, duration, rate, gate."""
    loud = F.filter("blocks", lambda e: (e > 0) & (_level(e) > ABSOLUTE_GATE))
    gate = _level(_mean(loud)) + RELATIVE_GATE
    value = _level(_mean(F.filter(loud, lambda e: _level(e) > gate)))
    reason = (
        F.when(_silent(), "silent_audio")
        .when(F.col("frames") < F.ceil(F.col("rate") * 4 / 10), "too_short_for_integrated_loudness")
        .when(~F.col("rate").isin(*LOUDNESS_RATES), "unsupported_loudness_sample_rate")
        .when(F.size(loud) == 0, "below_loudness_gate")
    )
    return value, reason


def _spectral_reason() -> Column:
    return F.when(_silent(), "silent_audio").when(F.col("frames") < 2, "too_short_for_spectral_analysis").when(F.col("centroid").isNull(), "numerical_range")


def _band(k: int) -> tuple[Column, Column]:
    top = EDGES[BANDS[k]][1]
    reason = F.coalesce(_spectral_reason(), F.when(F.col("rate") < 2 * top, "band_exceeds_nyquist").when(F.col("band_bins")[k] == 0, "insufficient_frequency_resolution"))
    return F.col("band_shares")[k], reason


def _first(start: Column, end: Column, holds) -> Column:
    """The first index from start to end (both counted) that holds; null if none does."""
    return F.get(F.filter(F.sequence(start, end), holds), 0)


def _over(x: Column, least: float) -> Column:
    return x >= least - ROUNDING


def _quiet(x: Column) -> Column:
    return x <= ONSET + ROUNDING


def several_onsets(envelope: Column) -> Column:
    """Whether sound, two quiet blocks in a row and a block of half the largest level follow each other."""
    start = F.struct(F.lit(False).alias("heard"), F.lit(0).alias("quiet"), F.lit(False).alias("parted"), F.lit(False).alias("again"))

    def step(s: Column, x: Column) -> Column:
        quiet = F.when(s["heard"] & _quiet(x), s["quiet"] + 1).otherwise(0)
        return F.struct(
            (s["heard"] | _over(x, ONSET)).alias("heard"),
            quiet.alias("quiet"),
            (s["parted"] | (quiet >= 2)).alias("parted"),
            (s["again"] | (s["parted"] & _over(x, SECOND))).alias("again"),
        )

    return F.aggregate(envelope, start, step, lambda s: s["again"])


def _with_marks(df: DataFrame) -> DataFrame:
    """The blocks of onset, rise, peak and strongest increment, and the first of two quiet ones after the peak."""
    e, n = F.col("envelope"), F.size("envelope")
    at = lambda i: F.get(e, i)
    there = F.when(n >= 2, F.lit(True))
    df = df.withColumn("_peak", F.when(there, _first(F.lit(0), n - 1, lambda i: _over(at(i), 1.0))))
    df = df.withColumn("_onset", F.when(there, _first(F.lit(0), F.col("_peak"), lambda i: _over(at(i), ONSET))))
    rises = F.transform(F.sequence(F.col("_onset"), F.col("_peak")), lambda i: at(i) - F.when(i > 0, at(i - 1)).otherwise(0.0))
    df = df.withColumn("_rises", F.when(there, rises)).withColumn("_rise", F.when(there, _first(F.col("_onset"), F.col("_peak"), lambda i: _over(at(i), RISE))))
    df = df.withColumn("_strongest", F.array_max("_rises"))
    df = df.withColumn("_position", F.when(there, _first(F.col("_onset"), F.col("_peak"), lambda i: F.get("_rises", i - F.col("_onset")) >= F.col("_strongest") - ROUNDING)))
    after = F.when(there & (F.col("_peak") + 1 <= n - 2), F.sequence(F.col("_peak") + 1, n - 2))
    return df.withColumn("_quiet", F.get(F.filter(after, lambda i: _quiet(at(i)) & _quiet(at(i + 1))), 0))


def _frame(block: Column) -> Column:
    return F.floor(block * F.col("rate") / ENVELOPE_RATE)


def _unmarked() -> Column:
    """Why a file has no transient."""
    return (
        F.when(_silent(), "silent_audio")
        .when(F.col("rate") < ENVELOPE_RATE, "unsupported_envelope_sample_rate")
        .when(F.col("envelope").isNull(), "too_short_for_envelope_analysis")
        .when(F.size("envelope") == 0, "insufficient_observed_audio")
        .when(several_onsets(F.col("envelope")), "multiple_onsets")
    )


def _transient(reason: Column) -> dict[str, tuple[Column, Column]]:
    ms = lambda a, b: (a - b) * 1000.0 / F.col("rate")
    return {
        "transient_strength": (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_strongest"))), reason),
        "transient_position": (ms(_frame(F.col("_position")), F.lit(0)), reason),
        "attack": (ms(_frame(F.col("_rise")), _frame(F.col("_onset"))), F.coalesce(reason, F.when(_over(F.get("envelope", F.lit(0)), ONSET), "left_truncated_attack"))),
        "decay": (ms(_frame(F.col("_quiet")), _frame(F.col("_peak"))), F.coalesce(reason, F.when(F.col("_quiet").isNull(), "truncated_decay"))),
    }


def _at_share(values: Column, share: float) -> Column:
    """The value at a share of the way through values, which are in order, between neighbours in proportion."""
    place = (F.size(values) - 1) * share
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (place - low) * (b - a)


def _with_pitch(df: DataFrame) -> DataFrame:
    """df with what pitch and key are told from: coverage, the median of the pitches' logarithms and their spread in cents."""
    logs = F.array_sort(F.transform("pitches", lambda p: F.log2(p)))
    df = df.withColumn("_logs", logs).withColumn("_median", _at_share(F.col("_logs"), 0.5)).withColumn("_coverage", F.size("pitches") / F.col("active_frames"))
    away = F.array_sort(F.transform("_logs", lambda x: F.abs(x - F.col("_median")) * 1200))
    return df.withColumn("_spread", _at_share(away, 0.9))


def _unpitched() -> Column:
    return (
        F.when(_silent(), "silent_audio")
        .when(~F.col("rate").isin(*PITCH_RATES), "unsupported_harmony_sample_rate")
        .when(F.col("active_frames").isNull() | (F.col("active_frames") < 3), "insufficient_active_frames")
    )


def _fundamental() -> tuple[Column, Column, Column]:
    """Value, reason and confidence of the pitch that a file keeps throughout."""
    refused = lambda why: F.array_contains("pitch_refusals", why)
    only_range = (F.size("pitch_refusals") > 0) & F.forall("pitch_refusals", lambda r: r == "pitch_out_of_range")
    reason = F.coalesce(
        _unpitched(),
        F.when(refused("channel_disagreement"), "channel_disagreement")
        .when(refused("octave_ambiguity"), "octave_ambiguity")
        .when((F.col("_coverage") < STEADY) & only_range, "pitch_out_of_range")
        .when(F.col("_coverage") < STEADY, "insufficient_periodicity")
        .when(F.col("_spread") > NEAR_CENTS + 1e-9, "unstable_pitch"),
    )
    confidence = _mean(F.col("periodicities")) * F.col("_coverage") * F.greatest(F.lit(0.0), 1 - F.col("_spread") / (2 * NEAR_CENTS))
    return F.pow(F.lit(2.0), F.col("_median")), reason, confidence


def _centred(values: list[float]) -> list[float]:
    mean = sum(values) / len(values)
    size = sum((v - mean) ** 2 for v in values) ** 0.5
    return [(v - mean) / size for v in values]


def _with_key(df: DataFrame) -> DataFrame:
    """df with what a key is told from, step by step: how long each tone sounds, its deviations, the keys by fit, the reason for none."""
    tone = lambda p: F.pmod(F.floor(F.lit(69.5) + 12 * F.log2(p / 440)), F.lit(12)).cast("int")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("_tones", F.transform("pitches", tone))
    df = df.withColumn("_share", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.try_divide(F.size(F.filter("_tones", lambda t: t == k)), F.size("pitches"))))
    df = df.withColumn("_centred", F.transform("_share", lambda s: s - F.lit(1 / 12)))
    df = df.withColumn("_length", F.sqrt(total(F.transform("_centred", lambda c: c * c))))
    keys = [(mode, tonic) for mode in RATINGS for tonic in range(12)]
    ratings = F.array(*(F.struct(F.lit(place).alias("place"), F.lit(TONICS[tonic]).alias("tonic"), F.lit(mode).alias("mode"), F.array(*map(F.lit, _centred([RATINGS[mode][(k - tonic) % 12] for k in range(12)]))).alias("ratings")) for place, (mode, tonic) in enumerate(keys)))
    dot = lambda r: total(F.zip_with("_centred", r, lambda c, x: c * x))
    fit = lambda k: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(k["ratings"]), F.col("_length"))))
    ranked = F.array_sort(F.transform(ratings, lambda k: F.struct((-fit(k)).alias("order"), k["place"].alias("place"), k["tonic"].alias("tonic"), k["mode"].alias("mode"))))
    df = df.withColumn("_keys", ranked)
    df = df.withColumn("_best", F.get("_keys", F.lit(0))).withColumn("_fit", -F.col("_best.order")).withColumn("_lead", F.get("_keys", F.lit(1))["order"] - F.col("_best.order"))
    reason = F.coalesce(
        _unpitched(),
        F.when(F.col("frames") < KEY_SECONDS * F.col("rate"), "insufficient_key_context")
        .when((F.col("_coverage") < KEY_SHARE) | (F.size("pitches") == 0), "insufficient_key_pitch_coverage")
        .when(F.size(F.filter("_share", lambda s: s >= CLASS_SHARE)) < KEY_CLASSES, "insufficient_pitch_class_diversity")
        .when(F.col("_length") <= 1e-15, "ambiguous_key_histogram")
        .when(F.col("_fit") < KEY_FIT - 1e-12, "low_key_fit")
        .when(F.col("_lead") < KEY_LEAD - 1e-12, "ambiguous_key"),
    )
    return df.withColumn("_unkeyed", reason)


def _key() -> Column:
    """tonic, mode, confidence and unavailable_reason of the key whose ratings correlate best with how long each tone sounds."""
    sure = F.col("_fit") * F.least(F.lit(1.0), F.col("_lead") / SURE_LEAD) * F.col("_coverage")
    known = F.col("_unkeyed").isNull()
    return F.struct(F.when(known, F.col("_best.tonic")).alias("tonic"), F.when(known, F.col("_best.mode")).alias("mode"), F.when(known, sure).alias("confidence"), F.col("_unkeyed").alias("unavailable_reason"))


def measure(files: DataFrame) -> DataFrame:
    """files (their columns but content) with error, rate, channels, frames, key and measurements: name, unit, value, unavailable_reason and confidence of each measure.

    A file that cannot be read has an error and neither measurements nor a key.
    Stereo width and tempo are not made here: not_implemented.
    """
    df = _with_key(_with_pitch(_with_marks(summaries(files)))).withColumn("_unmarked", _unmarked())
    rms = F.col("peak") * F.col("scaled_rms")
    none = F.lit(None).cast("string")
    known: dict[str, tuple[Column, Column]] = {
        "rms": (F.when(_silent(), 0.0).otherwise(rms), F.when(~_silent() & (rms <= 0), "numerical_range").otherwise(none)),
        "peak": (F.col("peak"), none),
        "crest_factor": (F.greatest(F.lit(1.0), 1 / F.col("scaled_rms")), F.when(_silent(), "silent_audio")),
        "loudness": _loudness(),
        "spectral_centroid": (F.col("centroid"), _spectral_reason()),
        "spectral_rolloff": (F.col("rolloff"), _spectral_reason()),
    }
    *pitch, confidence = _fundamental()
    known |= {band: _band(k) for k, band in enumerate(BANDS)} | _transient(F.col("_unmarked")) | {"fundamental": tuple(pitch)}
    df = df.withColumns({f"_why_{name}": reason for name, (_, reason) in known.items()})
    entries = []
    for name, (unit, _, _) in MEASURES.items():
        value = known[name][0] if name in known else F.lit(None).cast("double")
        reason = F.col(f"_why_{name}") if name in known else F.lit("not_implemented")
        entries.append(F.struct(F.lit(name).alias("name"), F.lit(unit).alias("unit"), F.when(reason.isNull(), value).alias("value"), reason.alias("unavailable_reason"), F.when(reason.isNull(), confidence if name == "fundamental" else F.lit(None).cast("double")).alias("confidence")))
    kept = [c for c in files.columns if c != "content"]
    return df.select(*kept, "error", "rate", "channels", "frames", F.when(F.col("error").isNull(), F.array(*entries)).alias("measurements"), F.when(F.col("error").isNull(), _key()).alias("key"))


def run(files: DataFrame, done: DataFrame) -> DataFrame:
    """An analysis that goes on: path, fingerprint, status (complete, failed), error, reused and measurements of every file.

    done has fingerprint and measurements of complete files of the same
    analysis version.  Contents that it knows are not decoded again, and a
    content that several paths have is decoded once.
    """
    found = files.withColumn("fingerprint", F.sha2("content", 256))
    fresh = found.join(done.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", "content").groupBy("fingerprint").agg(F.min("content").alias("content"))
    fields = [f.name for f in done.schema["measurements"].dataType.elementType]  # results of an older version may lack some
    kept = F.transform("measurements", lambda m: F.struct(*(m[f] for f in fields))).alias("measurements")
    made = measure(fresh).select("fingerprint", "error", kept, F.lit(False).alias("reused"))
    old = done.dropDuplicates(["fingerprint"]).select("fingerprint", F.lit(None).cast("string").alias("error"), F.transform("measurements", lambda m: F.struct(*(m[f] for f in fields))).alias("measurements"), F.lit(True).alias("reused"))
    status = F.when(F.col("error").isNull(), "complete").otherwise("failed")
    return found.select("path", "fingerprint").join(made.unionByName(old), "fingerprint").select("path", "fingerprint", status.alias("status"), "error", "reused", "measurements")


def run_counts(entries: DataFrame, discovered: int | Column) -> DataFrame:
    """discovered, total, completed, failed, remaining, analyzed and reused of one run."""
    complete = F.col("status") == "complete"
    return entries.agg(
        (F.lit(discovered) if isinstance(discovered, int) else discovered).cast("long").alias("discovered"),
        F.count("*").alias("total"),
        F.count_if(complete).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(~F.col("status").isin("complete", "failed")).alias("remaining"),
        F.count_if(complete & ~F.col("reused")).alias("analyzed"),
        F.count_if(complete & F.col("reused")).alias("reused"),
    )
