"""Registered queries of audio extraction. The test tables have no audio: each embedding becomes a WAV file of 64 frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.operators import extraction
from timbral.schemas import BANDS, TONICS
from timbral.sources import wav
from timbral.sources.views import read

RATE = 1600


def files(spark: SparkSession, d: str) -> DataFrame:
    """vec_id and content: 64-bit float mono at RATE; one of 50 lacks its last byte."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = [wav.encode(np.asarray(e, float)[:, None], RATE) for e in batch["embedding"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "content": [c[:-1] if i % 50 == 0 else c for i, c in zip(batch["vec_id"], whole, strict=True)]})

    return read(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(made, "vec_id long, content binary")


def measured(spark: SparkSession, d: str) -> DataFrame:
    rows = extraction.measure(files(spark, d)).select("vec_id", "error", F.explode_outer("measurements").alias("m"))
    named = lambda n, c: F.max(F.when(F.col("m.name") == n, F.col(f"m.{c}")))
    value = lambda n: F.round(named(n, "value"), 9).alias(n)
    why = lambda n: named(n, "unavailable_reason").alias(f"{n}_reason")
    return rows.groupBy("vec_id", "error").agg(value("rms"), value("peak"), value("crest_factor"), why("loudness"), why("band_bass"), why("band_high"), why("tempo"))


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Levels of eight blocks of eight frames."""
    df = wav.summaries(files(spark, d)).where("error is null")
    return df.select("vec_id", F.posexplode("envelope").alias("block", "level")).select("vec_id", F.col("block").cast("long").alias("block"), F.round("level", 9).alias("level"))


def second_onsets(spark: SparkSession, d: str) -> DataFrame:
    return wav.summaries(files(spark, d)).where("error is null").select("vec_id", extraction.several_onsets(F.col("envelope")).alias("several"))


def headers(spark: SparkSession, d: str) -> DataFrame:
    return wav.headers(files(spark, d)).select("vec_id", "error", "rate", "channels", "frames")


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    found = files(spark, d).select("vec_id", wav.is_wave(F.col("content")).alias("wave"), F.explode(wav.chunks("content")).alias("c"))
    return found.select("vec_id", "wave", "c.name", "c.start", "c.size")


def resumed(spark: SparkSession, d: str) -> DataFrame:
    """A run that finds every second file analysed before."""
    some = files(spark, d).withColumn("path", F.concat(F.lit("a/"), "vec_id")).drop("vec_id")
    before = extraction.measure(some.where("crc32(path) % 2 = 0").select(F.sha2("content", 256).alias("fingerprint"), "content")).where("error is null")
    return extraction.run_counts(extraction.run(some, before.select("fingerprint", "measurements")), F.count("*"))


def lenient_headers(spark: SparkSession, d: str) -> DataFrame:
    return wav.scan_headers(files(spark, d)).select("vec_id", "error", "rate", "channels", "frames", "duration_ms")


def half_resumed(spark: SparkSession, d: str) -> DataFrame:
    """A run over all files that finds those of even number analysed before."""
    some = files(spark, d).withColumn("path", F.concat(F.lit("a/"), "vec_id"))
    before = extraction.measure(some.where("vec_id % 2 = 0").select(F.sha2("content", 256).alias("fingerprint"), "content")).where("error is null")
    return extraction.run_counts(extraction.run(some.drop("vec_id"), before.select("fingerprint", "measurements")), F.count("*"))


def tone_library(spark: SparkSession, d: str) -> DataFrame:
    """A run over one file of 10 ms at 48 kHz for each part, every file of bytes of its own: what a drain of the queue measures."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(480) / 48000
        for batch in batches:
            whole = [wav.encode((0.3 * np.sin(2 * np.pi * (110 + k / 64) * t))[:, None], 48000) for k in batch["p_partkey"]]
            yield pd.DataFrame({"path": [f"t/{k}.wav" for k in batch["p_partkey"]], "content": whole})

    files = read(spark, d, "part").select("p_partkey").repartition(spark.sparkContext.defaultParallelism).mapInPandas(made, "path string, content binary")
    none = spark.createDataFrame([], "fingerprint string, measurements array<struct<name: string, unit: string, value: double, unavailable_reason: string, confidence: double>>")
    return extraction.run_counts(extraction.run(files, none), F.count("*"))


def tones(spark: SparkSession, d: str) -> DataFrame:
    """A second of one tone for each nation, and twelve seconds of a scale for each region: what is known of them beforehand."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(48000) / 48000
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "content": [wav.encode(0.5 * np.sin(2 * np.pi * (60 + 37 * k) * t)[:, None], 48000) for k in batch["k"]]})

    def scales(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = []
            for tonic in batch["k"]:
                weights = np.array(extraction.RATINGS["major"]) - 2
                notes = [(220 * 2 ** ((tonic + n - 9) % 12 / 12), int(12 * 48000 * w / weights.sum())) for n, w in enumerate(weights)]
                files.append(wav.encode(np.concatenate([0.5 * np.sin(2 * np.pi * f * np.arange(n) / 48000) for f, n in notes])[:, None], 48000))
            yield pd.DataFrame({"k": batch["k"], "content": files})

    value = lambda n: F.filter("measurements", lambda m: m["name"] == n)[0]["value"]
    heard = extraction.measure(read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")).mapInPandas(made, "k long, content binary"))
    near = F.abs(F.log2(value("fundamental") / (60 + 37 * F.col("k"))) * 1200) < 8
    widest = F.array_max(F.array(*(F.struct(value(b).alias("share"), F.lit(b).alias("band")) for b in BANDS)))
    single = heard.select(F.lit("tone").alias("kind"), "k", F.round(value("spectral_centroid")).cast("long").alias("centroid"), F.round(value("spectral_rolloff")).cast("long").alias("rolloff"), F.coalesce(near, F.lit(False)).alias("pitch"), widest["band"].alias("band"), F.col("key.tonic").alias("tonic"), F.col("key.mode").alias("mode"))
    keys = extraction.measure(read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k")).mapInPandas(scales, "k long, content binary"))
    none = F.lit(None)
    return single.unionByName(keys.select(F.lit("scale").alias("kind"), "k", none.cast("long").alias("centroid"), none.cast("long").alias("rolloff"), none.cast("boolean").alias("pitch"), none.cast("string").alias("band"), F.col("key.tonic").alias("tonic"), F.col("key.mode").alias("mode")))


def _band_sql(f: str) -> str:
    return "CASE " + " ".join(f"WHEN {f} >= {low} AND {f} < {high} THEN '{name}'" for name, (low, high) in zip(BANDS, wav.EDGES.values(), strict=True)) + " END"


_X = "x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings)"
_STATS = f"{_X}, s AS (SELECT vec_id, list_max(list_transform(v, lambda e: abs(e))) AS top, sqrt(list_avg(list_transform(v, lambda e: e * e))) AS rms FROM x)"
_BAD = "vec_id % 50 = 0"

QUERIES = {
    "S4_A1_A13_measures": (
        measured,
        f"""WITH {_STATS} SELECT vec_id, CASE WHEN {_BAD} THEN 'invalid_audio' END AS error, CASE WHEN NOT {_BAD} THEN round(rms, 9) END AS rms, CASE WHEN NOT {_BAD} THEN round(top, 9) END AS peak,
CASE WHEN NOT {_BAD} THEN round(greatest(1.0, top / rms), 9) END AS crest_factor, CASE WHEN NOT {_BAD} THEN 'too_short_for_integrated_loudness' END AS loudness_reason,
CAST(NULL AS VARCHAR) AS band_bass_reason, CASE WHEN NOT {_BAD} THEN 'band_exceeds_nyquist' END AS band_high_reason, CASE WHEN NOT {_BAD} THEN 'not_implemented' END AS tempo_reason FROM s""",
    ),
    "A7_envelope": (
        envelopes,
        f"""WITH {_X}, b AS (SELECT vec_id, k AS block, sqrt(list_avg(list_transform(v[8 * k + 1 : 8 * k + 8], lambda e: e * e))) AS level FROM x, range(8) r(k) WHERE NOT {_BAD})
SELECT vec_id, block, round(level / max(level) OVER (PARTITION BY vec_id), 9) AS level FROM b""",
    ),
    "A8_second_onsets": (second_onsets, None),
    "S6_headers": (headers, f"SELECT vec_id, CASE WHEN {_BAD} THEN 'invalid_audio' END AS error, CASE WHEN NOT {_BAD} THEN CAST({RATE} AS BIGINT) END AS rate, CASE WHEN NOT {_BAD} THEN CAST(1 AS BIGINT) END AS channels, CASE WHEN NOT {_BAD} THEN CAST(64 AS BIGINT) END AS frames FROM embeddings"),
    "S6_lenient_headers": (lenient_headers, f"SELECT vec_id, CASE WHEN {_BAD} THEN 'unsupported_format' END AS error, CASE WHEN NOT {_BAD} THEN CAST({RATE} AS BIGINT) END AS rate, CASE WHEN NOT {_BAD} THEN CAST(1 AS BIGINT) END AS channels, CASE WHEN NOT {_BAD} THEN CAST(64 AS BIGINT) END AS frames, CASE WHEN NOT {_BAD} THEN CAST(64 AS DOUBLE) / {RATE} * 1000 END AS duration_ms FROM embeddings"),
    "A4_A6_A10_A12_tones": (
        tones,
        f"""WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS k, 60 + 37 * n_nationkey AS f FROM nation)
SELECT 'tone' AS kind, k, CAST(f AS BIGINT) AS centroid, CAST(f AS BIGINT) AS rolloff, true AS pitch, {_band_sql("f")} AS band, CAST(NULL AS VARCHAR) AS tonic, CAST(NULL AS VARCHAR) AS mode FROM t
UNION ALL SELECT 'scale', r_regionkey, NULL, NULL, NULL, NULL, ({list(TONICS)})[r_regionkey + 1], 'major' FROM region""",
    ),
    "S7_S19_chunks": (
        chunk_rows,
        f"SELECT vec_id, true AS wave, 'fmt ' AS name, CAST(20 AS BIGINT) AS start, CAST(16 AS BIGINT) AS size FROM embeddings UNION ALL SELECT vec_id, true, 'data', CAST(44 AS BIGINT), CAST(512 AS BIGINT) FROM embeddings WHERE NOT {_BAD}",
    ),
    "A15_A16_resumed_run": (resumed, None),
    "A15_A16_tone_library": (tone_library, "SELECT count(*) AS discovered, count(*) AS total, count(*) AS completed, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS remaining, count(*) AS analyzed, CAST(0 AS BIGINT) AS reused FROM part"),
    "A15_A16_half_resumed_run": (
        half_resumed,
        f"SELECT count(*) AS discovered, count(*) AS total, count(*) FILTER (WHERE NOT {_BAD}) AS completed, count(*) FILTER (WHERE {_BAD}) AS failed, CAST(0 AS BIGINT) AS remaining, count(*) FILTER (WHERE NOT {_BAD} AND vec_id % 2 = 1) AS analyzed, count(*) FILTER (WHERE NOT {_BAD} AND vec_id % 2 = 0) AS reused FROM embeddings",
    ),
}
