"""Audio reading and measures against hand-made signals with known answers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.operators import extraction
from timbral.sources import wav


def tone(rate, seconds, hertz, level=0.5):
    return level * np.sin(2 * np.pi * hertz * np.arange(round(rate * seconds)) / rate)[:, None]


def pcm(samples, bits, rate=8000, channels=1, tag=1):
    wide = channels * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(samples) % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, channels, rate, rate * wide, wide, bits) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)


@pytest.mark.parametrize(
    ("data", "expected"),
    [
        (pcm(bytes([0, 128, 255]), 8), [-1.0, 0.0, 127 / 128]),
        (pcm(struct.pack("<3h", -32768, 0, 16384), 16), [-1.0, 0.0, 0.5]),
        (pcm(b"\x00\x00\x80" + b"\x00\x00\x40", 24), [-1.0, 0.5]),
        (pcm(struct.pack("<2i", -(2**31), 2**30), 32), [-1.0, 0.5]),
        (pcm(struct.pack("<2f", 1.5, -0.25), 32, tag=3), [1.5, -0.25]),
        (pcm(struct.pack("<2d", 1.5, -0.25), 64, tag=3), [1.5, -0.25]),
    ],
)
def test_six_formats(data, expected):
    rate, x = wav.decode(data)
    assert rate == 8000 and x[:, 0].tolist() == expected


@pytest.mark.parametrize(
    ("data", "code"),
    [
        (None, "invalid_audio"),
        (b"", "invalid_audio"),
        (b"OggS" + b"\0" * 40, "unsupported_format"),
        (pcm(b"\0\0", 16)[:-1], "invalid_audio"),
        (pcm(b"", 16), "empty_audio"),
        (pcm(b"\0" * 6, 16, channels=3), "unsupported_channels"),
        (pcm(b"\0\0", 16, tag=7), "unsupported_format"),
        (pcm(b"\0\0\0", 16), "invalid_audio"),
        (pcm(struct.pack("<d", float("nan")), 64, tag=3), "invalid_audio"),
    ],
)
def test_refused_files(data, code):
    with pytest.raises(ValueError, match=code):
        wav.decode(data)


def measures(spark, **files):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "name string, content binary")
    rows = extraction.measure(df).collect()
    return {r.name: {m["name"]: (m["value"], m["unavailable_reason"]) for m in r.measurements} if r.error is None else r.error for r in rows}


def test_measures(spark):
    click = np.zeros((4800, 1))
    click[1200:1440] = 0.8
    twice = click.copy()
    twice[3600:3840] = 0.8
    found = measures(
        spark,
        tone=wav.encode(tone(48000, 0.4, 1000), 48000),
        low=wav.encode(np.hstack([tone(48000, 1, 100), tone(48000, 1, 100)]), 48000),
        silent=wav.encode(np.zeros((100, 2)), 8000),
        short=wav.encode(np.array([[0.25]]), 8000),
        odd=wav.encode(tone(8000, 1, 440), 8000),
        click=wav.encode(click, 48000),
        twice=wav.encode(twice, 48000),
        bad=b"RIFF",
    )
    assert found["bad"] == "invalid_audio"
    one = found["tone"]
    assert one["loudness"][0] == pytest.approx(-9.024495184403492, abs=1e-9)
    assert one["rms"][0] == pytest.approx(0.5 / 2**0.5) and one["crest_factor"][0] == pytest.approx(2**0.5)
    assert one["spectral_centroid"][0] == pytest.approx(1000) and one["spectral_rolloff"][0] == pytest.approx(1000) and one["band_mid"][0] == pytest.approx(1)
    assert one["tempo"] == (None, "not_implemented")
    assert found["low"]["band_bass"][0] == pytest.approx(1)
    assert found["silent"]["rms"] == (0.0, None) and found["silent"]["peak"] == (0.0, None)
    assert {found["silent"][n] for n in ("crest_factor", "loudness", "band_sub", "decay")} == {(None, "silent_audio")}
    assert found["short"]["spectral_centroid"][1] == "too_short_for_spectral_analysis" and found["short"]["attack"][1] == "too_short_for_envelope_analysis"
    assert found["odd"]["loudness"][1] == "unsupported_loudness_sample_rate" and found["odd"]["band_high"][1] == "band_exceeds_nyquist"
    assert found["click"]["transient_position"][0] == pytest.approx(25) and found["click"]["transient_strength"][0] == pytest.approx(1)
    assert found["click"]["attack"][0] == pytest.approx(0) and found["click"]["decay"][0] == pytest.approx(5)
    assert found["twice"]["attack"] == (None, "multiple_onsets")
    for row in (v for v in found.values() if isinstance(v, dict)):
        assert all((value is None) == (reason is not None) for value, reason in row.values())


def test_weighting_of_other_rates_keeps_the_loudness_of_a_tone(spark):
    found = measures(spark, a=wav.encode(tone(44100, 1, 1000), 44100), b=wav.encode(tone(96000, 1, 1000), 96000), c=wav.encode(tone(48000, 1, 1000), 48000))
    assert found["a"]["loudness"][0] == pytest.approx(found["c"]["loudness"][0], abs=0.01)
    assert found["b"]["loudness"][0] == pytest.approx(found["c"]["loudness"][0], abs=0.01)


def test_weighting_is_the_recursion(spark):
    x = np.random.default_rng(1).normal(size=2000)
    y = x
    for b, a in wav.K_WEIGHTING:
        out = np.zeros(len(y))
        for n in range(len(y)):
            out[n] = sum(b[k] * y[n - k] for k in range(3) if n >= k) - sum(a[k] * out[n - k] for k in (1, 2) if n >= k)
        y = out
    assert np.allclose(np.convolve(x, wav._k_response(48000))[: len(x)], y, atol=1e-10)


def test_run_goes_on(spark, tmp_path):
    for name, data in {"a.wav": wav.encode(tone(8000, 0.1, 300), 8000), "sub/b.WAV": wav.encode(tone(8000, 0.1, 300), 8000), "c.wav": wav.encode(tone(8000, 0.1, 500), 8000), "d.wav": b"no", "e.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = wav.discover(spark, str(tmp_path))
    assert files.where("whole").count() == 4
    none = spark.createDataFrame([], extraction.run(files, spark.createDataFrame([], "fingerprint string, measurements array<struct<name:string,unit:string,value:double,unavailable_reason:string>>")).select("fingerprint", "measurements").schema)
    first = extraction.run(files.select("path", "content"), none)
    assert extraction.run_counts(first, 4).first().asDict() == {"discovered": 4, "total": 4, "completed": 3, "failed": 1, "remaining": 0, "analyzed": 3, "reused": 0}
    again = extraction.run(files.select("path", "content"), first.where("status = 'complete'").select("fingerprint", "measurements"))
    counts = extraction.run_counts(again, 4).first()
    assert (counts.completed, counts.failed, counts.reused) == (3, 1, 3)


def test_mixed_pair(spark):
    a, b = wav.encode(np.array([[0.5], [0.5]]), 8000), wav.encode(np.array([[0.25, -0.25]]), 8000)
    df = spark.createDataFrame([(bytearray(a), bytearray(b)), (bytearray(a), bytearray(b"x"))], "a binary, b binary").select(wav.mixed("a", "b").alias("m"))
    got = [r.m for r in df.collect()]
    assert np.allclose(wav.decode(bytes(got[0]))[1], np.array([[0.75, 0.25], [0.5, 0.5]]) * 10 ** (-0.3)) and got[1] is None


def test_empty_input(spark):
    assert extraction.measure(spark.createDataFrame([], "path string, content binary")).count() == 0
    assert spark.range(1).select(F.size(wav.chunks(F.lit(b"RIFF").cast("binary")))).first()[0] == 0
