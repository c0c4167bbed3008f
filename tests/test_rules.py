"""Rules without SQL, against plain versions: seeded draws, numbering, headers, measurement rules, choices without a window over all rows."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from timbral.operators import cache, dataset, evaluation
from timbral.schemas import MEASURES, measurement_problem
from timbral.sources import wav
from timbral.streaming import jobs


def twister(*parts):
    return random.Random(int.from_bytes(hashlib.sha256("|".join(str(p) for p in parts).encode()).digest()[:16], "big"))


def percentile(values, share):
    place = share * (len(values) - 1)
    low = int(place)
    return values[low] + (place - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def test_bootstrap_draws_query_values_in_order(spark):
    rows = [("a", 3, 0.25), ("a", 1, 1.0), ("a", 2, 0.5), ("a", 9, None), ("b", 1, 2.0), ("b", 2, 2.0), ("c", 1, None)]
    df = spark.createDataFrame(rows, "arm string, query long, value double").repartition(3)
    got = {r["arm"]: (r["n"], r["mean"], r["low"], r["high"]) for r in evaluation.bootstrap_means(df, ["arm"], "s", 600).collect()}
    values, means = [1.0, 0.5, 0.25], []
    for k in range(600):
        rng = twister("s", "a", k)
        means.append(sum(values[rng.randrange(3)] for _ in range(3)) / 3)
    means.sort()
    assert set(got) == {"a", "b"} and got["b"] == (2, 2.0, 2.0, 2.0)
    assert got["a"] == pytest.approx((3, 1.75 / 3, percentile(means, 0.025), percentile(means, 0.975)))
    with pytest.raises(Exception, match="a bootstrap over more values than"):
        evaluation.bootstrap_means(df, ["arm"], "s", 600, most=2).collect()


def test_random_arm_draws_from_the_list_as_it_is(spark):
    rows = [(q, f"i{k * 7 % 11}", k) for q in ("k1", "k2") for k in range(11)]
    df = spark.createDataFrame(rows, "query string, item string, place int").repartition(4)
    got = {(r["query"], r["position"]): r["item"] for r in dataset.random_arm(df, "seed", "v3", order="place").collect()}
    for q in ("k1", "k2"):
        rng, pool, want = twister("seed", "v3", "random", q), [f"i{k * 7 % 11}" for k in range(11)], []
        while pool:
            want.append(pool.pop(rng.randrange(len(pool))))
        assert [got[q, n] for n in range(1, 12)] == want


@pytest.mark.parametrize("keys", [[], list(range(997, 0, -3)), [hashlib.sha256(str(k).encode()).hexdigest() for k in range(500)], ["", "a", "ab", "abcdefgh", "abcdefgi", "é", "z"]])
def test_numbers_follow_the_key(spark, keys):
    kind = "long" if keys and isinstance(keys[0], int) else "string"
    df = spark.createDataFrame([(k,) for k in keys], f"content {kind}").repartition(5)
    got = {r["content"]: r["_nth"] for r in jobs.number_rows(df, "content", each=60).collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys, key=lambda x: x.encode() if kind == "string" else x), 1)}


def test_lenient_headers(spark):
    def file(channels=1, rate=8000, align=2, size=400, tag=1, riff=None, cut=0, extra=b""):
        form = struct.pack("<HHIIHH", tag, channels, rate, 7, align, 16)
        body = b"WAVE" + extra + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", size) + b"\0" * size
        data = b"RIFF" + struct.pack("<I", len(body) if riff is None else riff) + body
        return data[: len(data) - cut]

    cases = {
        "plain": (file(), (None, 8000, 1, 200, 25.0)),
        "riff size": (file(riff=1), (None, 8000, 1, 200, 25.0)),
        "tag": (file(tag=85), (None, 8000, 1, 200, 25.0)),
        "odd data without its pad": (file(size=401), (None, 8000, 1, 200, 25.0)),
        "cut data": (file(cut=1), ("unsupported_format", None, None, None, None)),
        "three channels": (file(channels=3), ("unsupported_channels", None, None, None, None)),
        "no rate": (file(rate=0), ("unsupported_format", None, None, None, None)),
        "empty data": (file(size=0), (None, 8000, 1, 0, 0.0)),
        "other chunk": (file(extra=b"LIST" + struct.pack("<I", 3) + b"abc\0"), (None, 8000, 1, 200, 25.0)),
        "no file": (b"", ("unsupported_format", None, None, None, None)),
        "null": (None, ("unsupported_format", None, None, None, None)),
    }
    df = spark.createDataFrame([(k, bytearray(d) if d is not None else None) for k, (d, _) in cases.items()], "name string, content binary")
    got = {r["name"]: (r["error"], r["rate"], r["channels"], r["frames"], r["duration_ms"]) for r in wav.scan_headers(df).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}


def test_measurement_rules(spark):
    unit = {n: u for n, (u, _, _) in MEASURES.items()}
    rows = [
        ("tempo", 0.0, None, 0.9, "not_positive"),
        ("tempo", 120.0, None, None, "confidence_missing"),
        ("tempo", 120.0, None, 0.9, None),
        ("tempo", None, "not_implemented", 0.9, "confidence_of_unknown"),
        ("tempo", None, "not_implemented", None, None),
        ("fundamental", 0.0, None, 0.9, "not_positive"),
        ("rms", 0.0, None, None, None),
        ("rms", 0.5, None, 1.5, "confidence_range"),
    ]
    df = spark.createDataFrame([(n, v, unit[n], r, c, w) for n, v, r, c, w in rows], "name string, value double, unit string, reason string, confidence double, want string")
    for r in df.withColumn("got", measurement_problem(F.col("name"), F.col("value"), F.col("unit"), F.col("reason"), F.col("confidence"))).collect():
        assert r["got"] == r["want"], r


def test_first_of_role_and_budgets(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["kick", "bass", None]), rng.randrange(4)) for k in range(300)]
    df = spark.createDataFrame(rows, "sample_id long, role string, priority int").repartition(6)
    got = {r["sample_id"] for r in dataset.select_per_role(df, 20).where("selected").collect()}
    want = set()
    for role in ("kick", "bass", None):
        want |= {k for _, k in sorted((p, k) for k, r, p in rows if r == role)[:20]}
    assert got == want
    entries = [(f"k{k}", f"2024-01-0{1 + k % 3}T0{k % 7}:00:{k % 60:02d}Z", rng.randrange(1, 50), k % 2) for k in range(200)]
    df = spark.createDataFrame(entries, "cache_key string, created_at string, size long, shard int").repartition(4)
    for by in (None, "shard"):
        got = {r["cache_key"] for r in cache.survivors(df, 60, 1200, by).collect()}
        want = set()
        for shard in (0, 1) if by else (None,):
            n = total = 0
            for key, _, size, s in sorted(entries, key=lambda e: (e[1], e[0]), reverse=True):
                if shard is None or s == shard:
                    n, total = n + 1, total + size
                    if n <= 60 and total <= 1200:
                        want.add(key)
        assert got == want


def test_identities_of_records(spark):
    from timbral.functions.documents import digest
    from timbral.operators import records

    rows = [(1, "b1", "r1", None), (2, "b1", "r2", None), (3, "b1", "r1", digest({"batch": "b1", "reader": "r1"})), (4, "b1", "r1", "other")]
    df = spark.createDataFrame(rows, "k int, batch string, reader string, stated string")
    got = {r["k"]: (r["version"], r["problem"]) for r in records.analysis_version(df, ["batch", "reader"]).collect()}
    one = digest({"batch": "b1", "reader": "r1"})
    assert got == {1: (one, None), 2: (digest({"batch": "b1", "reader": "r2"}), None), 3: (one, None), 4: (one, "descriptor_mismatch")}
    entries = [(r, p, f"d{p}", "linear", 3, 0.5, 1.0, None) for r in (1, 2) for p in range(4)] + [(3, p, f"d{p}", "linear", 4, 0.5, 1.0, None) for p in range(4)]
    df = spark.createDataFrame(entries, "record int, place int, dimension string, transform string, n long, mean double, std double, inactive_reason string").repartition(5)
    ids = {r["record"]: r["normalization_id"] for r in records.normalization_id(df, ["record"]).collect()}
    assert ids[1] == ids[2] != ids[3] and len(ids[1]) == 64
