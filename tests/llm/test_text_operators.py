"""Operators on documents against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from timbral.llm import decontaminate, jaccard_join, licenses
from timbral.llm.jaccard_join import jaccard_components
from timbral.llm.mixing import mix_sources, source_rates
from timbral.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "And", "tion", "Éau", "ère", "st", "blé", "x1", "onand"]) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(5, 90)) for _ in range(12)]
    out = [None, "", "   \n", "one", "One", "one two", "aaaa" * 60, "a" * 49, "a" * 50, base[0], base[0]]
    for k in range(50):
        parts = base[k % 12].split(" ")
        for _ in range(rng.randrange(0, 4)):
            parts[rng.randrange(len(parts))] = rng.choice(["new", "zz", "ün"])
        out.append(" ".join(parts) + ("\n" + base[(k + 1) % 12] if k % 7 == 0 else ""))
    out.append("\n".join([base[3]] * 4))
    return [(k * 3 % 101, t, "en", None, None) for k, t in enumerate(out)]


def brute_repeats(rows):
    seen, out = {}, {}
    for d, t in sorted((r[0], (r[1] or "").encode()) for r in rows):
        keep = bytearray(b"\1" * len(t))
        for p in range(len(t) - 49):
            if seen.setdefault(t[p : p + 50], d) < d:
                keep[p : p + 50] = bytes(50)
        kept = bytes(c for c, k in zip(t, keep, strict=True) if k)
        spans = sum(not keep[i] and (i == 0 or keep[i - 1]) for i in range(len(t)))
        out[d] = (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("home_bytes", "hot_runs"), [(400, 1 << 14), (400, 2), (3 << 20, 5), (3 << 20, 0)])
def test_repeats_are_those_of_brute_force(spark, rows, home_bytes, hot_runs):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("to", F.lit(1)).withColumn("payload", F.lit("x"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs, home_bytes, hot_runs).collect()}
    assert got == brute_repeats(rows)
    assert sum(x[1] for x in got.values()) > 1000


def test_repeats_in_parts_of_long_texts(spark, rows, monkeypatch):
    from timbral.llm import suffix_dedup

    table = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text").toArrow()
    whole = [suffix_dedup._runs(d, o)[1].sum() for d, o, _, _ in suffix_dedup._chunks(table)]
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 64)
    parts = [suffix_dedup._runs(d, o)[1].sum() for d, o, _, _ in suffix_dedup._chunks(table)]
    assert len(parts) > len(whole) and sum(parts) == sum(whole)  # every window once


def test_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert remove_repeats(spark.createDataFrame([(None, "x" * 60, None, None, None)], SCHEMA)).count() == 0


def shingles(text, width):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < width:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def brute_components(rows, width, at_least):
    sets = {r[0]: shingles(r[1], width) for r in rows}
    root = {d: d for d in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= at_least * len(sets[a] | sets[b]) and both:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("width", "at_least", "block"), [(3, 90, 1000), (5, 80, 3), (1, 60, 5)])
def test_components_are_those_of_brute_force(spark, rows, width, at_least, block):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("cls", F.lit("x")).withColumn("root", F.lit(2))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, width, at_least, 100, block).collect()}
    assert got == brute_components(rows, width, at_least)


def test_components_of_nothing(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search_of_long_lists_is_exact():
    rng = random.Random(2)
    import numpy as np

    sets = [np.unique(np.array([rng.randrange(300) for _ in range(rng.randrange(60, 120))], np.uint64)) for _ in range(150)]
    sets += [np.unique(np.append(sets[k % 7], np.array([1000 + k], np.uint64))) for k in range(60)]
    index = jaccard_join.Index(sets)
    index.drop(np.arange(0, 150, 2))
    index.drop(np.arange(1, 100, 2))
    for k, s in enumerate(sets):
        want = [j for j, t in enumerate(sets) if index.present[j] and 100 * len(np.intersect1d(s, t)) >= 70 * len(np.union1d(s, t))]
        assert sorted(index.links(s, 70, 100)) == want, k


def distance_in(pattern, text):
    """Least edit distance of pattern to any part of text (Sellers)."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_is_that_of_brute_force(spark):
    rng = random.Random(9)
    items = [(k, words(rng, n)) for k, n in enumerate([6, 14, 22, 40, 60])] + [(7, None), (8, "short"), (9, ""), (10, "Two, words"), (11, "é")]
    docs = [(0, None), (1, ""), (2, words(rng, 50)), (100, "SHORT, and (two words) É"), (101, "shorty twotwo words éé two"), (102, "x short"), (103, "two -- words")]
    for d in range(3, 40):
        text = list(items[d % 5][1])
        for _ in range(rng.randrange(0, 1 + len(text) // 8)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(["", "q", "z"])
        docs.append((d, words(rng, rng.randrange(4)) + " " + "".join(text).upper() + " -- " + words(rng, rng.randrange(4))))
    form = lambda t: decontaminate.normal_form(*decontaminate.text_bytes(__import__("pyarrow").array([t])))[0].tobytes().strip()
    want = {}
    for d, t in docs:
        for i, x in items:
            p = form(x)
            if len(p) >= decontaminate.SHORT and (n := distance_in(p, form(t))) <= int(len(p) * 0.1):
                want[d, i] = n
            elif 0 < len(p) < decontaminate.SHORT and b" " + p + b" " in b" " + form(t) + b" ":
                want[d, i] = 0
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    found = decontaminate.contamination(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in found} == want
    assert len(want) > 20 and any(want.values())
    assert all(r["short_item"] == (r["item_id"] in (8, 10, 11)) for r in found) and sum(r["short_item"] for r in found) == 5
    exact = next(r for r in found if r["distance"] == 0 and not r["short_item"])
    text = dict(docs)[exact["doc_id"]].encode()[exact["start"] : exact["stop"]]
    assert form(text.decode()) == form(dict(items)[exact["item_id"]])


def test_decontamination_without_items(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_long_items_and_items_without_an_id(spark):
    import time

    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(5_000))
    changed = list(long)
    for _ in range(250):
        at = rng.randrange(len(changed))
        changed[at : at + rng.randrange(2)] = rng.choice(["", "q", "z"])
    mid = " ".join(f"v{rng.randrange(10**5)}" for _ in range(400))
    docs = spark.createDataFrame([(1, "before it " + "".join(changed) + " after it"), (2, long[: len(long) // 2]), (3, "x " + mid[:-30] + " y")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, long), (None, mid), (None, long[:200]), (None, None)], "item_id long, text string").coalesce(1)
    began = time.time()
    got = sorted((r["doc_id"], r["item_id"] or 0, r["item_length"]) for r in decontaminate.contamination(docs, items).collect())
    assert time.time() - began < 120
    assert got == [(1, 0, 200), (1, 1, len(long)), (2, 0, 200), (3, 0, len(mid))]


def test_long_and_short_distances_agree():
    rng = random.Random(8)
    for _ in range(200):
        pattern, text = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))).encode() for n in (90, 150))
        for anchored in (False, True):
            low, at = decontaminate.myers_long(decontaminate._long_bits(pattern), len(pattern), text, anchored)
            best = [len(pattern)]
            row = list(range(len(pattern) + 1))
            for k, c in enumerate(text, 1):
                new = [k if anchored else 0]
                for j, p in enumerate(pattern, 1):
                    new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
                row = new
                best.append(row[-1])
            assert (low, at) == (min(best), best.index(min(best)))


def test_benchmark_in_blocks_gives_the_same(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows[9:40])], "item_id long, text string")
    whole = sorted(decontaminate.contamination(docs, items).collect())
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 2000)
    assert sorted(decontaminate.contamination(docs, items).collect()) == whole and whole


def test_mixing_meets_the_rates(spark):
    docs = spark.createDataFrame([(k, "x" * (1 + k % 3), "en", None if k % 5 == 0 else "ab"[k % 2], 1) for k in range(4000)] + [(4000, None, "en", "none", 0)], SCHEMA)
    rates = {r["source"]: r["rate"] for r in source_rates(docs, {"a": 3, "b": 1, None: 40}).collect()}
    mixed = mix_sources(docs, {"a": 3, "b": 1, None: 40})
    count = {r["source"]: r["n"] / r["d"] for r in mixed.groupBy("source").agg(F.count("*").alias("n"), F.lit(1).alias("d")).collect()}
    size = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert rates["none"] == 0 and "none" not in count
    for s in ("a", "b", None):
        assert count[s] / size[s] == pytest.approx(rates[s], rel=0.2)
    again = mix_sources(docs.repartition(7), {"a": 3, "b": 1, None: 40})
    assert sorted(r["shuffle_key"] for r in mixed.collect()) == sorted(r["shuffle_key"] for r in again.collect())
    keys = [r["shuffle_key"] for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys)  # the partitions follow each other


def test_mixing_large_means_and_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "x" * (1000 if k == 0 else 1), "en", "big" if k == 0 else "small", 1) for k in range(41)], SCHEMA).withColumn("copy", F.lit("old")).withColumn("cdf", F.lit(1))
    mixed = mix_sources(docs)
    n = mixed.where("source = 'small'").count()
    assert 40 * 13 * 0.8 < n < 40 * 13 * 1.2  # 1040 bytes, half of them for 40
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "cdf", "copy", "shuffle_key"]
    assert mix_sources(docs.where("false")).count() == 0


def brute_licenses(rows, least):
    form = lambda t: re.findall(r"[a-z0-9à-öø-ÿ]+", (t or "").lower())
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    out = {}
    for d, t in rows:
        for name, text in licenses.TEMPLATES.items():
            share = len(cut(form(t)) & cut(form(text))) / len(cut(form(text)))
            if share >= least:
                out[d, name] = share
    return out


def test_licenses_are_those_of_brute_force(spark):
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, "Released under"), (3, "no licence at all in this text, of nine words")]
    for k, (_name, text) in enumerate(sorted(licenses.TEMPLATES.items()) * 3):
        parts = text.split()
        if k % 3 == 1 and len(parts) > 60:
            parts[len(parts) // 2] = "changed"
        rows.append((10 + k, words(rng, rng.randrange(40)) + "\n" + " ".join(parts) + "\n" + words(rng, rng.randrange(40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(0))
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan_licenses(docs).collect()}
    assert got == pytest.approx(brute_licenses(rows, 0.8)) and len(got) >= 42
    assert licenses.scan_licenses(docs.where("false")).count() == 0
