"""Personal data: the fixed forms against Python's patterns, the bootstrap against a plain version, and edge cases."""

import hashlib
import math
import random
import re

import duckdb
import pytest

from timbral.llm import personal_data
from timbral.llm.personal_data import find_personal_data

SCHEMA = "doc_id long, text string"
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def plain_base(text):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind, m[0]))
    return sorted(out)


def listed(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind, *_ in spans)


def plain_row(doc, text):
    base = plain_base(text)
    counts = [sum(b[3] == kind for b in base) for kind in FORMS]
    return doc, *counts, hashlib.sha256(listed(base).encode()).hexdigest()


def rows_of(df):
    assert df.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    return [tuple(r) for r in df.collect()]


def made(seed, n):
    """Texts of pieces that nearly are, are, or touch personal data."""
    rng = random.Random(seed)
    parts = ["a.b@c.de", "x@y", "@", ".", "..", "_d", "@e.f", "1.2.3.4", "999.1.2.3", "1.2.3.4.5.6.7.8", "01.002.255.256", "00000000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", " - ", "-", " ", "5", "12", "+1 (017) 555-7713", "+", "+1", "(", ")", "+49.30.12345678", "1234567890123456789", "12345678901234567890", "é", "😀", "\n", "word", "A%", "4929348385146306", "+4929348385146306", " "]
    return [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(n)]


def test_fixed_forms(spark):
    texts = made(3, 1500)
    texts += [(9000, None), (9001, ""), (None, "mail a@b.cd"), (9002, "a@b.cd"), (9002, "a@b.cd"), (9003, "😀 é a@b.cd, 10.0.0.1"), (9004, "+1 22 333 44 55 " * 3)]
    got = rows_of(find_personal_data(spark.createDataFrame(texts, SCHEMA).selectExpr("*", "1 AS key", "'x' AS spans", "2 AS start")))
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((r[:6] for r in got), key=order) == sorted((plain_row(d, t) for d, t in texts), key=order)
    assert all(s == listed(plain_base(dict(texts)[d])) for d, *_, s, n in got if n == 0 and d is not None)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01/documents.parquet"
    texts = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}')").fetchall()
    got = rows_of(find_personal_data(spark.read.parquet(sf)))
    assert sorted(r[:6] for r in got) == sorted(plain_row(d, t) for d, t in texts)
    assert sum(r[7] for r in got) == 0  # words stand around its data by chance


def test_hostile_texts(spark):
    """Long runs that would make a pattern fall back: linear, and no stack is used up."""
    n = 200_000
    texts = ["1" * n, "1 " * n, "1-" * n, "a" * n, "a." * n, "a@" + "b." * n, "a@b" * n, "+" * n, "+1" + "(" * n, "1." * n, "+1 " + "2 " * n, "@" * n, "x@y.z" + "_q" * n, "12345 " * n]
    got = rows_of(find_personal_data(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)))
    assert len(got) == len(texts)
    assert {r[0]: r[1] for r in got}[5] == 1 and {r[0]: r[1] for r in got}[12] == 1


PHONES = [f"+1 555 01{k:02d} 77" for k in range(6)]


def cued():
    """A cue before known numbers, some of no fixed form behind it, and a second cue that only the new numbers have."""
    docs = [f"Please write. reach me: {p} any day" for p in PHONES]
    docs += [f"Here too reach me: 555-01{k}9 today." for k in range(5)]
    docs += [f"Then ring bell 555-01{k}9 or not" for k in range(5)]
    docs += ["And ring bell 555-7777 now", "And ring bell 555-8888 now"]
    docs += [f"It was seen of the {p} there" for p in PHONES[:5]] + [f"It was seen of the {w} there" for w in "cat dog cow hen pig fox owl bat".split()]
    docs += ["It was seen of the 555-6666 there", "Order number 10000451 shipped", "nothing at all"]
    return list(enumerate(docs))


def test_contexts_find_more(spark):
    docs = cued()
    got = {r[0]: r for r in rows_of(find_personal_data(spark.createDataFrame(docs + docs[:3] * 5, SCHEMA)))}
    added = {d: docs[d][1][int(s.split(":")[1]) : int(s.split(":")[2])] for d, *_, s, n in got.values() if n for s in s.split(",")}
    assert {v for d, v in added.items()} == {f"555-01{k}9" for k in range(5)} | {"555-7777", "555-8888"}
    assert all(got[d][6].startswith("phone:") for d in added)
    # without a second round the second cue is not known
    once = [r for r in rows_of(find_personal_data(spark.createDataFrame(docs, SCHEMA), rounds=1)) if r[7]]
    assert {docs[r[0]][1].split()[-2] for r in once} <= {f"555-01{k}9" for k in range(5)} | {"or"} and not any("7777" in docs[r[0]][1] for r in once)


def plain_scores(graph, followers, rounds):
    """kind and score of each value: the rounds by dictionaries."""
    known = {}
    for _ in range(rounds):
        sure = {}
        for pattern in {p for p, *_ in graph}:
            own = [(v, f, n) for p, v, f, n in graph if p == pattern]
            values, times = [0.0] * 4, [0.0] * 4
            for v, f, n in own:
                kind, score = (f, 1.0) if f < 4 else known.get(v, (None, 0.0))
                if kind is not None:
                    values[kind] += score
                    times[kind] += score * n
            kind = max(range(4), key=lambda k: (times[k], -k))
            share = times[kind] / (sum(n for *_, n in own) + followers.get(pattern, 0))
            if values[kind] >= personal_data.SUPPORT and share >= personal_data.CONFIDENCE:
                sure[pattern] = (kind, share)
        found = {}
        for p, v, f, _ in graph:
            if f == 4 and p in sure and sure[p][0] == 3:  # made values look like phone numbers alone
                found.setdefault(v, []).append(sure[p])
        known = {v: (3, 1 - math.prod(1 - min(c, 1 - 1e-9) for _, c in ways)) for v, ways in found.items()}
        known = {v: x for v, x in known.items() if x[1] >= personal_data.SCORE}
    return known


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_rounds_as_plain_ones(spark, rounds):
    rng = random.Random(11)
    graph = {(f"p{rng.randrange(12)}", f"555{rng.randrange(90):04d}") for _ in range(400)}
    graph = sorted((p, v, 3 if int(v) % 3 else 4, rng.randint(1, 5)) for p, v in graph)
    followers = {f"p{k}": 9 * k for k in range(12)}
    edge = spark.createDataFrame(graph, "pattern string, value string, family int, n long")
    follow = spark.createDataFrame(list(followers.items()), "pattern string, words long")
    known = None
    for _ in range(rounds):
        known = personal_data.discovered(edge, personal_data.confident(edge, follow, known))
    got = {r.value: (r.kind, r.score) for r in known.collect()}
    want = plain_scores(graph, followers, rounds)
    assert got.keys() == want.keys() and len(want) > 5
    assert all(got[v][0] == k and abs(got[v][1] - s) < 1e-9 for v, (k, s) in want.items())


def test_followers_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c a b d"), (2, "A  b\nc 12345"), (3, None), (4, "b +1 b 7")], SCHEMA)
    patterns = spark.createDataFrame([("b",), ("a b",), ("zz",)], "pattern string")
    want = {("b", 4), ("a b", 3)}  # b: c twice, d and 7; +1 is the start of a number
    assert {tuple(r) for r in personal_data.ordinary_followers(docs, patterns).collect()} == want
    monkeypatch.setattr(personal_data, "MOST_BROADCAST", 1)
    assert {tuple(r) for r in personal_data.ordinary_followers(docs, patterns).collect()} == want


def test_no_documents(spark):
    assert rows_of(find_personal_data(spark.createDataFrame([], SCHEMA))) == []


def test_native_plan(spark):
    plan = find_personal_data(spark.createDataFrame([(1, "a@b.cd")], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
