"""Orders of presentation against a plain repair on 200 orders, the pair sampler's repair against a plain one."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from timbral.operators import dataset


def meetings(order):
    return sum(a == b for a, b in zip(order, order[1:], strict=False))


def touching(order, k):
    return sum(1 for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j] == order[k])


def plain_order(kicks):
    """The rule step by step: (place, kick) rows, every swap tried by making it."""
    rows = list(enumerate(kicks))

    def try_swap(at):
        kinds = [k for _, k in rows]
        for other in [*range(at + 1, len(rows)), *range(at - 1, -1, -1)]:
            before = touching(kinds, at) + touching(kinds, other)
            kinds[at], kinds[other] = kinds[other], kinds[at]
            fewer = touching(kinds, at) + touching(kinds, other) < before
            if fewer:
                rows[at], rows[other] = rows[other], rows[at]
                return True
            kinds[at], kinds[other] = kinds[other], kinds[at]
        return False

    swapped = True
    while swapped:
        swapped = False
        for at in range(1, len(rows)):
            if rows[at - 1][1] == rows[at][1] and (try_swap(at) or try_swap(at - 1)):
                swapped = True
    kinds = [k for _, k in rows]
    if meetings(kinds) > max(0, 2 * max(Counter(kinds).values(), default=0) - len(kinds) - 1):
        left, start = {}, {}
        for place, row in enumerate(rows):
            left.setdefault(row[1], []).append(row)
            start.setdefault(row[1], place)
        dealt, last = [], None
        while any(left.values()):
            able = [(-len(x), start[k], k) for k, x in left.items() if x and k != last]
            last = min(able)[2] if able else last
            dealt.append(left[last].pop(0))
        if meetings([k for _, k in dealt]) < meetings(kinds):
            rows = dealt
    return [place for place, _ in rows]


def test_orders_as_plain_ones():
    rng = random.Random(4)
    orders = [[rng.choice(range(rng.randint(1, 6))) if rng.random() < 0.6 else 0 for _ in range(rng.randint(0, 30))] for _ in range(200)]
    orders += [[0, 0, 0, 1, 1], [0, 1, 0, 0, 0, 0, 1], [0] * 7, [1, 1, 2, 2, 3, 3], [0, 0], [5]]
    for kicks in orders:
        got = dataset.repaired(np.array(kicks, np.int64))
        assert got == plain_order(kicks)
        assert meetings([kicks[k] for k in got]) == max(0, 2 * max(Counter(kicks).values(), default=0) - len(kicks) - 1)


def test_repaired_rows(spark):
    rows = [(s, k, k + 1, None if k % 4 == 0 else f"k{k % 2}") for s in (1, 2) for k in range(9 * s)]
    df = spark.createDataFrame(rows, "session long, pair_id long, position int, kick string").selectExpr("*", "'x' AS other")
    found = dataset.repair_order(df).toPandas().sort_values(["session", "position"])
    for session in (1, 2):
        own = found[found.session == session]
        kicks = [r[3] for r in rows if r[0] == session]
        codes = {k: n for n, k in enumerate(dict.fromkeys(kicks))}
        assert own.pair_id.tolist() == plain_order([codes[k] for k in kicks]) and own.position.tolist() == list(range(1, len(kicks) + 1))


def plain_cover(pairs, basses, seed, version):
    now, given = dict(pairs), set()
    for bass in sorted(set(basses) - set(now.values())):
        held = Counter(now.values())
        open_ = sorted((hashlib.sha256("\n".join([seed, version, "repair", q, str(k), bass]).encode()).hexdigest(), q, k) for (q, k), b in now.items() if held[b] > 1)
        if not open_:
            break
        now[open_[0][1:]] = bass
        given.add(open_[0][1:])
    return {(q, k, b, (q, k) in given) for (q, k), b in now.items()}


@pytest.mark.parametrize(("queries", "basses"), [(6, 12), (4, 60), (9, 5), (3, 3)])
def test_coverage_as_a_plain_one(spark, queries, basses):
    names = [f"b{k:02d}" for k in range(basses)]
    kicks = spark.createDataFrame([(f"q{k}",) for k in range(queries + 3)], "identity string")
    low = spark.createDataFrame([(b,) for b in names + names[:2]], "identity string")
    drawn = dataset.hashed_pairs(kicks, low, "s", "v", queries, 5)
    pairs = {(r.query, r.slot): r.bass for r in drawn.collect()}
    key = lambda *parts: hashlib.sha256("\n".join(["s", "v", *parts]).encode()).hexdigest()
    first = sorted((f"q{k}" for k in range(queries + 3)), key=lambda q: key("query", q))[:queries]
    assert pairs == {(q, n): b for q in first for n, b in enumerate(sorted(names, key=lambda b: key("pair", q, b))[:5])}
    served = dataset.cover_basses(drawn, low, "s", "v")
    got = {tuple(r) for r in served.collect()}
    assert got == plain_cover(pairs, names, "s", "v")
    assert dataset.coverage(served, low).first().uncovered == max(0, basses - len(pairs))
