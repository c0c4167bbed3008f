"""Near copies at the pipeline's and at op9's setting against brute force: shared passages, tiny texts, dense groups, blocks."""

import random
from itertools import combinations

import pytest

from timbral.llm import jaccard_join
from timbral.llm.components import connected_components


def corpus():
    rng = random.Random(5)
    passages = [[f"p{k}x{i}" for i in range(50)] for k in range(3)]
    rows = []
    for k in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([rng.randrange(1, 12), rng.randrange(5, 200)]))]
        for passage in passages[: k % 4]:
            own[len(own) // 2 : len(own) // 2] = passage
        rows.append(own)
    for k in range(0, 150, 3):  # near copies at about the limit
        copy = list(rows[k])
        for _ in range(rng.randrange(1, max(2, len(copy) // 40))):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append(copy)
    base = [f"b{i}" for i in range(120)]
    for _ in range(80):  # a dense group, of which some are no links of most
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append(copy)
    rows += [[f"t{rng.randrange(6)}" for _ in range(rng.randrange(1, 9))] for _ in range(150)]
    return {k: " ".join(words) for k, words in enumerate(rows)} | {9000: None, 9001: "", 9002: "one two", 9003: "One  two", 9004: rows[0] and " ".join(rows[0])}


def brute(docs, width, at_least):
    sets = {k: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()) for k, w in ((k, (t or "").lower().split()) for k, t in docs.items())}
    root = {k: k for k in docs}

    def top(k):
        return k if root[k] == k else top(root[k])

    for a, b in combinations(sorted(docs), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= at_least * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {k: (len(sets[k]), top(k)) for k in docs}


@pytest.mark.parametrize(("width", "at_least", "block", "hot", "parts"), [(5, 80, 1 << 20, 100, 3), (5, 80, 1500, 5, 7), (3, 90, 1 << 20, 5, 2), (3, 90, 1500, 100, 5), (1, 50, 600, 5, 1)])
def test_components_are_those_of_brute_force(spark, monkeypatch, width, at_least, block, hot, parts):
    monkeypatch.setattr(jaccard_join, "_HOT", hot)
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(parts)
    want = brute(docs, width, at_least)
    assert sum(root != k for k, (_, root) in want.items()) > 10
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, width, at_least, 100, block=block).collect()}
    assert got == want


def test_a_shared_passage_makes_no_large_neighbourhood(spark):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(50)]
    rows = [(k, " ".join([f"w{rng.randrange(10**7)}" for _ in range(120)] + passage + [f"w{rng.randrange(10**7)}" for _ in range(120)])) for k in range(200)]
    sent = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(jaccard_join._signatures(5, 80, 100, 4), "to int, kind int, payload binary")
    near = sent.groupBy("to").applyInArrow(jaccard_join._stars, jaccard_join._NEAR)
    assert near.where("n > 0").count() > 500
    assert jaccard_join._neighbourhoods(near, jaccard_join._Segments(80, 100)).count() < 20


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2), (3, None)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(100, 99), (99, 98), (98, 100), (100, 99)], [(k, (k * 7 + 3) % 60) for k in range(60)]])
def test_components_of_edges(spark, edges):
    root = {}

    def top(k):
        return k if root[k] == k else top(root[k])

    for a, b in edges:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: top(k) for k in root}
