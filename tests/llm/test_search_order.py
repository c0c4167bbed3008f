"""A search gives the same links however its rows arrive."""

import random

import numpy as np
import pyarrow as pa

from timbral.llm import jaccard_join


def rows():
    rng = random.Random(3)
    texts = []
    for family in range(6):  # chains of near copies: many walks of a component are possible
        words = [f"f{family}w{i}" for i in range(80)]
        for _ in range(12):
            words = list(words)
            words[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    table = pa.table({"text": texts})
    return [(jaccard_join._class_of(s), k % 2 == 0, texts[k]) for k, s in jaccard_join._sets(table, 1)]


def links_of(search, found):
    seen = []
    for seed in range(5):
        random.Random(seed).shuffle(found)
        cls, asks, text = zip(*found, strict=True)
        links = search(pa.table({"cls": np.array(cls), "asks": list(asks), "text": list(text)}))
        seen.append(list(zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True)))
    assert len(seen[0]) > 20
    assert all(x == seen[0] for x in seen)


def test_links_do_not_depend_on_arrival():
    links_of(jaccard_join._search(1, 90, 100), rows())
    links_of(jaccard_join._search_rest(1, 90, 100), rows())
