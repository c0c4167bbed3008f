"""Cases of the fourth round's findings."""

import hashlib

from timbral.plans import registry
from timbral.sources import views

SF = "/root/testdata/sf0.01"


def test_pairs_are_drawn_from_all_basses(spark):
    """each kick's slots are its least hashes over the whole library, whatever a bass's id."""
    lib = [(f"id-{r.sample_id}", r.role == "kick") for r in views.library(spark, SF).collect()]
    sha = lambda *parts: (hashlib.sha256("\n".join(("seed-1", "v1", *parts)).encode()).hexdigest(), parts[-1])
    kicks, basses = [x for x, kick in lib if kick], [x for x, kick in lib if not kick]
    want = {(q, k, b) for q in sorted(kicks, key=lambda q: sha("query", q))[:60] for k, b in enumerate(sorted(basses, key=lambda b: sha("pair", q, b))[:5])}
    got = registry.queries()["R19_hashed_pairs"](spark, SF).select("query", "slot", "bass").collect()
    assert len(got) == 300 and {tuple(r) for r in got} == want
    assert {int(r.bass.removeprefix("id-")) % 3 for r in got} == {0, 1, 2}
