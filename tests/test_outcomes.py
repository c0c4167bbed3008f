"""The outcome log: a case for each refusal, a plain sequential log over made submissions, and a stream in several batches."""

import random

import pytest

from timbral.streaming import outcomes

PALETTES = [("pal-a", "proj-1", 2), ("pal-b", "proj-1", 0), ("pal-c", "proj-2", 5)]
COLUMNS = [c.split()[0] for c in outcomes.SUBMISSION.split(", ")]


def event(n, kind="selected", client=None, palette="pal-a", candidate="x", project="proj-1", revision=1, mode="hybrid", names=None, run="run-1"):
    client = f"c-{n}" if client is None else client
    if kind == "removed":
        return (n, client, kind, None, None, None, None, None, None, None, None, names)
    return (n, client, kind, project, palette, revision, run, candidate, "r1", mode, "v1", names)


def tables(spark, changes):
    return (
        spark.createDataFrame([("proj-1",), ("proj-2",)], "project_id string"),
        spark.createDataFrame(PALETTES, "palette_id string, project_id string, revision long"),
        spark.createDataFrame(changes, "palette_id string, candidate_id string, at long, active boolean"),
    )


def judged(spark, rows, changes, log=None):
    found = outcomes.judge(spark.createDataFrame(rows, outcomes.SUBMISSION), *tables(spark, changes), log)
    return {r[0]: tuple(r)[1:] for r in found.collect()}


def plain(rows, changes, log=()):
    """One submission after the other, as a table with a key on the client's id would take them."""
    stored = {r[0]: dict(zip(COLUMNS, r, strict=True)) for r in log}
    out = {}
    owners = {p: (project, revision) for p, project, revision in PALETTES}
    good = lambda x: isinstance(x, str) and 0 < len(x) <= 128 and not any(c in "/\\" or c.isspace() or ord(c) < 32 for c in x)
    for r in sorted(rows):
        e = dict(zip(COLUMNS, r, strict=True))

        def active(palette, candidate, at=r[0]):
            own = [c for c in changes if c[:2] == (palette, candidate) and c[2] <= at]
            return bool(own) and max(own, key=lambda c: c[2])[3]

        def live(palette, candidate):
            ended = {s["removes_event_id"] for s in stored.values() if s["event_type"] == "removed"}
            return min((k for k, s in stored.items() if s["event_type"] == "selected" and (s["palette_id"], s["candidate_id"]) == (palette, candidate) and k not in ended), default=None)

        rest = [e[c] for c in outcomes.IDENTITY if c not in ("event_type", "removes_event_id")]
        shape = e["removes_event_id"] is not None and e["removes_event_id"] >= 1 and not any(x is not None for x in rest) if e["event_type"] == "removed" else all(good(e[c]) for c in outcomes.IDS) and e["palette_revision"] is not None and e["palette_revision"] >= 0 and e["mode"] in outcomes.MODES and e["removes_event_id"] is None
        if not good(e["client_event_id"]) or e["event_type"] not in outcomes.KINDS or not shape:
            out[r[0]] = ("invalid_outcome", False, None)
            continue
        prior = next((k for k, s in stored.items() if s["client_event_id"] == e["client_event_id"]), None)
        if prior is not None:
            names = ("event_type", "removes_event_id") if e["event_type"] == "removed" else outcomes.IDENTITY
            same = all(stored[prior][c] == e[c] for c in names)
            out[r[0]] = (None if same else "idempotency_conflict", False, prior)
            continue
        code, full = None, e
        if e["event_type"] == "removed":
            source = stored.get(e["removes_event_id"])
            if source is None or source["event_type"] != "selected":
                code = "unknown_selection"
            elif any(s["event_type"] == "removed" and s["removes_event_id"] == e["removes_event_id"] for s in stored.values()):
                code = "outcome_conflict"
            elif active(source["palette_id"], source["candidate_id"]):
                code = "removal_not_reflected"
            else:
                full = source | {"event_id": r[0], "client_event_id": e["client_event_id"], "event_type": "removed", "removes_event_id": e["removes_event_id"]}
        elif e["project_id"] not in ("proj-1", "proj-2"):
            code = "unknown_project"
        elif e["palette_id"] not in owners:
            code = "unknown_palette"
        elif owners[e["palette_id"]][0] != e["project_id"]:
            code = "cross_project_reference"
        elif e["palette_revision"] > owners[e["palette_id"]][1]:
            code = "unknown_palette_revision"
        elif e["event_type"] == "selected" and not active(e["palette_id"], e["candidate_id"]):
            code = "selection_not_in_palette"
        elif e["event_type"] == "rejected" and live(e["palette_id"], e["candidate_id"]) is not None:
            code = "outcome_conflict"
        held = live(e["palette_id"], e["candidate_id"]) if code is None and e["event_type"] == "selected" else None
        if code is None and held is None:
            stored[r[0]] = full
        out[r[0]] = (code, code is None and held is None, held if held is not None else r[0] if code is None else None)
    return out, stored


IN = ("pal-a", "x", 1, True)


RULES = (
    [
        ([event(1, client="a b")], [IN], 1, ("invalid_outcome", False, None)),
        ([event(1, client="")], [IN], 1, ("invalid_outcome", False, None)),
        ([event(1, client="c" * 129)], [IN], 1, ("invalid_outcome", False, None)),
        ([event(1, client="a/b")], [IN], 1, ("invalid_outcome", False, None)),
        ([event(1, kind="bought")], [IN], 1, ("invalid_outcome", False, None)),
        ([event(1, mode="best")], [IN], 1, ("invalid_outcome", False, None)),
        ([event(1, revision=-1)], [IN], 1, ("invalid_outcome", False, None)),
        ([event(1, names=1)], [IN], 1, ("invalid_outcome", False, None)),
        ([event(1, "removed", names=0)], [IN], 1, ("invalid_outcome", False, None)),
        ([event(1, project="proj-9")], [IN], 1, ("unknown_project", False, None)),
        ([event(1, palette="pal-9")], [IN], 1, ("unknown_palette", False, None)),
        ([event(1, palette="pal-c")], [IN], 1, ("cross_project_reference", False, None)),
        ([event(1, revision=3)], [IN], 1, ("unknown_palette_revision", False, None)),
        ([event(1)], [], 1, ("selection_not_in_palette", False, None)),
        ([event(1)], [IN, ("pal-a", "x", 2, False)], 1, (None, True, 1)),
        ([event(1), event(2, "rejected")], [IN], 2, ("outcome_conflict", False, None)),
        ([event(1), event(2)], [IN], 2, (None, False, 1)),
        ([event(1), event(2, client="c-1")], [IN], 2, (None, False, 1)),
        ([event(1), event(2, "rejected", client="c-1")], [IN], 2, ("idempotency_conflict", False, 1)),
        ([event(1), event(2, client="c-1", palette="pal-9")], [IN], 2, ("idempotency_conflict", False, 1)),
        ([event(1, project="proj-9"), event(2, client="c-1")], [IN], 2, (None, True, 2)),
        ([event(1, "removed", names=1)], [IN], 1, ("unknown_selection", False, None)),
        ([event(1, "auditioned"), event(2, "removed", names=1)], [IN], 2, ("unknown_selection", False, None)),
        ([event(1), event(2, "removed", names=1)], [IN], 2, ("removal_not_reflected", False, None)),
        ([event(1), event(2, "removed", names=1)], [IN, ("pal-a", "x", 2, False)], 2, (None, True, 2)),
        ([event(1), event(2, "removed", names=1), event(3, "removed", names=1)], [IN, ("pal-a", "x", 2, False)], 3, ("outcome_conflict", False, None)),
        ([event(1), event(2), event(3, "removed", names=2)], [IN, ("pal-a", "x", 3, False)], 3, ("unknown_selection", False, None)),
        ([event(1), event(2, "removed", names=1), event(3, "removed", client="c-2", names=1)], [IN, ("pal-a", "x", 2, False)], 3, (None, False, 2)),
        ([event(1), event(2, "removed", names=1), event(3, "rejected")], [IN, ("pal-a", "x", 2, False)], 3, (None, True, 3)),
    ]
)


def test_each_rule(spark):
    """All cases in one log: the events, clients and candidates of each case have names of their own."""
    rows, changes = [], []
    for k, (events, slots, _, _) in enumerate(RULES):
        move = lambda n, k=k: n + 10 * k if n else n
        for r in events:
            e = dict(zip(COLUMNS, r, strict=True))
            e |= {"event_id": move(e["event_id"]), "removes_event_id": move(e["removes_event_id"]), "candidate_id": e["candidate_id"] and f"x{k}"}
            e["client_event_id"] += f"-{k}" if e["client_event_id"].startswith("c-") else ""
            rows.append(tuple(e[c] for c in COLUMNS))
        changes += [(p, f"x{k}", move(n), active) for p, _, n, active in slots]
    got, alone = judged(spark, rows, changes), plain(rows, changes)[0]
    for k, (events, slots, n, (code, created, answer)) in enumerate(RULES):
        assert got[n + 10 * k] == (code, created, answer and answer + 10 * k) == alone[n + 10 * k], events
        assert plain(events, slots)[0][n] == (code, created, answer)


def made(seed, n):
    rng = random.Random(seed)
    rows, changes = [], []
    for k in range(1, n + 1):
        palette, candidate = rng.choice(["pal-a", "pal-b", "pal-c", "pal-a", "pal-9"]), rng.choice("xy")
        client = f"c-{rng.randrange(1, k + 1) if rng.random() < 0.3 else k}"
        project = {"pal-c": "proj-2"}.get(palette, "proj-1") if rng.random() < 0.9 else "proj-2"
        kind = rng.choice(["selected", "selected", "removed", "rejected", "auditioned"])
        if rng.random() < 0.5:
            changes.append((palette, candidate, k, rng.random() < 0.6))
        rows.append(event(k, kind, client, palette, candidate, project, rng.choice([0, 0, 1]), names=rng.randrange(max(1, k - 8), k + 1) if kind == "removed" else None))
    return rows, changes


@pytest.mark.parametrize("seed", [1, 2])
def test_as_one_after_the_other(spark, seed):
    rows, changes = made(seed, 400)
    got, want = judged(spark, rows, changes), plain(rows, changes)[0]
    assert got == want and len({w[0] for w in want.values()}) >= 8


def test_a_stream_is_a_batch(spark, tmp_path):
    """Four batches, each judged with the log of those before: the answers and the log of one batch."""
    rows, changes = made(5, 200)
    source = tmp_path / "in"
    source.mkdir()
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], outcomes.SUBMISSION).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        next((tmp_path / f"w{k}").glob("part-*")).rename(source / f"{k}.parquet")
        outcomes.stream(spark.readStream.schema(outcomes.SUBMISSION).parquet(str(source)), lambda: tables(spark, changes), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want, stored = plain(rows, changes)
    results = spark.read.parquet(str(tmp_path / "out/results"))
    assert {r[0]: tuple(r)[1:4] for r in results.select("event_id", "code", "created", "answer_event_id").collect()} == want
    log = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out/log")).select(*COLUMNS).collect()}
    assert log == {tuple(s[c] for c in COLUMNS) for s in stored.values()}
    assert results.select("batch").distinct().count() == 4


def test_no_submissions(spark):
    assert judged(spark, [], []) == {}
