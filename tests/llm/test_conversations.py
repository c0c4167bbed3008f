"""Conversation repair against a search of all edits, its SQL, and conversations cut into pieces."""

import hashlib
import itertools
import random
import zlib

import pytest

from compare import difference, oracle
from timbral.llm import conversations
from timbral.llm.queries import REPAIR_SQL, op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        kept = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    return out


def all_repairs(rows, faults):
    """Every (cost, audit, lines): edits of each row, and up to two insertions of either role before each and at the end."""
    fills = [f for k in range(3) for f in itertools.product(("user", "assistant"), repeat=k)]
    partial = [(0, "", ())]
    for (_, role, text), fault in zip(rows, faults, strict=True):
        late = 5 if fault == "truncated" else 0
        edits = [(2, "D", ())]
        if fault in ("", "truncated"):
            edits += [(late, "K", ((role, text),)), (1 + late, "R", (("user", text),)), (1 + late, "R", (("assistant", text),))]
        partial = [(c + 5 * len(f) + e, a + "I" * len(f) + x, lines + tuple((r, "") for r in f) + more) for c, a, lines in partial for f in fills for e, x, more in edits]
        partial = [p for p in partial if fits(p[2], True)]
    ends = [(c + 5 * len(f), a + "I" * len(f), lines + tuple((r, "") for r in f)) for c, a, lines in partial for f in fills]
    return [e for e in ends if fits(e[2], False)]


def fits(lines, open_end):
    initials = "".join(r[:1] or "-" for r, _ in lines)
    body = initials[1:] if initials[:1] == "s" else initials
    if any(c != "ua"[k % 2] for k, c in enumerate(body)):
        return False
    return open_end or (len(body) % 2 == 0 and (body != "" or initials == ""))


def plain_repair(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(SPACE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, lines = min(all_repairs(rows, faults))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def made(n, seed, longest=4):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "Well", "  ", "", "So?\n", None, "A longer answer. With more", "ok.", " ", "Ünd … . "]
    rows = []
    for conv in range(n):
        for k in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.1 else rng.choice([k, k, k, k + 2, 3])
            rows.append((conv if conv % 17 else None, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "sage"]), rng.choice(texts)))
    return rows


def found(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_as_a_search_of_all_edits(spark):
    rows = [r for r in made(160, 5, longest=3) if r[0] is not None]
    got = found(conversations.damaged_repair(spark.createDataFrame(rows, SCHEMA)))
    want = {conv: plain_repair(kept) for conv, kept in plain_damage(rows).items()}
    assert got == want and any("R" in w[6] for w in want.values())


def test_insertions_close_a_layer():
    """A row less or a role changed is always cheaper, so no best repair shows them."""
    assert conversations.closed({0: (0, "")}) == {0: (0, ""), 2: (5, "I"), 3: (10, "II")}
    assert conversations.closed({1: (3, "K"), 3: (4, "DR")}) == {1: (3, "K"), 2: (8, "KI"), 3: (4, "DR")}
    assert conversations.replay("KII", ["system"], ["Go."]) == ["system:Go.", "user:", "assistant:"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("conversations")
    return made(120, 8, longest=14), str(folder)


def test_sql_and_pieces(spark, odd):
    """Ties, null keys and long conversations: as the SQL says, and the same however conversations are cut."""
    rows, folder = odd
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS audit", "1 AS digest", "true AS dropped")
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    con = oracle("/nowhere")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    assert not difference(op13_conversation_repair(spark, folder), con, REPAIR_SQL)
    whole = found(conversations.damaged_repair(df))
    damaged = conversations.damage(df)
    assert found(conversations.repair(damaged, most_rows=1)) == whole
    assert found(conversations.repair(damaged, most_rows=3)) == whole
    assert found(conversations.repair(damaged, most_chars=20)) == whole
    assert found(conversations.repair(damaged.coalesce(1))) == whole


def test_one_long_conversation(spark):
    """A conversation of thousands of rows is cut; most of the table is of it."""
    rng = random.Random(2)
    rows = [(7, k, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", f"Line {k}!"])) for k in range(5000)] + [(8, 0, "user", "Hi.")]
    got = found(conversations.damaged_repair(spark.createDataFrame(rows, SCHEMA)))
    kept = plain_damage(rows)[7]
    seen, layer = set(), {0: (0, "")}
    for _, role, text in kept:
        solid = text.strip(SPACE)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        layer = conversations.moved(layer, role[:1], fault)
    cost, audit = min(w for s, w in conversations.closed(layer).items() if s in (0, 3))
    text = "\n".join(conversations.replay(audit, [r for _, r, _ in kept], [t for _, _, t in kept]))
    assert got[7][5:] == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_nothing_left(spark):
    """A conversation whose rows all go, and no conversations."""
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = found(conversations.damaged_repair(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(conversations.damaged_repair(spark.createDataFrame([], SCHEMA))) == {}


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    assert not difference(op13_conversation_repair(spark, sf), oracle(sf), REPAIR_SQL)
