"""Data sets of files: content dedup, selection, orders of presentation and their checks."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.functions.durable import durable

#: How many times the basses that a query needs are looked at first; a bound that left too few is raised as often.
NEAR = 20
#: Places of a session up to which a swap is looked for one place after the other.
SHORT = 64


def admit_files(files: DataFrame) -> DataFrame:
    """files(sample_id, sha, role, priority) with decision: conflict (one content, several roles), duplicate, or kept (the first by priority)."""
    roles = files.groupBy("sha").agg(F.count_distinct("role").alias("n_roles"))
    order = Window.partitionBy("sha").orderBy("priority", "sample_id")
    placed = files.join(roles, "sha").withColumn("nth", F.row_number().over(order))
    decision = F.when(F.col("n_roles") > 1, "conflict").when(F.col("nth") > 1, "duplicate").otherwise("kept")
    return placed.select(*files.columns, decision.alias("decision"))


def select_per_role(files: DataFrame, target: int = 100) -> DataFrame:
    """files with selected: the first target of each role by priority and id; the others are reserves."""
    return _first_of_role(files, "selected", [F.col("priority")], target)


def _first_of_role(rows: DataFrame, name: str, order: list[Column], size: int) -> DataFrame:
    """rows with name: whether a row is among the first size of its role. Each task keeps size rows of a role, and only these meet."""
    by = Window.partitionBy("role").orderBy(*order, "sample_id")
    first = rows.select("role", "sample_id", F.row_number().over(by).alias("_nth")).where(F.col("_nth") <= size)
    picked = first.select(F.col("role").alias("_role"), F.col("sample_id").alias("_id"), F.lit(True).alias(name))
    return rows.join(picked, F.col("role").eqNullSafe(F.col("_role")) & (F.col("sample_id") == F.col("_id")), "left").select(*rows.columns, F.coalesce(name, F.lit(False)).alias(name))


def role_summary(files: DataFrame, target: int = 100) -> DataFrame:
    """role, candidates, kept, conflicts and shortfall against target."""
    found = files.groupBy("role").agg(F.count("*").alias("candidates"), F.count_if(F.col("decision") == "kept").alias("kept"), F.count_if(F.col("decision") == "conflict").alias("conflicts"))
    return found.withColumn("shortfall", F.greatest(F.lit(target) - F.col("kept"), F.lit(0)))


def role_hints(path: Column) -> Column:
    """The roles that a file's name, without its ending, suggests: kick, bass, both or none."""
    name = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=[^.])\.[^.]+$", ""))
    kick = name.contains("kick") | name.rlike("bass[ _-]?drum")
    bass = name.contains("bass") | name.contains("808") | name.rlike("(^|[ _-])sub([ _-]|$)")
    return F.array_compact(F.array(F.when(kick, "kick"), F.when(bass, "bass")))


def restricted(path: Column) -> Column:
    """Whether a folder or the file is named as a demo, a preview or a miscellany."""
    return F.exists(F.split(path, "/"), lambda part: F.lower(part).rlike("(^|[ ._-])(demo|preview|misc)([ ._-]|$)"))


def role_evidence(files: DataFrame, rules: DataFrame) -> DataFrame:
    """source, path, role, method, rule_id, subtype, problem of each file by the reviewed rules of its source.

    rules: source, kind (category: everything below path; file: path itself),
    path, role, rule_id, subtype.  Rules of several roles conflict; of those that
    agree the one of least id is named.  A file meets its own path and the
    folders above it, never all rules.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), F.when(n == F.size(parts), "file").otherwise("category").alias("kind")))
    asked = files.select("source", "path").distinct().select("source", "path", F.explode(above).alias("a")).select("source", F.col("path").alias("file"), "a.path", "a.kind")
    method = F.when(F.col("kind") == "category", "trusted_category").otherwise("reviewed_mapping")
    hits = asked.join(rules, ["source", "path", "kind"]).groupBy("source", F.col("file").alias("path")).agg(F.count_distinct("role").alias("roles"), F.min_by(F.struct("role", method.alias("method"), "rule_id", "subtype"), "rule_id").alias("rule"))
    one = F.col("roles") == 1
    problem = F.when(F.col("roles") > 1, "conflicting_role_evidence").when(F.col("roles").isNull(), "unconfirmed_role")
    told = [F.when(one, F.col("rule")[c]).alias(c) for c in ("role", "method", "rule_id", "subtype")]
    return files.select("source", "path").distinct().join(hits, ["source", "path"], "left").select("source", "path", *told, problem.alias("problem"))


def seeded_order(rows: DataFrame, seed: str, key: str = "pair_id", by: str = "session") -> DataFrame:
    """rows with sha_key and position: each session's order by SHA-256 of seed, session and key."""
    digest = F.sha2(F.concat_ws("\n", F.lit(seed), F.col(by).cast("string"), F.col(key).cast("string")), 256)
    order = Window.partitionBy(by).orderBy("sha_key", key)
    return rows.withColumn("sha_key", digest).withColumn("position", F.row_number().over(order))


def collisions(ordered: DataFrame, by: str = "session", kick: str = "kick") -> DataFrame:
    """by and how many neighbours in order have the same kick."""
    before = F.lag(kick).over(Window.partitionBy(by).orderBy("position"))
    return ordered.withColumn("_same", before == F.col(kick)).groupBy(by).agg(F.count_if("_same").alias("collisions"))


def _shared(codes: np.ndarray) -> np.ndarray:
    """Of each place, how many of its neighbours have the same kick; the ends have no neighbour outside."""
    same = np.concatenate([[0], (codes[1:] == codes[:-1]).astype(np.int64), [0]])
    return same[:-1] + same[1:]


def _better_swap_in_short(codes: list[int], at: int) -> int | None:
    """_better_swap() of a few places, one after the other."""
    shared = lambda x, k, other: sum(codes[j] == x for j in (k - 1, k + 1) if 0 <= j < len(codes) and j != other)
    own = codes[at]
    for other in (*range(at + 1, len(codes)), *range(at - 1, -1, -1)):
        came = codes[other]
        # side by side, the two meet each other before and after
        if came != own and shared(came, at, other) + shared(own, other, at) < shared(own, at, other) + shared(came, other, at):
            return other
    return None


def _better_swap(codes: np.ndarray, at: int) -> int | None:
    """The place to swap with that makes fewer places meet their own kick: the first one behind, then the nearest one before; None if there is none."""
    n, own = len(codes), codes[at]
    if n <= SHORT:
        return _better_swap_in_short(codes.tolist(), at)
    padded = np.concatenate([[-1], codes, [-2]])
    before, behind = padded[:-2], padded[2:]
    away = np.arange(n) - at
    # what comes to this place meets the neighbours here, what goes meets those there; side by side, each meets the other
    here = (codes == np.where(away == -1, own, before[at])).astype(np.int64) + (codes == np.where(away == 1, own, behind[at]))
    there = (own == np.where(away == 1, codes, before)).astype(np.int64) + (own == np.where(away == -1, codes, behind))
    count = _shared(codes)
    good = (here + there < count + count[at]) & (away != 0)
    later, earlier = np.flatnonzero(good[at + 1 :]), np.flatnonzero(good[:at])
    return int(at + 1 + later[0]) if len(later) else int(earlier[-1]) if len(earlier) else None


def _spread_out(codes: np.ndarray) -> list[int]:
    """Places in an order with as few meetings as there can be: always of the kick with most left, but for the last one dealt; ties by first place."""
    places: dict[int, deque] = {}
    for place, kick in enumerate(codes.tolist()):
        places.setdefault(kick, deque()).append(place)
    heap = [(-len(x), x[0], kick) for kick, x in places.items()]
    heapq.heapify(heap)
    out: list[int] = []
    held = None
    while heap or held:
        if not heap:
            heap, held = [held], None
        left, first, kick = heapq.heappop(heap)
        out.append(places[kick].popleft())
        if held:
            heapq.heappush(heap, held)
        held = (left + 1, first, kick) if left < -1 else None
    return out


def repaired(codes: np.ndarray) -> list[int]:
    """The places of codes in the order in which they are shown.

    Wherever a kick follows itself, the later place or else the earlier one is
    swapped if that leaves fewer meetings, over and over until a whole pass swaps
    nothing; if more are left than any order must have, the list is dealt anew.
    """
    codes, order = np.array(codes), np.arange(len(codes))
    changed = len(codes) > 1
    while changed:
        changed = False
        for at in range(1, len(codes)):
            for place in (at, at - 1):
                other = _better_swap(codes, place) if codes[at] == codes[at - 1] else None
                if other is not None:
                    codes[[place, other]], order[[place, other]] = codes[[other, place]], order[[other, place]]
                    changed = True
                    break
    meetings = lambda x: int((x[1:] == x[:-1]).sum())
    most = int(np.unique(codes, return_counts=True)[1].max(initial=0))
    if meetings(codes) > max(0, 2 * most - len(codes) - 1):
        dealt = _spread_out(codes)
        if meetings(codes[dealt]) < meetings(codes):
            order = order[dealt]
    return order.tolist()


def repair_order(ordered: DataFrame, by: str = "session", kick: str = "kick") -> DataFrame:
    """ordered with positions in which a kick follows itself as seldom as can be.

    A session is what one evaluator is shown, so one task has it whole; a task
    reads its sessions one after the other from its sorted rows.
    """

    def codes(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().dictionary_encode("encode").indices.to_numpy()

    def whole(table: pa.Table) -> pa.Table:
        """table, of whole sessions, in its new order."""
        kicks, at = codes(table[kick]), table.column_names.index("position")
        ends = np.flatnonzero(np.diff(codes(table[by]), append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]])
        order = np.concatenate([first + np.array(repaired(kicks[first:last])) for first, last in zip(starts, ends, strict=True)])
        places = np.arange(len(order)) - np.repeat(starts, ends - starts) + 1
        return table.take(pa.array(order)).set_column(at, table.schema.field(at), pa.array(places).cast(table.schema.types[at]))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if batch.num_rows and not held[0][by][0].equals(batch[by][-1]):
                table = pa.Table.from_batches(held)
                begun = np.flatnonzero(np.diff(codes(table[by]))) + 1
                if len(begun):
                    yield from whole(table.slice(0, begun[-1])).to_batches()
                    held = table.slice(begun[-1]).to_batches()
            held = [x for x in held if x.num_rows]
        if held:
            yield from whole(pa.Table.from_batches(held)).to_batches()

    spark = ordered.sparkSession
    # a number of tasks of its own: few bytes of rows would else be one task's
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ordered.repartition(tasks, by).sortWithinPartitions(by, "position").mapInArrow(repair, ordered.schema)


def seeded_twister(*parts: object) -> random.Random:
    """A Mersenne Twister seeded with the first 16 bytes, big-endian, of the SHA-256 of the parts' texts joined by |."""
    return random.Random(int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:16], "big"))


def random_arm(items: DataFrame, seed: str, version: str = "", order: str = "item") -> DataFrame:
    """query, item, position: each query's items drawn without replacement, one after the other from what is left.

    The draw is that of seeded_twister(seed, version, "random", query) from the
    list of eligible items in the order of the column order.  A query's list is
    what one evaluator is to be shown.
    """

    @F.pandas_udf("array<string>")
    def draw(query: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for q, x in zip(query, rows, strict=True):
            rng, pool, drawn = seeded_twister(seed, version, "random", q), list(x), []
            while pool:
                drawn.append(pool.pop(rng.randrange(len(pool))))
            out.append(drawn)
        return pd.Series(out)

    kind = items.schema["item"].dataType
    entry = F.struct(F.col(order).alias("at"), F.col("item").cast("string").alias("item"))
    lists = items.groupBy("query").agg(F.transform(F.array_sort(F.collect_set(entry)), lambda x: x["item"]).alias("rows"))
    return lists.select("query", F.posexplode(draw("query", "rows")).alias("at", "item")).select("query", F.col("item").cast(kind).alias("item"), (F.col("at") + 1).alias("position"))


def pool_split(n: int, share: float = 0.25) -> int:
    """How many of n go to the held-back pool: a quarter, at least one and never all. Specified behaviour."""
    return min(n - 1, max(1, math.ceil(share * n)))


def split_pool(samples: DataFrame, seed: str, size: int) -> DataFrame:
    """samples with pool: tuning or held_back, by a seeded hash of their id. Specified behaviour."""
    key = F.sha2(F.concat_ws("\n", F.lit(seed), F.col("sample_id").cast("string")), 256)
    placed = _first_of_role(samples, "_held", [key], size)
    return placed.withColumn("pool", F.when(F.col("_held"), "held_back").otherwise("tuning")).drop("_held")


def hashed_pairs(kicks: DataFrame, basses: DataFrame, seed: str, version: str, queries: int = 60, each: int = 5) -> DataFrame:
    """query, slot, bass: the first kicks by a seeded hash, and for each of them the first basses by another.

    kicks, basses: identity.  The draw depends on seed, version and identities
    alone.  The kicks drawn are a stated query set, which meets all basses as a
    stream: hashes below a bound are kept, and if a query has too few of them the
    bound is raised, until it leaves nothing out.
    """
    digest = lambda *parts: F.sha2(F.concat_ws("\n", F.lit(seed), F.lit(version), *parts), 256)
    first = durable(kicks.select(F.col("identity").alias("query")).distinct().orderBy(digest(F.lit("query"), F.col("query")), "query").limit(queries))
    # a number of parts of its own: few bytes of basses would else be one task's
    spread = basses.select(F.col("identity").alias("bass")).repartition(4 * basses.sparkSession.sparkContext.defaultParallelism)
    met = spread.crossJoin(F.broadcast(first)).withColumn("_digest", digest(F.lit("pair"), F.col("query"), F.col("bass")))
    asked, share = first.count(), NEAR * each / max(1, basses.count())
    while True:
        near = met if share >= 1 else met.where(F.col("_digest") < f"{int(share * 2**48):012x}")
        near = durable(near.distinct())
        if share >= 1 or near.groupBy("query").count().where(F.col("count") >= each).count() == asked:
            break
        share *= NEAR
    order = Window.partitionBy("query").orderBy("_digest", "bass")
    return near.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= each).select("query", (F.col("slot") - 1).alias("slot"), "bass")


def cover_basses(pairs: DataFrame, basses: DataFrame, seed: str, version: str) -> DataFrame:
    """pairs (query, slot, bass) with repaired, so changed that each bass has a slot if there are enough of them.

    A bass without a slot, in the order of identities, takes the slot of least
    seeded hash among those whose bass has another slot left.  Each repair uses
    up one slot too many of some bass, so as many basses can be served as there
    are more slots than basses in them: only these few, and the slots, whose
    number is the design's, are brought together.
    """
    seen = pairs.select("bass").distinct()
    spare = pairs.agg((F.count("*") - F.count_distinct("bass")).cast("int").alias("n")).first()["n"]
    left = basses.select(F.col("identity").alias("bass")).distinct().join(seen, "bass", "left_anti").orderBy("bass").limit(spare)
    both = pairs.select("query", "slot", "bass").unionByName(left.select(F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("slot"), "bass"))

    def serve(table: pd.DataFrame) -> pd.DataFrame:
        slots = table[table["query"].notna()].copy()
        held = Counter(slots["bass"])
        now = {(q, int(k)): b for q, k, b in zip(slots["query"], slots["slot"], slots["bass"], strict=True)}
        given = set()
        for bass in sorted(table[table["query"].isna()]["bass"]):
            open_ = [x for x, b in now.items() if held[b] > 1]
            if not open_:
                break
            place = min(open_, key=lambda x: (hashlib.sha256("\n".join([seed, version, "repair", x[0], str(x[1]), bass]).encode()).hexdigest(), x))
            held[now[place]] -= 1
            held[bass] += 1
            now[place] = bass
            given.add(place)
        return pd.DataFrame([(q, k, b, (q, k) in given) for (q, k), b in now.items()], columns=["query", "slot", "bass", "repaired"])

    return both.groupBy().applyInPandas(serve, "query string, slot int, bass string, repaired boolean")


def coverage(pairs: DataFrame, basses: DataFrame) -> DataFrame:
    """One row: queries, pairs, basses, and how many of them have no slot."""
    all_ = basses.agg(F.count_distinct("identity").alias("basses"))
    return pairs.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("pairs"), F.count_distinct("bass").alias("_seen")).crossJoin(F.broadcast(all_)).select("queries", "pairs", "basses", (F.col("basses") - F.col("_seen")).alias("uncovered"))


def balanced_assignment(pairs: DataFrame, evaluators: int, each: int, seed: str) -> DataFrame:
    """pair_id and evaluator: each pair goes to each different evaluators, dealt in turn along a seeded order. Specified behaviour."""
    if not 1 <= each <= evaluators:
        raise ValueError("each pair needs 1 to all evaluators")
    key = F.sha2(F.concat_ws("\n", F.lit(seed), F.col("pair_id").cast("string")), 256)
    start = F.pmod(F.conv(F.substring(key, 1, 12), 16, 10).cast("long"), F.lit(evaluators))
    step = F.explode(F.sequence(F.lit(0), F.lit(each - 1)))
    return pairs.select("pair_id", start.alias("_start"), step.alias("_step")).select("pair_id", F.pmod(F.col("_start") + F.col("_step"), F.lit(evaluators)).cast("int").alias("evaluator"))


def pair_problems(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """pair_id and the first problem of each pair: duplicate, unknown_sample, role_mismatch, rate_mismatch; none for good pairs."""
    side = lambda s: samples.select(F.col("sample_id").alias(f"{s}_id"), F.col("role").alias(f"{s}_role"), F.col("rate").alias(f"{s}_rate"))
    nth = F.row_number().over(Window.partitionBy("kick_id", "bass_id").orderBy("pair_id"))
    joined = pairs.withColumn("nth", nth).join(side("kick"), "kick_id", "left").join(side("bass"), "bass_id", "left")
    wrong = (F.col("kick_role") != "kick") | ~F.col("bass_role").isin("bass", "sub-bass")
    problem = F.when(F.col("nth") > 1, "duplicate").when(F.col("kick_role").isNull() | F.col("bass_role").isNull(), "unknown_sample").when(wrong, "role_mismatch").when(F.col("kick_rate") != F.col("bass_rate"), "rate_mismatch")
    return joined.select("pair_id", problem.alias("problem")).where("problem is not null")


def session_violations(answers: DataFrame, planned: DataFrame) -> DataFrame:
    """session_id, seq and violation, all of them in journal order.

    answers: session_id, seq, presentation_index, pair_id, label, skipped,
    recognised, correction, finished; planned: session_id, presentation_index,
    pair_id.
    """
    seen = F.row_number().over(Window.partitionBy("session_id", "presentation_index").orderBy("seq")) - 1
    before = F.count_if(~F.col("correction")).over(Window.partitionBy("session_id", "presentation_index").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    plan = planned.select("session_id", "presentation_index", F.col("pair_id").alias("planned_pair"))
    joined = answers.withColumn("seen", seen).withColumn("answered", F.coalesce(before, F.lit(0))).join(plan, ["session_id", "presentation_index"], "left")
    rules = [
        F.when(F.col("planned_pair").isNull(), "unknown_presentation"),
        F.when(F.col("planned_pair") != F.col("pair_id"), "pair_mismatch"),
        F.when(F.col("skipped") & F.col("label").isNotNull(), "skipped_with_label"),
        F.when(~F.col("skipped") & F.col("label").isNull(), "answer_without_label"),
        F.when(F.col("correction") & (F.col("seen") == 0), "correction_of_nothing"),
        F.when(~F.col("correction") & (F.col("answered") > 0), "duplicate_answer"),
    ]
    rows = joined.select("session_id", "seq", F.explode(F.array_compact(F.array(*rules))).alias("violation"))
    open_ = plan.join(answers.select("session_id", "presentation_index").distinct(), ["session_id", "presentation_index"], "left_anti").join(answers.where("finished").select("session_id").distinct(), "session_id", "left_semi")
    return rows.unionByName(open_.select("session_id", F.lit(None).cast("long").alias("seq"), F.lit("finished_with_open_presentations").alias("violation")).distinct())


def revalidated(records: DataFrame, found: DataFrame) -> DataFrame:
    """records with error: why a record no longer describes its file, or null.

    records: source, path, sha256, metadata and others; found: source, path,
    sha256, metadata, error of the files as they are read now (one that can't be
    read has an error alone, one that is gone no row).
    """
    now = found.select("source", "path", F.struct(F.col("sha256").alias("sha256"), F.col("metadata").alias("metadata"), F.col("error").alias("error")).alias("_now"))
    joined = records.join(now, ["source", "path"], "left")
    error = (
        F.when(F.col("_now").isNull(), "not_found")
        .when(F.col("_now.error").isNotNull(), F.col("_now.error"))
        .when(~F.col("sha256").eqNullSafe(F.col("_now.sha256")), "stale_fingerprint")
        .when(~F.col("metadata").eqNullSafe(F.col("_now.metadata")), "stale_metadata")
    )
    return joined.select(*records.columns, error.alias("error"))


def verified_shortfall(checked: DataFrame, target: int = 100, roles: tuple[str, ...] = ("kick", "bass")) -> DataFrame:
    """role, verified and shortfall of the selected records (group, role, error) that still hold; a role without any has its whole target to find."""
    held = checked.where("group = 'selected' AND error IS NULL").groupBy("role").agg(F.count("*").alias("verified"))
    every = checked.sparkSession.createDataFrame([(r,) for r in roles], "role string")
    counted = every.join(held, "role", "left").na.fill(0, ["verified"])
    return counted.withColumn("shortfall", F.greatest(F.lit(target) - F.col("verified"), F.lit(0)))
