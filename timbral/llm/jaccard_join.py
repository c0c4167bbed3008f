"""Exact n-gram Jaccard self-join of documents, by T-occurrence search.

Two documents link when ``of * |A & B| >= at_least * |A | B|`` for their sets of
word shingles.  Equal sets are one *class* from the start, so copies are never
compared.  The work has four parts:

* **Neighbourhoods without loss.**  Linked sets of sizes n <= m differ in at
  most D = (n + m)(of - at_least)/(of + at_least) shingles.  The hash space is
  cut into D + 1 + e segments; linked sets agree wholly on e + 1 of them at
  least.  Each class sends one signature for each segment, and the classes that
  share a signature are neighbours of the least of them, their *centre*.  What e
  allows is left out.  Classes that share a signature agree on its being
  frequent and on its centre: each leaves out frequent signatures, as those that
  a shared passage gives, in the order of their centres.  Of the others each class leaves out some that
  it shares with the rarest of its centres, which are mostly met by chance.  No
  pairs are made, and neighbourhoods are not joined, so that they do not chain.
* **T-occurrence search.**  A neighbourhood is a task; above ``block`` shingles
  it is dealt as blocks that have some pivots in common.  In a task an inverted
  index answers each class's search: with n shingles, a partner shares
  T = ceil(at_least * n / of) of them at least.  DivideSkip sets the L longest
  lists aside, heap-merges the short ones for documents met T - L times, and
  binary-probes the long lists for those only.  Classes that a search has
  reached leave the index, so a dense group is walked once.
* **Components** of the verified links.
* **The rest.**  Of a neighbourhood in several blocks, classes outside its
  largest component are searched for in all of its blocks.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbral.llm.components import connected_components
from timbral.llm.shared import LOWER_VALUES, U64, durable, mix, pack, prefix_hash, shingle_hashes, shuffle_width, slices, span_hash, spread, text_bytes, text_size, unpack, words

_SLICE = 2 << 20
_FLUSH = 1 << 20
#: Classes with one signature in a task, from which on a task names a centre of its own for them.
_HOT = 100
#: A signature is frequent if more classes have it.
FREQUENT = 8
#: One in so many of the shingles in which linked sets may differ, and one more, is allowed for frequent signatures, and for rare centres.
FREQUENT_PART, CHANCE_PART = 10, 12
#: Pivots that the blocks of a neighbourhood have in common, about.
_PIVOTS = 16
#: The share of the merge's cost that a probe of a long list takes (DivideSkip's mu).
_MU = 0.01
#: Shingles in a block, about: what a task of the search holds.
BLOCK = 1 << 20
#: The level of signatures that no class may leave out.
_KEPT = 255
_BLOB = "to int, kind int, payload binary"
_SENT = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_NEAR = "a long, b long, sig long, level int, n int, frequent int"


def _sets(batch: pa.RecordBatch | pa.Table, width: int):
    """(row in the batch, sorted distinct shingle hashes) of every document, in order."""
    base = 0
    for part in slices(batch, "text", _SLICE):
        data, off = text_bytes(part.column("text"))
        start, end, doc = words(data, off)
        hashes, own = shingle_hashes(span_hash(prefix_hash(data, LOWER_VALUES), start, end), doc, width)
        cuts = np.searchsorted(own, np.arange(part.num_rows + 1))
        for k in range(part.num_rows):
            yield base + k, np.unique(hashes[cuts[k] : cuts[k + 1]])
        base += part.num_rows


def _class_of(shingles: np.ndarray) -> int:
    """The same number for equal sets; as a signed 64-bit value."""
    n = np.array([len(shingles)], U64)
    return int(mix(mix(shingles).sum(dtype=U64, keepdims=True) ^ mix(n + U64(7)))[0].view(np.int64))


class _Segments:
    """How many segments each size of set is cut into, and how many of them may be empty, frequent, or left out as the rarest."""

    def __init__(self, at_least: int, of: int) -> None:
        self.at_least, self.of = at_least, of
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, edges[-1] * 6 // 5))
        self.edges = np.array(edges)
        self.cuts, self.empty, self.frequent, self.chance = [], [], [], []
        for low, high in zip(edges, edges[1:], strict=False):
            n = high - 1
            differ = (n + n * of // at_least) * (of - at_least) // (of + at_least)
            frequent, chance = (1 + differ // FREQUENT_PART, 1 + differ // CHANCE_PART) if differ else (0, 0)
            empty = 0
            while empty < differ:  # as many as the smallest sets have, nearly always
                k = differ + 1 + empty + frequent + 2 * chance
                mean = k * math.exp(-low / k)
                if empty >= mean + 3 * math.sqrt(mean):
                    break
                empty += 1 + empty // 16
            self.cuts.append(differ + 1 + empty + frequent + 2 * chance)
            self.empty.append(empty)
            self.frequent.append(frequent)
            self.chance.append(chance)

    def levels(self, n: int) -> range:
        """Levels of the smaller set of any pair that a set of n shingles can be in."""
        low = -(-n * self.at_least // self.of)
        return range(int(np.searchsorted(self.edges, low, "right")) - 1, int(np.searchsorted(self.edges, n, "right")))

    def signatures(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures and their levels.

        Sets that agree on a segment agree on its being empty.  A set with no
        more empty segments than empty[level] leaves them out.  One with more
        has its shingles in few segments; it sends these and, for others of its
        kind, which may agree with it on empty segments alone, the first
        shingles by hash, of which linked sets have one in common.
        """
        sums = np.append(np.zeros(1, U64), np.cumsum(mix(shingles + U64(3)), dtype=U64))
        out, levels, short = [], [], False
        for level in self.levels(len(shingles)):
            k = self.cuts[level]
            # bounds of k equal parts of the upper 32 bits, rounded alike for all sets
            bounds = ((np.arange(1, k, dtype=U64) << U64(32)) // U64(k)) << U64(32)
            at = np.concatenate([[0], np.searchsorted(shingles, bounds), [len(shingles)]])
            keep = at[1:] > at[:-1]
            name = mix(np.flatnonzero(keep).astype(U64) + U64(level << 40))
            out.append(mix((sums[at[1:]] - sums[at[:-1]])[keep] ^ name))
            short |= k - len(name) > self.empty[level]
            levels.append(np.full(len(name), level, np.uint8))
        if short:
            first = len(shingles) - -(-len(shingles) * self.at_least // self.of) + 1
            out.append(mix(shingles[:first] ^ U64(0x5851F42D4C957F2D)))
            levels.append(np.full(first, _KEPT, np.uint8))
        return np.concatenate(out), np.concatenate(levels)


def _signatures(width: int, at_least: int, of: int, buckets: int):
    """Signatures with their classes, packed by bucket; of one that many classes of a task have, the least class goes there and the others name it."""

    def send(batches):
        segments = _Segments(at_least, of)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        classes: list[int] = []
        seen: set[int] = set()

        def flush():
            sig, level = (np.concatenate(x) for x in zip(*held, strict=True))
            cls = np.repeat(np.array(classes, np.int64), [len(x) for x, _ in held])
            held.clear()
            classes.clear()
            seen.clear()
            order = np.lexsort((cls, sig))
            sig, cls, level = sig[order], cls[order], level[order]
            lead = np.append(True, sig[1:] != sig[:-1])
            first = np.flatnonzero(lead)
            hot = np.diff(np.append(first, len(sig))) > _HOT
            group = np.cumsum(lead) - 1
            named = hot[group] & ~lead
            far = (sig[named], cls[named], cls[first[group[named]]], level[named])
            sig, cls, level, hot = sig[~named], cls[~named], level[~named], hot[group[~named]].astype(np.uint8)
            to = ((sig >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)  # the order of to is that of sig
            at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            out = [(int(to[a]), 0, pack(sig[a:b], cls[a:b], level[a:b], hot[a:b])) for a, b in zip(at, [*at[1:], len(to)], strict=True)]
            if len(far[0]):
                out.append((int(far[1][0] % buckets), 1, pack(*far)))
            return pa.RecordBatch.from_pylist([dict(zip(_SENT.names, x, strict=True)) for x in out], schema=_SENT)

        size = 0
        for batch in batches:
            for _, shingles in _sets(batch, width):
                cls = _class_of(shingles) if len(shingles) else None
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    held.append(segments.signatures(shingles))
                    classes.append(cls)
                    size += len(held[-1][0])
                    if size >= _FLUSH:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return send


def _stars(table: pa.Table) -> pa.Table:
    """a, b, level, n, frequent: class a has n signatures of this level, so many of them frequent, with centre b.

    n = 0: a has the signature sig in common with b, its task's centre; n = -1:
    b is the centre of the classes that have sig in common with a.
    """
    out = [(np.zeros(0, np.int64),) * 6]
    parts = []
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload"), strict=True):
        if kind:
            sig, cls, least, level = unpack(payload.as_py(), "u8", "i8", "i8", "u1")
            out.append((cls, least, sig.view(np.int64), level, np.zeros(len(sig), np.int64), np.zeros(len(sig), np.int64)))
        else:
            parts.append(unpack(payload.as_py(), "u8", "i8", "u1", "u1"))
    if parts:
        sig, cls, level, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((cls, sig))
        sig, cls, level, hot = sig[order], cls[order], level[order], hot[order]
        lead = np.append(True, sig[1:] != sig[:-1])
        group, first = np.cumsum(lead) - 1, np.flatnonzero(lead)
        least = cls[first[group]]
        once = lead | np.append(True, cls[1:] != cls[:-1])  # two tasks may send the same class
        many = np.add.reduceat(once.astype(np.int64) + hot.astype(np.int64) * FREQUENT, first) > FREQUENT
        far = (cls != least) & once
        edge, at, n = np.unique(np.stack([cls[far], least[far], level[far].astype(np.int64)]), axis=1, return_inverse=True, return_counts=True)
        out.append((edge[0], edge[1], np.zeros(len(n), np.int64), edge[2], n, np.bincount(at.ravel(), many[group[far]], len(n)).astype(np.int64)))
        ends = hot > 0
        out.append((cls[ends], least[ends], sig[ends].view(np.int64), level[ends], np.full(int(ends.sum()), -1), np.zeros(int(ends.sum()), np.int64)))
    columns = [np.concatenate(x).astype(kind) for x, kind in zip(zip(*out, strict=True), (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32), strict=True)]
    return pa.table(columns, ["a", "b", "sig", "level", "n", "frequent"])


def _neighbourhoods(near: DataFrame, segments: _Segments) -> DataFrame:
    """(cls, center) of what the stars leave when every class has left out what it may; each centre with itself."""
    ends = near.where("n = -1").select("sig", F.col("a").alias("b"), F.col("b").alias("center")).distinct()
    hot = near.where("n = 0").join(ends, ["sig", "b"]).where("a <> center").select("a", "center", "level", "sig").distinct()
    stars = near.where("n > 0").select("a", F.col("b").alias("center"), "level", "n", "frequent").unionByName(hot.select("a", "center", "level", F.lit(1).alias("n"), F.lit(1).alias("frequent")))
    counts = stars.groupBy("a", "center", "level").agg(F.sum("n").alias("n"), F.sum("frequent").alias("frequent"))
    may = lambda most: F.coalesce(F.try_element_at(F.array(*map(F.lit, most)), F.col("level") + 1), F.lit(0))
    own = Window.partitionBy("a", "level")
    # frequent signatures go in the order of their centres, of which the least have the most classes: what two linked classes
    # leave out of those they share is a beginning of one list, the longer of two, so it is no more than one of them may leave out
    first = own.orderBy("center").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = counts.withColumn("upto", F.sum("frequent").over(first)).withColumn("n", F.when(F.col("upto") <= may(segments.frequent), F.col("n") - F.col("frequent")).otherwise(F.col("n"))).where("n > 0")
    rarest = own.orderBy("n", "center").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rest.withColumn("upto", F.sum("n").over(rarest)).where(F.col("upto") > may(segments.chance))
    both = F.explode(F.array(F.struct(F.col("a").alias("cls"), "center"), F.struct(F.col("center").alias("cls"), "center"))).alias("r")
    return kept.select(both).select("r.cls", "r.center").distinct()


class Index:
    """Inverted lists over some sets, searched by T-occurrence; rows can leave."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        rows = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate(sets) if sets else np.zeros(0, U64)
        order = np.argsort(flat, kind="stable")
        flat, self.rows = flat[order], rows[order]
        lead = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        self.tokens, self.begin = flat[lead], np.append(lead, len(flat))
        self.present = np.ones(len(sets), bool)
        self.left = self.listed = len(sets)

    def drop(self, rows: np.ndarray) -> None:
        """Rows leave; the lists are cut down each time half of what they hold has left."""
        self.left -= int(self.present[rows].sum())
        self.present[rows] = False
        if self.left * 2 < self.listed:
            keep = self.present[self.rows]
            self.begin = np.append(0, np.cumsum(keep))[self.begin]
            self.rows, self.listed = self.rows[keep], self.left

    def links(self, query: np.ndarray, at_least: int, of: int) -> np.ndarray:
        """Present rows whose sets link with query."""
        if not len(self.tokens):
            return np.zeros(0, np.int64)
        n = len(query)
        at = np.searchsorted(self.tokens, query)
        hit = (at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)
        at = at[hit]
        size = self.begin[at + 1] - self.begin[at]
        need = -(-at_least * n // of)
        order = np.argsort(size, kind="stable")
        at, size = at[order], size[order]
        full = size > 0
        at, size = at[full], size[full]
        if len(at) < need:
            return np.zeros(0, np.int64)
        longest = int(size[-1])
        aside = min(need - 1, int(need / (_MU * math.log2(longest + 1) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside :][::-1]
        lists = [self.rows[self.begin[k] : self.begin[k + 1]] for k in short]
        if sum(map(len, lists)) <= 2000:
            counted = [(row, sum(1 for _ in group)) for row, group in groupby(heapq.merge(*(x.tolist() for x in lists)))]
            rows, count = np.array([r for r, _ in counted], np.int64), np.array([c for _, c in counted], np.int64)
        else:  # the same merge, by numpy's run-merging sort
            rows, count = np.unique(np.sort(np.concatenate(lists), kind="stable"), return_counts=True)
        keep = (count >= need - aside) & self.present[rows] & (self.sizes[rows] * of >= n * at_least) & (self.sizes[rows] * at_least <= n * of)
        rows, count = rows[keep], count[keep]
        # what each needs is known now that its size is
        least = -(-at_least * (n + self.sizes[rows]) // (of + at_least))
        for done, k in enumerate(long):
            keep = count + (len(long) - done) >= least
            if not keep.all():
                rows, count, least = rows[keep], count[keep], least[keep]
            if not len(rows):
                break
            part = self.rows[self.begin[k] : self.begin[k + 1]]
            spot = np.searchsorted(part, rows)
            count = count + (part[np.minimum(spot, len(part) - 1)] == rows)
        return rows[count >= least]


class _Links:
    """Links found in a task, kept as a forest whose roots are the least classes; the same for any order of the rows."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def add(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)

    def table(self) -> pa.Table:
        far = sorted((x, self.root(x)) for x in list(self.up))
        far = [(x, y) for x, y in far if x != y]
        return pa.table({"a": pa.array([x for x, _ in far], pa.int64()), "b": pa.array([y for _, y in far], pa.int64())})


def _named_sets(table: pa.Table, width: int) -> tuple[list[int], list[np.ndarray]]:
    """Classes that table(cls, text) asks for, in order, and their sets. A doc_id that is repeated may bring another text; it is left out."""
    wanted, found = table.column("cls").to_numpy(), {}
    for row, shingles in _sets(table, width):
        if _class_of(shingles) == wanted[row]:
            found[int(wanted[row])] = shingles
    classes = sorted(found)
    return classes, [found[c] for c in classes]


def _search(width: int, at_least: int, of: int):
    """Links within a block, as (class, least class that it is linked with)."""

    def send(table: pa.Table) -> pa.Table:
        classes, sets = _named_sets(table, width)
        index, links, queue, todo = Index(sets), _Links(), [], 0
        while index.left:
            if queue:
                k = queue.pop()
            else:
                k, todo = todo, todo + 1
                if not index.present[k]:
                    continue
                index.drop(np.array([k]))
            rows = index.links(sets[k], at_least, of)
            index.drop(rows)
            queue += rows.tolist()
            for r in rows:
                links.add(classes[r], classes[k])
        return links.table()

    return send


def _search_rest(width: int, at_least: int, of: int):
    """Links of the classes asked for with all of a block."""

    def send(table: pa.Table) -> pa.Table:
        asked = pc.fill_null(table.column("asks"), False)
        names, queries = _named_sets(table.filter(asked), width)
        classes, sets = _named_sets(table.filter(pc.invert(asked)), width)
        index, links = Index(sets), _Links()
        for name, query in zip(names, queries, strict=True):
            for r in index.links(query, at_least, of):
                links.add(classes[r], name)
        return links.table()

    return send


def _describe(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64())])

    def send(batches):
        for batch in batches:
            found = [(len(s), _class_of(s) if len(s) else None) for _, s in _sets(batch, width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], schema=schema)

    return send


def _links(texts: DataFrame, members: DataFrame, width: int, at_least: int, of: int, block: int) -> DataFrame:
    """(node, root) of all linked classes. members: cls, center, doc_id and n (shingles) of each class of each neighbourhood."""
    sizes = members.groupBy("center").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"), F.ceil(F.count("*") / _PIVOTS).alias("each"))
    placed = durable(members.join(sizes, "center").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int")))
    pivot = F.pmod(F.xxhash64("cls", F.lit("pivot")), "each") == 0
    places = F.when((F.col("blocks") > 1) & pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = placed.select("doc_id", "cls", "center", F.explode(places).alias("block"))
    found = texts.join(dealt, "doc_id").select("center", "block", "cls", "text").groupBy("center", "block").applyInArrow(_search(width, at_least, of), "a long, b long")
    roots = connected_components(found)

    # neighbourhoods in several blocks: what is not in the largest component is searched for in all blocks
    several = placed.where("blocks > 1").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    counts = several.groupBy("center", "root").agg(F.count("*").alias("size"))
    largest = counts.groupBy("center").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    rest = durable(several.join(largest, "center").where("root <> main").select("center", "cls", "doc_id", "n", "blocks"))
    if rest.isEmpty():
        return roots
    chunks = rest.groupBy("center").agg(F.ceil(F.sum("n") / block).cast("int").alias("chunks"))
    all_blocks, all_chunks = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("chunks") - 1)
    queries = rest.join(chunks, "center").select("doc_id", "cls", "center", F.explode(all_blocks).alias("block"), F.pmod(F.xxhash64("cls"), "chunks").cast("int").alias("chunk"), F.lit(True).alias("asks"))
    held = placed.join(chunks, "center").select("doc_id", "cls", "center", "block", F.explode(all_chunks).alias("chunk"), F.lit(False).alias("asks"))
    more = texts.join(queries.unionByName(held), "doc_id").select("center", "block", "chunk", "asks", "cls", "text").groupBy("center", "block", "chunk").applyInArrow(_search_rest(width, at_least, of), "a long, b long")
    return connected_components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def jaccard_components(docs: DataFrame, width: int = 3, at_least: int = 90, of: int = 100, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links, itself included) of every row with a doc_id.

    docs: doc_id, text; other columns are ignored.  Words are the runs of
    characters other than white space, with A-Z in lower case.  A text of fewer
    words than width has all of them as its one shingle; a null, empty or blank
    text has none and links with nothing.  Rows that repeat a doc_id are
    described each; rows without a doc_id are left out.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = spread(text_size(texts) // 2, 16 << 20, 4 * shuffle_width(spark))
    described = durable(texts.mapInArrow(_describe(width), "doc_id long, n_shingles long, cls long"))
    classes = described.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"))

    sent = texts.mapInArrow(_signatures(width, at_least, of, buckets), _BLOB)
    near = durable(sent.groupBy("to").applyInArrow(_stars, _NEAR))
    members = _neighbourhoods(near, _Segments(at_least, of)).join(classes, "cls").select("cls", "center", "doc_id", "n")
    roots = _links(texts, members, width, at_least, of, block)

    # the other classes have one row, which is its own component
    linked = classes.join(roots, F.col("cls") == F.col("node"), "left").where("rows > 1 or root is not null").select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    first = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(first, "root").select("cls", "component_id")
    return described.join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
