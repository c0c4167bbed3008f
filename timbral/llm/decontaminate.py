"""Benchmark decontamination by pigeonhole edit matching.

A test item of m bytes may occur in a document with up to
k = floor(error_rate * m) edits.  Cut into k + 1 pieces, one piece at least
occurs exactly.  Neighbouring pieces form groups of up to 64 bytes; by the
same argument one group of c pieces has at most c - 1 edits, and
so a piece that occurs exactly.  Each exact piece hit has its group checked by Myers'
bit-parallel distance (one word), and where that holds, the whole item (one
word for each 64 bytes).  Both run for many windows of items of like length at
once in numpy; an item of more than LONG bytes has one long integer as its word.

Items of fewer than SHORT bytes have no budget and no pieces.  They are looked
for as whole words, by hashes of as many words in a row as they have.

Both sides are compared in a normal form, as UTF-8: ASCII and Latin-1 letters in
lower case, each run of other ASCII characters one space.  The items are the stated
query set.  They reach the tasks in blocks of bounded size, one pass over the
documents for each block, so that a large benchmark needs more passes and no
more memory.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.shared import U64, prefix_hash, slices, span_hash, text_bytes, words

ERROR_RATE = 0.1
#: Items of fewer bytes in normal form must occur exactly, as whole words.
SHORT = 24
#: Items of more bytes are compared one window at a time.
LONG = 1024
#: Bytes of windows that are compared at once.
_AT_ONCE = 8 << 20
#: Bytes of items in one pass over the documents.
ITEM_BLOCK = 1 << 20
_SLICE = 4 << 20
_RESULT = "doc_id long, item_id long, distance int, item_length int, n_windows int, start long, stop long, short_item boolean"

_FORM = np.full(256, 0x20, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _FORM[_b] = _b
_FORM[0x41:0x5B] = np.arange(0x61, 0x7B)


def normal_form(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in normal form, offsets of the documents in them, and each byte's place in data."""
    out = _FORM[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    space = out == 0x20
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    last = first[1:].copy()
    keep = ~space
    if len(data):
        before = np.append(False, ~space[:-1])
        # a space stays after a solid byte, unless it begins the document; one at the very end is cut below
        keep |= before & ~first[:-1]
        del last
    place = np.flatnonzero(keep)
    return out[place], np.searchsorted(place, off), place


class Items:
    """Pieces and Myers tables of a block of test items."""

    def __init__(self, rows: list[tuple[int | None, str | None]], error_rate: float) -> None:
        self.ids, forms, self.short = [], [], []
        for item, text in rows:
            form = normal_form(*text_bytes(pa.array([text], pa.string())))[0].tobytes().strip(b" ")
            if len(form) >= SHORT:
                self.ids.append(item)
                forms.append(form)
            elif form:
                self.short.append((form, item))
        self._short_table()
        self.length = np.array([len(f) for f in forms], np.int64)
        self.budget = np.floor(self.length * error_rate).astype(np.int64)
        pieces, groups = [], []
        for i, (form, k) in enumerate(zip(forms, self.budget.tolist(), strict=True)):
            cuts = [len(form) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if groups and groups[-1][0] == i and b - groups[-1][1] <= 64:
                    groups[-1][2], groups[-1][3] = b - groups[-1][1], groups[-1][3] + 1
                else:
                    groups.append([i, a, b - a, 0])
                pieces.append((len(groups) - 1, a, b - a, form[a:b]))
        self.group_item, self.group_at, self.group_length, self.group_budget = np.array(groups, np.int64).reshape(-1, 4).T
        self.gram = min([8, *(n for _, _, n, _ in pieces)])
        size = np.array([n for _, _, n, _ in pieces], np.int64)
        grams = np.array([int.from_bytes(p[: self.gram], "little") for *_, p in pieces], U64)
        tails = np.array([int.from_bytes(p[-self.gram :], "little") for *_, p in pieces], U64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.tails = grams[order], tails[order]
        self.group = np.array([i for i, *_ in pieces], np.int64)[order]
        self.at = np.array([a for _, a, *_ in pieces], np.int64)[order]
        self.size = size[order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self._slot(self.grams)] = True
        used = sorted(set(b"".join(forms)))
        self.code = np.zeros(256, np.uint8)
        self.code[used] = np.arange(1, len(used) + 1)
        self.near = self._bits([forms[i][a : a + n] for i, a, n, _ in groups])
        # tables by length: the items of each have at most twice the words of its shortest
        self.kind = np.where(self.length > LONG, -1, np.ceil(np.log2(np.maximum(-(-self.length // 64), 1)))).astype(np.int64)
        self.place = np.zeros(len(forms), np.int64)
        self.forward, self.backward = {}, {}
        for kind in np.unique(self.kind).tolist():
            rows_ = np.flatnonzero(self.kind == kind)
            self.place[rows_] = np.arange(len(rows_))
            own = [forms[i] for i in rows_]
            build = self._bits if kind >= 0 else lambda texts: [_long_bits(t) for t in texts]
            self.forward[kind], self.backward[kind] = build(own), build([f[::-1] for f in own])

    def _short_table(self) -> None:
        """Hashes of the short items by how many words they have."""
        self.short_hash: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_words: dict[int, list[int]] = {}
        for k, (form, _) in enumerate(self.short):
            by_words.setdefault(form.count(b" ") + 1, []).append(k)
        for n, rows in by_words.items():
            hashes = np.array([span_hash(prefix_hash(np.frombuffer(self.short[k][0], np.uint8)), np.array([0]), np.array([len(self.short[k][0])]))[0] for k in rows], U64)
            order = np.argsort(hashes, kind="stable")
            self.short_hash[n] = hashes[order], np.array(rows)[order]

    def short_hits(self, form: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, short item, start, stop) of each exact occurrence between spaces or ends."""
        if not self.short:
            return []
        start, end, doc = words(form, off)
        prefix, out = prefix_hash(form), []
        for n, (hashes, rows) in self.short_hash.items():
            if len(start) < n:
                continue
            a, b, d = start[: len(start) - n + 1], end[n - 1 :], doc[: len(start) - n + 1]
            same = d == doc[n - 1 :]
            a, b, d = a[same], b[same], d[same]
            found = span_hash(prefix, a, b)
            low, high = np.searchsorted(hashes, found), np.searchsorted(hashes, found, "right")
            for k in np.flatnonzero(high > low):
                text = form[a[k] : b[k]].tobytes()
                out += [(int(d[k]), int(r), int(a[k]), int(b[k])) for r in rows[low[k] : high[k]] if self.short[r][0] == text]
        return out

    def _bits(self, texts: list[bytes]) -> np.ndarray:
        """Myers' table: [text, word, code] has the bits of the places where text has the code's byte."""
        table = np.zeros((len(texts), -(-max(map(len, texts), default=1) // 64), int(self.code.max()) + 1), U64)
        for i, text in enumerate(texts):
            for j, b in enumerate(text):
                table[i, j // 64, self.code[b]] |= U64(1 << (j % 64))
        return table

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * U64(0x9E3779B97F4A7C15)) >> U64(48)

    def hits(self, form: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, group and where the group would begin, of every exact piece hit; each once."""
        z = np.zeros(0, np.int64)
        if len(form) < self.gram or not len(self.ids):
            return z, z, z
        padded = np.concatenate([form, np.zeros(8, np.uint8)])
        two = padded[:-1].astype(np.uint16) | (padded[1:].astype(np.uint16) << np.uint16(8))
        four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
        eight = four[:-4].astype(U64) | (four[4:].astype(U64) << U64(32))
        eight = eight[: len(form)] & U64((1 << (8 * self.gram)) - 1)
        spot = np.flatnonzero(self.seen[self._slot(eight)])
        low, high = np.searchsorted(self.grams, eight[spot]), np.searchsorted(self.grams, eight[spot], "right")
        count = high - low
        spot, low, count = spot[count > 0], low[count > 0], count[count > 0]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        spot, piece = np.repeat(spot, count), np.repeat(low, count) + nth
        doc = np.searchsorted(off, spot, "right") - 1
        end = spot + self.size[piece]
        keep = end <= off[doc + 1]
        spot, piece, doc, end = spot[keep], piece[keep], doc[keep], end[keep]
        keep = eight[end - self.gram] == self.tails[piece]  # the group's distance settles what is between
        spot, piece, doc = spot[keep], piece[keep], doc[keep]
        found = np.unique(np.stack([doc, self.group[piece], spot - self.at[piece] + self.group_at[self.group[piece]]]), axis=1)
        return found[0], found[1], found[2]


def myers(table: np.ndarray, item: np.ndarray, length: np.ndarray, text: np.ndarray, anchored: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each pattern to a part of its row of text, and the column after which it is reached first.

    table[item, word, code]: the pattern's bits.  anchored: the part begins with the row.
    """
    n, words = len(item), int(-(-length.max(initial=1) // 64))
    pv = [np.full(n, ~U64(0)) for _ in range(words)]
    mv = [np.zeros(n, U64) for _ in range(words)]
    last = ((length - 1) % 64).astype(U64)
    ends = [(length - 1) // 64 == j for j in range(words)]
    score, low, at = length.copy(), length.copy(), np.zeros(n, np.int64)
    one, top = U64(1), U64(63)
    for t in range(text.shape[1]):
        code = text[:, t]
        plus, minus = np.full(n, U64(anchored)), np.zeros(n, U64)
        for j in range(words):
            eq = table[item, j, code]
            xv = eq | mv[j]
            eq = eq | minus
            xh = (((eq & pv[j]) + pv[j]) ^ pv[j]) | eq
            ph = mv[j] | ~(xh | pv[j])
            mh = pv[j] & xh
            if ends[j].any():
                change = ((ph >> last) & one).astype(np.int64) - ((mh >> last) & one).astype(np.int64)
                score = score + (change if words == 1 else change * ends[j])
            ph_out, mh_out = ph >> top, mh >> top
            ph, mh = (ph << one) | plus, (mh << one) | minus
            pv[j], mv[j] = mh | ~(xv | ph), ph & xv
            plus, minus = ph_out, mh_out
        better = score < low
        low = np.where(better, score, low)
        at = np.where(better, t + 1, at)
    return low, at


def _long_bits(text: bytes) -> dict[int, int]:
    """Myers' table of a long pattern: the places of each byte, as the bits of one integer."""
    places = np.frombuffer(text, np.uint8)
    return {int(b): int.from_bytes(np.packbits(places == b, bitorder="little").tobytes(), "little") for b in np.unique(places)}


def myers_long(table: dict[int, int], length: int, text: bytes, anchored: bool) -> tuple[int, int]:
    """myers() of one pattern of any length and one text."""
    every = (1 << length) - 1
    pv, mv, score, low, at = every, 0, length, length, 0
    for t, byte in enumerate(text, 1):
        eq = table.get(byte, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & every, pv & xh & every
        score += (ph.bit_length() == length) - (mh.bit_length() == length)
        ph, mh = (ph << 1 | anchored) & every, (mh << 1) & every
        pv, mv = (mh | ~(xv | ph)) & every, ph & xv
        if score < low:
            low, at = score, t
    return low, at


def _windows(form: np.ndarray, code: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """A row of codes for each span, filled up with 0; back: from its end to its begin."""
    step = np.arange(width)
    place = end[:, None] - 1 - step if back else begin[:, None] + step
    inside = step < (end - begin)[:, None]
    return np.where(inside, code[form[np.clip(place, 0, max(len(form) - 1, 0))]], 0)


def _occurrences(items: Items, form: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance of each item in its window of form, and the start and stop of the nearest occurrence; a stop of 0 where it is over the budget."""
    best, start, stop = items.budget[item] + 1, np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    rows = np.flatnonzero(items.kind[item] < 0)
    rows = rows[np.lexsort((begin[rows], item[rows]))]
    reach = end[rows].copy()
    for k in range(1, len(rows)):  # windows that overlap are searched as one
        if item[rows[k]] == item[rows[k - 1]] and begin[rows[k]] < reach[k - 1]:
            reach[k] = max(reach[k], reach[k - 1])
    fresh = [k for k in range(len(rows)) if not k or item[rows[k]] != item[rows[k - 1]] or begin[rows[k]] >= reach[k - 1]]
    for a, b in zip(fresh, [*fresh[1:], len(rows)], strict=False):
        i, r = int(item[rows[a]]), rows[a:b]
        text = form[begin[rows[a]] : reach[b - 1]].tobytes()
        low, to = myers_long(items.forward[-1][items.place[i]], int(items.length[i]), text, False)
        if low <= items.budget[i]:
            best[r], stop[r] = low, begin[rows[a]] + to
            start[r] = stop[r] - myers_long(items.backward[-1][items.place[i]], int(items.length[i]), text[:to][::-1], True)[1]
    for kind in np.unique(items.kind[item]).tolist():
        rows = np.flatnonzero(items.kind[item] == kind) if kind >= 0 else np.zeros(0, np.int64)
        each = max(1, _AT_ONCE // (64 << max(kind, 0)) // 10)
        for a in range(0, len(rows), each):
            r = rows[a : a + each]
            i = item[r]
            place, wide = items.place[i], int((end[r] - begin[r]).max())
            text = _windows(form, items.code, begin[r], end[r], wide)
            low, to = myers(items.forward[kind], place, items.length[i], text, anchored=False)
            good = np.flatnonzero(low <= items.budget[i])
            if not len(good):
                continue
            back = to[good, None] - 1 - np.arange(wide)
            turned = np.where(back >= 0, np.take_along_axis(text[good], np.maximum(back, 0), axis=1), 0)
            _, before = myers(items.backward[kind], place[good], items.length[i[good]], turned, anchored=True)
            best[r[good]] = low[good]
            stop[r[good]] = begin[r[good]] + to[good]
            start[r[good]] = stop[r[good]] - before
    return best, start, stop


def find_items(batch: pa.RecordBatch, items: Items) -> list[tuple]:
    """(doc_id, item_id, distance, item length, windows, start, stop in UTF-8 bytes, short) of the nearest occurrence of each item in each document."""
    ids, base, out = batch.column("doc_id").to_pylist(), 0, []
    for part in slices(batch, "text", _SLICE):
        data, off = text_bytes(part.column("text"))
        form, noff, place = normal_form(data, off)
        first: dict[tuple[int, int], list[int]] = {}
        for d, r, a, b in sorted(items.short_hits(form, noff), key=lambda x: (x[0], x[1], x[2])):
            first.setdefault((d, r), [0, a, b])[0] += 1
        for (d, r), (n, a, b) in first.items():
            out.append((ids[base + d], items.short[r][1], 0, b - a, n, int(place[a] - off[d]), int(place[b - 1] + 1 - off[d]), True))
        doc, group, at = items.hits(form, noff)
        held = []
        for a in range(0, len(doc), 20_000):
            d, g, p = doc[a : a + 20_000], group[a : a + 20_000], at[a : a + 20_000]
            k, m = items.group_budget[g], items.group_length[g]
            begin, end = np.maximum(p - k, noff[d]), np.minimum(p + m + k, noff[d + 1])
            text = _windows(form, items.code, begin, end, int((m + 2 * k).max()))
            good = myers(items.near, g, m, text, anchored=False)[0] <= k
            # edits before the group move the item by up to its own budget, on top of the group's
            held.append((d[good], items.group_item[g[good]], p[good] - items.group_at[g[good]]))
        base += part.num_rows
        if not held or not sum(len(x) for x, _, _ in held):
            continue
        spots, windows = np.unique(np.stack([np.concatenate(x) for x in zip(*held, strict=True)]), axis=1, return_counts=True)
        doc, item, p = spots
        k, m = items.budget[item], items.length[item]
        best, start, stop = _occurrences(items, form, item, np.maximum(p - k, noff[doc]), np.minimum(p + m + k, noff[doc + 1]))
        good = np.flatnonzero(best <= k)
        doc, item, best, windows = doc[good], item[good], best[good], windows[good]
        start, stop = place[start[good]] - off[doc], place[stop[good] - 1] + 1 - off[doc]
        order = np.lexsort((stop, best, item, doc))
        doc, item, best, windows, start, stop = (x[order] for x in (doc, item, best, windows, start, stop))
        lead = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))) if len(doc) else []
        count = np.add.reduceat(windows, lead) if len(doc) else []
        own = base - part.num_rows
        out += [(ids[own + doc[x]], items.ids[item[x]], int(best[x]), int(items.length[item[x]]), int(n), int(start[x]), int(stop[x]), False) for x, n in zip(lead, count, strict=True)]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """One row for each document and test item that occurs in it with at most error_rate * length edits.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored.
    Returns doc_id, item_id, distance, item_length (both in bytes of the normal
    form), n_windows (piece windows that held), start and stop: the nearest
    occurrence in UTF-8 bytes of the text, the first of equals; and short_item:
    whether the item is under SHORT bytes, which say little by themselves, and
    was found exactly, n_windows times, between spaces.  Null and empty texts
    and items match nothing.  A repeated row gives its rows again; the same
    item_id given twice is two items, and so are two without one, whose rows
    have no item_id.  No items or no documents give no rows.
    """
    spark = docs.sparkSession
    sizes = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = int(sizes) // ITEM_BLOCK + 1
    found = []
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("item_length", pa.int32()), ("n_windows", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("short_item", pa.bool_())])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).select(F.col("item_id").cast("long"), "text")
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.orderBy("item_id", "text").toLocalIterator()])

        def search(batches, sent=sent):
            items = Items(sent.value, error_rate)
            for batch in batches:
                rows = find_items(batch, items)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

        found.append(texts.mapInArrow(search, _RESULT))
    rows = reduce(DataFrame.unionByName, found)
    return rows if blocks else rows.where("false")
