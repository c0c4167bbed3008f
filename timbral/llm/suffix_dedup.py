"""Removal of byte strings that an earlier document also holds (suffix-array dedup).

The suffix array is built only as deep as it is needed, by bucket-pointer
refinement: positions start in buckets of equal q-grams, and buckets are
refined by sorting on the bucket identifiers of later offsets (8 + 8 bytes,
then 16 + 16, then 32 + 18), each level reading the identifiers that the level
before has just updated.  Two positions share a bucket at the last level if and
only if their next 50 bytes are equal.

Spark deals out the positions so that no task sees more than a small bucket:

1. ``home`` groups of a few MB of documents find, for every 50-byte window, the
   least hash among its 16-grams (its q-gram bucket).  Equal windows have equal
   hashes.  Each home sends its distinct hashes to hash-dealt tasks, which
   answer with those that two documents share.
2. Windows of shared hashes travel as runs (84 bytes at most for up to 35
   windows) to their bucket's task; equal runs of one home travel once.  That
   task refines the buckets and answers with byte ranges by home.  A bucket of
   more than HOT runs is dealt out once more by the least but one hash of each
   window, on which equal windows agree as well.
3. Each home joins the ranges and cuts them from the texts.

A hot passage is one hash and, from each home, one run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.shared import BYTE_VALUES, U64, mix, pack, powers, prefix_hash, shuffle_width, spread, text_bytes, text_size, unpack

WINDOW = 50
GRAM = 16
RUN = WINDOW - GRAM + 1  # windows in a run, at most
WIDTH = WINDOW + RUN - 1  # bytes in a run, at most
#: Runs, before equal ones of a home become one, from which on a bucket is dealt out by two hashes.
HOT = 1 << 14
_CHUNK = 1 << 21
_BLOB = "to int, source int, payload binary"
_SENT = pa.schema([("to", pa.int32()), ("source", pa.int32()), ("payload", pa.binary())])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width neighbours, by doubling."""
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[: len(out) - (width - size)], out[width - size :])


def _grams(data: np.ndarray) -> np.ndarray:
    """The hash of each 16-gram."""
    prefix = prefix_hash(data, BYTE_VALUES)
    return mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(len(data))[1][: len(data) - GRAM + 1])


def _runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and hash of each run of neighbouring windows with one least 16-gram hash."""
    if len(data) < WINDOW:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U64)
    key = _least(_grams(data), RUN)
    n = len(key)  # windows; those that cross a document's end are left out
    whole = np.zeros(n + 1, np.int32)
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a >= WINDOW:
            whole[a] += 1
            whole[b - WINDOW + 1] -= 1
    whole = np.cumsum(whole[:n]) > 0
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (key[1:] != key[:-1])
    edge = off[(off > 0) & (off < n)]
    first[edge] |= whole[edge]
    start = np.flatnonzero(first)
    stop = np.flatnonzero(whole & np.append(~whole[1:] | first[1:], True)) + 1
    count = stop - start
    pieces = -(-count // RUN)
    if len(pieces) and pieces.max() > 1:  # the same least hash again and again, as in "aaaa"
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, stop = np.repeat(start, pieces) + nth * RUN, np.repeat(stop, pieces)
        count = np.minimum(stop - start, RUN)
    return start, count, key[start]


def _split(data: np.ndarray, start: np.ndarray, count: np.ndarray, hashes: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and bucket hash of the runs, with hot ones cut where their windows' least but one hash changes."""
    rows = np.flatnonzero(hot)
    if not len(rows):
        return start, count, hashes
    grams = np.append(_grams(data), np.full(2 * RUN, ~U64(0)))
    near = grams[start[rows, None] + np.arange(2 * RUN - 1)]
    near[near == hashes[rows, None]] = ~U64(0)
    second = np.lib.stride_tricks.sliding_window_view(near, RUN, axis=1).min(axis=2)
    inside = np.arange(RUN) < count[rows, None]
    first = inside & np.append(np.ones((len(rows), 1), bool), second[:, 1:] != second[:, :-1], axis=1)
    row, at = np.nonzero(first)
    stop = np.append(at[1:], 0)
    last = np.append(row[1:] != row[:-1], True)
    stop[last] = count[rows][row[last]]
    rest = ~hot
    named = mix(hashes[rows][row] + U64(1)) ^ second[row, at]
    return np.concatenate([start[rest], start[rows][row] + at]), np.concatenate([count[rest], stop - at]), np.concatenate([hashes[rest], named])


def _chunks(table: pa.Table):
    """(bytes, offsets, doc ids, offset in the document) of about 2 MB; a longer document comes in overlapping parts."""
    ids = table.column("doc_id").to_numpy()
    data, off = text_bytes(table.column("text"))
    a = 0
    while a < len(ids):
        b = a + 1
        while b < len(ids) and off[b + 1] - off[a] <= _CHUNK:
            b += 1
        if off[b] - off[a] <= _CHUNK:
            yield data[off[a] : off[b]], off[a : b + 1] - off[a], ids[a:b], 0
        else:
            for c in range(off[a], max(off[b] - WINDOW + 1, off[a] + 1), _CHUNK):
                part = data[c : min(c + _CHUNK + WINDOW - 1, off[b])]
                yield part, np.array([0, len(part)]), ids[a:b], int(c - off[a])
        a = b


def _send(to: np.ndarray, source: int, arrays: list[np.ndarray]) -> tuple[list, list, list]:
    """Arrays dealt out by to, one packed value for each receiver."""
    if not len(to):
        return [], [], []
    order = np.argsort(to, kind="stable")
    ordered = to[order]
    cuts = np.flatnonzero(np.diff(ordered, prepend=-1))
    ends = [*cuts[1:], len(to)]
    return [int(ordered[a]) for a in cuts], [source] * len(cuts), [pack(*(x[order[a:b]] for x in arrays)) for a, b in zip(cuts, ends, strict=True)]


def _table(*parts: tuple[list, list, list]) -> pa.Table:
    return pa.table([sum((p[0] for p in parts), []), sum((p[1] for p in parts), []), sum((p[2] for p in parts), [])], schema=_SENT)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(key) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)


def _hashes_of(buckets: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        home = key[0].as_py()
        found, docs = [], []
        for data, off, ids, _ in _chunks(table):
            start, _, hashes = _runs(data, off)
            own = ids[np.searchsorted(off, start, "right") - 1]
            found.append(hashes)
            docs.append(own)
        if not found or not sum(map(len, found)):
            return _table()
        hashes, own = np.concatenate(found), np.concatenate(docs)
        order = np.argsort(hashes, kind="stable")
        hashes, own = hashes[order], own[order]
        at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        several = (np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)).astype(np.uint8)
        runs = np.minimum(np.diff(np.append(at, len(hashes))), 0xFFFF).astype(np.uint16)
        return _table(_send(_bucket(hashes[at], buckets), home, [hashes[at], several, runs]))

    return send


def _shared_of(hot_runs: int):
    """To each home: those of its hashes that two documents have, and whether their buckets are hot."""

    def send(table: pa.Table) -> pa.Table:
        homes, parts = table.column("source").to_pylist(), [unpack(x.as_py(), "u8", "u1", "u2") for x in table.column("payload")]
        hashes, several, runs = (np.concatenate(x) for x in zip(*parts, strict=True))
        source = np.repeat(np.array(homes, np.int32), [len(p[0]) for p in parts])
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        count = np.diff(np.append(at, len(ordered)))
        # a home sends a hash once: two senders are two documents, as a document has one home
        good = np.repeat((count > 1) | (np.maximum.reduceat(several[order], at) > 0), count)
        hot = np.repeat(np.add.reduceat(runs[order].astype(np.int64), at) > hot_runs, count).astype(np.uint8)
        return _table(_send(source[order][good], 0, [ordered[good], hot[good]]))

    return send


def _windows_of(buckets: int):
    def send(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        home = key[0].as_py()
        if not answers.num_rows or not docs.num_rows:
            return _table()
        shared, hot = (np.concatenate(x) for x in zip(*(unpack(x.as_py(), "u8", "u1") for x in answers.column("payload")), strict=True))
        order = np.argsort(shared)
        shared, hot = shared[order], hot[order] > 0
        parts: list[list[np.ndarray]] = []
        for data, off, ids, base in _chunks(docs):
            start, count, hashes = _runs(data, off)
            at = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
            keep = shared[at] == hashes
            start, count, hashes = _split(data, start[keep], count[keep], hashes[keep], hot[at[keep]])
            if not len(start):
                continue
            row = np.searchsorted(off, start, "right") - 1
            padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
            text = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[start]
            text[np.arange(WIDTH) >= (count + WINDOW - 1)[:, None]] = 0
            parts.append([hashes, ids[row], (start - off[row] + base).astype(np.int64), count.astype(np.uint8), text])
        if not parts:
            return _table()
        hashes, ids, start, count, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        # runs that are equal all through: the first document's travels, later documents' are decided here
        first, later = _equal_runs(hashes, ids, count, text)
        ranges = _ranges(ids[later], start[later], start[later] + count[later] + WINDOW - 1)
        sent = _send(_bucket(hashes[first], buckets), home, [ids[first], start[first], count[first], text[first]])
        return _table(sent, ([home % buckets], [-1 - home], [pack(*ranges)])) if len(ranges[0]) else _table(sent)

    return send


def _equal_runs(hashes: np.ndarray, ids: np.ndarray, count: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the least document of each group of equal runs, and rows of later documents. Rows of the same document are all kept as the first."""
    same = np.ascontiguousarray(text).view(f"V{WIDTH}").ravel()
    word = mix(hashes + U64(1)) * (count.astype(U64) * U64(2) + U64(1))
    for j in range(0, WIDTH - 7, 8):
        word = mix(word ^ np.ascontiguousarray(text[:, j : j + 8]).view(U64).ravel())
    word = mix(word ^ np.ascontiguousarray(text[:, WIDTH - 8 :]).view(U64).ravel())
    order = np.lexsort((ids, word))
    w, s = word[order], same[order]
    lead = np.append(True, (w[1:] != w[:-1]) | (s[1:] != s[:-1]))
    least = ids[order][np.maximum.accumulate(np.where(lead, np.arange(len(w)), 0))]
    late = ids[order] != least
    return order[~late], order[late]


def _ranges(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """(doc, start, end) by document, with ranges that touch made one."""
    if not len(ids):
        return [ids.astype(np.int64), start.astype(np.int64), end.astype(np.int64)]
    order = np.lexsort((start, ids))
    ids, start, end = ids[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    row = np.cumsum(np.append(0, ids[1:] != ids[:-1]))
    far = row * (int(end.max()) + 2)  # documents apart on one line
    reach = np.maximum.accumulate(end + far)
    lead = np.append(True, (start + far)[1:] > reach[:-1])
    at = np.flatnonzero(lead)
    return [ids[at], start[at], np.append(reach[at[1:] - 1], reach[-1]) - far[at]]


def _refined(text: np.ndarray) -> np.ndarray:
    """Bucket of each window: equal for equal 50 bytes. text: rows of 84 bytes; the result has 35 columns."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8, axis=1)
    grams = np.ascontiguousarray(view).view(U64)[..., 0]
    ids = np.unique(grams, return_inverse=True)[1].reshape(grams.shape)
    for offset in (8, 16, WINDOW - 32):
        near, later = ids[:, :-offset], ids[:, offset:]
        pair = near.astype(np.int64) * (int(ids.max()) + 1) + later
        ids = np.unique(pair, return_inverse=True)[1].reshape(pair.shape)
    return ids


def _run_keys(text: np.ndarray) -> np.ndarray:
    """The q-gram bucket of each run again: the least hash among the 16-grams of its first window."""
    keys = [np.zeros(0, U64)]
    power, inverse = powers(WINDOW)
    for a in range(0, len(text), 1 << 16):
        prefix = np.zeros((len(text[a : a + (1 << 16)]), WINDOW + 1), U64)
        np.cumsum(BYTE_VALUES[text[a : a + (1 << 16), :WINDOW]] * power[:WINDOW], axis=1, out=prefix[:, 1:])
        keys.append(mix((prefix[:, GRAM:] - prefix[:, :-GRAM]) * inverse[:RUN]).min(axis=1))
    return np.concatenate(keys)


def _refine(table: pa.Table) -> pa.Table:
    """To each home: the ranges of its documents that an earlier document has."""
    passed, parts, homes = [], [], []
    for source, payload in zip(table.column("source").to_pylist(), table.column("payload"), strict=True):
        if source < 0:
            passed.append((-1 - source, payload.as_py()))
        else:
            parts.append(unpack(payload.as_py(), "i8", "i8", "u1", f"{WIDTH}u1"))
            homes.append(source)
    done = ([h for h, _ in passed], [0] * len(passed), [p for _, p in passed])
    if not parts:
        return _table(done)
    ids, start, count, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    docs, at = np.unique(ids, return_index=True)
    home = np.repeat(np.array(homes, np.int32), [len(p[0]) for p in parts])[at]
    first, later = _equal_runs(np.zeros(len(ids), U64), ids, count, text)
    found = [(ids[later], start[later], start[later] + count[later] + WINDOW - 1)]
    ids, start, count, text = ids[first], start[first], count[first], text[first]
    keys = _run_keys(text)
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(cuts, len(keys)))
    own = ids[order]
    if len(cuts):
        mixed = np.minimum.reduceat(own, cuts) != np.maximum.reduceat(own, cuts)
    a = 0
    while a < len(cuts):  # whole q-gram buckets, some thousand runs at a time
        b, n, rows = a, 0, []
        while b < len(cuts) and (not n or n + size[b] <= 20000):
            if mixed[b]:
                rows.append(order[cuts[b] : cuts[b] + size[b]])
                n += size[b]
            b += 1
        a = b
        if not n:
            continue
        rows = np.concatenate(rows)
        bucket = _refined(text[rows])
        valid = np.arange(RUN) < count[rows][:, None]
        flat, who = bucket[valid], np.broadcast_to(ids[rows][:, None], bucket.shape)[valid]
        least = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, flat, who)
        begin = (start[rows][:, None] + np.arange(RUN))[valid]
        gone = least[flat] < who
        found.append((who[gone], begin[gone], begin[gone] + WINDOW))
    ranges = _ranges(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return _table(done, _send(home[np.searchsorted(docs, ranges[0])], 0, ranges))


def _cut(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
    """doc_id, row, n_bytes, spans, kept bytes of a home's documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("kept_text", pa.string()), ("removed", pa.list_(pa.int64()))])
    ids = docs.column("doc_id").to_numpy()
    data, off = text_bytes(docs.column("text"))
    parts = [unpack(x.as_py(), "i8", "i8", "i8") for x in answers.column("payload")]
    who, start, end = _ranges(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else [np.zeros(0, np.int64)] * 3
    out = []
    for k, d in enumerate(ids):
        a, b = np.searchsorted(who, d), np.searchsorted(who, d, "right")
        text = data[off[k] : off[k + 1]]
        keep = np.ones(len(text), bool)
        for s, e in zip(start[a:b], end[a:b], strict=True):
            keep[s:e] = False
        kept = text[keep].tobytes()
        out.append((int(d), len(text), len(text) - len(kept), int(b - a), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore"), [int(x) for pair in zip(start[a:b], end[a:b], strict=True) for x in pair]))
    return pa.table([list(x) for x in zip(*out, strict=True)] if out else [[]] * 8, schema=schema)


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, kept_text string, removed array<bigint>"


def remove_repeats(docs: DataFrame, home_bytes: int = 3 << 20, hot_runs: int = HOT) -> DataFrame:
    """Each document's bytes without those covered by a 50-byte string that also starts in a document of smaller doc_id.

    docs: doc_id, text; other columns are ignored.  Returns for each row with a
    doc_id: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, kept (the remaining bytes), kept_text (without what a cut leaves
    of a character) and removed (start and end of each run, in turn).  A null or empty
    text has no bytes; rows that repeat a doc_id are the same document for the
    comparison, and get the union of their removed ranges only where their
    texts agree, so doc_id should be a key.  A null doc_id has no place in the
    order, so such rows are left out.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    size = text_size(docs)
    homes, buckets = spread(size, home_bytes, width), spread(size, 16 << 20, width)

    home = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(homes)).cast("int")
    dealt = docs.where("doc_id is not null").select(home.alias("to"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashes = dealt.groupBy("to").applyInArrow(_hashes_of(buckets), _BLOB)
    shared = hashes.groupBy("to").applyInArrow(_shared_of(hot_runs), _BLOB)
    windows = dealt.groupBy("to").cogroup(shared.groupBy("to")).applyInArrow(_windows_of(buckets), _BLOB)
    ranges = windows.groupBy("to").applyInArrow(_refine, _BLOB)
    return dealt.groupBy("to").cogroup(ranges.groupBy("to")).applyInArrow(_cut, _RESULT)
