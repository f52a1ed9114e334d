"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

A byte goes if some window of ``depth`` bytes over it also starts in a document
with a smaller id. That is a question about suffixes ordered through ``depth``
bytes only: groups equal to that depth are the repeated windows.

The first, most significant digit is dealt over the cluster: of the k-byte
grams in a window, the one with the smallest hash (40 bits of it) names the
window's bucket, so equal windows meet, and neighbouring windows mostly share
it and travel as one string. In a bucket, passes over eight bytes at a time
refine the order, and a group is dropped as soon as it holds one document only.
Whole travelling strings are ordered first; equal ones are one string from
there on, owned by their smallest document. Only windows of different strings
under one digit are then ordered one by one.

What repeats inside one task is resolved there: of equal strings the smallest
document's alone is dealt. So copies of a document, or a passage that a third of
all documents share, arrive once per task, not once per document.

Strings are dealt in two rounds. The first sends only their digits and places,
a few bytes each; what one document has alone ends there. Only the strings whose
digit two documents have are then cut from their texts and sent in full.

A digit that very many strings have (a common phrase in ever other surroundings) is
split by the next pass of the radix order before it is dealt: the gram with the
bytes before it names a bucket for windows that begin well before the gram, the
gram with the bytes after it one for the others. Of the strings that share a digit
within one task, two go to the first round, to tell all others.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .common import materialize, released

GRAM = 20
#: Text bytes whose strings leave a task together; text bytes of a bucket; window starts of a long text that are taken at once.
FLUSH, BUCKET, SEGMENT = 16_000_000, 4_000_000, 4_000_000
#: Strings of one digit in one flush, and in one bucket, from which on the digit is split; partitions at most.
HOT_FLUSH, HOT_BUCKET, PARTITIONS = 64, 20_000, 20_000
NO_ID = 2**63 - 1
_VALUE_BITS = 40
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _weights() -> np.ndarray:
    return bytewords._power_tables(1 << 16)[0][:GRAM]


def gram_values(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 40-bit values of the grams that start at ``at``."""
    up, total = _weights(), np.zeros(len(at), np.uint64)
    for i in range(GRAM):
        total += bytewords._VALUE[raw[at + i]] * up[i]
    return bytewords.mix(total) >> np.uint64(64 - _VALUE_BITS)


def wide_values(raw: np.ndarray, at: np.ndarray, wide: int, right: np.ndarray) -> np.ndarray:
    """The 40-bit values of the ``wide`` bytes from ``at``, apart by side."""
    up, total = bytewords._power_tables(1 << 16)[0], right.astype(np.uint64) * _MULT
    for i in range(wide):
        total += bytewords._VALUE[raw[at + i]] * up[i]
    return bytewords.mix(bytewords.mix(total)) >> np.uint64(64 - _VALUE_BITS)


def split(raw: np.ndarray, start: np.ndarray, length: np.ndarray, value: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(string, start, length, place, right): runs of windows whose first gram of the string's value lies at one place, on one side.

    ``place`` counts from the run's start and is that of the bytes that name the run: the gram with those before it, or (``right``) after it.
    """
    beside = (depth - GRAM) // 2
    at, of = flat(start, length - GRAM + 1), np.repeat(np.arange(len(start)), length - GRAM + 1)
    hit = np.flatnonzero(gram_values(raw, at) == value[of])
    # the strings are told apart by adding room between them
    room = int(length.max(initial=0)) + 1
    marks = (at - start[of])[hit] + of[hit] * room
    w, w_of = flat(np.zeros(len(start), np.int64), length - depth + 1), np.repeat(np.arange(len(start)), length - depth + 1)
    gram = marks[np.searchsorted(marks, w + w_of * room)] - w_of * room
    right = gram - w < beside
    place = np.where(right, gram, gram - beside)
    new = np.concatenate(([True], (w_of[1:] != w_of[:-1]) | (place[1:] != place[:-1]) | (right[1:] != right[:-1])))[: len(w)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(w)) - 1
    return w_of[first], w[first], w[last[: len(first)]] - w[first] + depth, place[first] - w[first], right[first]


def strings_of(raw: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, value, place): maximal runs of windows in one text whose smallest gram value is the same, as byte spans.

    ``place`` is where a gram of that value first starts, counted from the span's start.

    ``raw`` holds the texts, each ended by one more byte; ``starts`` has their starts and the end.
    """
    empty = np.empty(0, np.int64)
    n = len(raw)
    if n < depth:
        return empty, empty, empty.astype(np.uint64), empty
    up, down = bytewords._power_tables(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(bytewords._VALUE[raw] * up[:n], dtype=np.uint64)))
    grams = low = bytewords.mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]) >> np.uint64(64 - _VALUE_BITS)
    del sums
    span, have = depth - GRAM + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    ends = starts[1:] - 1
    valid = np.zeros(len(low) + 1, np.int8)
    fits = ends - starts[:-1] >= depth
    np.add.at(valid, starts[:-1][fits], 1)
    np.add.at(valid, ends[fits] - depth + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    new = valid.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    value = low[first]
    place = np.zeros(len(first), np.int64)
    todo = np.arange(len(first))
    for i in range(span):
        todo = todo[grams[first[todo] + i] != value[todo]]
        if not len(todo):
            break
        place[todo] = i + 1
    return first, np.flatnonzero(stop) + depth, value, place


def flat(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of all spans, one after the other."""
    if not len(start):
        return np.empty(0, np.int64)
    out = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    out += np.arange(len(out))
    return out


def digits(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; zeros follow the end."""
    d = np.concatenate((raw, np.zeros(16, np.uint8))).astype(np.uint64)
    for shift in (1, 2, 4):
        d[:-shift] = (d[:-shift] << np.uint64(8 * shift)) | d[shift:]
    return d


def refine(order: np.ndarray, group: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: items ``order`` (in groups) sorted by group and ``key``; groups of one document are dropped."""
    by = np.lexsort((key, group))
    order, group, key = order[by], group[by], key[by]
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))[: len(order)]
    first = np.flatnonzero(new)
    if not len(first):
        return order, group
    d = doc[order]
    several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    named = np.cumsum(new) - 1
    keep = several[named]
    return order[keep], named[keep]


def lowest_owner(raw: np.ndarray, start: np.ndarray, length: np.ndarray, value: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of windows of other documents' strings: (string number, window's start) repeated in a smaller document.

    First come whole strings: returned windows cover them. Each array pair entry is a
    span start and its end.
    """
    order, group = refine(np.arange(len(start)), np.zeros(len(start), np.int64), value, doc)
    if not len(order):
        return np.empty((0, 2), np.int64), np.empty(0, np.int64)
    d8 = digits(raw)
    spans, owner_of = [], []
    # equal whole strings: by length, then eight bytes at a time
    o, g = refine(order, group, length[order], doc)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while len(o):
        ended = length[o] <= at
        if ended.any():
            done.append((o[ended], g[ended]))
            o, g = o[~ended], g[~ended]
            if not len(o):
                break
        o, g = refine(o, g, d8[start[o] + at] >> (np.uint64(8) * np.maximum(0, 8 - (length[o] - at)).astype(np.uint64)), doc)
        at += 8
    copy = np.zeros(len(start), bool)
    for o, g in done:
        by = np.lexsort((doc[o], g))
        o, g = o[by], g[by]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        least = np.repeat(doc[o][first], np.diff(np.append(first, len(o))))
        covered = o[doc[o] > least]
        copy[covered] = True
        spans.append(np.stack((start[covered], start[covered] + length[covered]), 1))
        owner_of.append(covered)
    # windows of what is left, one by one
    rest = ~copy[order]
    order, group = order[rest], group[rest]
    order, group = refine(order, group, np.zeros(len(order), np.uint64), doc)
    if len(order):
        count = length[order] - depth + 1
        at_byte, of = flat(start[order], count), np.repeat(order, count)
        wdoc = doc[of]
        w, g = np.arange(len(of)), np.repeat(group, count)
        for k in range(0, depth, 8):
            if not len(w):
                break
            w, g = refine(w, g, d8[at_byte[w] + k] >> np.uint64(8 * max(0, 8 - (depth - k))), wdoc)
        if len(w):
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            least = np.repeat(np.minimum.reduceat(wdoc[w], first), np.diff(np.append(first, len(w))))
            hit = np.sort(w[wdoc[w] > least])
            if len(hit):
                cut = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])))
                a = hit[cut]
                b = hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
                spans.append(np.stack((at_byte[a], at_byte[b] + depth), 1))
                owner_of.append(of[a])
    if not spans:
        return np.empty((0, 2), np.int64), np.empty(0, np.int64)
    return np.concatenate(spans), np.concatenate(owner_of)


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts))


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = struct.unpack_from(f"<{len(types)}q", data), 8 * len(types), []
    for n, t in zip(sizes, types):
        out.append(np.frombuffer(data, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


def _deal(texts: list[bytes], ids: np.ndarray, keys: np.ndarray, bases: np.ndarray, depth: int, buckets: int, many_here: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, blob) of one flush: kind 0 holds strings, kind 1 spans that are resolved already, kind 2 strings whose digit is known to be shared. ``bases``: where each text starts in its document."""
    part = []
    base = 0
    raws = []
    for first, raw, starts in bytewords.steps(texts):
        s, e, v, p = strings_of(raw, starts, depth)
        t = np.searchsorted(starts, s, "right") - 1
        h = bytewords.span_hashes(raw, s, e)
        part.append((s + base, e - s, v, t + first, s - starts[t] + bases[t + first], h, p))
        raws.append(raw)
        base += len(raw)
    if not part:
        return
    start, length, value, text, offset, h, place = (np.concatenate(x) for x in zip(*part))
    raw = np.concatenate(raws)
    doc = ids[text]
    # equal strings of this flush: all but the smallest document's are covered whole
    by = np.lexsort((doc, h))
    same = np.concatenate(([False], (h[by][1:] == h[by][:-1]) & (length[by][1:] == length[by][:-1])))
    lead = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))] if len(by) else by
    later = np.flatnonzero(same & (doc[by] > doc[lead]))
    me, rep = by[later], lead[later]
    if len(me):
        equal = np.logical_and.reduceat(raw[flat(start[me], length[me])] == raw[flat(start[rep], length[rep])], np.concatenate(([0], np.cumsum(length[me])[:-1])))
        me = me[equal]
        order = np.lexsort((offset[me], text[me]))
        m = me[order]
        a, b = offset[m], offset[m] + length[m]
        cut = np.concatenate(([True], (text[m][1:] != text[m][:-1]) | (a[1:] > b[:-1])))
        f = np.flatnonzero(cut)
        ends = np.maximum.reduceat(b, f)
        yield int(xxhash.xxh32_intdigest(struct.pack("<qq", int(ids[0]), len(texts)))) % buckets, 1, _pack(ids[text[m][f]], keys[text[m][f]], a[f], ends)
    travels = np.ones(len(start), bool)
    travels[me] = False
    x = np.flatnonzero(travels)
    hot = np.zeros(len(start), bool)
    if len(x):
        # of a digit that many strings here have, the first and the last document's go on for all
        by = x[np.lexsort((doc[x], value[x]))]
        first = np.flatnonzero(np.concatenate(([True], value[by][1:] != value[by][:-1])))
        last = np.append(first[1:], len(by)) - 1
        many = (last - first >= many_here - 1) & (doc[by[first]] != doc[by[last]])
        hot[by[np.repeat(many, last - first + 1)]] = True
        known = hot.copy()
        known[by[first]] = known[by[last]] = False
        travels &= ~known
        x = np.flatnonzero(known)
        if len(x):
            yield int(xxhash.xxh32_intdigest(struct.pack("<qq", int(ids[-1]), len(texts)))) % buckets, 2, _pack(doc[x], keys[text[x]].astype("<u4"), offset[x].astype("<i4"), length[x].astype("<i4"), place[x].astype("u1"))
    for b, x in _by_bucket(np.flatnonzero(travels), value, buckets):
        docs, local = np.unique(text[x], return_inverse=True)
        yield b, 0, _pack(np.diff(ids[docs], prepend=np.int64(0)), keys[docs].astype("<u4"), np.diff(local, prepend=0).astype("<i4"), offset[x].astype("<i4"), length[x].astype("<i4"), place[x].astype("u1"), (value[x] & np.uint64(0xFFFFFFFF)).astype("<u4"), hot[x].astype("u1"))


def _by_bucket(items: np.ndarray, value: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its items) by the 40-bit digits of all items."""
    bucket = ((value[items] * _MULT) >> np.uint64(20)).astype(np.int64) % buckets
    order = np.lexsort((items, bucket))
    items, bucket = items[order], bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(items)]
    for a, b in zip(edges, np.append(edges[1:], len(items))):
        yield int(bucket[a]), items[a:b]


def _several(blobs: list[bytes], many: int) -> tuple[np.ndarray, ...]:
    """(id, key, offset, length, place and 256 if the digit is to be split) of the strings whose digit more than one document has."""
    parts = []
    for blob in blobs:
        d, k, local, off, n, place, value, hot = _unpack(blob, "<i8", "<u4", "<i4", "<i4", "<i4", "u1", "<u4", "u1")
        local = np.cumsum(local)
        parts.append((np.cumsum(d)[local], k[local], off, n, place, value, hot))
    doc, key, offset, length, place, value, hot = (np.concatenate(x) for x in zip(*parts))
    order, group = refine(np.arange(len(doc)), np.zeros(len(doc), np.int64), value, doc)
    times = np.bincount(group, minlength=1)
    wide = (times >= many) | (np.bincount(group, weights=hot[order], minlength=1) > 0)
    place = place.astype(np.int64)
    place[order] += 256 * wide[group]
    order = np.sort(order)
    return doc[order], key[order], offset[order], length[order], place[order]


#: Marks in a place's byte: the digit is the next pass's, and its bytes are after the gram.
_WIDE, _RIGHT = 128, 64


def _strings(texts: list[np.ndarray], ids: np.ndarray, keys: np.ndarray, places: list[tuple[np.ndarray, ...]], buckets: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of the named strings of some texts, in full."""
    count = [len(p[0]) for p in places]
    text = np.repeat(np.arange(len(texts)), count)
    offset, length, place = (np.concatenate(x) for x in zip(*places))
    raw = np.concatenate(texts)
    base = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
    hot = np.flatnonzero(place >= 256)
    place = place % 256
    value = gram_values(raw, base[text] + offset + place)
    if len(hot):
        start = base[text[hot]] + offset[hot]
        of, at, n, p, right = split(raw, start, length[hot], value[hot], depth)
        new = wide_values(raw, start[of] + at + p, GRAM + (depth - GRAM) // 2, right)
        cool = np.ones(len(text), bool)
        cool[hot] = False
        more = (text[hot[of]], offset[hot[of]] + at, n, p | _WIDE | np.where(right, _RIGHT, 0), new)
        text, offset, length, place, value = (np.concatenate((a[cool], b)) for a, b in zip((text, offset, length, place, value), more))
    start = base[text] + offset
    for b, x in _by_bucket(np.arange(len(text)), value, buckets):
        x = x[np.lexsort((offset[x], text[x]))]
        docs, local = np.unique(text[x], return_inverse=True)
        yield b, _pack(ids[docs], keys[docs].astype("<u4"), np.diff(local, prepend=0).astype("<i4"), offset[x].astype("<i4"), length[x].astype("<i4"), place[x].astype("u1"), raw[flat(start[x], length[x])])


def _resolve(blobs: list[bytes], depth: int) -> tuple[np.ndarray, ...]:
    """(id, key, start, end) of the covered spans in one bucket."""
    ids, keys, offsets, lengths, places, raws = [], [], [], [], [], []
    for blob in blobs:
        d, k, local, off, n, place, raw = _unpack(blob, "<i8", "<u4", "<i4", "<i4", "<i4", "u1", "u1")
        local = np.cumsum(local)
        ids.append(d[local])
        keys.append(k[local].astype(np.int64))
        offsets.append(off.astype(np.int64))
        lengths.append(n.astype(np.int64))
        places.append(place)
        raws.append(raw)
    doc, key, offset, length, place = map(np.concatenate, (ids, keys, offsets, lengths, places))
    place = place.astype(np.int64)
    raw = np.concatenate(raws)
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    value = np.zeros(len(start), np.uint64)
    wide = place >= _WIDE
    value[~wide] = gram_values(raw, start[~wide] + place[~wide])
    value[wide] = wide_values(raw, start[wide] + place[wide] % _RIGHT, GRAM + (depth - GRAM) // 2, place[wide] & _RIGHT > 0)
    found, of = lowest_owner(raw, start, length, value, doc, depth)
    shift = (offset - start)[of]
    return doc[of], key[of], found[:, 0] + shift, found[:, 1] + shift


def partitions(docs: DataFrame) -> tuple[int, int]:
    """(partitions, buckets) in proportion to the text; tasks take their buckets one by one, so that partitions may be bounded."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(PARTITIONS, -(-size // (4 * BUCKET))))
    return parts, max(4 * parts, -(-size // BUCKET))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of each bucket, from rows sorted by bucket."""
    now, blobs = None, []
    for b in batches:
        for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
            if bucket != now and blobs:
                yield blobs
                blobs = []
            now = bucket
            blobs.append(blob)
    if blobs:
        yield blobs


def _columns(arrays: tuple[np.ndarray, ...], names: list[str]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(arrays[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000].astype(np.int64)) for c in arrays], names)


def _first_round(docs: DataFrame, depth: int, parts: int, buckets: int) -> DataFrame:
    """(doc_id, key, kind, x, y, z): strings to send in full (kind 0: offset, length, place and 256 if the digit is split), covered spans (kind 1: start, end)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        ids: list[tuple[int, int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, kind, blob in _deal(texts, *np.array(ids, np.int64).T, depth, buckets, HOT_FLUSH):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "kind", "blob"])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if t is None or len(t) * 4 < depth:
                    continue
                raw = t.encode("utf-8", "surrogatepass")
                key = xxhash.xxh64_intdigest(raw, 42) & 0xFFFFFFFF
                # segments of a long text overlap so that each window starts in one of them
                for at in range(0, len(raw) - depth + 1, SEGMENT):
                    texts.append(raw[at : at + SEGMENT + depth - 1])
                    ids.append((i, key, at))
                    held += len(texts[-1])
                    if held >= FLUSH:
                        yield from flush()
                        texts, ids, held = [], [], 0
        if texts:
            yield from flush()

    names = ["doc_id", "key", "kind", "x", "y", "z"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolved: list[bytes] = []
        shared: list[bytes] = []

        def digits_only() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kind = np.array(b.column("kind").to_numpy())
                for k, held in ((1, resolved), (2, shared)):
                    held.extend(b.column("blob").filter(pa.array(kind == k)).to_pylist())
                yield b.filter(pa.array(kind == 0))

        for blobs in _grouped(digits_only()):
            doc, key, offset, length, place = _several(blobs, HOT_BUCKET)
            yield from _columns((doc, key, np.zeros(len(doc)), offset, length, place), names)
        for blob in shared:
            doc, key, offset, length, place = _unpack(blob, "<i8", "<u4", "<i4", "<i4", "u1")
            yield from _columns((doc, key, np.zeros(len(doc)), offset, length, place + np.int64(256)), names)
        for blob in resolved:
            doc, key, start, end = _unpack(blob, "<i8", "<i8", "<i8", "<i8")
            yield from _columns((doc, key, np.ones(len(doc)), start, end, np.zeros(len(doc))), names)

    dealt = docs.select("doc_id", "text").mapInArrow(released(deal), "bucket long, kind int, blob binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(released(meet), ", ".join(f"{c} long" for c in names))


def remove_repeats(docs: DataFrame, depth: int = 50, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; ``kept`` is the remaining bytes, or null.

    Documents are ordered by id; rows with the same id remove nothing from one
    another, a null id counts as larger than any. Null texts are empty, texts
    shorter than ``depth`` bytes stay whole, repeated rows give repeated results.
    ``depth`` is at least GRAM bytes and at most 200.
    """
    if not GRAM <= depth <= 200:
        raise ValueError("depth out of range")
    parts, buckets = partitions(docs)
    key = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), key.alias("key"), F.col("doc_id").isNull().alias("no"), "text")
    found = materialize(_first_round(own, depth, parts, buckets), "suffixes")
    # both joins below read one and the same exchange of the texts
    met = own.repartition(parts, "doc_id", "key")
    wanted = found.where("kind = 0").repartition(parts, "doc_id", "key").groupBy("doc_id", "key").agg(F.collect_list(F.struct("x", "y", "z")).alias("at"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[np.ndarray] = []
        ids, keys, places, seen = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, blob in _strings(texts, np.array(ids, np.int64), np.array(keys, np.int64), places, buckets, depth):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "blob"])

        last = None
        for b in batches:
            at = b.column("at")
            for i, (doc, k, t) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist())):
                if (doc, k) == last:  # a repeated row
                    continue
                last = doc, k
                texts.append(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))
                ids.append(doc)
                keys.append(k)
                items = at[i].values
                # a repeated row was dealt twice
                x = np.unique(np.stack([items.field(f).to_numpy(zero_copy_only=False) for f in ("x", "y", "z")], 1), axis=0)
                places.append((x[:, 0], x[:, 1], x[:, 2]))
                seen += len(t)
                if seen >= FLUSH:
                    yield from flush()
                    texts, ids, keys, places, seen = [], [], [], [], 0
        if texts:
            yield from flush()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _grouped(batches):
            yield from _columns(_resolve(blobs, depth), ["doc_id", "key", "x", "y"])

    sent = met.join(wanted.hint("shuffle_hash"), ["doc_id", "key"]).select("doc_id", "key", "no", "text", "at").mapInArrow(released(send), "bucket long, blob binary")
    late = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(released(resolve), "doc_id long, key long, x long, y long")
    spans = late.union(found.where("kind = 1").select("doc_id", "key", "x", "y"))
    covered = spans.repartition(parts, "doc_id", "key").groupBy("doc_id", "key").agg(F.collect_list(F.struct("x", "y")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = b.column("at"), []
            for i, (doc, no, t) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "no", "text")))):
                raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
                gone, n_spans, data = 0, 0, raw.tobytes()
                if at[i].is_valid:
                    delta = np.zeros(len(raw) + 1, np.int32)
                    for f, v in (("x", 1), ("y", -1)):
                        np.add.at(delta, at[i].values.field(f).to_numpy(zero_copy_only=False), v)
                    hit = np.cumsum(delta[:-1]) > 0
                    gone = int(hit.sum())
                    n_spans = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
                    data = raw[~hit].tobytes()
                out.append((None if no else doc, len(raw), gone, n_spans, hashlib.sha256(data).hexdigest(), data if keep_bytes else None))
            cols = list(zip(*out)) if out else [()] * 6
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    last = met.join(covered.hint("shuffle_hash"), ["doc_id", "key"], "left").select("doc_id", "key", "no", "text", "at")
    return last.mapInArrow(released(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
