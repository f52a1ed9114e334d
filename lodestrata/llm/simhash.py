"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position i of the 64-bit fingerprint gets a non-zero vector m(i) of
r + 1 bits. For each of the 2^(r+1) - 1 non-zero vectors v there is a table,
keyed by the fingerprint masked to the bits with odd <m(i), v>. Up to r
differing bits span at most r dimensions, so some v is orthogonal to all of
them: in that table the pair collides. No pair within the radius is missed.

A bucket never emits all its pairs. Its distinct fingerprints are linked
exactly and only a spanning star of each linked class leaves it: small buckets
compare their members, large ones meet in the middle (two fingerprints within
2k free bits share a variant within k of both), which is linear in the bucket.

Where a similarity is asked for, the classes so found are candidates only: texts
are linked if their shingle sets have that Jaccard similarity, and components are
taken over these links alone. The texts of a class meet in tasks of bounded size;
see ``_linked`` for classes that are larger.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix
from .common import OWN, materialize, released
from .graph import components

BITS = 64


def fingerprints(text: str | None, width: int = 4, seed: int = 42, count: int = 1) -> list[int]:
    """``count`` 64-bit SimHashes of ``width``-word shingles; all 0 for a text without words.

    The first is over XXH64 of the shingles, each other one over a bijection of it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * count
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((count, BITS), np.int64)
    for k in range(0, n, 1 << 15):
        cut = slice(k, min(n, k + (1 << 15)))
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[cut].tolist(), last[cut].tolist())], np.uint64)
        for t in range(count):
            own = mix(hashes + np.uint64(t * 0xA0761D6478BD642F % 2**64)) if t else hashes
            ones[t] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    return fingerprints(text, width, seed)[0]


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 4, seed: int = 42, count: int = 1) -> DataFrame:
    """All columns but ``text``, plus ``fingerprint``, a signed 64-bit integer (and ``more``, an array, for a ``count`` over 1)."""
    own = ["fingerprint", "more"][: 1 + (count > 1)]
    rest = [c for c in docs.columns if c not in (text, *own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprints(t, width, seed, count) for t in b.column(text).to_pylist()], np.uint64).reshape(-1, count).view(np.int64)
            cols = [pa.array(values[:, 0])] + ([pa.array(list(values[:, 1:]), pa.list_(pa.int64()))] if count > 1 else [])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *cols], [*rest, *own])

    schema = docs.select(*rest).withColumns({"fingerprint": F.lit(0).cast("long"), "more": F.array(F.lit(0).cast("long"))}).select(*rest, *own).schema
    return docs.select(*rest, text).mapInArrow(released(run), schema)


def masks(radius: int) -> list[int]:
    """The covering masks, one per non-zero vector of radius + 1 bits, as unsigned integers."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each one's class, for links a-b among n items."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (again := root[root]) is not None and (again != root).any():
            root = again
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def link_bucket(fps: np.ndarray, mask: int, radius: int, *, compare: int = 3000, variants: int = 500_000) -> np.ndarray:
    """Class roots (indices) of distinct fingerprints that agree on ``mask``, linked at ``radius`` or fewer bits."""
    n = len(fps)
    root = np.arange(n)
    if n <= compare:
        for i in range(0, n, 256):
            near = np.bitwise_count(fps[i : i + 256, None] ^ fps[None, :]) <= radius
            a, b = np.nonzero(near)
            root = _stars(n, np.concatenate((root, a + i)), np.concatenate((np.arange(n), b)))
        return root
    free = [np.uint64(1 << i) for i in range(BITS) if not mask >> i & 1]
    near, far = (radius + 1) // 2, radius // 2
    flips = [[np.bitwise_or.reduce(np.array(c, np.uint64)) if c else np.uint64(0) for k in range(d + 1) for c in itertools.combinations(free, k)] for d in (near, far)]
    rounds = max(1, -(-n * len(flips[0]) // variants))
    for r in range(rounds):
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for side in flips[: 1 + (near != far)]:
            keys, ids = [], []
            for f in side:
                v = fps ^ f
                pick = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(rounds) == np.uint64(r)
                keys.append(v[pick])
                ids.append(np.nonzero(pick)[0])
            found.append((np.concatenate(keys), np.concatenate(ids)))
        keys, ids = (np.concatenate([f[i] for f in found]) for i in (0, 1)) if near != far else found[0]
        if near != far:
            # a variant within ``near`` of one and within ``far`` of the other links the two
            side = np.repeat([0, 1], [len(found[0][0]), len(found[1][0])])
            order = np.lexsort((1 - side, keys))
            keys, ids, side = keys[order], ids[order], side[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            lead = np.repeat(first, np.diff(np.append(first, len(keys))))
            use = side[lead] == 1
            a, b = ids[lead][use], ids[use]
        else:
            order = np.argsort(keys, kind="stable")
            keys, ids = keys[order], ids[order]
            same = keys[1:] == keys[:-1]
            a, b = ids[:-1][same], ids[1:][same]
        root = _stars(n, np.concatenate((root, a)), np.concatenate((np.arange(n), b)))
    return root


def _bucket_edges(batches: Iterator[pa.RecordBatch], table_masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning stars of the buckets in rows (table, fingerprint[, node]) sorted by table, key and node, between the rows' nodes."""
    by_table = np.array(table_masks, np.uint64)

    def whole(t: np.ndarray, k: np.ndarray, f: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(f)))
        group = np.repeat(np.arange(len(first)), size)
        # every row of a class points to the class's first row, which has its smallest node
        pair_a, pair_b = [], []
        small = size[group] <= 32
        for s in range(1, min(32, int(size.max(initial=1)))):
            i = np.flatnonzero((group[s:] == group[:-s]) & small[s:])
            i = i[np.bitwise_count(f[i + s] ^ f[i]) <= radius]
            pair_a.append(i + s)
            pair_b.append(i)
        for g in np.flatnonzero(size > 32):
            at = np.arange(first[g], first[g] + size[g])
            one, lead, where = np.unique(f[at], return_index=True, return_inverse=True)
            root = link_bucket(one, table_masks[t[first[g]] % len(table_masks)], radius)
            low = np.full(len(one), len(at))
            np.minimum.at(low, root, lead)
            pair_a.append(at)
            pair_b.append(at[low[root[where]]])
        if not pair_a:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        root = _stars(len(f), *map(np.concatenate, (pair_a, pair_b)))
        a, b = node, node[root]
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        t, f, *node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(f):
            continue
        k = f.view(np.uint64) & by_table[t % len(by_table)]
        rows = t, k, f.view(np.uint64), (node[0] if node else f)
        end = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1]))
        if held and (t[0] != held[-1][0][-1] or k[0] != held[-1][1][-1]):
            yield whole(*(np.concatenate(x) for x in zip(*held)))
            held = []
        cut = 0
        if len(end):
            cut = int(end[-1]) + 1
            held.append(tuple(x[:cut] for x in rows))
            yield whole(*(np.concatenate(x) for x in zip(*held)))
            held = []
        held.append(tuple(x[cut:] for x in rows))
    if held:
        yield whole(*(np.concatenate(x) for x in zip(*held)))


def link(prints: DataFrame, radius: int = 4, node: str | None = None) -> DataFrame:
    """Edges (a > b) between nodes, enough to connect all that are linked: some i-th values of ``fingerprint`` and ``more`` within ``radius`` bits.

    Nodes are the column ``node``, an integer, or the fingerprints themselves. A row of
    a table holds its number, the value and the node; the bucket's key follows from these.
    """
    ms = masks(radius)
    values = F.array("fingerprint") if "more" not in prints.columns else F.concat(F.array("fingerprint"), "more")
    # a plain column of the values and one of table numbers: the plan does not grow with the tables
    every = prints.select(values.alias("v"), *([node] if node else [])).withColumn("t", F.explode(F.sequence(F.lit(0), F.size("v") * len(ms) - 1)))
    own = [node] if node else []
    rows = every.select("t", F.get("v", F.expr(f"cast(t div {len(ms)} as int)")).alias("f"), *own)
    key = F.col("f").bitwiseAND(F.get(F.array(*(F.lit(_signed(m)) for m in ms)), F.expr(f"cast(t % {len(ms)} as int)")))
    dealt = rows.repartition(F.col("t"), key).sortWithinPartitions(F.col("t"), key, F.col(node or "f"))
    return dealt.mapInArrow(released(lambda it: _bucket_edges(it, ms, radius)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", *, width: int = 4, radius: int = 4, seed: int = 42, count: int = 1) -> DataFrame:
    """(id, fingerprint, component_id) for every row; ``component_id`` is the smallest id reachable over links.

    With a ``count`` over 1, documents are also linked by further fingerprints
    over other hashes of the same shingles: each finds, by itself, every pair
    within the radius, and together they reach pairs that are less similar.
    Null and empty texts have fingerprint zero and link like any other; rows
    with a null id stay and count for no smallest id; repeated rows stay. An
    empty table gives no rows; other columns are not read.
    """
    own = materialize(with_fingerprint(docs.select(id, text), text, width, seed, count), "simhash")
    prints = [c for c in own.columns if c != id]
    distinct = own.groupBy(*prints).agg(F.min(id).alias("low"))
    if count == 1:
        distinct = materialize(distinct, "simhash-distinct")
        label = components(link(distinct, radius)).withColumnRenamed("node", "fingerprint")
        named = distinct.join(label, "fingerprint", "left").select("fingerprint", "low", F.coalesce("label", "fingerprint").alias("label"))
    else:
        distinct = materialize(distinct.withColumn("uid", F.monotonically_increasing_id()), "simhash-distinct")
        label = components(link(distinct, radius, "uid")).withColumnRenamed("node", "uid")
        named = distinct.join(label, "uid", "left").select(*prints, "low", F.coalesce("label", "uid").alias("label"))
    named = materialize(named, "simhash-classes")
    lowest = materialize(named.groupBy("label").agg(F.min("low").alias("component_id")), "simhash-lowest")
    classes = materialize(named.join(lowest, "label").select(*prints, "component_id"), "simhash-components")
    return own.join(classes, prints).select(id, "fingerprint", "component_id")


def shingle_hashes(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 of ``width``-word shingles, sorted; fewer words are one shingle, none are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + width]), seed) for i in range(n)], np.uint64))


def similar_classes(sets: list[np.ndarray], similarity: float, start: list[int] | None = None, asked: np.ndarray | None = None) -> list[int]:
    """The smallest index of each one's class, for links between sets of at least this Jaccard similarity; empty sets are equal.

    Two such sets share one of the n - ceil(similarity n) + 1 rarest members of
    each, so no link is missed; sets already in one class are not compared.
    ``start`` names one in the class of each that is known to be in it; with
    ``asked``, only pairs with a marked set are compared.
    """
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def unite(x: int, y: int) -> None:
        low, high = sorted((find(x), find(y)))
        root[high] = low

    for i, j in enumerate(start or ()):
        unite(i, j)
    sizes = np.array([len(x) for x in sets], np.int64)
    one, of, times = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    place = np.empty(len(one), np.int64)
    place[np.argsort(times, kind="stable")] = np.arange(len(one))
    members = [np.sort(x) for x in np.split(place[of], np.cumsum(sizes)[:-1])]
    mine = np.zeros(len(one), bool)
    #: by rare member, those that hold it: all, and those that are asked for
    holders: tuple[dict[int, list[int]], dict[int, list[int]]] = defaultdict(list), defaultdict(list)
    empty = None
    for i, (x, n) in enumerate(zip(members, sizes.tolist())):
        if not n:
            empty = i if empty is None else empty
            unite(empty, i)
            continue
        rare = x[: n - math.ceil(similarity * n - 1e-9) + 1].tolist()
        wanted = asked is None or bool(asked[i])
        known = holders[not wanted]
        met = set().union(*(known[r] for r in rare if r in known))
        for r in rare:
            holders[0][r].append(i)
            if wanted and asked is not None:
                holders[1][r].append(i)
        apart: dict[int, list[int]] = defaultdict(list)
        mine_root = find(i)
        for j in met:
            if min(n, sizes[j]) >= similarity * max(n, sizes[j]) - 1e-9 and (r := find(j)) != mine_root:
                apart[r].append(j)
        mine[x] = True
        step = 1
        while apart:
            # a few of each class at a time: the first that is near spares the rest of its class
            tried = [j for js in apart.values() for j in js[:step]]
            for k in range(0, len(tried), 256):
                some = tried[k : k + 256]
                size = sizes[some]
                shared = np.add.reduceat(mine[np.concatenate([members[j] for j in some])].astype(np.int64), np.cumsum(size) - size)
                for j in np.flatnonzero(shared >= similarity * (n + size - shared) - 1e-9).tolist():
                    unite(i, some[j])
            apart = {r: js[step:] for r, js in apart.items() if len(js) > step and find(r) != find(i)}
            step *= 4
        mine[x] = False
    return [find(i) for i in range(len(sets))]


#: Texts, and bytes of text, that one task links at once.
GROUP_TEXTS, GROUP_BYTES = 4096, 16_000_000


def _grouped_links(batches: Iterator[pa.RecordBatch], similarity: float, width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(uid, root) of every row (group, uid, start, asked, text), sorted by group and rank: the first of its class in the group."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        first: dict[int, int] = {}
        start = [first.setdefault(r[1], i) for i, r in enumerate(rows)]
        found = similar_classes([r[3] for r in rows], similarity, start, np.array([r[2] for r in rows], bool)) if len(rows) > 1 else [0]
        return [(r[0], rows[i][0]) for r, i in zip(rows, found)]

    def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["uid", "root"])

    now, held = None, []
    for b in batches:
        for group, uid, start, asked, text in zip(*b.columns):
            if (group := group.as_py()) != now:
                if held:
                    yield batch(links(held))
                now, held = group, []
            held.append((uid.as_py(), start.as_py(), asked.as_py(), shingle_hashes(text.as_py(), width, seed)))
    if held:
        yield batch(links(held))


def _linked(rows: DataFrame, texts: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """(uid, label) of each of ``rows`` (uid, class, low, size), whose ``texts`` (with text besides) are read in groups: one label for all of a class that links connect.

    The texts of a class meet in groups of bounded size. Where a class is one group,
    that is all. Else the largest sets of each group are linked by their first texts;
    every text outside the largest set that then is of the class meets every text of
    the class, in pairs of a block of such texts with a group. So no link between
    two texts is left out, and a class that mostly is one set, as groups of copies
    are, costs two passes over its texts.
    """
    sizes = rows.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    groups = F.greatest(F.ceil(F.col("n") / GROUP_TEXTS), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int")
    sizes = materialize(sizes.select("class", groups.alias("groups")), "simhash-sizes")
    order = ["low", "uid"]

    def links(rows: DataFrame, group: list[str]) -> DataFrame:
        """``rows`` have start and asked; groups are told apart by a number made of the columns ``group``."""
        name = F.struct(*group)
        met = rows.withColumn("name", name).repartition("name").sortWithinPartitions("name", *order)
        return met.select(F.to_json("name").alias("name"), "uid", "start", "asked", "text").mapInArrow(released(lambda it: _grouped_links(it, similarity, shingle, seed)), "uid long, root long")

    part = F.pmod(F.xxhash64("uid"), F.col("groups")).cast("int")
    asked = texts.join(sizes.hint("shuffle_hash"), "class").withColumn("part", part)
    alone = asked.withColumn("start", F.col("uid")).withColumn("asked", F.lit(True))
    first = materialize(links(alone, ["class", "part"]), "simhash-linked")
    if sizes.where("groups > 1").limit(1).count() == 0:
        return first.withColumnRenamed("root", "label")
    large = materialize(asked.where("groups > 1").join(first, "uid"), "simhash-large")
    # the largest set of each group, named by its first text; sets of these by class
    sets = large.groupBy("class", "part", "root").count().groupBy("class", "part").agg(F.max_by("root", F.struct("count", "root")).alias("uid"))
    heads = large.join(sets.select("class", "uid"), ["class", "uid"])
    bunch = F.pmod(F.xxhash64("uid"), F.ceil(F.col("groups") / GROUP_TEXTS)).cast("int")
    heads = heads.withColumn("part", bunch).withColumn("start", F.col("uid")).withColumn("asked", F.lit(True))
    second = materialize(links(heads, ["class", "part"]), "simhash-heads")
    merged = large.join(second.select(F.col("uid").alias("root"), F.col("root").alias("head")), "root", "left").withColumn("start", F.coalesce("head", "root")).drop("head")
    merged = materialize(merged, "simhash-merged")
    main = merged.groupBy("class", "start").count().groupBy("class").agg(F.max_by("start", F.struct("count", "start")).alias("main"))
    outside = merged.join(main, "class").where("start <> main").groupBy("class").agg(F.greatest(F.ceil(F.count("*") / GROUP_TEXTS), F.ceil(F.sum("size") / GROUP_BYTES)).cast("int").alias("blocks"), F.first("main").alias("main"))
    outside = materialize(outside, "simhash-outside")
    both = merged.join(outside, "class").withColumn("asked", F.col("start") != F.col("main")).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks")).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = both.withColumn("asked", F.lit(False)).withColumn("block", every("blocks"))
    there = both.where("asked").withColumn("part", every("groups"))
    # a text that lies in both, as an asked one and as one of the group, is united with itself
    third = materialize(links(here.unionByName(there), ["class", "part", "block"]), "simhash-outside-linked")
    edges = merged.select(F.col("uid").alias("a"), F.col("start").alias("b")).union(third.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    label = components(edges.where("a <> b")).withColumnRenamed("node", "uid")
    whole = merged.select("uid", "start").join(label, "uid", "left").select("uid", F.coalesce("label", "uid").alias("label"))
    return first.join(large.select("uid"), "uid", "left_anti").select("uid", F.col("root").alias("label")).union(whole)


def one_similar_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", *, similarity: float = 0.8, shingle: int = 5, width: int = 4, radius: int = 4, seed: int = 42, count: int = 1) -> DataFrame:
    """The first row, by id, of each class of texts that are linked by a Jaccard similarity of ``shingle``-word shingles.

    Candidates come from the fingerprints, as in ``near_duplicates``; each link is
    confirmed on the texts' own shingle sets (by 64-bit hashes), so rows that only
    look alike by their fingerprints all stay. Rows are told apart by id and text:
    rows that share an id and differ in text are different; equal rows become one.
    A null id cannot stand for a class: such rows all stay. Null and empty texts
    are one class; of texts with one smallest id, one stays. All columns stay.
    """
    mark = f"{OWN}digest"
    known = docs.where(F.col(id).isNotNull())
    marked = known.withColumn(mark, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    own = materialize(with_fingerprint(marked.select(id, mark, text, F.coalesce(F.octet_length(text), F.lit(0)).alias("size")), text, width, seed, count), "simhash")
    rest = [c for c in own.columns if c not in (id, mark)]
    texts = own.groupBy(mark).agg(F.min(id).alias("low"), *(F.first(c).alias(c) for c in rest)).withColumn("uid", F.monotonically_increasing_id())
    texts = materialize(texts, "simhash-texts")
    label = components(link(texts, radius, "uid"))
    # joins of texts by id and digest are by shuffle at every size
    asked = materialize(texts.select("uid", "low", mark, "size").join(label.select(F.col("node").alias("uid"), F.col("label").alias("class")), "uid"), "simhash-asked")
    rows = asked.withColumn(id, F.col("low")).hint("shuffle_hash")
    met = marked.select(id, mark, text).join(rows, [id, mark]).dropDuplicates([id, mark]).select("uid", "class", "low", "size", F.col(text).alias("text"))
    linked = materialize(_linked(asked, met, similarity, shingle, seed), "simhash-linked")
    ranked = linked.join(texts.select("uid", "low", mark), "uid")
    kept = ranked.groupBy("label").agg(F.min(F.struct("low", "uid")).alias("first"))
    gone = materialize(ranked.join(kept, "label").where("uid <> first.uid").select(mark), "simhash-gone")
    keep = materialize(texts.join(gone, mark, "left_anti").select(F.col("low").alias(id), mark), "simhash-kept")
    one = marked.join(keep.hint("shuffle_hash"), [id, mark], "left_semi").dropDuplicates([id, mark]).select(*docs.columns)
    return one.union(docs.where(F.col(id).isNull()))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their class by fingerprints, once each.

    All columns stay. A null id cannot stand for a class: such rows all stay. Rows
    that share an id count as one; :func:`one_similar_of_each` tells them apart by text.
    """
    found = near_duplicates(docs.where(F.col(id).isNotNull()), id, text, **options)
    keep = materialize(found.where(F.col(id) == F.col("component_id")).select(id).distinct(), "simhash-kept")
    one = docs.join(keep, id, "left_semi").select(*docs.columns).dropDuplicates([id])
    return one.union(docs.where(F.col(id).isNull()))
