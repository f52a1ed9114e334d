"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by their number n of distinct shingles, in powers of two.
An item's sketch is its bottom hashes: containment of at least t leaves at most
n - ceil(t n) of its shingles out, so of its n - ceil(t n) + 1 + c smallest shingle
hashes a document that contains it holds c + 1 at least. A partition's sketch of a
document is the document's shingle hashes up to the largest hash in the
partition's items' sketches; a partition whose least item does not fit into the
document is passed over. Items with enough hashes in the document's sketch are
verified by exact containment of word shingles. So the search loses nothing, and
the more of a document a partition cannot ask for, the less is looked up.

A benchmark of bounded size is sent to the documents: one narrow stage, no shuffle.
A larger one meets them by joins on sketch hashes, behind a filter of fixed size;
either way documents are sketched once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import gram_hashes, span_hashes, spans, steps, word_hashes
from .common import OWN, materialize, released

#: A word is a maximal run of these in the lower-cased text: ASCII letters and digits, and all that is not ASCII.
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_INSIDE = np.array([bool(_WORD.match(bytes([b]))) for b in range(256)])
_JAVA_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
FILTER_BITS = 20
#: Hashes of a sketch beyond the least, so that one shared shingle alone makes no candidate.
SPARE = 2
#: Bits of the filter that is sent to documents where items are joined.
JOIN_BITS = 24


def _lower(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def shingles(raw: bytes, width: int) -> set[tuple[bytes, ...]]:
    """Word shingles of lower-cased bytes; fewer words than ``width`` are one shingle, none are none."""
    w = _WORD.findall(raw)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _hash(gram: tuple[bytes, ...]) -> int:
    raw = np.frombuffer(b" ".join(gram) + b"\0", np.uint8)
    a, b = spans(raw, _INSIDE)
    return int(gram_hashes(span_hashes(raw, a, b), len(gram))[0])


def sketch(grams: set[tuple[bytes, ...]], threshold: float) -> tuple[list[int], int, int]:
    """(sketch, hits, need) of an item: of the sketch's hashes a document that contains it has ``hits``, and ``need`` of its shingles."""
    need = max(1, math.ceil(threshold * len(grams) - 1e-9))
    hashes = sorted({_hash(g) for g in grams})
    least = len(grams) - need + 1
    own = hashes[: least + SPARE]
    # with fewer hashes than shingles (two that collide) one hit less is sure; never less than one
    return own, max(1, len(own) - (len(grams) - need) - (len(grams) - len(hashes))), need


def partition_of(n: int) -> int:
    """Size partition of an item of n shingles: 2^(k-1) < n <= 2^k."""
    return (n - 1).bit_length()


class Partition:
    """The sketches of the items of one size partition and shingle length."""

    def __init__(self) -> None:
        self.probes: dict[int, list[int]] = defaultdict(list)
        self.top, self.least = 0, 1 << 62

    def add(self, item: int, own: list[int], need: int) -> None:
        for h in own:
            self.probes[h].append(item)
        self.top, self.least = max(self.top, own[-1]), min(self.least, need)

    def close(self) -> None:
        self.probes = dict(self.probes)
        self.table = np.zeros(1 << FILTER_BITS, bool)
        self.table[(np.fromiter(self.probes, np.uint64, len(self.probes)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True


class Sketches:
    """Items by size partition, ready to be looked up."""

    def __init__(self, items: list[tuple[object, str | None]], width: int, threshold: float) -> None:
        self.width, self.items = width, []
        #: by shingle length (shorter than ``width`` for items of fewer words), then by size
        self.parts: dict[int, dict[int, Partition]] = defaultdict(lambda: defaultdict(Partition))
        for key, text in items:
            grams = shingles(_lower(text), width)
            if not grams:
                continue
            own, hits, need = sketch(grams, threshold)
            self.parts[len(next(iter(grams)))][partition_of(len(grams))].add(len(self.items), own, need)
            self.items.append((key, grams, need, hits))
        self.parts = {n: dict(x) for n, x in self.parts.items()}
        for x in self.parts.values():
            for part in x.values():
                part.close()

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, object, int, int]]:
        """(text number, item key, shared shingles, item's shingles) of every containment at or above the threshold."""
        lowered = [_lower(t) for t in texts]
        for first, grams in document_grams(lowered, list(self.parts)):
            found: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
            for n, (at, hashes, size) in grams.items():
                for part in self.parts[n].values():
                    # the partition's sketch of each document that is large enough, as far as its filter lets it through
                    pick = np.flatnonzero((hashes <= np.uint64(part.top)) & part.table[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    pick = pick[size[at[pick]] >= part.least]
                    for k, h in zip(at[pick].tolist(), hashes[pick].tolist()):
                        for item in part.probes.get(h, ()):
                            found[k][item].add(h)
            for k, hit in found.items():
                own: dict[int, set] = {}
                for c in sorted(hit):
                    key, grams_, need, hits = self.items[c]
                    if len(hit[c]) < hits:
                        continue
                    n = len(next(iter(grams_)))
                    if n not in own:
                        own[n] = document_shingles(lowered[first + k], n)
                    if len(own[n]) >= need and (shared := len(grams_ & own[n])) >= need:
                        yield first + k, key, shared, len(grams_)


def document_shingles(lowered: bytes, n: int) -> set[tuple[bytes, ...]]:
    w = _WORD.findall(lowered)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def document_grams(lowered: list[bytes], lengths: list[int]) -> Iterator[tuple[int, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(first text, {shingle length: (text of each shingle, its hash, shingles of each text)}) by runs of texts, every text whole in one run."""
    for first, raw, starts in steps(lowered):
        a, b = spans(raw, _INSIDE)
        if not len(a):
            continue
        words = word_hashes(raw, a, b)
        text_of = np.searchsorted(starts, a, "right") - 1
        out = {}
        for n in lengths:
            hashes = gram_hashes(words, n)
            inside = text_of[: len(hashes)] == text_of[n - 1 :]
            at = text_of[: len(hashes)][inside]
            out[n] = at, hashes[inside], np.bincount(at, minlength=len(starts) - 1)
        yield first, out


def contained(docs: DataFrame, benchmark: DataFrame, *, width: int = 5, threshold: float = 0.8, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): every document row that contains a benchmark item.

    Containment is the share of an item's distinct shingles that the document
    has. Null and empty texts and items without words are never part of a
    match; items of fewer than ``width`` words are one shingle of all of them;
    repeated rows give repeated results, also where ids are null; other columns
    are not read. An empty table on either side gives no rows. A benchmark of up
    to ``block_words`` words is sent to every task; a larger one is joined.
    A document and, in a task, the items sent or those that meet one document are
    held at once.
    """
    size = benchmark.agg(F.sum(F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_JAVA_WORD), F.lit(0))))).first()[0] or 0
    found = _sent(docs, benchmark, width, threshold) if size <= block_words else _joined(docs, benchmark, width, threshold)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def _sent(docs: DataFrame, benchmark: DataFrame, width: int, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, n_shared long, n_item long"
    types = spark.createDataFrame([], schema).toArrow().schema
    rows = benchmark.select("item_id", "text").collect()
    sent = spark.sparkContext.broadcast(Sketches([(r.item_id, r.text) for r in rows], width, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hits = b.column("doc_id").to_pylist(), list(sent.value.search(b.column("text").to_pylist()))
            cols = [[ids[h[0]] for h in hits], *([h[i] for h in hits] for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, types)], [f.name for f in types])

    return docs.select("doc_id", "text").mapInArrow(released(run), schema)


def _joined(docs: DataFrame, benchmark: DataFrame, width: int, threshold: float) -> DataFrame:
    """As :func:`_sent`, for a benchmark of any size: sketch hashes meet by a join, then documents meet their candidates' texts."""
    spark = docs.sparkSession
    items = materialize(benchmark.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "leaks-items")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                grams = shingles(_lower(text), width)
                if grams:
                    own, hits, need = sketch(grams, threshold)
                    n, part = len(next(iter(grams))), partition_of(len(grams))
                    out += [(item, n, part, h - (h >> 63 << 64), hits, need) for h in own]
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "n", "part", "hash", "hits", "need"])

    own = materialize(items.select("item", "text").mapInArrow(released(sketches), "item long, n long, part long, hash long, hits long, need long"), "leaks-sketches")
    # hashes are unsigned; their order is that of the signed numbers with the top bit turned
    turned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    tops = {(r.n, r.part): ((r.top + (1 << 63)), r.least) for r in own.groupBy("n", "part").agg(F.max(turned).alias("top"), F.min("need").alias("least")).collect()}
    # places count from 1, as the bitmap functions do
    place = F.shiftrightunsigned("hash", 64 - JOIN_BITS) + 1
    bits = own.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    table = np.zeros((1 << JOIN_BITS) // 8, np.uint8)
    for r in bits:
        raw = np.frombuffer(bytes(r.bits), np.uint8)
        table[(r.b - 1) * len(raw) : r.b * len(raw)] = raw
    sent = spark.sparkContext.broadcast((tops, table))
    key = [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, table = sent.value
        lengths = sorted({n for n, _ in tops})
        for b in batches:
            lowered = [_lower(t) for t in b.column("text").to_pylist()]
            for first, grams in document_grams(lowered, lengths):
                for n, (at, hashes, size) in grams.items():
                    for (m, part), (top, least) in tops.items():
                        if m != n:
                            continue
                        where = (hashes >> np.uint64(64 - JOIN_BITS)).astype(np.int64)
                        pick = np.flatnonzero((hashes <= np.uint64(top)) & (table[where >> 3] >> (where & 7).astype(np.uint8) & 1 > 0))
                        pick = pick[size[at[pick]] >= least]
                        pairs = np.unique(np.stack((at[pick].astype(np.uint64), hashes[pick]), 1), axis=0)
                        rows = pa.array(pairs[:, 0].astype(np.int64) + first)
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("mark").take(rows), pa.array(np.full(len(pairs), n)), pa.array(np.full(len(pairs), part)), pa.array(pairs[:, 1].view(np.int64))], ["doc_id", "mark", "n", "part", "hash"])

    kind = dict(docs.dtypes)["doc_id"]
    looked = docs.select(*key, "text").mapInArrow(released(asked), f"doc_id {kind}, mark long, n long, part long, hash long")
    hits = looked.join(own, ["n", "part", "hash"]).groupBy("doc_id", "mark", "item").agg(F.count_distinct("hash").alias("have"), F.first("hits").alias("hits"))
    candidates = materialize(hits.where("have >= hits").select("doc_id", "mark", "item"), "leaks-candidates")
    # of the documents those with candidates, once with the number of their copies; then, in one group with each, the items that it may contain
    known = candidates.select(F.col("doc_id").alias("d"), F.col("mark").alias("m")).distinct().hint("shuffle_hash")
    rows = docs.select(*key, "text")
    some = rows.join(known, rows["doc_id"].eqNullSafe(known["d"]) & (rows["mark"] == known["m"]), "left_semi")
    doc = some.groupBy("doc_id", "mark", "text").agg(F.count("*").alias("copies")).select("doc_id", "mark", F.lit(None).cast("long").alias("item"), "text", "copies")
    asked_items = candidates.join(items.select("item", "text"), "item").select("doc_id", "mark", "item", "text", F.lit(None).cast("long").alias("copies"))
    met = doc.unionByName(asked_items).withColumn("name", F.xxhash64("doc_id", "mark")).repartition("name").sortWithinPartitions("name", "doc_id", "mark", F.col("item").asc_nulls_first(), "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            out: list[tuple] = []
            for at, (i, m, item, text, copies) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "mark", "item", "text", "copies")))):
                if now != (i, m):
                    now, held = (i, m), []
                if item is None:
                    held.append((_lower(text), copies, {}))
                    continue
                grams = shingles(_lower(text), width)
                n, need = len(next(iter(grams))), sketch(grams, threshold)[2]
                for lowered, copies, known in held:
                    if n not in known:
                        known[n] = document_shingles(lowered, n)
                    if (shared := len(grams & known[n])) >= need:
                        out += [(at, item, shared, len(grams))] * copies
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3))], ["doc_id", "item", "n_shared", "n_item"])

    found = met.mapInArrow(released(check), f"doc_id {kind}, item long, n_shared long, n_item long")
    return found.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "n_shared", "n_item")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id no match names; rows with a null id stay."""
    leaks = contained(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


#: The same pairs in SQL, by shingle joins.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
"""
