"""Mixture-controlled packing of token sequences.

Deficit round-robin over source queues: in round k every source may have sent
k times its quantum (its target share of a window); it sends whole documents
while it is behind that, and what the last one sends beyond it is carried as a
deficit into the rounds that follow. With one running token count per source
this has a closed form: a document leaves in round floor(c / quantum), c being
the tokens before it in its queue. So the schedule is a few prefix sums over
small rows (id, source, token count), each in groups of bounded size, and
deficits cross windows and partitions exactly. Sequences are then cut from the
one stream that the rounds form; only the last one can be short.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, released

#: Rows of one group of a prefix sum, and rounds of one block.
CHUNK, BLOCK = 4096, 65536
#: Bytes of a batch that are taken at once, characters of a long text that are encoded at once, rows of pieces that leave together.
STEP, PIECE, ROWS = 1_000_000, 200_000, 20_000
#: No token lies across the end of this letter: a space before a letter opens one.
_SEAM = re.compile("[A-Za-z](?= [A-Za-z])")
#: Texts of these characters alone are cut alike by both libraries; all others take the first.
_PLAIN = re.compile("[^\t\n\r -~¡-ɏ‐-‧€]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to arrays of ids, equal to ``tokenizers`` on the file at ``path``.

    Where the same vocabulary lies beside it as ranks, plain texts go through
    ``tiktoken``, which gives the same ids in a quarter of the time.
    """
    import base64
    import json
    import os

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    ranks_path = re.sub(r"\.json$", ".tiktoken", path)
    specials = [t.content for t in slow.get_added_tokens_decoder().values()]
    fast = None
    if ranks_path != path and os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if fast is None or _PLAIN.search(text) or any(s in text for s in specials):
            return slow.encode(text, add_special_tokens=False).ids
        return fast(text)

    # cutting before a space is free only where both libraries split there: byte-level splitting, no normalizer
    pre = json.loads(slow.to_str())
    apart = pre.get("normalizer") is None and pre["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

    def ids(text: str) -> np.ndarray:
        own = "<u2" if slow.get_vocab_size() <= 65536 else "<u4"
        if not apart or len(text) <= PIECE:
            return np.array(encode(text), own)
        return np.concatenate([np.array(encode(t), own) for t in pieces(text)])

    return ids


def pieces(text: str) -> Iterator[str]:
    """Parts of a long text, cut before a space between two ASCII letters, where no token can lie across.

    A part has about PIECE characters, more only where the text has no such place.
    """
    at = 0
    while at < len(text):
        m = _SEAM.search(text, at + PIECE)
        end = m.start() + 1 if m else len(text)
        yield text[at:end]
        at = end


def by_size(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of values of about STEP bytes together, so that what is held does not grow with a batch."""
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, int(ends[first]) + STEP, "right")) - 1)
        yield first, last
        first = last


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """(uid, doc_id, source, n, ids): ids as little-endian unsigned integers (16 bits where the vocabulary fits), ``end_id`` last; uid numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = b.column("text")
            for first, last in by_size(texts):
                raw, n = [], []
                for t in texts.slice(first, last - first):
                    own = encode(t.as_py() or "")
                    own = np.append(own, np.array(end_id, own.dtype if end_id < 65536 else "<u4"))
                    raw.append(own.tobytes())
                    n.append(len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + len(n))), *(b.column(c).slice(first, last - first) for c in ("doc_id", "source")), pa.array(n, pa.int64()), pa.array(raw, pa.binary())],
                    ["uid", "doc_id", "source", "n", "ids"],
                )
                at += len(n)

    return docs.select("doc_id", "source", "text").mapInArrow(released(run), "uid long, doc_id long, source string, n long, ids binary")


def schedule(counts: DataFrame, window: int = 1024, mixture: dict[str, float] | None = None) -> DataFrame:
    """(uid, n, g): the place of each document's first token in the packed stream, from rows (uid, source, n).

    ``mixture`` has target shares by source; by default each source's share of
    all tokens, so that the queues end together. Sources it does not name, and
    null, keep that default.
    """
    src, chunk = F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no")), F.expr(f"uid div {CHUNK}")
    c = counts.select("uid", "n", src.alias("q"), chunk.alias("chunk"))
    sums = materialize(c.groupBy("q", "chunk").agg(F.sum("n").alias("chunk_n")), "packing-chunks")
    total = sums.agg(F.sum("chunk_n")).first()[0] or 0
    before = lambda w, col: F.sum(col).over(w) - F.col(col)
    in_q = Window.partitionBy("q")
    share = F.col("q_n") / F.lit(float(max(total, 1)))
    if mixture:
        named = F.create_map(*[F.lit(x) for kv in mixture.items() for x in kv])
        share = F.coalesce(F.when(~F.col("q.no"), F.try_element_at(named, F.col("q.s"))).cast("double"), share)
    # chunks in groups of CHUNK: a window holds one group of one queue, and of a whole queue its groups' totals only
    sums = sums.withColumn("group", F.expr(f"chunk div {CHUNK}"))
    groups = sums.groupBy("q", "group").agg(F.sum("chunk_n").alias("group_n")).withColumn("group_at", before(in_q.orderBy("group"), "group_n")).withColumn("q_n", F.sum("group_n").over(in_q))
    groups = groups.select("q", "group", "group_at", (F.lit(float(window)) * share).alias("quantum"))
    sums = sums.join(groups, ["q", "group"]).withColumn("chunk_at", F.col("group_at") + before(Window.partitionBy("q", "group").orderBy("chunk"), "chunk_n"))
    sums = materialize(sums.select("q", "chunk", "chunk_at", "quantum"), "packing-quanta")
    placed = c.join(sums, ["q", "chunk"]).withColumn("c", F.col("chunk_at") + before(Window.partitionBy("q", "chunk").orderBy("uid"), "n"))
    rounds = materialize(placed.select("uid", "n", "q", "c", F.floor(F.col("c") / F.col("quantum")).cast("long").alias("round")), "packing-rounds")
    totals = materialize(rounds.groupBy("round").agg(F.sum("n").alias("round_n")).withColumn("block", F.expr(f"round div {BLOCK}")), "packing-totals")
    blocks = totals.groupBy("block").agg(F.sum("round_n").alias("block_n")).withColumn("block_at", before(Window.orderBy("block"), "block_n")).select("block", "block_at")
    starts = totals.join(blocks, "block").withColumn("round_at", F.col("block_at") + before(Window.partitionBy("block").orderBy("round"), "round_n")).select("round", "round_at")
    in_round = Window.partitionBy("round").orderBy("q", "c", "uid")
    return rounds.join(starts, "round").withColumn("g", F.col("round_at") + before(in_round, "n")).select("uid", "n", "g")


def cut(rows: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The pieces of rows (doc_id, ids, n, g); a document's ids are taken one sequence at a time."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    for b in rows:
        for doc, raw, n, g in zip(*(b.column(c) for c in ("doc_id", "ids", "n", "g"))):
            doc, n, g = doc.as_py(), n.as_py(), g.as_py()
            raw = raw.as_buffer()
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
            at = 0
            while at < n:
                seq, off = divmod(g + at, length)
                k = min(n - at, length - off)
                out.append((doc, at, k, zlib.crc32(ids[at : at + k].astype("<u4").tobytes()), n, seq, off))
                at += k
                if len(out) >= ROWS:
                    yield batch()
    yield batch()


def pack(docs: DataFrame, *, vocabulary: str | None = None, length: int = 1024, window: int | None = None, mixture: dict[str, float] | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row lies in exactly one piece, a null or empty text is
    its end id alone, repeated rows are packed as often as they come, a null id
    stays null, and a null source is a queue of its own. All sequences but the
    last are full. An empty table has no pieces; other columns than doc_id,
    source and text are not read. A text is held whole, its ids as two or four
    bytes each; batches are taken in steps of bounded size.
    """
    tokens = materialize(tokenize(docs, vocabulary or default_vocabulary(), end_id), "packing-tokens")
    places = materialize(schedule(tokens.select("uid", "source", "n"), window or length, mixture), "packing-places")
    # the places of a partition are a small part of its tokens: they are hashed, and the tokens need no sort
    joined = tokens.select("uid", "doc_id", "ids").join(places.hint("shuffle_hash"), "uid").select("doc_id", "ids", "n", "g")
    return joined.mapInArrow(released(lambda it: cut(it, length)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
