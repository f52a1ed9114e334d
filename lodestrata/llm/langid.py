"""Language identification by a linear-chain conditional random field over words.

A word's features are its character n-grams with markers at both ends (the ones
that touch a marker are its affixes) and its whole form (the lexicon), hashed
into weight tables. Learned transitions tie neighbouring words, and
forward-backward gives every word its posterior over languages; a document's
language is the one with the largest share of its words.

Texts of a batch form one chain of words in which a text's first word starts
afresh, and forward-backward runs over blocks of that chain at once: products
of transition matrices carry the messages from block to block, exactly. A long
chain is taken by segments: forward to find the message that enters each, then
backward with the message that leaves it, so that a text needs the same memory
however long it is (beside its bytes and its words' places).

The model is trained on sentences of labelled documents joined into
code-switched sequences, so that transitions see both staying and switching.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix, slices, span_hashes, spans, steps
from .common import crc_mod, released

UNKNOWN = "und"
#: Words are runs of ASCII letters and non-ASCII bytes in the lower-cased text.
_INSIDE = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
#: Bits of the tables of 2-, 3-, 4-byte grams and of whole words.
_BITS = (16, 16, 17, 18)
_BLOCK = 64
#: Words of a segment, a multiple of _BLOCK; texts that are taken together mostly have fewer.
SEGMENT = 1 << 19


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def rows_of(raw: np.ndarray) -> list[np.ndarray]:
    """For each byte, the table row of the 2-, 3- and 4-byte gram that starts there; bytes outside words are the marker."""
    c = np.where(_INSIDE[raw], raw, 0).astype(np.uint32)
    c = np.concatenate((c, np.zeros(4, np.uint32)))
    n = len(raw)
    two = c[:n] << np.uint32(8) | c[1 : n + 1]
    three = two * np.uint32(0x9E3779B1) + c[2 : n + 2] * np.uint32(0x85EBCA6B)
    four = three * np.uint32(0xC2B2AE35) + c[3 : n + 3] * np.uint32(0x27D4EB2F)
    return [(two & np.uint32(0xFFFF)).astype(np.int64), ((three ^ three >> np.uint32(15)) >> np.uint32(16)).astype(np.int64), ((four ^ four >> np.uint32(13)) >> np.uint32(15)).astype(np.int64)]


@dataclass
class Words:
    """Word spans of some texts, with the table rows of their features."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    rows: list[np.ndarray]
    whole: np.ndarray

    @classmethod
    def parts(cls, raw: np.ndarray, text_starts: np.ndarray, some: slice | None = None) -> Iterator[Words]:
        """The words (or a run of them) in order, by slices of bounded size."""
        starts, ends = spans(raw, _INSIDE)
        if some is not None:
            starts, ends = starts[some], ends[some]
        for part in slices(starts, ends):
            a, b = starts[part], ends[part]
            low = max(0, int(a[0]) - 1)
            own = raw[low : int(b[-1]) + 4]
            whole = (mix(span_hashes(own, a - low, b - low)) >> np.uint64(64 - _BITS[3])).astype(np.int64)
            yield cls(a - low, b - low, np.searchsorted(text_starts, a, "right") - 1, rows_of(own), whole)

    @classmethod
    def of(cls, raw: np.ndarray, text_starts: np.ndarray) -> Words:
        """All words of a short run of texts that has some."""
        return next(cls.parts(raw, text_starts))

    def gram_spans(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 places of the n-byte grams of each word, from the marker before it; at least one."""
        first = np.maximum(self.starts - 1, 0)
        return first, np.maximum(self.ends + 1 - n + 1, first + 1)


class Model:
    """Weights of features (tables), of transitions (from, to) and of the first word."""

    def __init__(self, labels: list[str]) -> None:
        k = max(1, len(labels))
        self.labels = labels
        self.tables = [np.zeros((1 << b, k), np.float32) for b in _BITS]
        self.transition = np.zeros((k, k))
        self.first = np.zeros(k)

    def emissions(self, words: Words) -> np.ndarray:
        """Summed feature weights of every word, by label."""
        out = self.tables[3][words.whole].astype(np.float64)
        for n, rows, table in zip((2, 3, 4), words.rows, self.tables):
            total = np.empty((len(rows) + 1, table.shape[1]))
            total[0] = 0
            np.cumsum(table[rows], axis=0, dtype=np.float64, out=total[1:])
            a, b = words.gram_spans(n)
            out += total[np.minimum(b, len(rows))] - total[a]
        return out

    def marginals(self, emission: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Posterior of every word of one chain; ``fresh`` marks words that start a text."""
        return forward_backward(emission, fresh, self.transition, self.first)

    def shares(self, raw: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Summed posteriors of every text's words, text by text."""
        starts, _ = spans(raw, _INSIDE)
        text = np.searchsorted(text_starts, starts, "right") - 1
        fresh = np.concatenate(([True], text[1:] != text[:-1]))[: len(text)]
        share = np.zeros((len(text_starts) - 1, len(self.first)))
        cuts = [slice(a, min(len(text), a + SEGMENT)) for a in range(0, len(text), SEGMENT)]

        def emission(cut: slice) -> np.ndarray:
            return np.concatenate([self.emissions(w) for w in Words.parts(raw, text_starts, cut)])

        def add(cut: slice, p: np.ndarray) -> None:
            bounds = np.flatnonzero(np.concatenate(([True], text[cut][1:] != text[cut][:-1])))
            np.add.at(share, text[cut][bounds], np.add.reduceat(p, bounds))

        if len(cuts) == 1:
            add(cuts[0], self.marginals(emission(cuts[0]), fresh))
            return share
        enters, now = [], None
        for cut in cuts:
            enters.append(now)
            _, now, _ = messages(emission(cut), fresh[cut], self.transition, self.first, enter=now)
        leave = None
        for cut, enter in zip(reversed(cuts), reversed(enters)):
            p, _, leave = messages(emission(cut), fresh[cut], self.transition, self.first, enter=enter, leave=leave)
            add(cut, p)
        return share


def forward_backward(emission: np.ndarray, fresh: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posteriors by exact messages, block by block side by side."""
    return messages(emission, fresh, transition, first)[0]


def messages(emission: np.ndarray, fresh: np.ndarray, transition: np.ndarray, first: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, message after the last word, message before the first) of a chain, or of a segment between two messages.

    A segment that others follow is a whole number of blocks.
    """
    n, k = emission.shape
    if not n:
        return emission, enter, leave
    came, goes = enter, leave
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    t, s = np.exp(transition - transition.max()), np.exp(first - first.max())
    blocks = -(-n // _BLOCK)
    size = blocks * _BLOCK
    e = np.concatenate((e, np.ones((size - n, k)))).reshape(blocks, _BLOCK, k)
    f = np.concatenate((fresh, np.ones(size - n, bool))).reshape(blocks, _BLOCK)
    if came is None:
        f[0, 0] = True
    start = np.ones((k, 1)) * s  # whatever came before, a fresh word begins as if first

    def step(i: int) -> np.ndarray:
        return np.where(f[:, i, None, None], start, t) * e[:, i, None, :]

    # product of the steps of each block, then the message that enters each block
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(_BLOCK):
        product = product @ step(i)
        product /= product.sum(axis=(1, 2), keepdims=True)
    enter = np.empty((blocks, k))
    leave = np.empty((blocks, k))
    now = np.full(k, 1.0 / k) if came is None else came
    for b in range(blocks):
        enter[b] = now
        now = now @ product[b]
        now /= now.sum()
    after = now
    now = np.ones(k) if goes is None else goes
    for b in range(blocks - 1, -1, -1):
        leave[b] = now
        now = product[b] @ now
        now /= now.sum()
    before = now
    alpha = np.empty((blocks, _BLOCK, k))
    now = enter
    for i in range(_BLOCK):
        now = np.where(f[:, i, None], s, now @ t) * e[:, i]
        now /= now.sum(axis=1, keepdims=True)
        alpha[:, i] = now
    now = leave
    for i in range(_BLOCK - 1, -1, -1):
        alpha[:, i] *= now
        ahead = e[:, i] * now
        now = np.where(f[:, i, None], (ahead * s).sum(axis=1, keepdims=True), ahead @ t.T)
        now /= now.sum(axis=1, keepdims=True)
    p = alpha.reshape(size, k)[:n]
    return p / p.sum(axis=1, keepdims=True), after, before


def _pair_marginals(emission: np.ndarray, fresh: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected transition counts over texts of bounded length, by a plain forward and backward pass side by side."""
    k = emission.shape[1]
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    t, s = np.exp(transition - transition.max()), np.exp(first - first.max())
    bounds = np.flatnonzero(fresh)
    length = np.diff(np.append(bounds, len(e)))
    width = int(length.max())
    at = np.minimum(bounds[:, None] + np.arange(width), len(e) - 1)
    live = np.arange(width) < length[:, None]
    grid = np.where(live[:, :, None], e[at], 1.0)
    alpha = np.empty_like(grid)
    now = s * grid[:, 0]
    alpha[:, 0] = now = now / now.sum(axis=1, keepdims=True)
    for i in range(1, width):
        now = (now @ t) * grid[:, i]
        alpha[:, i] = now = now / now.sum(axis=1, keepdims=True)
    total = np.zeros((k, k))
    back = np.ones((len(bounds), k))
    for i in range(width - 1, 0, -1):
        ahead = np.where(live[:, i, None], grid[:, i] * back, 1.0)
        pair = alpha[:, i - 1, :, None] * t * ahead[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        total += pair[live[:, i]].sum(axis=0)
        back = np.where(live[:, i, None], ahead @ t.T, back)
        back /= back.sum(axis=1, keepdims=True)
    return total


def train(rows: list[tuple[str | None, str]], *, sequences: int = 3000, segment: tuple[int, int] = (3, 40), epochs: int = 4, batch: int = 100, rate: float = 0.08, seed: int = 0) -> Model:
    """Conditional maximum likelihood by stochastic gradient (Adagrad) on code-switched sequences.

    ``rows`` are (text, language); a sequence joins one to four runs of words
    from documents of random languages. No rows give a model that knows none.
    """
    rng = np.random.default_rng(seed)
    labels = sorted({y for _, y in rows})
    model = Model(labels)
    split = re.compile(rb"[a-z\x80-\xff]+")
    pool: dict[str, list[list[bytes]]] = {}
    for t, y in rows:
        w = split.findall(lowered(t))
        if w:
            pool.setdefault(y, []).append(w)
    known = sorted(pool)
    if not known:
        return model
    place = {y: i for i, y in enumerate(labels)}
    chains: list[tuple[bytes, np.ndarray]] = []
    for _ in range(sequences):
        words: list[bytes] = []
        truth: list[int] = []
        for _ in range(int(rng.integers(1, 5))):
            y = known[rng.integers(len(known))]
            doc = pool[y][rng.integers(len(pool[y]))]
            n = int(rng.integers(*segment))
            a = int(rng.integers(max(1, len(doc) - n + 1)))
            words += doc[a : a + n]
            truth += [place[y]] * len(doc[a : a + n])
        chains.append((b" ".join(words), np.array(truth)))
    k = len(labels)
    squares = [np.full(t.shape, 1e-6, np.float32) for t in model.tables]
    square_t, square_f = np.full((k, k), 1e-6), np.full(k, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for a in range(0, len(order), batch):
            part = [chains[i] for i in order[a : a + batch]]
            raws = [b" " + c[0] for c in part]
            starts = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
            words = Words.of(np.frombuffer(b"\0".join(raws) + b"\0", np.uint8), starts)
            truth = np.concatenate([c[1] for c in part])
            fresh = np.concatenate(([True], words.text[1:] != words.text[:-1]))
            emission = model.emissions(words)
            p = model.marginals(emission, fresh)
            grad = p.copy()
            grad[np.arange(len(truth)), truth] -= 1
            expected = _pair_marginals(emission, fresh, model.transition, model.first)
            seen = np.zeros((k, k))
            inner = ~fresh[1:]
            np.add.at(seen, (truth[:-1][inner], truth[1:][inner]), 1)
            g = (expected - seen) / len(truth) * 20 + 1e-4 * model.transition
            square_t += g * g
            model.transition -= rate * g / np.sqrt(square_t)
            g = (p[fresh].sum(axis=0) - np.bincount(truth[fresh], minlength=k)) / len(part)
            square_f += g * g
            model.first -= rate * g / np.sqrt(square_f)
            for n, rows_n, table, square in zip((2, 3, 4, 0), [*words.rows, None], model.tables, squares):
                if n:
                    s, e = words.gram_spans(n)
                    count = e - s
                    of = np.repeat(np.arange(len(s)), count)
                    at = np.repeat(s - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(of))
                    index = rows_n[np.minimum(at, len(rows_n) - 1)]
                else:
                    of, index = np.arange(len(truth)), words.whole
                touched, where = np.unique(index, return_inverse=True)
                g = np.stack([np.bincount(where, grad[of, j], len(touched)) for j in range(k)], 1).astype(np.float32)
                square[touched] += g * g
                table[touched] -= np.float32(rate) * g / np.sqrt(square[touched])
    return model


def fit(docs: DataFrame, *, per_language: int = 400, most_chars: int = 200_000, test_remainder: int | None = 2, **options) -> Model:
    """Train on at most ``per_language`` documents of each language, picked by a hash of the id, and on ``most_chars`` characters of each.

    Documents whose crc32(id as text) mod 4 is ``test_remainder`` are left out,
    and so are null languages and texts. Rows that are picked twice count twice;
    the sample is in order of id and text, so that equal tables give equal models.
    """
    from pyspark.sql import Window

    usable = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and lang <> 'und'")
    if test_remainder is not None:
        usable = usable.where(crc_mod("doc_id", 4) != test_remainder)
    # a hash threshold first, so that the ranking sees few rows; then the exact bound
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train([])
    share = F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, min(1.0, 1.5 * per_language / n))])
    some = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("rank") <= per_language)
    rows = ranked.select("doc_id", F.substring("text", 1, most_chars).alias("text"), "lang").collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id if r.doc_id is not None else 0, r.text, r.lang))
    return train([(r.text, r.lang) for r in rows], **options)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 where it is null or has no letter."""
    # a leading space, so that a text's first word has its marker wherever the text stands
    low = [b" " + lowered(t) for t in texts]
    k = len(model.labels)
    share = np.zeros((len(texts), max(1, k)))
    for first, raw, starts in steps(low):
        if k and _INSIDE[raw].any():
            share[first : first + len(starts) - 1] = model.shares(raw, starts)
    total = share.sum(axis=1)
    best = share.argmax(axis=1)
    score = share[np.arange(len(texts)), best] / np.maximum(total, 1e-300)
    names = [model.labels[j] if n > 0 and any(map(str.isalpha, t)) else UNKNOWN for j, n, t in zip(best, total, texts)] if k else [UNKNOWN] * len(texts)
    return names, np.where([x == UNKNOWN for x in names], 0.0, score)


def label_words(model: Model, text: str | None) -> list[tuple[str, str]]:
    """Every word of a text, lower-cased, with its most probable language."""
    raw = np.frombuffer(b" " + lowered(text) + b"\0", np.uint8)
    emission = [model.emissions(w) for w in Words.parts(raw, np.array([0, len(raw)]))] if model.labels else []
    if not emission:
        return []
    starts, ends = spans(raw, _INSIDE)
    best = model.marginals(np.concatenate(emission), np.arange(len(starts)) == 0).argmax(axis=1)
    return [(raw[a:b].tobytes().decode("utf-8", "replace"), model.labels[j]) for a, b, j in zip(starts, ends, best)]


def with_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but ``text``, plus ``lang_pred`` and ``score`` (0 to 1), for every row.

    A null or empty text, or one without a letter, is ``und`` with score 0, and so is
    every text where the model knows no language. Of languages with equal shares the
    first by name is taken; repeated rows have equal results. Columns that are named
    like the results are replaced, all others stay; an empty table gives no rows.
    """
    own = ("lang_pred", "score")
    rest = [c for c in docs.columns if c not in (text, *own)]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = predict(sent.value, b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(names, pa.string()), pa.array(score)], [*rest, *own])

    return docs.select(*rest, text).mapInArrow(released(run), docs.select(*rest).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)
