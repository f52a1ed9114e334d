"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

The kernel of two words is the gap-weighted subsequence kernel: all common
subsequences of three characters, each weighted down by the length it spans in
either word, normalised to 1 for equal words. So an insult with a character
put in, left out or replaced stays close to itself. A document meets a landmark
word with the largest kernel of any of its words, above a floor; the landmarks'
own kernel matrix, to the power -1/2, turns these into Nyström features, on
which a linear machine with squared hinge loss is trained.

Landmarks are words that labelled toxic documents have and clean ones lack.
Documents are scored where they are: one narrow stage. A word is evaluated once
per task, and only against landmarks that it can reach at all: the norm of the
landmark's subsequences over the letters they share bounds the kernel.

A word longer than LONGEST characters is a set of overlapping pieces, of which the
nearest counts, as the nearest word does in a document: every run of LONGEST / 2
characters lies in one piece, so none is cut off. Over words the kernel is positive
definite; a document's largest kernel, and its power SHARP, are features made of
kernels, and no kernel of documents themselves.
"""

from __future__ import annotations

import itertools
import math
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, released

#: Length of subsequences, decay by character, floor of the normalised kernel, power of its second scale, longest piece of a word.
ORDER, DECAY, FLOOR, SHARP, LONGEST = 3, 0.6, 0.5, 6, 24
_STRIP = re.compile(r"[\W_]+")
#: Four or more single characters in a row, with one separator between each.
_SPELLED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")
_SENTENCE = re.compile(r"[.!?\n]+")
#: Words that are screened together, words of one kernel call.
BLOCK, CALL = 40_000, 4000
#: Words kept with their features by one worker, and what they are kept for.
CACHE = 1_000_000
_kept: tuple[str, dict] = ("", {})


def kept_for(key: str) -> dict:
    """The worker's word cache of one model; another model's is dropped."""
    global _kept
    if _kept[0] != key:
        _kept = (key, {})
    return _kept[1]


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unnormalised kernels of the words in the columns of ``a`` and ``b`` (code points, zeros below the end), pair by pair; one column of ``b`` serves all."""
    n, m, k = len(a), len(b), a.shape[1]
    match = ((a[:, None, :] == b[None, :, :]) & (a[:, None, :] > 0)).astype(np.float32) * np.float32(DECAY * DECAY)
    decay = np.float32(DECAY)
    tail = np.ones((n, m, k), np.float32)
    for _ in range(ORDER - 1):
        # tail[i, j]: weight of shorter subsequences that lie before characters i and j
        longer = np.zeros_like(tail)
        for i in range(n - 1):
            run = np.zeros(k, np.float32)
            for j in range(m - 1):
                run *= decay
                run += match[i, j] * tail[i, j]
                np.multiply(longer[i, j + 1], decay, out=longer[i + 1, j + 1])
                longer[i + 1, j + 1] += run
        tail = longer
    return np.einsum("ijk,ijk->k", match, tail)


def pad(words: list[str]) -> np.ndarray:
    """Code points, a word in each column."""
    out = np.zeros((max(map(len, words), default=1), len(words)), np.int32)
    for i, w in enumerate(words):
        out[: len(w), i] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def normal(word: str) -> str:
    """Letters and digits alone."""
    return _STRIP.sub("", word)


def pieces(word: str) -> list[str]:
    """A long word as overlapping parts of LONGEST characters, so that none is cut off."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words, and words spelled out with separators."""
    low = (text or "").lower()
    out = set(low.split())
    out.update(m.group() for m in _SPELLED.finditer(low))
    return out


class Landmarks:
    """Landmark words; evaluates words against them."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.codes = pad(words)
        self.norms = subsequence_kernel(self.codes, self.codes)
        # by landmark: its letters; for each set of them the share of its norm that they can make; its subsequences and their shares
        self.letters, self.reach, self.shares = [], [], []
        for w, norm in zip(words, self.norms):
            c = [ord(x) for x in w]
            letters = sorted(set(c))
            weight: dict[tuple, float] = {}
            for at in itertools.combinations(range(len(c)), ORDER):
                u = tuple(letters.index(c[i]) for i in at)
                weight[u] = weight.get(u, 0.0) + DECAY ** (at[-1] - at[0] + 1)
            table = np.zeros(1 << min(12, len(letters)))
            for u, v in weight.items():
                table[sum(1 << x for x in set(u) if x < 12)] += v * v
            for k in range(min(12, len(letters))):
                bit = (np.arange(len(table)) >> k & 1).astype(bool)
                table[bit] += table[np.flatnonzero(bit) ^ (1 << k)]
            least = FLOOR * FLOOR * 0.999
            self.letters.append(letters)
            self.reach.append(table / norm > least)
            self.shares.append((np.array(list(weight)).T, np.array([v * v for v in weight.values()], np.float32) / np.float32(norm * least)))

    def features(self, words: list[str]) -> dict[int, np.ndarray]:
        """By word number, the kernels above the floor, as a vector over landmarks; words without any are left out."""
        out: dict[int, np.ndarray] = {}
        parts = [(i, p) for i, w in enumerate(words) for p in pieces(normal(w)) if len(p) >= ORDER]
        parts.sort(key=lambda x: len(x[1]))
        for a in range(0, len(parts), BLOCK):
            block = parts[a : a + BLOCK]
            codes = pad([p for _, p in block])
            first, last, has = {}, {}, {}
            for x in {y for ls in self.letters for y in ls}:
                is_x = codes == x
                has[x] = is_x.any(axis=0)
                first[x] = np.where(has[x], is_x.argmax(axis=0), len(codes)).astype(np.int8)
                last[x] = np.where(has[x], len(codes) - 1 - is_x[::-1].argmax(axis=0), -1).astype(np.int8)
                has[x] = has[x].astype(np.int16)
            reached: list[tuple[int, np.ndarray]] = []
            for j, letters in enumerate(self.letters):
                index = np.zeros(len(block), np.int16)
                for k, x in enumerate(letters[:12]):
                    index += has[x] << k
                near = np.flatnonzero(self.reach[j][index])
                if len(near):
                    # subsequences whose characters can follow one another in the word at all
                    fi, la = (np.stack([side[x][near] for x in letters]) for side in (first, last))
                    follows = fi[:, None] < la[None]
                    u, share = self.shares[j]
                    can = follows[u[0], u[1]]
                    for k in range(1, ORDER - 1):
                        can &= follows[u[k], u[k + 1]]
                    near = near[share @ can.astype(np.float32) > 1]
                if len(near):
                    reached.append((j, near))
            norms = np.zeros(len(block), np.float32)
            some = np.unique(np.concatenate([near for _, near in reached])) if reached else ()
            for b in range(0, len(some), CALL):
                own = codes[:, some[b : b + CALL]]
                norms[some[b : b + CALL]] = subsequence_kernel(own, own)
            for j, near in reached:
                mark = self.codes[: len(self.words[j]), j : j + 1]
                cross = np.concatenate([subsequence_kernel(codes[:, near[b : b + CALL]], mark) for b in range(0, len(near), CALL)])
                value = cross / np.sqrt(norms[near] * self.norms[j])
                for i, v in zip(near[value > FLOOR].tolist(), value[value > FLOOR].tolist()):
                    found = out.setdefault(block[i][0], np.zeros(len(self.words)))
                    found[j] = max(found[j], min(1.0, (v - FLOOR) / (1 - FLOOR)))
        return out


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    slope: float

    def margin(self, features: np.ndarray) -> np.ndarray:
        return np.column_stack((features, features**SHARP)) @ self.weights + self.bias

    def score(self, texts: list[str | None], cache: dict[str, np.ndarray | None] | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-self.slope * np.clip(self.margin(document_features(self.landmarks, texts, cache)), -50, 50)))


def document_features(landmarks: Landmarks, texts: list[str | None], cache: dict[str, np.ndarray | None] | None = None) -> np.ndarray:
    """The largest kernel of any word of each text, by landmark. ``cache`` keeps words that were seen before."""
    cache = {} if cache is None else cache
    out = np.zeros((len(texts), len(landmarks.words)))
    for a in range(0, len(texts), 1500):
        sets = [words_of(t) for t in texts[a : a + 1500]]
        new = list({w for s in sets for w in s if w not in cache})
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list({w for s in sets for w in s})
        found = landmarks.features(new)
        cache.update((w, found.get(i)) for i, w in enumerate(new))
        for i, s in enumerate(sets, a):
            for w in s:
                if (v := cache[w]) is not None:
                    np.maximum(out[i], v, out=out[i])
    return out


def choose_landmarks(texts: list[str | None], toxic: list[int], most: int, support: int) -> list[str]:
    """Words that at least ``support`` toxic texts have, by how much likelier they are there than in clean ones."""
    bad, good = Counter(), Counter()
    for t, y in zip(texts, toxic):
        (bad if y else good).update({n for w in words_of(t) if ORDER <= len(n := normal(w)) <= LONGEST})
    n_bad, n_good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    odds = {w: math.log((k + 0.5) / (n_bad + 1)) - math.log((good[w] + 0.5) / (n_good + 1)) for w, k in bad.items() if k >= support}
    return sorted((w for w, v in odds.items() if v > 2), key=lambda w: (-odds[w] * bad[w], w))[:most]


def disguised(word: str, rnd: random.Random) -> str:
    """The word with one character put in somewhere inside."""
    k = rnd.randrange(1, len(word))
    return word[:k] + rnd.choice("abcdefghijklmnopqrstuvwxyz") + word[k:]


def train(texts: list[str | None], toxic: list[int], *, most: int = 160, support: float = 0.005, cost: float = 30.0, disguise_weight: float = 0.3, clean_weight: float = 4.0, rounds: int = 60) -> Model:
    """Landmarks, Nyström map and squared-hinge machine from labelled texts; one class alone gives a constant below 0.5 or above.

    A toxic text stands for its sentences that have a landmark word, in equal
    parts, so that each insult must do alone; without any it teaches nothing.
    Clean texts weigh ``clean_weight`` times as much as toxic ones. Every such
    sentence also counts, at ``disguise_weight``, as its insults with a character
    put into each: tolerance is learned where no clean word contradicts it.
    """
    words = choose_landmarks(texts, toxic, most, max(4, math.ceil(support * sum(toxic))))
    marks = Landmarks(words)
    if not words or len(set(toxic)) < 2:
        return Model(marks, np.zeros(2 * len(words)), 1.0 if toxic and all(toxic) else -1.0, 2.0)
    rnd, known = random.Random(0), set(words)
    rows: list[tuple[str | None, float, float]] = []
    for t, bad in zip(texts, toxic):
        told = [(p, [n for w in sorted(words_of(p)) if (n := normal(w)) in known]) for p in _SENTENCE.split(t or "")] if bad else []
        told = [x for x in told if x[1]]
        if not bad:
            rows.append((t, -1.0, 1.0))
        for p, insults in told:
            rows.append((p, 1.0, 1 / len(told)))
            rows.append((" ".join(disguised(n, rnd) for n in insults), 1.0, disguise_weight / len(told)))
    x = document_features(marks, [t for t, *_ in rows])
    y, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    # Nyström: at either scale, features times the landmarks' kernel to the power -1/2, small eigenvalues left out
    gram, maps = document_features(marks, words), []
    for power in (1, SHARP):
        k = np.minimum(gram, gram.T) ** power
        value, vector = np.linalg.eigh(k)
        good = value > 1e-2
        maps.append(vector[:, good] / np.sqrt(value[good]))
    whiten = np.zeros((2 * len(words), sum(m.shape[1] for m in maps)))
    whiten[: len(words), : maps[0].shape[1]] = maps[0]
    whiten[len(words) :, maps[0].shape[1] :] = maps[1]
    z = np.column_stack((x, x**SHARP)) @ whiten
    for side, part in ((y > 0, 1.0), (y < 0, clean_weight)):
        weight[side] *= part * cost / ((1 + clean_weight) * weight[side].sum())
    full = np.column_stack((z, np.ones(len(z))))
    reg = np.diag([*np.full(z.shape[1], 1e-2), 1e-6])
    # Newton steps on the squared hinge: least squares over the rows inside the margin
    theta = np.zeros(full.shape[1])
    for step in range(rounds):
        inside = y * (full @ theta) < 1
        f = full[inside]
        new = np.linalg.solve(reg + f.T @ (f * weight[inside, None]), f.T @ (weight[inside] * y[inside]))
        moved = np.abs(new - theta).max()
        theta = new if step < 5 else (theta + new) / 2
        if moved < 1e-9:
            break
    w, b = theta[:-1], float(theta[-1])
    margin, slope = z @ w + b, 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-slope * margin))
        g, h = (weight * (p - (y > 0)) * margin).sum() / weight.sum() + 1e-3 * slope, (weight * p * (1 - p) * margin**2).sum() / weight.sum() + 1e-3
        slope = float(np.clip(slope - g / h, 0.1, 20))
    return Model(marks, whiten @ w, b, slope)


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, most_chars: int = 200_000, test_remainder: int | None = 0, **options) -> Model:
    """Train on at most ``per_class`` labelled documents of each class, picked by a hash of the id, and on ``most_chars`` characters of each.

    Rows of documents whose crc32(id as text) mod 5 is ``test_remainder`` are
    left out; so are rows with a null id or label. Only text and label are used. The
    sample is in order of id, text and label, so that equal tables give equal models,
    also where rows repeat.
    """
    usable = labels.select("doc_id", "toxic").dropna().distinct()
    if test_remainder is not None:
        usable = usable.where(crc_mod("doc_id", 5) != test_remainder)
    picked = None
    for y in (0, 1):
        part = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.substring("text", 1, most_chars).alias("text"), "toxic").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending"), ("toxic", "ascending")])
    return train(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), **options)


def with_score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but ``text``, plus ``score`` from 0 to 1.

    Null and empty texts have the score of no words; repeated rows have equal scores.
    A column ``score`` is replaced, all others stay; an empty table gives no rows. A
    score of exactly 0.5 counts as toxic where a verdict is drawn from it.
    """
    rest = [c for c in docs.columns if c not in (text, "score")]
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = kept_for(key)
        for b in batches:
            scores = sent.value.score(b.column(text).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(scores)], [*rest, "score"])

    return docs.select(*rest, text).mapInArrow(released(run), docs.select(*rest).withColumn("score", F.lit(0.0)).schema)
