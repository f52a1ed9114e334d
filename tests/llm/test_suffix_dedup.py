"""Windows removed by the radix sort against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from lodestrata.llm import suffix_dedup


def brute(docs, depth):
    owner = {}
    for i, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - depth + 1):
            w = raw[k : k + depth]
            if i is not None and (w not in owner or owner[w] > i):
                owner[w] = i
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - depth + 1):
            o = owner.get(raw[k : k + depth])
            if o is not None and (i is None or o < i):
                gone[k : k + depth] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=8, n=150):
    rnd = random.Random(seed)
    vocab = ["the", "of", "naïve", "Straße", "tion", "er", "x" * 30, "ab" * 40]
    line = lambda k: " ".join(rnd.choice(vocab) + str(rnd.randrange(30)) for _ in range(k))
    common = [line(20) for _ in range(4)]
    docs = [(0, None), (1, ""), (2, "short"), (3, "a" * 500), (4, "a" * 300 + "b" + "a" * 60), (5, "ab" * 200)]
    for i in range(6, n):
        t = line(rnd.choice([3, 12, 120]))
        r = rnd.random()
        if r < 0.4 and docs[-1][1]:
            t = rnd.choice(docs)[1] or ""
        if r < 0.2 and t:
            k = rnd.randrange(len(t))
            t = t[:k] + "#" + t[k:]
        if r > 0.5:
            t += rnd.choice(common) + line(2)
        docs.append((i, t))
    docs += [docs[40], (50, "other " + common[0]), (None, docs[60][1]), (None, line(30))]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("flush,segment,hot_flush,hot_bucket", [(500, 100, 64, 20_000), (16_000_000, 4_000_000, 64, 20_000), (20_000, 4_000_000, 2, 20_000), (16_000_000, 4_000_000, 10**6, 2), (3_000, 700, 3, 4)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, flush, segment, hot_flush, hot_bucket):
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    monkeypatch.setattr(suffix_dedup, "HOT_FLUSH", hot_flush)
    monkeypatch.setattr(suffix_dedup, "HOT_BUCKET", hot_bucket)
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int").repartition(3)
    for depth in (50, 23):
        got = suffix_dedup.remove_repeats(df, depth).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(docs, depth)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_no_rows(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_periodic_text(spark):
    docs = [(1, "abcdefg " * 20_000), (2, "x" + "abcdefg " * 10_000), (3, "z" * 100_000)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (80_000, 1), 3: (0, 0)}


@pytest.mark.parametrize("depth", [20, 21, 50, 51])
def test_split_windows_keep_their_bytes_together(depth):
    """Every window is in one run; equal windows of one digit have equal names, wherever their strings begin."""
    rnd = random.Random(depth)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(depth, 400))) + bytes(rnd.choice(b"ab") for _ in range(3)) for _ in range(20)] + [b"a" * 300, b"ab" * 100]
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    s, e, v, p = suffix_dedup.strings_of(raw, starts, depth)
    of, at, n, place, right = suffix_dedup.split(raw, s, e - s, v, depth)
    wide = suffix_dedup.GRAM + (depth - suffix_dedup.GRAM) // 2
    name = suffix_dedup.wide_values(raw, s[of] + at + place, wide, right)
    assert (n >= depth).all() and (at + n <= (e - s)[of]).all() and (place >= 0).all() and place.max() < 64
    windows, seen = {}, []
    for k in range(len(of)):
        for w in range(n[k] - depth + 1):
            here = s[of[k]] + at[k] + w
            seen.append(here)
            assert 0 <= place[k] - w and place[k] - w + wide <= depth
            key = raw[here : here + depth].tobytes()
            assert windows.setdefault(key, (v[of[k]], name[k])) == (v[of[k]], name[k])
    assert sorted(seen) == [w for a, b in zip(s, e) for w in range(a, b - depth + 1)]


def test_a_phrase_in_ever_other_surroundings(spark):
    """A third of all documents share 27 bytes and no window: its digits are split, and nothing goes."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    docs = [(i, f"{word()}{word()} the one very common phrase {word()}{word()}") for i in range(900)]
    docs += [(5000, docs[7][1]), (5001, "x" + docs[8][1] + "y")]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert {i for i, n in got.items() if n} == {5000, 5001} and got[5001] == len(docs[8][1])
