"""Containment search against comparing every pair."""

import random
import re

import numpy as np

from lodestrata.llm import bytewords, decontam


def grams(text, width=5):
    w = re.findall(r"[a-z0-9\x80-\U0010FFFF]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, q in items:
            g = grams(q)
            if not g:
                continue
            n = len(next(iter(g)))
            w = re.findall(r"[a-z0-9\x80-\U0010FFFF]+", (t or "").lower())
            own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if len(g & own) >= 0.8 * len(g) - 1e-9 and g & own:
                out.add((d, i, len(g & own), len(g)))
    return out


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}é" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 20, 50])))) for i in range(40)] + [(90, None), (91, ""), (92, "!!! ???"), (93, "W1é")]
    docs = [(0, None), (1, ""), (2, "w1é"), (3, "W1É, w2é!")]
    for d in range(4, 120):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([10, 200, 3000]))]
        for _ in range(2):
            p = rnd.choice(items[:40])[1].split()
            if rnd.random() < 0.6:
                p[rnd.randrange(len(p))] = rnd.choice(vocab)
            at = rnd.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in p]
        docs.append((d, " ".join(w)))
    docs.append((4, docs[4][1]))
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (2_000_000, 100):
        got = decontam.contained(df, bench, block_words=words)
        assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()} == brute(docs, items)
    assert got.where("doc_id = 4").count() == 2 * got.where("doc_id = 4").select("item_id").distinct().count()
    left = decontam.without_contaminated(df, bench)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {x[0] for x in brute(docs, items)}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contained(docs, bench).count() == 0
    assert decontam.contained(bench.toDF("doc_id", "text"), bench.where("false")).count() == 0


def test_span_hashes_depend_on_bytes_alone():
    inside = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
    raw = np.frombuffer(b"abc x abc xx abcd abc\0", np.uint8)
    a, b = bytewords.spans(raw, inside)
    h = bytewords.span_hashes(raw, a, b)
    assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 4


def test_slices_change_nothing(monkeypatch):
    raw = np.frombuffer(("word " * 50 + "x" * 300 + " ab cd ").encode() + b"\0", np.uint8)
    inside = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
    a, b = bytewords.spans(raw, inside)
    want = bytewords.span_hashes(raw, a, b)
    for step in (1, 7, 100, 10_000):
        monkeypatch.setattr(bytewords, "STEP", step)
        assert (bytewords.word_hashes(raw, a, b) == want).all()


def test_partitions_skip_what_cannot_fit():
    """Each size partition has its own sketch; a document too small for one is not looked up there."""
    rnd = random.Random(2)
    items = [(k, " ".join(f"p{k}x{i}" for i in range(n))) for k, n in enumerate([2, 5, 9, 12, 40, 200, 1000])]
    s = decontam.Sketches(items, 5, 0.8)
    assert set(s.parts[5]) == {decontam.partition_of(len(grams(t))) for _, t in items[1:]} and set(s.parts[2]) == {0}
    for n, parts in s.parts.items():
        for k, part in parts.items():
            mine = [x for x in s.items if len(next(iter(x[1]))) == n and decontam.partition_of(len(x[1])) == k]
            assert part.least == min(x[2] for x in mine) and {i for v in part.probes.values() for i in v} == {s.items.index(x) for x in mine}
            assert part.top == max(part.probes)
    asked = []
    for parts in s.parts.values():
        for k, part in parts.items():
            part.probes = type("D", (dict,), {"get": lambda self, h, d=(), k=k: asked.append(k) or dict.get(self, h, d)})(part.probes)
    assert {h[1] for h in s.search([items[2][1], items[3][1] + " and more"])} == {2, 3}
    # ten shingles hold nothing of forty and more
    assert asked and max(asked) <= 4
    words = [w for _, t in items[3:] for w in t.split()]
    docs = [" ".join(items[k][1] if rnd.random() < 0.5 else " ".join(rnd.choice(words) for _ in range(60)) for k in rnd.sample(range(7), 3)) for _ in range(40)]
    assert {(d, i, a, b) for d, i, a, b in s.search(docs)} == brute(list(enumerate(docs)), items)


def test_joined_and_sent_are_equal_for_nulls_and_copies(spark):
    passage = " ".join(f"q{i}" for i in range(30))
    docs = [(None, f"x {passage} y"), (None, f"x {passage} y"), (None, "none"), (1, passage), (1, passage), (1, f"{passage} {passage}"), (2, None), (3, "")]
    items = [(7, passage), (7, passage + " end"), (None, passage), (8, "none"), (9, "")]
    df, bench = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    sent, joined = (sorted((tuple(r) for r in decontam.contained(df, bench, block_words=n).collect()), key=str) for n in (10**6, 1))
    assert sent == joined and len(sent) == 3 * 5 + 1
    assert decontam.contained(df.where("false"), bench, block_words=1).count() == 0
