"""Near duplicates confirmed by exact similarity."""

import random

import pytest

import corpus_pipeline
from lodestrata.llm import simhash


def jaccard(a, b, width=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def classes(texts, similarity):
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= similarity:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def varied(rnd, n, changes):
    """Texts of 120 words, each the one before or the first with a few words changed."""
    base = [f"w{rnd.randrange(4000)}" for _ in range(120)]
    out = [base]
    while len(out) < n:
        w = list(rnd.choice((out[-1], base)))
        for _ in range(rnd.randrange(changes)):
            w[rnd.randrange(len(w))] = f"c{rnd.randrange(4000)}"
        out.append(w)
    return [" ".join(w) for w in out]


def test_classes_are_those_of_all_comparisons():
    rnd = random.Random(1)
    for _ in range(20):
        texts = [*varied(rnd, 25, 5), *varied(rnd, 10, 2), "", " ", "a b", "A b", "a c"]
        rnd.shuffle(texts)
        got = simhash.similar_classes([simhash.shingle_hashes(t) for t in texts], 0.8)
        assert got == classes(texts, 0.8)


def test_only_asked_pairs_are_compared():
    import numpy as np

    rnd = random.Random(3)
    texts = varied(rnd, 40, 7)
    sets = [simhash.shingle_hashes(t) for t in texts]
    asked = np.array([rnd.random() < 0.4 for _ in texts])
    start = [i - i % 3 for i in range(len(texts))]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(texts)):
        for j in range(i):
            if start[i] == start[j] or (asked[i] or asked[j]) and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert simhash.similar_classes(sets, 0.8, start, asked) == [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("texts_at_once,bytes_at_once", [(4, 10**9), (7, 4000), (5, 1)])
def test_large_classes_are_linked_in_groups(spark, monkeypatch, texts_at_once, bytes_at_once):
    """Classes far beyond one group, dense ones and chains, give what comparing all pairs of the class gives."""
    monkeypatch.setattr(simhash, "GROUP_TEXTS", texts_at_once)
    monkeypatch.setattr(simhash, "GROUP_BYTES", bytes_at_once)
    rnd = random.Random(texts_at_once)
    n = 16 if bytes_at_once == 1 else 45
    texts = [*varied(rnd, n, 8), *varied(rnd, 6, 3), "", " ", "  "]
    kind = [*([0] * n), *([1] * 6), 2, 2, 2]
    rows = spark.createDataFrame([(i, k, 100 + i, len(t), t) for i, (t, k) in enumerate(zip(texts, kind))], "uid long, class long, low long, size long, text string").repartition(3)
    got = {r.uid: r.label for r in simhash._linked(rows.drop("text"), rows, 0.8, 5, 42).collect()}
    want = classes(texts, 0.8)
    assert len(got) == len(texts)
    same = lambda labels: {frozenset(i for i in labels if labels[i] == v) for v in labels.values()}
    assert same(got) == same(dict(enumerate(want)))


def test_stage_keeps_what_is_below_the_similarity(spark):
    rnd = random.Random(6)
    texts = [t for _ in range(30) for t in varied(rnd, 6, 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    want = classes(texts, 0.8)
    assert len(set(want)) < len(texts)
    # no document goes without a near one; nearly all near ones are found
    assert set(want) <= kept
    assert len(kept - set(want)) <= 0.03 * len(texts)


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    rnd = random.Random(8)
    first, other, alone = (" ".join(f"w{rnd.randrange(4000)}" for _ in range(120)) for _ in range(3))
    rows = [(1, first), (2, first + " more"), (2, other), (2, other), (3, alone), (3, first), (None, first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert kept == sorted([(1, first), (2, other), (3, alone), (None, first)], key=str)


def test_stage_of_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " ", "z"), (4, "one two", "x"), (4, "one two", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, label string")
    kept = sorted((tuple(r) for r in simhash.one_similar_of_each(docs, width=2, count=3).collect()), key=str)
    assert kept == sorted([(1, None, "x"), (4, "one two", "x"), (None, None, "x")], key=str)
    assert simhash.one_similar_of_each(docs.where("false"), count=2).count() == 0
