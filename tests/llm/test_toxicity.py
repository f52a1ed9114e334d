"""The kernel against its definition, the screen against no screen, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest

from lodestrata.llm import toxicity
from lodestrata.llm.common import crc_mod


def brute_kernel(s, t):
    def features(w):
        out = {}
        for at in itertools.combinations(range(len(w)), toxicity.ORDER):
            u = "".join(w[i] for i in at)
            out[u] = out.get(u, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = features(s), features(t)
    return sum(v * b.get(u, 0) for u, v in a.items())


WORDS = ["idiot", "idxiot", "moron", "banana", "anna", "aaaa", "abcabcabc", "straße", "x" * 24]


def test_kernel_equals_definition():
    for t in WORDS[:-1]:
        got = toxicity.subsequence_kernel(toxicity.pad(WORDS), toxicity.pad([t]))
        assert np.allclose(got, [brute_kernel(s, t) for s in WORDS], rtol=1e-4)


def test_screen_loses_nothing():
    rnd = random.Random(3)
    words = list({"".join(rnd.choice("idotmrnabc") for _ in range(rnd.randrange(1, 12))) for _ in range(3000)} | {"idiot", "i.d.i.o.t", "idxiot", "y" * 60 + "idiot"})
    marks = toxicity.Landmarks(["idiot", "moron", "banana"])
    got = marks.features(words)
    for i, w in enumerate(words):
        for j, t in enumerate(marks.words):
            best = 0
            for p in toxicity.pieces(toxicity.normal(w)):
                if len(p) >= toxicity.ORDER:
                    best = max(best, brute_kernel(p, t) / (brute_kernel(p, p) * brute_kernel(t, t)) ** 0.5)
            want = max(0, (best - toxicity.FLOOR) / (1 - toxicity.FLOOR))
            assert abs(want - (got[i][j] if i in got else 0)) < 1e-3, (w, t)


def sentences(n=900, seed=4):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(["th", "er", "on", "an", "re", "nd", "ti"]) for _ in range(rnd.randrange(1, 5))) for _ in range(3000)]
    out = []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 80))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(2):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "scum,", "Worthless", "pathetic!"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = sentences()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    return rows, docs, toxicity.fit(docs, labels)


def test_held_out_accuracy_and_disguises(spark, model):
    rows, docs, machine = model
    got = {r.doc_id: r.score for r in toxicity.with_score(docs, machine).collect()}
    held = {r.doc_id for r in docs.where(crc_mod("doc_id", 5) == 0).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i in held]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    for w in ("wor-thless", "i d i o t", "pathettic", "worthlesss", "p.a.t.h.e.t.i.c", "wortzhless"):
        assert machine.score([f"er the {w} onan"])[0] >= 0.5, w


def test_edges(spark, model):
    machine = model[2]
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (3, "z " * 50_000, 5), (None, "idiot scum", 5)], "doc_id long, text string, score int")
    rows = toxicity.with_score(docs, machine).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score >= 0.5) == (r.doc_id is None) for r in rows)
    empty = docs.where("false")
    assert toxicity.with_score(empty, machine).count() == 0
    constant = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert constant.score(["idiot"])[0] < 0.5


def test_scores_equal_a_plain_evaluation(spark, model):
    """Every word against every landmark by the kernel's definition, and the machine's formula."""
    machine = model[2]
    rnd = random.Random(8)
    texts = [None, "", "er on an", "i d i o t", "pathetixc scum", " ".join(rnd.choice(["worthless", "wrthless", "banana", "idiots", "an", "tion"]) for _ in range(6))]
    for t, got in zip(texts, machine.score(texts)):
        x = np.zeros(len(machine.landmarks.words))
        for w in toxicity.words_of(t):
            for p in toxicity.pieces(toxicity.normal(w)):
                if len(p) < toxicity.ORDER:
                    continue
                for j, m in enumerate(machine.landmarks.words):
                    k = brute_kernel(p, m) / (brute_kernel(p, p) * brute_kernel(m, m)) ** 0.5
                    x[j] = max(x[j], (k - toxicity.FLOOR) / (1 - toxicity.FLOOR))
        margin = np.concatenate((x, x**toxicity.SHARP)) @ machine.weights + machine.bias
        assert abs(got - 1 / (1 + np.exp(-machine.slope * margin))) < 1e-3


def test_repeated_rows_do_not_depend_on_their_order(spark, model):
    rows, docs, _ = model
    labels = spark.createDataFrame([(i % 300, y) for i, _, y in rows], "doc_id long, toxic int")
    twice = docs.selectExpr("doc_id % 300 as doc_id", "text")
    a, b = (toxicity.fit(twice.repartition(n), labels.repartition(n)) for n in (2, 5))
    assert a.landmarks.words == b.landmarks.words and np.array_equal(a.weights, b.weights)
