"""Forward-backward against enumeration, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest

from lodestrata.llm import bytewords, langid


def brute(emission, fresh, transition, first):
    n, k = emission.shape
    out = np.zeros((n, k))
    bounds = [*np.flatnonzero(fresh), n]
    for a, b in zip(bounds, bounds[1:]):
        for path in itertools.product(range(k), repeat=b - a):
            w = first[path[0]] + sum(transition[x, y] for x, y in zip(path, path[1:])) + sum(emission[a + i, y] for i, y in enumerate(path))
            for i, y in enumerate(path):
                out[a + i, y] += np.exp(w)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block", [2, 3, 64])
def test_posteriors_equal_enumeration(monkeypatch, block):
    monkeypatch.setattr(langid, "_BLOCK", block)
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 12):
        e, t, f = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        fresh = np.arange(n) % 6 == 0
        assert np.allclose(langid.forward_backward(e, fresh, t, f), brute(e, fresh, t, f))


PARTS = {"aa": ["th", "er", "ing", "tion", "re"], "bb": ["ung", "keit", "sch", "ü", "ver"], "cc": ["ción", "mente", "ado", "os", "ñ"]}


def make(rnd, lang, n):
    return " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(2)
    rows = [(i, make(rnd, y := rnd.choice(list(PARTS)), rnd.randrange(4, 60)), y) for i in range(400)]
    docs = spark.createDataFrame([*rows, (400, None, "aa"), (401, "12 !", "bb"), (402, "thering", None), (403, "", "cc"), (None, "ung keit ver", "bb"), (3, *rows[3][1:])], "doc_id long, text string, lang string")
    return rows, docs, langid.fit(docs, sequences=400)


def test_held_out_documents(spark, data):
    rows, docs, model = data
    assert model.labels == sorted(PARTS)
    got = langid.with_language(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    pred = {r.doc_id: r.lang_pred for r in got}
    assert sum(pred[i] == y for i, _, y in rows) >= 0.99 * len(rows)
    assert [pred[i] for i in (400, 401, 403)] == ["und"] * 3
    assert pred[402] == "aa" and pred[None] == "bb"


def test_words_of_a_switched_text(data):
    rnd = random.Random(5)
    text = make(rnd, "aa", 12) + ", " + make(rnd, "bb", 12)
    labels = [y for _, y in langid.label_words(data[2], text)]
    assert sum(y == "aa" for y in labels[:12]) >= 11 and sum(y == "bb" for y in labels[12:]) >= 11


def test_slices_change_nothing(monkeypatch, data):
    rnd = random.Random(6)
    texts = [make(rnd, y, 300) for y in PARTS] + ["", None, "12"]
    want = langid.predict(data[2], texts)
    for step in (1, 50, 700):
        monkeypatch.setattr(bytewords, "STEP", step)
        got = langid.predict(data[2], texts)
        assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_long_texts_and_no_rows(spark, data):
    model = data[2]
    names, score = langid.predict(model, ["thering " * 50_000, "ung"])
    assert names == ["aa", "bb"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.with_language(empty, model).count() == 0
    assert langid.predict(langid.fit(empty), ["abc"])[0] == ["und"]


@pytest.mark.parametrize("segment", [64, 128, 1 << 18])
def test_segments_change_nothing(monkeypatch, data, segment):
    """A chain taken by segments has the posteriors of the whole, and these are those of plain messages."""
    model, rnd = data[2], random.Random(9)
    texts = [make(rnd, "aa", 400) + " " + make(rnd, "cc", 350), None, "", "12", *(make(rnd, rnd.choice(list(PARTS)), rnd.randrange(1, 90)) for _ in range(20)), make(rnd, "bb", 700)]
    monkeypatch.setattr(langid, "SEGMENT", segment)
    names, score = langid.predict(model, texts)
    for i, t in enumerate(texts):
        raw = np.frombuffer(b" " + langid.lowered(t) + b"\0", np.uint8)
        parts = list(langid.Words.parts(raw, np.array([0, len(raw)])))
        if not parts:
            assert (names[i], score[i]) == ("und", 0)
            continue
        p = plain(np.concatenate([model.emissions(w) for w in parts]), model.transition, model.first)
        share = p.mean(axis=0)
        assert names[i] == model.labels[int(share.argmax())] and abs(score[i] - share.max()) < 1e-9


def plain(emission, transition, first):
    """Forward-backward word by word, in logarithms."""
    n = len(emission)
    a, b = np.empty_like(emission), np.zeros_like(emission)
    a[0] = first + emission[0]
    for i in range(1, n):
        x = a[i - 1][:, None] + transition
        a[i] = np.logaddexp.reduce(x, axis=0) + emission[i]
    for i in range(n - 2, -1, -1):
        b[i] = np.logaddexp.reduce(transition + emission[i + 1] + b[i + 1], axis=1)
    p = a + b
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_equal_tables_give_equal_models_and_columns_may_clash(spark, data):
    docs = data[1]
    twice = langid.fit(docs.repartition(5), sequences=400)
    assert all((a == b).all() for a, b in zip(twice.tables, data[2].tables))
    clash = docs.selectExpr("doc_id", "text", "'x' as score", "1 as lang_pred", "doc_id as held_out")
    got = langid.with_language(clash, data[2])
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and dict(got.dtypes)["score"] == "double"
    # no language is nearer than another: the first by name
    even = langid.Model(["aa", "bb"])
    names, score = langid.predict(even, ["one two"])
    assert names == ["aa"] and score[0] == 0.5
