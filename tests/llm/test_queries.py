"""Every operator's query, over a small folder of tables, against plain Python: the columns that are compared elsewhere."""

import base64
import hashlib
import random
import re
import zlib

import pytest

from lodestrata.llm import html_text, langid, pii, quality_rules, queries, toxicity
from tests.llm import test_html_text as html_tests
from tests.llm import test_langid as lang_tests
from tests.llm import test_native as native_tests
from tests.llm import test_stores as store_tests
from tests.llm import test_suffix_dedup as suffix_tests
from tests.llm import test_toxicity as toxic_tests


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of three languages with edge cases, repeated rows and a null id; labels; pages."""
    root = tmp_path_factory.mktemp("tables")
    rnd = random.Random(11)
    rows = []
    for i in range(160):
        lang = rnd.choice(list(lang_tests.PARTS))
        text = lang_tests.make(rnd, lang, rnd.randrange(40, 120))
        if i % 5 == 0:
            text += " idiot scum"
        if i % 9 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        if i % 17 == 0:
            text += " call +49 30 1234567 or a@b.co, 1.2.3.4, card 4111 1111 1111 1111"
        rows.append((i, text, lang, f"s{i % 3}"))
    rows += [(160, None, "aa", "s0"), (161, "", None, None), (162, "12 ! -", "bb", "s1"), (163, rows[3][1], "cc", "s2"), (163, rows[3][1], "cc", "s2"), (164, rows[4][1] + " more", None, "s1"), (165, " \n ", "und", None)]
    docs = [*rows, (None, rows[5][1], "aa", "s0")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 0), int(i % 5 == 0)) for i in range(160)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    pages = [(r[0], r[1], r[2]) for r in html_tests.site(random.Random(3), 40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return f"file://{root}", docs, pages


def test_op1(spark, folder):
    root, docs, _ = folder
    got = queries.op1_language_id(spark, root).collect()
    assert len(got) == len(docs)
    # the field that the query learned, evaluated word by word
    model = langid.fit(spark.read.parquet(f"{root}/documents.parquet"))
    by_text = {}
    import numpy as np

    for i, t, *_ in docs:
        raw = np.frombuffer(b" " + langid.lowered(t) + b"\0", np.uint8)
        parts = list(langid.Words.parts(raw, np.array([0, len(raw)])))
        share = lang_tests.plain(np.concatenate([model.emissions(w) for w in parts]), model.transition, model.first).mean(axis=0) if parts else None
        by_text[i] = ("und", 0.0) if share is None else (model.labels[int(share.argmax())], share.max())
    for r in got:
        want = by_text[r.doc_id]
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-6
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id, 4) == 2)
    truth = {i: y for i, _, y, _ in docs[:160]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op2(spark, folder):
    root, docs, _ = folder
    got = queries.op2_suffix_dedup(spark, root).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == suffix_tests.brute([(i, t) for i, t, *_ in docs], 50)


def test_op4(spark, folder):
    root, _, pages = folder
    got = queries.op4_warc(spark, root).collect()
    assert len(got) == len(pages)
    top = {}
    for i, _, h in pages:
        key = (h or "").encode()
        top[key] = max(top.get(key, -1), -1 if i is None else i)
    digest = {base64.b32encode(hashlib.sha1(k).digest()).decode(): k for k in top}
    for r in got:
        key = digest[r.payload_digest]
        assert r.payload_bytes == len(key)
        assert r.refers_to == (None if r.record_type == "response" else top[key] if top[key] >= 0 else None)
        assert r.record_type == "revisit" or (r.page_id if r.page_id is not None else -1) == top[key]
    assert sum(r.record_type == "response" for r in got) == len(top)


def test_op5(spark, folder):
    from tokenizers import Tokenizer

    from lodestrata.llm import packing

    root, docs, _ = folder
    slow = Tokenizer.from_file(packing.default_vocabulary())
    got = queries.op5_packing(spark, root).collect()
    sizes = sorted(len(slow.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in docs)
    assert sum(r.length for r in got) == sum(sizes) and sorted(r.doc_tokens for r in got if r.start == 0) == sizes
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert all(n == 1024 for s, n in ends.items() if s != max(ends))


def test_op6(spark, folder):
    root, docs, _ = folder
    texts = {}
    for i, t, *_ in docs:
        texts.setdefault(i, t)
    for r in queries.op6_pii(spark, root).collect():
        base = native_tests.brute_pii(texts[r.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert {x for x in r.spans.split(",") if x} >= {x for x in shown.split(",") if x}


def test_op7(spark, folder):
    root, docs, _ = folder
    got = queries.op7_toxicity(spark, root).collect()
    tables = [spark.read.parquet(f"{root}/{n}.parquet") for n in ("documents", "labels")]
    model = toxicity.fit(*tables)
    want = dict(zip([i for i, *_ in docs], model.score([t for _, t, *_ in docs])))
    assert len(got) == len(docs)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id, 5) == 0)
    held = [r for r in got if r.held_out and r.doc_id < 160]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)


def test_a_score_of_one_half_is_toxic(spark):
    import numpy as np

    even = toxicity.Model(toxicity.Landmarks([]), np.zeros(0), 0.0, 1.0)
    docs = spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, score int")
    row = toxicity.with_score(docs, even).first()
    assert row.score == 0.5 and int(row.score >= 0.5) == 1


def test_op8(spark, folder):
    root, docs, _ = folder
    got = queries.op8_simhash(spark, root).collect()
    prints = {i: store_tests.brute_fingerprint(t) for i, t, *_ in docs if i is not None}
    want = store_tests.brute_components(list(prints.items()))
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is not None:
            assert re.fullmatch("[0-9a-f]{16}", r.fingerprint) and int(r.fingerprint, 16) == prints[r.doc_id]
            assert r.component_id == want[r.doc_id]


def test_op9(spark, folder):
    root, _, pages = folder
    got = queries.op9_html_text(spark, root).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    direct = html_text.with_main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)).collect()
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=repr) == sorted((tuple(r) for r in direct), key=repr)


def test_op10(spark, folder):
    """The learned list, applied in plain Python to plain statistics, gives the query's verdicts."""
    root, docs, _ = folder
    got = queries.op10_quality_rules(spark, root).collect()
    rules = quality_rules.fit(*(spark.read.parquet(f"{root}/{n}.parquet") for n in ("documents", "labels")))
    assert rules.rules and len(got) == len(docs)
    texts = {}
    for i, t, *_ in docs:
        texts.setdefault(i, t or "")
    for r in got:
        t = texts[r.doc_id]
        n, chars, symbols, dup, repeat, failed = native_tests.brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        lines = sum(bool(re.search(f"[^{native_tests.WS}]", x)) for x in t.split("\n"))
        w, m = max(n, 1), max(lines, 1)
        row = {
            "symbols_per_word": symbols / w, "repeat_share": repeat / w, "dup_line_share": dup / m, "upper_share": sum("A" <= c <= "Z" for c in t) / max(chars, 1),
            "bangs_per_word": t.count("!") / w, "mean_word_chars": chars / w, "words_per_line": n / m,
        }
        first = next((k for k, rule in enumerate(rules.rules, 1) if rule.holds(row)), None)
        assert r.rule == (0 if failed else first) and r.kept == (not failed and first is None)
