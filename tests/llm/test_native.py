"""Quality rules and personal data against plain Python."""

import hashlib
import random
import re

from lodestrata.llm import pii, quality_rules

WS = "\x20\x09\x0a\x0b\x0c\x0d"
EDGE = [None, "", " \n\t", "a", "a b", "one two three", "x " * 3000, "é ß ñ\n\n é ß ñ\né ß ñ", "same line\nsame line\n\n\nsame line\nother", "a b c a b c a b c d", "#*$%&|<> #"]


def brute_quality(text):
    text = text or ""
    words = re.findall(f"[^{WS}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{WS}]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_pii(text):
    text, out = text or "", []
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    for rank, (kind, pattern, good) in enumerate(
        (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
        )
    ):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def texts(seed=3, n=60):
    rnd = random.Random(seed)
    alphabet = ["a", "b", "the", "the", "of", "\n", "#", "X!", "é", "12", "4111 1111 1111 1111", "a.b@c.d", "1.2.3.4", "+49 (30) 123-4567", "300.1.1.1", ".5.6.7.8", "@x.y", "a@b@c.de", "DE89 3704 0044 0532 0130 00", "0001.2.3.255", "-", "4111-1111-1111-1112", "😀", " "]
    return [rnd.choice(["", " "]).join(rnd.choice(alphabet) for _ in range(rnd.choice([5, 40, 300]))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_words string")


def test_statistics_equal_brute_force(spark):
    rows = EDGE + texts()
    got = quality_rules.apply_rules(frame(spark, rows), quality_rules.DecisionList()).select("doc_id", "n_words", "quality").collect()
    assert len(got) == len(rows)
    for r in got:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute_quality(rows[r.doc_id]), rows[r.doc_id]
        assert r.n_words == "x" and q.kept == (not q.base_failed)


def test_statistics_of_an_empty_table(spark):
    assert quality_rules.apply_rules(frame(spark, []), quality_rules.DecisionList()).count() == 0


def test_list_learns_a_threshold_and_keeps_the_rest(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    clean = [" ".join(rnd.choice(words) for _ in range(80)) for _ in range(60)]
    junk = [" ".join(rnd.choice(words) + "$$$" for _ in range(80)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels)
    assert rules.rules, str(rules)
    kept = {r.doc_id for r in quality_rules.apply_rules(docs, rules).where("quality.kept").collect()}
    assert kept == set(range(60))
    assert not quality_rules.fit(docs, labels.where("false")).rules


def test_spans_equal_brute_force(spark):
    rows = EDGE + texts() + ["7" * 5000, "a" * 4000 + "@b.c", "+1" + "2" * 3000]
    got = pii.with_spans(frame(spark, rows)).select("doc_id", "pii").collect()
    for r in got:
        base = [(x.kind, x.start, x.end) for x in r.pii if x.kind in pii.BASE]
        assert base == brute_pii(rows[r.doc_id]), rows[r.doc_id]
        assert all(0 <= x.score <= 1 for x in r.pii)


def test_checksum_and_context(spark):
    rows = ["my iban DE89 3704 0044 0532 0130 00 thanks", "iban DE88 3704 0044 0532 0130 00", "card 4111 1111 1111 1111", "number 4111 1111 1111 1111"]
    a, b, c, d = (r.pii for r in pii.with_spans(frame(spark, rows)).orderBy("doc_id").collect())
    assert [x.kind for x in a] == ["iban"] and not b
    assert c[0].score > d[0].score


def test_redaction(spark):
    rows = ["call +49 30 1234567 or a@b.co now", None, "nothing"]
    out = [r.text for r in pii.redact(frame(spark, rows)).orderBy("doc_id").collect()]
    assert out == ["call [PHONE] or [EMAIL] now", None, "nothing"]


def redacted(text, spans):
    """Runs of overlapping spans in brackets, by plain Python."""
    runs = []
    for x in spans:
        if runs and x.start < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], x.end)
        else:
            runs.append([x.start, x.end, x.kind])
    for a, b, kind in reversed(runs):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def test_redaction_equals_plain_python(spark, monkeypatch):
    rows = texts(seed=9, n=40) + ["1.2.3.4@a.b 1.2.3.4.5@c.d " * 30]
    spans = {r.doc_id: r.pii for r in pii.with_spans(frame(spark, rows)).collect()}
    for block in (4096, 7):
        monkeypatch.setattr(pii, "_BLOCK", block)
        for r in pii.redact(frame(spark, rows)).collect():
            assert r.text == redacted(rows[r.doc_id], spans[r.doc_id])


def test_many_matches_in_one_text(spark, monkeypatch):
    """A million numbers, a hundred thousand addresses, ten thousand IBANs: seconds each, and the spans of plain Python."""
    iban = "DE89 3704 0044 0532 0130 00"
    rows = [", ".join(map(str, range(10, 1_000_010))), " ".join(f"u{i}@x.org 10.0.{i % 256}.{i % 256}" for i in range(100_000)), f"{iban}, " * 10_000]
    got = {r.doc_id: r.pii for r in pii.with_spans(frame(spark, rows)).collect()}
    for i in (0, 1):
        assert [(x.kind, x.start, x.end) for x in got[i]] == brute_pii(rows[i])
    assert [(x.start, x.end) for x in got[2] if x.kind == "iban"] == [(29 * i, 29 * i + 27) for i in range(10_000)]
    out = {r.doc_id: r.text for r in pii.redact(frame(spark, rows[1:])).collect()}
    assert out[0] == "[EMAIL] [IP] " * 99_999 + "[EMAIL] [IP]" and out[1] == "[IBAN], " * 10_000


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a@b.c", "x", 7)], "doc_id int, text string, pii string, start int")
    row = pii.with_spans(docs).first()
    assert row.start == 7 and [x.kind for x in row.pii] == ["email"]
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).first().pii == "x"
    assert pii.with_spans(docs.where("false")).count() == 0


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
