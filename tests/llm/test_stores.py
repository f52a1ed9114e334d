"""SimHash, packing and the archive against plain Python."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lodestrata.llm import packing, simhash, warc

EDGE = [None, "", "  \n", "a", "A b", "one two three", "one two three four", "é ß\x0bñ 😀 x y z", "same " * 2000, "same " * 2000]


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    """rows: (id, fingerprint)."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in rows:
        for j, g in rows:
            if (f ^ g).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def texts(seed=5, n=120):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            w = (rnd.choice(out) or "x").split()
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 60, 400]))))
    return out


def test_fingerprints_and_components(spark):
    rows = list(enumerate(EDGE + texts()))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, label string")
    got = {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = {i: brute_fingerprint(t) for i, t in rows}
    classes = brute_components(sorted(want.items()))
    assert got == {i: (want[i], classes[i]) for i in want}
    assert len(set(classes.values())) < len(classes)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(classes.values())


def test_more_fingerprints_link_at_least_as_much(spark):
    rows = list(enumerate(texts(seed=11)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: simhash.fingerprints(t, count=3) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, f in prints.items():
        for j, g in prints.items():
            if any((a ^ b).bit_count() <= 4 for a, b in zip(f, g)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, count=3).collect()}
    assert got == {i: find(i) for i in root}


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (None, "a b c"), (7, "a b c")], schema)
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [3] * 4
    assert sorted(str(r.doc_id) for r in simhash.one_of_each(docs).collect()) == ["3", "None"]


def test_masks_cover_every_pair_within_the_radius():
    rnd = random.Random(2)
    for radius in (1, 2, 4):
        ms = simhash.masks(radius)
        assert len(ms) == 2 ** (radius + 1) - 1
        for _ in range(500):
            diff = sum(1 << b for b in rnd.sample(range(64), radius))
            assert any(not m & diff for m in ms)


@pytest.mark.parametrize("radius", [3, 4])
def test_large_buckets_are_linked_as_by_comparison(radius):
    rnd = np.random.default_rng(3)
    mask = simhash.masks(4)[6]
    centres = rnd.integers(0, 2**63, 12, dtype=np.uint64) & np.uint64(~mask & (2**64 - 1))
    free = [b for b in range(64) if not mask >> b & 1]
    fps = {int(c) ^ sum(1 << int(b) for b in rnd.choice(free, rnd.integers(0, 7), replace=False)) for c in centres for _ in range(40)}
    fps = np.array(sorted(fps), np.uint64)
    a = simhash.link_bucket(fps, mask, radius)
    for variants in (4_000_000, 20_000):
        assert (a == simhash.link_bucket(fps, mask, radius, compare=1, variants=variants)).all()


def test_pieces_tile_documents_and_sequences(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_vocabulary())
    rnd = random.Random(4)
    rows = [*EDGE, "<|endoftext|> a", "x\x85y\x1cz", "日本語 текст", *texts(n=60)]
    docs = spark.createDataFrame([(i, t, rnd.choice(["a", "a", "b", None, "c"])) for i, t in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    got = packing.pack(docs, length=256).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
        seqs[p.sequence_id].append((p.offset, p.length))
    assert set(pieces) == set(range(len(rows)))
    for i, ps in pieces.items():
        ids = np.array(slow.encode(rows[i] or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s, parts in seqs.items():
        at = 0
        for off, k in sorted(parts):
            assert off == at
            at += k
        assert at == 256 or s == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))


def test_every_window_holds_its_share(spark):
    counts = [(i, "abc"[min(2, i % 6)], 10 + i * 7 % 50) for i in range(6000)]
    out = packing.schedule(spark.createDataFrame(counts, "uid long, source string, n long"), window=2000).collect()
    place = {r.uid: r.g for r in out}
    order = sorted(counts, key=lambda x: place[x[0]])
    total = sum(n for *_, n in counts)
    share = {s: sum(n for _, x, n in counts if x == s) / total for s in "abc"}
    sent, at = dict.fromkeys("abc", 0), 0
    for uid, s, n in order:
        assert place[uid] == at
        sent[s] += n
        at += n
        assert all(abs(sent[x] - share[x] * at) <= 2000 + 60 for x in "abc")


def test_windows_keep_a_given_mixture(spark):
    """Every prefix of the stream, and so every window, is off a source's target by one window and one document at most."""
    counts = [(i, "abc"[i % 3], 5 + i * 11 % 60) for i in range(9000)]
    mixture = {"a": 0.2, "b": 0.3, "c": 0.5}
    out = packing.schedule(spark.createDataFrame(counts, "uid long, source string, n long"), window=1024, mixture=mixture).collect()
    place = {r.uid: r.g for r in out}
    left = {s: sum(n for _, x, n in counts if x == s) for s in mixture}
    sent, at, worst = dict.fromkeys(mixture, 0), 0, 0
    for uid, s, n in sorted(counts, key=lambda x: place[x[0]]):
        assert place[uid] == at
        sent[s] += n
        at += n
        if all(sent[x] < left[x] for x in mixture):
            worst = max(worst, *(abs(sent[x] - mixture[x] * at) for x in mixture))
    assert worst <= 1024 + 64
    assert at == sum(left.values())


def test_long_texts_are_encoded_in_parts(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    slow, rnd = Tokenizer.from_file(path), random.Random(6)
    letters = ["the", "I'm", "e\u0301t\u00e9", "x\u3000y", "12 3", "<|endoftext|>", " ", "  two", "\n", "\t a", "!?", "\u65e5\u672c", "a b c"]
    monkeypatch.setattr(packing, "PIECE", 40)
    for _ in range(60):
        text = rnd.choice(["", " "]).join(rnd.choice(letters) for _ in range(rnd.randint(0, 300)))
        assert "".join(packing.pieces(text)) == text
        assert packing.encoder(path)(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_batches_are_taken_in_steps(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "STEP", 100)
    texts = [None, "", "a" * 250, *("b" * (i % 40) for i in range(100)), None, "c" * 90]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts]).slice(1)):
        runs = list(packing.by_size(column))
        assert [i for a, b in runs for i in range(a, b)] == list(range(len(texts)))
        assert all(b - a == 1 or sum(len(t or "") for t in texts[a:b]) <= 100 for a, b in runs)


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_archive_round_trip(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "é" * 10, "é" * 10, "x" * 100_000, "<p>a</p>"]
    pages = [(i, f"http://h/{i}\r\nx" if i % 2 else None, h, "e") for i, h in enumerate(html)] + [(7, "http://h/7", "<p>a</p>", "e"), (None, "u", "<p>a</p>", "e")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha256 string")
    archive = warc.write(df)
    assert archive.payloads.count() == 4
    got = warc.read(archive, keep_record=True).collect()
    assert len(got) == len(pages)
    want = {}
    for page, _, h, _ in pages:
        want.setdefault(h or "", []).append(page)
    groups = defaultdict(list)
    for r in got:
        fields, block = warc.parse(r.record)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(block).digest()).decode() and r.payload_bytes == len(block)
        groups[block.decode()].append(r)
    assert {k: len(v) for k, v in groups.items()} == {k: len(v) for k, v in want.items()}
    for k, rs in groups.items():
        top = max(p for p in want[k] if p is not None)
        assert [r.page_id for r in rs if r.record_type == "response"] == [top]
        assert all(r.refers_to == top for r in rs if r.record_type == "revisit")
        assert all(r.refers_to is None for r in rs if r.record_type == "response")
    assert warc.read(warc.write(df.where("false"))).count() == 0
    assert all(r.record_type == "response" for r in warc.read(warc.write(df, min_revisit_bytes=10**9)).collect())


@pytest.mark.parametrize("compress", [True, False])
def test_records_for_other_tools(spark, compress):
    """Concatenated records are one file: responses hold HTTP messages, revisits their heads, and every payload comes back."""
    html = [None, "<p>a</p>", "<p>a</p>", "é\r\n\r\nx", "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    rows = warc.standard(warc.write(pages), compress).collect()
    records = list(warc.read_standard(b"".join(bytes(r.record) for r in rows)))
    assert len(records) == len(html)
    body = {f["WARC-Record-ID"]: p for f, p in records if f["WARC-Type"] == "response"}
    for fields, payload in records:
        page = int(fields["X-Page-ID"])
        whole = payload if fields["WARC-Type"] == "response" else body[fields["WARC-Refers-To"]]
        assert whole == (html[page] or "").encode() and fields["Content-Type"] == "application/http; msgtype=response"
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(whole).digest()).decode()
        assert fields["WARC-Type"] == "response" or payload == b""
    with pytest.raises(ValueError):
        list(warc.read_standard(b"nothing"))
    with pytest.raises(ValueError):
        list(warc.read_standard(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
