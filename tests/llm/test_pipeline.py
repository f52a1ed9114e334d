"""The stages' decisions on planted cases, one after the other."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rnd = random.Random(9)
    words = ["".join(rnd.choice(["th", "er", "on", "an", "re", "nd"]) for _ in range(rnd.randrange(1, 4))) for _ in range(900)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(120):
        t = line(150)
        if i % 4 == 3:
            t = t.replace(" ", "$$$ ")
        docs.append((i, t, "en", f"src{i % 3}", len(t)))
        labels.append((i, int(i % 4 != 3), 0))
    item = line(30)
    add = lambda i, t: docs.append((i, t, "en", "src9", len(t or "")))
    w = docs[0][1].split()
    add(200, docs[0][1])
    add(201, " ".join(w[:70] + ["changed"] + w[71:]))
    add(202, line(60) + " " + item + " " + line(60))
    add(203, line(100) + " mail me at some.one@example.org now")
    add(204, None)
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_decides(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns
        docs = docs.cache()
        seen.append({r.doc_id: r.text for r in docs.collect()})
    good = {i for i in range(120) if i % 4 != 3}
    assert set(seen[0]) == good | {200, 201, 202, 203}
    assert set(seen[1]) == good | {202, 203}
    assert set(seen[2]) == set(seen[3]) == good | {203}
    assert "[EMAIL]" in seen[3][203] and all(seen[3][i] == seen[2][i] for i in good)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {p.doc_id for p in pieces} == good | {203}
    assert {p.doc_id for p in corpus_pipeline.run(spark, data).collect()} == good | {203}


def test_stages_of_nothing(spark, data):
    empty = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0
