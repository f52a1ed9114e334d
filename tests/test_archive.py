"""Archives: metadata that holds, metadata that does not, and whole replacement."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import predicates as P
from lodestrata.operators import synopses as S
from lodestrata.operators import zones
from lodestrata.sources import archive, metadata, storage, tables


def made(spark, path, n=1000, first=0, **options):
    df = spark.range(first, first + n).selectExpr("id", "id % 7 as k", "cast(id * 0.001 as decimal(12,4)) as d", "case when id % 5 = 0 then null else cast(id % 3 as string) end as s")
    archive.write(df, path, archive.WriteOptions(cluster_by=("id",), partitions=4, zone_rows=50, histograms=("k",), indexes=("k", "id"), **options))
    return df


def files_read(df):
    return len(df.inputFiles())


def test_files_that_cannot_match_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "a")
    df = made(spark, path)
    p = P.pred("Between", "id", 10, 20)
    got = archive.read(spark, path, p)
    assert got.count() == 11 and files_read(got) < files_read(archive.read(spark, path))
    for q in (P.AND(P.pred("GtEq", "id", 900), P.pred("Contains", "s", "1")), P.NOT(P.pred("Lt", "id", 990)), P.OR(P.pred("Eq", "id", 3), P.pred("IsNull", "s")), P.pred("Eq", "d", 0.5), P.pred("Eq", "id", -1), P.pred("InSet", "k", [])):
        for use_index in (True, False):
            assert sorted(archive.read(spark, path, q, use_index=use_index).collect(), key=str) == sorted(df.where(P.to_column(q)).collect(), key=str), q
    assert archive.read(spark, path, P.pred("Eq", "id", -1)).schema == archive.read(spark, path).schema


@pytest.mark.parametrize("many", [False, True])
def test_stale_metadata_loses_no_rows(spark, tmp_path, monkeypatch, many):
    """A file that is added, rewritten or deleted: pruned reads, answers and indexes are those of the files as they are."""
    if many:
        monkeypatch.setattr(storage, "FEW_FILES", 1)
    path = str(tmp_path / "a")
    made(spark, path)
    everything, low = P.pred("GtEq", "id", 0), P.pred("Lt", "id", 100)

    def same(p):
        plain = spark.read.parquet(f"{path}/data").where(P.to_column(p))
        assert sorted(archive.read(spark, path, p).collect()) == sorted(plain.collect())

    assert metadata.synopses(metadata.opened(spark, path)) is not None
    spark.range(-1000, 0).selectExpr("id", "id % 7 as k", "cast(0 as decimal(12,4)) as d", "'x' as s").coalesce(1).write.mode("append").parquet(f"{path}/data")
    assert archive.read(spark, path, P.pred("Lt", "id", 100)).count() == 1100
    assert archive.read(spark, path, everything).count() == 1000
    a = metadata.opened(spark, path)
    assert not metadata.whole(a) and metadata.synopses(a) is None and metadata.index(a, "k") is None
    for q in (low, P.pred("Eq", "k", 3), P.pred("Eq", "id", -5)):
        same(q)
    archive.refresh(spark, path, archive.WriteOptions(zone_rows=50, histograms=("k",), indexes=("k", "id")))
    assert metadata.whole(metadata.opened(spark, path)) and files_read(archive.read(spark, path, P.pred("Eq", "id", -5))) == 1
    # one file takes another's content, under its old name
    old = sorted(f for f in glob.glob(f"{path}/data/*.parquet"))
    spark.range(5000, 5100).selectExpr("id", "id % 7 as k", "cast(0 as decimal(12,4)) as d", "'y' as s").coalesce(1).write.parquet(str(tmp_path / "b"))
    new = glob.glob(str(tmp_path / "b" / "*.parquet"))[0]
    os.replace(new, old[0])
    for f in glob.glob(f"{path}/data/.*.crc"):
        os.remove(f)
    assert archive.read(spark, path, P.pred("Gt", "id", 4000)).count() == 100
    os.remove(old[1])
    assert not metadata.whole(metadata.opened(spark, path))
    for q in (low, P.pred("Eq", "k", 3), P.pred("Gt", "id", 990), everything):
        same(q)
    assert {r.finding for r in archive.verify(spark, path).collect()} == {"missing", "length"}
    assert {"missing", "length"} <= {r.finding for r in archive.verify(spark, path, deep=False).collect()}


def test_answers_from_stored_metadata(spark, tmp_path):
    path, other = str(tmp_path / "a"), str(tmp_path / "b")
    df, more = made(spark, path), made(spark, other, 500, 1000)
    s, t = (metadata.synopses(metadata.opened(spark, x)) for x in (path, other))
    assert S.count_rows(s).first().n == 1000 and S.count_column(s, "s").first().n == df.where("s is not null").count()
    assert S.sum_avg(s, "d").first().total == float(df.agg(F.sum("d")).first()[0])
    assert {(r.key, r.n) for r in S.group_count(s, "k").collect()} == {(r.k, r["count"]) for r in df.groupBy("k").count().collect()}
    both = metadata.merged([s, t])
    assert S.count_rows(both).first().n == 1500 and tuple(S.min_max(both, "id").first()) == (0, 1499)
    assert {(r.key, r.n) for r in S.group_count(both, "k").collect()} == {(r.k, r["count"]) for r in df.union(more).groupBy("k").count().collect()}
    assert metadata.merged([s, S.Synopses(t.facts, t.zone, t.columns, all_visible=False)]) is None and metadata.merged([]) is None


def test_stored_indexes(spark, tmp_path, monkeypatch):
    from lodestrata.operators import key_index

    path = str(tmp_path / "a")
    df = made(spark, path)
    a = metadata.opened(spark, path)
    i = metadata.index(a, "k")
    assert key_index.usable(i, metadata.fingerprint(a)) and not key_index.usable(i, "other")
    for found, where in ((key_index.lookup_eq(i, 3), "k = 3"), (key_index.lookup_range(i, 2, 5, low_open=True), "k > 2 and k <= 5"), (key_index.lookup_in(i, [0, 99]), "k in (0, 99)"), (key_index.lookup_eq(i, 99), "false")):
        want = sorted(r.id for r in df.where(where).collect())
        assert sorted(r.id for r in metadata.fetch(a, found).collect()) == want
        monkeypatch.setattr(metadata, "NAMED_FILES", 10)
        assert sorted(r.id for r in metadata.fetch(a, found).collect()) == want
        monkeypatch.setattr(metadata, "NAMED_FILES", 10_000)
    assert metadata.index(a, "s") is None
    assert metadata.survey(a, P.pred("Eq", "id", 7)).by_index == "id"


def test_explanations_and_counters(spark, tmp_path):
    path = str(tmp_path / "a")
    made(spark, path)
    a = metadata.opened(spark, path)
    p = P.AND(P.pred("Lt", "id", 60), P.pred("Contains", "s", "1"))
    e = metadata.explain(a, p).collect()
    assert sum(r.rows for r in e) == 1000 and {r.row_start for r in e if r.zone == 1} == {50}
    kept = [r for r in e if r.decision == "kept"]
    assert {r.fallback for r in kept} <= {None, "no_statistics"} and all(r.evidence == "Lt:id" for r in e if r.decision == "pruned")
    c = metadata.counters(a, P.pred("Lt", "id", 60)).first()
    assert (c.files, c.files_pruned, c.files_stale, c["index"]) == (4, 3, 0, "id") and c.rows == 1000 and c.zones_whole >= 1
    spark.range(1).coalesce(1).selectExpr("id", "id as k", "cast(0 as decimal(12,4)) as d", "'x' as s").write.mode("append").parquet(f"{path}/data")
    stale = [r for r in metadata.explain(a, p).collect() if r.fallback == "stale_metadata"]
    assert len(stale) == 1 and stale[0].decision == "kept"
    splits = archive.scan_splits(spark, path, 100).groupBy("split", "file").agg(F.sum("rows").alias("n")).collect()
    assert sum(r.n for r in splits) == 1000 and all(r.n <= 150 for r in splits)
    assert [r.valid for r in archive.describe_layout(spark, path).collect()] == [True] * 4


def test_replacement_is_whole(spark, tmp_path):
    path = str(tmp_path / "a")
    made(spark, path)
    with pytest.raises(tables.ArchiveError, match="exists"):
        made(spark, path)
    made(spark, path, 10, mode="ignore")
    assert archive.read(spark, path).count() == 1000
    made(spark, path, 10, mode="overwrite")
    assert archive.read(spark, path).count() == 10 and metadata.whole(metadata.opened(spark, path))
    # a write that fails leaves the old archive; a swap that ended early is taken back
    with pytest.raises(Exception, match="broken"):
        archive.write(spark.range(5).select(F.raise_error(F.lit("broken")).cast("int").alias("id")), path, archive.WriteOptions(mode="overwrite"))
    assert archive.read(spark, path).count() == 10
    os.rename(path, f"{path}.old-1")
    assert archive.read(spark, path, P.pred("GtEq", "id", 0)).count() == 10
    made(spark, path, 5, 10, mode="append")
    assert archive.read(spark, path, P.pred("GtEq", "id", 0)).count() == 15


def test_options_are_checked(spark, tmp_path):
    df = spark.range(3)
    for bad in ({"mode": "x"}, {"cluster_by": ("z",)}, {"histograms": "declared"}, {"indexes": "auto"}, {"curve": ("id",), "curve_kind": "hilbert"}, {"zone_rows": 0}):
        with pytest.raises(tables.ArchiveError):
            archive.write(df, str(tmp_path / "x"), archive.WriteOptions(**bad))
    made(spark, str(tmp_path / "y"))
    archive.write(spark.range(2000).selectExpr("id", "id % 3 as few"), str(tmp_path / "z"), archive.WriteOptions(histograms="auto"))
    assert os.path.isdir(tmp_path / "z" / "histograms" / "few") and not os.path.isdir(tmp_path / "z" / "histograms" / "id")


def test_curves(spark, tmp_path):
    n = 16
    cells = spark.range(n * n).selectExpr("id % 16 as x", "id div 16 as y")
    at = {r.d: (r.x, r.y) for r in cells.withColumn("d", zones.hilbert(F.col("x"), F.col("y"), 4)).collect()}
    assert sorted(at) == list(range(n * n))
    # each step along the curve goes to a neighbouring cell
    assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(n * n - 1))
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.random(), rnd.randrange(1000), None if i % 50 == 0 else i) for i in range(4000)], "a double, b int, c long")
    for kind in ("z", "hilbert"):
        path = str(tmp_path / kind)
        archive.write(df, path, archive.WriteOptions(curve=("a", "b"), curve_kind=kind, partitions=16))
        for p in (P.pred("Lt", "a", 0.1), P.pred("Lt", "b", 100)):
            got = archive.read(spark, path, p)
            assert got.count() == df.where(P.to_column(p)).count() and files_read(got) <= 10


def test_manifests_of_other_folders(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in" / "one"))
    spark.range(5, 9).coalesce(1).write.parquet(str(tmp_path / "two"))
    one, two = (glob.glob(str(tmp_path / x / "*.parquet"))[0] for x in ("in/one", "two"))
    rows = [{"uri": os.path.relpath(one, tmp_path), "bytes": os.path.getsize(one)}, {"uri": two, "bytes": None}]
    assert archive.scan_listed(spark, str(tmp_path), rows).count() == 9
    stale = [{**rows[0], "bytes": 1}, rows[1]]
    with pytest.raises(tables.ArchiveError, match="length"):
        archive.scan_listed(spark, str(tmp_path), stale)
    assert archive.scan_listed(spark, str(tmp_path), stale, strict=False).count() == 9
    with pytest.raises(tables.ArchiveError, match="digest"):
        archive.scan_listed(spark, str(tmp_path), [{**rows[0], "sha256": "0"}])


def test_names_that_need_escapes(spark, tmp_path):
    path = str(tmp_path / "a b+c%20")
    df = spark.createDataFrame([(i, s) for i in range(40) for s in ("x y", "a+b", "50%", "k=v/w")], "id long, s string")
    archive.write(df, path, archive.WriteOptions(partition_by=("s",)))
    assert metadata.whole(metadata.opened(spark, path))
    for p in (P.pred("Eq", "s", "a+b"), P.AND(P.pred("Eq", "s", "50%"), P.pred("Lt", "id", 3)), P.pred("Lt", "id", 3)):
        got = archive.read(spark, path, p)
        assert got.count() == df.where(P.to_column(p)).count()
    assert files_read(archive.read(spark, path, P.pred("Eq", "s", "k=v/w"))) < files_read(archive.read(spark, path))


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(tables.ArchiveError, match="no_shared_folder"):
        storage.scratch(Session(), "x")


def rows_by_file(spark, path):
    return [r.rows for r in spark.read.parquet(f"{path}/manifest").orderBy("file").collect()]


def test_files_of_exact_rows(spark, tmp_path):
    """Files hold the rows in order of their names, so that zones have numbers over all files; equal rows have places of their own."""
    path = str(tmp_path / "a")
    df = spark.range(1000).selectExpr("cast(id * 7 % 500 as bigint) as k", "'x' as s").repartition(5)
    archive.write(df, path, archive.WriteOptions(cluster_by=("k",), file_rows=128, zone_rows=32))
    assert rows_by_file(spark, path) == [128] * 7 + [104]
    files = [r.file for r in spark.read.parquet(f"{path}/manifest").orderBy("file").collect()]
    assert [r.k for f in files for r in spark.read.parquet(f"{path}/data/{f}").collect()] == sorted(i * 7 % 500 for i in range(1000))
    e = metadata.explain(metadata.opened(spark, path), P.pred("GtEq", "k", 0))
    assert [r.start for r in metadata.file_starts(e).orderBy("file").collect()] == [128 * i for i in range(8)]
    for bad in ({"file_rows": 9}, {"file_rows": 0, "cluster_by": ("k",)}, {"file_rows": 9, "curve": ("k",)}):
        with pytest.raises(tables.ArchiveError):
            archive.write(df, str(tmp_path / "bad"), archive.WriteOptions(**bad))


def test_curve_keys_follow_their_columns(spark):
    """A key that is the same for all rows would put them into one file."""
    df = spark.range(4096).selectExpr("id % 64 as x", "cast(id div 64 as double) as y")
    for kind in ("z", "hilbert"):
        assert zones.with_curve(df, "key", ("x", "y"), kind).select("key").distinct().count() > 3000


def test_partitions_follow_the_rows(spark, tmp_path, monkeypatch):
    """However few files are asked for, none is larger than what a task may sort; rows of one key are spread, too."""
    monkeypatch.setattr(archive, "FILE_ROWS", 100)
    many = spark.range(1000).selectExpr("id", "id % 2 as k", "'x' as s")
    for name, o in (("key", {"cluster_by": ("id",), "partitions": 2}), ("hot", {"cluster_by": ("k",), "partitions": 1}), ("curve", {"curve": ("id", "k"), "partitions": 1}), ("plain", {})):
        path = str(tmp_path / name)
        archive.write(many, path, archive.WriteOptions(**o))
        held = rows_by_file(spark, path)
        assert sum(held) == 1000 and max(held) <= 100
        assert archive.read(spark, path).agg(F.sum("id")).first()[0] == 499500
    # text counts by its bytes
    monkeypatch.setattr(archive, "FILE_BYTES", 10_000)
    wide = spark.range(60).selectExpr("id", "repeat('y', 1000) as s")
    archive.write(wide, str(tmp_path / "wide"), archive.WriteOptions(cluster_by=("id",), partitions=1))
    assert len(rows_by_file(spark, str(tmp_path / "wide"))) >= 5
    # and the metadata is made file by file
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    with storage.file_by_file(spark, f"{tmp_path}/wide/data"):
        assert spark.read.parquet(f"{tmp_path}/wide/data").rdd.getNumPartitions() == len(rows_by_file(spark, str(tmp_path / "wide")))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def test_metadata_is_not_aggregated_in_one_task(spark, tmp_path):
    """The few rows of an archive's metadata are written by one task, but each partition's aggregation is a task of its own."""
    store = spark._jsc.sc().statusStore()
    page = spark._jvm.org.apache.spark.SparkEnv.get().memoryManager().pageSizeBytes()

    def stages():
        found = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    last = max((s.stageId() for s in stages()), default=-1)
    df = spark.range(2000).selectExpr("id", "concat('n', id) as s")
    archive.write(df.repartition(12), str(tmp_path / "a"))
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for s in stages():
        if s.stageId() > last and s.numCompleteTasks():
            tasks = store.taskList(s.stageId(), s.attemptId(), 1000)
            most = max(most, *(tasks.apply(i).taskMetrics().get().peakExecutionMemory() for i in range(tasks.size())))
    assert 0 < most <= 2.5 * page


def test_metadata_tables_follow_the_rows(spark, tmp_path, monkeypatch):
    """A task makes a histogram or an index of a bounded number of rows, whatever the session's shuffle partitions; one key's rows are spread, too."""
    monkeypatch.setattr(archive, "TABLE_ROWS", 100, raising=False)
    conf = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = [spark.conf.get(k) for k in conf]
    df = spark.range(1000).selectExpr("id", "7 as hot", "if(id % 10 = 0, null, id div 2) as k")
    path = str(tmp_path / "a")
    archive.write(df, path, archive.WriteOptions(cluster_by=("id",), zone_rows=50, histograms=("id", "k"), indexes=("hot", "k"), include=("id",)))
    for table in ("histograms/id", "histograms/k", "index/hot", "index/k"):
        made = spark.read.parquet(f"{path}/{table}").groupBy(F.input_file_name()).count()
        held = [r["count"] for r in made.collect()]
        assert len(held) == 10 and max(held) < 200, table
    h = spark.read.parquet(f"{path}/histograms/k")
    assert h.agg(F.sum("n")).first()[0] == 900 and h.count() == h.select("file", "zone", "key").distinct().count()
    assert [spark.conf.get(k) for k in conf] == before
    # the index is whole, and a lookup of a key in several ranges finds all its rows
    assert spark.read.parquet(f"{path}/index/k").count() == 900
    assert sorted(r.id for r in archive.lookup(spark, path, "hot", [7]).collect()) == list(range(1000))
    assert sorted(r.id for r in archive.lookup(spark, path, "k", [3, 5, 499]).collect()) == [6, 7, 11, 998, 999]
