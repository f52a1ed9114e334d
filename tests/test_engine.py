"""Rules that no single SQL text shows: proofs, guards, folds, errors."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import canonical as K
from lodestrata.functions import predicates as P
from lodestrata.operators import coverage, key_index, mapping, ordinals, projection, synopses, temporal, visibility, zones
from lodestrata.sources import archive, tables
from lodestrata.streaming import ingest


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = [(i, i // 20, rnd.choice([None, rnd.randrange(50)]), rnd.choice([None, float("nan"), rnd.random() * 10, 5.0]), rnd.choice([None, "ab", "abc", "b", "ca"])) for i in range(400)]
    return spark.createDataFrame(data, "id long, zone long, n int, x double, s string").cache()


def predicates(seed, n=40):
    rnd = random.Random(seed)

    def atom():
        c = rnd.choice("nxs")
        v = {"n": lambda: rnd.randrange(50), "x": lambda: round(rnd.random() * 10, 1), "s": lambda: rnd.choice(["a", "ab", "b", "c"])}[c]
        op = rnd.choice([*P.COMPARE, "IsNull", "IsNotNull", "Between", "InSet", *(["LikePrefix"] if c == "s" else [])])
        fields = {"IsNull": (), "IsNotNull": (), "Between": (v(), v()), "InSet": ([v(), v(), None],)}.get(op, (v(),))
        return P.pred(op, c, *fields)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            return atom()
        k = rnd.random()
        return P.NOT(tree(depth - 1)) if k < 0.25 else (P.AND if k < 0.65 else P.OR)(*(tree(depth - 1) for _ in range(2)))

    return [tree(2) for _ in range(n)]


def test_skipping_never_changes_a_result_and_certainty_holds(spark, rows):
    stats = zones.zone_stats(rows, ["zone"], ["n", "x", "s"]).cache()
    for p in predicates(2):
        want = {r.id for r in rows.where(P.to_column(p)).select("id").collect()}
        assert {r.id for r in zones.pruned_scan(rows, ["zone"], stats, p).select("id").collect()} == want, p
        whole = stats.where(zones.outcome(p) == zones.ALL).select("zone")
        assert {r.id for r in rows.join(whole, "zone", "left_semi").select("id").collect()} <= want, p


def test_normal_forms_select_the_same_rows(rows):
    for p in predicates(3, 15):
        want = rows.where(P.to_column(p)).count()
        for form in ("cnf", "dnf"):
            assert rows.where(P.to_column(P.normal_form(p, form))).count() == want, (p, form)


def test_both_forms_of_a_predicate_select_the_same_rows(spark, rows):
    for p in predicates(11, 30):
        assert P._sql(p) is not None
        assert sorted(r.id for r in rows.where(P.to_expr(p)).collect()) == sorted(r.id for r in rows.where(P.to_column(p)).collect()), p
    odd = spark.createDataFrame([(1, "it's \\ 100%"), (2, "x")], "id int, s string")
    assert odd.where(P.to_expr(P.pred("Eq", "s", "it's \\ 100%"))).count() == 1
    for v in (float("nan"), "a\nb", 2**70, None):
        assert P._sql(P.pred("Eq", "x", v)) is None


def test_order_of_conjuncts_does_not_matter(rows):
    stats = zones.zone_stats(rows, ["zone"], ["n", "s"])
    a, b = P.pred("Gt", "n", 40), P.pred("Eq", "s", "ab")
    one, two = (zones.surviving(stats, ["zone"], P.AND(*x)) for x in ((a, b), (b, a)))
    assert sorted(one.collect()) == sorted(two.collect())


def test_predicate_errors_intervals_and_language():
    for bad in ("a eq", "a is_null 3", "a like b", "eq 3"):
        with pytest.raises(tables.ArchiveError):
            P.parse_filter(bad)
    with pytest.raises(tables.ArchiveError):
        P.validate({"op": "Eq", "column": "a"})
    assert P.parse_filter("a in (1,'x',null)") == P.pred("InSet", "a", [1, "x", None])
    assert P.intervals(P.AND(P.pred("Gt", "a", 3), P.OR(P.pred("LtEq", "a", 9), P.pred("Eq", "a", 2))), "a") == [(3, 9)]
    assert P.classify(P.OR(P.pred("Eq", "a", 1), P.pred("NotEq", "a", 2))) == "unsupported"
    assert P.classify(P.AND(P.pred("Eq", "a", 1), P.pred("NotEq", "a", 2))) == "inexact"


def test_null_policy_rejects(rows):
    with pytest.raises(Exception, match="null_rejected"):
        rows.where(P.with_null_policy(P.pred("Gt", "n", 1), "NullRejected")).count()
    assert rows.where(P.with_null_policy(P.pred("Gt", "n", 1), "NullOnly")).count() == rows.where("n is null").count()


def test_metadata_answers_are_guarded(rows):
    s = synopses.build(rows, ["zone"], ["n", "s"], ["n", "s"])
    assert synopses.group_count(s, "s") is None  # null rows
    assert synopses.count_where(s, "s", ["ab"]).first().n == rows.where("s = 'ab'").count()
    assert synopses.sum_avg(s, "s") is None and synopses.count_distinct(s, "x") is None
    hidden = synopses.build(rows, ["zone"], ["n"], ["n"], redacted=frozenset("n"))
    assert synopses.count_rows(hidden).first().n == 400 and synopses.min_max(hidden, "n") is None and synopses.count_column(hidden, "n") is None
    none = synopses.build(rows.where("false"), ["zone"], ["n"])
    assert synopses.count_rows(none).first().n == 0 and synopses.sum_avg(none, "n").first().mean is None


def test_indexes_are_advisory(rows):
    i = key_index.build(rows, "n", ["zone"], "id", "v1")
    assert key_index.usable(i, "v1") and not key_index.usable(i, "v2") and not key_index.usable(None, "v1")
    with pytest.raises(tables.ArchiveError):
        key_index.usable(key_index.KeyIndex(rows.select("id"), ["zone"], "id", "v1"), "v1")
    with pytest.raises(tables.ArchiveError):
        key_index.lookup_in(i, [])
    i.exact = False
    assert key_index.aggregate(i, "count") is None
    spans = key_index.row_ranges(key_index.lookup_range(i, 10, 30), ["zone"], "id").collect()
    assert sum(r.length for r in spans) == rows.where("n between 10 and 30").count()


def test_range_algebra_against_sets(spark):
    rnd = random.Random(4)
    make = lambda: [(rnd.randrange(3), rnd.randrange(60), rnd.randrange(8)) for _ in range(25)]
    a, b = make(), make()
    schema = "f int, start long, length long"
    cells = lambda rs: {(f, s + k) for f, s, n in rs for k in range(n)}
    of = lambda df: [(r.f, r.start, r.length) for r in df.collect()]
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    one = of(coverage.coalesce_ranges(x, ["f"]))
    assert cells(one) == cells(a) and sum(r[2] for r in one) == len(cells(a))
    assert cells(of(coverage.intersect_ranges(x, y, ["f"]))) == cells(a) & cells(b)
    blocks = coverage.coarsen(x, ["f"], 4)
    assert cells(of(coverage.refine(blocks, 4).select("f", "start", "length"))) >= cells(a)
    df = spark.createDataFrame([(f, r, 9) for f in range(3) for r in range(80)], "f int, row long, start long")
    for mode, keep in (("DeletedRanges", lambda c: c not in cells(a)), ("VisibleRanges", lambda c: c in cells(a))):
        got = {(r.f, r.row) for r in visibility.apply_overlay(df, ["f"], "row", mode, x).collect()}
        assert got == {(f, r) for f in range(3) for r in range(80) if keep((f, r))}


def test_coverage_cache_and_plans(spark):
    cache, df = coverage.CoverageCache("s1"), spark.range(3)
    assert cache.get("s1", "p", "zone") is None
    assert not cache.put(df, "Heuristic", "p", "zone") and cache.put(df, "ExactTight", "p", "zone")
    assert cache.get("s1", "p", "zone") is df and cache.get("s2", "p", "zone") is None
    assert (cache.hits, cache.misses, cache.invalidated) == (1, 2, 1)
    plans = [{"name": "a", "cost": 1, "strength": "Heuristic"}, {"name": "b", "cost": 5, "strength": "ExactTight"}]
    assert coverage.choose_plan(plans, 10)["name"] == "b" and coverage.choose_plan(plans, 4)["name"] == "full_scan"


def fold(records, fresh):
    state, dead, seen = None, False, 0
    for kind, props in records:
        seen += 1
        if kind == "Tombstone":
            dead = True
            if fresh:
                state = None
            elif state is None:
                state = dict(props)
        elif kind in ("Baseline", "Snapshot") or state is None:
            state, dead = dict(props), False
        else:
            state, dead = {**state, **props}, False
    return (None if dead else state), dead, state, seen


def test_reconstruction_equals_a_sequential_fold(spark):
    rnd = random.Random(5)
    data, hist = [], {}
    for g in range(150):
        hist[str(g)] = []
        for k in range(rnd.randrange(1, 9)):
            props = {p: rnd.choice([None, str(rnd.randrange(5))]) for p in rnd.sample("abc", rnd.randrange(4))}
            kind = rnd.choice(["Baseline", "Snapshot", "Delta", "Delta", "Delta", "Tombstone"])
            hist[str(g)].append((kind, props))
            data.append(("T", "m", str(g), k // 2, k, 0, k, f"{g}.{k}", kind, props))
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "object_type string, branch_key string, goid string, timestamp_us long, csn long, segment_id long, row_index long, record_id string, kind string, properties map<string,string>")
    for fresh in (False, True):
        got = {r.goid: (dict(r.properties), r.status, r.version) for r in temporal.reconstruct(df, fresh_after_tombstone=fresh, include_tombstones=True).collect()}
        for g, rs in hist.items():
            live, dead, state, seen = fold(rs, fresh)
            assert got[g] == ((state or {}), "Tombstone" if dead else "Live", seen), (g, rs)
        alive = {r.goid for r in temporal.reconstruct(df, fresh_after_tombstone=fresh).collect()}
        assert alive == {g for g, rs in hist.items() if not fold(rs, fresh)[1]}
    linked = temporal.with_previous(df)
    assert temporal.bad_references(linked).count() == 0 == temporal.dangling_references(linked).count()
    with pytest.raises(Exception, match="legacy"):
        temporal.reconstruct(df.withColumn("kind", F.lit("Old"))).collect()


def test_little_endian_and_text_functions(spark):
    df = spark.createDataFrame([(200,), (-2,), (2**40 + 1,)], "v long")
    assert [bytes(r[0]) for r in df.select(K.le64(F.col("v"))).collect()] == [(v % 2**64).to_bytes(8, "little") for v in (200, -2, 2**40 + 1)]
    t = spark.createDataFrame([(" \tÀB c\n",), (None,)], "s string")
    assert [r[0] for r in t.select(K.canonicalise(F.col("s"), ["trim_lower"])).collect()] == ["Àb c", None]
    assert t.select(K.canonicalise(F.col("s"), ["unicode_casefold", "trim"])).first()[0] == "àb c"
    with pytest.raises(Exception, match="parse_int64"):
        t.select(K.canonicalise(F.col("s"), ["parse_int64"])).collect()
    with pytest.raises(tables.ArchiveError):
        K.canonicalise(F.col("s"), ["soundex"])


def test_null_and_empty_keys_differ(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "x")], "row_index long, key string")
    rule = mapping.Rule("r", "s", "T", (mapping.Component("k", "key"),))
    m = mapping.Mapping(bytes(16), "1", (mapping.Source("s"),), (rule,))
    assert len({r.goid for r in mapping.identities(m, {"s": df}).collect()}) == 3
    strict = mapping.Mapping(bytes(16), "1", (mapping.Source("s"),), (mapping.Rule("r", "s", "T", rule.key, null_policy="reject"),))
    with pytest.raises(Exception, match="null key"):
        mapping.identities(strict, {"s": df}).collect()


@pytest.mark.parametrize("merge_class,auto,scope", [("authoritative", None, "global"), ("authoritative", False, "row"), ("strong_deterministic", None, "row"), ("strong_deterministic", True, "global"), ("source_scoped", None, "source"), ("none", None, "row")])
def test_merge_scopes(merge_class, auto, scope):
    assert mapping.Rule("r", "s", "T", (), merge_class=merge_class, auto_merge=auto).scope() == scope


def test_mapping_is_checked():
    s, r = mapping.Source("s"), mapping.Rule("r", "s", "T", (mapping.Component("k", "key"),))
    for bad in (
        mapping.Mapping(b"", "1", (s,), (mapping.Rule("r", "other", "T", ()),)),
        mapping.Mapping(b"", "1", (s,), (r, r)),
        mapping.Mapping(b"", "1", (s,), (mapping.Rule("r", "s", "T", (mapping.Component("k", "key", "date"),)),)),
        mapping.Mapping(b"", "1", (s,), (mapping.Rule("r", "s", "T", (), kind="Thing"),)),
        mapping.Mapping(b"", "1", (s,), (mapping.Rule("a", "s", "T", (), (mapping.Property("p", "c"),)), mapping.Rule("b", "s", "T", (), (mapping.Property("p", "c", conflict="source_priority_wins"),)))),
    ):
        with pytest.raises(tables.ArchiveError):
            bad.validate()


def test_unequal_values_fail_unless_priority_decides(spark):
    rows = [("g", "p", "1", "reject_conflict", "a", "s", 0, 1, 0), ("g", "p", "2", "reject_conflict", "b", "t", 1, 2, 0), ("g", "q", None, "reject_conflict", "a", "s", 0, 1, 0), ("g", "q", "7", "reject_conflict", "b", "t", 1, 2, 0)]
    df = spark.createDataFrame(rows, "goid string, property string, value string, policy string, assertion_id string, source_id string, priority int, source_order int, row_index long")
    with pytest.raises(Exception, match="property conflict"):
        mapping.resolve(df).collect()
    fates = {(r.property, r.source_id): r.fate for r in mapping.resolve(df.withColumn("policy", F.lit("source_priority_wins"))).collect()}
    assert fates == {("p", "s"): "won", ("p", "t"): "suppressed", ("q", "s"): "null", ("q", "t"): "won"}


def test_projection_rules(spark):
    objs = spark.createDataFrame([("a", "T", {"n": "10", "s": " XÀ "}), ("b", "T", {"n": "9"}), ("c", "U", {"n": "x"})], "goid string, object_type string, properties map<string,string>")
    edges = spark.createDataFrame([("l", "a", "c", "1"), ("l", "a", "b", "2")], "type string, source_goid string, target_goid string, association_goid string")
    p, O = projection.Projector(objs, edges), projection.Output
    got = {r.id: r for r in p.project([O("id", "goid"), O("big", "T.n > 9", "boolean"), O("low", "lower(trim(T.s))"), O("sum", "sum(association(l).n)", "double"), O("avg", "avg(association(l).n)", "double"), O("ends", "association(l)", policy="list")], object_type="T").collect()}
    assert (got["a"].big, got["b"].big) == (True, False) and got["a"].low == "xÀ" and got["a"].ends == ["c", "b"]
    assert (got["b"].sum, got["b"].avg, got["b"].ends) == (0.0, None, [])
    with pytest.raises(Exception, match="more than one"):
        p.project([O("x", "association(l).n")]).collect()
    for bad in (lambda: p.project([O("x", "frob(T.n)")]), lambda: p.project([O("x", "T.n +")]), lambda: p.project([O("x", "goid", policy="any")]), lambda: p.project([O("x", "association(l)", policy="first")]), lambda: p.project([O("x", "goid")], grain="row")):
        with pytest.raises(tables.ArchiveError):
            bad()


def test_archives(spark, tmp_path, rows):
    path = str(tmp_path / "a")
    archive.write(rows, path, archive.WriteOptions(cluster_by=("n",), partition_by=("s",), bloom=("n",), partitions=3, zone_rows=32))
    assert archive.verify(spark, path).count() == 0 and archive.scan_manifest(spark, path).count() == 400
    p = P.pred("Between", "n", 5, 8)
    assert archive.read(spark, path, p).count() == rows.where("n between 5 and 8").count()
    assert archive.describe_layout(spark, path).agg(F.sum("rows")).first()[0] == 400
    import glob
    import os
    import shutil

    shutil.rmtree(f"{path}/zones")
    assert archive.read(spark, path, p).count() == rows.where("n between 5 and 8").count()
    os.remove(glob.glob(f"{path}/data/*/*.parquet")[0])
    assert [r.finding for r in archive.verify(spark, path).collect()] == ["missing"]
    with pytest.raises(tables.ArchiveError):
        archive.scan_manifest(spark, path)


def test_table_selection_and_options(spark, tmp_path):
    root = str(tmp_path)
    for n in ("x.a", "y.a", "x.b"):
        spark.range(2).write.parquet(f"{root}/table={n}")
    assert tables.scan(spark, root, table_name="b").count() == 2
    for bad in ({"table_name": "a"}, {"table_name": "z"}, {"colour": 1}, {"filter_residual_policy": "x"}):
        with pytest.raises(tables.ArchiveError):
            tables.scan(spark, root, **bad)
    assert tables.scan(spark, root, table_name="a", namespace="y").count() == 2
    spark.range(2).selectExpr("cast(id as string) id").write.parquet(f"{root}/other")
    with pytest.raises(tables.ArchiveError):
        tables.scan(spark, f"{root}/table=x.b", f"{root}/other")
    with pytest.raises(tables.ArchiveError):
        tables.scan(spark)


def test_mapping_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id, name\n\n p1 , Ada\np2,\n")
    got = tables.mapping_csv(spark, str(tmp_path / "p.csv")).orderBy("row_index").collect()
    assert [tuple(r) for r in got] == [(0, "p1", "Ada"), (1, "p2", "")]
    (tmp_path / "q.csv").write_text("id,name\np1\n")
    with pytest.raises(Exception, match="field_count"):
        tables.mapping_csv(spark, str(tmp_path / "q.csv")).collect()
    (tmp_path / "r.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    got = tables.mapping_jsonl(spark, str(tmp_path / "r.jsonl"), "id int").orderBy("row_index").collect()
    assert [tuple(r) for r in got] == [(0, 1), (2, 2)]
    assert tables.source_id("/x/people.csv") == "people" and tables.detect_format("a/b.feather") == "arrow"
    for bad in ("/x/people.parquet",):
        with pytest.raises(tables.ArchiveError):
            tables.source_id(bad)
    with pytest.raises(tables.ArchiveError):
        tables.detect_format("a.xls")


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert [tuple(r) for r in tables.read_any(spark, str(tmp_path / "t.arrow")).collect()] == [(1, "x"), (2, None)]


def test_redaction_refuses_and_features_intersect(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(Exception, match="redacted"):
        visibility.redact(df, [{"column": "b", "policy": "Refuse"}]).collect()
    visibility.check_features("scan", {"odd": {"index"}})
    with pytest.raises(tables.ArchiveError):
        visibility.check_features("lookup", {"odd": {"index"}})


def test_streams_become_snapshots_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:10"), (2, "2024-01-01 02:00:00")], "id int, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(src)
        ingest.ingest(stream, out, str(tmp_path / "cp"), keys=["id"]).awaitTermination()
    assert ingest.snapshots(spark, out).count() == 2
    assert archive.latest_snapshot(spark, out).endswith("snapshot=0")
    q = ingest.windowed_counts(spark.readStream.schema(df.schema).parquet(src), "t", "id").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id, r.n) for r in spark.sql("select * from counts").collect()} == {(1, 2), (2, 1)}


def test_joins_by_time(spark):
    from lodestrata.operators import joins

    a = spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 1, "z")], "k int, t long, v string")
    b = spark.createDataFrame([(1, 5, 10), (1, 5, 11), (1, 2, 12), (3, 0, 13)], "k int, t long, w int")
    got = {r.v: r.right_w for r in joins.asof_join(a, b, ["k"], "t").collect()}
    assert got == {"x": 11, "y": 11, "z": None}
    assert {r.v: r.right_w for r in joins.asof_join(a, b, ["k"], "t", strict=True).collect()} == {"x": 12, "y": 11, "z": None}
    spans = spark.createDataFrame([(1, 0, 6), (1, 5, 5), (1, 6, 100), (2, 2, 9)], "k int, s long, e long")
    assert {(r.v, r.s) for r in joins.interval_join(a, spans, ["k"], "t", "s", "e", 4).collect()} == {("x", 0), ("y", 6)}
    assert joins.salted_join(a, b, ["k"], 3).count() == a.join(b, "k").count()


def test_temporal_modes(spark):
    df = spark.createDataFrame([("T", "m", "g", 1, 1, 0, 0, "a", "Baseline", {"valid_from": "1"}), ("T", "m", "g", 2, 2, 0, 1, "b", "Tombstone", {})], "object_type string, branch_key string, goid string, timestamp_us long, csn long, segment_id long, row_index long, record_id string, kind string, properties map<string,string>")
    view = projection.temporal_view
    assert view(df, "latest_committed").count() == 0 and view(df, "as_of_csn:1").count() == 1 and view(df, "as_of_timestamp_us:0").count() == 0
    assert [r.place for r in view(df, "full_history").orderBy("csn").collect()] == [1, 2]
    with pytest.raises(Exception, match="no valid_from"):
        view(df, "valid_time").collect()
    with pytest.raises(tables.ArchiveError):
        view(df, "as_of_csn")


def test_synopses_prove_or_say_nothing(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (True, None)], "proves boolean, usable boolean")
    assert [r[0] for r in df.select(zones.synopsis_outcome(F.col("proves"), F.col("usable"))).collect()] == [zones.NO, zones.UNKNOWN, zones.SOME, zones.UNKNOWN]


def test_external_tables_and_partition_values(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).selectExpr("id", "case when id % 10 = 0 then null else id % 3 end as part")
    archive.write_partitioned(df, path, "part")
    tables.create_external_table(spark, "external_t", path)
    found = tables.register(spark, "view_t", path)
    assert spark.sql("select count(*) n from view_t where part = 1").first().n == df.where("part = 1").count()
    assert found.where("part is null").count() == 10
    plan = found.where("part = 1").select("id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    with pytest.raises(tables.ArchiveError):
        tables.create_external_table(spark, "external_u", path, colour=1)
    spark.sql("drop table external_t")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 7 as a", "cast(id as string) as b").write.parquet(path)
    plan = tables.scan(spark, path).where(P.to_column(P.AND(P.pred("GtEq", "a", 3), P.pred("InSet", "b", ["1", "2"])))).select("id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(a,3)" in plan and "In(b, [1,2])" in plan


def test_ordinals_are_dense(spark):
    from lodestrata.operators.ordinals import running_sum, with_ordinal

    df = spark.range(0, 10_000, 1, 5).selectExpr("cast(id % 3 as string) as f", "id as o", "1L as one")
    got = [r.n for r in with_ordinal(df, "n", "f", "o").orderBy("f", "o").collect()]
    assert got == list(range(10_000))
    sums = running_sum(df, "one", "at", ["o"], ["f"], F.expr("o div 100")).orderBy("f", "o").collect()
    assert [r["at"] for r in sums if r.f == "1"] == list(range(len([1 for r in sums if r.f == "1"])))


def test_ranges_in_parts(spark, monkeypatch):
    """Ranges ordered in parts, with islands that run through several of them, are as those of one order."""
    monkeypatch.setattr(coverage, "PART_RANGES", 7)
    rnd = random.Random(11)
    rows = [(rnd.choice((0, 1, None)), rnd.randrange(150), rnd.choice((0, 1, 1, 2))) for _ in range(120)] + [(0, 3, 60), (0, 20, 20), (2, 5, 1)]
    got = coverage.coalesce_ranges(spark.createDataFrame(rows, "f int, start long, length long"), ["f"]).collect()
    want = []
    for f in (0, 1, 2, None):
        held = sorted({s + k for g, s, n in rows if g == f for k in range(n)})
        for c in held:
            if want and want[-1][0] == f and want[-1][1] + want[-1][2] == c:
                want[-1][2] += 1
            else:
                want.append([f, c, 1])
    assert sorted(([r.f, r.start, r.length] for r in got), key=str) == sorted(want, key=str)
    held, real = [], ordinals.ranged
    monkeypatch.setattr(ordinals, "ranged", lambda *a: held.append(real(*a)) or held[-1])
    assert coverage.coalesce_ranges(spark.range(100).selectExpr("0 as f", "id * 2 as start", "1L as length"), ["f"]).count() == 100
    assert held[0].groupBy("__range").count().agg(F.max("count")).first()[0] <= 21


def test_explanations_read_kept_evidence(spark, tmp_path, monkeypatch):
    """Several questions of one evidence do not make it several times."""
    from lodestrata.plans import surfaces

    spark.range(20).selectExpr("id as c_custkey", "concat('n', id) as c_name", "cast(id % 5 as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(5).selectExpr("id as n_nationkey", "concat('m', id) as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    asked, real = [], mapping.explain
    monkeypatch.setattr(mapping, "explain", lambda e, id_: asked.append(e) or real(e, id_))
    assert [tuple(r) for r in surfaces.map_explained(spark, str(tmp_path)).collect()] == [(20, 2)]
    assert len(asked) == 3 and all("/evidence-" in f for e in asked for f in e.inputFiles())
