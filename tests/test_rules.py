"""Operators against plain joins, plain Python and each other: joins, ordinals, proofs, sketches, sources, mappings."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import canonical as K
from lodestrata.functions import predicates as P
from lodestrata.operators import coverage, joins, key_index, ordinals, synopses, temporal, zones
from lodestrata.operators import mapping as M
from lodestrata.sources import archive, copying, metadata, tables
from lodestrata.sources.tables import ArchiveError


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti", "right", "full"])
def test_salted_joins_equal_plain_joins(spark, how):
    rnd = random.Random(3)
    a = spark.createDataFrame([(rnd.choice([1, 1, 1, 1, 2, 3, 4, None]), rnd.choice("xy"), i) for i in range(300)], "k int, j string, v int").repartition(3)
    b = spark.createDataFrame([(k, j, w) for k in (1, 2, 5, None) for j in "xyz" for w in range(2)], "k int, j string, w int")
    got, want = joins.salted_join(a, b, ["k", "j"], 4, how), a.join(b, ["k", "j"], how)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    assert rows_of(joins.salted_join(a.where("false"), b, ["k", "j"], 4, how)) == rows_of(a.where("false").join(b, ["k", "j"], how))


def test_salted_join_spreads_hot_keys_alone(spark):
    a = spark.range(10_000).selectExpr("case when id < 9000 then 0 else id end as k", "id")
    b = spark.range(5).selectExpr("id as k", "id as w")
    assert joins.salted_join(a, b, ["k"], 8).count() == 9000
    with pytest.raises(ArchiveError, match="bad_join"):
        joins.salted_join(a, b, ["k"], 8, "cross")


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_by_pieces(spark, strict):
    rnd = random.Random(5)
    a = spark.createDataFrame([(rnd.choice([1, 1, 2, None]), rnd.randrange(-50, 200), i) for i in range(200)], "k int, t long, v int")
    b = spark.createDataFrame([(rnd.choice([1, 2, 3, None]), rnd.randrange(-50, 200), i) for i in range(60)], "k int, t long, w int")
    want = rows_of(joins.asof_join(a, b, ["k"], "t", strict=strict))
    for step in (1, 7, 1000):
        assert rows_of(joins.asof_join(a, b, ["k"], "t", strict=strict, step=step)) == want


def test_numbers_and_sums_over_ranges(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.randrange(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    got = {(r.g, r.o): r["at"] for r in ordinals.running_sum(df, "v", "at", ["o"], ["g"], F.expr("o div 20")).collect()}
    for g in ("a", "b", None):
        total = 0
        for _, o, v in sorted(x for x in rows if x[0] == g) if g else sorted(((x[0], x[1], x[2]) for x in rows if x[0] is None), key=lambda x: x[1]):
            assert got[(g, o)] == total
            total += v
    assert [r.n for r in ordinals.numbered(df, ["o"], "n").orderBy("o").collect()] == list(range(500))
    assert ordinals.numbered(df.where("false"), ["o"], "n").count() == 0
    assert [(r.value, r["rank"]) for r in zones.domain(df, "g").orderBy("rank").collect()] == [("a", 0), ("b", 1)]


def test_domain_proofs(spark):
    rnd = random.Random(9)
    rows = [(z, rnd.choice([None, *"abcdefgh"[z : z + 3]]) if z else "d") for z in range(6) for _ in range(20)]
    df = spark.createDataFrame(rows, "zone int, s string")
    ranges = zones.domain_rank_ranges(df, ["zone"], "s").join(df.groupBy("zone").agg(F.count_if(F.col("s").isNull()).alias("nulls")), "zone")
    ranks = zones.domain(df, "s")
    for low, high in (("b", "c"), ("c", None), (None, "a"), ("x", "z"), ("a", "h"), ("dd", "de")):
        for r in zones.domain_outcome(ranges, ranks, ["zone"], low, high).collect():
            vs = [s for z, s in rows if z == r.zone]
            hits = [s is not None and (low is None or s >= low) and (high is None or s <= high) for s in vs]
            assert r.outcome != zones.NO or not any(hits)
            assert r.outcome != zones.ALL or all(hits)
    assert {r.outcome for r in zones.domain_outcome(ranges, ranks, ["zone"], "x", "z").collect()} == {zones.NO}


def test_truncated_bounds_never_prove_equality(spark):
    values = ["apple", "applesauce", "apricot", "banana", "zebra", "zebras", "\U0010ffffx", "a"]
    df = spark.createDataFrame([(i // 2, v) for i, v in enumerate(values)] + [(9, "applesauce"), (9, "applesauce")], "zone int, s string")
    stats = zones.truncated_stats(zones.zone_stats(df, ["zone"], ["s"]), "s", 4)
    cut = frozenset(["s"])
    for p in [P.pred(op, "s", v) for op in P.COMPARE for v in ("appl", "applesauce", "zebr", "zebra", "b")] + [P.pred("LikePrefix", "s", "apple"), P.pred("Between", "s", "appl", "applf")]:
        for r in stats.select("zone", zones.outcome(p, cut).alias("o")).collect():
            hits = [x.h for x in df.where(F.col("zone") == r.zone).select(P.to_column(p).alias("h")).collect()]
            assert not (r.o == zones.NO and any(hits)), (p, r)
            assert not (r.o == zones.ALL and not all(hits) and p["op"] in ("Eq", "NotEq", "Lt", "LtEq", "Gt", "GtEq")), (p, r)


def test_zone_order_flags(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 1, 1, 2])] + [(1, i, v) for i, v in enumerate([3, 2, 2])] + [(2, 0, None)], "zone int, at int, v int")
    assert rows_of(zones.zone_order(df, ["zone"], "v", "at")) == [(0, True, 3), (1, False, 2), (2, True, 1)]


def test_quantile_sketches_merge(spark):
    rnd = random.Random(2)
    values = [rnd.gauss(0, 10) for _ in range(20_000)]
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)] + [(0, None)], "zone int, v double")
    one, two = synopses.quantile_sketch(df.where("zone < 3"), "v", ["zone"]), synopses.quantile_sketch(df.where("zone >= 3"), "v", ["zone"])
    values.sort()
    for r in synopses.quantile_estimate(one.union(two), [0.01, 0.5, 0.9]).collect():
        rank = sum(v <= r.value for v in values) / len(values)
        assert abs(rank - r.share) < 0.02
    ints = synopses.quantile_sketch(df.selectExpr("zone", "cast(v as int) as v"), "v")
    assert synopses.quantile_estimate(ints, [0.5]).first().value in (-1, 0, 1)
    assert synopses.quantile_estimate(one.where("false"), [0.5]).count() == 0
    assert synopses.may_answer("histogram", exact=True) and not synopses.may_answer("quantile_sketch", exact=True) and synopses.may_answer("quantile_sketch", exact=False) and not synopses.may_answer("thing", exact=False)
    exact = synopses.build(spark.createDataFrame([(0, "1.00005"), (0, "2.00001")], "z int, d string").selectExpr("z", "cast(d as decimal(10,5)) as d"), ["z"], ["d"])
    assert synopses.sum_avg(exact, "d").first().total == 3.00006


def test_costs_and_language(spark):
    kinds = {"a": "int", "s": "string"}
    p = P.AND(P.pred("Contains", "s", "x"), P.pred("Eq", "s", "y"), P.pred("Gt", "a", 1), P.pred("IsNull", "a"), P.pred("FunctionCall", "lower", [P.pred("ColumnRef", "s")]), P.pred("Lt", "a", 5))
    assert [x["op"] for x in P.cost_ordered(p, kinds)["items"]] == ["IsNull", "Gt", "Lt", "Eq", "Contains", "FunctionCall"]
    q = P.OR(P.NOT(P.AND(P.pred("Contains", "s", "x"), P.pred("Gt", "a", 1))), P.pred("Lt", "a", 5))
    assert P.cost_ordered(q, kinds) == P.OR(P.NOT(P.AND(P.pred("Gt", "a", 1), P.pred("Contains", "s", "x"))), P.pred("Lt", "a", 5))
    assert P.parse_filter("a in ('x, y', \"z\",3)")["values"] == ["x, y", "z", 3]
    df = spark.createDataFrame([("Ab",)], "s string")
    call = P.pred("FunctionCall", "concat", [P.pred("FunctionCall", "upper", [P.pred("ColumnRef", "s")]), P.pred("Literal", "!")])
    assert df.select(P.to_column(call)).first()[0] == "AB!"
    with pytest.raises(ArchiveError):
        P.to_column(P.pred("FunctionCall", "rand", []))


def test_tables_from_memory(spark, tmp_path):
    import io

    import pyarrow as pa
    import pyarrow.orc as orc
    import pyarrow.parquet as pq

    t = pa.table({"a": [1, 2, 3], "b": ["x", None, "z"]})
    raw = {}
    for kind, put in (("parquet", pq.write_table), ("orc", orc.write_table)):
        f = io.BytesIO()
        put(t, f)
        raw[kind] = f.getvalue()
    f = io.BytesIO()
    with pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    raw["arrow"], raw["csv"], raw["jsonl"] = f.getvalue(), b"a,b\n1,x\n", b'{"a": 1, "b": "x"}\n'
    for kind, data in raw.items():
        assert tables.read_bytes(spark, data, kind).first().a == 1
        assert tables.read_bytes(spark, io.BytesIO(data), kind).count() == (3 if kind in ("parquet", "orc", "arrow") else 1)
    assert tables.read_bytes(spark, raw["parquet"], "parquet", spark.createDataFrame([], "a string").schema).collect()[1].a == "2"
    for data, kind in ((b"nothing", "parquet"), (b"", "thing")):
        with pytest.raises(ArchiveError):
            tables.read_bytes(spark, data, kind)
    os.makedirs(tmp_path / "many.arrow")
    for i in range(3):
        (tmp_path / "many.arrow" / f"{i}.arrow").write_bytes(raw["arrow"])
    got = tables.read_any(spark, str(tmp_path / "many.arrow"))
    assert got.count() == 9 and got.schema.simpleString() == "struct<a:bigint,b:string>"


def test_copy(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 2 as k", "concat('n', id) as s").createOrReplaceTempView("copied")
    path = str(tmp_path / "out")
    assert copying.copy(spark, f"COPY copied TO '{path}' STORED AS PARQUET PARTITIONED BY (k) OPTIONS (compression 'zstd')").first()[0] == 10
    assert spark.read.parquet(path).where("k = 1").count() == 5
    assert copying.copy(spark, f"copy (SELECT id FROM copied WHERE s <> 'n3, x' AND id < 5) to '{path}.csv' OPTIONS (delimiter ';', header true)").first()[0] == 5
    assert spark.read.option("header", True).csv(f"{path}.csv").columns == ["id"]
    with pytest.raises(ArchiveError, match="exists"):
        copying.copy(spark, f"COPY copied TO '{path}' STORED AS PARQUET")
    assert copying.copy_to(spark.range(3), path, "parquet", mode="overwrite") == 3 and spark.read.parquet(path).count() == 3
    assert copying.copy_to(spark.range(3), path, "parquet", mode="append", files=1) == 3 and spark.read.parquet(path).count() == 6
    with pytest.raises(Exception, match="broken"):
        copying.copy_to(spark.range(3).select(F.raise_error(F.lit("broken")).alias("x").cast("int")), path, "parquet", mode="overwrite")
    assert spark.read.parquet(path).count() == 6
    for bad in (f"COPY copied INTO '{path}'", f"COPY copied TO '{path}2' STORED AS avro", f"COPY copied TO '{path}2' STORED AS parquet OPTIONS (colour red)", f"COPY copied TO '{path}2' STORED AS parquet PARTITIONED BY (q)", f"COPY copied TO '{path}2' STORED AS parquet OPTIONS (compression thing)"):
        with pytest.raises(ArchiveError):
            copying.copy(spark, bad)
    assert not os.path.exists(f"{path}2")


def test_unsorted_valid_and_bloom(spark):
    schema = "object_type string, branch_key string, goid string, timestamp_us long, csn long, segment_id long, row_index long, record_id string, kind string, properties map<string,string>"
    rows = [("T", b, f"g{g}", t, t, s, i, f"{b}{s}.{i}", "Baseline" if i < 2 else "Delta", {"n": f"{b}{i}", "m": "1"}) for b in ("main", "side") for s in range(4) for i, (g, t) in enumerate([(s, 1), (s + 10, 2), (s, 5 - s), (s, 9)])]
    df = spark.createDataFrame(rows, schema)
    bad = {(r.segment_id, r.row_index) for r in temporal.unsorted_records(df.where("branch_key = 'main'")).collect()}
    assert bad == {(s, i) for s in range(4) for i in (1, 2, 3) if (5 - s if i == 2 else (1, 2, 0, 9)[i]) < (5 - s if i == 3 else (1, 2, 0, 9)[i - 1])}
    bloom = temporal.segment_bloom(df)
    got = [r.record_id for r in temporal.history_of(df, "g2", bloom).collect()]
    assert got == [r.record_id for r in temporal.history_of(df, "g2").collect()] and len(got) == 6
    assert temporal.history_of(df, "nobody", bloom).count() == 0
    both = temporal.reconstruct(df).where("goid = 'g1'").collect()
    assert {(r.branch_key, r.properties["n"]) for r in both} == {("main", "main3"), ("side", "side3")}
    one = temporal.as_of(df, branch="side", csn=4).where("goid = 'g1'").first()
    assert one.branch_key == "side" and one.properties["n"] == "side2"
    part = temporal.reconstruct(df, properties=["m"]).first()
    assert set(part.properties) == {"m"}
    edges = spark.createDataFrame([("a", 1, 5), ("b", None, 3), ("c", 4, None), ("d", 5, 5)], "n string, valid_from int, valid_to int")
    assert {r.n for r in temporal.valid_at(edges, 4).collect()} == {"a", "c"} and {r.n for r in temporal.valid_at(edges, 0).collect()} == {"b"}


def test_overlap_lookup_and_row_numbers(spark):
    df = spark.createDataFrame([(i, i % 5, i, i + 3) for i in range(20)], "id long, zone long, a int, b int")
    i = key_index.KeyIndex(df.selectExpr("id as key", "zone", "id", "a", "b"), ["zone"], "id")
    got = {r.id for r in key_index.lookup_overlap(i, 5, 8, "a", "b").collect()}
    assert got == {k for k in range(20) if k < 8 and k + 3 > 5}
    numbered = archive.with_row_numbers(df, ["id"], ["zone"])
    assert all(r.n == r.id // 5 + 1 for r in numbered.collect())


def test_storable_and_fidelity(spark, tmp_path):
    df = spark.sql("select 1 as a, null as v, map(struct(1), 'x') as m, array(map('k', 1)) as l, cast('a' as char(3)) as c, interval '1' day as i, named_struct('x', null) as s")
    kept = archive.storable(df)
    assert kept.schema["v"].dataType.simpleString() == "string" and kept.schema["m"].dataType.simpleString() == "string"
    archive.write(kept.drop("s", "i"), str(tmp_path / "a"))
    assert archive.read(spark, str(tmp_path / "a")).first().l == [{"k": 1}]
    f = {r.column: r.exact for r in archive.fidelity(df.drop("c")).collect()}
    assert f["a"] and f["l"] and not f["v"]
    assert {r.column: r.exact for r in archive.fidelity(spark.sql("select parse_json('1') as p, 1.5bd as d, timestamp_ntz'2020-01-01' as t")).collect()}["d"]


def test_late_reads_and_lookups(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.range(500).selectExpr("id", "id % 50 as k", "repeat('x', 20) as wide")
    archive.write(df, path, archive.WriteOptions(cluster_by=("id",), partitions=3, indexes=("k",)))
    p = P.pred("Eq", "k", 7)
    for most in (100, 3):
        assert rows_of(archive.read_late(spark, path, p, ["id", "wide"], most=most)) == rows_of(df.where("k = 7").select("id", "wide"))
    assert rows_of(archive.lookup(spark, path, "k", [7, 8, 99])) == rows_of(df.where("k in (7, 8)"))
    assert rows_of(archive.lookup(spark, path, "id", [7])) == rows_of(df.where("id = 7"))
    i = archive.inspect(spark, path)
    assert {r.section for r in i.collect()} == {"data", "zones", "manifest", "schema", "index/k"} and i.where("section = 'data'").first().files == 3
    for policy in ("preserve", "elide_exact"):
        for q in (P.pred("Lt", "id", 300), P.pred("GtEq", "id", 0), P.AND(P.pred("Lt", "id", 300), P.pred("Contains", "wide", "x"))):
            assert rows_of(archive.read(spark, path, q, residual=policy)) == rows_of(df.where(P.to_column(q)))
    whole = archive.read(spark, path, P.pred("GtEq", "id", 0), residual="elide_exact")
    assert "Filter" not in whole._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ArchiveError):
        archive.read(spark, path, p, residual="some")


def test_conversion_report(spark, tmp_path):
    src, out = str(tmp_path / "t.parquet"), str(tmp_path / "a")
    spark.sql("select id, cast(id as decimal(9,2)) as d, timestamp'2024-01-01 00:00:00' as t, cast(null as string) as n from range(7)").write.parquet(src)
    r = archive.convert(spark, src, out, archive.WriteOptions(histograms=("id",), indexes=("id",)))
    assert (r.format, r.rows, r.lossy) == ("parquet", 7, []) and r.sections == ["data", "zones", "manifest", "schema", "histograms/id", "index/id"]
    assert {c["name"]: c["type"] for c in r.columns} == {"id": "bigint", "d": "decimal(9,2)", "t": "timestamp", "n": "string"}
    assert r.source_digest.startswith("sha256:") and r.schema_digest and r.policies["timestamp"] == "micros"
    assert json.loads(r.json())["rows"] == 7 and archive.report_rows(spark, r).count() == 4
    assert archive.TYPE_POLICIES["timestamp[ns]"][1] and archive.source_type("decimal128(9, 2)") == ("decimal(9,2)", False)


# mappings
def sample(spark):
    people = spark.createDataFrame([(0, "p1", "Ada", "t1", "2026-01-01", None, 3), (1, "p2", "Linus", "t2", "2026-02-01", "2026-12-31", 4), (2, "p3", "Grace", "t9", None, None, None)], "row_index long, pid string, name string, tid string, since string, until string, level int")
    teams = spark.createDataFrame([(0, "t1", "Core"), (1, "t2", "Systems")], "row_index long, tid string, name string")
    return {"people": people, "teams": teams}


PERSON = M.Rule("person", "people", "Person", (M.Component("id", "pid"),), (M.Property("name", "name"),))
TEAM = M.Rule("team", "teams", "Team", (M.Component("id", "tid"),), (M.Property("name", "name"),))


def mapped(*associations, rules=(PERSON, TEAM), **more):
    return M.Mapping(bytes(16), "1", (M.Source("people", 1), M.Source("teams", 2)), rules, associations, **more)


def test_association_ends_roles_and_validity(spark):
    s = sample(spark)
    a = M.Association("in", "member", "people", "person", "team", (M.Component("id", "tid"),), valid_from="since", observed_at="until", source_role="member", target_role="group", cardinality="many")
    m = mapped(a)
    ids = {(r.rule_id, r.row_index): r.goid for r in M.identities(m, s).collect()}
    got = M.associations(m, s).collect()
    assert {(r.row_index, r.source_goid, r.target_goid, r.valid_from, r.observed_at) for r in got} == {(0, ids["person", 0], ids["team", 0], "2026-01-01", None), (1, ids["person", 1], ids["team", 1], "2026-02-01", "2026-12-31")}
    assert {(r.source_role, r.target_role, r.cardinality_policy, r.source_evidence_id) for r in got} == {("member", "group", "many", f"people:{i}") for i in (0, 1)}
    with pytest.raises(Exception, match="missing end: in"):
        M.associations(mapped(M.Association("in", "member", "people", "person", "team", (M.Component("id", "tid"),), missing="reject")), s).collect()
    # without a validity to miss, and with one that is missing
    plain = mapped(M.Association("in", "member", "people", "person", "team", (M.Component("id", "tid"),)))
    assert M.associations(plain, s).count() == 2
    assert M.associations(mapped(M.Association("in", "member", "people", "person", "team", (M.Component("id", "tid"),), valid_to="until")), s).count() == 1
    # both ends in one row
    badge = M.Rule("badge", "people", "Badge", (M.Component("id", "name"),))
    same = mapped(M.Association("wears", "wears", "people", "person", "badge", ()), rules=(PERSON, TEAM, badge))
    ids = {(r.rule_id, r.row_index): r.goid for r in M.identities(same, s).collect()}
    assert {(r.source_goid, r.target_goid) for r in M.associations(same, s).collect()} == {(ids["person", i], ids["badge", i]) for i in range(3)}
    for bad in (M.Association("x", "x", "teams", "person", "team", ()), M.Association("x", "x", "people", "person", "team", ()), M.Association("x", "x", "people", "person", "team", (), missing="maybe")):
        with pytest.raises(ArchiveError):
            mapped(bad).validate()
    objs = M.association_objects(M.associations(m, s))
    assert {tuple(sorted(r.properties)) for r in objs.collect()} == {tuple(sorted(M.ASSOCIATION_PROPERTIES))}


def test_associations_to_keys_that_do_not_merge(spark):
    s = sample(spark)
    s["teams"] = s["teams"].union(spark.createDataFrame([(2, "t1", "Other core")], s["teams"].schema))
    team = M.Rule("team", "teams", "Team", (M.Component("id", "tid"),), merge_class="source_scoped")
    row = M.Rule("team", "teams", "Team", (M.Component("id", "tid"),), merge_class="none")
    for rule, n in ((team, 2), (row, 3)):
        m = mapped(M.Association("in", "member", "people", "person", "team", (M.Component("id", "tid"),)), rules=(PERSON, rule))
        assert M.associations(m, s).count() == n
        known = {r.goid for r in M.identities(m, s).where("rule_id = 'team'").collect()}
        assert {r.target_goid for r in M.associations(m, s).collect()} <= known


def test_constraints_by_every_name(spark):
    s = sample(spark)
    s["people"] = s["people"].union(spark.createDataFrame([(3, "p1", "Ada L.", "t1", None, None, None)], s["people"].schema))
    ids = M.identities(mapped(), s)
    of = {r.row_index: r for r in ids.where("rule_id = 'person'").collect()}
    for a, b in (("people:0", "people:3"), (of[0].row_digest, of[3].row_digest), ("people:0", f"person:{of[0].key_digest}"), (f"Person:{of[0].key_digest}", "people:3")):
        m = mapped(do_not_merge=((a, b),))
        assert M.check_do_not_merge(m, M.identities(m, s)).count() == 1
        with pytest.raises(ArchiveError, match="do_not_merge"):
            M.reject_merges(m, M.identities(m, s))
    fine = mapped(do_not_merge=(("people:0", "people:1"),))
    M.reject_merges(fine, M.identities(fine, s))


def test_discriminators_nulls_and_operations(spark):
    s = sample(spark)
    senior = M.Rule("senior", "people", "Senior", (M.Component("id", "pid"),), (M.Property("level", "level", nullable=False),), kind="Dispatched", when="level >= 4", operation="PatchProperty")
    gone = M.Rule("gone", "people", "Person", (M.Component("id", "pid"),), kind="Tombstone", operation="TombstoneObject", tombstone_target="source_record", when="level is null")
    m = mapped(rules=(PERSON, TEAM, senior, gone))
    ids = M.identities(m, s)
    assert {(r.rule_id, r.row_index) for r in ids.where("rule_id in ('senior', 'gone')").collect()} == {("senior", 1), ("gone", 2)}
    values = M.property_values(m, s, ids)
    assert values.where("assertion_id = 'senior.level'").first().value == "4"
    e = M.with_operations(m, M.evidence(M.objects(ids), M.resolve(values)))
    assert {(r.assertion_id, r.source_operation_kind, r.operation_effect, r.operation_target) for r in e.collect()} >= {("senior", "PatchProperty", "patch_property", "property"), ("person", "Fact", "fact", "object"), ("gone", "TombstoneObject", "tombstone_object", "source_record")}
    assert M.repeated_evidence(e).count() == 0 and M.repeated_evidence(e.union(e)).count() == e.count()
    strict = mapped(rules=(PERSON, TEAM, M.Rule("level", "people", "Level", (M.Component("id", "pid"),), (M.Property("level", "level", nullable=False),))))
    with pytest.raises(Exception, match="non-nullable"):
        M.property_values(strict, s, M.identities(strict, s)).collect()
    assert {M.Rule("r", "s", "T", (), operation=o).effect() for o in M.OPERATIONS} >= {"insert_object_state", "expire_and_create", "fact", "evidence_only"}
    for bad in (M.Rule("r", "people", "T", (), tombstone_target="object"), M.Rule("r", "people", "T", (), kind="Tombstone", tombstone_target="thing")):
        with pytest.raises(ArchiveError):
            mapped(rules=(PERSON, TEAM, bad)).validate()


def test_histories_and_explanations(spark):
    s = sample(spark)
    s["people"] = s["people"].union(spark.createDataFrame([(3, "p1", "Ada", "t1", None, None, None)], s["people"].schema))
    m = mapped()
    ids = M.identities(m, s)
    objs, values = M.objects(ids), M.property_values(m, s, ids)
    records = M.temporal_records(objs, values)
    assert records.count() == 6 and temporal.bad_references(records).count() == 0 and temporal.dangling_references(records).count() == 0
    ada = records.where("prev_ref is not null").collect()
    assert len(ada) == 1 and ada[0].row_index == 3
    states = {r.properties["name"] for r in M.object_states(objs, M.resolve(values)).collect()}
    assert states == {"Ada", "Linus", "Grace", "Core", "Systems"}
    e = M.evidence(objs, M.resolve(values))
    goid = objs.where("row_index = 1 and source_id = 'people'").first().goid
    assert M.explain(e, goid).count() == 1 and M.explain(e, "person.name").count() == 4
    with pytest.raises(ArchiveError, match="unknown_id"):
        M.explain(e, "nothing")


def test_plans_previews_and_catalogs(spark):
    maybe = M.Rule("maybe", "people", "Person", (M.Component("name", "name"),), merge_class="candidate")
    m = mapped(M.Association("in", "member", "people", "person", "team", (M.Component("id", "tid"),)), rules=(PERSON, TEAM, maybe))
    plan = M.plan_keys(m, sample(spark)).collect()
    assert len(plan) == 8 and all((r.goid is None) == (r.rule_id == "maybe") == (r.candidate_match_id is not None) == (r.canonical_anchor is None) for r in plan)
    assert {r.section: r.entries for r in M.preview(spark, m).collect()}["rules"] == 3
    assert rows_of(M.object_catalog(spark, m)) == [(1, "Association:member", "association"), (2, "Person", "object"), (3, "Team", "object")]
    c = M.property_catalog(spark, m)
    assert c.where("object_type = 'Association:member'").count() == 10 and c.where("object_type = 'Person'").first().property_id == K.property_id("name", 1)


def test_mapping_documents(spark):
    m = mapped(M.Association("in", "member", "people", "person", "team", (M.Component("id", "tid", "utf8", ("trim",)),)), do_not_merge=(("a", "b"),))
    assert M.from_document(M.to_document(m)) == m
    doc = json.loads(M.to_document(m))

    def change(f):
        d = json.loads(json.dumps(doc))
        f(d)
        return d

    for code, f in {
        "unknown_field": lambda d: d["rules"][0].update(colour=1), "missing_field": lambda d: d["rules"][0].pop("source"), "bad_field": lambda d: d["sources"][0].update(priority="high"), "undeclared_source": lambda d: d["rules"][0].update(source="z"),
    }.items():
        with pytest.raises(ArchiveError, match=code):
            M.from_document(change(f))
    for bad in ("{", "[]", {"id": "zz", "version": "1", "sources": [], "rules": []}, {"version": "1"}, {**doc, "more": 1}, {**doc, "rules": ["x"]}):
        with pytest.raises(ArchiveError):
            M.from_document(bad)


def test_source_states(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b\n1,\n")
    digest = M.byte_digest(spark, str(tmp_path / "p.csv"))
    df = spark.createDataFrame([(0, 1, None), (1, 2, "x")], "row_index long, a int, b string")
    schema = M.schema_digest(df, "csv")
    assert schema.startswith("map-schema-v1:") and schema != M.schema_digest(df, "jsonl") and schema != M.schema_digest(df.where("b is not null"), "csv") and schema == M.schema_digest(df.select("b", "a", "row_index"), "csv")
    m = mapped()
    good = [("people", schema, digest), ("teams", "s", "t")]
    M.check_replay(m, {"people": M.Declared(schema, digest, True), "teams": M.Declared()}, good)
    for code, declared, observed in (
        ("duplicate_source", {}, [*good, good[0]]), ("undeclared_source", {}, [*good, ("z", "", "")]), ("missing_source", {}, good[:1]), ("incomplete_replay", {"people": M.Declared(schema, None, True)}, good),
        ("source_state", {"people": M.Declared("other")}, good), ("source_state", {"people": M.Declared(schema, "sha256:0", True)}, good),
    ):
        with pytest.raises(ArchiveError, match=code):
            M.check_replay(m, declared, observed)
    M.check_sources({"people": M.fingerprint(df)}, {"people": df})
    for declared in ({"people": "x"}, {}):
        with pytest.raises(ArchiveError):
            M.check_sources(declared, {"people": df})


def test_digests_of_rows(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, None, 1.5)], "b int, a string, c double")
    a, b, c = (r[0] for r in df.select(K.row_digest(["b", "a", "c"])).collect())
    import hashlib

    assert a == b == hashlib.sha256(b'{"a":"x","b":1,"c":null}').hexdigest() and a != c
    got = [r[0] for r in df.select(K.row_schema_digest(dict(df.dtypes))).collect()]
    assert got[0] == hashlib.sha256(b"a:utf8|b:int64|c:null").hexdigest() and got[2] == hashlib.sha256(b"a:null|b:int64|c:float64").hexdigest()
    assert K.property_id("name", 3) == int.from_bytes(hashlib.sha256(b"name").digest()[:4], "little")
    # another tool's marker gives its digests
    marked = df.select(F.hex(K.join_key(7, "r", [("k", "utf8", F.col("a"))], marker=b"OTHER"))).first()[0]
    assert bytes.fromhex(marked).startswith(b"OTHER" + (7).to_bytes(4, "little") + (1).to_bytes(8, "little") + b"r")


def test_coverage_inspection(spark):
    cache = coverage.CoverageCache("s1")
    cache.put(spark.range(3), "ExactTight", "p", "zone")
    assert rows_of(coverage.inspect(spark, cache)) == [("s1", "p/zone", 3)]
    assert metadata.opened(spark, "/nowhere/at/all") is None


def test_key_expressions_in_both_forms(spark):
    df = spark.createDataFrame([(i, v, s, b) for i, (v, s, b) in enumerate([(1, "x", True), (-5, "", False), (2**40, "é" * 300, None), (None, None, True)])], "row_index long, v long, s string, b boolean")
    parts = [("n", "int64", "v"), ("t", "utf8", "s"), ("f", "bool", "b")]
    column = K.join_key(300, "rule", [(r, k, F.col(c)) for r, k, c in parts])
    both = df.withColumn("a", column).withColumn("k", F.expr(K.key_sql(300, "rule", parts)))
    both = both.select("a", "k", K.goid(b"\x01" * 16, "2", 300, "rule", F.col("a"), F.col("s")).alias("ga"), F.expr(K.goid_sql(b"\x01" * 16, "2", 300, "rule", "k", "s")).alias("gk"))
    for r in both.collect():
        assert r.a == r.k and r.ga == r.gk
    assert bytes(both.first().a) == b"JOIN-KEY-V1" + (300).to_bytes(4, "little") + b"\x04" + bytes(7) + b"rule" + b"\x03" + bytes(3) + b"\x01" + bytes(7) + b"n" + b"\x05" + bytes(7) + b"int64" + b"\x01\x08" + bytes(7) + (1).to_bytes(8, "little") + b"\x01" + bytes(7) + b"t" + b"\x04" + bytes(7) + b"utf8" + b"\x01\x01" + bytes(7) + b"x" + b"\x01" + bytes(7) + b"f" + b"\x04" + bytes(7) + b"bool" + b"\x01\x01" + bytes(7) + b"\x01"
    with pytest.raises(ArchiveError):
        K.key_sql(1, "r", [("x", "float64", "v")])
