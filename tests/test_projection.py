"""Projections on typed values: order, truth, roles, shapes, declarations."""

import functools
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import projection as J
from lodestrata.sources.tables import ArchiveError

O = J.Output


def variants(spark, rows, edges=None):
    """Objects from (goid, type, properties as JSON)."""
    df = spark.createDataFrame([(g, t, {k: json.dumps(v) for k, v in p.items()}) for g, t, p in rows], "goid string, object_type string, p map<string,string>")
    objs = df.select("goid", "object_type", F.transform_values("p", lambda k, v: F.parse_json(v)).alias("properties"))
    return J.Projector(objs, edges)


def order(a, b):
    """Numbers as numbers, else JSON text."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    x, y = (a, b) if number(a) and number(b) else (json.dumps(a, separators=(",", ":")), json.dumps(b, separators=(",", ":")))
    return (x > y) - (x < y)


VALUES = [None, True, False, 0, 1, 9, 10, 2.5, -3, "", "0", "9", "10", "a", "B", "false", [], [1], {}, {"k": 1}]


def test_comparison_and_truth_of_typed_values(spark):
    rows = [(f"{i}.{k}", "T", {"a": a, "b": b}) for i, a in enumerate(VALUES) for k, b in enumerate(VALUES)]
    ops = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "==", "ne": "!="}
    got = variants(spark, rows).project([O("id", "goid"), *(O(n, f"T.a {op} T.b", "boolean") for n, op in ops.items()), O("truth", "if(T.a, 'yes', 'no')")], object_type="T").collect()
    for r in got:
        i, k = map(int, r.id.split("."))
        a, b = VALUES[i], VALUES[k]
        c = order(a, b)
        assert (r.lt, r.le, r.gt, r.ge, r.eq, r.ne) == (c < 0, c <= 0, c > 0, c >= 0, c == 0, c != 0), (a, b)
        assert r.truth == ("yes" if a not in (None, False, 0, "", [], {}) or a is True else "no"), a


def test_untyped_text_and_literals(spark):
    objs = spark.createDataFrame([("a", "T", {"n": "10", "z": "0", "s": "x"})], "goid string, object_type string, properties map<string,string>")
    row = J.Projector(objs).project([O("number", "T.n > 9", "boolean"), O("quoted", "T.n > '9'", "boolean"), O("literals", '"10" > "9"', "boolean"), O("zero", "if(T.z, 1, 2)", "int"), O("same", "T.s == 'x'", "boolean"), O("none", "T.q == null", "boolean")]).first()
    assert (row.number, row.quoted, row.literals, row.zero, row.same, row.none) == (True, False, False, 1, True, True)


def test_aggregates_against_plain_python(spark):
    rnd = random.Random(4)
    pools = [[None, 1, 9, 10, 2.5, -3], [None, "9", "10", "a", ""], [None, None], [1, 1.5, 100, 20, 3]]
    rows, links, held = [(f"a{i}", "A", {}) for i in range(12)], [], {}
    for i in range(12):
        for k in range(rnd.randrange(6)):
            v = rnd.choice(pools[i % 4])
            rows.append((f"b{i}.{k}", "B", {"v": v} if rnd.random() < 0.9 else {}))
            held.setdefault(i, []).append(rows[-1][2].get("v"))
            links.append(("l", f"a{i}", f"b{i}.{k}", f"e{i}.{k}"))
    edges = spark.createDataFrame(links, "type string, source_goid string, target_goid string, association_goid string")
    names = ("count", "distinct_count", "min", "max", "sum", "avg")
    p = variants(spark, rows, edges)
    outs = [O("id", "goid"), *(O(n, f"{n}(association(l).v)") for n in names), O("edges", "count(association(l))", "int"), O("all", "list(association(l).v)"), O("has", "exists(association(l).v)", "boolean")]
    plan = p.project(outs, object_type="A")
    for r in plan.collect():
        vs = held.get(int(r.id[1:]), [])
        some = [v for v in vs if v is not None]
        nums = [v for v in some if not isinstance(v, str)]
        low, high = (sorted(some, key=functools.cmp_to_key(order))[k] if some else None for k in (0, -1))
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        assert (int(r["count"]), int(r.distinct_count)) == (len(some), len({json.dumps(v) for v in some}))
        assert (r.min, r.max) == (text(low), text(high)), vs
        assert float(r.sum) == pytest.approx(sum(nums)) and (r.avg is None) == (not nums) and r.edges == len(vs) and len(r.all) == len(vs) and r.has == bool(vs)
    # one join of the associations, however much is asked of them
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_roles(spark):
    rows = [(g, "T", {"n": g}) for g in "abc"]
    edges = spark.createDataFrame([("l", "a", "b", "1", "boss", "aide"), ("l", "b", "c", "2", "aide", "boss"), ("l", "c", "c", "3", "boss", "boss"), ("l", "a", "c", "4", None, None)], "type string, source_goid string, target_goid string, association_goid string, source_role string, target_role string")
    p = variants(spark, rows, edges)
    ask = lambda role: {r.id: r.v for r in p.project([O("id", "goid"), O("v", f"association(l{role}).n", policy="list")]).collect()}
    assert ask("") == ask(", source") == ask(", from") == {"a": ["b", "c"], "b": ["c"], "c": ["c"]}
    assert ask(", to") == ask(", target") == {"a": [], "b": ["a"], "c": ["b", "c", "a"]}
    assert ask(", boss") == {"a": ["b"], "b": [], "c": ["b", "c"]}
    assert ask(", aide") == {"a": [], "b": ["a", "c"], "c": []}
    with pytest.raises(ArchiveError, match="no_roles"):
        J.Projector(p.objects, edges.drop("source_role")).project([O("v", "association(l, boss).n", policy="list")])


def test_orderings(spark):
    assert J.ordering("a, -b ,c desc,d:asc, -e") == [("a", False), ("b", True), ("c", True), ("d", False), ("e", True)]
    with pytest.raises(ArchiveError):
        J.ordering("a,,b")
    rows = [("a", "A", {}), *((f"b{i}", "B", {"v": v, "w": w}) for i, (v, w) in enumerate([(10, "x"), (9, "y"), (9, "x"), (100, None)]))]
    edges = spark.createDataFrame([("l", "a", f"b{i}", f"{i}") for i in range(4)], "type string, source_goid string, target_goid string, association_goid string")
    p = variants(spark, rows, edges)
    ask = lambda by, policy="list": p.project([O("v", "association(l).v", "int", policy, by)], object_type="A").first().v
    assert ask("value") == [9, 9, 10, 100] and ask("value desc") == [100, 10, 9, 9]
    assert ask("B.w:desc, B.v") == [100, 9, 9, 10] or ask("B.w:desc, B.v") == [9, 9, 10, 100]
    assert ask("B.w, -value") == [10, 9, 9, 100]
    assert ask("value", "last") == 100 and ask("-value", "last") == 9


def test_types_and_shapes(spark):
    assert J.logical_type("uint64").simpleString() == "decimal(20,0)" and J.logical_type("bigint").simpleString() == "bigint"
    shape = {"type": "struct", "fields": [{"name": "a", "type": "int64"}, {"name": "b", "type": "list", "item": {"logical_type": "utf8"}}]}
    assert J.logical_type("struct", json.dumps(shape)).simpleString() == "struct<a:bigint,b:array<string>>"
    assert J.logical_type("map", {"type": "map", "key": {"type": "utf8"}, "value": {"type": "float64", "nullable": False}}).simpleString() == "map<string,double>"
    for bad in (("list", None), ("list", {"type": "struct", "fields": []}), ("map", {"type": "map", "key": {"type": "utf8"}}), ("struct", {"type": "struct"}), ("list", "{"), ("int64", {"type": "int64"}), ("list", {"type": "list", "item": {"type": "thing"}}), ("thing", None)):
        with pytest.raises(ArchiveError):
            J.logical_type(*bad)
    p = variants(spark, [("a", "T", {"x": {"a": 3, "b": ["u", "v"]}, "y": [1, 2]})])
    row = p.project([O("x", "T.x", "struct", shape=json.dumps(shape)), O("y", "T.y", "list", shape='{"type": "list", "item": {"type": "int32"}}'), O("j", "T.x", "json")]).first()
    assert row.x.a == 3 and row.x.b == ["u", "v"] and row.y == [1, 2] and json.loads(row.j) == {"a": 3, "b": ["u", "v"]}


def declared(**change):
    return J.Projection(**{"id": "p", "output_table": "t", "grain": "object", "columns": (O("id", "goid"), O("n", "lower(T.n)")), "object_type": "T", **change})


def test_declarations_are_checked(spark):
    declared().validate()
    for code, change in {
        "incomplete_projection": {"columns": ()}, "bad_grain": {"grain": "row"}, "bad_output_mode": {"modes": ("xml",)}, "bad_temporal_mode": {"temporal_mode": "as_of_csn"}, "bad_anchor": {"object_type": None, "association_type": "l"},
        "duplicate_column": {"columns": (O("a", "goid"), O("a", "goid"))}, "bad_policy": {"columns": (O("a", "goid", policy="any"),)}, "unordered_choice": {"columns": (O("a", "association(l).n", policy="last"),)},
        "bad_type": {"columns": (O("a", "goid", "thing"),)}, "bad_shape": {"columns": (O("a", "goid", "list"),)}, "undeclared_function": {"functions": ("trim",)}, "unsupported_expression": {"columns": (O("a", "frob(T.n)"),)},
        "no_executor": {"columns": (O("a", "frob(T.n)"),), "functions": ("frob",)}, "bad_arguments": {"columns": (O("a", "if(T.n, 1)"),)}, "bad_expression": {"grain": "evidence_assertion", "object_type": None},
    }.items():
        with pytest.raises(ArchiveError, match=code):
            declared(**change).validate()
    p = variants(spark, [("a", "T", {"n": "X"}), ("b", "U", {"m": "Y"})])
    assert [r.n for r in p.run(declared()).collect()] == ["x"]
    with pytest.raises(ArchiveError, match="undeclared_path"):
        p.run(declared(columns=(O("m", "T.m"),)))
    assert p.run(declared(object_type="V", columns=(O("m", "V.m"),))).count() == 0


def test_grains_modes_and_output(spark):
    schema = "object_type string, branch_key string, goid string, timestamp_us long, csn long, segment_id long, row_index long, record_id string, kind string, properties map<string,string>"
    records = spark.createDataFrame([("T", "m", "g", 1, 1, 0, 0, "r1", "Baseline", {"n": "A"}), ("T", "m", "g", 2, 2, 0, 1, "r2", "Delta", {"n": "B"})], schema)
    p = J.Projector(records)
    run = lambda **c: [tuple(r) for r in p.run(declared(**c), records).collect()]
    assert run() == [("g", "b")] and run(temporal_mode="as_of_csn:1") == [("g", "a")]
    assert run(grain="event_object", temporal_mode="full_history", columns=(O("csn", "temporal.csn", "int"), O("id", "record.id"))) == [(1, "r1"), (2, "r2")]
    versions = p.run(declared(grain="property_version", temporal_mode="commit_order"), records).collect()
    assert sorted((r.record_id, r.property, r.value) for r in versions) == [("r1", "n", "A"), ("r2", "n", "B")]
    evidence = spark.createDataFrame([("x", "object")], "assertion_id string, output_kind string")
    out = p.run(declared(grain="evidence_assertion", object_type=None, columns=(O("a", "evidence.assertion_id"), O("b", "evidence.other"))), evidence=evidence)
    assert [tuple(r) for r in out.collect()] == [("x", None)]
    rows = p.run(declared(), records)
    assert [r.json for r in J.render(rows, "json", "t").collect()] == ['{"id":"g","n":"b"}']
    assert J.render(rows, "arrow", "t").to_pylist() == [{"id": "g", "n": "b"}]
    assert [r.kind for r in J.render(rows, "sql", "t").collect()] == ["create", "insert"]
    with pytest.raises(ArchiveError):
        J.render(rows, "xml", "t")


def test_aggregates_of_own_values(spark):
    p = variants(spark, [("a", "T", {"n": 4}), ("b", "T", {})])
    got = {r.id: (r.c, r.s, r.m, r.l) for r in p.project([O("id", "goid"), O("c", "count(T.n)", "int"), O("s", "sum(T.n)", "double"), O("m", "max(T.n)", "int"), O("l", "list(T.n)", "int")]).collect()}
    assert got == {"a": (1, 4.0, 4, [4]), "b": (0, 0.0, None, [None])}
