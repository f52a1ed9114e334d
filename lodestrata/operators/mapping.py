"""From rows of several sources to identified objects, associations and evidence.

A key joins at most one merge group, and a group's id depends on nothing but
its own key and scope. So identities need no graph: the object id is an
expression over one row, and groups are rows with equal ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import MISSING, asdict, dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import canonical as K
from lodestrata.sources.tables import ArchiveError

OBJECT_KINDS = ("Object", "EventObject", "LinkObject", "Composite", "Dispatched", "KeyValueFragment", "Tombstone")
NO_OBJECT_KINDS = ("AssociationOnly", "EvidenceOnly", "ProjectionOnly")
ASSOCIATION_KINDS = tuple(k for k in (*OBJECT_KINDS, "AssociationOnly") if k != "Tombstone")
CLASSES = ("authoritative", "strong_deterministic", "source_scoped", "candidate", "none")
OPERATIONS = {
    **dict.fromkeys(("Fact", "Insert", "Upsert", "EvidenceOnly"), None),
    **dict.fromkeys(("PatchProperty", "CloseAssociation", "ExpireAndCreate", "RedactEvidence", "Correction"), "Delta"),
    "ReplaceObjectState": "Snapshot",
    **dict.fromkeys(("TombstoneObject", "TombstoneProperty", "TombstoneAssociation"), "Tombstone"),
}
#: What an operation does to its target, where it is not its own name in snake case, and what that is, where it is not an object.
_EFFECTS = {"Insert": "insert_object_state", "Upsert": "upsert_object_state"}
_TARGETS = {**dict.fromkeys(("PatchProperty", "TombstoneProperty"), "property"), **dict.fromkeys(("CloseAssociation", "TombstoneAssociation"), "association"), **dict.fromkeys(("RedactEvidence", "EvidenceOnly"), "evidence")}
TOMBSTONE_TARGETS = ("object", "property", "association", "source_record", "evidence")
CONFLICT_POLICIES = ("reject_conflict", "source_priority_wins")


@dataclass(frozen=True)
class Source:
    id: str
    priority: int = 100  #: lower wins
    label: str = "public"
    rank: int = 0  #: higher is stricter
    policies: tuple[str, ...] = ()


@dataclass(frozen=True)
class Component:
    role: str
    column: str
    kind: str = "utf8"
    functions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Property:
    name: str
    column: str
    missing: str = "null"  #: or reject
    conflict: str = "reject_conflict"
    nullable: bool = True


@dataclass(frozen=True)
class Rule:
    """How rows of one source become objects of one type."""

    id: str
    source: str
    object_type: str
    key: tuple[Component, ...]
    properties: tuple[Property, ...] = ()
    kind: str = "Object"
    merge_class: str = "authoritative"
    auto_merge: bool | None = None
    null_policy: str = "marker"
    candidate_only: bool = False
    operation: str = "Fact"
    record_kind: str = "Baseline"
    when: str | None = None  #: SQL over the source row: only these rows are the rule's (discriminators, fragments)
    tombstone_target: str | None = None

    def scope(self) -> str:
        """global, source or row: how far equal keys mean one object."""
        if self.merge_class == "authoritative":
            return "row" if self.auto_merge is False else "global"
        if self.merge_class == "strong_deterministic":
            return "global" if self.auto_merge else "row"
        return "source" if self.merge_class == "source_scoped" else "row"

    def candidate(self) -> bool:
        return self.candidate_only or self.merge_class == "candidate"

    def commits(self) -> str:
        """The kind of temporal record that its operation makes."""
        return OPERATIONS[self.operation] or self.record_kind

    def effect(self) -> str:
        return _EFFECTS.get(self.operation) or re.sub(r"(?<=[a-z])(?=[A-Z])", "_", self.operation).lower()

    def target(self) -> str:
        return self.tombstone_target or _TARGETS.get(self.operation, "object")


@dataclass(frozen=True)
class Association:
    """Links from the object that one rule finds in a row to the object with an equal key under another rule.

    Without a ``to_key`` the other rule is one of the same source and finds its object in the same row.
    A validity that is declared and missing in a row counts like a missing end.
    """

    id: str
    type: str
    source: str
    from_rule: str
    to_rule: str
    to_key: tuple[Component, ...]
    missing: str = "skip"  #: or reject
    valid_from: str | None = None
    valid_to: str | None = None
    observed_at: str | None = None
    source_role: str = ""
    target_role: str = ""
    cardinality: str = "one"


@dataclass(frozen=True)
class Mapping:
    id: bytes
    version: str
    sources: tuple[Source, ...]
    rules: tuple[Rule, ...]
    associations: tuple[Association, ...] = ()
    functions: tuple[str, ...] = tuple(K.FUNCTIONS)
    do_not_merge: tuple[tuple[str, str], ...] = ()

    def types(self) -> dict[str, int]:
        """Object types and ``Association:<type>`` names, in byte order, numbered from 1."""
        names = {r.object_type for r in self.rules} | {f"Association:{a.type}" for a in self.associations}
        return {n: i for i, n in enumerate(sorted(names, key=str.encode), 1)}

    def validate(self) -> Mapping:
        """The mapping itself; the first thing wrong with it is an error."""
        known, rules = {s.id for s in self.sources}, {r.id for r in self.rules}
        if len(known) != len(self.sources) or len(rules) != len(self.rules):
            raise ArchiveError("duplicate_id", "source or rule")
        policy: dict[tuple[str, str], str] = {}
        for r in self.rules:
            if r.source not in known:
                raise ArchiveError("undeclared_source", r.source)
            if r.tombstone_target is not None and (r.kind != "Tombstone" or r.tombstone_target not in TOMBSTONE_TARGETS):
                raise ArchiveError("bad_tombstone_target", r.id)
            if r.kind not in OBJECT_KINDS + NO_OBJECT_KINDS or r.merge_class not in CLASSES or r.operation not in OPERATIONS:
                raise ArchiveError("bad_rule", r.id)
            for c in r.key:
                if c.kind not in K.KEY_TYPES:
                    raise ArchiveError("bad_key_type", c.kind)
                if missing := [f for f in c.functions if f not in self.functions]:
                    raise ArchiveError("undeclared_function", missing[0])
            for p in r.properties:
                if p.conflict not in CONFLICT_POLICIES:
                    raise ArchiveError("bad_conflict_policy", p.conflict)
                if policy.setdefault((r.object_type, p.name), p.conflict) != p.conflict:
                    raise ArchiveError("mixed_conflict_policies", p.name)
            if len({p.name for p in r.properties}) != len(r.properties):
                raise ArchiveError("duplicate_property", r.id)
        for a in self.associations:
            if a.from_rule not in rules or a.to_rule not in rules or a.source not in known or a.missing not in ("skip", "reject"):
                raise ArchiveError("bad_association", a.id)
            sources = {r.id: r.source for r in self.rules}
            if sources[a.from_rule] != a.source or not a.to_key and sources[a.to_rule] != a.source:
                raise ArchiveError("bad_association_end", a.id)
        return self


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _text(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with_key(m: Mapping, r: Rule, rows: DataFrame, components: tuple[Component, ...], null_policy: str, out: str) -> DataFrame:
    """Rows with the canonical parts of a rule's key as columns, and the key's byte tuple in column ``out``."""
    cells = {}
    for i, c in enumerate(components):
        v = K.canonicalise(F.col(c.column).cast("string"), list(c.functions), list(m.functions)) if c.functions else F.col(c.column)
        if null_policy == "reject":
            v = F.when(v.isNotNull(), v).otherwise(F.raise_error(F.lit(f"null key component: {r.id}.{c.role}")).cast("string"))
        cells[f"{out}_{i}"] = v
    kept = rows.withColumns(cells) if cells else rows
    made = K.key_sql(m.types()[r.object_type], r.id, [(c.role, c.kind, f"{out}_{i}") for i, c in enumerate(components)])
    return kept.withColumn(out, F.expr(made))


def _goid(m: Mapping, r: Rule, key: str) -> str:
    """SQL of the id of a row's object under a rule, from its key's column; null for candidates. It is an expression over the row."""
    scope = {"global": "''", "source": _text(r.source), "row": f"concat_ws(':', {_text(r.source)}, cast(row_index as string))"}[r.scope()]
    return "cast(null as string)" if r.candidate() else K.goid_sql(m.id, m.version, m.types()[r.object_type], r.id, key, scope)


def _rows(r: Rule, sources: dict[str, DataFrame]) -> DataFrame:
    """The source rows of a rule."""
    if r.source not in sources:
        raise ArchiveError("missing_source", r.source)
    return sources[r.source] if r.when is None else sources[r.source].where(r.when)


def identities(m: Mapping, sources: dict[str, DataFrame]) -> DataFrame:
    """One row for each source row under each of its rules: source_id, row_index, rule_id, object_type, kind, key_tuple, key_digest, goid, candidate, the row's digest, and the order of its group's anchor."""
    m.validate()
    order = {s.id: i for i, s in enumerate(m.sources)}
    if missing := sorted(set(sources) - {r.source for r in m.rules}):
        raise ArchiveError("no_rule", missing[0])
    parts = []
    for i, r in enumerate(m.rules):
        rows = _rows(r, sources)
        names = sorted(c for c in rows.columns if c != "row_index")
        row_json = f"to_json(struct({', '.join(f'`{c}`' for c in names)}), map('ignoreNullFields', 'false'))" if names else "'{}'"
        keyed = _with_key(m, r, rows, r.key, r.null_policy, "__key")
        parts.append(
            keyed.selectExpr(
                f"{_text(r.source)} as source_id", "cast(row_index as bigint) as row_index", f"{_text(r.id)} as rule_id", f"{_text(r.object_type)} as object_type", f"{_text(r.kind)} as kind", f"{_text(r.commits())} as record_kind",
                "__key as key_tuple", f"{str(r.candidate()).lower()} as candidate", f"{CLASSES.index(r.merge_class)} as class_rank", f"{i} as rule_order", f"{order[r.source]} as source_order",
                f"sha2({row_json}, 256) as row_digest", "sha2(__key, 256) as key_digest", f"{_goid(m, r, '__key')} as goid",
            )
        )
    return _union(parts)


def objects(ids: DataFrame) -> DataFrame:
    """One row for each row and rule that makes an object; candidates make none."""
    made = ids.where(~F.col("candidate") & F.col("kind").isin(*OBJECT_KINDS))
    return made.withColumn("record_id", K.record_id(F.col("source_id"), F.col("row_index"), F.col("rule_id"), F.col("goid")))


def candidates(ids: DataFrame) -> DataFrame:
    return ids.where("candidate").select("source_id", "row_index", "rule_id", "key_digest")


def equivalences(ids: DataFrame) -> DataFrame:
    """(goid, anchor, member): rows of every object, the anchor being the first by class, rule, source, key and row."""
    rows = ids.where("not candidate").withColumn("member", F.concat_ws(":", "source_id", F.col("row_index").cast("string")))
    anchors = rows.groupBy("goid").agg(F.min_by("member", F.struct("class_rank", "rule_order", "source_order", "key_tuple", "row_index", "member")).alias("anchor"))
    return rows.select("goid", "member").distinct().join(anchors, "goid").select("goid", "anchor", "member")


def check_do_not_merge(m: Mapping, ids: DataFrame) -> DataFrame:
    """Objects that hold both sides of a constraint, named by row (source:row), row digest, key (rule:digest) or key of a type (type:digest)."""
    if not m.do_not_merge:
        return ids.select("goid").limit(0).select("goid", F.lit("").alias("a"), F.lit("").alias("b"))
    spark = ids.sparkSession
    pairs = spark.createDataFrame(list(m.do_not_merge), "a string, b string")
    sides = sorted({x for pair in m.do_not_merge for x in pair})
    names = [F.concat_ws(":", "source_id", F.col("row_index").cast("string")), F.concat_ws(":", "rule_id", "key_digest"), F.concat_ws(":", "object_type", "key_digest")]
    if "row_digest" in ids.columns:
        names.append(F.col("row_digest"))
    # only names that some constraint has go on
    alias = ids.where("not candidate").select("goid", F.explode(F.array(*names)).alias("n")).where(F.col("n").isin(sides)).distinct()
    a = alias.join(F.broadcast(pairs), F.col("n") == F.col("a")).select("goid", "a", "b")
    return a.join(alias.withColumnRenamed("n", "b"), ["goid", "b"]).select("goid", "a", "b").distinct()


def reject_merges(m: Mapping, ids: DataFrame) -> None:
    """An error if any object holds both sides of a constraint."""
    if first := check_do_not_merge(m, ids).first():
        raise ArchiveError("do_not_merge", f"{first.a} <-> {first.b}")


def property_values(m: Mapping, sources: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """Long form: goid, object_type, property, value, policy, and who asserts it."""
    rank = {s.id: (s.priority, i) for i, s in enumerate(m.sources)}
    parts = []
    for r in m.rules:
        if r.candidate() or r.kind not in OBJECT_KINDS or not r.properties:
            continue
        cells = []
        for p in r.properties:
            v = F.col(p.column).cast("string")
            if p.missing == "reject":
                v = F.when(v.isNotNull(), v).otherwise(F.raise_error(F.lit(f"missing property: {r.id}.{p.name}")).cast("string"))
            if not p.nullable:
                v = F.when(v.isNotNull(), v).otherwise(F.raise_error(F.lit(f"null in non-nullable property: {r.id}.{p.name}")).cast("string"))
            cells.append(F.struct(F.lit(p.name).alias("property"), v.alias("value"), F.lit(p.conflict).alias("policy"), F.lit(f"{r.id}.{p.name}").alias("assertion_id")))
        own = _rows(r, sources).select(F.col("row_index").cast("long"), F.explode(F.array(*cells)).alias("c")).select("row_index", "c.*")
        mine = ids.where((F.col("rule_id") == r.id)).select("goid", "object_type", "row_index")
        parts.append(own.join(mine, "row_index").withColumns({"source_id": F.lit(r.source), "priority": F.lit(rank[r.source][0]), "source_order": F.lit(rank[r.source][1])}))
    return _union(parts)


def conflicts(values: DataFrame) -> DataFrame:
    """(goid, property, kinds): properties under ``reject_conflict`` with unequal non-null values."""
    return values.where("value is not null and policy = 'reject_conflict'").groupBy("goid", "property").agg(F.count_distinct("value").alias("kinds")).where("kinds > 1")


def resolve(values: DataFrame) -> DataFrame:
    """All assertions with their fate: won, equal, suppressed (a higher priority won) or null (nulls never overwrite).

    Unequal values under ``reject_conflict`` fail the job.
    """
    order = F.struct("priority", "source_order", "row_index", "assertion_id", "source_id")
    some = F.when(F.col("value").isNotNull(), order)
    best = values.groupBy("goid", "property").agg(F.min(some).alias("__first"), F.min_by("value", some).alias("__winner"), (F.min("value") != F.max("value")).alias("__unequal"))
    clash = (F.col("policy") == "reject_conflict") & F.col("__unequal")
    fate = (
        F.when(clash, F.raise_error(F.concat(F.lit("property conflict: "), "property")).cast("string"))
        .when(F.col("value").isNull(), "null").when(order == F.col("__first"), "won").when(F.col("value") == F.col("__winner"), "equal").otherwise("suppressed")
    )
    return values.join(best, ["goid", "property"]).withColumn("fate", fate).drop("__first", "__winner", "__unequal")


def object_states(objs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(goid, object_type, properties): one merged row for each object, of the winning values."""
    won = resolved.where("fate = 'won'").groupBy("goid").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("property", "value")))).alias("properties"))
    empty = F.create_map().cast("map<string,string>")
    return objs.select("goid", "object_type").distinct().join(won, "goid", "left").select("goid", "object_type", F.coalesce("properties", empty).alias("properties"))


#: Properties that every association has.
ASSOCIATION_PROPERTIES = ("source_goid", "target_goid", "association_type", "mapping_rule_id", "source_evidence_id", "source_role", "target_role", "valid_from", "valid_to", "cardinality_policy")


def associations(m: Mapping, sources: dict[str, DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """(association_id, type, association_goid, source_goid, target_goid, source_id, row_index, roles, validity, source_evidence_id, cardinality_policy).

    Both ends are expressions over the row that makes the association; what is looked
    up is only whether the target's key is known, and which objects have it where equal
    keys are not one object. ``ids`` is not needed.
    """
    rules = {r.id: r for r in m.rules}
    parts = []
    for a in m.associations:
        source, target = rules[a.from_rule], rules[a.to_rule]
        if source.kind not in ASSOCIATION_KINDS or source.candidate():
            continue
        fail = lambda what, a=a: F.raise_error(F.lit(f"missing {what}: {a.id}")).cast("string")
        same_row = not a.to_key
        keyed = _with_key(m, source, _rows(source, sources), source.key, source.null_policy, "__own")
        keyed = _with_key(m, target, keyed, target.key if same_row else a.to_key, "marker", "__to")
        made = _goid(m, target, "__to") if same_row or target.scope() == "global" else "cast(null as string)"
        cells = [f"cast({f'`{c}`' if (c := getattr(a, n)) else 'null'} as string) as {n}" for n in ("valid_from", "valid_to", "observed_at")]
        rows = keyed.selectExpr("cast(row_index as bigint) as row_index", f"{_goid(m, source, '__own')} as source_goid", "sha2(__to, 256) as key_digest", f"{made} as made", *cells)
        if same_row:
            found = rows.withColumnRenamed("made", "target_goid")
        else:
            known = _with_key(m, target, _rows(target, sources), target.key, "marker", "__to").selectExpr("sha2(__to, 256) as key_digest", f"{_goid(m, target, '__to')} as known")
            if target.scope() == "global":
                # equal keys are one object, whose id the row itself tells
                known = known.selectExpr("key_digest", "true as has").distinct()
                found = rows.join(known, "key_digest", "left").withColumn("target_goid", F.expr("if(has, made, null)"))
            else:
                found = rows.join(known.distinct(), "key_digest", "left").withColumnRenamed("known", "target_goid")
        ends = [("target_goid", "end"), *((c, c) for c in ("valid_from", "valid_to") if getattr(a, c))]
        for c, what in ends:
            if a.missing == "reject":
                found = found.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(fail(what)))
            else:
                found = found.where(F.col(c).isNotNull())
        goid = f"substring(sha2(concat_ws('|', '{m.id.hex()}', {_text(a.type)}, {_text(a.id)}, source_goid, target_goid), 256), 1, 32)"
        parts.append(
            found.where("target_goid is not null").selectExpr(
                f"{_text(a.id)} as association_id", f"{_text(a.type)} as type", f"{goid} as association_goid", "source_goid", "target_goid", f"{_text(a.source)} as source_id", "row_index", "valid_from", "valid_to", "observed_at",
                f"{_text(a.source_role)} as source_role", f"{_text(a.target_role)} as target_role", f"concat_ws(':', {_text(a.source)}, cast(row_index as string)) as source_evidence_id", f"{_text(a.cardinality)} as cardinality_policy",
            )
        )
    if not parts:
        raise ArchiveError("no_associations", m.version)
    return _union(parts)


def association_objects(links: DataFrame) -> DataFrame:
    """Associations as objects (goid, object_type, properties) of type ``Association:<type>``, with the properties that all have."""
    names = {"association_type": "type", "mapping_rule_id": "association_id"}
    cells = [x for p in ASSOCIATION_PROPERTIES for x in (F.lit(p), F.col(names.get(p, p)).cast("string"))]
    return links.select(F.col("association_goid").alias("goid"), F.concat(F.lit("Association:"), "type").alias("object_type"), F.create_map(*cells).alias("properties"))


def evidence(objs: DataFrame, resolved: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(assertion_id, output_kind, output_id, source_id, row_index, note) for everything that was made or suppressed."""
    parts = [
        objs.select(F.col("rule_id").alias("assertion_id"), F.lit("object").alias("output_kind"), F.col("goid").alias("output_id"), "source_id", "row_index", F.lit(None).cast("string").alias("note")),
        resolved.select("assertion_id", F.lit("property").alias("output_kind"), F.concat_ws(".", "goid", "property").alias("output_id"), "source_id", "row_index", F.when(F.col("fate") == "null", "null_does_not_overwrite_non_null").when(F.col("fate") == "suppressed", "lower_priority").alias("note")),
    ]
    if links is not None:
        parts.append(links.select(F.col("association_id").alias("assertion_id"), F.lit("association").alias("output_kind"), F.col("association_goid").alias("output_id"), "source_id", "row_index", F.lit(None).cast("string").alias("note")))
    return _union(parts)


def with_operations(m: Mapping, evidence_: DataFrame) -> DataFrame:
    """Evidence with the operation of the rule that made it: source_operation_kind, operation_effect, operation_target."""
    rows = [(x, r.operation, r.effect(), r.target()) for r in m.rules for x in (r.id, *(f"{r.id}.{p.name}" for p in r.properties), *(a.id for a in m.associations if a.from_rule == r.id))]
    dim = evidence_.sparkSession.createDataFrame(rows, "assertion_id string, source_operation_kind string, operation_effect string, operation_target string").dropDuplicates(["assertion_id"])
    return evidence_.join(F.broadcast(dim), "assertion_id", "left")


def repeated_evidence(evidence_: DataFrame) -> DataFrame:
    """(assertion_id, output_kind, output_id, source_id, row_index, n) of evidence that is there more than once; there should be none."""
    return evidence_.groupBy("assertion_id", "output_kind", "output_id", "source_id", "row_index").agg(F.count("*").alias("n")).where("n > 1")


def explain(evidence_: DataFrame, id_: str) -> DataFrame:
    """The evidence of an assertion or of an output; an unknown id is an error."""
    found = evidence_.where((F.col("assertion_id") == id_) | (F.col("output_id") == id_))
    if not found.limit(1).count():
        raise ArchiveError("unknown_id", id_)
    return found


def governance(m: Mapping, objs: DataFrame, reject_mixed: bool = False) -> DataFrame:
    """(goid, rank, labels, policies): the strictest rank of an object's sources, labels at it, all policies."""
    spark = objs.sparkSession
    dim = spark.createDataFrame([(s.id, s.label, s.rank, list(s.policies)) for s in m.sources], "source_id string, label string, rank int, policies array<string>")
    all_ = objs.select("goid", "source_id").distinct().join(F.broadcast(dim), "source_id")
    top = all_.groupBy("goid").agg(F.max("rank").alias("rank"), F.min("rank").alias("low"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("policies")))).alias("policies"), F.collect_set(F.struct("rank", "label")).alias("pairs"))
    labels = F.sort_array(F.transform(F.filter("pairs", lambda x: x["rank"] == F.col("rank")), lambda x: x["label"]))
    if reject_mixed:
        top = top.withColumn("rank", F.when(F.col("low") == F.col("rank"), F.col("rank")).otherwise(F.raise_error(F.lit("mixed sensitivity")).cast("int")))
    return top.select("goid", "rank", labels.alias("labels"), "policies")


def operation_counts(m: Mapping, ids: DataFrame) -> DataFrame:
    """Rows by rule, source operation and the kind of record that it makes."""
    spark = ids.sparkSession
    dim = spark.createDataFrame([(r.id, r.operation) for r in m.rules], "rule_id string, operation string")
    return ids.join(F.broadcast(dim), "rule_id").groupBy("operation", "record_kind").agg(F.count("*").alias("n"))


def report(m: Mapping, ids: DataFrame, values: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row of counts."""
    one = ids.agg(
        F.lit(len(m.sources)).cast("long").alias("sources"), F.count_distinct("source_id", "row_index").alias("rows"), F.count_if(~F.col("candidate") & F.col("kind").isin(*OBJECT_KINDS)).alias("materialised"),
        F.count_distinct("goid").alias("objects"), F.count_if("candidate").alias("candidates"),
    )
    out = one.join(F.broadcast(values.agg(F.count("value").alias("property_values"))))
    n = links.agg(F.count("*").alias("associations")) if links is not None else ids.sparkSession.range(1).select(F.lit(0).cast("long").alias("associations"))
    return out.join(F.broadcast(n))


def temporal_records(objs: DataFrame, values: DataFrame, *, timestamp_us: int = 0, csn: int = 1, branch: str = "main") -> DataFrame:
    """Objects as temporal records, with a map of the values that their own row asserts and the record before them."""
    from .temporal import with_previous

    own = values.groupBy("goid", "source_id", "row_index").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("property", "value")))).alias("properties"))
    empty = F.create_map().cast("map<string,string>")
    rows = objs.join(own, ["goid", "source_id", "row_index"], "left").select(
        "object_type", F.lit(branch).alias("branch_key"), "goid", F.lit(timestamp_us).cast("long").alias("timestamp_us"), F.lit(csn).cast("long").alias("csn"), F.col("source_order").cast("long").alias("segment_id"), "row_index", "record_id", F.col("record_kind").alias("kind"), F.coalesce("properties", empty).alias("properties"),
    )
    return with_previous(rows)


def fingerprint(df: DataFrame) -> str:
    """Sorted field:type text of a source's rows."""
    return "|".join(sorted(f"{n}:{t}" for n, t in df.dtypes if n != "row_index"))


def check_sources(declared: dict[str, str], sources: dict[str, DataFrame]) -> None:
    """Every declared source is there with its fingerprint, and nothing else is."""
    if extra := sorted(set(sources) ^ set(declared)):
        raise ArchiveError("source_set", extra[0])
    for s, want in declared.items():
        if (got := fingerprint(sources[s])) != want:
            raise ArchiveError("source_fingerprint", f"{s}: {got}")


def schema_digest(df: DataFrame, kind: str, prefix: str = "map-schema-v1") -> str:
    """``prefix:sha256`` over the source's kind and its sorted ``field:kinds`` as observed: null, bool, int, float, string, list, object."""
    names = sorted(c for c in df.columns if c != "row_index")

    def kind_of(t: str) -> str:
        if t in ("tinyint", "smallint", "int", "bigint"):
            return "int"
        if t in ("double", "float") or t.startswith("decimal"):
            return "float"
        return {"boolean": "bool", "void": "null"}.get(t) or ("list" if t.startswith("array") else "object" if t.startswith(("struct", "map")) else "string")

    kinds = dict(df.dtypes)
    seen = df.agg(*(F.struct(F.max(F.col(f"`{c}`").isNull()).alias("n"), F.max(F.col(f"`{c}`").isNotNull()).alias("v")).alias(f"k{i}") for i, c in enumerate(names))).first() if names else []
    fields = []
    for c, k in zip(names, seen):
        found = ({"null"} if k.n else set()) | ({kind_of(kinds[c])} if k.v else set())
        if found:
            fields.append(f"{c}:{','.join(sorted(found))}")
    return f"{prefix}:{hashlib.sha256((kind + chr(10) + '|'.join(fields)).encode()).hexdigest()}"


def byte_digest(spark: SparkSession, path: str) -> str:
    """``sha256:<hex>`` of a source file's bytes; the file is read by one task, whole."""
    return "sha256:" + spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


@dataclass(frozen=True)
class Declared:
    """What a mapping says of a source's state; ``replay``: both digests are needed and must hold."""

    schema: str | None = None
    snapshot: str | None = None
    replay: bool = False


def check_replay(m: Mapping, declared: dict[str, Declared], observed: list[tuple[str, str, str]]) -> None:
    """Observed (source, schema digest, byte digest) against what is declared: a source that is unknown, given twice, missing where rules or a replay need it, or in another state is an error."""
    known, seen = {s.id for s in m.sources}, {}
    for source, schema, snapshot in observed:
        if source in seen:
            raise ArchiveError("duplicate_source", source)
        if source not in known:
            raise ArchiveError("undeclared_source", source)
        seen[source] = schema, snapshot
        want = declared.get(source, Declared())
        if want.replay and not (want.schema and want.snapshot):
            raise ArchiveError("incomplete_replay", source)
        for have, should in ((schema, want.schema), (snapshot, want.snapshot)):
            if should is not None and have != should:
                raise ArchiveError("source_state", f"{source}: {have}")
    needed = {r.source for r in m.rules} | {s for s, d in declared.items() if d.replay}
    if missing := sorted(needed - set(seen)):
        raise ArchiveError("missing_source", missing[0])


def preview(spark: SparkSession, m: Mapping) -> DataFrame:
    """(section, entries, ids) of a mapping."""
    rows = [("sources", [s.id for s in m.sources]), ("rules", [r.id for r in m.rules]), ("associations", [a.id for a in m.associations]), ("object_types", sorted(m.types(), key=str.encode)), ("functions", list(m.functions)), ("do_not_merge", [f"{a} <-> {b}" for a, b in m.do_not_merge])]
    return spark.createDataFrame([(n, len(x), x) for n, x in rows], "section string, entries int, ids array<string>")


def plan_keys(m: Mapping, sources: dict[str, DataFrame]) -> DataFrame:
    """Every row's key under every rule, before anything is made: identities with their anchor, and candidate matches with an id of their own."""
    ids = identities(m, sources)
    row = F.concat_ws(":", "source_id", F.col("row_index").cast("string"))
    anchors = equivalences(ids).select("goid", "anchor").distinct()
    out = ids.withColumn("source_row_identity", row).withColumn("identity_alias", F.concat_ws(":", "rule_id", "key_digest")).join(anchors, "goid", "left")
    match = F.when(F.col("candidate"), F.substring(F.sha2(F.concat_ws("|", row, "rule_id", "key_digest"), 256), 1, 32))
    return out.select("source_id", "row_index", "source_row_identity", "row_digest", "rule_id", "object_type", F.col("key_digest").alias("join_key_sha256"), "identity_alias", F.col("anchor").alias("canonical_anchor"), "goid", match.alias("candidate_match_id"))


def object_catalog(spark: SparkSession, m: Mapping) -> DataFrame:
    """(object_type_id, object_type, kind): every type and whether it is an object, an event, a link object or an association."""
    kinds: dict[str, str] = {}
    for r in m.rules:
        kinds.setdefault(r.object_type, {"EventObject": "event", "LinkObject": "link_object"}.get(r.kind, "object"))
    return spark.createDataFrame([(i, n, "association" if n.startswith("Association:") else kinds[n]) for n, i in m.types().items()], "object_type_id int, object_type string, kind string")


def property_catalog(spark: SparkSession, m: Mapping) -> DataFrame:
    """(object_type, property_id, property, nullable, conflict, role): declared properties, and those that associations have."""
    rows: dict[tuple[str, str], tuple] = {}
    for r in m.rules:
        for i, p in enumerate(r.properties, 1):
            old = rows.get((r.object_type, p.name))
            rows[(r.object_type, p.name)] = (r.object_type, K.property_id(p.name, i), p.name, p.nullable and (old is None or old[3]), p.conflict, None)
    roles = {"source_goid": "from_goid", "target_goid": "to_goid", "association_type": "type", "mapping_rule_id": "rule", "source_evidence_id": "evidence", "valid_from": "valid_from", "valid_to": "valid_to"}
    for t in sorted({f"Association:{a.type}" for a in m.associations}):
        for i, p in enumerate(ASSOCIATION_PROPERTIES, 1):
            rows[(t, p)] = (t, i, p, p.startswith("valid"), "reject_conflict", roles.get(p))
    return spark.createDataFrame(sorted(rows.values(), key=lambda x: x[:2]), "object_type string, property_id long, property string, nullable boolean, conflict string, role string")


_SECTIONS = {"sources": Source, "rules": Rule, "associations": Association}
_PARTS = {"key": Component, "to_key": Component, "properties": Property}


def from_document(doc: str | dict) -> Mapping:
    """A mapping from its document: {"id": hex, "version", "sources": [...], "rules": [...], ...} with the fields of the classes; unknown, missing or ill-typed fields are errors."""
    try:
        doc = json.loads(doc) if isinstance(doc, str) else doc
    except ValueError as e:
        raise ArchiveError("bad_document", str(e)) from e
    top = {"id", "version", "sources", "rules", "associations", "functions", "do_not_merge"}

    def made(kind: type, entry: object, where: str):
        if not isinstance(entry, dict):
            raise ArchiveError("bad_document", where)
        own = {f.name: f for f in fields(kind)}
        if unknown := sorted(set(entry) - set(own)):
            raise ArchiveError("unknown_field", f"{where}.{unknown[0]}")
        if missing := sorted(n for n, f in own.items() if f.default is MISSING and n not in entry):
            raise ArchiveError("missing_field", f"{where}.{missing[0]}")
        given = {}
        for n, v in entry.items():
            want = str(own[n].type)
            fits = {"str": str, "int": int, "bool": bool}.get(want.split(" |")[0])
            if fits and not (isinstance(v, fits) and not (fits is int and isinstance(v, bool)) or v is None and "None" in want) or want.startswith("tuple") and not isinstance(v, list):
                raise ArchiveError("bad_field", f"{where}.{n}")
            given[n] = tuple(made(_PARTS[n], x, f"{where}.{n}") for x in v) if n in _PARTS else tuple(v) if isinstance(v, list) else v
        return kind(**given)

    if not isinstance(doc, dict) or set(doc) - top:
        raise ArchiveError("unknown_field", str(sorted(set(doc) - top)[:1]) if isinstance(doc, dict) else "document")
    if missing := sorted({"id", "version", "sources", "rules"} - set(doc)):
        raise ArchiveError("missing_field", missing[0])
    try:
        id_ = bytes.fromhex(doc["id"])
    except (TypeError, ValueError) as e:
        raise ArchiveError("bad_field", "id") from e
    parts = {n: tuple(made(k, x, f"{n}[{i}]") for i, x in enumerate(doc.get(n, ()))) for n, k in _SECTIONS.items()}
    extra = {"functions": tuple(doc["functions"])} if "functions" in doc else {}
    return Mapping(id_, doc["version"], **parts, **extra, do_not_merge=tuple(map(tuple, doc.get("do_not_merge", ())))).validate()


def to_document(m: Mapping) -> str:
    """The document of a mapping; :func:`from_document` reads it back."""
    out = {"id": m.id.hex(), "version": m.version, **{n: [asdict(x) for x in getattr(m, n)] for n in _SECTIONS}, "functions": m.functions, "do_not_merge": m.do_not_merge}
    return json.dumps(out)


def diff(spark: SparkSession, old: Mapping, new: Mapping) -> DataFrame:
    """(section, id, change): what was added, removed or changed between versions."""
    parts = {"source": lambda m: {s.id: repr(s) for s in m.sources}, "rule": lambda m: {r.id: repr(r) for r in m.rules}, "association": lambda m: {a.id: repr(a) for a in m.associations}, "version": lambda m: {"version": m.version}}
    rows = []
    for name, f in parts.items():
        a, b = f(old), f(new)
        rows += [(name, k, "added" if k not in a else "removed" if k not in b else "changed") for k in sorted(set(a) | set(b)) if a.get(k) != b.get(k)]
    return spark.createDataFrame(rows, "section string, id string, change string")

