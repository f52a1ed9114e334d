"""Reading objects back through declared projections.

An expression is parsed once and becomes a Column over an anchor row. What it asks
of associations comes with one join and one aggregation for each (type, role) of the
whole projection. Property maps hold variants, which keep the types of JSON, or plain
strings, which are numbers where they look like one (as text sources give them) except
beside a quoted literal. Numbers are ordered as numbers, all else as JSON text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.canonical import ascii_lower, ascii_upper, trim_all
from lodestrata.sources.tables import ArchiveError

GRAINS = ("object", "event_object", "object_as_of_time", "association", "link_object", "property_version", "evidence_assertion")
POLICIES = ("reject", "explode", "list", "aggregate", "first", "last")
MODES = ("json", "arrow", "sql", "archive", "objects")
_TOKEN = re.compile(r"\s*(?:(?P<num>-?\d+(?:\.\d+)?)|(?P<str>'[^']*'|\"[^\"]*\")|(?P<name>[A-Za-z_][\w]*)|(?P<op>==|!=|>=|<=|[><(),.]))")


@dataclass(frozen=True)
class Output:
    """A column of a projection. ``order_by``: keys separated by commas, each ``value`` or a property of the association or the linked object, as ``key``, ``-key``, ``key asc``, ``key desc``, ``key:asc`` or ``key:desc``.

    ``type`` is a Spark type or a logical type of :func:`logical_type`; list, struct and map need a ``shape``.
    """

    name: str
    expression: str
    type: str = "string"
    policy: str = "reject"
    order_by: str | None = None
    shape: str | None = None


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ArchiveError("bad_expression", text)
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str) -> tuple:
    """A tree of ("lit", v), ("path", parts), ("call", name, args), ("assoc", type, role, parts), ("cmp", op, a, b)."""
    ts = tokens(text)
    at = 0

    def peek() -> str | None:
        return ts[at][1] if at < len(ts) else None

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal at
        if at >= len(ts) or (want is not None and ts[at][1] != want):
            raise ArchiveError("bad_expression", text)
        at += 1
        return ts[at - 1]

    def path(first: str) -> list[str]:
        parts = [first]
        while peek() == ".":
            take()
            parts.append(take()[1])
        return parts

    def value() -> tuple:
        kind, v = take()
        if kind == "num":
            return ("lit", float(v) if "." in v else int(v))
        if kind == "str":
            return ("lit", v[1:-1])
        if kind != "name":
            raise ArchiveError("bad_expression", text)
        if v in ("null", "true", "false") and peek() != "(":
            return ("lit", {"null": None, "true": True, "false": False}[v])
        if peek() != "(":
            return ("path", tuple(path(v)))
        take("(")
        if v == "association":
            kind_, role = take()[1], None
            if peek() == ",":
                take()
                role = take()[1]
            take(")")
            return ("assoc", kind_, role, tuple(path("")[1:]) if peek() == "." else ())
        args = []
        while peek() != ")":
            args.append(compared())
            if peek() == ",":
                take()
        take(")")
        return ("call", v, tuple(args))

    def compared() -> tuple:
        a = value()
        if peek() in ("==", "!=", ">=", "<=", ">", "<"):
            op = take()[1]
            return ("cmp", op, a, value())
        return a

    tree = compared()
    if at != len(ts):
        raise ArchiveError("bad_expression", text)
    return tree


SCALARS = {
    "identity": None,
    "trim": lambda a: trim_all(a),
    "lower": lambda a: ascii_lower(a),
    "lowercase": lambda a: ascii_lower(a),
    "upper": lambda a: ascii_upper(a),
    "uppercase": lambda a: ascii_upper(a),
}
AGGREGATES = ("count", "min", "max", "sum", "avg", "distinct_count", "list")
#: Functions that need no declaration.
BUILTIN = ("if", "ifelse", "exists", "association", *AGGREGATES)
_FIXED = {
    ("goid",): "goid", ("object", "goid"): "goid", ("Object", "goid"): "goid", ("record", "id"): "record_id", ("record", "record_id"): "record_id", ("record", "kind"): "kind",
    ("object", "type"): "object_type", ("Object", "type"): "object_type", ("object_type",): "object_type", ("object", "type_id"): "object_type_id", ("object_type_id",): "object_type_id",
    **{(*a, c): c for c in ("timestamp_us", "csn", "branch_key") for a in (("temporal",), ())},
}
#: Fields of an association row, and where they are found.
_EDGE = {
    "goid": "association_goid", "source_goid": "source_goid", "target_goid": "target_goid", "association_type": "type", "mapping_rule_id": "association_id", "source_evidence_id": "source_evidence_id",
    "source_role": "source_role", "target_role": "target_role", "valid_from": "valid_from", "valid_to": "valid_to", "observed_at": "observed_at", "cardinality_policy": "cardinality_policy",
}


@dataclass(frozen=True)
class Value:
    """A value as its raw text (for output), its number, its JSON text, and whether it is a JSON string; null in all where it is null.

    ``loose``: text of no declared type; ``quoted``: a string literal.
    """

    text: Column
    number: Column
    json: Column
    string: Column
    loose: bool = False
    quoted: bool = False
    truth: Column | None = None

    def exists(self) -> Column:
        return self.json.isNotNull()


def _null() -> Column:
    return F.lit(None).cast("string")


def literal(v: object) -> Value:
    if v is None:
        return Value(_null(), F.lit(None).cast("double"), _null(), F.lit(False))
    if isinstance(v, bool):
        return Value(F.lit(str(v).lower()), F.lit(None).cast("double"), F.lit(str(v).lower()), F.lit(False))
    if isinstance(v, (int, float)):
        return Value(F.lit(str(v)), F.lit(float(v)), F.lit(str(v)), F.lit(False))
    return Value(F.lit(v), F.lit(None).cast("double"), F.lit(json.dumps(v, ensure_ascii=False)), F.lit(True), quoted=True)


#: Text that looks like a number.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def loose(c: Column) -> Value:
    """Text without a type: a number where it looks like one."""
    number = F.when(c.rlike(_NUMBER), c.try_cast("double"))
    return Value(c, number, F.when(number.isNotNull(), c).otherwise(F.concat(F.lit('"'), c, F.lit('"'))), number.isNull() & c.isNotNull(), loose=True)


def typed(v: Column) -> Value:
    """A variant: JSON null is null, and only JSON numbers are numbers."""
    v = F.when(v.isNotNull() & ~F.is_variant_null(v), v)
    kind = F.schema_of_variant(v)
    number = F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    string = F.coalesce(kind == "STRING", F.lit(False))
    text = F.when(string, F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    return Value(text, number, F.to_json(v), string)


def exact(c: Column, kind: T.DataType) -> Value:
    """A column of a Spark type: text, number or truth."""
    if isinstance(kind, T.NumericType):
        return Value(c.cast("string"), c.cast("double"), c.cast("string"), F.lit(False))
    if isinstance(kind, T.BooleanType):
        return Value(c.cast("string"), F.lit(None).cast("double"), c.cast("string"), F.lit(False))
    text = c.cast("string")
    return Value(text, F.lit(None).cast("double"), F.concat(F.lit('"'), text, F.lit('"')), text.isNotNull())


def truthy(v: Value | Column) -> Column:
    """Null, 0, the empty string, false and empty lists and objects are not; any other string is."""
    v = loose(v.cast("string")) if isinstance(v, Column) else v
    if v.truth is not None:
        return v.truth
    number = F.lit(None).cast("double") if v.loose else v.number
    return v.exists() & F.when(number.isNotNull(), number != 0).otherwise(~v.json.isin('""', "false", "[]", "{}") & (v.text != ""))


def compare(op: str, a: Value | Column, b: Value | Column) -> Column:
    """Both numbers: as numbers; else by JSON text, where null is ``null``. Beside a quoted literal, text without a type is a string."""
    a, b = (loose(x.cast("string")) if isinstance(x, Column) else x for x in (a, b))
    plain = a.quoted or b.quoted
    n, m = a.number, b.number
    x, y = (F.concat(F.lit('"'), v.text, F.lit('"')) if plain and v.loose else v.json for v in (a, b))
    x, y = F.coalesce(x, F.lit("null")), F.coalesce(y, F.lit("null"))
    numbers = F.lit(False) if plain else n.isNotNull() & m.isNotNull()

    def both(f) -> Column:
        return F.when(numbers, f(n, m)).otherwise(f(x, y))

    return {"==": both(lambda p, q: p == q), "!=": both(lambda p, q: p != q), ">=": both(lambda p, q: p >= q), "<=": both(lambda p, q: p <= q), ">": both(lambda p, q: p > q), "<": both(lambda p, q: p < q)}[op]


def ordering(text: str) -> list[tuple[str, bool]]:
    """(key, descending) of each key of an ordering."""
    out = []
    for part in text.split(","):
        key, down = part.strip(), False
        if key.startswith("-"):
            key, down = key[1:].strip(), True
        for suffix in (" desc", " asc", ":desc", ":asc"):
            if key.endswith(suffix):
                key, down = key.removesuffix(suffix).strip(), suffix.endswith("desc")
        if not key:
            raise ArchiveError("bad_ordering", text)
        out.append((key, down))
    return out


#: Logical types of projection columns.
_LOGICAL = {
    "bool": "boolean", "boolean": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "int": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "uint": "decimal(20,0)",
    "float32": "float", "float64": "double", "float": "double", "decimal64": "decimal(18,4)", "decimal128": "decimal(38,10)", "decimal": "decimal(38,10)", "date_days": "date", "date32": "date", "date": "date",
    "timestamp_micros": "timestamp", "timestamp_us": "timestamp", "timestamp_nanos": "timestamp", "timestamp_ns": "timestamp", "utf8": "string", "string": "string", "binary": "binary", "uuid": "string", "json": "string",
}


def logical_type(name: str, shape: str | dict | None = None) -> T.DataType:
    """The Spark type of a logical type; lists, structs and maps by their shape, JSON as {"type": ..., "item" | "fields" | "key", "value": ...}."""
    if name in ("list", "struct", "map"):
        try:
            spec = json.loads(shape) if isinstance(shape, str) else shape
        except ValueError as e:
            raise ArchiveError("bad_shape", str(e)) from e
        if not isinstance(spec, dict) or spec.get("type", spec.get("kind")) != name:
            raise ArchiveError("bad_shape", f"{name}: {shape}")
        return _shaped(spec)
    if shape is not None:
        raise ArchiveError("bad_shape", f"{name} has no shape")
    try:
        return T._parse_datatype_string(_LOGICAL.get(name, name))
    except Exception as e:
        raise ArchiveError("bad_type", name) from e


def _shaped(spec: object) -> T.DataType:
    if not isinstance(spec, dict):
        raise ArchiveError("bad_shape", str(spec))
    kind = spec.get("type", spec.get("kind"))

    def part(key: str) -> T.DataType:
        if (inner := spec.get(key)) is None:
            raise ArchiveError("bad_shape", f"{kind} needs {key}")
        return _shaped(inner)

    if kind == "list":
        inner = spec.get("item", spec.get("element"))
        return T.ArrayType(_shaped(inner), not isinstance(inner, dict) or inner.get("nullable", True))
    if kind == "map":
        return T.MapType(part("key"), part("value"), spec["value"].get("nullable", True))
    if kind == "struct":
        fields = spec.get("fields")
        if not isinstance(fields, list) or not all(isinstance(f, dict) and f.get("name") for f in fields):
            raise ArchiveError("bad_shape", "struct needs named fields")
        return T.StructType([T.StructField(f["name"], _shaped(f), f.get("nullable", True)) for f in fields])
    name = spec.get("logical_type", spec.get("logical", kind))
    if not isinstance(name, str) or name not in _LOGICAL:
        raise ArchiveError("bad_type", str(name))
    return logical_type(name)


def walk(tree: tuple) -> Iterator[tuple]:
    """A tree and all trees in it."""
    yield tree
    for x in tree[2] if tree[0] == "call" else tree[2:] if tree[0] == "cmp" else ():
        yield from walk(x)


@dataclass(frozen=True)
class Projection:
    """A projection as it is declared. ``object_type`` or ``association_type`` is the anchor."""

    id: str
    output_table: str
    grain: str
    columns: tuple[Output, ...]
    object_type: str | None = None
    association_type: str | None = None
    temporal_mode: str = "latest_committed"
    modes: tuple[str, ...] = ("json",)
    functions: tuple[str, ...] = ()

    def validate(self) -> Projection:
        """The projection itself; what is missing, unknown or undeclared is an error."""
        if not self.id or not self.output_table or not self.columns or not self.modes:
            raise ArchiveError("incomplete_projection", self.id)
        if self.grain not in GRAINS:
            raise ArchiveError("bad_grain", self.grain)
        if unknown := sorted(set(self.modes) - set(MODES)):
            raise ArchiveError("bad_output_mode", unknown[0])
        if not _known_mode(self.temporal_mode):
            raise ArchiveError("bad_temporal_mode", self.temporal_mode)
        if self.grain in ("association", "link_object"):
            if self.association_type is None or self.object_type is not None:
                raise ArchiveError("bad_anchor", f"{self.grain} is anchored at an association type")
        elif self.grain in GRAINS[:3] and (self.object_type is None or self.association_type is not None):
            raise ArchiveError("bad_anchor", f"{self.grain} is anchored at an object type")
        if len({c.name for c in self.columns}) != len(self.columns):
            raise ArchiveError("duplicate_column", self.id)
        for c in self.columns:
            if c.policy not in POLICIES:
                raise ArchiveError("bad_policy", c.policy)
            if c.policy in ("first", "last") and not c.order_by:
                raise ArchiveError("unordered_choice", c.name)
            logical_type(c.type, c.shape)
            if c.order_by:
                ordering(c.order_by)
            if self.grain == "evidence_assertion":
                if not c.expression.startswith("evidence."):
                    raise ArchiveError("bad_expression", c.expression)
                continue
            for x in walk(parse(c.expression)):
                check_call(x, self.functions)
        return self


def check_call(tree: tuple, declared: tuple[str, ...] = ()) -> None:
    """Functions need an executor, the right number of arguments and, where any are declared and they are no operators, a declaration."""
    if tree[0] != "call":
        return
    name, n = tree[1], len(tree[2])
    if name not in (*BUILTIN, *SCALARS, "coalesce"):
        raise ArchiveError("no_executor" if name in declared else "unsupported_expression", name)
    if declared and name not in BUILTIN and name not in declared:
        raise ArchiveError("undeclared_function", name)
    if n != {"if": 3, "ifelse": 3}.get(name, 1) and not (name == "coalesce" and n):
        raise ArchiveError("bad_arguments", name)


def _ranker(downs: list[bool]):
    """A comparison of list items by their keys, each up or down, and then by association and linked object."""

    def ranked(a: Column, b: Column) -> Column:
        out = F
        for i, down in enumerate(downs):
            x, y = a["k"][i], b["k"][i]
            both = x["n"].isNotNull() & y["n"].isNotNull()
            less, more = (F.when(both, x["n"] < y["n"]).otherwise(x["t"] < y["t"]), F.when(both, x["n"] > y["n"]).otherwise(x["t"] > y["t"]))
            out = out.when(more if down else less, -1).when(less if down else more, 1)
        one, two = F.struct(a["a"], a["f"]), F.struct(b["a"], b["f"])
        return out.when(one < two, -1).when(one > two, 1).otherwise(0)

    return ranked


def _caster(kind: T.DataType):
    return lambda x: Projector._cast(x["v"], x["j"], kind)


@dataclass
class _Asked:
    """What a projection asks of one (association type, role): columns of one aggregation."""

    aggregates: dict[tuple[str, tuple], str] = field(default_factory=dict)
    lists: dict[tuple[tuple, str | None], str] = field(default_factory=dict)


class Projector:
    """Projects objects (goid, object_type, properties, and whatever record columns there are) with their edges.

    Edges have type, source_goid, target_goid, association_goid, and may have roles, validity and properties of their own.
    """

    def __init__(self, objects: DataFrame, edges: DataFrame | None = None) -> None:
        self.objects, self.edges = objects, edges

    def _property(self, df: DataFrame, column: str, key: str) -> Value:
        kind = df.schema[column].dataType.valueType
        v = F.try_element_at(F.col(column), F.lit(key))
        return typed(v) if kind.simpleString() == "variant" else loose(v) if isinstance(kind, T.StringType) else exact(v, kind)

    def _field(self, df: DataFrame, name: str) -> Value:
        return exact(F.col(name), df.schema[name].dataType)

    def value(self, tree: tuple, df: DataFrame, found: dict, edge: bool = False) -> Value:
        """A tree over anchor rows; what it asks of associations is in columns that ``found`` names."""
        match tree:
            case ("lit", v):
                return literal(v)
            case ("path", parts):
                if edge and (parts[0] == "association" or len(parts) == 1 and parts[0] in _EDGE):
                    name = _EDGE.get(parts[-1])
                    if name in df.columns:
                        return self._field(df, name)
                    if "properties" not in df.columns and name is None:
                        raise ArchiveError("unknown_path", ".".join(parts))
                    return literal(None) if name is not None and "properties" not in df.columns else self._property(df, "properties", parts[-1])
                if parts[0] == "association":
                    raise ArchiveError("unknown_path", ".".join(parts))
                if tuple(parts) in _FIXED:
                    name = _FIXED[tuple(parts)]
                    if name not in df.columns:
                        raise ArchiveError("unknown_path", ".".join(parts))
                    return self._field(df, name)
                return self._property(df, "properties", parts[-1])
            case ("cmp", op, a, b):
                truth = compare(op, self.value(a, df, found, edge), self.value(b, df, found, edge))
                return Value(truth.cast("string"), F.lit(None).cast("double"), truth.cast("string"), F.lit(False), truth=truth)
            case ("call", name, args):
                if name in AGGREGATES and args and args[0][0] == "assoc":
                    c = F.col(found[(name, args[0])])
                    if name in ("min", "max"):
                        return Value(c["text"], c["number"], c["json"], F.lit(False))
                    return exact(c, T.DoubleType() if name in ("sum", "avg") else T.LongType())
                if name == "exists" and args and args[0][0] == "assoc":
                    has = F.size(F.col(found[("assoc", args[0])])) > 0
                    return Value(has.cast("string"), F.lit(None).cast("double"), has.cast("string"), F.lit(False), truth=has)
                check_call(tree)
                made = [self.value(a, df, found, edge) for a in args]
                one = made[0]
                if name == "identity":
                    return one
                if name in SCALARS:
                    # of what is no string there is no other case
                    text = SCALARS[name](F.when(one.string | F.lit(one.loose), one.text))
                    return Value(text, F.lit(None).cast("double"), F.concat(F.lit('"'), text, F.lit('"')), text.isNotNull())
                if name == "exists":
                    has = one.exists()
                    return Value(has.cast("string"), F.lit(None).cast("double"), has.cast("string"), F.lit(False), truth=has)
                if name == "coalesce":
                    return self._chosen([(v.exists(), v) for v in made])
                if name in ("if", "ifelse"):
                    return self._chosen([(truthy(one), made[1]), (F.lit(True), made[2])])
                if name in AGGREGATES:
                    # of a value of the row itself: one value, or none
                    number = one.number
                    if name in ("min", "max"):
                        return one
                    if name in ("count", "distinct_count"):
                        return exact(one.exists().cast("long"), T.LongType())
                    if name in ("sum", "avg"):
                        return exact(F.coalesce(number, F.lit(0.0)) if name == "sum" else number, T.DoubleType())
        raise ArchiveError("unsupported_expression", str(tree))

    @staticmethod
    def _chosen(cases: list[tuple[Column, Value]]) -> Value:
        """The value of the first case that holds."""

        def pick(part: str) -> Column:
            out = None
            for when, v in cases:
                out = F.when(when, getattr(v, part)) if out is None else out.when(when, getattr(v, part))
            return out

        return Value(pick("text"), pick("number"), pick("json"), F.coalesce(pick("string"), F.lit(False)), loose=all(v.loose for _, v in cases))

    def linked(self, kind: str, role: str | None, far: bool) -> DataFrame:
        """(goid, far, edge columns, p): the associations of every anchor, with the linked object's properties where they are asked for.

        Without a role the anchor is the source; ``source`` and ``from``, ``target`` and
        ``to`` name an end, any other role is looked for at both.
        """
        if self.edges is None:
            raise ArchiveError("no_associations", kind)
        e = self.edges.where(F.col("type") == kind)
        ends = {"source": True, "from": True, None: True, "target": False, "to": False}
        side = lambda first, e=e: e.select((F.col("source_goid") if first else F.col("target_goid")).alias("goid"), (F.col("target_goid") if first else F.col("source_goid")).alias("__far"), *(F.col(c).alias(f"__e_{c}") for c in e.columns))
        if role in ends:
            pairs = side(ends[role])
        else:
            if not {"source_role", "target_role"} <= set(e.columns):
                raise ArchiveError("no_roles", role)
            one, two = F.col("source_role").eqNullSafe(role), F.col("target_role").eqNullSafe(role)
            # an association from an object to itself is one, whichever end has the role
            pairs = side(True, e.where(one)).unionByName(side(False, e.where(two & ~(one & (F.col("source_goid") == F.col("target_goid"))))))
        if not far:
            return pairs
        return pairs.join(self.objects.select(F.col("goid").alias("__far"), F.col("properties").alias("__p")), "__far", "left")

    def _of_link(self, df: DataFrame, path: tuple) -> Value:
        """A property of an association: its own, or else the linked object's; without a path, the linked object's id."""
        if not path:
            return exact(F.col("__far"), T.StringType())
        name = path[-1]
        if (own := f"__e_{_EDGE.get(name, name)}") in df.columns and name != "properties" and (name in _EDGE or own != "__e_type"):
            return self._field(df, own)
        far = self._property(df, "__p", name)
        if "__e_properties" not in df.columns:
            return far
        mine = self._property(df, "__e_properties", name)
        return self._chosen([(mine.exists(), mine), (F.lit(True), far)])

    def _gather(self, kind: str, role: str | None, asked: _Asked) -> DataFrame:
        """(goid, one column for each thing asked): one join and one aggregation, combined before it moves."""
        paths = [p for _, p in asked.aggregates] + [p for p, _ in asked.lists]
        keys = [k for _, o in asked.lists for k, _ in (ordering(o) if o else [])]
        far = any(p and p[-1] not in _EDGE for p in paths) or any(k != "value" and k.rpartition(".")[2] not in _EDGE for k in keys)
        rows = self.linked(kind, role, far)
        # what an aggregate needs of a value (text, number, JSON) is a column, made once
        cells: dict[str, Column] = {"goid": F.col("goid")}
        places: dict[tuple, int] = {}

        def cell(path: tuple, part: str) -> str:
            i = places.setdefault(path, len(places))
            v = self._of_link(rows, path)
            # text without a type differs where its text does, and is there where its text is
            part = "text" if part == "json" and v.loose else part
            cells.setdefault(f"__v{i}{part[0]}", getattr(v, part))
            return f"__v{i}{part[0]}"

        aggs = []
        for (name, path), out in asked.aggregates.items():
            if name in ("min", "max"):
                # numbers as numbers if all are, else JSON text
                t, n, j = (cell(path, x) for x in ("text", "number", "json"))
                if t == j:
                    cells[j := f"{t}q"] = self._of_link(rows, path).json
                every = f"count({n}) = count({j})"
                made = f"named_struct('text', if({every}, {name}_by({t}, {n}), {name}_by({t}, {j})), 'number', if({every}, {name}({n}), null), 'json', if({every}, {name}_by({j}, {n}), {name}({j})))"
            elif name in ("sum", "avg"):
                made = f"{name}({cell(path, 'number')})"
                made = f"coalesce({made}, 0D)" if name == "sum" else made
            else:
                made = f"count(distinct {cell(path, 'json')})" if name == "distinct_count" else f"count({cell(path, 'text')})" if path else "count(1)"
            aggs.append(F.expr(made).alias(out))
        for (path, order), out in asked.lists.items():
            sort = []
            for key, _ in ordering(order) if order else []:
                k = path if key == "value" else tuple(key.split("."))
                n, j = cell(k, "number"), cell(k, "text")
                cells.setdefault(f"{j}q", self._of_link(rows, k).json)
                sort.append(f"named_struct('n', {n}, 't', coalesce({j}q, 'null'))")
            t = cell(path, "text")
            cells.setdefault(f"{t}q", self._of_link(rows, path).json)
            cells |= {"__a": F.col("__e_association_goid"), "__f": F.col("__far")}
            keys = f"array({', '.join(sort)})" if sort else "cast(null as array<struct<n:double,t:string>>)"
            aggs.append(F.expr(f"collect_list(named_struct('k', {keys}, 'a', __a, 'f', __f, 'v', {t}, 'j', {t}q))").alias(out))
        rows = rows.select(*(c.alias(n) for n, c in cells.items()))
        got = rows.groupBy("goid").agg(*aggs)
        for (_, order), out in asked.lists.items():
            got = got.withColumn(out, F.array_sort(F.col(out), _ranker([down for _, down in ordering(order)] if order else [])))
        return got

    def project(self, outputs: list[Output], *, object_type: str | None = None, grain: str = "object", association_type: str | None = None, functions: tuple[str, ...] = ()) -> DataFrame:
        """One row per anchor, or more where a list is exploded."""
        if grain not in GRAINS:
            raise ArchiveError("bad_grain", grain)
        for o in outputs:
            if o.policy not in POLICIES:
                raise ArchiveError("bad_policy", o.policy)
            if o.policy in ("first", "last") and not o.order_by:
                raise ArchiveError("unordered_choice", o.name)
        trees = [parse(o.expression) for o in outputs]
        for t in trees:
            for x in walk(t):
                check_call(x, functions)
        edge = grain in ("association", "link_object")
        if edge:
            if self.edges is None:
                raise ArchiveError("no_associations", str(association_type))
            df = self.edges if association_type is None else self.edges.where(F.col("type") == association_type)
        else:
            df = self.objects if object_type is None else self.objects.where(F.col("object_type") == object_type)
        asked: dict[tuple, _Asked] = {}
        found: list[dict] = []
        for i, (t, o) in enumerate(zip(trees, outputs)):
            mine: dict = {}
            inside = {id(x[2][0]) for x in walk(t) if x[0] == "call" and x[1] in AGGREGATES and x[1] != "list" and x[2] and x[2][0][0] == "assoc"}
            for x in walk(t):
                if x[0] == "call" and x[1] in AGGREGATES and x[1] != "list" and x[2] and x[2][0][0] == "assoc":
                    a = x[2][0]
                    want = asked.setdefault((a[1], a[2]), _Asked())
                    mine[(x[1], a)] = want.aggregates.setdefault((x[1], tuple(a[3])), f"__a{len(asked)}_{len(want.aggregates)}")
                elif x[0] == "assoc" and id(x) not in inside:
                    want = asked.setdefault((x[1], x[2]), _Asked())
                    mine[("assoc", x)] = want.lists.setdefault((tuple(x[3]), o.order_by), f"__l{len(asked)}_{len(want.lists)}")
            found.append(mine)
        if edge and asked:
            raise ArchiveError("unsupported_expression", "an association has no associations of its own")
        empties = {"count": F.lit(0).cast("long"), "distinct_count": F.lit(0).cast("long"), "sum": F.lit(0.0)}
        for (kind, role), want in asked.items():
            df = df.join(self._gather(kind, role, want), "goid", "left")
            for (name, _), c in want.aggregates.items():
                if name in empties:
                    df = df.withColumn(c, F.coalesce(c, empties[name]))
            for c in want.lists.values():
                df = df.withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
        for i, (t, o, mine) in enumerate(zip(trees, outputs, found)):
            kind = logical_type(o.type, o.shape)
            listed = t[0] == "assoc" or t[0] == "call" and t[1] == "list"
            name = f"__o{i}"
            if not listed:
                df = df.withColumn(name, self._out(self.value(t, df, mine, edge), kind))
                continue
            if t[0] == "assoc":
                items = F.col(mine[("assoc", t)])
            elif t[2] and t[2][0][0] == "assoc":
                items = F.col(mine[("assoc", t[2][0])])
            else:
                v = self.value(t[2][0], df, mine, edge)
                items = F.array(F.struct(v.text.alias("v"), v.json.alias("j")))
            whole = t[0] == "call" or o.policy in ("list", "aggregate")
            if whole:
                element = kind.elementType if isinstance(kind, T.ArrayType) and o.shape else kind
                df = df.withColumn(name, F.transform(items, _caster(element)))
                continue
            one = _caster(kind)
            if o.policy == "reject":
                none = F.raise_error(F.lit(f"more than one value: {o.name}")).cast(kind)
                df = df.withColumn(name, F.when(F.size(items) > 1, none).otherwise(one(F.get(items, F.lit(0)))))
            elif o.policy in ("first", "last"):
                df = df.withColumn(name, one(F.try_element_at(items, F.lit(1 if o.policy == "first" else -1))))
            else:
                df = df.withColumn(name, F.explode_outer(items)).withColumn(name, one(F.col(name)))
        return df.select(*(F.col(f"__o{i}").alias(o.name) for i, o in enumerate(outputs)))

    @staticmethod
    def _cast(text: Column, json_: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            return F.from_json(json_, kind)
        return text.cast(kind)

    def _out(self, v: Value, kind: T.DataType) -> Column:
        if v.truth is not None and isinstance(kind, T.BooleanType):
            return v.truth
        return self._cast(v.text, v.json, kind)

    def run(self, p: Projection, records: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
        """A declared projection; ``records`` are an object history, which its temporal mode is applied to in place of ``objects``."""
        p.validate()
        if p.grain == "evidence_assertion":
            if evidence is None:
                raise ArchiveError("no_evidence", p.id)
            out = project_evidence(evidence, [c.expression.removeprefix("evidence.") for c in p.columns])
            return out.toDF(*(c.name for c in p.columns))
        me = self if records is None else Projector(temporal_view(records, p.temporal_mode), self.edges)
        if p.grain == "property_version":
            base = me.objects if p.object_type is None else me.objects.where(F.col("object_type") == p.object_type)
            return property_versions(base)
        me.check_paths(p)
        return me.project(list(p.columns), object_type=p.object_type, association_type=p.association_type, grain=p.grain, functions=p.functions)

    def check_paths(self, p: Projection) -> None:
        """A property that no row of the anchor has, where there are rows, is an error."""
        if p.object_type is None or "properties" not in self.objects.columns:
            return
        names = {x[1][-1] for c in p.columns for x in walk(parse(c.expression)) if x[0] == "path" and tuple(x[1]) not in _FIXED}
        if not names:
            return
        own = self.objects.where(F.col("object_type") == p.object_type)
        has = own.agg(F.count("*").alias("rows"), *(F.max(F.map_contains_key("properties", n)).alias(f"h{i}") for i, n in enumerate(sorted(names)))).first()
        if has.rows:
            for i, n in enumerate(sorted(names)):
                if not has[f"h{i}"]:
                    raise ArchiveError("undeclared_path", f"{p.id}: {n}")


def render(df: DataFrame, mode: str, table: str) -> object:
    """A projection's rows in an output mode: JSON text rows, an Arrow table (on the driver), SQL statements, or the rows themselves for an archive or for objects."""
    from lodestrata.sources import archive

    if mode not in MODES:
        raise ArchiveError("bad_output_mode", mode)
    return {"json": lambda: archive.json_rows(df), "arrow": df.toArrow, "sql": lambda: archive.sql_export(df, table)}.get(mode, lambda: df)()


def _known_mode(mode: str) -> bool:
    name, _, value = mode.partition(":")
    return name in ("latest_committed", "latest", "full_history", "commit_order", "valid_time", "observed_time") and not value or name in ("as_of_timestamp_us", "as_of_csn") and value.lstrip("-").isdigit()


def property_versions(records: DataFrame) -> DataFrame:
    """One row for each property of each record."""
    return records.select("goid", "record_id", "kind", "timestamp_us", "csn", F.explode("properties").alias("property", "value"))


def project_evidence(evidence: DataFrame, fields: list[str]) -> DataFrame:
    """Named evidence fields; one that is missing is null."""
    return evidence.select(*((F.col(f) if f in evidence.columns else F.lit(None)).cast("string").alias(f) for f in fields))


def temporal_view(records: DataFrame, mode: str) -> DataFrame:
    """Records as a projection's mode sees them.

    latest_committed, as_of_timestamp_us:N and as_of_csn:N give one live state per
    object; full_history and commit_order give every record with its place;
    valid_time and observed_time order by that property, which must exist.
    """
    from pyspark.sql import Window

    from . import temporal

    name, _, value = mode.partition(":")
    if name in ("latest_committed", "latest") and not value:
        return temporal.as_of(records)
    if name in ("as_of_timestamp_us", "as_of_csn") and value.lstrip("-").isdigit():
        return temporal.as_of(records, **{name.removeprefix("as_of_"): int(value)})
    if name in ("full_history", "commit_order") and not value:
        w = Window.partitionBy(*temporal.KEY).orderBy(*temporal.ORDER)
        return records.withColumn("place", F.row_number().over(w))
    if name in ("valid_time", "observed_time") and not value:
        key = {"valid_time": "valid_from", "observed_time": "observed_at"}[name]
        has = F.when(F.map_contains_key("properties", key), F.col("properties")[key]).otherwise(F.raise_error(F.lit(f"no {key}")).cast("string"))
        return records.withColumn("at", has)
    raise ArchiveError("bad_temporal_mode", mode)
