"""Persistable predicates: a JSON tree, its normal forms, its columns, a filter language.

A predicate is a dict {"op": ..., ...}; see OPS. Trees compile to Column
expressions and so are pushed down and evaluated by Spark; three-valued logic is
SQL's.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.sources.tables import ArchiveError

COMPARE = {"Eq": "=", "NotEq": "<>", "Lt": "<", "LtEq": "<=", "Gt": ">", "GtEq": ">="}
NEGATED = {"Eq": "NotEq", "NotEq": "Eq", "Lt": "GtEq", "LtEq": "Gt", "Gt": "LtEq", "GtEq": "Lt", "IsNull": "IsNotNull", "IsNotNull": "IsNull", "True": "False", "False": "True"}
FLIPPED = {"Eq": "Eq", "NotEq": "NotEq", "Lt": "Gt", "LtEq": "GtEq", "Gt": "Lt", "GtEq": "LtEq"}
#: op -> fields
OPS = {
    **{op: ("column", "value") for op in (*COMPARE, "LikePrefix", "Contains")},
    **{op: ("column",) for op in ("IsNull", "IsNotNull", "IsNaN", "IsFinite")},
    **{op: ("items",) for op in ("And", "Or")},
    "Between": ("column", "low", "high"), "InSet": ("column", "values"), "Not": ("item",), "True": (), "False": (),
    "FunctionCall": ("name", "arguments"), "Literal": ("value",), "ColumnRef": ("column",),
}
NULL_POLICIES = ("SqlWhere", "NullExcluded", "NullIncluded", "NullOnly", "NullRejected")
#: Functions of one row that a predicate may call; they depend on their arguments alone.
_FUNCTIONS = frozenset(
    "lower upper trim ltrim rtrim length char_length octet_length substring left right concat concat_ws replace translate reverse lpad rpad startswith endswith contains instr "
    "abs ceil floor round sqrt power mod sign greatest least coalesce nullif nvl if year month day hour minute second date_trunc to_date cast_string md5 sha2 crc32 xxhash64 size array_contains element_at".split()
)


def pred(op: str, *values: object) -> dict:
    return {"op": op, **dict(zip(OPS[op], values, strict=True))}


def AND(*items: dict) -> dict:
    return pred("And", list(items))


def OR(*items: dict) -> dict:
    return pred("Or", list(items))


def NOT(item: dict) -> dict:
    return pred("Not", item)


def validate(p: dict) -> dict:
    """The predicate itself; an unknown op or another set of fields is an error."""
    if p.get("op") not in OPS or set(p) - {"op"} != set(OPS[p["op"]]):
        raise ArchiveError("bad_predicate", str(p))
    for child in children(p):
        validate(child)
    return p


def children(p: dict) -> list[dict]:
    return p["items"] if p["op"] in ("And", "Or") else [p["item"]] if p["op"] == "Not" else p["arguments"] if p["op"] == "FunctionCall" else []


def columns_of(p: dict) -> set[str]:
    return ({p["column"]} if "column" in p else set()).union(*map(columns_of, children(p)))


def to_column(p: dict) -> Column:
    """The predicate as a Column. An And or Or of nothing is its neutral element; null members of a set select nothing."""
    op = p["op"]
    c = F.col(p["column"]) if "column" in p else None
    if op in COMPARE:
        v = F.lit(p["value"])
        return {"Eq": c == v, "NotEq": c != v, "Lt": c < v, "LtEq": c <= v, "Gt": c > v, "GtEq": c >= v}[op]
    if op in ("And", "Or"):
        parts = [to_column(x) for x in p["items"]]
        join = (lambda a, b: a & b) if op == "And" else (lambda a, b: a | b)
        return reduce(join, parts) if parts else F.lit(op == "And")
    match op:
        case "True" | "False":
            return F.lit(op == "True")
        case "Not":
            return ~to_column(p["item"])
        case "IsNull":
            return c.isNull()
        case "IsNotNull":
            return c.isNotNull()
        case "IsNaN":
            return F.when(c.isNull(), None).otherwise(F.isnan(c))
        case "IsFinite":
            d = c.cast("double")
            return F.when(c.isNull(), None).otherwise(~F.isnan(d) & (F.abs(d) != float("inf")))
        case "Between":
            return (c >= F.lit(p["low"])) & (c <= F.lit(p["high"]))
        case "InSet":
            values = [v for v in p["values"] if v is not None]
            return c.isin(values) if values else F.lit(False)
        case "LikePrefix":
            return c.startswith(p["value"])
        case "Contains":
            return c.contains(p["value"])
        case "ColumnRef":
            return c
        case "Literal":
            return F.lit(p["value"])
        case "FunctionCall" if p["name"] in _FUNCTIONS:
            made = [to_column(x) for x in p["arguments"]]
            return made[0].cast("string") if p["name"] == "cast_string" else F.call_function(p["name"], *made)
    raise ArchiveError("unsupported_predicate", op)


def _sql_value(v: object) -> str | None:
    """A literal as SQL, if that is plain."""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int) and -(2**31) <= v < 2**31:
        return str(v)
    if isinstance(v, int) and -(2**63) <= v < 2**63:
        return f"{v}L"
    if isinstance(v, float) and v == v and abs(v) != float("inf"):
        return f"{v!r}D"
    if isinstance(v, str) and v.isprintable():
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return None


def _sql(p: dict) -> str | None:
    op, c = p["op"], f"`{p['column']}`" if "column" in p and "`" not in p["column"] else None
    if op in ("And", "Or"):
        parts = [_sql(x) for x in p["items"]]
        return None if None in parts else f"({f' {op.lower()} '.join(parts)})" if parts else str(op == "And").lower()
    if op == "Not":
        inner = _sql(p["item"])
        return None if inner is None else f"(not {inner})"
    if op in ("True", "False"):
        return op.lower()
    if c is None:
        return None
    if op in ("IsNull", "IsNotNull"):
        return f"({c} is {'not ' if op == 'IsNotNull' else ''}null)"
    if op == "InSet":
        values = [_sql_value(v) for v in p["values"] if v is not None]
        return None if None in values else f"({c} in ({', '.join(values)}))" if values else "false"
    if op == "Between":
        low, high = _sql_value(p["low"]), _sql_value(p["high"])
        return None if low is None or high is None else f"({c} >= {low} and {c} <= {high})"
    if op in (*COMPARE, "LikePrefix", "Contains") and (v := _sql_value(p["value"])) is not None:
        return f"({c} {COMPARE[op]} {v})" if op in COMPARE else f"{'startswith' if op == 'LikePrefix' else 'contains'}({c}, {v})"
    return None


def to_expr(p: dict) -> Column:
    """:func:`to_column`, parsed from one SQL text where the predicate is plain: one call instead of several for each part."""
    text = _sql(p)
    return F.expr(text) if text is not None else to_column(p)


def with_null_policy(p: dict, policy: str) -> Column:
    """Which rows a predicate selects where it, or one of its columns, is null."""
    if policy not in NULL_POLICIES:
        raise ArchiveError("bad_null_policy", policy)
    c, cols = to_column(p), [F.col(x).isNull() for x in sorted(columns_of(p))]
    some_null = reduce(lambda a, b: a | b, cols) if cols else F.lit(False)
    match policy:
        case "SqlWhere":
            return F.coalesce(c, F.lit(False))
        case "NullExcluded":
            return F.coalesce(c, F.lit(False)) & ~some_null
        case "NullIncluded":
            return F.coalesce(c, F.lit(False)) | some_null
        case "NullOnly":
            return some_null
    return F.when(some_null, F.raise_error(F.lit("null_rejected")).cast("boolean")).otherwise(F.coalesce(c, F.lit(False)))


def push_negation(p: dict, negative: bool = False) -> dict:
    """No Not above anything but an op without a complement; the same in three-valued logic."""
    op = p["op"]
    if op == "Not":
        return push_negation(p["item"], not negative)
    if op in ("And", "Or"):
        other = {"And": "Or", "Or": "And"}[op] if negative else op
        return pred(other, [push_negation(x, negative) for x in p["items"]])
    if not negative:
        return p
    if op in NEGATED:
        return {**p, "op": NEGATED[op]}
    if op == "Between":
        return OR(pred("Lt", p["column"], p["low"]), pred("Gt", p["column"], p["high"]))
    return NOT(p)


def _flat(op: str, items: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in items:
        for y in x["items"] if x["op"] == op else [x]:
            if y not in out:
                out.append(y)
    return out


def normal_form(p: dict, form: str, most: int = 256) -> dict:
    """CNF or DNF as one And of Ors, or one Or of Ands; more than ``most`` clauses are an error."""
    outer, inner = {"cnf": ("And", "Or"), "dnf": ("Or", "And")}[form]

    def clauses(x: dict) -> list[list[dict]]:
        if x["op"] == outer:
            return [c for y in x["items"] for c in clauses(y)]
        if x["op"] == inner:
            parts = [clauses(y) for y in x["items"]]
            if (n := reduce(lambda a, b: a * len(b), parts, 1)) > most:
                raise ArchiveError("normal_form_too_large", str(n))
            return [_flat(inner, [z for c in combo for z in c]) for combo in itertools.product(*parts)]
        return [[x]]

    return pred(outer, [pred(inner, c) for c in clauses(push_negation(p))])


def intervals(p: dict, column: str) -> list[tuple[object, object]]:
    """Closed bounds (None: open) outside which a conjunction or disjunction over one column selects nothing."""
    op = p["op"]
    if p.get("column") == column:
        v = p.get("value")
        found = {"Eq": [(v, v)], "Lt": [(None, v)], "LtEq": [(None, v)], "Gt": [(v, None)], "GtEq": [(v, None)], "Between": [(p.get("low"), p.get("high"))], "InSet": sorted((x, x) for x in set(p.get("values") or ()) - {None})}
        return found.get(op, [(None, None)])
    if op == "Or":
        return [i for x in p["items"] for i in intervals(x, column)]
    if op == "And":
        out = [(None, None)]
        for x in p["items"]:
            out = [
                (max((v for v in (a, c) if v is not None), default=None), min((v for v in (b, d) if v is not None), default=None))
                for a, b in out for c, d in intervals(x, column)
            ]
        return [(a, b) for a, b in out if a is None or b is None or a <= b]
    return [(None, None)]


_DSL = {"eq": "Eq", "lt": "Lt", "lte": "LtEq", "gt": "Gt", "gte": "GtEq", "in": "InSet", "is_null": "IsNull", "is_not_null": "IsNotNull"}


def _literal(text: str) -> object:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None}.get(text.lower(), text)


def parse_filter(text: str) -> dict:
    """``column op value`` with eq, lt, lte, gt, gte, in (a,b,...), is_null, is_not_null."""
    column, _, rest = text.strip().partition(" ")
    op, _, value = rest.strip().partition(" ")
    if op not in _DSL or not column or (op.startswith("is_") == bool(value.strip())):
        raise ArchiveError("bad_filter", text)
    if op == "in":
        inner = value.strip()
        inner = inner[1:-1] if inner.startswith("(") and inner.endswith(")") else inner
        return pred("InSet", column, [_literal(x) for x in re.findall(r"(?:'[^']*'|\"[^\"]*\"|[^,'\"])+", inner)])
    return pred(_DSL[op], column) if op.startswith("is_") else pred(_DSL[op], column, _literal(value))


#: What a test costs, by operation: bitmaps, then fixed widths, then text, then functions.
_COSTS = {**dict.fromkeys(("True", "False", "IsNull", "IsNotNull"), 0), **dict.fromkeys((*COMPARE, "Between", "InSet", "IsNaN", "IsFinite"), 1), "LikePrefix": 4, "Contains": 5, "FunctionCall": 6}


def cost(p: dict, kinds: dict[str, str]) -> int:
    """Rank of a predicate by its dearest part: nulls, numbers, coded text equality, other text, functions."""
    inner = children(p)
    if p["op"] in ("And", "Or", "Not"):
        return max((cost(x, kinds) for x in inner), default=0)
    own = _COSTS.get(p["op"], 6)
    if own == 1 and kinds.get(p.get("column"), "") in ("string", "binary"):
        own = 2 if p["op"] in ("Eq", "InSet") else 3
    return max([own, *(cost(x, kinds) for x in inner if x["op"] in _COSTS)])


def cost_ordered(p: dict, kinds: dict[str, str]) -> dict:
    """The same predicate with every conjunction's parts from cheap to dear, stably; Spark tests them in this order. ``kinds``: column -> Spark type."""
    if p["op"] in ("And", "Or"):
        parts = [cost_ordered(x, kinds) for x in p["items"]]
        return pred(p["op"], sorted(parts, key=lambda x: cost(x, kinds)) if p["op"] == "And" else parts)
    return pred("Not", cost_ordered(p["item"], kinds)) if p["op"] == "Not" else p


def classify(p: dict) -> str:
    """What a scan can promise: ``exact`` pushed comparison, ``inexact`` (prunes, residual stays), or ``unsupported``."""
    op = p["op"]
    if op in ("Eq", "Lt", "LtEq", "Gt", "GtEq", "Between", "InSet"):
        return "exact"
    if op in ("IsNull", "IsNotNull", "LikePrefix"):
        return "inexact"
    if op == "And":
        kinds = {classify(x) for x in p["items"]}
        return "exact" if kinds == {"exact"} else "unsupported" if kinds == {"unsupported"} else "inexact"
    if op == "Or":
        return "unsupported" if any(classify(x) == "unsupported" for x in p["items"]) else "inexact"
    return "unsupported"
