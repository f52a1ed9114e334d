"""Canonical bytes, key digests and deterministic object ids, as Column expressions.

Integers are little-endian; lengths are unsigned 64-bit, counts and type ids
unsigned 32-bit. All of it stays in the JVM but Unicode normal forms, for which
Spark has no function.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.sources.tables import ArchiveError

#: Marker that opens a join-key tuple; give another one to reproduce another tool's digests.
KEY_MARKER = b"JOIN-KEY-V1"
KEY_TYPES = ("bool", "int64", "uint64", "float64", "utf8", "binary")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _le(hex16: Column, size: int) -> Column:
    """The low ``size`` bytes of a 16-digit hexadecimal number, least significant first."""
    return F.unhex(F.concat(*[F.substring(hex16, 17 - 2 * (i + 1), 2) for i in range(size)]))


def le64(c: Column) -> Column:
    return _le(F.lpad(F.hex(c.cast("long")), 16, "0"), 8)


def le32(c: Column) -> Column:
    return _le(F.lpad(F.hex(c.cast("long")), 16, "0"), 4)


def with_length(b: Column) -> Column:
    b = b.cast("binary")
    n = F.octet_length(b)
    # one byte of length and seven of nothing, for what is short
    short = F.unhex(F.concat(F.lpad(F.hex(n), 2, "0"), F.lit("0" * 14)))
    return F.concat(F.when(n < 256, short).otherwise(le64(n)), b)


def _sized(b: bytes) -> bytes:
    """:func:`with_length` of what is known."""
    return len(b).to_bytes(8, "little") + b


def _lit(b: bytes) -> Column:
    return F.lit(bytearray(b))


def component_bytes(c: Column, kind: str) -> Column:
    """Canonical bytes of a key component of one of KEY_TYPES."""
    match kind:
        case "bool":
            return F.when(c.cast("boolean"), F.lit(bytearray(b"\x01"))).otherwise(F.lit(bytearray(b"\x00")))
        case "int64" | "uint64":
            return le64(c)
        case "utf8" | "binary":
            return c.cast("binary")
        case "float64":
            raise ArchiveError("float_key", "a float key needs its bits: pass them as int64")
    raise ArchiveError("bad_key_type", kind)


def join_key(object_type_id: int, rule: str, components: list[tuple[str, str, Column]], marker: bytes = KEY_MARKER) -> Column:
    """The byte tuple of a key: marker, type, rule, then (role, type, presence, bytes) of each component. Null is not empty."""
    known, parts = marker + object_type_id.to_bytes(4, "little") + _sized(rule.encode()) + len(components).to_bytes(4, "little"), []
    for role, kind, c in components:
        known += _sized(role.encode()) + _sized(kind.encode())
        made = component_bytes(c, kind)
        value = with_length(made) if kind in ("utf8", "binary") else F.concat(_lit((1 if kind == "bool" else 8).to_bytes(8, "little")), made)
        parts += [_lit(known), F.when(c.isNull(), _lit(b"\x00")).otherwise(F.concat(_lit(b"\x01"), value))]
        known = b""
    return F.concat(*parts) if parts else _lit(known)


# The same as SQL over named columns: one expression is parsed at once, where each Column call is a trip to the JVM.
def _hexed(b: bytes) -> str:
    return f"X'{b.hex()}'"


def _le_sql(value: str, size: int = 8) -> str:
    digits = f"lpad(hex(cast({value} as bigint)), 16, '0')"
    return f"unhex(concat({', '.join(f'substring({digits}, {15 - 2 * i}, 2)' for i in range(size))}))"


def sized_sql(binary: str) -> str:
    """:func:`with_length` of a binary expression."""
    n = f"octet_length({binary})"
    return f"concat(if({n} < 256, unhex(concat(lpad(hex({n}), 2, '0'), '{'0' * 14}')), {_le_sql(n)}), {binary})"


def key_sql(object_type_id: int, rule: str, components: list[tuple[str, str, str]], marker: bytes = KEY_MARKER) -> str:
    """:func:`join_key` of components (role, kind, column name)."""
    known, parts = marker + object_type_id.to_bytes(4, "little") + _sized(rule.encode()) + len(components).to_bytes(4, "little"), []
    for role, kind, c in components:
        known += _sized(role.encode()) + _sized(kind.encode())
        if kind in ("utf8", "binary"):
            value = sized_sql(f"cast(`{c}` as binary)")
        elif kind == "bool":
            value = f"concat({_hexed((1).to_bytes(8, 'little'))}, if(cast(`{c}` as boolean), X'01', X'00'))"
        elif kind in ("int64", "uint64"):
            value = f"concat({_hexed((8).to_bytes(8, 'little'))}, {_le_sql(f'`{c}`')})"
        else:
            component_bytes(F.lit(0), kind)
        parts += [_hexed(known), f"if(`{c}` is null, X'00', concat(X'01', {value}))"]
        known = b""
    return f"concat({', '.join(parts)})" if parts else _hexed(known)


def goid_sql(mapping_id: bytes, version: str, type_id: int, rule: str, tuple_: str, scope: str) -> str:
    """:func:`goid` of a binary column and a string expression."""
    head = _sized(mapping_id) + _sized(version.encode()) + _sized(type_id.to_bytes(4, "little")) + _sized(rule.encode())
    return f"substring(sha2(concat({_hexed(head)}, {sized_sql(tuple_)}, {sized_sql(f'cast({scope} as binary)')}), 256), 1, 32)"


def digest(b: Column) -> Column:
    return F.sha2(b, 256)


def goid(mapping_id: bytes, version: str, type_id: int, rule: str, tuple_: Column, scope: Column) -> Column:
    """The 32-digit object id: half of a digest over length-prefixed parts. It depends on the row alone."""
    head = _sized(mapping_id) + _sized(version.encode()) + _sized(type_id.to_bytes(4, "little")) + _sized(rule.encode())
    return F.substring(F.sha2(F.concat(_lit(head), with_length(tuple_), with_length(scope)), 256), 1, 32)


def record_id(source: Column, row: Column, rule: Column, goid_: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source, row.cast("string"), rule, goid_), 256), 1, 32)


def row_digest(names: list[str]) -> Column:
    """Digest of the row as JSON with sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{n}`") for n in sorted(names)]), {"ignoreNullFields": "false"}), 256)


def row_schema_digest(kinds: dict[str, str]) -> Column:
    """Digest of a row's sorted ``name:type``, by column name -> Spark type; a null's type is null."""
    names = {"boolean": "bool", "tinyint": "int64", "smallint": "int64", "int": "int64", "bigint": "int64", "float": "float64", "double": "float64"}
    kind = lambda t: names.get(t) or ("list" if t.startswith("array") else "struct" if t.startswith(("struct", "map")) else "float64" if t.startswith("decimal") else "utf8")
    return F.sha2(F.concat_ws("|", *(F.concat(F.lit(f"{n}:"), F.when(F.col(f"`{n}`").isNull(), "null").otherwise(kind(kinds[n]))) for n in sorted(kinds))), 256)


def property_id(name: str, ordinal: int) -> int:
    """The first four bytes of the name's digest, little-endian; 0 gives way to the ordinal."""
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "little") or ordinal


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, _LOWER, _UPPER)


def trim_all(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$", "")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def _checked(c: Column, parsed: Column, what: str) -> Column:
    return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit(f"{what}: "), c.cast("string"))).cast("string")).otherwise(parsed)


FUNCTIONS = {
    "identity": lambda c: c,
    "trim": trim_all,
    "ascii_lower": ascii_lower,
    "trim_lower": lambda c: ascii_lower(trim_all(c)),
    "unicode_nfc": _nfc,
    "unicode_nfkc": _nfkc,
    "unicode_casefold": _casefold,
    "parse_int64": lambda c: _checked(c, trim_all(c).try_cast("bigint").cast("string"), "parse_int64"),
    "parse_decimal": lambda c: _checked(c, trim_all(c).try_cast("decimal(38,18)").cast("string"), "parse_decimal"),
    "parse_timestamp_utc": lambda c: _checked(c, F.unix_micros(F.try_to_timestamp(trim_all(c))).cast("string"), "parse_timestamp_utc"),
    "sha256_hex": lambda c: F.sha2(c.cast("binary"), 256),
}


def canonicalise(c: Column, names: list[str], declared: list[str] | None = None) -> Column:
    """Apply named functions in order; one that is unknown, or not declared where declarations are given, is an error."""
    for n in names:
        if n not in FUNCTIONS or (declared is not None and n not in declared):
            raise ArchiveError("undeclared_function", n)
        c = FUNCTIONS[n](c)
    return c


def concat_delimited(*columns: Column) -> Column:
    """Parts joined by a bar; a null part is empty."""
    return reduce(lambda a, b: F.concat(a, F.lit("|"), b), [F.coalesce(c, F.lit("")) for c in columns])
