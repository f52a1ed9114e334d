"""Personal data: regular expressions propose spans, checksums confirm them, context scores them.

Everything is SQL expressions on one row: no Python, no shuffle. A pattern's
matches and the gaps between them come from two passes of the same expression
(extract all and split), so the offset of a match is a running sum of lengths
of gaps and matches; offsets count code points, ends are exclusive. Running sums
are made by doubling steps over whole arrays, and texts are cut by blocks, so
that a text with a million matches costs its length times a logarithm.

The patterns are the contract's, written with possessive quantifiers and, where
a run of characters can only match from its start, with a look-behind: the
matches are the same, but a long run costs linear time and constant stack.
Where an IBAN ends cannot be told by its characters: its pattern finds the start,
and of all ends that the contract's pattern allows, the checksum tells which hold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, pinned


@dataclass(frozen=True)
class Kind:
    """A pattern, the check of a match (from its SQL to SQL), a string that any match has, and what its score is made of.

    With ``ends``, the pattern matches the start only; its group 1 is the longest run of characters that may
    belong to the match, its group 2 what cuts that run's last word. ``ends`` (from their SQL to SQL) gives the match, or null.
    """

    name: str
    pattern: str
    check: Callable[[str], str] | None
    has: str
    prior: float
    checksum: float
    near: str
    ends: Callable[[str, str], str] | None = None


def _digits(m: str) -> str:
    return f"translate({m}, translate({m}, '0123456789', ''), '')"


def _ip_parts(m: str) -> str:
    return f"forall(split({m}, '\\\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)"


def _luhn(m: str) -> str:
    """12 to 19 digits; from the right, every second digit counts double, less 9 above 9."""
    d = _digits(m)
    return (
        f"length({d}) between 12 and 19 and aggregate(split({d}, ''), named_struct('odd', length({d}) % 2, 'sum', 0), (a, c) -> "
        "if(c = '', a, named_struct('odd', 1 - a.odd, 'sum', a.sum + if(a.odd = 1, ascii(c) - 48, (ascii(c) - 48) * 2 - if(c >= '5', 9, 0)))), a -> a.sum % 10 = 0)"
    )


def _phone_digits(m: str) -> str:
    return f"length({_digits(m)}) between 9 and 15"


def _mod97(m: str) -> str:
    """Country and check digits go to the end, letters count 10 to 35; the remainder by 97 is 1."""
    d = f"replace({m}, ' ', '')"
    return (
        f"aggregate(split(concat(substring({d}, 5), substring({d}, 1, 4)), ''), 0, (a, c) -> "
        "if(c = '', a, if(c between '0' and '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))) = 1"
    )


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _iban(run: str, cut: str) -> str:
    """Of the parts of the run that end where a word does and pass, the one of its country's length, else the longest."""
    size = "length(replace(p, ' ', ''))"
    known = "map(" + ", ".join(f"'{c}', {n}" for c, n in IBAN_LENGTHS.items()) + ")"
    parts = f"transform(filter(sequence(15, length({run})), e -> if(e = length({run}), {cut} = '', substring({run}, e + 1, 1) = ' ')), e -> substring({run}, 1, e))"
    passed = f"filter({parts}, p -> {size} between 15 and 34 and {_mod97('p')})"
    return f"array_max(transform({passed}, p -> named_struct('own', coalesce({size} = {known}[left(p, 2)], false), 'n', length(p), 'm', p))).m"


BASE = ("email", "ip", "card", "phone")
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, "@", 0.9, 0, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip_parts, ".", 0.6, 0, "ip|host|server|addr|client|adresse|servidor"),
    # runs of fewer than 12 digits fail the check in any case
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", _luhn, "", 0.6, 0.2, "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone_digits, "+", 0.6, 0, "tel|phone|call|fax|mobile|anruf|appel|llama"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+)([A-Za-z0-9]?))[A-Z]{2}[0-9]{2}", None, "", 0.4, 0.4, "iban|account|bank|konto|compte|cuenta", _iban),
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(array: str, joined: Callable[[str, str], str]) -> str:
    """SQL for the running total of an array column under an associative operation: after step k, totals reach 2^(k+1) back."""
    back = "shiftleft(1, k)"
    return (
        f"aggregate(sequence(0, cast(ceil(log2(greatest(size({array}), 1))) as int)), {array}, "
        f"(a, k) -> transform(a, (x, i) -> if(i >= {back}, {joined('x', f'get(a, i - {back})')}, x)))"
    )


#: Matches of one short list, which is copied whenever one is added.
_SHORT = 256


def _apart(spans: str) -> str:
    """SQL: of spans by start, those that do not begin inside the one kept before; kept ones gather in short lists."""
    item = "array<struct<start:int,rank:int,m:string,before:string>>"
    add = "array_append(a.now, x)"
    return (
        f"aggregate({spans}, named_struct('end', -1, 'now', cast(array() as {item}), 'done', cast(array() as array<{item}>)), (a, x) -> if(x.start < a.end, a, "
        f"if(size(a.now) < {_SHORT}, named_struct('end', x.start + length(x.m), 'now', {add}, 'done', a.done), "
        "named_struct('end', x.start + length(x.m), 'now', array(x), 'done', array_append(a.done, a.now)))), a -> flatten(array_append(a.done, a.now)))"
    )


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii", *, context: int = 40, context_bonus: float = 0.2, min_score: float = 0.5) -> DataFrame:
    """Add ``out``: array of structs (start, kind, end, score), by start, then by the order of :data:`KINDS`.

    A null or empty text has no spans, spans of different kinds may overlap, and
    repeated rows have the same spans. A column of the table that is named like
    ``out`` is replaced, all others stay. The score is the kind's prior, plus a
    bonus for a passed checksum and one for a context word among the last
    ``context`` characters between the pattern's match before and this one.
    Spans of the four base kinds always stay; spans of added kinds stay from
    ``min_score`` on. A row's text, its matches and the gaps between them are
    held at once.
    """
    t = f"{OWN}t"
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    parts = []
    for rank, k in enumerate(KINDS):
        m, g, e, s = (f"{OWN}{a}{rank}" for a in "mges")
        re = _quoted(k.pattern)
        df = df.withColumn(m, F.expr(f"if(contains({t}, '{k.has}'), regexp_extract_all({t}, {re}, 0), array())"))
        df = df.withColumn(g, F.expr(f"if(size({m}) > 0, split({t}, {re}, -1), array())"))
        # running end of each match: lengths of the gaps and matches so far
        df = df.withColumn(e, F.expr(f"transform({m}, (x, i) -> length(get({g}, i)) + length(x))"))
        df = df.withColumn(e, F.expr(_running(e, lambda x, y: f"{x} + {y}")))
        start, before = f"get({e}, i) - length(x)", f"right(get({g}, i), {context})"
        if k.ends:
            runs, cuts = f"{OWN}r{rank}", f"{OWN}c{rank}"
            for name, group in ((runs, 1), (cuts, 2)):
                df = df.withColumn(name, F.expr(f"if(size({m}) > 0, regexp_extract_all({t}, {re}, {group}), array())"))
            df = df.withColumn(s, F.expr(f"filter(transform({m}, (x, i) -> named_struct('start', {start}, 'rank', {rank}, 'm', {k.ends(f'get({runs}, i)', f'get({cuts}, i)')}, 'before', {before})), x -> x.m is not null)"))
            # what begins inside a match is part of it
            df = df.withColumn(s, F.expr(f"transform({_apart(s)}, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.start + length(x.m), 'm', x.m, 'before', x.before))"))
        else:
            df = df.withColumn(s, F.expr(f"transform({m}, (x, i) -> named_struct('start', {start}, 'rank', {rank}, 'end', get({e}, i), 'm', x, 'before', {before}))"))
        check = k.check("x.m") if k.check else "true"
        score = f"least(1D, {k.prior + k.checksum}D + if(lower(x.before) rlike '{k.near}', {context_bonus}D, 0D))"
        keep = "true" if k.name in BASE else f"{score} >= {min_score}D"
        df = df.withColumn(s, F.expr(f"transform(filter({s}, x -> {check} and {keep}), x -> named_struct('start', x.start, 'rank', x.rank, 'kind', '{k.name}', 'end', x.end, 'score', {score}))"))
        parts.append(s)
    joined = df.withColumn(out, F.expr(f"transform(sort_array(concat({', '.join(parts)})), x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'score', x.score))"))
    return pinned(joined, out).drop(t, *(f"{OWN}{a}{i}" for i in range(len(KINDS)) for a in "mgersc"))


#: Characters of a block of a text that is cut at many places.
_BLOCK = 4096


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans become one, named by the first.

    A null text stays null, repeated rows stay. Only ``text`` (and ``n_chars`` where the table has
    it) changes; all other columns and rows stay.
    """
    spans, reach, first, cut, blocks = (f"{OWN}{x}" for x in ("sp", "reach", "first", "cut", "blocks"))
    df = with_spans(docs, text, spans)
    # runs of overlapping spans, each with the kind of its first span: a run begins where all spans before have ended
    df = df.withColumn(reach, F.expr(f"transform({spans}, x -> x.end)"))
    df = df.withColumn(reach, F.expr(_running(reach, lambda x, y: f"greatest({x}, {y})")))
    df = df.withColumn(first, F.expr(f"filter(transform({spans}, (x, i) -> if(i = 0 or x.start >= get({reach}, i - 1), i, -1)), i -> i >= 0)"))
    df = df.withColumn(cut, F.expr(f"transform({first}, (i, k) -> named_struct('start', get({spans}, i).start, 'kind', get({spans}, i).kind, 'end', get({reach}, coalesce(get({first}, k + 1), size({spans})) - 1)))"))
    df = df.withColumn(blocks, F.expr(f"if(size({cut}) = 0, array(), regexp_extract_all(`{text}`, '(?s).{{1,{_BLOCK}}}', 0))"))

    def piece(a: str, b: str) -> str:
        """Characters a to b of the text, out of the blocks that hold them."""
        low, high = f"({a}) div {_BLOCK}", f"({b}) div {_BLOCK}"
        tail = f"substring(get({blocks}, cast({low} as int)), 1 + ({a}) % {_BLOCK}, {_BLOCK})"
        head = f"substring(coalesce(get({blocks}, cast({high} as int)), ''), 1, ({b}) % {_BLOCK})"
        inner = f"substring(get({blocks}, cast({low} as int)), 1 + ({a}) % {_BLOCK}, ({b}) - ({a}))"
        between = f"array_join(slice({blocks}, cast({low} as int) + 2, cast({high} - {low} - 1 as int)), '')"
        return f"if({a} >= {b}, '', if({low} = {high}, {inner}, concat({tail}, {between}, {head})))"

    start = f"coalesce(get({cut}, i - 1).end, 0)"
    pieces = f"transform({cut}, (x, i) -> concat({piece(start, 'x.start')}, '[', upper(x.kind), ']'))"
    rest = f"substring(`{text}`, 1 + element_at({cut}, -1).end)"
    df = df.withColumn(text, F.expr(f"if(size({cut}) = 0, `{text}`, concat(array_join({pieces}, ''), {rest}))"))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.expr(f"if(size({cut}) = 0, n_chars, cast(length(`{text}`) as bigint))"))
    return df.drop(spans, reach, first, cut, blocks)
