"""Proof-safe data skipping over zones of rows.

A zone is a group of rows named by one or more columns (a morsel: 4,096 rows).
One aggregation makes its statistics; a predicate over them has one of four
outcomes, and only a zone that certainly has no match is skipped. What remains
is filtered again by the whole predicate, so skipping can never change a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.predicates import columns_of, push_negation, to_column

NO, SOME, ALL, UNKNOWN = 0, 1, 2, 3
MORSEL_ROWS = 4096


def morsel(ordinal: Column | str) -> Column:
    return F.floor(F.col(ordinal) / MORSEL_ROWS if isinstance(ordinal, str) else ordinal / MORSEL_ROWS).cast("long")


def zone_stats(df: DataFrame, zone: list[str], columns: list[str], sums: bool = False) -> DataFrame:
    """One row per zone: ``rows``, and for each column ``c__nulls``, ``c__min``, ``c__max``, ``c__nan``.

    With ``sums``, integers and decimals also have ``c__sum``, exact, and truth values ``c__true`` and ``c__false`` instead.
    """
    kinds = dict(df.dtypes)
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        real = kinds[c] in ("double", "float")
        v = F.when(~F.isnan(c), F.col(c)) if real else F.col(c)
        nan = F.max(F.coalesce(F.isnan(c), F.lit(False))) if real else F.lit(False)
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"), nan.alias(f"{c}__nan")]
        if sums and (exact := exact_sum_type(kinds[c])):
            aggs.append(F.sum(F.col(c).cast(exact)).alias(f"{c}__sum"))
        if sums and kinds[c] == "boolean":
            aggs += [F.count_if(F.col(c)).alias(f"{c}__true"), F.count_if(~F.col(c)).alias(f"{c}__false")]
    return df.groupBy(*zone).agg(*aggs)


def exact_sum_type(kind: str) -> str | None:
    """The decimal type in which sums of a type are exact: as many places as the type has, 38 digits in all."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "decimal(38,0)"
    return f"decimal(38,{kind.rpartition(',')[2].rstrip(')')})" if kind.startswith("decimal") else None


def zone_order(df: DataFrame, zone: list[str], column: str, at: str) -> DataFrame:
    """(zone, sorted, runs): whether a zone's values never fall along ``at``, nulls first, and how many runs of equal values it has. Zones are of bounded size."""
    w = Window.partitionBy(*zone).orderBy(at)
    c, before = F.col(column), F.lag(column).over(w)
    first = F.row_number().over(w) == 1
    falls = F.coalesce((before > c) | (before.isNotNull() & c.isNull()), F.lit(False)) & ~first
    new = first | ~before.eqNullSafe(c)
    marked = df.select(*zone, falls.alias("__f"), new.alias("__n"))
    return marked.groupBy(*zone).agg((~F.max("__f")).alias("sorted"), F.count_if("__n").alias("runs"))


def truncated_stats(stats: DataFrame, column: str, length: int) -> DataFrame:
    """Statistics with a text column's bounds cut to ``length`` characters: the lower one as a prefix, the upper one as a prefix with the largest character after it. Such bounds can rule a zone out, and never in; ``c__cut`` says so."""
    low, high = F.col(f"{column}__min"), F.col(f"{column}__max")
    cut = (F.length(low) > length) | (F.length(high) > length)
    # whatever follows the prefix is below it with the largest character
    above = F.when(F.length(high) <= length, high).otherwise(F.concat(F.substring(high, 1, length), F.lit("\U0010ffff")))
    return stats.withColumns({f"{column}__cut": F.coalesce(cut, F.lit(False)), f"{column}__min": F.substring(low, 1, length), f"{column}__max": above})


def describe_zones(df: DataFrame, zone: list[str], column: str) -> DataFrame:
    """Statistics of one column with flags: constant, all null, has NaN, distinct values."""
    s = zone_stats(df, zone, [column]).join(df.groupBy(*zone).agg(F.count_distinct(column).alias("distinct")), zone)
    c = lambda x: F.col(f"{column}__{x}")
    return s.select(*zone, "rows", c("nulls").alias("nulls"), c("min").alias("min"), c("max").alias("max"), "distinct", (c("nulls") == 0).__and__(c("min") == c("max")).alias("constant"), (c("nulls") == F.col("rows")).alias("all_null"), c("nan").alias("has_nan"))


def outcome_and(a: Column, b: Column) -> Column:
    """No dominates, All is neutral; Unknown with Some is Some."""
    return F.when((a == NO) | (b == NO), NO).when(a == ALL, b).when(b == ALL, a).when((a == SOME) | (b == SOME), SOME).otherwise(UNKNOWN)


def outcome_or(a: Column, b: Column) -> Column:
    """All dominates, No is neutral."""
    return F.when((a == ALL) | (b == ALL), ALL).when(a == NO, b).when(b == NO, a).when((a == SOME) | (b == SOME), SOME).otherwise(UNKNOWN)


def outcome_not(a: Column, null_free: Column) -> Column:
    """All becomes No; No becomes All only where no null or NaN can make the predicate unknown."""
    return F.when(a == ALL, NO).when((a == NO) & null_free, ALL).when(a == NO, UNKNOWN).otherwise(a)


def outcome(p: dict, truncated: frozenset[str] = frozenset()) -> Column:
    """The outcome of a predicate as a Column over :func:`zone_stats` rows; the bounds of ``truncated`` columns may be cut (:func:`truncated_stats`)."""
    op = p["op"]
    if op in ("And", "Or"):
        join = outcome_and if op == "And" else outcome_or
        return reduce(join, [outcome(x, truncated) for x in p["items"]], F.lit(ALL if op == "And" else NO))
    if op == "Not":
        inner = push_negation(p)
        if inner["op"] != "Not":
            return outcome(inner, truncated)
        clean = reduce(lambda a, b: a & b, [(F.col(f"{c}__nulls") == 0) & ~F.col(f"{c}__nan") for c in columns_of(p)], F.lit(True))
        return outcome_not(outcome(inner["item"], truncated), clean)
    if op in ("True", "False"):
        return F.lit(ALL if op == "True" else NO)
    if "column" not in p:
        return F.lit(UNKNOWN)
    low, high, nulls, nan = (F.col(f"{p['column']}__{x}") for x in ("min", "max", "nulls", "nan"))
    rows, cut = F.col("rows"), F.col(f"{p['column']}__cut") if p["column"] in truncated else F.lit(False)
    if op in ("IsNull", "IsNotNull"):
        none, every = (NO, ALL) if op == "IsNull" else (ALL, NO)
        return F.when(nulls == 0, none).when(nulls == rows, every).otherwise(SOME)

    def decide(never: Column, always: Column) -> Column:
        # NaN takes part in no order that the statistics know
        return F.when(nulls == rows, NO).when(nan, UNKNOWN).when(never, NO).when(always & (nulls == 0) & ~cut, ALL).otherwise(SOME)

    v = F.lit(p["value"]) if "value" in p else None
    match op:
        case "Eq":
            return decide((low > v) | (high < v), (low == v) & (high == v))
        case "NotEq":
            return decide((low == v) & (high == v) & ~cut, (low > v) | (high < v))
        case "Lt":
            return decide(low >= v, high < v)
        case "LtEq":
            return decide(low > v, high <= v)
        case "Gt":
            return decide(high <= v, low > v)
        case "GtEq":
            return decide(high < v, low >= v)
        case "Between":
            a, b = F.lit(p["low"]), F.lit(p["high"])
            return decide((low > b) | (high < a) | (a > b), (low >= a) & (high <= b))
        case "InSet":
            values = [x for x in p["values"] if x is not None]
            return reduce(outcome_or, [outcome({"op": "Eq", "column": p["column"], "value": x}, truncated) for x in values], F.lit(NO))
        case "LikePrefix":
            return decide((high < v) | (low > F.concat(v, F.lit("\U0010ffff"))), low.startswith(p["value"]) & high.startswith(p["value"]))
    return F.lit(UNKNOWN)


def three_valued(c: Column) -> Column:
    """The surface vocabulary: definitely_no, definitely_yes, unknown."""
    return F.when(c == NO, "definitely_no").when(c == ALL, "definitely_yes").otherwise("unknown")


def surviving(stats: DataFrame, zone: list[str], p: dict) -> DataFrame:
    """The zones that may hold a match."""
    return stats.where(outcome(p) != NO).select(*zone)


def pruned_scan(df: DataFrame, zone: list[str], stats: DataFrame | None, p: dict, *more: DataFrame) -> DataFrame:
    """Rows of ``df`` that match: zones that cannot are left out, the predicate is then applied in full.

    ``more`` are further zone sets that are known to hold every match (of indexes
    or coverage); without statistics this is the plain scan.
    """
    for keep in [*([surviving(stats, zone, p)] if stats is not None else []), *more]:
        df = df.join(keep.distinct(), zone, "left_semi")
    return df.where(to_column(p))


def explain_pruning(stats: DataFrame, zone: list[str], p: dict) -> DataFrame:
    """For each zone the decision, the outcome, and the first conjunct that rules it out."""
    parts = p["items"] if p["op"] == "And" else [p]
    why = F.coalesce(*[F.when(outcome(x) == NO, F.lit(x["op"] + ":" + ",".join(sorted(columns_of(x))))) for x in parts], F.lit("none"))
    names = F.element_at(F.array(*map(F.lit, ("no_match", "some_match", "all_match", "unknown"))), outcome(p) + 1)
    return stats.select(*zone, "rows", F.when(outcome(p) == NO, "pruned").otherwise("kept").alias("decision"), names.alias("outcome"), why.alias("evidence"))


def plan_cost(stats: DataFrame, p: dict) -> DataFrame:
    """One row: zones and rows considered, pruned, certain to match whole."""
    o = outcome(p)
    return stats.agg(F.count("*").alias("zones"), F.count_if(o == NO).alias("zones_pruned"), F.count_if(o == ALL).alias("zones_whole"), F.sum("rows").alias("rows"), F.coalesce(F.sum(F.when(o == NO, F.col("rows"))), F.lit(0)).alias("rows_pruned"))


def exact_sets(df: DataFrame, zone: list[str], column: str) -> DataFrame:
    """(zone, key): the values that each zone holds. A zone without a requested value cannot match."""
    return df.where(F.col(column).isNotNull()).select(*zone, F.col(column).alias("key")).distinct()


def inverted_index(df: DataFrame, zone: list[str], column: str) -> DataFrame:
    """(key, zones): sorted zones of each key, for keys with few zones; use :func:`exact_sets` rows to look up."""
    return exact_sets(df, zone, column).groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*zone) if len(zone) > 1 else F.col(zone[0]))).alias("zones"))


def zones_of_keys(index: DataFrame, zone: list[str], keys: list[object]) -> DataFrame:
    return index.where(F.col("key").isin([k for k in keys if k is not None])).select(*zone).distinct()


def composite_zones(df: DataFrame, zone: list[str], columns: list[str]) -> DataFrame:
    """Distinct value tuples of each zone, for conjunctions of memberships over several columns."""
    return df.dropna(subset=columns).select(*zone, *columns).distinct()


def top_n_summary(df: DataFrame, zone: list[str], column: str, n: int, largest: bool = True) -> DataFrame:
    """(zone, place, value): the n largest or smallest values of each zone."""
    order = F.col(column).desc() if largest else F.col(column).asc()
    w = Window.partitionBy(*zone).orderBy(order)
    return df.where(F.col(column).isNotNull()).select(*zone, F.col(column).alias("value"), F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def top_n_zones(summary: DataFrame, zone: list[str], n: int, largest: bool = True) -> DataFrame:
    """Zones that can hold one of the n extreme rows of all: those with a value at or beyond the n-th summarised one."""
    order = F.col("value").desc() if largest else F.col("value").asc()
    nth = summary.orderBy(order).limit(n).agg((F.min if largest else F.max)("value").alias("nth"))
    best = summary.groupBy(*zone).agg((F.max if largest else F.min)("value").alias("best"))
    return best.join(F.broadcast(nth), F.col("best") >= F.col("nth") if largest else F.col("best") <= F.col("nth")).select(*zone)


def domain(df: DataFrame, column: str) -> DataFrame:
    """(value, rank): distinct values in byte order, numbered over sorted ranges of them."""
    from .ordinals import numbered

    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return numbered(values, ["value"], "rank").withColumn("rank", F.col("rank").cast("int"))


def domain_outcome(ranges: DataFrame, ranks: DataFrame, zone: list[str], low: object = None, high: object = None) -> DataFrame:
    """(zone, outcome) of ``low <= value <= high`` from a column's domain and the ranks that each zone holds: no rank of the domain in the interval, or none in the zone's, is a sure no."""
    inside = ranks
    if low is not None:
        inside = inside.where(F.col("value") >= F.lit(low))
    if high is not None:
        inside = inside.where(F.col("value") <= F.lit(high))
    span = inside.agg(F.min("rank").alias("a"), F.max("rank").alias("b")).first()
    if span.a is None:
        return ranges.select(*zone, F.lit(NO).alias("outcome"))
    no = (F.col("high_rank") < span.a) | (F.col("low_rank") > span.b)
    every = (F.col("low_rank") >= span.a) & (F.col("high_rank") <= span.b)
    nulls = F.col("nulls") > 0 if "nulls" in ranges.columns else F.lit(True)
    return ranges.select(*zone, F.when(no, NO).when(every & ~nulls, ALL).otherwise(SOME).alias("outcome"))


def domain_rank_ranges(df: DataFrame, zone: list[str], column: str) -> DataFrame:
    """(zone, low_rank, high_rank) over the column's domain."""
    ranked = df.select(*zone, F.col(column).alias("value")).join(domain(df, column), "value")
    return ranked.groupBy(*zone).agg(F.min("rank").alias("low_rank"), F.max("rank").alias("high_rank"))


def bloom_index(df: DataFrame, zone: list[str], column: str, bits: int = 8192, hashes: int = 4) -> DataFrame:
    """(zone, bits): set positions of a Bloom filter of each zone; may only rule out."""
    places = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(i)), F.lit(bits)).cast("int") for i in range(hashes)]))
    return df.where(F.col(column).isNotNull()).select(*zone, places.alias("p")).distinct().groupBy(*zone).agg(F.sort_array(F.collect_list("p")).alias("bits"))


def bloom_zones(index: DataFrame, zone: list[str], value: Column, bits: int = 8192, hashes: int = 4) -> DataFrame:
    """Zones that may hold ``value``."""
    probes = [F.array_contains("bits", F.pmod(F.xxhash64(value, F.lit(i)), F.lit(bits)).cast("int")) for i in range(hashes)]
    return index.where(reduce(lambda a, b: a & b, probes)).select(*zone)


def z_order(*ranks: Column, bits: int = 16) -> Column:
    """Bit-interleaved key of non-negative integer columns below 2**bits, for clustering."""
    n = len(ranks)
    parts = [F.shiftleft(F.shiftright(r.cast("long"), i).bitwiseAND(F.lit(1)), i * n + k) for i in range(bits) for k, r in enumerate(ranks)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Place along a Hilbert curve of non-negative integer columns below 2**bits: near keys are near in both."""
    one = F.lit(1).cast("long")
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def turn(a: Column, i: Column) -> Column:
        side = F.call_function("shiftleft", one, i)
        rx, ry = (F.when(a[c].bitwiseAND(side) > 0, 1).otherwise(0) for c in "xy")
        last = F.lit((1 << bits) - 1).cast("long")
        step = a["d"] + side * side * (rx * 3).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        u, v = F.when(flip, last - a["x"]).otherwise(a["x"]), F.when(flip, last - a["y"]).otherwise(a["y"])
        return F.struct(F.when(ry == 0, v).otherwise(u).alias("x"), F.when(ry == 0, u).otherwise(v).alias("y"), step.cast("long").alias("d"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, turn, lambda a: a["d"])


#: Steps of a column's range along a curve.
_STEPS = 64


def _upto(n: Column):
    """A test of one argument: Spark gives a second one, even one with a default, the element's place."""
    return lambda c: c <= n


def with_curve(df: DataFrame, out: str, columns: tuple[str, ...], kind: str = "z") -> DataFrame:
    """Add a clustering key along a curve over columns of numbers or times; each is cut into steps of about equal counts, nulls first."""
    numbers = [F.col(c).cast("timestamp").cast("double") if t.startswith(("timestamp", "date")) else F.col(c).cast("double") for c, t in ((c, dict(df.dtypes)[c]) for c in columns)]
    marks = df.agg(*(F.percentile_approx(n, [i / _STEPS for i in range(1, _STEPS)], 1000).alias(f"m{i}") for i, n in enumerate(numbers))).first()
    ranks = []
    for n, cuts in zip(numbers, marks):
        cuts = F.array(*(F.lit(float(x)) for x in sorted(set(cuts or ()))))
        ranks.append(F.coalesce(F.size(F.filter(cuts, _upto(n))), F.lit(0)).cast("long"))
    bits = (_STEPS - 1).bit_length()
    return df.withColumn(out, hilbert(*ranks, bits=bits) if kind == "hilbert" else z_order(*ranks, bits=bits))


def synopsis_outcome(proves_no_match: Column, usable: Column) -> Column:
    """What a caller's synopsis says of a zone: a stale or corrupt one says nothing."""
    return F.when(~F.coalesce(usable, F.lit(False)), UNKNOWN).when(proves_no_match, NO).otherwise(SOME)
