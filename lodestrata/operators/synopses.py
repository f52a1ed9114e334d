"""Per-zone synopses and aggregates that they answer without a scan.

Exact synopses (counts, minima and maxima, checked sums, histograms, truth
counts) may answer exact queries, and only if all rows are covered and visible
and the column is not redacted; else the answer is None and the caller scans.
Sketches (distinct, quantiles) are approximate and never answer exact queries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .zones import exact_sum_type

#: What each synopsis may answer: an approximate one never answers an exact query.
ACCURACY = {**dict.fromkeys(("count", "min_max", "sum", "histogram", "truth_counts", "distinct_keys"), "exact"), **dict.fromkeys(("distinct_sketch", "quantile_sketch", "top_k_sketch"), "approximate")}


def may_answer(kind: str, *, exact: bool) -> bool:
    """Whether a synopsis may answer a query, by its accuracy; an unknown kind may not."""
    return ACCURACY.get(kind) == "exact" or not exact and ACCURACY.get(kind) == "approximate"


@dataclass
class Synopses:
    """Metadata of one table: zone-level facts, and what keeps them from answering."""

    facts: DataFrame
    zone: list[str]
    columns: list[str]
    histograms: dict[str, DataFrame] = field(default_factory=dict)
    redacted: frozenset[str] = frozenset()
    all_visible: bool = True

    def usable(self, *columns: str) -> bool:
        return self.all_visible and not self.redacted.intersection(columns)


def build(df: DataFrame, zone: list[str], columns: list[str], histograms: list[str] = (), **state: object) -> Synopses:
    """Facts in one aggregation: rows, and per column nulls, minimum, maximum and, for numbers, a checked decimal sum."""
    kinds, aggs = dict(df.dtypes), [F.count("*").alias("rows")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
        if kind := exact_sum_type(kinds[c]):
            aggs.append(F.sum(F.col(c).cast(kind)).alias(f"{c}__sum"))
        if kinds[c] == "boolean":
            aggs += [F.count_if(F.col(c)).alias(f"{c}__true"), F.count_if(~F.col(c)).alias(f"{c}__false")]
    return Synopses(df.groupBy(*zone).agg(*aggs), list(zone), list(columns), {c: histogram(df, zone, c) for c in histograms}, **state)


def histogram(df: DataFrame, zone: list[str], column: str) -> DataFrame:
    """(zone, key, n) over non-null values; counts add up to the zone's non-null rows."""
    return df.where(F.col(column).isNotNull()).groupBy(*zone, F.col(column).alias("key")).agg(F.count("*").alias("n"))


def count_rows(s: Synopses) -> DataFrame | None:
    return s.facts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")) if s.usable() else None


def count_column(s: Synopses, c: str) -> DataFrame | None:
    return s.facts.agg(F.coalesce(F.sum(F.col("rows") - F.col(f"{c}__nulls")), F.lit(0)).alias("n")) if s.usable(c) and c in s.columns else None


def min_max(s: Synopses, c: str) -> DataFrame | None:
    """Null if every row is null; truth values have no answer."""
    if not s.usable(c) or c not in s.columns or f"{c}__true" in s.facts.columns:
        return None
    return s.facts.agg(F.min(f"{c}__min").alias("low"), F.max(f"{c}__max").alias("high"))


def sum_avg(s: Synopses, c: str) -> DataFrame | None:
    """Exact sum and its quotient as a double; null if every row is null. Columns without a checked sum have no answer."""
    if not s.usable(c) or f"{c}__sum" not in s.facts.columns:
        return None
    n = F.sum(F.col("rows") - F.col(f"{c}__nulls"))
    total = F.sum(f"{c}__sum").cast("double")
    return s.facts.agg(total.alias("total"), F.when(n > 0, total / n).alias("mean"))


def count_distinct(s: Synopses, c: str) -> DataFrame | None:
    return s.histograms[c].agg(F.count_distinct("key").alias("n")) if s.usable(c) and c in s.histograms else None


def count_where(s: Synopses, c: str, values: list[object]) -> DataFrame | None:
    """Rows equal to any of the values."""
    if not s.usable(c) or c not in s.histograms:
        return None
    return s.histograms[c].where(F.col("key").isin([v for v in values if v is not None])).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def group_count(s: Synopses, c: str) -> DataFrame | None:
    """Rows by value; a null row, which the histogram does not hold, or an uncovered one means no answer."""
    if not s.usable(c) or c not in s.histograms or c not in s.columns:
        return None
    held = s.histograms[c].groupBy(*s.zone).agg(F.sum("n").alias("held"))
    open_ = s.facts.join(held, s.zone, "left").where((F.col(f"{c}__nulls") > 0) | (F.coalesce("held", F.lit(0)) != F.col("rows")))
    return None if open_.limit(1).count() else s.histograms[c].groupBy("key").agg(F.sum("n").alias("n"))


def truth_counts(df: DataFrame, zone: list[str], column: str) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*zone).agg(F.count_if(c).alias("trues"), F.count_if(~c).alias("falses"), F.count_if(c.isNull()).alias("nulls"))


def heavy_hitters(df: DataFrame, column: str, k: int, zone: list[str] = ()) -> DataFrame:
    """The k commonest values (of each zone), count descending, then key."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*zone, F.col(column).alias("key")).agg(F.count("*").alias("n"))
    if not zone:
        return counts.orderBy(F.desc("n"), "key").limit(k)
    w = Window.partitionBy(*zone).orderBy(F.desc("n"), "key")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def distinct_sketch(df: DataFrame, column: str, zone: list[str] = ()) -> DataFrame:
    """HyperLogLog sketches by zone, mergeable; read with :func:`distinct_estimate`."""
    return df.groupBy(*zone).agg(F.hll_sketch_agg(column, 14).alias("sketch"))


def distinct_estimate(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def quantiles(df: DataFrame, column: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles, one row per share."""
    found = df.agg(F.percentile_approx(column, shares, accuracy).alias("v"))
    return found.select(F.posexplode("v").alias("i", "value")).select(F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1).alias("share"), "value")


def _kll(kind: str) -> str:
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "float" if kind == "float" else "double"


def quantile_sketch(df: DataFrame, column: str, zone: list[str] = (), k: int = 200) -> DataFrame:
    """KLL sketches by zone, mergeable; nulls are not counted. Read with :func:`quantile_estimate`."""
    kind = _kll(dict(df.dtypes)[column])
    value = F.col(column) if kind != "double" else F.col(column).cast("double")
    return df.where(F.col(column).isNotNull()).groupBy(*zone).agg(F.call_function(f"kll_sketch_agg_{kind}", value, F.lit(k)).alias("sketch"), F.lit(kind).alias("kind"))


def quantile_estimate(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """(share, value) of the merged sketches of any zones, files or archives; no rows if there are none."""
    first = sketches.select("kind").first()
    if first is None:
        return sketches.sparkSession.createDataFrame([], "share double, value double")
    merged = sketches.agg(F.call_function(f"kll_merge_agg_{first.kind}", F.col("sketch")).alias("s"))
    found = F.array(*(F.struct(F.lit(float(x)).alias("share"), F.call_function(f"kll_sketch_get_quantile_{first.kind}", F.col("s"), F.lit(float(x))).cast("double").alias("value")) for x in shares))
    return merged.select(F.explode(found).alias("x")).select("x.*")
