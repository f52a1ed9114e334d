"""Coverage sets: fragments that together hold every match of a predicate.

A set is a DataFrame of fragment columns, or of (fragment, start, length) row
ranges. It may prune only if it cannot miss rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ELIGIBLE = ("ExactTight", "ExactConservative", "ProbabilisticConservative")


def may_prune(strength: str, under_inclusive: bool = False) -> bool:
    return strength in ELIGIBLE and not under_inclusive


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b.select(*a.columns)).distinct()


def coarsen(ranges: DataFrame, fragment: list[str], size: int) -> DataFrame:
    """Row ranges to whole blocks of ``size`` rows that they touch."""
    first, last = F.expr(f"start div {size}"), F.expr(f"(start + length - 1) div {size}")
    return ranges.where("length > 0").select(*fragment, F.explode(F.sequence(first, last)).alias("block")).distinct()


def refine(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks to the row ranges they stand for."""
    return blocks.withColumn("start", F.col("block") * size).withColumn("length", F.lit(size).cast("long")).drop("block")


#: Ranges that a task orders at most; more are ordered in parts.
PART_RANGES = 1 << 19


def coalesce_ranges(ranges: DataFrame, fragment: list[str]) -> DataFrame:
    """Overlapping or touching ranges of a fragment become one; empty ranges go.

    Many ranges are ordered in parts of bounded size. A part is told how far the
    fragment that it begins with was covered before it, and how many islands of that
    fragment began there; so an island may run through any number of parts.
    """
    from .ordinals import ranged

    end = F.col("start") + F.col("length")
    spans = ranges.where("length > 0").groupBy(*fragment, "start").agg(F.max("length").alias("length"))
    parts = -(-spans.count() // PART_RANGES)
    held = ranged(spans, [*fragment, "start"], parts).repartitionById(parts, "__range") if parts > 1 else spans.withColumn("__range", F.lit(0))
    w = Window.partitionBy("__range", *fragment).orderBy("start")
    marked = held.withColumn("__seen", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    if parts > 1:
        marked = _from_before(marked, held.groupBy("__range", *fragment).agg(F.max(end).alias("__open")), F.max("__open"), fragment)
    before = F.greatest("__seen", "__open") if parts > 1 else F.col("__seen")
    marked = marked.withColumn("__new", F.coalesce(F.col("start") > before, F.lit(True)).cast("long"))
    island = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy("__range", *fragment, "__island").agg(F.min("start").alias("start"), F.max(end).alias("end"))
    if parts > 1:
        begun = marked.groupBy("__range", *fragment).agg(F.sum("__new").alias("__begun"))
        out = _from_before(out, begun, F.sum("__begun"), fragment).withColumn("__island", F.col("__island") + F.coalesce("__begun", F.lit(0)))
        out = out.groupBy(*fragment, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select(*fragment, "start", (F.col("end") - F.col("start")).alias("length"))


def _from_before(rows: DataFrame, totals: DataFrame, total: Column, fragment: list[str]) -> DataFrame:
    """Rows with the total of a fragment over the parts before theirs, null if there are none. Only a part's first fragment can have some, so that these are one row for each part."""
    name = totals.columns[-1]
    w = Window.partitionBy(*fragment).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("__range").alias("__r"), *(F.col(f).alias(f"__f{i}") for i, f in enumerate(fragment)), total.over(w).alias(name)).where(F.col(name).isNotNull())
    same = F.col("__range") == F.col("__r")
    for i, f in enumerate(fragment):
        same = same & F.col(f).eqNullSafe(F.col(f"__f{i}"))
    return rows.join(F.broadcast(before), same, "left").drop("__r", *(f"__f{i}" for i in range(len(fragment))))


def intersect_ranges(a: DataFrame, b: DataFrame, fragment: list[str]) -> DataFrame:
    """Rows in both, as coalesced ranges."""
    x = a.select(*fragment, F.col("start").alias("s1"), (F.col("start") + F.col("length")).alias("e1"))
    y = b.select(*fragment, F.col("start").alias("s2"), (F.col("start") + F.col("length")).alias("e2"))
    both = x.join(y, fragment).where("s1 < e2 and s2 < e1").select(*fragment, F.greatest("s1", "s2").alias("start"), F.least("e1", "e2").alias("end"))
    return coalesce_ranges(both.select(*fragment, "start", (F.col("end") - F.col("start")).alias("length")), fragment)


def degree_ppm(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Share of fragments covered, in millionths; a planning figure only."""
    n = part.distinct().agg(F.count("*").alias("covered"))
    m = whole.distinct().agg(F.count("*").alias("fragments"))
    return n.join(F.broadcast(m)).select("covered", "fragments", F.expr("covered * 1000000 div greatest(fragments, 1)").alias("ppm"))


@dataclass
class CoverageCache:
    """Coverage sets by (snapshot, predicate form, granularity, strength, exactness); another snapshot's are dropped."""

    snapshot: str
    entries: dict[tuple, DataFrame] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0
    invalidated: int = 0

    def get(self, snapshot: str, *key: object) -> DataFrame | None:
        if snapshot != self.snapshot:
            self.invalidated += len(self.entries)
            self.entries.clear()
            self.snapshot = snapshot
        found = self.entries.get(key)
        self.hits, self.misses = self.hits + (found is not None), self.misses + (found is None)
        return found

    def put(self, fragments: DataFrame, strength: str, *key: object, under_inclusive: bool = False) -> bool:
        """Keep a set that may prune."""
        if not may_prune(strength, under_inclusive):
            return False
        self.entries[key] = fragments
        return True


def inspect(spark: SparkSession, cache: CoverageCache) -> DataFrame:
    """(snapshot, key, fragments) of what a cache holds."""
    rows = [(cache.snapshot, "/".join(map(str, k)), v.count()) for k, v in cache.entries.items()]
    return spark.createDataFrame(rows, "snapshot string, key string, fragments long")


def choose_plan(candidates: list[dict], full_cost: float) -> dict:
    """The cheapest candidate that is proven and cheaper than the scan; else the scan. Candidates: name, cost, strength."""
    safe = [c for c in candidates if may_prune(c["strength"], c.get("under_inclusive", False)) and c["cost"] < full_cost]
    return min(safe, key=lambda c: (c["cost"], c["name"]), default={"name": "full_scan", "cost": full_cost, "strength": "ExactTight"})
