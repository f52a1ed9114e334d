"""Secondary indexes: one sorted table of keys and row places serves every lookup.

An index is advisory. It is used only if its fingerprint equals the dataset's;
otherwise the answer is None and the caller scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.tables import ArchiveError


@dataclass
class KeyIndex:
    """rows: (key, zone columns, place); ``exact``: every non-null row has an entry."""

    rows: DataFrame
    zone: list[str]
    place: str
    fingerprint: str = ""
    exact: bool = True


def build(df: DataFrame, key: str | Column, zone: list[str], place: str, fingerprint: str = "") -> KeyIndex:
    k = F.col(key) if isinstance(key, str) else key
    return KeyIndex(df.select(k.alias("key"), *zone, place).where("key is not null"), list(zone), place, fingerprint)


def write(index: KeyIndex, path: str) -> None:
    """Sorted by key, so that row-group statistics prune lookups."""
    index.rows.repartitionByRange("key").sortWithinPartitions("key", index.place).write.mode("overwrite").parquet(path)


def usable(index: KeyIndex | None, fingerprint: str) -> bool:
    """A stale index is ignored; one without its columns is an error."""
    if index is None or index.fingerprint != fingerprint:
        return False
    if not {"key", index.place, *index.zone} <= set(index.rows.columns):
        raise ArchiveError("corrupt_index", str(index.rows.columns))
    return True


def lookup_eq(index: KeyIndex, value: object) -> DataFrame:
    return index.rows.where(F.col("key") == F.lit(value))


def lookup_range(index: KeyIndex, low: object = None, high: object = None, *, low_open: bool = False, high_open: bool = False) -> DataFrame:
    k, out = F.col("key"), index.rows
    if low is not None:
        out = out.where(k > F.lit(low) if low_open else k >= F.lit(low))
    return out if high is None else out.where(k < F.lit(high) if high_open else k <= F.lit(high))


def lookup_prefix(index: KeyIndex, prefix: str) -> DataFrame:
    return index.rows.where(F.col("key").startswith(prefix))


def lookup_in(index: KeyIndex, values: list[object]) -> DataFrame:
    if not values:
        raise ArchiveError("empty_membership", "no keys")
    return index.rows.where(F.col("key").isin(values))


def fetch(df: DataFrame, index: KeyIndex, found: DataFrame) -> DataFrame:
    """The data rows at the places that a lookup found."""
    on = [*index.zone, index.place]
    return df.join(found.select(*on).distinct(), on, "left_semi")


def membership(index: KeyIndex, keys: DataFrame) -> DataFrame:
    """(key, present) of each requested key, distinct and without nulls."""
    asked = keys.select(F.col(keys.columns[0]).alias("key")).where("key is not null").distinct()
    have = index.rows.select("key").distinct().withColumn("hit", F.lit(True))
    return asked.join(have, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("present"))


def aggregate(index: KeyIndex, kind: str) -> DataFrame | None:
    """count, min, max, distinct_count or exists from the index alone; None if it does not cover all rows."""
    if not index.exact:
        return None
    k = F.col("key")
    made = {"count": F.count("*"), "min": F.min(k), "max": F.max(k), "distinct_count": F.count_distinct(k), "exists": F.count("*") > 0}
    if kind not in made:
        raise ArchiveError("bad_aggregate", kind)
    return index.rows.agg(made[kind].alias("answer"))


def row_ranges(found: DataFrame, zone: list[str], place: str) -> DataFrame:
    """Candidate rows as (zone, start, length) runs, sorted and coalesced."""
    from .coverage import coalesce_ranges

    return coalesce_ranges(found.select(*zone, F.col(place).alias("start"), F.lit(1).cast("long").alias("length")), zone)


def lookup_overlap(index: KeyIndex, low: object, high: object, start: str, end: str) -> DataFrame:
    """Entries whose own interval (columns ``start``, ``end``, half-open) meets [low, high)."""
    return index.rows.where((F.col(start) < F.lit(high)) & (F.col(end) > F.lit(low)))
