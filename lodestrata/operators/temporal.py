"""Object histories: as-of cuts, state reconstruction, reference checks.

Records: object_type, branch_key, goid, timestamp_us, csn, segment_id, row_index,
record_id, kind (Baseline, Snapshot, Delta, Tombstone), prev_ref, properties (a
map; a key with a null value is present, and overwrites). One object's records
form a sequence, and everything here is windows and aggregates over its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["object_type", "branch_key", "goid"]
ORDER = ["timestamp_us", "csn", "segment_id", "row_index", "record_id"]
KINDS = ("Baseline", "Snapshot", "Delta", "Tombstone")


def cut(records: DataFrame, *, timestamp_us: int | None = None, csn: int | None = None, branch: str | None = None) -> DataFrame:
    """Records up to a commit time or number, of one branch if named."""
    if timestamp_us is not None:
        records = records.where(F.col("timestamp_us") <= timestamp_us)
    if csn is not None:
        records = records.where(F.col("csn") <= csn)
    return records if branch is None else records.where(F.col("branch_key") == branch)


def _known(records: DataFrame) -> DataFrame:
    good = F.col("kind").isin(*KINDS)
    return records.withColumn("kind", F.when(good, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("legacy record kind: "), F.coalesce("kind", F.lit("null"))))))


def reconstruct(records: DataFrame, *, fresh_after_tombstone: bool = False, include_tombstones: bool = False, properties: list[str] | None = None) -> DataFrame:
    """The state of every object after its last record: KEY, status, version (records seen), properties.

    A Baseline or Snapshot replaces the state, a Delta overlays what it has, a
    Tombstone marks the object dead. A Delta after a Tombstone revives the
    older properties, or with ``fresh_after_tombstone`` starts from nothing, and
    then a dead object has no state at all.
    """
    # Every step is an aggregation that combines before it moves, so an object with a
    # third of all records is no task of its own: a property's last value belongs to
    # the state if it is not older than the object's last reset.
    full, dead = F.col("kind").isin("Baseline", "Snapshot"), F.col("kind") == "Tombstone"
    r = _known(records).withColumn("at", F.struct(*ORDER))
    heads = r.groupBy(*KEY).agg(F.count("*").alias("version"), F.max_by("kind", "at").alias("last_kind"), F.min("at").alias("first"), F.max(F.when(full | dead if fresh_after_tombstone else full, F.col("at"))).alias("start"))
    entries = F.map_entries("properties")
    if properties is not None:
        entries = F.filter(entries, lambda x: x["key"].isin(properties))
    cells = r.select(*KEY, "at", dead.alias("dead"), F.explode(entries).alias("e")).select(*KEY, "at", "dead", F.col("e.key").alias("k"), F.struct(F.col("e.value").alias("v")).alias("s"))
    live, gone = F.when(~F.col("dead"), F.col("at")), F.when(F.col("dead"), F.col("at"))
    values = cells.groupBy(*KEY, "k").agg(F.max(live).alias("at"), F.max_by("s", live).alias("s"), F.min(gone).alias("gone_at"), F.min_by("s", gone).alias("gone"))
    held = values.join(heads.select(*KEY, "first", "start"), KEY)
    now = F.col("at").isNotNull() & (F.col("start").isNull() | (F.col("at") >= F.col("start")))
    # a tombstone's own properties count only where it is all there is to start from
    alone = F.lit(not fresh_after_tombstone) & (F.col("gone_at") == F.col("first")) & F.col("start").isNull()
    kept = held.withColumn("s", F.when(now, F.col("s")).when(alone, F.col("gone"))).where("s is not null")
    maps = kept.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", F.col("s.v").alias("v"))))).alias("properties"))
    empty = F.create_map().cast(dict(records.dtypes)["properties"])
    out = heads.join(maps, KEY, "left").select(*KEY, F.when(F.col("last_kind") == "Tombstone", "Tombstone").otherwise("Live").alias("status"), "version", F.coalesce("properties", empty).alias("properties"))
    return out if include_tombstones else out.where("status = 'Live'")


def as_of(records: DataFrame, **where: object) -> DataFrame:
    """Live objects at a cut, as projections see them: a tombstone forgets everything before it."""
    return reconstruct(cut(records, **where), fresh_after_tombstone=True)


def with_previous(records: DataFrame) -> DataFrame:
    """``prev_ref`` filled with the record before it of the same object."""
    return records.withColumn("prev_ref", F.lag("record_id").over(Window.partitionBy(*KEY).orderBy(*ORDER)))


def bad_references(records: DataFrame) -> DataFrame:
    """Records whose ``prev_ref`` is not the record just before them of the same object, in the same archive."""
    last = F.lag("record_id").over(Window.partitionBy(*KEY).orderBy(*ORDER))
    return records.withColumn("expected", last).where("prev_ref is not null and not (prev_ref <=> expected)").select(*KEY, "record_id", "prev_ref", "expected")


def dangling_references(records: DataFrame) -> DataFrame:
    """Records whose ``prev_ref`` names no record of this archive."""
    known = records.select(F.col("record_id").alias("prev_ref"))
    return records.where("prev_ref is not null").join(known, "prev_ref", "left_anti")


def unsorted_records(records: DataFrame) -> DataFrame:
    """Rows of a segment that come before their predecessor in record order."""
    w = Window.partitionBy("segment_id").orderBy("row_index")
    now, before = F.struct("timestamp_us", "csn"), F.struct(F.lag("timestamp_us").over(w), F.lag("csn").over(w))
    return records.withColumn("__b", before).withColumn("__n", now).where("__b.col1 is not null and __n < __b").drop("__b", "__n")


def segment_bloom(records: DataFrame, bits: int = 8192) -> DataFrame:
    """(segment_id, bits): a Bloom filter of each segment's object ids."""
    from .zones import bloom_index

    return bloom_index(records, ["segment_id"], "goid", bits)


def history_of(records: DataFrame, goid: str, bloom: DataFrame | None = None, bits: int = 8192) -> DataFrame:
    """One object's records in order; with filters, only segments that may have it are looked at."""
    from .zones import bloom_zones

    if bloom is not None:
        records = records.join(bloom_zones(bloom, ["segment_id"], F.lit(goid), bits), "segment_id", "left_semi").select(*records.columns)
    return records.where(F.col("goid") == goid).orderBy(*ORDER)


def valid_at(edges: DataFrame, at: object, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows whose half-open validity interval holds a moment; an open end is valid for ever."""
    t = F.lit(at)
    return edges.where((F.col(start).isNull() | (F.col(start) <= t)) & (F.col(end).isNull() | (F.col(end) > t)))
