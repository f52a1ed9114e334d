"""Row visibility, redaction and what they forbid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.tables import ArchiveError

from .coverage import coalesce_ranges

MODES = ("All", "VisibleRanges", "DeletedRanges", "DeletedBitmap")


def apply_overlay(df: DataFrame, file: list[str], row: str, mode: str, overlay: DataFrame | None = None) -> DataFrame:
    """Visible rows of a snapshot.

    Ranges are (file, start, length), a bitmap is (file, row). Ranges are
    coalesced and dealt to blocks of 4,096 rows, so that rows meet their ranges
    by an equality join of (file, block) and not by comparing all with all.
    """
    if mode not in MODES:
        raise ArchiveError("bad_overlay", mode)
    if mode == "All" or overlay is None:
        return df
    if mode == "DeletedBitmap":
        return df.join(overlay.select(*file, F.col("row").alias(row)).distinct(), [*file, row], "left_anti")
    ranges = coalesce_ranges(overlay, file)
    cut = ranges.select(*file, F.col("start").alias("__s"), (F.col("start") + F.col("length")).alias("__e")).withColumn("__b", F.explode(F.sequence(F.expr("__s div 4096"), F.expr("(__e - 1) div 4096"))))
    at = df.withColumn("__b", F.expr(f"{row} div 4096"))
    inside = [at[c] == cut[c] for c in [*file, "__b"]] + [at[row] >= cut["__s"], at[row] < cut["__e"]]
    on = inside[0]
    for c in inside[1:]:
        on = on & c
    return at.join(cut, on, "left_anti" if mode == "DeletedRanges" else "left_semi").drop("__b")


def visible_count(files: DataFrame, mode: str, overlay: DataFrame | None = None) -> DataFrame:
    """Visible rows by file from (file, rows) and the overlay alone."""
    if mode == "All" or overlay is None:
        return files.select("file", F.col("rows").alias("visible"))
    if mode == "DeletedBitmap":
        n = overlay.distinct().groupBy("file").agg(F.count("*").alias("n"))
    else:
        n = coalesce_ranges(overlay, ["file"]).groupBy("file").agg(F.sum("length").alias("n"))
    named = F.coalesce("n", F.lit(0))
    return files.join(n, "file", "left").select("file", (named if mode == "VisibleRanges" else F.col("rows") - named).alias("visible"))


def overlay_decision(operation: str, has_overlay: bool, overlay_aware: bool = False) -> str:
    """What an operation may take from metadata that was made before an overlay."""
    table = {"prune": "allowed", "scan": "apply_overlay", "lookup": "apply_overlay", "exact_domain": "forbidden", "exact_aggregate": "forbidden"}
    if operation not in table:
        raise ArchiveError("bad_operation", operation)
    if not has_overlay:
        return "allowed"
    return "allowed" if overlay_aware and table[operation] == "forbidden" else table[operation]


def redact(df: DataFrame, manifest: list[dict]) -> DataFrame:
    """Apply entries {column, policy: Hide | Placeholder | Refuse, when?, placeholder?} in order; ``when`` is SQL."""
    for e in manifest:
        hit = F.expr(e.get("when", "true"))
        c = F.col(e["column"])
        made = {"Hide": F.lit(None), "Placeholder": F.lit(e.get("placeholder", "[redacted]")), "Refuse": F.raise_error(F.lit(f"redacted: {e['column']}"))}
        if e["policy"] not in made:
            raise ArchiveError("bad_redaction", e["policy"])
        df = df.withColumn(e["column"], F.when(hit, made[e["policy"]].cast(df.schema[e["column"]].dataType)).otherwise(c))
    return df


#: Features that operations need; a feature that an archive requires and the engine lacks rejects only what intersects it.
SCOPES = {"scan": {"data"}, "prune": {"data", "zones"}, "lookup": {"data", "index"}, "metadata_aggregate": {"synopses"}, "overlay": {"data", "visibility"}}


def check_features(operation: str, required_unknown: dict[str, set[str]]) -> None:
    """``required_unknown``: feature -> the parts it touches."""
    bad = sorted(f for f, parts in required_unknown.items() if parts & SCOPES[operation])
    if bad:
        raise ArchiveError("unsupported_feature", ", ".join(bad))
