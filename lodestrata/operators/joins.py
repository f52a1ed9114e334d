"""Joins that Spark has no operator for, as equality joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.sources.tables import ArchiveError


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, *, prefix: str = "right_", strict: bool = False, step: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time (before it, if ``strict``).

    Both sides become one sorted run per key, along which the last right row is
    carried: one shuffle, and no pairs are made. Left rows without a match have
    nulls; of right rows at one time the largest counts. With a ``step``, for integer
    times, a key's run is cut every ``step``, so that a hot key is many tasks; what
    a piece begins with is the last right row of the pieces before it.
    """
    rest = [c for c in right.columns if c not in on]
    lcols = [c for c in left.columns if c not in on]
    # at equal times right rows come first, or last where only earlier ones count
    side = lambda is_right: F.lit(int(is_right == strict))
    a = left.select(*on, F.col(time).alias("__t"), side(False).alias("__s"), F.struct(*lcols).alias("__l"), F.lit(None).cast(right.select(F.struct(*rest)).schema[0].dataType).alias("__r"))
    b = right.select(*on, F.col(time).alias("__t"), side(True).alias("__s"), F.lit(None).cast(left.select(F.struct(*lcols)).schema[0].dataType).alias("__l"), F.struct(*rest).alias("__r"))
    both, piece = a.unionByName(b), []
    if step is not None:
        both, piece = both.withColumn("__p", F.expr(f"__t div {step} - cast(__t % {step} < 0 as int)")), ["__p"]
    w = Window.partitionBy(*on, *piece).orderBy("__t", "__s", "__r").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w))
    if step is not None:
        # one row for each piece of a key: its last right row, carried over the pieces after it
        ends = both.groupBy(*on, "__p").agg(F.max(F.when(F.col("__r").isNotNull(), F.struct("__t", "__r"))).alias("__x"))
        over = Window.partitionBy(*on).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        enter = ends.select(*on, "__p", F.last("__x", ignorenulls=True).over(over)["__r"].alias("__e"))
        names = [F.col(f"__k{i}") for i in range(len(on))]
        enter = enter.toDF(*(f"__k{i}" for i in range(len(on))), "__q", "__e")
        meets = F.col("__p") == F.col("__q")
        for k, n in zip(on, names):
            meets = meets & F.col(k).eqNullSafe(n)
        carried = carried.join(enter, meets, "left").withColumn("__m", F.coalesce("__m", "__e"))
    carried = carried.where("__l is not null")
    return carried.select(*on, "__l.*", *(F.col(f"__m.{c}").alias(prefix + c) for c in rest))


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, end: str, step: int) -> DataFrame:
    """Points with the half-open intervals that hold them, met by blocks of ``step`` along the line.

    An interval is copied to each block it touches, so ``step`` should be near the usual length.
    """
    cut = intervals.where(F.col(start) < F.col(end)).withColumn("__b", F.explode(F.sequence(F.expr(f"{start} div {step}"), F.expr(f"({end} - 1) div {step}"))))
    at = points.withColumn("__b", F.expr(f"{point} div {step}"))
    return at.join(cut, [*on, "__b"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__b")


#: Keys with at least this share of the large side's rows are hot; so there are at most a thousand.
HOT_SHARE = 0.001


def salted_join(large: DataFrame, small: DataFrame, on: list[str], salts: int, how: str = "inner", spread: Column | None = None) -> DataFrame:
    """An equality join whose hot keys are spread over ``salts`` tasks by copying their rows of the smaller side.

    Only keys with HOT_SHARE of the large side's rows or more are spread, and rows with
    a null key, which meet nothing. ``how``: inner, left, left_semi, left_anti, and
    right or full, where unmatched rows of the small side are added once.
    """
    how = {"outer": "full", "full_outer": "full", "left_outer": "left", "right_outer": "right", "semi": "left_semi", "anti": "left_anti"}.get(how, how)
    if how not in ("inner", "left", "left_semi", "left_anti", "right", "full"):
        raise ArchiveError("bad_join", how)
    total = large.count()
    counts = large.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("__n"))
    hot = large.sparkSession.createDataFrame(counts.where(F.col("__n") >= max(2, HOT_SHARE * total)).drop("__n").toArrow()).withColumn("__hot", F.lit(True))
    salt = F.pmod(spread if spread is not None else F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    none = F.lit(False)
    for c in on:
        none = none | F.col(c).isNull()
    spread_large = large.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__hot") | none, salt).otherwise(0)).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread_small = small.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    out = spread_large.join(spread_small, [*on, "__salt"], {"right": "inner", "full": "left"}.get(how, how)).drop("__salt")
    if how not in ("right", "full"):
        return out
    alone = small.join(large.select(*on).distinct(), on, "left_anti")
    rest = {c: F.lit(None).cast(large.schema[c].dataType) for c in large.columns if c not in on}
    return out.unionByName(alone.withColumns(rest).select(*out.columns))
