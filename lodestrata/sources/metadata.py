"""An archive's metadata, read back: what holds for the files as they are now, and what it proves.

Tables beside the data name the files they were made from, with length and time.
A file that is new, rewritten or unknown has no valid entry: it is never left out
and never answered for. Small tables are kept in the driver until they change, as
local relations, so that using them costs no job; larger ones stay tables.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.predicates import children, columns_of, cost_ordered, pred, to_column, to_expr
from lodestrata.operators import zones as Z
from lodestrata.operators.key_index import KeyIndex
from lodestrata.operators.synopses import Synopses

from . import storage

#: Rows and bytes of a metadata table that the driver keeps, files that a scan is given by name.
HELD_ROWS, HELD_BYTES, NAMED_FILES = 1_000_000, 16_000_000, 10_000


class _Table:
    """A metadata table: a local relation if it is small, else Parquet."""

    def __init__(self, spark: SparkSession, path: str, small: bool) -> None:
        df = spark.read.parquet(path)
        self.df, self.local = df, False
        if small:
            held = df.limit(HELD_ROWS + 1).toArrow()
            if held.num_rows <= HELD_ROWS and held.nbytes <= HELD_BYTES:
                self.df, self.local = spark.createDataFrame(held, df.schema), True


@dataclass
class Archive:
    """Metadata of one archive as it was written."""

    spark: SparkSession
    path: str
    schema: T.StructType
    files: dict[str, tuple[int, int]] | None
    tables: dict[str, _Table] = field(default_factory=dict)
    #: By predicate, the files that there were and what was found of them.
    surveys: dict[str, tuple[dict, Survey]] = field(default_factory=dict)
    missing: set[str] = field(default_factory=set)

    def table(self, name: str) -> _Table | None:
        if name in self.missing:
            return None
        if name not in self.tables:
            path = f"{self.path}/{name}"
            if not storage.exists(self.spark, f"{path}/_SUCCESS"):
                self.missing.add(name)
                return None
            # a table of very many files is not small
            found = storage.few(self.spark, path)
            self.tables[name] = _Table(self.spark, path, found is not None and sum(n for n, _ in found.values()) <= HELD_BYTES)
        return self.tables[name]


_open: dict[str, tuple[tuple, Archive]] = {}


def opened(spark: SparkSession, path: str) -> Archive | None:
    """The metadata of an archive, kept while its mark (what is written last) stays; None if there is none, so that callers scan."""
    mark = storage.stamp(spark, f"{path}/schema/_SUCCESS")
    if mark is None:
        return None
    key = f"{spark.sparkContext.applicationId}:{path}"
    if key not in _open or _open[key][0] != mark:
        if not all(storage.exists(spark, f"{path}/{n}/_SUCCESS") for n in ("manifest", "zones")):
            return None
        if len(_open) > 200:
            _open.clear()
        schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first().value))
        rows = spark.read.parquet(f"{path}/manifest").select("file", "bytes", "modified").limit(storage.FEW_FILES + 1).collect()
        files = {r.file: (r.bytes, r.modified) for r in rows} if len(rows) <= storage.FEW_FILES else None
        _open[key] = mark, Archive(spark, path, schema, files)
    return _open[key][1]


def _known(p: dict, columns: set[str]) -> dict:
    """The predicate with what no statistics speak of marked as unknown."""
    if p["op"] in ("And", "Or"):
        return pred(p["op"], [_known(x, columns) for x in p["items"]])
    if p["op"] == "Not":
        return pred("Not", _known(p["item"], columns))
    return p if not children(p) and columns_of(p) <= columns else {"op": "Unknown"}


@dataclass
class Survey:
    """Which files a predicate leaves, and why. ``files``: names to scan, None for all (no list is made)."""

    files: list[str] | None
    considered: int = 0
    pruned: int = 0
    unknown: int = 0
    by_index: str | None = None


def _states(a: Archive) -> tuple[dict[str, tuple[int, int]], set[str]] | None:
    """(files there are now, those whose metadata holds), for archives of few files."""
    now = storage.few(a.spark, f"{a.path}/data") if a.files is not None else None
    return None if now is None else (now, {f for f, s in now.items() if a.files.get(f) == s})


def whole(a: Archive) -> bool:
    """Whether metadata holds for every file there is, and no file of it is gone."""
    states = _states(a)
    if states is not None:
        return states[1] == set(states[0]) == set(a.files)
    made = a.spark.read.parquet(f"{a.path}/manifest").select("file", "bytes", "modified")
    now = storage.listing(a.spark, f"{a.path}/data")
    return not made.exceptAll(now).union(now.exceptAll(made)).limit(1).count()


def _zone_table(a: Archive) -> tuple[DataFrame, set[str], bool]:
    t = a.table("zones")
    return t.df, {c.removesuffix("__min") for c in t.df.columns if c.endswith("__min")}, t.local


def survey(a: Archive, p: dict, use_index: bool = True) -> Survey:
    """Files that may hold a match: all but those with valid metadata of which every zone, or an index, says no.

    What a predicate leaves is kept while the files stay as they are.
    """
    states = _states(a)
    key = json.dumps([p, use_index], default=repr, sort_keys=True)
    if states is not None and key in a.surveys and a.surveys[key][0] == states[0]:
        return a.surveys[key][1]
    stats, columns, local = _zone_table(a)
    o = Z.outcome(_known(p, columns))
    if states is None or not local:
        made = a.spark.read.parquet(f"{a.path}/manifest").select("file", "bytes", "modified")
        now = storage.listing(a.spark, f"{a.path}/data")
        gone = stats.groupBy("file").agg(F.max(o != Z.NO).alias("may")).where("not may").select("file")
        left = now.join(made.join(gone, "file", "left_semi"), ["file", "bytes", "modified"], "left_anti").select("file")
        found = [r.file for r in left.limit(NAMED_FILES + 1).collect()]
        return Survey(found if len(found) <= NAMED_FILES else None)
    now, valid = states
    may = {r.file for r in stats.where(o != Z.NO).select("file").collect()}
    out = Survey(None, len(now), 0, len(now) - len(valid))
    if use_index and (index := _index_atom(a, p)) is not None:
        column, atom = index
        t = a.table(f"index/{column}")
        hits = t.df.where(to_column({**atom, "column": "key"})).select("file")
        may &= {r.file for r in (hits if t.local else hits.distinct()).collect()}
        out.by_index = column
    keep = sorted(f for f in now if f not in valid or f in may)
    out.pruned, out.files = len(now) - len(keep), keep if len(keep) < len(now) else None
    if len(a.surveys) > 1000:
        a.surveys.clear()
    a.surveys[key] = now, out
    return out


def _index_atom(a: Archive, p: dict) -> tuple[str, dict] | None:
    """The first conjunct that an index answers: (column, conjunct)."""
    for x in p["items"] if p["op"] == "And" else [p]:
        if x["op"] in ("Eq", "InSet", "Between", "Lt", "LtEq", "Gt", "GtEq", "LikePrefix") and a.table(f"index/{x['column']}") is not None:
            return x["column"], x
    return None


def matched(a: Archive, p: dict) -> frozenset[str]:
    """Files that valid statistics show to match whole; none where there are many files."""
    stats, columns, local = _zone_table(a)
    states = _states(a)
    if states is None or not local:
        return frozenset()
    partial = {r.file for r in stats.where(Z.outcome(_known(p, columns)) != Z.ALL).select("file").collect()}
    return frozenset(states[1] - partial)


def scan(a: Archive, p: dict, found: Survey, whole_files: frozenset[str] = frozenset()) -> DataFrame:
    """The files of a survey, filtered by the predicate, cheap tests first; ``whole_files`` need no filter."""
    data = f"{a.path}/data"
    test = to_expr(cost_ordered(p, {f.name: f.dataType.simpleString() for f in a.schema}))
    if found.files is None and not whole_files:
        return (a.spark.read.parquet(data) if found.unknown else a.spark.read.schema(a.schema).parquet(data)).where(test)
    files = found.files if found.files is not None else sorted(storage.few(a.spark, data) or {})
    part = lambda names: a.spark.read.schema(a.schema).option("basePath", data).parquet(*(f"{data}/{f}" for f in names))
    some, every = [f for f in files if f not in whole_files], [f for f in files if f in whole_files]
    if not files:
        return a.spark.createDataFrame([], a.schema)
    if not every:
        return part(some).where(test)
    return part(every) if not some else part(every).unionByName(part(some).where(test))


def synopses(a: Archive) -> Synopses | None:
    """Stored facts and histograms, if they hold for every file; else None, and the caller scans."""
    if not whole(a):
        return None
    facts, columns, _ = _zone_table(a)
    hists = {c: a.table(f"histograms/{c}").df for c in a.schema.names if a.table(f"histograms/{c}") is not None}
    return Synopses(facts, ["file", "zone"], sorted(columns), hists)


def merged(parts: list[Synopses]) -> Synopses | None:
    """Synopses of several archives as one: facts and histograms that all have, side by side; None if one may not answer."""
    if not parts or any(not s.usable() for s in parts):
        return None
    columns = sorted(set.intersection(*(set(s.columns) for s in parts)))
    redacted = frozenset().union(*(s.redacted for s in parts))
    tag = lambda df, i: df.withColumn("archive", F.lit(i))
    facts, hists = tag(parts[0].facts, 0), {}
    for i, s in enumerate(parts[1:], 1):
        facts = facts.unionByName(tag(s.facts, i), allowMissingColumns=True)
    for c in set.intersection(*(set(s.histograms) for s in parts)):
        hists[c] = tag(parts[0].histograms[c], 0)
        for i, s in enumerate(parts[1:], 1):
            hists[c] = hists[c].unionByName(tag(s.histograms[c], i))
    return Synopses(facts, ["archive", *parts[0].zone], columns, hists, redacted)


def index(a: Archive, column: str) -> KeyIndex | None:
    """A stored index, if it holds for every file; else None. One without its columns is an error where it is used."""
    t = a.table(f"index/{column}")
    if t is None or not whole(a):
        return None
    return KeyIndex(t.df, ["file"], "row_index", fingerprint(a))


def fingerprint(a: Archive) -> str:
    """What an index or synopsis of these files is valid for."""
    if a.files is None:
        d = a.spark.read.parquet(f"{a.path}/manifest").agg(F.sum(F.xxhash64("file", "bytes", "modified").cast("decimal(38,0)"))).first()[0]
        return str(d)
    return hashlib.sha256(repr(sorted(a.files.items())).encode()).hexdigest()


def fetch(a: Archive, found: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The data rows (or some columns) at the places (file, row_index) of a lookup; few places name the files to read.

    Where the index itself has all the columns, no data file is opened.
    """
    names = columns or a.schema.names
    if set(names) <= set(found.columns):
        return found.select(*names)
    data = f"{a.path}/data"
    few = found.select("file", "row_index").limit(NAMED_FILES + 1).collect()
    if not few:
        return a.spark.createDataFrame([], a.schema).select(*names)
    place = lambda df: df.select("*", storage.below("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    if len(few) > NAMED_FILES:
        df = place(a.spark.read.schema(a.schema).parquet(data))
        on = found.select(F.col("file").alias("__file"), F.col("row_index").alias("__row")).distinct()
        return df.join(on, ["__file", "__row"], "left_semi").select(*names)
    few = list(dict.fromkeys(few))
    files: dict[str, list[int]] = {}
    for r in few:
        files.setdefault(r.file, []).append(r.row_index)
    df = place(a.spark.read.schema(a.schema).option("basePath", data).parquet(*(f"{data}/{f}" for f in sorted(files))))
    if len(few) <= 200:
        test = None
        for f, rows in files.items():
            one = (F.col("__file") == f) & F.col("__row").isin(rows)
            test = one if test is None else test | one
        return df.where(test).select(*names)
    local = a.spark.createDataFrame(pa.table({"__file": [r.file for r in few], "__row": pa.array([r.row_index for r in few], pa.int64())}))
    return df.join(F.broadcast(local), ["__file", "__row"], "left_semi").select(*names)


def top_n(a: Archive, column: str, n: int, ties: list[str], largest: bool = True) -> DataFrame:
    """The n rows with the largest (or smallest) values, nulls last, then by ``ties``.

    Zones in order of their worst bound, as far as they surely hold n rows, give a
    value that the n-th row reaches at least. Only rows up to it are sorted, and files
    without one are not opened.
    """
    order = [F.desc_nulls_last(column) if largest else F.asc_nulls_last(column), *ties]
    stats, columns, local = _zone_table(a)
    if column not in columns or not local or not whole(a):
        return a.spark.read.parquet(f"{a.path}/data").orderBy(*order).limit(n)
    worst = f"{column}__{'min' if largest else 'max'}"
    rows = stats.select((F.col("rows") - F.col(f"{column}__nulls")).alias("n"), F.col(worst).alias("worst"), F.col(f"{column}__nan").alias("nan")).where("n > 0").collect()
    held, bound = 0, None
    for r in sorted((r for r in rows if r.worst is not None), key=lambda r: r.worst, reverse=largest):
        held += r.n
        if held >= n:
            bound = r.worst
            break
    if bound is None or any(r.nan for r in rows):
        return a.spark.read.schema(a.schema).parquet(f"{a.path}/data").orderBy(*order).limit(n)
    p = pred("GtEq" if largest else "LtEq", column, bound)
    return scan(a, p, survey(a, p)).orderBy(*order).limit(n)


def explain(a: Archive, p: dict, projection: list[str] | None = None) -> DataFrame:
    """One row per zone: file, zone, row_start, rows, decision, outcome, evidence, fallback; files without valid metadata have one row that is kept."""
    stats, columns, _ = _zone_table(a)
    known = _known(p, columns)
    rows = Z.explain_pruning(stats, ["file", "zone", "row_start"], known)
    states = _states(a)
    if states is not None:
        now, valid = states
        state = a.spark.createDataFrame([(f, f in valid) for f in now], "file string, valid boolean")
    else:
        made = a.spark.read.parquet(f"{a.path}/manifest").select("file", "bytes", "modified", F.lit(True).alias("valid"))
        state = storage.listing(a.spark, f"{a.path}/data").join(made, ["file", "bytes", "modified"], "left").select("file", F.coalesce("valid", F.lit(False)).alias("valid"))
    held = rows.join(F.broadcast(state.where("valid").select("file")), "file").withColumn("fallback", F.when(F.col("outcome") == "unknown", "no_statistics"))
    open_ = state.where("not valid").select("file", F.lit(None).cast("long").alias("zone"), F.lit(None).cast("long").alias("row_start"), F.lit(None).cast("long").alias("rows"), F.lit("kept").alias("decision"), F.lit("unknown").alias("outcome"), F.lit("none").alias("evidence"), F.lit("stale_metadata").alias("fallback"))
    return held.select(*open_.columns).unionByName(open_)


def file_starts(explained: DataFrame) -> DataFrame:
    """(file, start) of :func:`explain` rows: the rows in the files before, in order of their names. One row for each file is gathered."""
    held = explained.groupBy("file").agg(F.sum("rows").alias("n"))
    return held.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start"))


def counters(a: Archive, p: dict) -> DataFrame:
    """One row of scan counters: files and zones considered, pruned and without metadata, rows that need not be read, the index used."""
    found = survey(a, p)
    e = explain(a, p)
    one = e.agg(
        F.count("zone").alias("zones"), F.count_if((F.col("decision") == "pruned")).alias("zones_pruned"), F.count_if(F.col("outcome") == "all_match").alias("zones_whole"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("decision") == "pruned", F.col("rows"))), F.lit(0)).alias("rows_pruned"),
    )
    return one.select(F.lit(found.considered).cast("long").alias("files"), F.lit(found.pruned).cast("long").alias("files_pruned"), F.lit(found.unknown).cast("long").alias("files_stale"), F.lit(found.by_index).cast("string").alias("index"), *one.columns)
