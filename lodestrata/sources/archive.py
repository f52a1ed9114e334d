"""Immutable archives: clustered Parquet with metadata tables beside it, and exports.

Layout: ``<path>/data`` (Parquet), ``<path>/zones`` (statistics and sums by file and
block of rows), ``<path>/manifest`` (one row per data file), ``<path>/schema``, and
where asked for ``<path>/histograms/<column>`` and ``<path>/index/<column>``. All of it
is made in a new folder that then takes the archive's place. Metadata is advisory: it
holds for a file only while the file's length and time are those it was made from.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.predicates import to_column
from lodestrata.operators import zones as Z
from lodestrata.operators.ordinals import numbered

from . import metadata, storage
from .tables import ArchiveError, detect_format, read_any

#: Files up to this many bytes have a digest of their bytes; larger ones are known by their rows' hashes.
DIGEST_BYTES = 256_000_000
#: Rows of a data file, and bytes of text and nested values in it: a task sorts no more, as far as ranges are even.
FILE_ROWS, FILE_BYTES = 1 << 20, 128_000_000
#: Rows of the data for which one task makes a histogram or a range of an index, as far as these are even.
TABLE_ROWS = 1 << 18
#: Distinct values of a column for which ``auto`` makes a histogram.
AUTO_VALUES = 1000


@dataclass(frozen=True)
class WriteOptions:
    """How an archive is laid out and what metadata it gets.

    ``cluster_by``: sort columns; ``curve``: columns whose z-order (or, for two,
    ``curve_kind="hilbert"``) key rows are sorted by instead; ``partition_by``: folder
    columns; ``bloom``: columns with a Bloom filter; ``statistics``: columns with zone
    statistics (None: all that can be ordered); ``histograms`` and ``indexes``: columns,
    or ``"none"``, or for histograms ``"auto"``: every scalar column of few values;
    ``include``: columns that every index holds beside its key, so that lookups of these
    alone open no data file;
    ``partitions``: files at least; there are more where one would be too large for the
    task that sorts it (:data:`FILE_ROWS`). ``file_rows``: rows of each file but the last,
    exactly, in the order of ``cluster_by``, ties in that of the other columns; files in
    order of their names then hold the rows in order.
    ``zone_rows``: rows of a zone. Row groups are Parquet's own.
    """

    cluster_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()
    statistics: tuple[str, ...] | None = None
    compression: str = "zstd"
    partitions: int | None = None
    file_rows: int | None = None
    zone_rows: int = 131_072
    mode: str = "errorifexists"
    histograms: tuple[str, ...] | str = ()
    indexes: tuple[str, ...] | str = ()
    include: tuple[str, ...] = ()
    curve: tuple[str, ...] = ()
    curve_kind: str = "z"

    def check(self, df: DataFrame) -> WriteOptions:
        if self.mode not in ("errorifexists", "error", "overwrite", "ignore", "append") or self.curve_kind not in ("z", "hilbert") or self.zone_rows < 1:
            raise ArchiveError("bad_option", str(self))
        for name in ("histograms", "indexes"):
            if isinstance(v := getattr(self, name), str) and v not in (("none", "auto") if name == "histograms" else ("none",)):
                raise ArchiveError("bad_option", f"{name}: {v}")
        named = {*self.cluster_by, *self.partition_by, *self.bloom, *self.curve, *self.include, *(self.statistics or ()), *(() if isinstance(self.histograms, str) else self.histograms), *(() if isinstance(self.indexes, str) else self.indexes)}
        if missing := sorted(named - set(df.columns)):
            raise ArchiveError("unknown_column", missing[0])
        if self.curve_kind == "hilbert" and len(self.curve) not in (0, 2):
            raise ArchiveError("bad_option", "a Hilbert curve runs over two columns")
        if self.file_rows is not None and (not 0 < self.file_rows <= FILE_ROWS or not self.cluster_by or self.curve or self.partition_by):
            raise ArchiveError("bad_option", f"file_rows: {self.file_rows}")
        return self


def storable(df: DataFrame) -> DataFrame:
    """Columns that Parquet cannot hold become JSON text: void types and maps with keys that are not scalars."""
    out = []
    for f in df.schema:
        odd = isinstance(f.dataType, T.NullType) or isinstance(f.dataType, T.MapType) and isinstance(f.dataType.keyType, (T.StructType, T.ArrayType, T.MapType))
        out.append((F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.lit(None).cast("string")).alias(f.name) if odd else F.col(f"`{f.name}`"))
    return df.select(*out)


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.NullType)) and kind.simpleString() not in ("variant", "interval")


def _pieces(df: DataFrame, most: int | None = None) -> int:
    """How many files keep each within FILE_ROWS (or ``most``) rows and FILE_BYTES, from one pass over the rows."""
    sizes = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(c))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) or f.dataType.simpleString() == "variant":
            sizes.append(F.octet_length(F.to_json(c)))
    held = df.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(f"b{i}") for i, x in enumerate(sizes))).first()
    return max(1, -(-held[0] // (most or FILE_ROWS)), -(-sum(held[1:]) // FILE_BYTES))


def _tie(df: DataFrame, keys: tuple[str, ...]) -> Column:
    """A mark by which rows of one key, however many, can lie in several ranges."""
    rest = [F.col(f"`{f.name}`") for f in df.schema if f.name not in keys and _orderable(f.dataType)]
    return F.xxhash64(*rest) if rest else F.lit(0)


def clustered(df: DataFrame, o: WriteOptions) -> DataFrame:
    """Rows ranged over the cluster and sorted, by columns or along a curve. Ranges follow the number of rows, so that a task's sort does not grow with the table."""
    if o.file_rows:
        order = [*o.cluster_by, *(f.name for f in df.schema if f.name not in o.cluster_by and _orderable(f.dataType))]
        n = _pieces(df, o.file_rows)
        rows = numbered(df, order, "__row", n).withColumn("__piece", F.expr(f"cast(__row div {o.file_rows} as int)"))
        return rows.repartitionById(n, "__piece").sortWithinPartitions("__row").drop("__row", "__piece")
    if o.curve:
        key, curved = "__curve", Z.with_curve(df, "__curve", o.curve, o.curve_kind)
        n = max(o.partitions or 1, _pieces(df))
        return curved.repartitionByRange(n, key, _tie(curved, (key,))).sortWithinPartitions(*o.partition_by, key).drop(key)
    if o.cluster_by:
        n = max(o.partitions or 1, _pieces(df))
        return df.repartitionByRange(n, *o.cluster_by, _tie(df, o.cluster_by)).sortWithinPartitions(*o.partition_by, *o.cluster_by)
    return df.repartition(max(o.partitions, _pieces(df))) if o.partitions else df


def write(df: DataFrame, path: str, options: WriteOptions | None = None) -> None:
    """Write an archive: data, then the metadata of what was written, and then put it in place as a whole.

    ``append`` adds files to the data; they have no metadata, and so are always read, until :func:`refresh`.
    """
    o, spark = (options or WriteOptions()).check(df), df.sparkSession
    df = storable(df)
    storage.recover(spark, path)
    there = storage.exists(spark, path)
    if there and o.mode in ("errorifexists", "error"):
        raise ArchiveError("exists", path)
    if there and o.mode == "ignore":
        return
    append = there and o.mode == "append"
    target = path if append else f"{path}.new-{storage.uuid.uuid4().hex}"
    w = clustered(df, o).write.mode("append").option("compression", o.compression).option("maxRecordsPerFile", FILE_ROWS)
    for c in o.bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    (w.partitionBy(*o.partition_by) if o.partition_by else w).parquet(f"{target}/data")
    if not append:
        _describe(spark, target, o)
        storage.replace(spark, target, path)


def refresh(spark: SparkSession, path: str, options: WriteOptions | None = None) -> None:
    """Make the metadata again from the data files as they are."""
    _describe(spark, path, options or WriteOptions())


def _describe(spark: SparkSession, path: str, o: WriteOptions) -> None:
    """Metadata of the data files. Bounds of text are made by sorting, so a task has one file."""
    with storage.file_by_file(spark, f"{path}/data"):
        _describe_files(spark, path, o)


def _describe_files(spark: SparkSession, path: str, o: WriteOptions) -> None:
    rows = with_places(spark, path, o.zone_rows)
    kept = spark.read.parquet(f"{path}/data").schema
    columns = [f.name for f in kept if _orderable(f.dataType) and (o.statistics is None or f.name in o.statistics)]
    # dealt by a shuffle: in one task, the aggregations of all partitions would hold their memory side by side
    parts = 1 if storage.few(spark, f"{path}/data") else 64
    first = Z.zone_stats(rows, ["file", "zone"], columns, sums=True).withColumn("row_start", F.col("zone") * o.zone_rows)
    first.repartition(parts).write.mode("overwrite").parquet(f"{path}/zones")
    manifest(spark, f"{path}/data", rows.drop("row_index", "zone")).repartition(parts).write.mode("overwrite").parquet(f"{path}/manifest")
    spark.createDataFrame([(kept.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    names = [] if o.histograms == "none" else o.histograms
    if o.histograms == "auto":
        scalar = [c for c in columns if c not in o.partition_by]
        few = rows.agg(*(F.approx_count_distinct(c).alias(c) for c in scalar)).first() if scalar else {}
        names = [c for c in scalar if few[c] <= AUTO_VALUES]
    indexes = () if isinstance(o.indexes, str) else o.indexes
    # by rows, since the session's number of shuffle partitions does not grow with them, and adaptive execution merges these
    used = {*names, *indexes, *(o.include if indexes else ())}
    tasks = _pieces(rows.select(*sorted(used)), TABLE_ROWS) if used else 1
    for c in names:
        hist = rows.where(F.col(c).isNotNull()).groupBy("file", "zone", F.col(c).alias("key")).agg(F.count("*").alias("n"))
        with storage.dealt(spark, tasks):
            hist.write.mode("overwrite").parquet(f"{path}/histograms/{c}")
    for c in indexes:
        # sorted by key, so that row-group statistics prune lookups; by place, too, so that rows of one key can lie in several ranges
        keys = rows.where(F.col(c).isNotNull()).select(F.col(c).alias("key"), "file", "row_index", *(x for x in o.include if x not in ("key", "file", "row_index")))
        keys.repartitionByRange(tasks, "key", "file", "row_index").sortWithinPartitions("key", "file", "row_index").write.mode("overwrite").parquet(f"{path}/index/{c}")


def _file() -> Column:
    """The name of a row's file below the data folder."""
    return storage.below("_metadata.file_path")


def with_places(spark: SparkSession, path: str, zone_rows: int = Z.MORSEL_ROWS) -> DataFrame:
    """Data rows with their file, their row number in it and their zone."""
    df = spark.read.parquet(f"{path}/data")
    return df.select("*", _file().alias("file"), F.col("_metadata.row_index").alias("row_index")).withColumn("zone", F.expr(f"row_index div {zone_rows}"))


def read(spark: SparkSession, path: str, predicate: dict | None = None, *, use_index: bool = True, residual: str = "preserve") -> DataFrame:
    """Scan an archive. With a predicate, only files that may match are opened, as statistics and indexes prove; the predicate is then applied in full.

    Files without valid metadata (new, rewritten) are always read, and metadata of
    files that are gone says nothing: the rows are those of a full scan. With the
    residual policy ``elide_exact``, files all of whose rows match are not filtered.
    """
    if residual not in ("preserve", "elide_exact"):
        raise ArchiveError("bad_option", residual)
    storage.recover(spark, path)
    if predicate is None:
        return spark.read.parquet(f"{path}/data")
    a = metadata.opened(spark, path)
    if a is None:
        return spark.read.parquet(f"{path}/data").where(to_column(predicate))
    found = metadata.survey(a, predicate, use_index)
    return metadata.scan(a, predicate, found, metadata.matched(a, predicate) if residual == "elide_exact" else frozenset())


def read_late(spark: SparkSession, path: str, predicate: dict, columns: list[str], *, most: int = 10_000) -> DataFrame:
    """The columns of matching rows, in two steps: the predicate's columns find the rows, then the other columns are read in their files only.

    Worth it for few matches and wide rows; beyond ``most`` matches it is the plain scan.
    """
    a = metadata.opened(spark, path)
    if a is None:
        return read(spark, path, predicate).select(*columns)
    rows = metadata.scan(a, predicate, metadata.survey(a, predicate))
    places = rows.select(_file().alias("file"), F.col("_metadata.row_index").alias("row_index"))
    few = places.limit(most + 1).collect()
    if len(few) > most:
        return rows.select(*columns)
    return metadata.fetch(a, spark.createDataFrame([tuple(r) for r in few], "file string, row_index long")).select(*columns)


def lookup(spark: SparkSession, path: str, column: str, values: list[object]) -> DataFrame:
    """Rows with one of the values, through the column's index alone; without one that holds, by a scan."""
    from lodestrata.functions.predicates import pred
    from lodestrata.operators.key_index import lookup_in

    a = metadata.opened(spark, path)
    index = metadata.index(a, column) if a is not None else None
    if index is None:
        return read(spark, path, pred("InSet", column, values))
    return metadata.fetch(a, lookup_in(index, values))


def sections(spark: SparkSession, path: str) -> list[str]:
    """The parts that an archive has."""
    fs, p = storage._at(spark, path)
    names = [n for n in ("data", "zones", "manifest", "schema") if storage.exists(spark, f"{path}/{n}")]
    for kind in ("histograms", "index"):
        if storage.exists(spark, f"{path}/{kind}"):
            names += sorted(f"{kind}/{s.getPath().getName()}" for s in fs.listStatus(storage._at(spark, f"{path}/{kind}")[1]))
    return names


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(section, files, bytes) of every part of an archive."""
    rows = []
    for n in sections(spark, path):
        # metadata is plain files, data may be very many
        if n == "data":
            one = storage.listing(spark, f"{path}/data").agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
            rows.append((n, one[0], one[1]))
        else:
            held = storage.few(spark, f"{path}/{n}") or {}
            rows.append((n, len(held), sum(x for x, _ in held.values())))
    return spark.createDataFrame(rows, "section string, files long, bytes long")


def manifest(spark: SparkSession, data: str, rows: DataFrame | None = None) -> DataFrame:
    """(file, bytes, modified, sha256, content, rows) of each data file.

    ``sha256`` is over the bytes of files up to DIGEST_BYTES, which Spark reads whole;
    ``content`` is a sum of hashes of the rows, whatever the file's size, and needs no
    file in one piece.
    """
    own = storage.listing(spark, data)
    name = data.rstrip("/").rpartition("/")[2]
    bytes_ = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(data).where(F.col("length") <= DIGEST_BYTES)
    digests = bytes_.select(F.regexp_extract("path", f"/{name}/(.*)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))
    ident = own.join(digests, "file", "left")
    if rows is None:
        return ident
    cells = [F.to_json(f"`{f.name}`") if "map" in f.dataType.simpleString() or f.dataType.simpleString() == "variant" else F.col(f"`{f.name}`") for f in rows.schema if f.name != "file"]
    counted = rows.groupBy("file").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).cast("string").alias("content"))
    return ident.join(counted, "file", "left").select("file", "bytes", "modified", "sha256", "content", F.coalesce("rows", F.lit(0)).alias("rows"))


def verify(spark: SparkSession, path: str, *, deep: bool = True) -> DataFrame:
    """(file, finding) of each file that differs from the manifest: missing, unknown, length, digest, or (not ``deep``) time.

    ``deep`` reads the files: digests of bytes, and hashes of rows where a file has none.
    """
    want = spark.read.parquet(f"{path}/manifest")
    if deep:
        have = manifest(spark, f"{path}/data", with_places(spark, path).drop("row_index", "zone"))
    else:
        have = storage.listing(spark, f"{path}/data").withColumns({"sha256": F.lit(None).cast("string"), "content": F.lit(None).cast("string")})
    w, h = want.alias("w"), have.alias("h")
    both = w.join(h, F.col("w.file") == F.col("h.file"), "full")
    unlike = F.coalesce(F.col("w.sha256") != F.col("h.sha256"), F.col("w.content") != F.col("h.content")) if deep else F.lit(False)
    finding = (
        F.when(F.col("h.file").isNull(), "missing").when(F.col("w.file").isNull(), "unknown").when(F.col("w.bytes") != F.col("h.bytes"), "length")
        .when(unlike, "digest").when(F.lit(not deep) & (F.col("w.modified") != F.col("h.modified")), "time")
    )
    return both.select(F.coalesce("w.file", "h.file").alias("file"), finding.alias("finding")).where("finding is not null")


def scan_manifest(spark: SparkSession, path: str, *, strict: bool = True, deep: bool = False) -> DataFrame:
    """Scan the files that a manifest lists, and no others. A file that is not what it says is an error, or where not strict, is read all the same."""
    bad = verify(spark, path, deep=deep).where("finding <> 'unknown'")
    if strict and (first := bad.first()):
        raise ArchiveError("file_identity", f"{first.file}: {first.finding}")
    listed = spark.read.parquet(f"{path}/manifest").select("file")
    names = [r.file for r in listed.limit(metadata.NAMED_FILES + 1).collect()]
    data = f"{path}/data"
    if len(names) <= metadata.NAMED_FILES:
        now = storage.few(spark, data)
        names = [n for n in names if now is None or n in now]
        schema = spark.read.parquet(data).schema
        return spark.read.schema(schema).option("basePath", data).parquet(*(f"{data}/{n}" for n in names)) if names else spark.createDataFrame([], schema)
    df = spark.read.parquet(data).withColumn("__f", _file())
    return df.join(listed.withColumnRenamed("file", "__f"), "__f", "left_semi").drop("__f")


def scan_listed(spark: SparkSession, root: str, files: DataFrame | list[dict], *, strict: bool = True) -> DataFrame:
    """Scan the files of a dataset manifest: rows (uri, bytes, and optionally sha256), URIs absolute or relative to ``root``.

    ``strict``: a file that is missing or of another length or digest is an error;
    else such entries are taken as they are, and one that is missing is left out. A
    stale entry never leaves a file out.
    """
    rows = files if isinstance(files, list) else [r.asDict() for r in files.limit(metadata.NAMED_FILES + 1).collect()]
    if len(rows) > metadata.NAMED_FILES:
        raise ArchiveError("manifest_too_long", str(len(rows)))
    paths = []
    for r in rows:
        uri = r["uri"] if "://" in r["uri"] or r["uri"].startswith("/") else f"{root.rstrip('/')}/{r['uri']}"
        found = storage.stamp(spark, uri)
        wrong = "missing" if found is None else "length" if r.get("bytes") is not None and found[0] != r["bytes"] else None
        if wrong is None and strict and r.get("sha256"):
            wrong = None if spark.read.format("binaryFile").load(uri).select(F.sha2("content", 256)).first()[0] == r["sha256"] else "digest"
        if wrong and strict:
            raise ArchiveError("file_identity", f"{r['uri']}: {wrong}")
        if found is not None:
            paths.append(uri)
    if not paths:
        raise ArchiveError("empty_listing", root)
    return spark.read.parquet(*paths)


def describe_layout(spark: SparkSession, path: str) -> DataFrame:
    """Files with their rows, bytes and zones, and whether their metadata holds."""
    n = spark.read.parquet(f"{path}/zones").groupBy("file").agg(F.count("*").alias("zones"))
    now = storage.listing(spark, f"{path}/data").withColumn("valid", F.lit(True))
    return spark.read.parquet(f"{path}/manifest").join(n, "file", "left").join(now, ["file", "bytes", "modified"], "left").select("file", "rows", "bytes", F.coalesce("zones", F.lit(0)).alias("zones"), F.coalesce("valid", F.lit(False)).alias("valid"))


def scan_splits(spark: SparkSession, path: str, target_rows: int) -> DataFrame:
    """(split, file, zone, row_start, rows): zones dealt to splits of about ``target_rows`` rows, in file order, none across files."""
    z = spark.read.parquet(f"{path}/zones").select("file", "zone", "row_start", "rows")
    before = F.sum("rows").over(Window.partitionBy("file").orderBy("zone")) - F.col("rows")
    return z.withColumn("split", F.concat_ws("#", "file", F.floor(before / target_rows).cast("string")))


def trust_chain(df: DataFrame, segment: list[str], order: list[str], payload: Column, seed: str = "") -> DataFrame:
    """Digest of each segment's chain h(i) = H(h(i-1) || payload(i)), in order."""
    rows = df.groupBy(*segment).agg(F.sort_array(F.collect_list(F.struct(*order, payload.cast("string").alias("p")))).alias("r"))
    chained = F.aggregate("r", F.lit(seed), lambda h, x: F.sha2(F.concat(h, x["p"]), 256))
    return rows.select(*segment, F.size("r").alias("n"), chained.alias("head"))


#: What conversion makes of source types (Arrow names): the type, and whether something is lost.
TYPE_POLICIES = {
    "timestamp[s]": ("timestamp", False), "timestamp[ms]": ("timestamp", False), "timestamp[us]": ("timestamp", False), "timestamp[ns]": ("timestamp", True), "large_string": ("string", False), "large_binary": ("binary", False),
    "uint8": ("smallint", False), "uint16": ("int", False), "uint32": ("bigint", False), "uint64": ("decimal(20,0)", False), "halffloat": ("float", False), "date64[ms]": ("date", True), "time64[us]": ("bigint", True), "null": ("string", True),
}


def source_type(name: str) -> tuple[str, bool]:
    """(Spark type, lossy) of an Arrow type by name; time zones are dropped to UTC, decimals keep precision and scale, what has no row here is kept as Arrow has it."""
    plain = re.sub(r", tz=[^\]]*", "", name)
    if m := re.fullmatch(r"decimal(?:128|256)?\((\d+), ?(\d+)\)", plain):
        return (f"decimal({m[1]},{m[2]})", False) if int(m[1]) <= 38 else ("string", True)
    if plain in TYPE_POLICIES:
        return TYPE_POLICIES[plain]
    same = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float": "float", "double": "double", "bool": "boolean", "string": "string", "binary": "binary", "date32[day]": "date"}
    return same.get(plain, plain), False


@dataclass
class ConversionReport:
    """What a conversion read, wrote and lost."""

    source: str
    format: str
    rows: int = 0
    columns: list[dict] = field(default_factory=list)
    lossy: list[str] = field(default_factory=list)
    source_digest: str | None = None
    schema_digest: str = ""
    sections: list[str] = field(default_factory=list)
    histograms: list[str] = field(default_factory=list)
    indexes: list[str] = field(default_factory=list)
    files: int = 0
    bytes: int = 0
    policies: dict[str, str] = field(default_factory=lambda: {"timestamp": "micros", "timezone": "session", "decimal": "keep", "collation": "binary", "nested": "keep", "unstorable": "json"})
    reordered: bool = False
    fallbacks: list[str] = field(default_factory=list)

    def json(self) -> str:
        return json.dumps(asdict(self))


def convert(spark: SparkSession, source: str, target: str, options: WriteOptions | None = None, schema: T.StructType | None = None) -> ConversionReport:
    """Read any known format, write an archive, report what became of each column."""
    o = options or WriteOptions()
    df = read_any(spark, source, schema)
    stored = storable(df)
    write(df, target, o)
    rep = ConversionReport(source, detect_format(source))
    made = spark.read.parquet(f"{target}/manifest").agg(F.sum("rows").alias("rows"), F.count("*").alias("files"), F.sum("bytes").alias("bytes")).first()
    rep.rows, rep.files, rep.bytes = made.rows or 0, made.files, made.bytes or 0
    for a, b in zip(df.schema, stored.schema):
        rep.columns.append({"name": a.name, "source_type": a.dataType.simpleString(), "type": b.dataType.simpleString(), "nullable": a.nullable})
        if a.dataType != b.dataType:
            rep.lossy.append(a.name)
            rep.fallbacks.append(f"{a.name}: {a.dataType.simpleString()} as {b.dataType.simpleString()}")
    # one digest over the source's files, each up to DIGEST_BYTES by its bytes
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    parts = files.where(F.col("length") <= DIGEST_BYTES).select(F.sha2("content", 256).alias("d")).union(files.where(F.col("length") > DIGEST_BYTES).select(F.concat(F.lit("length:"), F.col("length").cast("string"))))
    rep.source_digest = "sha256:" + parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ","), 256)).first()[0]
    rep.schema_digest = hashlib.sha256("|".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in stored.schema)).encode()).hexdigest()
    rep.sections, rep.reordered = sections(spark, target), bool(o.cluster_by or o.curve)
    rep.histograms, rep.indexes = ([s.partition("/")[2] for s in rep.sections if s.startswith(kind)] for kind in ("histograms/", "index/"))
    return rep


def report_rows(spark: SparkSession, report: ConversionReport) -> DataFrame:
    """One row per column of a conversion."""
    rows = [(c["name"], c["source_type"], c["type"], c["nullable"], c["name"] in report.lossy, c["name"] in report.histograms, c["name"] in report.indexes) for c in report.columns]
    return spark.createDataFrame(rows, "name string, source_type string, type string, nullable boolean, lossy boolean, histogram boolean, indexed boolean")


def sql_type(kind: T.DataType) -> str:
    names = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "SMALLINT", "double": "DOUBLE", "float": "REAL", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    text = kind.simpleString()
    return text.upper() if text.startswith("decimal") else names.get(text, "VARCHAR")


def _sql_literal(f: T.StructField) -> Column:
    c, kind = F.col(f"`{f.name}`"), sql_type(f.dataType)
    bare = c.cast("string") if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.to_json(c)
    quoted = F.concat(F.lit("'"), F.replace(bare, F.lit("'"), F.lit("''")), F.lit("'"))
    text = quoted if kind in ("VARCHAR", "DATE", "TIMESTAMP") else bare
    return F.coalesce(text, F.lit("NULL"))


def sql_export(df: DataFrame, table: str) -> DataFrame:
    """(kind, statement): CREATE TABLE, and an INSERT for each row."""
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    create = f"CREATE TABLE {quote(table)} ({', '.join(f'{quote(f.name)} {sql_type(f.dataType)}' for f in df.schema)});"
    head = df.sparkSession.createDataFrame([("create", create)], "kind string, statement string")
    values = F.concat_ws(", ", *map(_sql_literal, df.schema))
    return head.union(df.select(F.lit("insert").alias("kind"), F.concat(F.lit(f"INSERT INTO {quote(table)} VALUES ("), values, F.lit(");")).alias("statement")))


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, nulls kept."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """Folders by value; rows are dealt by those columns and spread by AQE, so a hot value is many files."""
    df.hint("rebalance", *columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def fidelity(df: DataFrame) -> DataFrame:
    """(column, type, exact): whether a column's type comes back from Arrow as it was."""
    from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

    def exact(kind: T.DataType) -> bool:
        if isinstance(kind, T.NullType):
            return False
        try:
            return from_arrow_type(to_arrow_type(kind)).simpleString() == kind.simpleString()
        except Exception:  # Arrow has no such type
            return False

    rows = [(f.name, f.dataType.simpleString(), exact(f.dataType)) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column string, type string, exact boolean")


def latest_snapshot(spark: SparkSession, root: str) -> str | None:
    """The newest complete snapshot folder below ``root`` (``snapshot=<n>`` with a success mark)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [n for n in names if n.startswith("snapshot=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return f"{root}/{max(done, key=lambda n: int(n.partition('=')[2]))}" if done else None


def with_row_numbers(df: DataFrame, order: list[str], partition: list[str]) -> DataFrame:
    """Row numbers within small groups."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
