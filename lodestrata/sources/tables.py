"""Tables by path: options, multi-table archives, format detection, mapping sources.

Everything resolves to one Spark reader, so that projections, filters, limits and
partition values reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


class ArchiveError(ValueError):
    """An error with a stable ``code``."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


_schemas: dict[tuple, T.StructType] = {}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a folder. Its schema is kept while the path's time and length stay, which saves a job per scan."""
    path = f"{root}/{name}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    key = path, status.getModificationTime(), status.getLen()
    if key not in _schemas:
        if len(_schemas) > 1000:
            _schemas.clear()
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


@dataclass(frozen=True)
class TableOptions:
    """What a scan may be told. Options that the engine decides by itself are accepted and have no effect."""

    table_name: str | None = None
    namespace: str | None = None
    merge_schema: bool = False
    recursive: bool = False
    filter_residual_policy: str = "preserve"
    target_morsels_per_partition: int = 0

    @classmethod
    def of(cls, **given: object) -> TableOptions:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(given) - known):
            raise ArchiveError("unknown_option", ", ".join(unknown))
        if given.get("filter_residual_policy", "preserve") not in ("preserve", "elide_exact"):
            raise ArchiveError("bad_option", "filter_residual_policy")
        return cls(**given)


def _list(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise ArchiveError("not_found", path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.getFileStatus(p).isDirectory() else []


def select_table(spark: SparkSession, path: str, options: TableOptions) -> str:
    """The folder of the wanted table in an archive: itself if it holds one table, else by name; ambiguity is an error."""
    names = _list(spark, path)
    folders = [n for n in names if n.startswith("table=")]
    if not folders:
        return path
    wanted = [n for n in folders if options.table_name in (None, n.removeprefix("table=").split(".")[-1]) and (options.namespace is None or n.removeprefix("table=").startswith(f"{options.namespace}."))]
    if not wanted:
        raise ArchiveError("table_not_found", str(options.table_name))
    if len(wanted) > 1:
        raise ArchiveError("ambiguous_table", ", ".join(sorted(wanted)))
    return f"{path}/{wanted[0]}"


def scan(spark: SparkSession, *paths: str, **options: object) -> DataFrame:
    """Scan one archive table, or several files of compatible schemas together.

    Several paths must have equal columns and types; partition folders become columns.
    """
    opts = TableOptions.of(**options)
    if not paths:
        raise ArchiveError("empty_listing", "no files")
    chosen = [select_table(spark, p, opts) for p in paths]
    reader = spark.read.option("mergeSchema", opts.merge_schema).option("recursiveFileLookup", opts.recursive)
    if len(chosen) > 1 and not opts.merge_schema:
        shapes = [[(f.name, f.dataType) for f in spark.read.parquet(p).schema] for p in chosen]
        if any(s != shapes[0] for s in shapes):
            raise ArchiveError("schema_mismatch", "files of a dataset need equal schemas")
    return reader.parquet(*chosen)


def register(spark: SparkSession, name: str, *paths: str, **options: object) -> DataFrame:
    df = scan(spark, *paths, **options)
    df.createOrReplaceTempView(name)
    return df


def create_external_table(spark: SparkSession, name: str, path: str, **options: object) -> None:
    """CREATE TABLE ... USING parquet LOCATION, with checked options."""
    opts = TableOptions.of(**options)
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{select_table(spark, path, opts)}'")


def create_external_view(spark: SparkSession, name: str, path: str, **options: object) -> None:
    """CREATE TEMPORARY VIEW ... USING parquet OPTIONS (path ...), with checked options."""
    opts = TableOptions.of(**options)
    quoted = select_table(spark, path, opts).replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} USING parquet OPTIONS (path '{quoted}', mergeSchema '{str(opts.merge_schema).lower()}', recursiveFileLookup '{str(opts.recursive).lower()}')")


FORMATS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "json": "json", "jsonl": "json", "arrow": "arrow", "ipc": "arrow", "feather": "arrow"}


def detect_format(path: str) -> str:
    """The format that a file's extension names."""
    ext = path.rstrip("/").rpartition(".")[2].lower()
    if ext not in FORMATS:
        raise ArchiveError("unknown_format", path)
    return FORMATS[ext]


def _arrow_batches(raw: object) -> Iterator[object]:
    """The record batches of Arrow IPC bytes, file or stream."""
    import pyarrow as pa
    import pyarrow.ipc as ipc

    try:
        reader = ipc.open_file(raw)
        yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
    except pa.ArrowInvalid:
        if hasattr(raw, "seek"):
            raw.seek(0)
        yield from ipc.open_stream(raw)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files of one schema, from any store that Spark reads; a task holds a file whole."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    def schema_of(raw: bytes):
        import pyarrow.ipc as ipc

        try:
            return ipc.open_file(raw).schema
        except pa.ArrowInvalid:
            return ipc.open_stream(raw).schema

    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.limit(1).mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([schema_of(x.as_py()).serialize().to_pybytes()], pa.binary())], ["s"]) for b in it for x in b.column(0)), "s binary").first()
    if first is None:
        raise ArchiveError("empty_listing", path)
    schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(first.s)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                for part in _arrow_batches(x.as_py()):
                    if part.schema.names != schema.names:
                        raise ArchiveError("schema_mismatch", str(part.schema.names))
                    yield part

    return files.mapInArrow(run, schema)


def read_bytes(spark: SparkSession, source: object, kind: str, schema: T.StructType | None = None) -> DataFrame:
    """A table out of memory: bytes, or a file-like object that is read by ranges (Parquet and ORC read what they need).

    ``kind``: parquet, orc, arrow, csv or jsonl. The rows are converted on the driver, and so need to fit there.
    """
    import io

    import pyarrow as pa

    if kind not in ("parquet", "orc", "arrow", "csv", "jsonl", "json"):
        raise ArchiveError("unknown_format", kind)
    f = pa.BufferReader(source) if isinstance(source, (bytes, bytearray, memoryview)) else pa.PythonFile(source, "r")
    try:
        if kind == "parquet":
            import pyarrow.parquet as pq

            found = pq.read_table(f, columns=schema.names if schema is not None else None)
        elif kind == "orc":
            import pyarrow.orc as orc

            found = orc.ORCFile(f).read(columns=schema.names if schema is not None else None)
        elif kind == "arrow":
            found = pa.Table.from_batches(list(_arrow_batches(f)))
        elif kind == "csv":
            import pyarrow.csv as csv

            found = csv.read_csv(f)
        else:
            import pyarrow.json as pj

            found = pj.read_json(io.BytesIO(f.read()))
    except (pa.ArrowInvalid, OSError) as e:
        raise ArchiveError("bad_bytes", str(e)) from e
    df = spark.createDataFrame(found)
    return df if schema is None else df.select(*(F.col(x.name).cast(x.dataType).alias(x.name) for x in schema))


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by extension."""
    kind = detect_format(path)
    if kind == "arrow":
        return read_arrow(spark, path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        reader = reader.option("header", True) if schema is not None else reader.option("header", True).option("inferSchema", True)
    return reader.format(kind).load(path)


def mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """A mapping source: every field a trimmed string, empty ones stay empty; ``row_index`` counts data rows from 0.

    There is no quoting; a row with another number of fields fails the job.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("o")).where("trim(value) <> ''")
    first = lines.orderBy("f", "o").first()
    if first is None:
        raise ArchiveError("empty_source", path)
    names = [n.strip() for n in first.value.split(",")]
    parts = F.transform(F.split("value", ",", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    bad = F.raise_error(F.concat(F.lit("field_count: "), F.col("value")))
    cells = F.when(F.size("p") == len(names), F.col("p")).otherwise(bad.cast("array<string>"))
    rows = lines.where((F.col("f") != first.f) | (F.col("o") != first.o)).withColumn("p", parts).withColumn("p", cells)
    # the row number is an ordinal of the physical order, from two-level counts by input split
    from lodestrata.operators.ordinals import with_ordinal

    return with_ordinal(rows, "row_index", "f", "o").select("row_index", *(F.col("p")[i].alias(n) for i, n in enumerate(names)))


def mapping_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A mapping source of one JSON object a line; ``row_index`` is the physical line number from 0, blank lines counted."""
    from lodestrata.operators.ordinals import with_ordinal

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("o"))
    numbered = with_ordinal(lines, "row_index", "f", "o").where("trim(value) <> ''")
    return numbered.select("row_index", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j")).select("row_index", "j.*")


def source_id(path: str) -> str:
    """A mapping source is named by its file's stem and must be CSV or JSON lines."""
    stem, _, ext = path.rstrip("/").rpartition("/")[2].rpartition(".")
    if ext.lower() not in ("csv", "jsonl"):
        raise ArchiveError("unknown_source", path)
    return stem
