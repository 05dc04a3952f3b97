"""File sources: delimited text, mixed formats, prefix filters, size gate, schema evolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.common import any_of

# --- fixed values ------------------------------------------------------------
SUPPORTED_FORMATS = ("csv", "json", "parquet", "avro")
MAX_FILE_SIZE_MB = 1024
INCLUDE_PREFIXES = ("incoming/",)
# ------------------------------------------------------------------------------

#: Reader per extension, with its default options.
READERS: Mapping[str, tuple[str, Mapping[str, str]]] = {
    "csv": ("csv", {"header": "true", "sep": ","}),
    "json": ("json", {}),
    "parquet": ("parquet", {}),
    "orc": ("orc", {}),
    "xml": ("xml", {"rowTag": "row"}),
    "txt": ("text", {}),
    "avro": ("avro", {}),
}

Schema = T.StructType | str


def read_csv(spark: SparkSession, path: str, schema: Schema, sep: str = ",", **options) -> DataFrame:
    """Delimited files with a header in a directory tree.

    A schema is required: inference would read everything twice.
    """
    return (
        spark.read.schema(schema).option("header", True).option("sep", sep)
        .option("recursiveFileLookup", True).options(**options).csv(path)
    )


def any_case(extension: str) -> str:
    """Glob for an extension in upper, lower or mixed case, as the file gate judges it."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def read_by_extension(
    spark: SparkSession, root: str, extensions: Sequence[str], schema: Schema,
    options: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Files of several formats in one tree as one frame, chosen by extension."""
    result = None
    for extension in extensions:
        if extension not in READERS:
            raise ValueError(f"no reader for .{extension}; known: {sorted(READERS)}")
        fmt, defaults = READERS[extension]
        reader = spark.read.format(fmt).options(**defaults).options(**(options or {}).get(extension, {}))
        if fmt != "text":
            reader = reader.schema(schema)
        try:
            frame = (
                reader.option("recursiveFileLookup", True).option("pathGlobFilter", any_case(extension)).load(root)
            )
        except AnalysisException as exc:
            if fmt == "avro":
                raise RuntimeError("reading .avro needs the spark-avro package on the class path") from exc
            raise
        result = frame if result is None else result.unionByName(frame, allowMissingColumns=True)
    return result


def relative_path(spark: SparkSession, root: str) -> Column:
    """Path of the row's file below ``root``; an error for a file that is not below it.

    File paths come URL-encoded and with scheme: the root is brought to the same
    form, taken off once from the start, and the rest is decoded.
    """
    location = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    start = system.makeQualified(location).toUri().getRawPath().rstrip("/") + "/"
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    below = F.substr(path, F.lit(len(start) + 1))
    decoded = F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B")))
    return F.when(path.startswith(start), decoded).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {start}: "), path)).cast("string")
    )


def with_prefixes(
    df: DataFrame, root: str, include: Sequence[str] = INCLUDE_PREFIXES, exclude: Sequence[str] = ()
) -> DataFrame:
    """Rows of files below an included prefix and below no excluded one.

    Hidden and marker files (names starting with ``.`` or ``_``) are never
    listed by the reader. The test is on file metadata, so files outside are
    skipped, not read.
    """
    path = relative_path(df.sparkSession, root)
    kept = df.where(any_of([path.startswith(p) for p in include])) if include else df
    return kept.where(~any_of([path.startswith(p) for p in exclude])) if exclude else kept


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, size, modification time and extension of files, without their content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select(
            "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
            F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))
    )


def gate_files(
    files: DataFrame, max_file_size_mb: float = MAX_FILE_SIZE_MB, formats: Sequence[str] = SUPPORTED_FORMATS
) -> DataFrame:
    """Add ``decision`` (VALID or QUARANTINE) and ``reason`` to a file listing."""
    reason = (
        F.when(~F.col("extension").isin(*formats), "unsupported format")
        .when(F.col("size") > max_file_size_mb * 1024 * 1024, "file too large")
    )
    return files.withColumn("reason", reason).withColumn(
        "decision", F.when(F.col("reason").isNull(), "VALID").otherwise("QUARANTINE"))


def schema_diff(old: T.StructType, new: T.StructType) -> list[tuple[str, str, str | None, str | None]]:
    """Column changes as (column, change, old type, new type); schemas only, no data."""
    before = {f.name: f.dataType.simpleString() for f in old.fields}
    after = {f.name: f.dataType.simpleString() for f in new.fields}
    changes = [(c, "added", None, t) for c, t in after.items() if c not in before]
    changes += [(c, "removed", t, None) for c, t in before.items() if c not in after]
    changes += [(c, "changed", t, after[c]) for c, t in before.items() if c in after and after[c] != t]
    return sorted(changes)


def evolve(old: DataFrame, new: DataFrame, evolution: bool = True) -> DataFrame:
    """Rows of both generations. New columns are merged when ``evolution`` is on and
    ignored otherwise; columns that disappear are kept and filled with NULL."""
    if not evolution:
        new = new.select(*[c for c in old.columns if c in new.columns])
    return old.unionByName(new, allowMissingColumns=True)


# --- fixed values: JDBC engines ------------------------------------------------
JDBC_URLS = {
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
}
JDBC_PORTS = {"mysql": 3306, "postgresql": 5432, "oracle": 1521, "sqlserver": 1433}
# -------------------------------------------------------------------------------


def jdbc_options(
    engine: str, host: str, database: str, table: str, port: int | None = None,
    partition_column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 1,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options; a partition column with bounds makes the read parallel."""
    if engine not in JDBC_URLS:
        raise ValueError(f"engine {engine!r} is not one of {sorted(JDBC_URLS)}")
    url = JDBC_URLS[engine].format(host=host, port=port or JDBC_PORTS[engine], database=database)
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column is not None:
        if lower is None or upper is None or partitions < 1:
            raise ValueError("a partition column needs lower and upper bounds and a partition count")
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc_tables(spark: SparkSession, include: Sequence[str], **options) -> dict[str, DataFrame]:
    """One lazy frame per listed table."""
    return {t: spark.read.format("jdbc").options(**jdbc_options(table=t, **options)).load() for t in include}
