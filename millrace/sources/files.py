"""File inventories, file content tables and file or query sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# What a scan keeps and skips unless told otherwise.
DEFAULT_TYPES = (
    ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".md", ".html",
    ".htm", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp",
)
DEFAULT_EXCLUDED = (".git", "node_modules", "__pycache__", ".venv")
FILE_FORMATS = ("parquet", "csv", "json", "text", "orc")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case suffix from the last dot of the file name, empty without a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def wanted_file(path: Column, types: Sequence[str]) -> Column:
    """Types with a leading dot match the extension, others any part of the name; no types keep all."""
    suffixes = [s.lower() for s in types if s.startswith(".")]
    parts = [s.lower() for s in types if not s.startswith(".")]
    if not types:
        return F.lit(True)
    keep = extension(path).isin(*suffixes) if suffixes else F.lit(False)
    for part in parts:
        keep = keep | F.contains(F.lower(file_name(path)), F.lit(part))
    return keep


def in_excluded_dir(path: Column, excluded: Sequence[str]) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(e) for e in excluded])) if excluded else F.lit(False)


def inventory(
    spark: SparkSession,
    directory: str,
    types: Sequence[str] = DEFAULT_TYPES,
    excluded: Sequence[str] = DEFAULT_EXCLUDED,
) -> DataFrame:
    """All wanted files below a directory. The content column is pruned, so no file is read.

    Spark's listing passes over files and folders whose name starts with a dot or an underscore.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .load(directory)
    )
    root = directory.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace("path", rf"^[a-z0-9]*:?/*\Q{root}\E/", "")
    rows = found.select(
        "path",
        file_name(F.col("path")).alias("name"),
        relative.alias("relative_path"),
        F.col("length").alias("size"),
        extension(F.col("path")).alias("extension"),
        F.lit(False).alias("is_dir"),
    )
    skipped = in_excluded_dir(F.col("relative_path"), excluded)
    return rows.where(wanted_file(F.col("path"), types) & ~skipped)


def contents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Content table of the files at ``path`` with size, modification time and bytes."""
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path",
        file_name(F.col("path")).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        "content",
    )


def stat(files: DataFrame) -> DataFrame:
    """Everything but the content."""
    return files.drop("content")


def list_directories(files: DataFrame, requested: DataFrame) -> DataFrame:
    """Files directly in the requested ``parent`` folders; an unknown folder lists nothing."""
    return stat(files).join(requested.select("parent").distinct(), "parent", "left_semi")


def existing(files: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested paths with a flag."""
    known = files.select("path").distinct().withColumn("__known", F.lit(True))
    return requested.join(known, "path", "left").select(
        *requested.columns, F.coalesce("__known", F.lit(False)).alias("found")
    )


def deleted(files: DataFrame, requested: DataFrame) -> DataFrame:
    """The table without the requested paths; a path that is not there is no error."""
    return files.join(requested.select("path").distinct(), "path", "left_anti")


def file_source(spark: SparkSession, path: str, file_format: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Read files of a known format. Give a schema for csv and json, so that nothing is inferred."""
    if file_format not in FILE_FORMATS:
        raise ValueError(f"unknown file format {file_format!r}")
    reader = spark.read.format(file_format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def query_source(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Run a SELECT over named DataFrames, written as ``{name}`` in the text."""
    return spark.sql(text, **tables)


def jdbc_source(spark: SparkSession, url: str, text: str, driver: str, **options) -> DataFrame:
    """Run a SELECT in a database. Give partitionColumn, lowerBound, upperBound and numPartitions for a
    parallel read; the JDBC driver must be on the class path of the session."""
    options = {"url": url, "driver": driver, **options}
    if "partitionColumn" in options:
        options["dbtable"] = f"({text}) AS source"
    else:
        options["query"] = text
    return spark.read.format("jdbc").options(**options).load()
