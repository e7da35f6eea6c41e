"""A stored list of landed text files and their header lines, brought up to date by what is new.

Files are listed through the Hadoop file system, so empty files and every store Spark reads are covered. Only files
that the list lacks in their present size and time are opened, and only for their first line. The list is a Parquet folder
to which updates are appended; the newest entry of a path counts, and only while the path is there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import file_date

OPEN_FILES = 16
FILE = "path string, size long, modified long"
ENTRY = FILE + ", head string"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of all files under ``path``, empty ones too; names that start with _ or . are left out."""
    store, hadoop = _file_system(spark, path)

    def statuses() -> Iterator[tuple[str, int, int]]:
        found = store.listFiles(hadoop, True)
        while found.hasNext():
            status = found.next()
            if status.getPath().getName()[0] not in "_.":
                yield status.getPath().toString(), status.getLen(), status.getModificationTime()

    return spark.createDataFrame(list(statuses()), FILE)


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file without its byte-order mark; None for an empty file."""
    store, hadoop = _file_system(spark, path)
    stream = store.open(hadoop)
    try:
        line = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return line if line is None else line.removeprefix("\ufeff")


def header_fields(head: Column) -> Column:
    """The names in a header line: separated by commas, blanks around them and quotes taken off. None for no line."""
    bare = F.regexp_replace(head, "^\ufeff", "")
    fields = F.regexp_extract_all(F.concat(bare, F.lit(",")), F.lit(r'\s*("(?:[^"]|"")*"|[^,"]*)\s*,'), F.lit(1))
    unquoted = F.transform(fields, lambda f: F.when(
        f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(F.trim(f)))
    return F.when(F.length(F.trim(bare)) > 0, F.transform(unquoted, lambda f: F.trim(f)))


def _stored(spark: SparkSession, manifest: str) -> DataFrame | None:
    store, hadoop = _file_system(spark, manifest)
    return spark.read.schema(ENTRY + ", version int").parquet(manifest) if store.exists(hadoop) else None


def update_manifest(spark: SparkSession, path: str, manifest: str) -> int:
    """Add the heads of files that are new, or changed in size or time. Returns the number of files opened."""
    files, stored = listed_files(spark, path), _stored(spark, manifest)
    version, fresh = 0, files
    if stored is not None:
        version = (stored.agg(F.max("version")).first()[0] or 0) + 1
        fresh = files.join(stored, ["path", "size", "modified"], "left_anti")
    new = fresh.collect()  # file names, not rows
    if not new:
        return 0
    with ThreadPoolExecutor(OPEN_FILES) as pool:
        heads = list(pool.map(lambda f: first_line(spark, f.path) if f.size else None, new))
    rows = [(f.path, f.size, f.modified, head, version) for f, head in zip(new, heads)]
    spark.createDataFrame(rows, ENTRY + ", version int").coalesce(1).write.mode("append").parquet(manifest)
    return len(new)


def landed_files(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """One row per file now under ``path``, after an update of the manifest.

    Returns path, source_file, size, head (first line; null for an empty file), header (its names), file_date (from the
    name) and file_order, from 1 by date and name; files without a date come last.
    """
    update_manifest(spark, path, manifest)
    stored = _stored(spark, manifest)
    if stored is None:  # no file was ever there
        stored = spark.createDataFrame([], ENTRY + ", version int")
    newest = stored.groupBy("path").agg(F.max_by(F.struct("size", "head"), "version").alias("_entry"))
    name = F.element_at(F.split("path", "/"), -1)
    files = newest.join(listed_files(spark, path).select("path"), "path", "left_semi").select(
        "path", name.alias("source_file"), "_entry.size", "_entry.head", header_fields(F.col("_entry.head")).alias("header"))
    return ordered_files(files.withColumn("file_date", file_date(F.col("source_file"))))


def ordered_files(files: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """Add ``file_order``: 1, 2, ... by date, then name. One row a file, so one task can rank them."""
    order = order or [F.col("file_date").asc_nulls_last(), F.col("source_file")]
    return files.withColumn("file_order", F.row_number().over(Window.orderBy(*order)))
