"""Readers for landed files. Every reader fixes the schema up front and turns bad text into NULL."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.columns import file_date, finite, number, parsed_date
from tidegauge.session import ensure_checkpoint_dir
from tidegauge.sources import schemas as S
from tidegauge.sources.manifest import header_fields, landed_files, ordered_files


class MissingColumnsError(ValueError):
    """Required columns are absent."""


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise MissingColumnsError(f"Missing required columns: {missing}")
    return df


def conform(df: DataFrame, fields: Mapping[str, str], keys: Sequence[str], date_pattern: str) -> DataFrame:
    """Rename by ``fields`` and project onto the standard columns.

    Absent source columns become NULL, others are dropped; keys stay text, the date is parsed and
    everything else is a number.
    """
    present = set(df.columns)

    def source(name: str) -> Column:
        return F.col(f"`{name}`").cast("string") if name in present else F.lit(None).cast("string")

    ordered = {target: source(name) for name, target in fields.items()}
    measures = [t for t in fields.values() if t not in keys and t != "date"]
    return df.select(
        *[ordered[k].alias(k) for k in keys],
        parsed_date(ordered["date"], date_pattern).alias("date"),
        *[number(ordered[m]).alias(m) for m in measures],
    )


def measurements(records: DataFrame) -> DataFrame:
    return conform(records, S.MEASUREMENT_FIELDS, S.MEASUREMENT_KEYS, "yyyy.M.d")


def weather(records: DataFrame) -> DataFrame:
    return conform(records, S.WEATHER_FIELDS, S.WEATHER_KEYS, "yyyy-M-d")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array of records, in subfolders too."""
    raw = spark.read.schema(S.text_schema(list(S.MEASUREMENT_FIELDS))).option("multiLine", True).option("recursiveFileLookup", True)
    return measurements(raw.json(path))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(S.text_schema(list(S.WEATHER_FIELDS))).option("multiLine", True).option("recursiveFileLookup", True)
    return weather(raw.json(path))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """The site master, read as text so that codes keep leading zeros."""
    return spark.read.schema(S.text_schema(S.SITE_COLUMNS)).csv(path, header=True)


def positional_export(raw: DataFrame, body_types: Sequence[str] = tuple(S.WATER_BODY_TYPES)) -> DataFrame:
    """Rows of the headerless export in standard columns; title and header rows have no known type."""
    named = raw.toDF(*S.EXPORT_COLUMNS).filter(F.col("water_body_type").isin(*body_types))
    same_name = {c: c for c in S.MEASUREMENT_FIELDS.values()}
    return conform(named, same_name, S.MEASUREMENT_KEYS, "yyyy.M.d")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return positional_export(spark.read.schema(S.text_schema(S.EXPORT_COLUMNS)).csv(path, header=False))


def landed_headers(files: DataFrame, required: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """Groups of files with one header each: (names, paths). Raises if a file lacks a required column, naming both.

    ``files`` has path and header (``landed_files``); files without a header line are left out.
    """
    grouped = files.filter("header is not null").groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    out = [(list(row.header), list(row.paths)) for row in grouped.collect()]  # names of files, one group a layout
    for columns, paths in out:
        if lacking := sorted(set(required) - set(columns)):
            raise MissingColumnsError(f"Missing required columns: {lacking} in {paths[0]}")
    return sorted(out, key=lambda group: group[1][0])


def read_cycler(spark: SparkSession, path: str, file_format: str = "csv", manifest: str | None = None) -> DataFrame:
    """Only the required channels of every file, with the file name and the date in it.

    Each text file is read by its own header, whatever the order of its columns; files with equal headers are read
    together. The headers come from ``manifest``, a folder in which they are kept from one call to the next. Empty
    files have no rows. NaN becomes NULL.
    """
    name = F.col("_metadata.file_name")

    def channels(frame: DataFrame, text: bool) -> DataFrame:
        def typed(c: str, kind: T.DataType) -> Column:
            column = F.col(f"`{c}`")
            if not isinstance(kind, T.DoubleType):
                return column.try_cast(kind)
            return number(column) if text else finite(column.try_cast(kind))

        return frame.select(name.alias("source_file"), file_date(name).alias("file_date"), *[typed(c, t).alias(c) for c, t in S.CYCLER_CHANNELS.items()])

    if file_format != "csv":
        return channels(require_columns(spark.read.format(file_format).load(path), list(S.CYCLER_CHANNELS)), False)
    frame = None
    for columns, paths in landed_headers(landed_files(spark, path, manifest or _own_manifest(spark)), list(S.CYCLER_CHANNELS)):
        positions = [f"_c{i}" if columns.index(c) != i else c for i, c in enumerate(columns)]  # of repeated names the first counts
        part = channels(spark.read.schema(S.text_schema(positions)).option("header", True).csv(paths), True)
        frame = part if frame is None else frame.unionByName(part)
    if frame is None:
        raise MissingColumnsError(f"no header in any file of {path}")
    return frame


def _own_manifest(spark: SparkSession) -> str:
    """A manifest for one call, in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/manifests/{uuid.uuid4().hex}"


def header_audit(files: DataFrame, required: Sequence[str], path: str = "path", text: str = "value") -> DataFrame:
    """One row per file: order, date, whether it has a header line, required columns it lacks.

    The header is the first line of ``text``, read as ``read_cycler`` reads it: quotes and a byte-order mark do not count.
    """
    line = F.split_part(F.regexp_replace(F.col(text), "\r", ""), F.lit("\n"), F.lit(1))
    name = F.element_at(F.split(F.col(path), "/"), -1)
    wanted = F.array(*[F.lit(c) for c in required])
    header = header_fields(line)
    return files.select(
        name.alias("source_file"),
        file_date(name).alias("file_date"),
        header.isNotNull().alias("has_header"),
        F.array_join(F.array_sort(F.array_except(wanted, F.coalesce(header, F.array().cast("array<string>")))), ",").alias("missing_columns"),
    )


def audit_headers(spark: SparkSession, path: str, required: Sequence[str] = tuple(S.CYCLER_CHANNELS), manifest: str | None = None) -> DataFrame:
    """``header_audit`` over landed text files, empty ones too, from the heads kept in ``manifest``.

    Adds ``file_order``, the place of a file by the date in its name, then by name.
    """
    files = landed_files(spark, path, manifest or _own_manifest(spark))
    audit = header_audit(files.select("path", F.coalesce("head", F.lit("")).alias("value")), required)
    return ordered_files(audit)


def modelling_series(df: DataFrame) -> DataFrame:
    """The rows that forecasts may use, after a check that the table is complete."""
    return require_columns(df, S.SERIES_COLUMNS).filter("is_modeling_cycle")


def rolling_scenarios(df: DataFrame) -> DataFrame:
    return require_columns(df, S.SCENARIO_COLUMNS)


def network_points(features: DataFrame) -> DataFrame:
    """Explode GeoJSON feature collections into one row per point.

    ``features`` has ``file`` and ``features`` (array of structs with ``properties``: ptNo, ptNm, X, Y).
    """
    return features.select("file", F.posexplode("features").alias("place", "feature")).select(
        "file",
        "place",
        F.col("feature.properties.ptNo").cast("string").alias("code"),
        F.col("feature.properties.ptNm").cast("string").alias("name"),
        F.col("feature.properties.Y").cast("double").alias("lat"),
        F.col("feature.properties.X").cast("double").alias("lon"),
    )


NETWORK_SCHEMA = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StructType([
            T.StructField("ptNo", T.StringType()),
            T.StructField("ptNm", T.StringType()),
            T.StructField("X", T.DoubleType()),
            T.StructField("Y", T.DoubleType()),
        ])),
    ]))),
])


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """All GeoJSON files under ``path``, in subfolders too."""
    raw = spark.read.schema(NETWORK_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return network_points(raw.select(F.col("_metadata.file_path").alias("file"), "features"))


def forecast_summary(items: DataFrame) -> DataFrame:
    """Long forecast items (fcstDate yyyyMMdd, category, fcstValue) to one row per day."""
    value = number(F.col("fcstValue").cast("string"))

    def of(category: str) -> Column:
        return F.when(F.col("category") == category, value)

    return (
        items.filter(F.col("category").isin("TMX", "TMN", "POP"))
        .groupBy("fcstDate")
        .agg(
            F.min(of("TMN")).alias("temp_min"),
            F.max(of("TMX")).alias("temp_max"),
            F.max(of("POP")).alias("precip_probability"),
        )
        .select(
            F.concat_ws("/", F.substring("fcstDate", 5, 2), F.substring("fcstDate", 7, 2)).alias("day"),
            "temp_min", "temp_max", "precip_probability",
        )
    )
