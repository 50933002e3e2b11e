"""Sources and sinks of documents, manifests, reports and assets, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as t

#: Extensions of images (fixed values).
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
#: Columns of a recognition report in order (fixed values).
REPORT_COLUMNS = ("file_name", "status", "number", "confidence", "date", "class", "reasons", "total_ms", "error")


def images(spark: SparkSession, path: str, recursive: bool = True, limit: int = 0) -> DataFrame:
    """path, modificationTime, length and content of image files in the order of their paths; extensions in any case; limit 0: all."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path if recursive else path.rstrip("/") + "/*")
    rows = rows.where(F.lower(F.col("path")).rlike(r"\.(" + "|".join(IMAGES) + ")$")).orderBy("path")
    return rows.limit(limit) if limit else rows


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents (an object or an array of them a file)."""
    return spark.read.schema(schema).json(path, multiLine=True)


def manifest(spark: SparkSession, path: str, schema: str, ignored: list[str], limit: int = 0, order: str = "messageId") -> DataFrame:
    """Entries of a JSON array with a file path and a status that isn't ignored; limit 0: all, else the first in order."""
    rows = read_json(spark, path, schema)
    rows = rows.where((F.coalesce("filePath", F.lit("")) != "") & ~F.coalesce(F.col("status"), F.lit("")).isin(ignored))
    return rows.orderBy(order).limit(limit) if limit else rows


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object a line."""
    rows.write.json(path)


def write_text(rows: DataFrame, path: str, column: str) -> None:
    """A text a line."""
    rows.select(F.regexp_replace(t.text(F.col(column)), r"[\r\n]+", " ").alias("value")).write.text(path)


def write_report_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns; arrays joined by ', '."""
    kinds = dict(rows.dtypes)
    rows.select(*[F.array_join(c, ", ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns]).write.csv(path, header=True)


def outputs(kind: str, path: str) -> list[tuple[str, str]]:
    """(format, path) of a report: json, csv or both."""
    formats = {"json": ["json"], "csv": ["csv"], "both": ["json", "csv"]}
    if kind not in formats:
        raise ValueError(f"no report format: {kind}")
    stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    return [(f, f"{stem}.{f}") for f in formats[kind]]


def write_report(rows: DataFrame, kind: str, path: str, columns: list[str]) -> list[str]:
    done = []
    for form, target in outputs(kind, path):
        write_report_csv(rows, target, columns) if form == "csv" else write_json(rows.select(*columns), target)
        done.append(target)
    return done


def asset_descriptor(company: Column, kind: Column, source: Column, asset: Column, original: Column, url: Column, media_type: Column, stored: Column, content: Column, driver: str, base_url: str | None = None) -> Column:
    """What is known of a stored asset: key, extension, source, type, size, hash and public address."""
    ending = t.guess_extension(url, original, media_type)
    key = t.asset_key(company, kind, stored, source, asset, ending)
    return F.struct(
        asset.alias("asset_id"), company.alias("company_id"), source.alias("source_id"), kind.alias("document_type"), F.lit(driver).alias("storage_driver"), key.alias("storage_key"), ending.alias("extension"), stored.alias("stored_at"),
        F.struct(F.when(url.isNotNull(), "url").otherwise("upload").alias("type"), t.some(t.base_name(original)).alias("original_name"), url.alias("remote_url")).alias("source"),
        F.coalesce(t.some(media_type), t.guess_media_type(key)).alias("content_type"), F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(content, 256).alias("sha256"), t.public_url(F.lit(base_url), key).alias("public_url"),
    )


def write_assets(rows: DataFrame, path: str, stored: str) -> None:
    """Parquet by company, document type and date (UTC)."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd"}
    rows.withColumns({k: F.date_format(stored, v) for k, v in parts.items()}).write.partitionBy("company_id", "document_type", *parts).parquet(path)


def read_assets(spark: SparkSession, path: str, company: str | None = None, day: str | None = None) -> DataFrame:
    """Assets of a company and day: both prune folders."""
    rows = spark.read.option("basePath", path).parquet(path)
    if company:
        rows = rows.where(F.col("company_id") == company)
    return rows.where(F.format_string("%04d-%02d-%02d", *[F.col(c).cast("int") for c in ("year", "month", "day")]) == day) if day else rows
