"""Readers and writers of files and databases, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffix of a stored object of each type; other types are kept as raw bytes.
SUFFIX = {"text": ".txt", "iot": ".json", "image": ".jpg", "video": ".mp4", "audio": ".wav"}


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """parquet, orc, csv, json, text, xml, avro, jdbc, kafka, ... : whatever the session has a reader for."""
    reader = spark.read.format(kind).options(**options)
    reader = reader.schema(schema) if schema else reader
    return reader.load() if kind in ("jdbc", "kafka") else reader.load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "append", partition_by: tuple[str, ...] = (), max_records: int = 0) -> None:
    """Files of at most max_records rows (0: no bound): the rolling of a log."""
    writer = df.write.format(kind).mode(mode)
    writer = writer.option("maxRecordsPerFile", max_records) if max_records else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; lines that aren't JSON objects are left out."""
    held = f"{schema}, _bad STRING"
    lines = spark.read.schema(held).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return lines.where(F.col("_bad").isNull()).drop("_bad")


def read_media(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Files as objects: (object_id, type, payload, size, created_at); the type by suffix."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = found.option("pathGlobFilter", f"*{SUFFIX[kind]}") if kind else found
    by_suffix = F.create_map(*[F.lit(x) for t, s in SUFFIX.items() for x in (s, t)])
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    return found.load(path).select(F.md5(F.col("path").cast("binary")).alias("object_id"), F.coalesce(F.element_at(by_suffix, suffix), F.lit("binary")).alias("type"), F.col("content").alias("payload"), F.col("length").alias("size"), F.col("modificationTime").alias("created_at"))
