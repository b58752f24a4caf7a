"""The engine's tables over a folder of Parquet tables: objects, events, vectors, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("text", "image", "video", "audio", "iot")

OBJECTS = "object_id STRING, type STRING, text STRING, payload BINARY, metadata MAP<STRING,STRING>, tags ARRAY<STRING>, created_at TIMESTAMP, updated_at TIMESTAMP, size BIGINT"
EVENTS = "event_id STRING, object_id STRING, event_type STRING, ts TIMESTAMP, data MAP<STRING,STRING>, metadata MAP<STRING,STRING>, sequence_number BIGINT"
EDGES = "src STRING, dst STRING, rel_type STRING, properties MAP<STRING,STRING>, created_at TIMESTAMP"

#: Which kind of change an event of the stream stands for.
EVENT_KINDS = {"signup": "INSERT", "click": "UPDATE", "purchase": "UPDATE", "view": "PATCH", "error": "DELETE"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as objects of type text. Map look-ups on `metadata` fold to the scanned columns, so they are pushed down."""
    d = table(spark, folder, "documents")
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("object_id"), F.lit("text").alias("type"), "text", "doc_id",
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string")).alias("metadata"),
        F.array("lang", "source").alias("tags"), F.octet_length(F.encode("text", "UTF-8")).cast("bigint").alias("size"),
    )


def iot_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of the event stream as objects of type iot."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("object_id"), F.lit("iot").alias("type"), F.create_map(F.lit("k"), k, F.lit("value"), F.round("value", 2).cast("string")).alias("metadata"), F.col("ts").cast("timestamp").alias("created_at"))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as a log of changes to one object per user."""
    e = table(spark, folder, "events")
    kind = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    data = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.concat(F.lit("last_"), F.col("event_type")), F.col("event_id").cast("string"))
    return e.select(F.col("event_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("object_id"), F.element_at(kind, F.col("event_type")).alias("event_type"), F.col("ts").cast("timestamp").alias("ts"), data.alias("data"), F.col("event_id").alias("sequence_number"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return v.select(F.col("vec_id"), F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("object_id"), "embedding", "label")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations, customers, suppliers and orders as graph nodes."""
    part = lambda name, key, label: table(spark, folder, name).select(F.concat(F.lit(f"{name}-"), F.col(key).cast("string")).alias("object_id"), F.lit(name).alias("type"), F.col(label).cast("string").alias("name"))
    return part("region", "r_regionkey", "r_name").union(part("nation", "n_nationkey", "n_name")).union(part("customer", "c_custkey", "c_name")).union(part("supplier", "s_suppkey", "s_name"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """region -> nation -> customer and supplier, as typed edges."""
    link = lambda name, above, src, key, kind: table(spark, folder, name).select(F.concat(F.lit(f"{above}-"), F.col(src).cast("string")).alias("src"), F.concat(F.lit(f"{name}-"), F.col(key).cast("string")).alias("dst"), F.lit(kind).alias("rel_type"))
    return link("nation", "region", "n_regionkey", "n_nationkey", "has_nation").union(link("customer", "nation", "c_nationkey", "c_custkey", "has_customer")).union(link("supplier", "nation", "s_nationkey", "s_suppkey", "has_supplier"))


def register_views(spark: SparkSession, folder: str) -> None:
    """multimodal_data, its typed views, and the other tables, for SQL."""
    both = objects(spark, folder)
    v = vectors(spark, folder).select("object_id", F.col("embedding").cast("array<double>").alias("embedding"))
    full = both.join(v, "object_id", "left")
    shown = full.select("object_id", F.col("object_id").alias("id"), F.col("text").alias("content"), "text", "type", F.col("type").alias("data_type"), "metadata", "tags", "size", "embedding", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"), F.col("metadata")["n_chars"].cast("bigint").alias("n_chars"))
    shown.createOrReplaceTempView("multimodal_data")
    for kind in TYPES:
        shown.where(F.col("type") == kind).createOrReplaceTempView(kind)
    event_log(spark, folder).createOrReplaceTempView("event_log")
    edges(spark, folder).createOrReplaceTempView("edges")
    nodes(spark, folder).createOrReplaceTempView("nodes")
