"""Content-addressed storage: chunks, digests, reference counts, Merkle roots, rewrite rule."""

from __future__ import annotations

import math
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1024 * 1024


def serialized(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def chunks(objects: DataFrame, size: int = CHUNK, body: Column | None = None, id_col: str = "object_id") -> DataFrame:
    """(id, idx, chunk_hash, chunk_size, bytes) of each object's fixed-size pieces; an empty body is one empty piece."""
    data = serialized(F.col("text")) if body is None else body
    held = objects.select(id_col, data.alias("data")).where(F.col("data").isNotNull())
    last = F.greatest(F.ceil(F.octet_length("data") / size) - 1, F.lit(0)).cast("int")
    cut = held.select(id_col, F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("idx"), F.substring(F.col("data"), i * size + 1, F.lit(size)).alias("bytes")))).alias("c"))
    return cut.select(id_col, F.col("c.idx").alias("idx"), F.sha2(F.col("c.bytes"), 256).alias("chunk_hash"), F.octet_length("c.bytes").alias("chunk_size"), F.col("c.bytes").alias("bytes"))


def reassemble(pieces: DataFrame, id_col: str = "object_id") -> DataFrame:
    """(id, data): the pieces put together again, in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "bytes"))), lambda p: F.hex(p["bytes"]))
    return pieces.groupBy(id_col).agg(F.unhex(F.array_join(parts, "")).alias("data"))


def chunk_table(pieces: DataFrame) -> DataFrame:
    """(chunk_hash, chunk_size, refs): each different piece once and how often it is used."""
    return pieces.groupBy("chunk_hash").agg(F.first("chunk_size").alias("chunk_size"), F.count("*").alias("refs"))


def orphans(table: DataFrame, pieces: DataFrame) -> DataFrame:
    """Stored chunks that no object refers to any more."""
    return table.join(pieces.select("chunk_hash"), "chunk_hash", "left_anti")


def dedup_savings(table: DataFrame) -> DataFrame:
    """Chunks used more than once, and the bytes saved by storing them once."""
    return table.where("refs > 1").withColumn("saved", F.col("chunk_size") * (F.col("refs") - 1))


def same_size_groups(pieces: DataFrame, kind: str = "type") -> DataFrame:
    """(size, type, n): groups of different chunks of equal size and type, with more than one member; and their hashes' digest."""
    one = pieces.dropDuplicates(["chunk_hash"])
    return one.groupBy("chunk_size", kind).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("chunk_hash")).alias("hashes")).where("n > 1")


def merkle_level(hashes: Column) -> Column:
    """Pairs of hex digests hashed together, an odd last one moved up as it is."""
    pairs = F.sequence(F.lit(0), ((F.size(hashes) + 1) / 2).cast("int") - 1)
    at = lambda i: F.get(hashes, i)
    return F.transform(pairs, lambda i: F.when(at(2 * i + 1).isNull(), at(2 * i)).otherwise(F.sha2(F.concat(at(2 * i), at(2 * i + 1)), 256)))


def merkle_roots(pieces: DataFrame, most_chunks: int | None = None, id_col: str = "object_id") -> DataFrame:
    """(id, chunk_count, merkle_root); the number of levels follows the largest object."""
    held = pieces.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "chunk_hash"))).alias("p"))
    held = held.select(id_col, F.size("p").alias("chunk_count"), F.transform("p", lambda x: x["chunk_hash"]).alias("level"))
    if most_chunks is None:
        most_chunks = held.agg(F.max("chunk_count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(most_chunks, 1)))):
        held = held.withColumn("level", merkle_level(F.col("level")))
    return held.select(id_col, "chunk_count", F.col("level")[0].alias("merkle_root"))


def compressed_size(data: Column, level: int = 6) -> Column:
    """Bytes after zlib; there is no built-in for it."""

    @F.pandas_udf("long")
    def deflated(held: pd.Series) -> pd.Series:
        return held.map(lambda b: len(zlib.compress(bytes(b), level)) if b is not None else None)

    return deflated(data)


def needs_rewrite(old_type: Column, new_type: Column, old_size: Column, new_size: Column) -> Column:
    """Another type, or a size change of more than half."""
    return (old_type != new_type) | (F.abs(new_size - old_size) / F.greatest(old_size, F.lit(1)) > 0.5)


def update_objects(old: DataFrame, new: DataFrame, id_col: str = "object_id") -> DataFrame:
    """Rewritten where needed, else metadata merged (the new wins) and tags united."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{id_col}") == F.col(f"n.{id_col}"), "full")
    has = F.col(f"n.{id_col}").isNotNull()
    fresh = F.col(f"o.{id_col}").isNull() | needs_rewrite(F.col("o.type"), F.col("n.type"), F.col("o.size"), F.col("n.size"))
    merged = F.map_concat(F.coalesce("o.metadata", F.create_map().cast("map<string,string>")), F.coalesce("n.metadata", F.create_map().cast("map<string,string>")))
    tags = F.array_union(F.coalesce("o.tags", F.array().cast("array<string>")), F.coalesce("n.tags", F.array().cast("array<string>")))
    pick = lambda c: F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(
        F.coalesce(f"n.{id_col}", f"o.{id_col}").alias(id_col), pick("type"), pick("text"), pick("size"),
        F.when(has & ~fresh, merged).when(has, F.col("n.metadata")).otherwise(F.col("o.metadata")).alias("metadata"),
        F.when(has & ~fresh, tags).when(has, F.col("n.tags")).otherwise(F.col("o.tags")).alias("tags"),
        F.when(~has, "kept").when(fresh, "rewritten").otherwise("merged").alias("how"),
    )


def storage_stats(objects: DataFrame, kind: str = "type") -> DataFrame:
    """By type and in all: objects, bytes, stored bytes (if known), ratio."""
    stored = F.sum("compressed_size") if "compressed_size" in objects.columns else F.sum("size")
    return objects.rollup(kind).agg(F.count("*").alias("objects"), F.sum("size").alias("total_size"), stored.alias("stored_size")).withColumn("ratio", F.col("stored_size") / F.greatest(F.col("total_size"), F.lit(1)))
