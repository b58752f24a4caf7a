"""Chunking, deduplication, Merkle roots, object updates, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import statistics, storage
from ..session import prepare, shared_dir
from ..sources import catalog, formats
from .registry import query

PIECES = """p AS (SELECT doc_id, i AS idx, sha256(array_slice(b, i * 1024 + 1, (i + 1) * 1024)) AS chunk_hash, octet_length(array_slice(b, i * 1024 + 1, (i + 1) * 1024)) AS chunk_size
FROM (SELECT doc_id, encode(text) AS b, unnest(generate_series(0, greatest((octet_length(encode(text)) + 1023) // 1024 - 1, 0))) AS i FROM documents))"""


def pieces(spark, folder):
    return storage.chunks(catalog.table(spark, folder, "documents").select("doc_id", "text"), 1024, id_col="doc_id")


@query("chunk_objects", "SNK-04 SNK-06 SC-05 SC-06", f"WITH {PIECES} SELECT doc_id, idx, chunk_hash, chunk_size FROM p")
def chunk_objects(spark, folder):
    return pieces(spark, folder).select("doc_id", F.col("idx").cast("long").alias("idx"), "chunk_hash", F.col("chunk_size").cast("long").alias("chunk_size"))


@query("chunk_dedup_refs", "SNK-05 SNK-09 AGG-06", f"WITH {PIECES} SELECT chunk_hash, any_value(chunk_size) AS chunk_size, count(*) AS refs, any_value(chunk_size) * (count(*) - 1) AS saved FROM p GROUP BY chunk_hash HAVING count(*) > 1")
def dedup_refs(spark, folder):
    return storage.dedup_savings(storage.chunk_table(pieces(spark, folder))).withColumn("chunk_size", F.col("chunk_size").cast("long"))


@query("chunk_same_size", "AGG-05", f"WITH {PIECES} SELECT chunk_size, count(DISTINCT chunk_hash) AS n FROM p GROUP BY chunk_size HAVING count(DISTINCT chunk_hash) > 1")
def same_size(spark, folder):
    held = pieces(spark, folder).withColumn("type", F.lit("text"))
    return storage.same_size_groups(held).select(F.col("chunk_size").cast("long").alias("chunk_size"), "n")


@query("chunk_orphans", "JN-07 SNK-09", f"WITH {PIECES} SELECT DISTINCT chunk_hash FROM p WHERE chunk_hash NOT IN (SELECT chunk_hash FROM p WHERE doc_id % 7 <> 0)")
def orphans(spark, folder):
    held = pieces(spark, folder)
    return storage.orphans(storage.chunk_table(held), held.where("doc_id % 7 <> 0")).select("chunk_hash")


@query("chunk_reassemble", "SRC-04 JN-07", "SELECT doc_id, sha256(text) AS digest FROM documents")
def reassemble(spark, folder):
    return storage.reassemble(pieces(spark, folder), "doc_id").select("doc_id", F.sha2("data", 256).alias("digest"))


def _merkle_sql(levels: int = 8) -> str:
    steps, last = [], "p"
    for k in range(levels):
        steps.append(f"m{k} AS (SELECT doc_id, idx // 2 AS idx, CASE WHEN count(*) = 1 THEN min(chunk_hash) ELSE sha256(string_agg(chunk_hash, '' ORDER BY idx)) END AS chunk_hash FROM {last} GROUP BY doc_id, idx // 2)")
        last = f"m{k}"
    return f"WITH {PIECES}, {', '.join(steps)}, n AS (SELECT doc_id, count(*) AS chunk_count FROM p GROUP BY doc_id) SELECT doc_id, chunk_count, chunk_hash AS merkle_root FROM {last} JOIN n USING (doc_id)"


@query("merkle_root", "SNK-07", _merkle_sql())
def merkle(spark, folder):
    return storage.merkle_roots(pieces(spark, folder).drop("bytes"), id_col="doc_id").withColumn("chunk_count", F.col("chunk_count").cast("long"))


@query("storage_stats", "AGG-03 AGG-04 AGG-12", """
SELECT lang, count(*) AS objects, sum(octet_length(encode(text)))::BIGINT AS total_size, sum(n_chars)::BIGINT AS stored_size, round(sum(n_chars) / greatest(sum(octet_length(encode(text))), 1), 4) AS ratio FROM documents GROUP BY ROLLUP (lang)""")
def stats(spark, folder):
    d = catalog.table(spark, folder, "documents").select("lang", F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"), F.col("n_chars").alias("compressed_size"))
    return storage.storage_stats(d, "lang").withColumn("ratio", F.round("ratio", 4))


@query("zlib_sizes", "SC-08 AGG-03")
def zlib_sizes(spark, folder):
    d = catalog.table(spark, folder, "documents")
    return d.select("doc_id", F.octet_length(F.encode("text", "UTF-8")).alias("size"), storage.compressed_size(F.encode("text", "UTF-8")).alias("compressed_size"))


@query("database_stats", "AGG-12 AGG-15 API-04", """
SELECT 'objects' AS part, count(*) AS rows, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents UNION ALL SELECT 'vectors', count(*), (sum(len(embedding)) * 4)::BIGINT FROM embeddings
UNION ALL SELECT 'events', count(*), 0 FROM events UNION ALL SELECT 'edges', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier), 0""")
def database_stats(spark, folder):
    return statistics.database_stats(catalog.objects(spark, folder), catalog.vectors(spark, folder), catalog.event_log(spark, folder), catalog.edges(spark, folder))


@query("update_rewrite_rule", "SNK-08", """
SELECT doc_id, abs(n_chars - before) / greatest(before, 1) > 0.5 AS rewrite FROM (SELECT doc_id, n_chars, lag(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) WHERE before IS NOT NULL""")
def rewrite_rule(spark, folder):
    d = catalog.table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    d = d.withColumn("before", F.lag("n_chars").over(Window.partitionBy("source").orderBy("doc_id"))).where("before IS NOT NULL")
    return d.select("doc_id", storage.needs_rewrite(F.lit("text"), F.lit("text"), F.col("before"), F.col("n_chars")).alias("rewrite"))


@query("update_objects", "SNK-02 SNK-08 SC-13 SET-05", """
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'kept' WHEN abs(0.0 + octet_length(encode(split_part(text, chr(10), 1))) - octet_length(encode(text))) / greatest(octet_length(encode(text)), 1) > 0.5 THEN 'rewritten' ELSE 'merged' END AS how,
CASE WHEN doc_id % 3 <> 0 THEN lang WHEN abs(0.0 + octet_length(encode(split_part(text, chr(10), 1))) - octet_length(encode(text))) / greatest(octet_length(encode(text)), 1) > 0.5 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN '2' END AS version FROM documents""")
def update(spark, folder):
    prepare(spark)
    o = catalog.objects(spark, folder)
    new = o.where("doc_id % 3 = 0").select("object_id", "type", F.split("text", "\n", -1)[0].alias("text"), F.create_map(F.lit("version"), F.lit("2")).alias("metadata"), F.array(F.lit("new")).alias("tags"))
    new = new.withColumn("size", F.octet_length(F.encode("text", "UTF-8")).cast("long"))
    out = storage.update_objects(o.drop("doc_id"), new)
    return out.select(F.substring("object_id", 5, 20).cast("long").alias("doc_id"), "how", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["version"].alias("version"))


@query("backup_restore", "SNK-16 API-05 SRC-14", "SELECT doc_id, md5(text) AS digest FROM documents")
def backup(spark, folder):
    where = f"{shared_dir(spark)}/backup-{spark.sparkContext.applicationId}"
    formats.write(catalog.table(spark, folder, "documents"), where, "orc", "overwrite")
    return formats.read(spark, where, "orc").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("log_round_trip", "SRC-05 SNK-10 SC-10 SC-09", "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def log_round_trip(spark, folder):
    where = f"{shared_dir(spark)}/log-{spark.sparkContext.applicationId}"
    e = catalog.table(spark, folder, "events").select("event_id", "event_type", F.from_json("props", "k STRING").alias("data"))
    formats.write(e, where, "json", "overwrite", max_records=5000)
    return formats.read_log(spark, where, "event_id BIGINT, event_type STRING, data STRUCT<k STRING>").select("event_id", "event_type", F.col("data.k").alias("k"))
