"""Scans, predicates, scores, sorting over objects."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from ..functions.columns import contains_ci, iot_description, vec_cosine
from ..operators import graph, predicates
from ..sources import catalog
from . import planner
from .registry import query


@query("flagship_caption_topk", "SRC-01 FLT-02 FLT-08 JN-01 VEC-01 SRT-03 LIM-01 PRJ-01", """
SELECT d.object_id, d.lang, d.similarity FROM (
  SELECT 'doc-' || doc_id AS object_id, doc_id, lang, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS similarity
  FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang = 'en' AND contains(lower(text), 'the')) d
ORDER BY similarity DESC, object_id LIMIT 10""")
def flagship(spark, folder):
    docs = catalog.objects(spark, folder).where(predicates.compare(F.col("metadata")["lang"], "=", "en")).where(contains_ci(F.col("text"), "the"))
    v = catalog.vectors(spark, folder)
    first = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("query")))
    scored = docs.select("object_id", F.col("metadata")["lang"].alias("lang")).join(v.select("object_id", "embedding"), "object_id").crossJoin(first)
    return scored.select("object_id", "lang", F.round(vec_cosine(F.col("embedding"), F.col("query")), 4).alias("similarity")).orderBy(F.desc("similarity"), "object_id").limit(10)


@query("scan_objects", "SRC-01 PRJ-01 FRM-01", """
SELECT 'doc-' || doc_id AS object_id, 'text' AS type, lang, source, octet_length(encode(text)) AS size, text AS content FROM documents""")
def scan_objects(spark, folder):
    return catalog.objects(spark, folder).select("object_id", "type", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"), "size", F.col("text").alias("content"))


@query("scan_type_union", "SRC-02 SRC-03 SET-01 SET-02 NL-04", """
SELECT DISTINCT object_id, type FROM (SELECT 'doc-' || doc_id AS object_id, 'text' AS type FROM documents UNION ALL SELECT 'evt-' || event_id, 'iot' FROM events) WHERE type IN ('text', 'iot')""")
def scan_type_union(spark, folder):
    both = catalog.objects(spark, folder).select("object_id", "type").unionByName(catalog.iot_objects(spark, folder).select("object_id", "type"))
    return both.where(F.col("type").isin("text", "iot")).distinct()


@query("point_lookup", "SRC-04 JN-01", "SELECT 'doc-' || doc_id AS object_id, lang, text FROM documents WHERE doc_id = 42")
def point_lookup(spark, folder):
    return catalog.objects(spark, folder).where("doc_id = 42").select("object_id", F.col("metadata")["lang"].alias("lang"), "text")


@query("where_and_eq_gt_lt", "FLT-01 FLT-02 FLT-03 FLT-04 FLT-05 FLT-23", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500 AND n_chars < 5000 AND source <> 'src1'")
def where_and(spark, folder):
    d = catalog.table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.where((F.col("lang") == "en") & (F.col("n_chars") > 500) & (F.col("n_chars") < 5000) & (F.col("source") != "src1")).select("doc_id", "lang", "n_chars")


@query("where_metadata_keys", "FLT-02 FLT-03 FLT-05 FLT-23", "SELECT 'doc-' || doc_id AS object_id FROM documents WHERE lang <> 'en' AND n_chars >= 2000")
def where_metadata(spark, folder):
    o = catalog.objects(spark, folder)
    return predicates.all_of(o, [("lang", "<>", "en"), ("n_chars", ">=", 2000), ("type", "=", "text")]).select("object_id")


@query("where_or_in_between", "FLT-01 FLT-06", "SELECT doc_id, lang, source FROM documents WHERE (lang IN ('de', 'fr') OR n_chars BETWEEN 100 AND 400) AND source LIKE 'src1%' AND lang IS NOT NULL")
def where_or(spark, folder):
    d = catalog.table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.where((F.col("lang").isin("de", "fr") | F.col("n_chars").between(100, 400)) & F.col("source").like("src1%") & F.col("lang").isNotNull()).select("doc_id", "lang", "source")


@query("json_path_filter", "FLT-22 SC-10", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def json_path(spark, folder):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return catalog.table(spark, folder, "events").select("event_id", k.alias("k")).where("k > 50")


@query("variant_path_filter", "SC-10 FLT-22", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type")
def variant_path(spark, folder):
    e = catalog.table(spark, folder, "events").select("event_type", F.expr("try_variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


@query("caption_contains", "FLT-08 SC-01", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def caption(spark, folder):
    return catalog.objects(spark, folder).where(contains_ci(F.col("text"), "LICENSE")).select("doc_id")


@query("keyword_score", "FLT-10 FLT-07", """
SELECT doc_id, round(s / 3.0, 4) AS semantic_score FROM (SELECT doc_id, contains(lower(text), 'the')::int + contains(lower(text), 'trash')::int + contains(lower(text), 'moron')::int AS s FROM documents) WHERE s > 0""")
def keyword(spark, folder):
    hit = predicates.keyword_match(catalog.objects(spark, folder), ["the", "trash", "Moron"])
    return hit.select("doc_id", F.round("semantic_score", 4).alias("semantic_score"))


@query("filters_location_object", "FLT-11 FLT-12 FLT-13 FLT-14 FLT-15", "SELECT doc_id FROM documents WHERE contains(source, 'src1') AND contains(text, 'tion') AND contains(text, 'der')")
def filters(spark, folder):
    o = catalog.objects(spark, folder).withColumn("metadata", F.create_map(F.lit("location"), F.col("metadata")["source"]))
    return predicates.apply_filters(o, [{"type": "location", "value": "src1"}, {"type": "color", "value": "tion"}, {"type": "object", "value": "der"}, {"type": "unknown", "value": "x"}]).select("doc_id")


@query("time_range_month", "FLT-17 SC-14 SC-15 NL-07", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'")
def time_range(spark, folder):
    period = predicates.resolve_time_range("last_month", (), dt.datetime(2024, 2, 10, 8))
    e = catalog.table(spark, folder, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("created_at"))
    return predicates.in_period(e, period).select("event_id", "event_type")


@query("time_range_inclusive", "FLT-18 FLT-21 GR-02", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'")
def time_inclusive(spark, folder):
    return graph.by_time(catalog.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2024-01-05", "2024-01-07").select("event_id")


@query("tag_lookup", "FLT-19 GR-02 AGG-09", "SELECT tag, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest([lang, source]) AS tag FROM documents WHERE lang = 'de' OR source = 'de') GROUP BY tag")
def tags(spark, folder):
    return graph.tag_index(graph.by_tag(catalog.objects(spark, folder), "de"))


@query("order_by_fields", "SRT-01 SRT-02 LIM-01", "SELECT doc_id, lang, n_chars FROM documents ORDER BY lang DESC, n_chars, doc_id LIMIT 25")
def order_by(spark, folder):
    return catalog.table(spark, folder, "documents").select("doc_id", "lang", "n_chars").orderBy(F.desc("lang"), "n_chars", "doc_id").limit(25)


@query("page_offset", "LIM-07 LIM-02", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def offset(spark, folder):
    return catalog.table(spark, folder, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20)


@query("projection_distinct", "PRJ-02 SET-02", "SELECT DISTINCT lang, upper(source) AS src, n_chars // 1000 AS kilo FROM documents")
def distinct(spark, folder):
    return catalog.table(spark, folder, "documents").select("lang", F.upper("source").alias("src"), F.floor(F.col("n_chars") / 1000).alias("kilo")).distinct()


@query("iot_description", "SC-16 EMB-04", "SELECT event_id, 'IoT data: k: ' || json_extract_string(props, '$.k') || ', type: ' || event_type AS description FROM events")
def iot(spark, folder):
    e = catalog.table(spark, folder, "events")
    return e.select("event_id", iot_description(F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))).alias("description"))


@query("string_functions", "SC-02 SC-03 SC-04 SC-05 SC-07", r"""
SELECT page_id, md5(url) AS url_md5, regexp_extract(url, '^https?://([^/]+)', 1) AS host, upper(substr(trim(url), 1, 8)) AS head, len(string_split(url, '/')) AS parts, octet_length(encode(html)) AS bytes FROM pages""")
def strings(spark, folder):
    p = catalog.table(spark, folder, "pages")
    return p.select("page_id", F.md5(F.encode("url", "UTF-8")).alias("url_md5"), F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.upper(F.substring(F.trim("url"), 1, 8)).alias("head"), F.size(F.split("url", "/")).cast("long").alias("parts"), F.octet_length(F.encode("html", "UTF-8")).cast("long").alias("bytes"))


@query("left_outer_labels", "JN-09 FLT-23", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def labels(spark, folder):
    d, lab = catalog.table(spark, folder, "documents").select("doc_id"), catalog.table(spark, folder, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


def in_context(question: pd.Series, history: pd.Series) -> pd.Series:
    return pd.Series([planner.with_context(q, {"conversation_history": list(h)}) for q, h in zip(question, history)])


@query("conversation_context", "NL-13 SRT-05", """
SELECT conv_id, arg_max(text, turn) || ' | 会话上下文: ' || string_agg(role || ':' || text, '; ' ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)) WHERE r <= 3 GROUP BY conv_id""")
def context(spark, folder):
    from pyspark.sql import Window

    c = catalog.table(spark, folder, "conversations").distinct()
    last = c.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r <= 3")
    turn = F.struct("turn", F.concat("role", F.lit(":"), "text").alias("t"))
    held = last.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["t"]).alias("history"))
    asked = F.pandas_udf(in_context, "string")
    return held.select("conv_id", asked("question", "history").alias("context"))


