"""Questions in natural language and SQL with semantic predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import embedding, statistics
from ..session import prepare
from ..sources import catalog
from ..sources.config import Settings
from . import executor, ir, nl_rules, planner, sqlpp
from .registry import query

NOW = dt.datetime(2024, 2, 10, 12)


def base(spark, folder):
    o = catalog.objects(spark, folder)
    return o.withColumn("metadata", F.create_map(F.lit("location"), F.col("metadata")["source"], F.lit("lang"), F.col("metadata")["lang"]))


def ask(spark, folder, text, **options):
    return executor.answer(nl_rules.parse(text), base(spark, folder), settings=Settings(**options), now=NOW).select("doc_id", F.round("similarity", 4).alias("similarity"))


def _terms(*terms: str, limit: int, more: str = "") -> str:
    hit = " + ".join(f"contains(lower(text), '{t}')::INT" for t in terms)
    return f"SELECT doc_id, round(s, 4) AS similarity FROM (SELECT 'doc-' || doc_id AS id, doc_id, ({hit}) / {len(terms)}.0 AS s FROM documents {more}) WHERE s > 0 ORDER BY s DESC, id LIMIT {limit}"


@query("nl_query_terms", "NL-03 NL-05 NL-15 LIM-03 SRT-04", _terms("license", limit=5))
def nl_terms(spark, folder):
    return ask(spark, folder, "查找License 的文本，5条")


@query("nl_query_two_terms", "NL-05 FLT-10", _terms("trash", "clown", limit=100))
def nl_two(spark, folder):
    return ask(spark, folder, "搜索trash，包含clown")


@query("nl_query_location", "NL-06 FLT-11", "SELECT doc_id, 1.0 AS similarity FROM documents WHERE contains(source, 'src3') ORDER BY 'doc-' || doc_id LIMIT 100")
def nl_location(spark, folder):
    return ask(spark, folder, "在src3拍摄的文本")


@query("nl_query_all", "NL-04 NL-08 LIM-02", "SELECT doc_id, 1.0 AS similarity FROM documents ORDER BY 'doc-' || doc_id LIMIT 100")
def nl_all(spark, folder):
    return ask(spark, folder, "all of it please")


@query("nl_query_period", "NL-07 SC-15 FLT-17", "SELECT 'evt-' || event_id AS object_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-02-05' ORDER BY 'evt-' || event_id LIMIT 100")
def nl_period(spark, folder):
    q = nl_rules.parse("上星期的传感器")
    q = ir.Question(q.kind, q.original, q.types, period=q.period)
    return executor.answer(q, catalog.iot_objects(spark, folder), now=dt.datetime(2024, 2, 7)).select("object_id")


@query("nl_query_dict", "API-07 NL-15 FLT-01", "SELECT doc_id, 1.0 AS similarity FROM documents WHERE lang = 'fr' ORDER BY 'doc-' || doc_id LIMIT 7")
def nl_dict(spark, folder):
    q = ir.from_dict({"type": "natural_language", "data_types": ["text"], "where_conditions": [("lang", "=", "fr")], "limit": 7})
    return executor.answer(q, base(spark, folder)).select("doc_id", "similarity")


@query("nl_query_semantic", "VEC-02 EMB-05 NL-15 JN-02")
def nl_semantic(spark, folder):
    o = base(spark, folder)
    q = nl_rules.parse("找出license 10条文本")
    held = embedding.embed_objects(o)
    return executor.answer(q, o, held, embedding.embed_text, Settings(semantic_threshold=0.05)).select("doc_id", F.round("similarity", 4).alias("similarity"))


@query("nl_model_plan", "NL-09 NL-10 NL-11 NL-12 LLM-01 LLM-02", _terms("license", limit=9))
def model_plan(spark, folder):
    client = planner.MockClient({"ANALYZE": '```json\n{"intent": {"type": "SELECT"}, "entities": [{"type": "data_type", "value": "text"}, {"type": "content", "value": "License"}], "limit": 9}\n```', "CONFIDENCE": "0.9"})
    plan = planner.Planner(client).plan("find licenses")
    return executor.answer(planner.to_question("find licenses", plan["analysis"]), base(spark, folder)).select("doc_id", F.round("similarity", 4).alias("similarity"))


def statement(spark, folder, sql, **vectors):
    prepare(spark)
    catalog.register_views(spark, folder)
    return sqlpp.run(spark, sql, vectors)


@query("sqlpp_caption", "NL-01 NL-02 UD-02 FLT-08", "SELECT 'doc-' || doc_id AS object_id, lang FROM documents WHERE contains(lower(text), 'license') AND lang = 'en' ORDER BY object_id LIMIT 10")
def sql_caption(spark, folder):
    return statement(spark, folder, 'SELECT object_id, lang FROM multimodal_data WHERE CAPTION_CONTAINS("License") AND lang = "en" ORDER BY object_id LIMIT 10;')


@query("sqlpp_semantic_match", "UD-01 FLT-07", "SELECT 'doc-' || doc_id AS object_id FROM documents WHERE contains(lower(text), 'trash') AND contains(lower(text), 'moron') OR contains(lower(text), 'trash') OR contains(lower(text), 'moron')")
def sql_semantic(spark, folder):
    return statement(spark, folder, 'SELECT object_id FROM text WHERE SEMANTIC_MATCH(content, "trash moron")')


@query("sqlpp_vector", "UD-03 FLT-09", "SELECT 'doc-' || vec_id AS object_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(generate_series(1, 64), lambda i: CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.0 END)), 4) AS s FROM embeddings JOIN documents ON doc_id = vec_id WHERE list_cosine_similarity(embedding::DOUBLE[], list_transform(generate_series(1, 64), lambda i: CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.0 END)) > 0.2")
def sql_vector(spark, folder):
    return statement(spark, folder, "SELECT object_id, round(VECTOR_SIMILARITY(embedding, query_vector), 4) AS s FROM multimodal_data WHERE VECTOR_SIMILARITY(embedding, query_vector) > 0.2", query_vector=[1.0] + [0.0] * 63)


@query("sqlpp_metadata_path", "FLT-22 NL-11", "SELECT 'doc-' || doc_id AS object_id FROM documents WHERE source = 'src5' AND contains(lower(text), 'the') ORDER BY object_id LIMIT 100")
def sql_path(spark, folder):
    return statement(spark, folder, "SELECT object_id FROM multimodal_data WHERE metadata->>'source' = 'src5' AND CAPTION_CONTAINS('the') ORDER BY object_id LIMIT 100")


@query("sqlpp_group", "AGG-16 PRJ-02 NL-02", "SELECT lang, count(*) AS n, round(avg(n_chars), 2) AS mean_chars FROM documents GROUP BY lang HAVING count(*) > 10")
def sql_group(spark, folder):
    return statement(spark, folder, "SELECT lang, count(*) AS n, round(avg(n_chars), 2) AS mean_chars\nFROM multimodal_data\nGROUP BY lang HAVING count(*) > 10")


@query("intent_agg", "AGG-16", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 2) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang")
def intents(spark, folder):
    d = catalog.table(spark, folder, "documents")
    names = {"COUNT": "n", "SUM": "total", "AVG": "mean", "MIN": "least", "MAX": "most"}
    parts = [statistics.intent_aggregate(d, i, None if i == "COUNT" else "n_chars", ["lang"]).withColumnRenamed("value", n) for i, n in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "lang")
    return out.withColumn("mean", F.round("mean", 2))
