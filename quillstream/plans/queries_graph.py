"""Graph queries over region, nation, customer and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import prepare
from ..sources import catalog
from .registry import query

EDGES = """e AS (SELECT 'region-' || n_regionkey AS src, 'nation-' || n_nationkey AS dst, 'has_nation' AS rel_type FROM nation UNION ALL SELECT 'nation-' || c_nationkey, 'customer-' || c_custkey, 'has_customer' FROM customer UNION ALL SELECT 'nation-' || s_nationkey, 'supplier-' || s_suppkey, 'has_supplier' FROM supplier)"""


@query("graph_neighbors", "GR-01 JN-06 SRC-09 UD-05", f"""
WITH {EDGES}, w AS (SELECT src, dst, rel_type, 0 AS depth FROM e WHERE src = 'region-0' UNION ALL SELECT b.src, b.dst, b.rel_type, 1 FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 'region-0') SELECT src, dst, rel_type, depth FROM w""")
def neighbors(spark, folder):
    return graph.traverse(catalog.edges(spark, folder), "region-0", 2)


@query("graph_recursive", "GR-01 GR-04", f"WITH RECURSIVE {EDGES}, walk(node, depth) AS (SELECT 'region-0', 0 UNION ALL SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.depth < 2) SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node")
def recursive(spark, folder):
    catalog.edges(spark, folder).createOrReplaceTempView("edges")
    return spark.sql(graph.traverse_sql("region-0", 2))


@query("graph_stats", "AGG-11 GR-03", """
WITH n AS (SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS nodes), m AS (SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS edges),
r AS (SELECT count(DISTINCT r_regionkey) AS components FROM region)
SELECT nodes, 4 AS types, edges, components, round(edges::DOUBLE / (nodes * (nodes - 1)), 8) AS density, components = 1 AS connected FROM n, m, r""")
def stats(spark, folder):
    return graph.graph_stats(catalog.edges(spark, folder), catalog.nodes(spark, folder)).withColumn("density", F.round("density", 8))


@query("graph_components", "GR-03 AGG-11", """
WITH m AS (SELECT r_regionkey AS r, 'region-' || r_regionkey AS id FROM region UNION ALL SELECT n_regionkey, 'nation-' || n_nationkey FROM nation
UNION ALL SELECT n_regionkey, 'customer-' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 'supplier-' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT id AS object_id, min(id) OVER (PARTITION BY r) AS component FROM m""")
def components(spark, folder):
    return graph.components(catalog.edges(spark, folder), catalog.nodes(spark, folder))


@query("edge_upsert", "SNK-18 JN-08", """
SELECT 'customer-' || o_custkey AS src, 'status-' || o_orderstatus AS dst, arg_max(o_orderpriority, o_orderkey) AS rel_type, max(o_orderkey) AS o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY o_custkey, o_orderstatus""")
def edge_upsert(spark, folder):
    o = catalog.table(spark, folder, "orders").select(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("status-"), "o_orderstatus").alias("dst"), F.col("o_orderpriority").alias("rel_type"), "o_orderkey")
    known = catalog.nodes(spark, folder).select("object_id").unionByName(o.select(F.col("dst").alias("object_id")).where("object_id <> 'status-P'").distinct())
    return graph.upsert_edges(o, known, "o_orderkey")


@query("node_upsert_merge", "SNK-17 SC-13 SET-05 SC-12", """
SELECT doc_id, lang, CASE WHEN q IS NOT NULL THEN q::VARCHAR END AS quality, lang || ',' || source || CASE WHEN q IS NOT NULL THEN ',labelled' ELSE '' END AS tags FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)""")
def node_upsert(spark, folder):
    prepare(spark)
    old = catalog.objects(spark, folder).select("object_id", "type", "metadata", "tags")
    lab = catalog.table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("q"))
    new = lab.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("object_id"), F.lit("text").alias("type"), F.create_map(F.lit("quality"), "q").alias("metadata"), F.array(F.lit("labelled")).alias("tags"))
    out = graph.upsert_nodes(old, new)
    return out.select(F.substring("object_id", 5, 20).cast("long").alias("doc_id"), F.col("metadata")["lang"].alias("lang"), F.col("metadata")["quality"].alias("quality"), F.array_join("tags", ",").alias("tags"))


@query("node_delete", "SNK-17", f"WITH {EDGES} SELECT src, dst FROM e WHERE src NOT IN ('nation-3', 'nation-4') AND dst NOT IN ('nation-3', 'nation-4')")
def node_delete(spark, folder):
    nodes, edges = catalog.nodes(spark, folder), catalog.edges(spark, folder)
    _, left = graph.delete_nodes(nodes, edges, nodes.where("object_id IN ('nation-3', 'nation-4')").select("object_id"))
    return left.select("src", "dst")


@query("graph_degree", "AGG-09 GR-02", f"WITH {EDGES} SELECT src, rel_type, count(*) AS degree FROM e GROUP BY ALL")
def degree(spark, folder):
    return catalog.edges(spark, folder).groupBy("src", "rel_type").agg(F.count("*").alias("degree"))
