"""Vector search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import vec_cosine, vec_norm
from ..operators import embedding, search
from ..sources import catalog
from .registry import query

Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
COS = f"list_cosine_similarity(embedding::DOUBLE[], {Q0})"


def against(spark, folder, *ids):
    """Vectors, and the vectors of some ids as queries (query_id, query)."""
    v = catalog.vectors(spark, folder).select("vec_id", "embedding", "label")
    return v, v.where(F.col("vec_id").isin(*ids)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def one(spark, folder, qid=0):
    """Vectors, each beside one query's vector, in a column `query`."""
    v, q = against(spark, folder, qid)
    return v.crossJoin(F.broadcast(q.select("query")))


def rounded(df):
    return df.withColumn("similarity", F.round("similarity", 4))


@query("vec_topk", "VEC-01 LIM-05 SRT-03 EMB-05", f"SELECT vec_id, round({COS}, 4) AS similarity FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10")
def topk(spark, folder):
    return rounded(search.top_k(one(spark, folder), F.col("query"), 10, id_col="vec_id"))


@query("vec_threshold", "FLT-20 FLT-09 VEC-01", f"SELECT vec_id, round({COS}, 4) AS similarity FROM embeddings WHERE {COS} >= 0.2")
def threshold(spark, folder):
    v = one(spark, folder).select("vec_id", vec_cosine(F.col("embedding"), F.col("query")).alias("similarity"))
    return rounded(v.where("similarity >= 0.2"))


@query("vec_inner_product", "VEC-03", f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {Q0}), 4) AS similarity FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {Q0}) DESC, vec_id LIMIT 10")
def inner_product(spark, folder):
    return rounded(search.top_k(one(spark, folder), F.col("query"), 10, metric="dot", id_col="vec_id"))


@query("vec_angular", "VEC-04", f"SELECT vec_id, round(1 / (1 + sqrt(greatest(0, 2 - 2 * {COS}))), 4) AS similarity FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10")
def angular(spark, folder):
    return rounded(search.top_k(one(spark, folder), F.col("query"), 10, metric="angular", id_col="vec_id"))


@query("vec_batch_topk", "VEC-11 JN-04 WIN-05", """
SELECT query_id, vec_id, round(s, 4) AS similarity, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def batch(spark, folder):
    v = catalog.vectors(spark, folder)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(search.batch_top_k(v, q, 10, id_col="vec_id"))


@query("vec_multi_term", "VEC-02 AGG-07 FLT-16", """
SELECT vec_id, round(max(s), 4) AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id IN (3, 7, 11) AND list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.1) WHERE rank <= 50 GROUP BY vec_id""")
def multi_term(spark, folder):
    v, q = against(spark, folder, 3, 7, 11)
    return rounded(search.multi_term(v, q, 50, 0.1, "vec_id"))


@query("vec_hybrid", "VEC-05 VEC-06 VEC-07 VEC-08 AGG-08 SET-03", f"SELECT vec_id, round({COS}, 4) AS similarity FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10")
def hybrid(spark, folder):
    return rounded(search.hybrid(one(spark, folder), F.col("query"), 10, id_col="vec_id"))


@query("vec_candidates_semijoin", "JN-01 JN-02 JN-03 SET-04", f"""
SELECT e.vec_id, d.source, round({COS}, 4) AS similarity FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang = 'en' ORDER BY {COS} DESC, e.vec_id LIMIT 15""")
def candidates(spark, folder):
    docs = catalog.table(spark, folder, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "source")
    hits = search.top_k(one(spark, folder).join(docs.select("vec_id"), "vec_id", "left_semi"), F.col("query"), 15, id_col="vec_id")
    return rounded(hits.join(docs, "vec_id").select("vec_id", "source", "similarity"))


@query("vec_dim_fit", "VEC-14 SC-12 SNK-19", """
SELECT vec_id, round(sqrt(list_inner_product(c, c)), 4) AS cut_norm, round(sqrt(list_inner_product(e, e)), 4) AS full_norm, 96 AS dim FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS c, embedding::DOUBLE[] AS e FROM embeddings)""")
def dim_fit(spark, folder):
    v = catalog.vectors(spark, folder)
    cut, filled = search.fitted(v, 32).select("vec_id", F.round(vec_norm(F.col("embedding")), 4).alias("cut_norm")), search.fitted(v, 96)
    return filled.select("vec_id", F.round(vec_norm(F.col("embedding")), 4).alias("full_norm"), F.size("embedding").alias("dim")).join(cut, "vec_id").select("vec_id", "cut_norm", "full_norm", "dim")


@query("vec_pairwise", "VEC-13 SC-11", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pairwise(spark, folder):
    v = catalog.vectors(spark, folder)
    return rounded(search.pairwise(v, v.select((F.col("vec_id") - 1).alias("vec_id"), "embedding"), "vec_id"))


CENTRES = "c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"


@query("vec_label_centroid", "AGG-14 VEC-09", f"""
WITH {CENTRES}, n AS (SELECT label FROM c ORDER BY list_cosine_similarity(centroid, {Q0}) DESC, label LIMIT 3)
SELECT vec_id, round({COS}, 4) AS similarity FROM embeddings WHERE label IN (SELECT label FROM n) ORDER BY {COS} DESC, vec_id LIMIT 10""")
def label_probe(spark, folder):
    v, q = against(spark, folder, 0)
    q = F.broadcast(q.select("query"))
    near = search.centroids(v).crossJoin(q).select("label", vec_cosine(F.col("centroid"), F.col("query")).alias("s")).orderBy(F.desc("s"), "label").limit(3).select("label")
    return rounded(search.top_k(v.join(F.broadcast(near), "label", "left_semi").crossJoin(q), F.col("query"), 10, id_col="vec_id"))


@query("vec_stats", "AGG-13 AGG-15 VEC-15", "SELECT label, count(*) AS n, sum(len(embedding))::BIGINT AS elements, round(avg(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS energy FROM embeddings GROUP BY label")
def stats(spark, folder):
    v = catalog.vectors(spark, folder)
    return v.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("elements"), F.round(F.avg(F.pow(vec_norm(F.col("embedding")), 2)), 4).alias("energy"))


@query("vec_lookup", "VEC-12", "SELECT vec_id, label, len(embedding)::int AS dim FROM embeddings WHERE vec_id = 17")
def lookup(spark, folder):
    return search.get_vector(catalog.vectors(spark, folder), "doc-17").select("vec_id", "label", F.size("embedding").alias("dim"))


@query("vec_upsert", "SNK-19", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE round(embedding[1]::DOUBLE, 4) END AS head FROM embeddings")
def upsert(spark, folder):
    v = catalog.vectors(spark, folder).select("vec_id", "embedding")
    new = v.where("vec_id % 10 = 0").select("vec_id", F.transform("embedding", lambda x: F.lit(0.0).cast("float")).alias("embedding"))
    return search.upsert_vectors(v, new, 64, "vec_id").select("vec_id", F.round(F.col("embedding")[0], 4).alias("head"))


@query("vec_kmeans", "VEC-10 VEC-09 VEC-06")
def kmeans(spark, folder):
    assigned, centres = search.kmeans(catalog.vectors(spark, folder), 10, id_col="vec_id")
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("n")).join(centres.select("cluster_id", F.size("centroid").alias("dim")), "cluster_id")


@query("vec_ivf_probe", "VEC-06 VEC-09")
def ivf(spark, folder):
    v, q = against(spark, folder, 0)
    assigned, centres = search.kmeans(v, 10, id_col="vec_id")
    wanted = [float(x) for x in q.first()["query"]]
    return rounded(search.probe(assigned, centres, wanted, 10, id_col="vec_id"))


@query("vec_lsh", "VEC-04")
def lsh(spark, folder):
    v, q = against(spark, folder, 0)
    return rounded(search.lsh_neighbours(v, [float(x) for x in q.first()["query"]], 10, id_col="vec_id"))


@query("embed_hashed_text", "EMB-01 EMB-02 EMB-06", """
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS tok FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 4))::INT % 64 AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
m AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM b GROUP BY doc_id)
SELECT doc_id, bucket, round(n / norm, 4) AS weight FROM b JOIN m USING (doc_id)""")
def embed(spark, folder):
    d = catalog.table(spark, folder, "documents").select("doc_id", F.posexplode(embedding.embed_column(F.col("text"))).alias("bucket", "w"))
    return d.where("w > 0").select("doc_id", "bucket", F.round("w", 4).alias("weight"))
