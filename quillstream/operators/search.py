"""Vector search: exact, batched, several terms, hybrid, clustered (IVF) and hashed (LSH)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import as_column, fit_dim, vec_angular_similarity, vec_cosine, vec_dot

SCORES = {"cosine": vec_cosine, "dot": vec_dot, "angular": vec_angular_similarity}
BLOCK_QUERIES = 5_000


def top_k(vectors: DataFrame, query, k: int = 10, threshold: float | None = None, metric: str = "cosine", id_col: str = "object_id") -> DataFrame:
    """(id, similarity) of the k most similar rows, ties by id; threshold inclusive."""
    scored = vectors.select(id_col, SCORES[metric](F.col("embedding"), query).alias("similarity"))
    scored = scored.where(F.col("similarity") >= threshold) if threshold is not None else scored
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None, id_col: str = "object_id") -> DataFrame:
    """(query_id, id, similarity, rank): the k best of every query row (query_id, query).

    Queries are a stated set. They are sent to every task in blocks of about BLOCK_QUERIES; each block meets all vectors, dealt
    to the cluster's cores. Single-precision products of unit vectors, less their rounding error, find which rows can be among
    a task's k best of a query; `vec_cosine`, term by term in double precision, then ranks these. Only the k best are shuffled.
    """
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    parts = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [queries]
    dealt = vectors.select(id_col, "embedding").repartition(vectors.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions(id_col)
    scored = reduce(DataFrame.unionByName, [_block_top_k(dealt, part, k, id_col) for part in parts])
    scored = scored.where(F.col("similarity") >= threshold) if threshold is not None else scored
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _block_top_k(dealt: DataFrame, queries: DataFrame, k: int, id_col: str) -> DataFrame:
    """(query_id, id, similarity): the k best of each query in each partition. Partitions are in the order of ids, so a row's place decides among equals."""
    held = queries.select("query_id", "query").toArrow().combine_chunks()
    names = ["query_id", id_col, "similarity"]
    sent = dealt.sparkSession.sparkContext.broadcast(held)

    def rows_of(column, dim):
        """Rows as doubles; those that are null, hold a null or are of another length are zeros, and have similarity 0 to all. Then unit vectors, which rows' norms may over- or underflow, which are 0, which rows have a similarity."""
        start, values = column.offsets.to_numpy()[:-1].astype(np.int64), column.values
        gaps = np.append(0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False)))
        lens = np.diff(column.offsets.to_numpy())
        fit = column.is_valid().to_numpy(zero_copy_only=False) & (lens == dim) & (gaps[start + lens] == gaps[start])
        out = np.zeros((len(column), dim))
        out[fit] = values.to_numpy(zero_copy_only=False).astype(float)[start[fit][:, None] + np.arange(dim)]
        square = np.einsum("ij,ij->i", out, out)
        odd = ~np.isfinite(square) | ((square > 0) & (square < 1e-200)) | (square > 1e200)
        unit = np.where((odd | (square == 0))[:, None], 0, out / np.sqrt(square)[:, None]).astype(np.float32)
        return out, unit, odd, square == 0, fit

    def norms(rows):
        total = np.zeros(len(rows))
        for d in range(rows.shape[1]):
            total += rows[:, d] * rows[:, d]
        return np.sqrt(total)

    def run(batches):
        np.seterr(all="ignore")  # as in Spark, what overflows is infinite
        table = sent.value
        column = table.column("query").chunk(0) if len(table) else None
        lens = np.diff(column.offsets.to_numpy()) if len(table) else np.empty(0, int)
        groups = []  # queries of a length, and the best of each so far: (query, similarity, place), in that order
        for dim in np.unique(lens):
            at = np.flatnonzero(lens == dim)
            rows, unit, odd, nil, fit = rows_of(column.take(pa.array(at)), int(dim))
            groups.append([int(dim), at, rows, unit, odd, nil, norms(rows), fit, (np.empty(0, int), np.empty(0), np.empty(0, int))])
        ids, seen = [], 0
        for batch in batches:
            if not batch.num_rows or k < 1:
                continue
            ids.append(batch.column(0))
            # a first short stretch sets a bound for the others
            short = 1000 if not seen and batch.num_rows > 1000 else 0
            for part, place in ((batch.column(1)[:short], seen), (batch.column(1)[short:], seen + short)):
                for group in groups if len(part) else ():
                    group[-1] = better(group, part, place)
            seen += batch.num_rows
        ids = pa.concat_arrays(ids) if ids else None
        for _, at, *_, (q, sim, place) in groups:
            for s in range(0, len(q), 100_000):
                i = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([table.column("query_id").chunk(0).take(pa.array(at[q[i]])), ids.take(pa.array(place[i])), pa.array(sim[i])], names)

    def better(group, part, offset):
        dim, at, queries, units, odd_q, nil_q, norm_q, fit_q, best = group
        rows, unit, odd, _, fit = rows_of(part, dim)
        # of equal vectors the first k are enough
        _, same = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * dim))).ravel(), return_inverse=True) if dim else (None, np.zeros(len(rows), int))
        same = 2 * same + fit
        order = np.argsort(same, kind="stable")
        new = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
        nth = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
        kept = np.sort(order[nth < k])
        rows, unit, odd, fit = rows[kept], unit[kept], odd[kept], fit[kept]
        plain = np.flatnonzero(~odd)[:k]
        error = np.float32((dim + 8) * 2.0**-22)
        bound = np.full(len(at), -np.inf)
        full = np.flatnonzero(np.bincount(best[0], minlength=len(at)) == k)
        last = np.append(np.flatnonzero(best[0][1:] != best[0][:-1]), len(best[0]) - 1) if len(best[0]) else best[0]
        bound[full] = best[1][last[np.isin(best[0][last], full)]]
        bound[np.isnan(bound)] = np.inf  # the largest of all
        found = [(np.empty(0, int), np.empty(0, int))]
        for s in range(0, len(at), 256):
            sims = units[s : s + 256] @ unit.T
            least = bound[s : s + 256]
            if len(kept) - odd.sum() >= k and np.isinf(least).any():
                own = np.partition(np.where(odd, -np.inf, sims), -k, axis=1)[:, -k].astype(float) - error
                least = np.maximum(least, own)
            least = np.where(odd_q[s : s + 256], -np.inf, least)
            keep = sims >= np.nextafter((least - error).astype(np.float32), np.float32(-np.inf))[:, None]
            keep[:, odd] = True
            for q in np.flatnonzero(nil_q[s : s + 256]):
                keep[q] = odd
                keep[q, plain] = True
            q, v = np.nonzero(keep)
            found.append((q + s, v))
        q, v = (np.concatenate(x) for x in zip(*found))
        sim, norm = np.zeros(len(q)), norms(rows)
        for s in range(0, len(q), 500_000):
            i = slice(s, s + 500_000)
            dot = np.zeros(len(q[i]))
            for d in range(dim):
                dot += rows[v[i], d] * queries[q[i], d]
            by = np.where(fit[v[i]] & fit_q[q[i]], norm[v[i]] * norm_q[q[i]], 0)
            sim[i] = np.divide(dot, by, out=np.zeros(len(dot)), where=by != 0)
        q, sim, place = (np.concatenate(x) for x in zip(best, (q, sim, kept[v] + offset)))
        order = np.lexsort((place, -np.where(np.isnan(sim), np.inf, sim), q))
        q, sim, place = q[order], sim[order], place[order]
        new = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
        ahead = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q)))) < k
        return q[ahead], sim[ahead], place[ahead]

    kinds = StructType([queries.schema["query_id"], dealt.schema[id_col], StructField("similarity", DoubleType())])
    return dealt.mapInArrow(run, kinds)


def multi_term(vectors: DataFrame, queries: DataFrame, per_term: int = 50, threshold: float = 0.7, id_col: str = "object_id") -> DataFrame:
    """(id, similarity): the best similarity of an id to any term, among each term's best."""
    return batch_top_k(vectors, queries, per_term, threshold, id_col).groupBy(id_col).agg(F.max("similarity").alias("similarity"))


def merge_best(parts: list[DataFrame], id_col: str = "object_id") -> DataFrame:
    """Union of search results, the best similarity of each id."""
    return reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.max("similarity").alias("similarity"))


def hybrid(vectors: DataFrame, query, k: int = 10, threshold: float | None = None, id_col: str = "object_id") -> DataFrame:
    """Both metrics' candidates, each by its cosine."""
    by_dot = top_k(vectors, query, k, None, "dot", id_col).select(id_col).join(vectors, id_col)
    parts = [top_k(vectors, query, k, threshold, "cosine", id_col), top_k(by_dot, query, k, threshold, "cosine", id_col)]
    return merge_best(parts, id_col).orderBy(F.desc("similarity"), id_col).limit(k)


def pairwise(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Cosine of the vectors that two tables have for the same id."""
    return left.select(on, F.col("embedding").alias("a")).join(right.select(on, F.col("embedding").alias("b")), on).select(on, vec_cosine(F.col("a"), F.col("b")).alias("similarity"))


def arrow_top_k(vectors: DataFrame, queries: np.ndarray, k: int = 10, id_col: str = "object_id") -> DataFrame:
    """The same result as batch_top_k by matrix products over Arrow batches; for long vectors and many queries."""
    kind = dict(vectors.dtypes)[id_col]
    unit = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            m = np.array(frame["embedding"].tolist(), float)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            sims = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0) @ unit.T
            for q in range(len(unit)):
                at = np.arange(len(m))
                if k < len(m):  # ties with the last stay: the id decides among them
                    at = np.flatnonzero(sims[:, q] >= np.partition(sims[:, q], -max(k, 1))[-max(k, 1)])
                yield pd.DataFrame({"query_id": q, id_col: frame[id_col].to_numpy()[at], "similarity": sims[at, q]})

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col))
    return vectors.select(id_col, "embedding").mapInPandas(run, f"query_id long, {id_col} {kind}, similarity double").withColumn("rank", rank).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, label: str = "label", dim: int | None = None) -> DataFrame:
    """(label, centroid): the mean vector of each label."""
    parts = vectors.select(label, F.posexplode("embedding").alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("centroid"))


def auto_clusters(n: int) -> int:
    """A tenth of the rows, 50 at most."""
    return max(1, min(n // 10, 50))


def kmeans(vectors: DataFrame, k: int | None = None, seed: int = 42, id_col: str = "object_id") -> tuple[DataFrame, DataFrame]:
    """(assignments, centroids) of a k-means over the vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.select(id_col, "embedding", array_to_vector("embedding").alias("features"))
    k = k or auto_clusters(vectors.count())
    model = KMeans(k=k, seed=seed).fit(ready)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, centroid array<double>")
    return model.transform(ready).select(id_col, "embedding", F.col("prediction").alias("cluster_id")), centres


def with_radius(assigned: DataFrame, centres: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Centres with `radius`, the widest angle between a centre and its rows; null for clusters without rows."""
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), vec_cosine(F.col("embedding"), F.col("centroid")))))
    widest = assigned.join(F.broadcast(centres.select(label, "centroid")), label).groupBy(label).agg(F.max(angle).alias("radius"))
    return centres.join(widest, label, "left")


def probe(assigned: DataFrame, centres: DataFrame, query, k: int = 10, probes: int = 3, id_col: str = "object_id", label: str = "cluster_id") -> DataFrame:
    """Top k of all rows, exact. The `probes` clusters nearest to the query give k first rows; then each cluster that can hold
    a row as similar as the last of them is read: angles obey the triangle inequality, so no row of a cluster is nearer
    to the query than its centre is, less its radius. There are far fewer clusters than rows; a column `radius` in `centres` saves a pass."""
    centres = centres if "radius" in centres.columns else with_radius(assigned, centres, label)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), vec_cosine(F.col("centroid"), query)))
    held = centres.where("radius IS NOT NULL").select(label, cosine.alias("s"), F.cos(F.greatest(F.lit(0.0), F.acos(cosine) - F.col("radius"))).alias("most")).orderBy(F.desc("s"), label).collect()
    first = top_k(assigned.where(F.col(label).isin([r[label] for r in held[:probes]])), query, k, id_col=id_col).collect()
    least = first[-1]["similarity"] if len(first) == k and k else None
    wanted = [r[label] for i, r in enumerate(held) if i < probes or least is None or r["most"] is None or r["most"] >= least - 1e-6]
    return top_k(assigned.where(F.col(label).isin(wanted)), query, k, id_col=id_col)


def lsh_neighbours(vectors: DataFrame, query, k: int = 10, bucket: float = 0.8, tables: int = 12, seed: int = 42, id_col: str = "object_id") -> DataFrame:
    """Approximate nearest rows by random projections of unit vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    ready = vectors.select(id_col, array_to_vector("embedding").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(ready)
    found = model.approxNearestNeighbors(ready, Vectors.dense(list(map(float, query))), k, distCol="distance")
    return found.select(id_col, (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("similarity"))


def fitted(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors cut or filled to a dimension."""
    return vectors.withColumn("embedding", fit_dim(F.col("embedding"), dim))


def upsert_vectors(old: DataFrame, new: DataFrame, dim: int, id_col: str = "object_id") -> DataFrame:
    """Old rows without those replaced, and the new ones, all of one dimension."""
    return fitted(old.join(new, id_col, "left_anti").unionByName(new), dim)


def get_vector(vectors: DataFrame, object_id: str) -> DataFrame:
    return vectors.where(F.col("object_id") == object_id)


__all__ = ["as_column", "arrow_top_k", "auto_clusters", "batch_top_k", "centroids", "fitted", "get_vector", "hybrid", "kmeans", "lsh_neighbours", "merge_best", "multi_term", "pairwise", "probe", "top_k", "upsert_vectors", "with_radius"]
