"""The metadata graph: upserts, look-ups, bounded traversal, components, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata merged, the new winning; tags united; other columns from the new where given."""
    o, n = old.alias("o"), new.alias("n")
    empty = F.create_map().cast("map<string,string>")
    rest = [c for c in old.columns if c not in ("object_id", "metadata", "tags")]
    return o.join(n, F.col("o.object_id") == F.col("n.object_id"), "full").select(
        F.coalesce("n.object_id", "o.object_id").alias("object_id"), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest],
        F.map_from_entries(F.concat(F.filter(F.map_entries(F.coalesce("o.metadata", empty)), lambda e: ~F.array_contains(F.map_keys(F.coalesce("n.metadata", empty)), e["key"])), F.map_entries(F.coalesce("n.metadata", empty)))).alias("metadata"),
        F.array_union(F.coalesce("o.tags", F.array().cast("array<string>")), F.coalesce("n.tags", F.array().cast("array<string>"))).alias("tags"),
    )


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of `gone` (object_id)."""
    left = edges.join(gone.select(F.col("object_id").alias("src")), "src", "left_anti").join(gone.select(F.col("object_id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "object_id", "left_anti"), left.select(*edges.columns)


def upsert_edges(edges: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """One edge, the latest by `order`, for each pair; only between nodes that exist."""
    ids = nodes.select("object_id")
    held = edges.join(ids, F.col("src") == F.col("object_id"), "left_semi").join(ids, F.col("dst") == F.col("object_id"), "left_semi")
    rest = [c for c in held.columns if c not in ("src", "dst")]
    return held.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), order).alias("e")).select("src", "dst", *[F.col(f"e.{c}").alias(c) for c in rest])


def by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.where(F.array_contains("tags", tag))


def by_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind)


def by_time(nodes: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Inclusive at both ends."""
    return nodes.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def tag_index(nodes: DataFrame) -> DataFrame:
    """(tag, n) over all nodes."""
    return nodes.select("object_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count_distinct("object_id").alias("n"))


def traverse(edges: DataFrame, start: str, max_depth: int = 2, legacy_depth: bool = False) -> DataFrame:
    """(src, dst, depth): the out-edges of all nodes within max_depth - 1 hops, breadth first.

    The frontier is joined to the edges once per hop, and nodes seen before are dropped, so cycles end. Each hop's
    edges and new nodes are tables in the shared folder, so no hop is worked out twice.
    legacy_depth expands one hop further.
    """
    import uuid

    spark = edges.sparkSession
    root = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    hops = max_depth + 1 if legacy_depth else max_depth
    seen = spark.createDataFrame([(start, 0)], "node string, depth int")
    frontier, found = seen, None
    for depth in range(hops):
        out = edges.join(F.broadcast(frontier) if depth == 0 else frontier, F.col("src") == F.col("node"), "inner").select(*edges.columns, F.lit(depth).alias("depth"))
        out = saved(out, f"edges-{depth}")
        found = out if found is None else found.unionByName(out)
        if depth + 1 == hops:
            break
        fresh = saved(out.select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth + 1)), f"nodes-{depth}")
        seen, frontier = seen.unionByName(fresh), fresh
    return found if found is not None else edges.withColumn("depth", F.lit(0)).limit(0)


def traverse_sql(start: str, max_depth: int) -> str:
    """The same as one recursive query over the view `edges`, for graphs without heavy cycles."""
    return f"""WITH RECURSIVE walk(node, depth) AS (
  SELECT '{start}', 0 UNION ALL SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < {max_depth})
SELECT node, min(depth) AS depth FROM walk GROUP BY node"""


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(object_id, component): the smallest id that is weakly connected. Rounds are written to the shared folder."""
    import uuid

    spark, root = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/graph-{uuid.uuid4().hex}"

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    both = saved(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).where("u <> v").distinct(), "links")
    labels = saved(nodes.select("object_id", F.col("object_id").alias("component")), "0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both.v == labels.object_id).groupBy("u").agg(F.min("component").alias("best"))
        moved = labels.join(near, labels.object_id == near.u, "left").select("object_id", F.col("component").alias("old"), F.least("component", "best").alias("mid"))
        jump = labels.select(F.col("object_id").alias("at"), F.col("component").alias("there"))
        new = moved.join(jump, moved.mid == jump["at"], "left").select("object_id", "old", F.least("mid", F.coalesce("there", "mid")).alias("component"))
        new = saved(new, str(step))
        labels = new.select("object_id", "component")
        if not new.where("old <> component").limit(1).count():
            return labels


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, types, density m / (n (n - 1)), components."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("type").alias("types"))
    m = edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    c = components(edges, nodes).agg(F.count_distinct("component").alias("components"))
    return n.crossJoin(m).crossJoin(c).withColumn("density", F.coalesce(F.try_divide(F.col("edges").cast("double"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0))).withColumn("connected", F.col("components") == 1)


def last_write_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")
