"""Scenarios over the façade and properties of single operators."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.engine import Engine
from quillstream.operators import embedding, events, graph, predicates, search, storage


@pytest.fixture
def engine(spark, tmp_path):
    with Engine(spark, str(tmp_path)) as e:
        yield e


def test_insert_update_delete(engine):
    a, b = engine.insert_many([{"type": "text", "data": "hello world, long enough", "metadata": {"version": 1, "k": "v"}, "tags": ["x"]}, {"type": "iot", "data": {"t": 1.5}, "metadata": {"sensor": "s"}, "tags": []}])
    assert engine.get(a)["text"] == "hello world, long enough" and engine.get(b)["data"] == {"t": 1.5}
    before = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    assert engine.update(a, {"type": "text", "data": "hello world, long enough!", "metadata": {"version": 2}, "tags": ["y"]})
    got = engine.get(a)
    assert got["metadata"] == {"version": "2", "k": "v"} and got["tags"] == ["x", "y"] and got["version"] == 2
    assert engine.get(a, before)["metadata"]["version"] == "1"
    assert engine.update(a, {"type": "text", "data": "short", "metadata": {"n": 1}})
    assert engine.get(a)["metadata"] == {"n": "1"} and engine.get(a)["tags"] == []
    assert engine.delete(a) and engine.get(a) is None
    assert engine.delete("unknown") and engine.get("unknown") is None and not engine.update("unknown", {})


def test_queries_statistics_backup(engine, tmp_path):
    ids = engine.insert_many([{"type": "text", "data": f"批量测试数据 {i}", "metadata": {"batch": i}, "tags": ["batch"]} for i in range(10)] + [{"type": "odd", "data": None}])
    assert len(ids) == 11
    assert engine.query("找出批量测试数据").count() == 10
    assert engine.query("包含nothing的文本").count() == 0
    assert engine.query({"type": "natural_language", "data_types": ["text"], "limit": 3}).count() == 3
    assert engine.query("SELECT object_id FROM multimodal_data WHERE CAPTION_CONTAINS(\"数据 3\")").collect()[0][0] == ids[3]
    stats = engine.statistics()
    assert stats["total_objects"] == 11 and stats["objects_by_type"] == {"text": 10, "odd": 1} and stats["events_by_type"] == {"INSERT": 11}
    assert engine.backup(str(tmp_path / "b")) and engine.delete(ids[0])
    engine.compact()
    assert engine.statistics()["total_objects"] == 10
    assert engine.restore(str(tmp_path / "b")) and engine.statistics()["total_objects"] == 11
    assert engine.health()["status"] == "healthy"


def test_chunks_and_merkle(spark):
    texts = ["", "a" * 10, "b" * 11, "é" * 23, "c" * 50, None]
    df = spark.createDataFrame(list(enumerate(texts)), "object_id int, text string")
    pieces = storage.chunks(df, 10)
    back = {r[0]: bytes(r[1]).decode() for r in storage.reassemble(pieces).collect()}
    assert back == {i: t for i, t in enumerate(texts) if t is not None}

    def root(text):
        data = text.encode()
        level = [hashlib.sha256(data[i : i + 10]).hexdigest() for i in range(0, max(len(data), 1), 10)]
        while len(level) > 1:
            level = [hashlib.sha256("".join(level[i : i + 2]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    assert {r[0]: r[2] for r in storage.merkle_roots(pieces).collect()} == {i: root(t) for i, t in enumerate(texts) if t is not None}


def test_rewrite_rule_is_strict(spark):
    got = spark.range(1).select(storage.needs_rewrite(F.lit("a"), F.lit("a"), F.lit(12), F.lit(18)), storage.needs_rewrite(F.lit("a"), F.lit("a"), F.lit(12), F.lit(19)), storage.needs_rewrite(F.lit("a"), F.lit("b"), F.lit(1), F.lit(1))).first()
    assert tuple(got) == (False, True, True)


def log_of(spark, rows):
    return spark.createDataFrame([(i, o, k, dt.datetime(2024, 1, 1, 0, m), d, i) for i, (o, k, m, d) in enumerate(rows)], "event_id long, object_id string, event_type string, ts timestamp, data map<string,string>, sequence_number long")


def test_fold_edges(spark):
    log = log_of(spark, [("a", "INSERT", 0, {"x": "1"}), ("a", "PATCH", 1, {"y": "2"}), ("a", "DELETE", 2, None), ("a", "INSERT", 2, {"z": "3"}), ("b", "INSERT", 0, {"x": "1"}), ("b", "OTHER", 1, {"q": "9"}), ("c", "INSERT", 3, {"x": "1"}), ("c", "DELETE", 3, None)])
    at = lambda m: {r["object_id"]: (r["state"], r["version"]) for r in events.state_at(log, f"2024-01-01 00:0{m}:00").collect()}
    assert at(1) == {"a": ({"x": "1", "y": "2"}, 2), "b": ({"x": "1"}, 2)}
    assert at(3) == {"a": ({"z": "3"}, 4), "b": ({"x": "1"}, 2)}
    for every in (1, 2, 3):
        snaps = events.snapshots(log, every)
        got = {r["object_id"]: r["state"] for r in events.state_from_snapshots(log, snaps, "2024-01-01 00:03:00").collect()}
        assert got == {k: v[0] for k, v in at(3).items()}
    assert events.state_at(log, "2023-01-01").count() == 0


def test_traversal_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("c", "d"), ("a", "c")], "src string, dst string")
    got = lambda **k: sorted((r["src"], r["dst"], r["depth"]) for r in graph.traverse(e, "a", **k).collect())
    assert got(max_depth=0) == []
    assert got(max_depth=1) == [("a", "a", 0), ("a", "b", 0), ("a", "c", 0)]
    assert got(max_depth=9) == [("a", "a", 0), ("a", "b", 0), ("a", "c", 0), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1)]
    assert got(max_depth=1, legacy_depth=True) == got(max_depth=2)
    nodes = spark.createDataFrame([(x, "t") for x in "abcdez"], "object_id string, type string")
    assert {r[0]: r[1] for r in graph.components(e, nodes).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "z": "z"}


def test_search_edges(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [2.0, 0.0]), ("d", [0.0, 1.0])], "object_id string, embedding array<double>")
    assert [(r[0], r[1]) for r in search.top_k(v, [1.0, 0.0], 3).collect()] == [("a", 1.0), ("c", 1.0), ("b", 0.0)]
    assert [r[0] for r in search.top_k(v, [1.0, 0.0], 3, 1.0).collect()] == ["a", "c"]
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "query_id int, query array<double>")
    want = sorted((r["query_id"], r["object_id"], round(r["similarity"], 9)) for r in search.batch_top_k(v, q, 2).collect())
    import numpy as np

    assert sorted((r["query_id"], r["object_id"], round(r["similarity"], 9)) for r in search.arrow_top_k(v, np.array([[1.0, 0.0], [1.0, 1.0]]), 2).collect()) == want
    assert search.multi_term(v, q, 2, 0.5).where("object_id = 'a'").first()["similarity"] == 1.0
    assert search.fitted(v, 3).first()["embedding"] == [1.0, 0.0, 0.0]


def test_batch_search_equals_all_pairs_and_joins_none(spark, monkeypatch):
    """Copies, ties, nulls, other lengths, zeros, NaN, very large and small elements, repeated and null ids; in one block of queries and in several."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quillstream.functions.columns import vec_cosine

    r = random.Random(5)
    vectors = [[r.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(4)] for _ in range(150)] + [[1.0, 2.0, 3.0, 4.0]] * 60 + [[r.gauss(0, 1) for _ in range(4)] for _ in range(1200)]
    vectors += [None, [], [1.0], [1.0, None, 2.0, 3.0], [0.0] * 4, [-0.0] * 4, [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1e200, 1.0, 1.0, 1.0], [1e-170] * 4, [1e-120, 1e-121, 0.0, 0.0], [1.0, 2.0, 3.0]]
    ids = list(range(len(vectors)))
    r.shuffle(ids)
    rows = [(None if i == 7 else f"é{i}" if i % 9 == 0 else f"v{i}", v) for i, v in zip(ids, vectors)]
    v = spark.createDataFrame(rows, "object_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i if i != 3 else None, x) for i, x in enumerate([*vectors[:20], *vectors[145:160], *vectors[-13:]])], "query_id int, query array<double>")
    scored = F.broadcast(q).crossJoin(v).select("query_id", "object_id", vec_cosine(F.col("embedding"), F.col("query")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "object_id"))
    want = scored.withColumn("rank", rank).cache()
    text = lambda df: sorted(map(str, df.collect()))
    for block, k, threshold in ((5_000, 1, None), (5_000, 10, 0.9), (20, 10, None), (20, 2000, 0.0)):
        monkeypatch.setattr(search, "BLOCK_QUERIES", block)
        found = search.batch_top_k(v, q, k, threshold)
        assert text(found) == text(want.where(F.col("rank") <= k) if threshold is None else want.where((F.col("rank") <= k) & (F.col("similarity") >= threshold)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert search.batch_top_k(v, q, 0).count() == search.batch_top_k(v.limit(0), q).count() == search.batch_top_k(v, q.limit(0)).count() == 0


def test_embedding_is_the_same_on_both_sides(spark):
    df = spark.createDataFrame([("1", "text", "The the cat"), ("2", "text", ""), ("3", "text", None)], "object_id string, type string, text string").withColumn("metadata", F.create_map().cast("map<string,string>"))
    got = {r[0]: list(r[1]) for r in embedding.embed_objects(df).collect()}
    assert got["1"] == pytest.approx(embedding.embed_text("The the cat")) and set(got["2"]) == set(got["3"]) == {0.0}


def test_predicates_are_three_valued(spark):
    df = spark.createDataFrame([(1, {"a": "5"}), (2, {"a": "x"}), (3, {"b": "1"}), (4, {"a": "0"}), (5, {"a": ""})], "id int, metadata map<string,string>")
    ids = lambda *c: [r[0] for r in predicates.all_of(df, c).orderBy("id").collect()]
    assert ids(("a", ">", 1)) == [1] and ids(("a", "<=", 0)) == [4] and ids(("a", "!=", "5")) == [2, 4, 5]
    assert ids(("a", "in", ["5", "x"])) == [1, 2] and ids(("a", "is null", None)) == [3] and ids(("a", "between", (0, 5))) == [1, 4]
    assert ids(("a", "like", "%x")) == [2] and ids(("id", ">=", 4), ("a", "contains", "")) == [4, 5]


@pytest.mark.parametrize("spread", [0.2, 1.0])
def test_ivf_probe_finds_all_neighbours(spark, spread):
    """Recall against brute force, with tight clusters and with none; a zero vector and an empty index too."""
    r = np.random.default_rng(4)
    m = r.normal(size=(20, 16))[r.integers(0, 20, 600)] * (1 - spread) + r.normal(size=(600, 16)) * spread
    m[7] = 0
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "object_id long, embedding array<double>").cache()
    assigned, centres = search.kmeans(v, 40)
    assigned, centres = assigned.cache(), search.with_radius(assigned, centres).cache()
    for q in (0, 20, 40, 60, 80):
        query = [float(x) for x in m[q]]
        want = [x["object_id"] for x in search.top_k(v, query, 10).collect()]
        assert [x["object_id"] for x in search.probe(assigned, centres, query, 10).collect()] == want
    assert search.probe(assigned.limit(0), centres, query, 10).count() == 0


def test_global_numbers_whatever_the_partitions(spark, tmp_path):
    """Six files, coalescing on and off, many events of one second, blocks of few and of many numbers."""
    from pyspark.sql import Window

    log = spark.range(5000).selectExpr("id AS event_id", "id AS sequence_number", "CASE WHEN id % 3 = 0 THEN timestamp'2024-01-05 00:00:01' ELSE timestamp'2024-01-01' + make_interval(0, 0, 0, id % 9, 0, 0, pmod(xxhash64(id), 5000000) / 1000) END AS ts")
    log.unionByName(spark.sql("SELECT 9999L AS event_id, 9999L AS sequence_number, CAST(NULL AS TIMESTAMP) AS ts")).repartition(6).write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    want = {(r[0], r[1]) for r in log.select("event_id", F.row_number().over(Window.orderBy("ts", "sequence_number"))).collect()}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for coalesce in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            for numbers in (7, events.NUMBERS):
                got = events.renumber(log, numbers)
                assert got.columns == ["event_id", "sequence_number", "ts", "global_number"]
                assert {(r["event_id"], r["global_number"]) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert events.renumber(log.limit(0)).count() == 0
