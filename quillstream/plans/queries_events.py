"""Event sourcing, time travel and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import events as es
from ..session import prepare
from ..sources import catalog
from ..streaming import log as st
from .registry import query

KIND = "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'click' THEN 'UPDATE' WHEN 'purchase' THEN 'UPDATE' WHEN 'view' THEN 'PATCH' WHEN 'error' THEN 'DELETE' END"
LOG = f"l AS (SELECT event_id, 'user-' || user_id AS object_id, {KIND} AS kind, ts, json_extract_string(props, '$.k') AS k, event_type FROM events)"
AT = "2024-01-20 00:00:00"
#: Last value of each key after the last DELETE, as of a time.
FOLD = """a AS (SELECT * FROM l WHERE ts <= TIMESTAMP '{at}'),
w AS (SELECT object_id, count(*) AS version, max(event_id) FILTER (WHERE kind = 'DELETE') AS gone FROM a GROUP BY object_id),
kv AS (SELECT object_id, event_id, unnest(['k', 'last_' || event_type]) AS key, unnest([k, event_id::VARCHAR]) AS val FROM a WHERE kind <> 'DELETE'),
s AS (SELECT object_id, key, arg_max(val, event_id) AS val FROM kv JOIN w USING (object_id) WHERE gone IS NULL OR event_id > gone GROUP BY object_id, key)"""


def rows_of(state):
    """(object_id, key, val, version) of each entry."""
    return state.select("object_id", "version", F.explode("state").alias("key", "val"))


@query("event_filter", "SRC-06 SRC-07 FLT-21 LIM-06 ES-01", "SELECT event_id, object_id FROM (SELECT event_id, 'user-' || user_id AS object_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND event_type = 'view' AND user_id = 8 ORDER BY ts, event_id LIMIT 20)")
def event_filter(spark, folder):
    return es.select_events(catalog.event_log(spark, folder), "2024-01-05", "2024-01-25", "PATCH", "user-8", 20).select("event_id", "object_id")


@query("event_version", "WIN-01 WIN-02 ES-07 SNK-11", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def event_version(spark, folder):
    return es.with_versions(catalog.event_log(spark, folder)).select("event_id", "version")


@query("event_global_number", "WIN-02 SRT-05", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS global_number FROM events")
def event_number(spark, folder):
    return es.renumber(catalog.event_log(spark, folder).select("event_id", "ts", "sequence_number")).select("event_id", "global_number")


@query("event_stats", "AGG-01 AGG-02 AGG-15", f"WITH {LOG} SELECT 'total' AS kind, '' AS key, count(*) AS n FROM l UNION ALL SELECT 'type', kind, count(*) FROM l GROUP BY kind UNION ALL SELECT 'object', object_id, count(*) FROM l GROUP BY object_id")
def event_stats(spark, folder):
    return es.event_statistics(catalog.event_log(spark, folder))


@query("event_state_as_of", "ES-02 ES-04 ES-05 AGG-10 UD-04", f"WITH {LOG}, {FOLD.format(at=AT)} SELECT object_id, key, val, version FROM s JOIN w USING (object_id)")
def state_as_of(spark, folder):
    prepare(spark)
    return rows_of(es.state_at(catalog.event_log(spark, folder), AT))


@query("event_time_travel", "ES-05 UD-05", f"WITH {LOG}, {FOLD.format(at=AT)} SELECT object_id, key, val, version FROM s JOIN w USING (object_id) WHERE object_id = 'user-12'")
def travel(spark, folder):
    prepare(spark)
    return rows_of(es.time_travel(catalog.event_log(spark, folder), "user-12", AT))


@query("event_snapshot_replay", "ES-03 ES-08 SNK-12 WIN-03", f"WITH {LOG}, {FOLD.format(at=AT)} SELECT object_id, key, val, version FROM s JOIN w USING (object_id)")
def snapshot_replay(spark, folder):
    prepare(spark)
    log = catalog.event_log(spark, folder)
    return rows_of(es.state_from_snapshots(log, es.snapshots(log, 10), AT))


@query("event_snapshots", "SNK-12 WIN-03", """
SELECT object_id, version, event_id FROM (SELECT 'user-' || user_id AS object_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events) WHERE version % 10 = 0""")
def snapshot_rows(spark, folder):
    prepare(spark)
    return es.snapshots(catalog.event_log(spark, folder), 10).select("object_id", "version", F.col("sequence_number").alias("event_id"))


@query("event_latest", "WIN-04 ES-06", f"WITH {LOG} SELECT object_id, arg_max(event_id, event_id) AS event_id, arg_max(kind, event_id) AS event_type, count(*) AS version FROM l GROUP BY object_id")
def event_latest(spark, folder):
    return es.latest(catalog.event_log(spark, folder))


@query("event_version_at", "ES-06", f"SELECT 'user-' || user_id AS object_id, count(*) AS version FROM events WHERE ts <= TIMESTAMP '{AT}' GROUP BY user_id")
def version_at(spark, folder):
    return es.version_at(catalog.event_log(spark, folder), AT)


@query("event_snapshot_asof", "JN-05 ES-08 WIN-06", """
SELECT e.event_id, s.event_id AS snapshot_event FROM events e ASOF JOIN (SELECT * FROM events WHERE event_id % 100 = 0) s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def snapshot_asof(spark, folder):
    log = catalog.event_log(spark, folder).select("event_id", "object_id", "ts")
    marks = log.where("event_id % 100 = 0").select("object_id", "ts", F.col("event_id").alias("value"))
    return es.as_of(log, marks, "object_id").where("value_as_of IS NOT NULL").select("event_id", F.col("value_as_of").alias("snapshot_event"))


@query("event_conflicts", "ES-09", "SELECT 'user-' || user_id AS object_id, count(*) AS version FROM events GROUP BY user_id HAVING count(*) <> 50")
def conflicts(spark, folder):
    log = catalog.event_log(spark, folder)
    writes = log.select("object_id").distinct().withColumn("expected_version", F.lit(50))
    return es.expected_version_conflicts(log, writes).select("object_id", "version")


@query("event_restore_deleted", "ES-10 SNK-03", """
SELECT object_id, kind AS last_kind FROM (SELECT 'user-' || user_id AS object_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND kind = 'error'""")
def deleted(spark, folder):
    last = es.latest(catalog.event_log(spark, folder)).where("event_type = 'DELETE'").select("object_id", F.lit("error").alias("last_kind"))
    return last


@query("event_compact", "SNK-13 SNK-10 SRC-05", "SELECT event_id, event_type AS kind FROM events")
def compacted(spark, folder):
    log = catalog.table(spark, folder, "events").select("event_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("sequence_number"))
    return es.compact(log, 2).select("event_id", "kind")


@query("event_tumbling", "ST-06", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling(spark, folder):
    e = catalog.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.tumbling(e, "1 day", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("event_sliding", "ST-06", """
SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS start FROM events) GROUP BY start""")
def sliding(spark, folder):
    e = catalog.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.sliding(e, "12 hours", "6 hours").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("event_session", "ST-06", """
SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
  SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, g""")
def sessions(spark, folder):
    e = catalog.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.sessions(e, "30 minutes", "user_id").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("event_stream_counts", "ST-01 ST-02 ST-06", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, folder):
    counted = st.stream_table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return st.run_now(counted, f"stream_counts_{uuid.uuid4().hex}", "complete")


@query("event_stream_windows", "ST-06", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, folder):
    counted = st.tumbling(st.stream_table(spark, folder, "events"), "1 day", late="10 minutes").select("window", "n")
    return st.run_now(counted, f"stream_windows_{uuid.uuid4().hex}", "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("event_stream_dedup", "ST-06", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup(spark, folder):
    s = st.stream_table(spark, folder, "events").select("event_id", "ts")
    twice = st.deduplicated(s.union(s), ["event_id"], "1 hour").groupBy().agg(F.count("*").alias("n"))
    return st.run_now(twice, f"stream_dedup_{uuid.uuid4().hex}", "complete")


@query("event_stream_versions", "ST-03 ST-05 ES-07", "SELECT event_id, version, version % 100 = 0 AS snapshot FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)")
def stream_versions(spark, folder):
    s = st.stream_table(spark, folder, "events").withColumn("object_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return st.run_to_folder(st.versioned(s)).select("event_id", "version", "snapshot")


@query("event_stream_views", "ST-04 LLM-04 SNK-01", "SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id")
def stream_views(spark, folder):
    from ..session import shared_dir

    root = f"{shared_dir(spark)}/views-{uuid.uuid4().hex}"
    views = {"per_user": lambda b: b.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))}
    st.materialize(st.stream_table(spark, folder, "events"), views, root, f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/per_user").groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event"))


@query("event_running_windows", "WIN-06 WIN-07", """
SELECT event_id, lag(event_type) OVER w AS before, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 2) AS last5 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return catalog.table(spark, folder, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.round(F.sum("value").over(w.rowsBetween(-4, 0)), 2).alias("last5"))


@query("event_interval_join", "ST-06 JN-09", """
SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL '6 hours'""")
def interval_join(spark, folder):
    e = lambda kind: st.stream_table(spark, folder, "events").where(F.col("event_type") == kind)
    left = e("signup").select("ts", F.col("user_id").alias("u"), F.col("event_id").alias("first_id"))
    right = e("purchase").select(F.col("ts").alias("ts2"), "user_id", F.col("event_id").alias("second_id"))
    pairs = st.interval_join(left, right, F.col("u") == F.col("user_id"), "6 hours", "40 days").select("first_id", "second_id")
    return st.run_to_folder(pairs)


@query("event_triggers", "LLM-04 ST-04", "SELECT 'errors' AS rule, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'dear', event_id FROM events WHERE value > 100")
def fired(spark, folder):
    from ..session import shared_dir

    root = f"{shared_dir(spark)}/triggers-{uuid.uuid4().hex}"
    rules = {"errors": lambda b: b.where("event_type = 'error'"), "dear": lambda b: b.where("value > 100"), "never": lambda b: b.where("event_id < 0")}
    act = lambda name, rows: rows.select(F.lit(name).alias("rule"), "event_id").write.mode("append").parquet(f"{root}/out")
    st.triggers(st.stream_table(spark, folder, "events"), rules, act, f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("rule string, event_id bigint").parquet(f"{root}/out")


def nations(spark, folder):
    """What a caller hands to the facade: 25 objects."""
    rows = catalog.table(spark, folder, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    return [{"type": "text", "data": r["n_name"], "metadata": {"key": str(r["n_nationkey"])}, "tags": ["nation"]} for r in rows]


def facade(spark):
    from ..engine import Engine
    from ..session import shared_dir

    return Engine(spark, f"{shared_dir(spark)}/facade-{uuid.uuid4().hex}")


@query("facade_objects", "SNK-01 SNK-02 SNK-03 API-02 API-08", """
SELECT n_nationkey AS key, n_name || CASE WHEN n_nationkey % 5 = 3 THEN '!' ELSE '' END AS text, CASE WHEN n_nationkey % 5 = 3 THEN 2 ELSE 1 END AS version, CASE WHEN n_nationkey % 5 = 3 THEN 'nation,changed' ELSE 'nation' END AS tags,
CASE WHEN n_nationkey % 5 = 3 THEN 'x' END AS note FROM nation WHERE n_nationkey % 5 <> 4""")
def facade_objects(spark, folder):
    with facade(spark) as e:
        given = nations(spark, folder)
        for i, key in enumerate(e.insert_many(given)):
            if i % 5 == 3:
                e.update(key, {"type": "text", "data": given[i]["data"] + "!", "metadata": {"note": "x"}, "tags": ["changed"]})
            elif i % 5 == 4:
                e.delete(key)
        return e.current().select(F.col("metadata")["key"].cast("long").alias("key"), "text", "version", F.array_join("tags", ",").alias("tags"), F.col("metadata")["note"].alias("note"))


@query("facade_compact_restore", "SNK-13 SNK-16 API-05 SNK-10", """
SELECT 'compacted' AS stage, 'INSERT' AS event_type, count(*) AS n FROM nation UNION ALL SELECT 'compacted', 'DELETE', count(*) FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'restored', 'INSERT', count(*) FROM nation""")
def facade_compact_restore(spark, folder):
    with facade(spark) as e:
        made = e.insert_many(nations(spark, folder))
        e.backup(f"{e.path}-backup")
        for key in made[:3]:
            e.delete(key)
        count = lambda stage: [(stage, r["event_type"], r["count"]) for r in e.events().groupBy("event_type").count().collect()]
        e.compact(2)
        rows = count("compacted")
        e.restore(f"{e.path}-backup")
        return spark.createDataFrame(rows + count("restored"), "stage string, event_type string, n long")


@query("facade_query", "API-03 API-07 LIM-04 UD-02", "SELECT n_name AS text FROM nation WHERE contains(n_name, 'AN')")
def facade_query(spark, folder):
    with facade(spark) as e:
        e.insert_many(nations(spark, folder))
        return e.query("SELECT text FROM multimodal_data WHERE CAPTION_CONTAINS(\"AN\")").select("text")


@query("event_undelete", "ES-10 SNK-03 ES-02", """
WITH e AS (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS gone, max(event_id) OVER (PARTITION BY user_id) AS top FROM events),
d AS (SELECT * FROM e WHERE gone = top), b AS (SELECT user_id, max(CASE WHEN event_type = 'error' AND event_id < gone THEN event_id END) AS wiped FROM d GROUP BY user_id)
SELECT 'user-' || user_id AS object_id, arg_max(json_extract_string(props, '$.k'), event_id) AS k FROM d JOIN b USING (user_id) WHERE event_id < gone AND (wiped IS NULL OR event_id > wiped) GROUP BY user_id""")
def undelete(spark, folder):
    """Objects that are deleted now, as they were before their last DELETE."""
    log = catalog.event_log(spark, folder)
    gone = es.latest(log).where("event_type = 'DELETE'").select("object_id", F.col("event_id").alias("gone"))
    return es.fold(log.join(gone, "object_id").where("sequence_number < gone").drop("gone")).where(F.size("state") > 0).select("object_id", F.col("state")["k"].alias("k"))
