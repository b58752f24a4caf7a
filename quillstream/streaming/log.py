"""The event log as a stream: sources, sinks, views per micro-batch, windows, versions per key."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir

RAW = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def stream_log(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """An append-only folder of log files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table's file(s) as a stream; times without zone become instants, as watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "false").parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in found.columns else found


def append_log(stream: DataFrame, path: str, checkpoint: str, kind: str = "json") -> StreamingQuery:
    return stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def materialize(stream: DataFrame, views: dict[str, Callable[[DataFrame], DataFrame]], root: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch into several derived tables; a batch is overwritten as a whole if it is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, view in views.items():
            view(batch).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, size: str, *by: str, late: str | None = None) -> DataFrame:
    held = events.withWatermark("ts", late) if late else events
    return held.groupBy(F.window("ts", size), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str, step: str, *by: str, late: str | None = None) -> DataFrame:
    held = events.withWatermark("ts", late) if late else events
    return held.groupBy(F.window("ts", size, step), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, key: str, late: str | None = None) -> DataFrame:
    held = events.withWatermark("ts", late) if late else events
    return held.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Streams: within the watermark. Batches: all rows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def interval_join(left: DataFrame, right: DataFrame, on: Column, within: str, late: str) -> DataFrame:
    """Pairs whose times (ts, ts2) are at most `within` apart, the right one not earlier; both sides need watermarks as streams."""
    a, b = left.withWatermark("ts", late), right.withWatermark("ts2", late)
    return a.join(b, on & (F.col("ts2") >= F.col("ts")) & (F.col("ts2") <= F.col("ts") + F.expr(f"INTERVAL {within}")))


def versioned(events: DataFrame, key: str = "object_id", every: int = 100) -> DataFrame:
    """(key, event_id, version, snapshot): a counter kept per key; snapshot marks every `every`-th version.

    Keys are single writers, so versions have no gaps and no repeats.
    """
    kind = dict(events.dtypes)[key]

    def count(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        held = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        versions = range(n + 1, n + 1 + len(held))
        state.update((n + len(held),))
        yield pd.DataFrame({key: held[key].to_numpy(), "event_id": held["event_id"].to_numpy(), "version": list(versions), "snapshot": [v % every == 0 for v in versions]})

    return events.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(count, f"{key} {kind}, event_id long, version long, snapshot boolean", "n long", "append", "NoTimeout")


def run_now(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """All that is there now, through an in-memory table; for results that fit the driver, as aggregates do."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_folder(stream: DataFrame) -> DataFrame:
    """All that is there now, through a Parquet folder in the shared one; for results of any size."""
    root = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def triggers(stream: DataFrame, rules: dict[str, Callable[[DataFrame], DataFrame]], act: Callable[[str, DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Calls act(name, rows) for each rule that has rows in a micro-batch."""

    def check(batch: DataFrame, _: int) -> None:
        for name, rule in rules.items():
            rows = rule(batch)
            if rows.limit(1).count():
                act(name, rows)

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_json(props: dict) -> str:
    return json.dumps(props, ensure_ascii=False, sort_keys=True)
