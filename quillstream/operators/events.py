"""Event sourcing over an event log: versions, replay, time travel, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAP = "map<string,string>"
ORDER = ("ts", "sequence_number")


def select_events(log: DataFrame, start=None, end=None, event_type: str | None = None, object_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Events within inclusive bounds, of a type, of an object; the first `limit` by time."""
    for held in ([F.col("ts") >= F.lit(start).cast("timestamp")] if start else []) + ([F.col("ts") <= F.lit(end).cast("timestamp")] if end else []):
        log = log.where(held)
    log = log.where(F.col("event_type") == event_type) if event_type else log
    log = log.where(F.col("object_id") == object_id) if object_id else log
    return log.orderBy(*ORDER).limit(limit) if limit else log


def with_versions(log: DataFrame) -> DataFrame:
    """Adds version: 1, 2, ... within each object."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy("object_id").orderBy(*ORDER)).cast("long"))


#: Sequence numbers of a block; events of one instant are numbered block by block.
NUMBERS = 1 << 16


def renumber(log: DataFrame, numbers: int = NUMBERS) -> DataFrame:
    """Dense global numbers in time order: counts of hours, of their seconds and of the instants' blocks of sequence numbers give where each block begins.

    All of these are columns of the event itself, so every plan that reads the log agrees on them, and a block holds `numbers` events at most.
    """
    ts, number = ORDER
    keyed = log.withColumn("_block", F.floor(F.col(number) / numbers))
    blocks = keyed.groupBy(ts, "_block").agg(F.count("*").alias("_n")).withColumns({"_second": F.date_trunc("second", ts), "_hour": F.date_trunc("hour", ts)})

    def before(of: list[str], *by: str) -> Column:
        window = Window.partitionBy(*of).orderBy(*by) if of else Window.partitionBy(F.lit(0)).orderBy(*by)  # a row for each hour
        return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    seconds = blocks.groupBy("_hour", "_second").agg(F.sum("_n").alias("_n"))
    hours = seconds.groupBy("_hour").agg(F.sum("_n").alias("_n")).select(F.col("_hour").alias("_h"), before([], "_hour").alias("_low"))
    seconds = seconds.select("_hour", F.col("_second").alias("_s"), before(["_hour"], "_second").alias("_mid")).join(hours, F.col("_hour").eqNullSafe(F.col("_h")))
    starts = blocks.select(F.col(ts).alias("_ts"), F.col("_block").alias("_b"), "_second", before(["_second"], ts, "_block").alias("_high")).join(seconds, F.col("_second").eqNullSafe(F.col("_s")))
    starts = starts.select("_ts", "_b", (F.col("_low") + F.col("_mid") + F.col("_high")).alias("_start"))
    placed = keyed.withColumn("_place", F.row_number().over(Window.partitionBy(ts, "_block").orderBy(number)))
    placed = placed.join(starts, F.col(ts).eqNullSafe(F.col("_ts")) & F.col("_block").eqNullSafe(F.col("_b")))
    return placed.withColumn("global_number", F.col("_start") + F.col("_place")).select(*log.columns, "global_number")


def latest(log: DataFrame) -> DataFrame:
    """The last event of each object and its version."""
    at = F.struct(*ORDER, "event_id", "event_type")
    return log.groupBy("object_id").agg(F.max(at).alias("last"), F.count("*").alias("version")).select("object_id", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"), "version")


def merged(state: Column, entries: Column) -> Column:
    """A map with the entries added, replacing those of the same key. Entries, unlike maps, can be sorted with their events."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.concat(F.filter(F.map_entries(state), lambda e: ~F.array_contains(keys, e["key"])), entries))


def entries_of(data) -> Column:
    return F.map_entries(F.coalesce(data, F.create_map().cast(MAP))).alias("entries")


def _step(state: Column, event: Column) -> Column:
    """INSERT, UPDATE: top-level keys replaced. PATCH: merged, key by key of a flat map. DELETE: emptied. Others: unchanged."""
    return F.when(event["event_type"].isin("INSERT", "UPDATE", "PATCH"), merged(state, event["entries"])).when(event["event_type"] == "DELETE", F.create_map().cast(MAP)).otherwise(state)


def fold(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(object_id, state, version): each object's events in order, on top of `base` (object_id, state, version) if given.

    Events before an object's last DELETE can't matter and are dropped before the fold.
    """
    erased = F.max(F.when(F.col("event_type") == "DELETE", F.struct(*ORDER))).over(Window.partitionBy("object_id"))
    counted = log.withColumn("_erased", erased).withColumn("_live", F.col("_erased").isNull() | (F.struct(*ORDER) > F.col("_erased")))
    event = F.struct(*ORDER, "event_type", entries_of(F.col("data")))
    grouped = counted.groupBy("object_id").agg(F.array_sort(F.collect_list(F.when(F.col("_live"), event))).alias("events"), F.count("*").alias("n"), F.max("_erased").isNotNull().alias("wiped"))
    start = F.create_map().cast(MAP)
    if base is not None:
        grouped = grouped.join(base.select("object_id", F.col("state").alias("s0"), F.col("version").alias("v0")), "object_id", "full")
        start = F.when(F.coalesce("wiped", F.lit(False)), F.create_map().cast(MAP)).otherwise(F.coalesce("s0", F.create_map().cast(MAP)))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("v0", F.lit(0))
    else:
        n = F.col("n")
    events = F.coalesce("events", F.array().cast(grouped.schema["events"].dataType))
    return grouped.select("object_id", F.aggregate(events, start, _step).alias("state"), n.alias("version"))


def state_at(log: DataFrame, at) -> DataFrame:
    """(object_id, state, version) as of a time, inclusive; objects without state, deleted ones too, are absent."""
    return fold(log.where(F.col("ts") <= F.lit(at).cast("timestamp"))).where(F.size("state") > 0)


def time_travel(log: DataFrame, object_id: str, at) -> DataFrame:
    """object_id, at, state, version of one object; no row if it had no state then."""
    return state_at(log.where(F.col("object_id") == object_id), at).withColumn("at", F.lit(at).cast("timestamp"))


def version_at(log: DataFrame, at) -> DataFrame:
    return log.where(F.col("ts") <= F.lit(at).cast("timestamp")).groupBy("object_id").agg(F.count("*").alias("version"))


def snapshots(log: DataFrame, every: int = 100) -> DataFrame:
    """(object_id, version, ts, sequence_number, state) at every `every`-th version of an object.

    The states come from one pass of running folds: each stretch between snapshots is folded
    by itself, and the few stretch results of an object are then combined in order.
    """
    numbered = with_versions(log).withColumn("stretch", F.floor((F.col("version") - 1) / every))
    erased = F.max(F.when(F.col("event_type") == "DELETE", F.col("version"))).over(Window.partitionBy("object_id", "stretch"))
    live = numbered.withColumn("_erased", erased)
    event = F.struct("version", "event_type", entries_of(F.col("data")))
    parts = live.groupBy("object_id", "stretch").agg(
        F.array_sort(F.collect_list(F.when(F.col("_erased").isNull() | (F.col("version") > F.col("_erased")), event))).alias("events"),
        F.max("_erased").isNotNull().alias("wiped"), F.max(F.struct("version", "ts", "sequence_number")).alias("at"),
    ).select("object_id", "stretch", "wiped", "at", F.aggregate("events", F.create_map().cast(MAP), _step).alias("part"))
    history = Window.partitionBy("object_id").orderBy("stretch")
    part = F.struct(F.when(F.col("wiped"), F.lit("DELETE")).otherwise(F.lit("UPDATE")).alias("event_type"), F.map_entries("part").alias("entries"))
    whole = parts.withColumn("parts", F.collect_list(part).over(history))
    keep = F.aggregate("parts", F.create_map().cast(MAP), lambda s, p: merged(F.when(p["event_type"] == "DELETE", F.create_map().cast(MAP)).otherwise(s), p["entries"]))
    return whole.where(F.col("at.version") % every == 0).select("object_id", F.col("at.version").alias("version"), F.col("at.ts").alias("ts"), F.col("at.sequence_number").alias("sequence_number"), keep.alias("state"))


def nearest_snapshot(snaps: DataFrame, at) -> DataFrame:
    """The last snapshot of each object up to a time."""
    cols = [c for c in snaps.columns if c not in ("object_id",)]
    return snaps.where(F.col("ts") <= F.lit(at).cast("timestamp")).groupBy("object_id").agg(F.max_by(F.struct(*cols), "version").alias("s")).select("object_id", *[F.col(f"s.{c}").alias(c) for c in cols])


def state_from_snapshots(log: DataFrame, snaps: DataFrame, at) -> DataFrame:
    """The same as state_at, folding only events after each object's nearest snapshot."""
    base = nearest_snapshot(snaps, at).select("object_id", "state", "version")
    tail = with_versions(log).where(F.col("ts") <= F.lit(at).cast("timestamp")).join(base.select("object_id", F.col("version").alias("v0")), "object_id", "left").where(F.col("v0").isNull() | (F.col("version") > F.col("v0")))
    return fold(tail.drop("version", "v0"), base).where(F.size("state") > 0)


def as_of(rows: DataFrame, states: DataFrame, key: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Each row with the last `value` of its key up to its time: one union, one sort per key."""
    left = rows.withColumn("_v", F.lit(None).cast(dict(states.dtypes)[value])).withColumn("_side", F.lit(1))
    right = states.select(key, ts, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    over = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.withColumn(f"{value}_as_of", F.last("_v", ignorenulls=True).over(over)).where("_side = 1").drop("_v", "_side")


def event_statistics(log: DataFrame) -> DataFrame:
    """(kind, key, n): the total, by type and by object, in one pass."""
    counted = log.groupingSets([[], ["event_type"], ["object_id"]], "event_type", "object_id").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "type").otherwise("object")
    return counted.select(kind.alias("kind"), F.coalesce("event_type", "object_id", F.lit("")).alias("key"), "n")


def expected_version_conflicts(log: DataFrame, writes: DataFrame) -> DataFrame:
    """Writes (object_id, expected_version) that another event has overtaken."""
    held = writes.join(latest(log).select("object_id", "version"), "object_id", "left")
    return held.where(F.coalesce("version", F.lit(0)) != F.col("expected_version"))


def compact(log: DataFrame, files: int = 1) -> DataFrame:
    """The log in time order in a given number of files, for rewriting it."""
    return log.repartitionByRange(files, *ORDER).sortWithinPartitions(*ORDER)
