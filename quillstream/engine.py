"""The façade: insert, update, delete, get, query, statistics, backup and restore over one event log."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import embedding, events, storage
from .plans import executor, ir, nl_rules, planner, sqlpp
from .session import prepare
from .sources.config import Settings

LOG = "event_id STRING, object_id STRING, event_type STRING, ts TIMESTAMP, sequence_number BIGINT, type STRING, text STRING, metadata MAP<STRING,STRING>, tags ARRAY<STRING>"


class Engine:
    """One writer's view of a folder. The log is the only thing written; objects, vectors, chunks are derived from it."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, client=None):
        self.spark, self.path, self.settings = prepare(spark), path.rstrip("/"), settings or Settings()
        self.providers = planner.Providers(self.settings) if client is None else client
        self.planner = planner.Planner(self.providers, self.settings.default_limit)
        self.clock = lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None)
        self._next = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        self._next = None

    # -- writing

    def _append(self, rows: list[dict]) -> None:
        if self._next is None:
            self._next = (self.events().agg(F.max("sequence_number")).first()[0] or 0) + 1
        now, made = self.clock(), []
        for r in rows:
            made.append((str(uuid.uuid4()), r["object_id"], r["event_type"], now, self._next, r.get("type"), r.get("text"), r.get("metadata"), r.get("tags")))
            self._next += 1
        self.spark.createDataFrame(made, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/events")

    @staticmethod
    def _fields(data: dict) -> dict:
        body = data.get("data")
        text = body if isinstance(body, str) or body is None else json.dumps(body, ensure_ascii=False, sort_keys=True)
        return {"type": data.get("type"), "text": text, "metadata": {k: v if isinstance(v, str) else json.dumps(v) for k, v in (data.get("metadata") or {}).items()}, "tags": list(data.get("tags") or [])}

    def insert(self, data: dict) -> str:
        return self.insert_many([data])[0]

    def insert_many(self, objects: list[dict]) -> list[str]:
        """Ids of the new objects; one append."""
        ids = [str(uuid.uuid4()) for _ in objects]
        self._append([{"object_id": i, "event_type": "INSERT"} | self._fields(o) for i, o in zip(ids, objects)])
        return ids

    def update(self, object_id: str, data: dict) -> bool:
        """Rewritten if its type changes or its size by more than half, else merged; False for an unknown object."""
        if not self.current().where(F.col("object_id") == object_id).limit(1).count():
            return False
        self._append([{"object_id": object_id, "event_type": "UPDATE"} | self._fields(data)])
        return True

    def delete(self, object_id: str) -> bool:
        """True, for unknown objects too."""
        self._append([{"object_id": object_id, "event_type": "DELETE"}])
        return True

    # -- reading

    def events(self) -> DataFrame:
        self._settle()
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/events")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    def current(self, at: dt.datetime | None = None) -> DataFrame:
        """Objects now, or as of a time: every object's events after its last DELETE folded in order."""
        log = self.events().where(F.col("ts") <= F.lit(at)) if at else self.events()
        erased = F.max(F.when(F.col("event_type") == "DELETE", F.col("sequence_number"))).over(Window.partitionBy("object_id"))
        log = log.withColumn("live", F.coalesce(F.col("sequence_number") > erased, F.lit(True)))
        size = F.coalesce(F.octet_length(F.encode("text", "UTF-8")), F.lit(0))
        empty_map, empty_tags = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
        event = F.struct("sequence_number", "event_type", "ts", "type", "text", F.map_entries(F.coalesce("metadata", empty_map)).alias("entries"), F.coalesce("tags", empty_tags).alias("tags"), size.alias("size"))
        grouped = log.groupBy("object_id").agg(F.array_sort(F.collect_list(F.when(F.col("live"), event))).alias("events"), F.count("*").alias("version")).where(F.size("events") > 0)
        blank = F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("text"), empty_map.alias("metadata"), empty_tags.alias("tags"), F.lit(0).alias("size"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(False).alias("live"))

        def step(s, e):
            fresh = ~s["live"] | (e["event_type"] == "INSERT") | F.coalesce(storage.needs_rewrite(s["type"], e["type"], s["size"], e["size"]), F.lit(True))
            return F.when(e["event_type"] == "DELETE", blank).otherwise(
                F.struct(e["type"].alias("type"), e["text"].alias("text"), F.when(fresh, F.map_from_entries(e["entries"])).otherwise(events.merged(s["metadata"], e["entries"])).alias("metadata"), F.when(fresh, e["tags"]).otherwise(F.array_union(s["tags"], e["tags"])).alias("tags"), e["size"].alias("size"), F.coalesce(s["created_at"], e["ts"]).alias("created_at"), e["ts"].alias("updated_at"), F.lit(True).alias("live"))
            )

        folded = grouped.select("object_id", "version", F.aggregate("events", blank, step).alias("s")).where("s.live")
        return folded.select("object_id", "version", *[F.col(f"s.{c}").alias(c) for c in ("type", "text", "metadata", "tags", "size", "created_at", "updated_at")])

    def get(self, object_id: str, at: dt.datetime | None = None) -> dict | None:
        row = self.current(at).where(F.col("object_id") == object_id).first()
        if row is None:
            return None
        held = row.asDict()
        held["data"] = json.loads(held["text"]) if held["type"] == "iot" and held["text"] else held["text"]
        return held

    def vectors(self) -> DataFrame:
        return embedding.embed_objects(self.current().where("type <> 'iot'"), self.settings.embedding_dimension)

    def query(self, asked: str | dict, semantic: bool = False, now: dt.datetime | None = None, context: dict | None = None) -> DataFrame:
        """A dictionary is run as it is; SELECT ... goes to Spark SQL; other text is planned by the model if it is sure, else by the rules.

        Terms match by the words they contain, or, with semantic, by vectors.
        """
        current = self.current()
        if isinstance(asked, str) and nl_rules.is_sql(asked):
            v = self.vectors()
            shown = current.join(v, "object_id", "left")
            shown = shown.withColumns({"id": F.col("object_id"), "content": F.col("text"), "data_type": F.col("type")})
            shown.createOrReplaceTempView("multimodal_data")
            for kind in nl_rules.TYPE_WORDS:
                shown.where(F.col("type") == kind).createOrReplaceTempView(kind)
            return sqlpp.run(self.spark, asked)
        if isinstance(asked, dict):
            question = ir.from_dict(asked)
        else:
            plan = self.planner.plan(asked, context)
            question = planner.to_question(asked, plan["analysis"], self.settings.default_limit) if plan["method"] == "model" and plan["confidence"] > 0.7 else nl_rules.parse(asked)
        if semantic:
            return executor.answer(question, current, self.vectors(), lambda t: embedding.embed_text(t, self.settings.embedding_dimension), self.settings, now)
        return executor.answer(question, current, settings=self.settings, now=now)

    def statistics(self) -> dict:
        log, current = self.events(), self.current()
        by_type = {r["type"]: r["n"] for r in current.groupBy("type").agg(F.count("*").alias("n")).collect()}
        by_event = {r["event_type"]: r["n"] for r in log.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
        size = current.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        return {"total_objects": sum(by_type.values()), "objects_by_type": by_type, "total_events": sum(by_event.values()), "events_by_type": by_event, "total_size": size, "total_vectors": sum(n for t, n in by_type.items() if t != "iot")}

    def health(self) -> dict:
        return {"status": "healthy", "provider": self.providers.current if hasattr(self.providers, "current") else "given", "events": self.events().limit(1).count() > 0}

    # -- upkeep

    def compact(self, files: int = 1) -> None:
        """The log rewritten into about `files` files of ranges of its numbers, beside it, then put in its place by renaming."""
        self._replace(self.events().repartitionByRange(files, "sequence_number").sortWithinPartitions("sequence_number"))

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _replace(self, log: DataFrame) -> None:
        """A failure at any point leaves the old log, or the new one whole."""
        log.write.mode("overwrite").parquet(f"{self.path}/events.new")
        fs, old = self._folder("events")
        if fs.exists(old):
            fs.rename(old, self._folder("events.old")[1])
        self._settle()

    def _settle(self) -> None:
        """Ends a replacement: the old log is set aside only once the new one is complete, so the new one takes its place."""
        fs, log = self._folder("events")
        aside, new = self._folder("events.old")[1], self._folder("events.new")[1]
        if not fs.exists(log) and fs.exists(self._folder("events.new/_SUCCESS")[1]):
            fs.rename(new, log)
        if fs.exists(log) and fs.exists(aside):
            fs.delete(aside, True)

    def backup(self, path: str) -> bool:
        self.events().write.mode("overwrite").parquet(f"{path}/events")
        return True

    def restore(self, path: str) -> bool:
        self._replace(self.spark.read.schema(LOG).parquet(f"{path}/events"))
        self._next = None
        return True
