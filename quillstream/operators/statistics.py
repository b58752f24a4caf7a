"""Counts and roll-ups over all tables of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a question's intent computes.
INTENTS = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def intent_aggregate(df: DataFrame, intent: str, column: str | None = None, by: list[str] | None = None) -> DataFrame:
    """COUNT, SUM, AVG, MIN or MAX of a column, by groups if given; COUNT takes rows without one."""
    made = F.count("*") if intent.upper() == "COUNT" and column is None else INTENTS[intent.upper()](column)
    return (df.groupBy(*by) if by else df.groupBy()).agg(made.alias("value"))


def database_stats(objects: DataFrame, vectors: DataFrame, events: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, rows, bytes) of each table."""
    row = lambda df, part, size: df.agg(F.lit(part).alias("part"), F.count("*").alias("rows"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"))
    return row(objects, "objects", F.sum("size")).unionByName(row(vectors, "vectors", F.sum(F.size("embedding") * 4))).unionByName(row(events, "events", F.lit(None))).unionByName(row(edges, "edges", F.lit(None)))
