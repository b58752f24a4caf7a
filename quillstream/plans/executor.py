"""Questions to DataFrames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import predicates, search
from ..sources.config import Settings
from .ir import Question


def answer(question: Question, objects: DataFrame, vectors: DataFrame | None = None, embed=None, settings: Settings | None = None, now: dt.datetime | None = None) -> DataFrame:
    """One lazy plan: types, filters and period, then scores, order and limit.

    With vectors and an embedder, terms score by their best cosine among each term's 50 nearest candidates;
    without, by the share of terms contained. Without terms every candidate scores 1. Candidates
    are filtered before they are ranked. Ordered by score, then id.
    """
    settings = settings or Settings()
    rows = objects.where(F.col("type").isin(list(question.types))) if question.types else objects
    rows = predicates.all_of(predicates.apply_filters(rows, question.filters), question.conditions)
    if question.period:
        rows = predicates.in_period(rows, predicates.resolve_time_range(*question.period, now or dt.datetime.now(dt.UTC).replace(tzinfo=None)))
    if not question.terms:
        scored = rows.withColumn("similarity", F.lit(1.0))
    elif vectors is not None and embed is not None:
        spark = objects.sparkSession
        terms = spark.createDataFrame([(i, [float(x) for x in embed(t)]) for i, t in enumerate(question.terms)], "query_id int, query array<double>")
        held = vectors.join(rows.select("object_id"), "object_id", "left_semi")
        hits = search.multi_term(held, terms, 50, settings.semantic_threshold)
        scored = rows.join(hits, "object_id")
    else:
        scored = predicates.keyword_match(rows, list(question.terms)).withColumnRenamed("semantic_score", "similarity")
    order = [F.desc(c) if down else F.asc(c) for c, down in question.order_by] or [F.desc("similarity")]
    out = scored.orderBy(*order, "object_id")
    limit = settings.clamp(question.limit)
    out = out.limit(limit) if limit else out
    return out if question.select == ("*",) else out.select(*question.select)
