"""Conditions as Columns: parsed conditions, filters of natural-language queries, time ranges."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_ci, keyword_score

NUMERIC = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def field_of(df: DataFrame, name: str) -> Column:
    """A column of that name, else the metadata key; missing keys are null."""
    return F.col(name) if name in df.columns else F.col("metadata")[name]


def compare(column: Column, op: str, value) -> Column:
    """Three-valued comparison. Numbers compare as numbers (text that isn't one is null), other values as text."""
    if op in ("in", "not in"):
        found = column.cast("string").isin([str(v) for v in value])
        return found if op == "in" else ~found
    if op == "between":
        return compare(column, ">=", value[0]) & compare(column, "<=", value[1])
    if op == "like":
        return column.cast("string").like(value)
    if op == "contains":
        return contains_ci(column.cast("string"), value)
    if op in ("is null", "is not null"):
        return column.isNull() if op == "is null" else column.isNotNull()
    if isinstance(value, bool) or value is None:
        held = column.cast("string") == F.lit(str(value).lower() if value is not None else None)
    elif isinstance(value, (int, float)):
        number = column.cast("string").try_cast("double")
        if op in NUMERIC:
            return NUMERIC[op](number, F.lit(float(value)))
        held = number == float(value)
    else:
        if op in NUMERIC:
            return NUMERIC[op](column.cast("string"), F.lit(value))
        held = column.cast("string") == value
    return ~held if op in ("!=", "<>") else held


def all_of(df: DataFrame, conditions: Iterable[tuple[str, str, object]]) -> DataFrame:
    """Conditions (field, operator, value), joined by AND."""
    for name, op, value in conditions:
        df = df.where(compare(field_of(df, name), op, value))
    return df


def apply_filters(df: DataFrame, filters) -> DataFrame:
    """location: part of metadata.location; color and object: part of the text; other kinds pass everything."""
    items = filters.items() if isinstance(filters, dict) else [(f["type"], f["value"]) for f in filters]
    for kind, value in items:
        if kind == "location":
            df = df.where(F.contains(F.col("metadata")["location"], F.lit(value)))
        elif kind in ("color", "object"):
            df = df.where(F.contains(F.col("text"), F.lit(value)))
    return df


def keyword_match(df: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Rows with a positive keyword score, and that score."""
    return df.withColumn("semantic_score", keyword_score(F.col(text), terms)).where("semantic_score > 0")


def resolve_time_range(kind: str, groups: tuple[str, ...], now: dt.datetime) -> tuple[dt.datetime, dt.datetime] | None:
    """[from, to) of a named period, as seen from `now`."""
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    month = day.replace(day=1)
    try:
        if kind == "today":
            return day, day + dt.timedelta(days=1)
        if kind == "yesterday":
            return day - dt.timedelta(days=1), day
        if kind == "last_week":
            monday = day - dt.timedelta(days=day.weekday())
            return monday - dt.timedelta(days=7), monday
        if kind == "last_month":
            return (month - dt.timedelta(days=1)).replace(day=1), month
        if kind == "specific_date":
            at = day.replace(month=int(groups[0]), day=int(groups[1]))
            return at, at + dt.timedelta(days=1)
        if kind == "year_month":
            at = month.replace(year=int(groups[0]), month=int(groups[1]))
            return at, (at + dt.timedelta(days=32)).replace(day=1)
    except ValueError:
        return None
    return None


def in_period(df: DataFrame, period: tuple[dt.datetime, dt.datetime] | None, column: str = "created_at") -> DataFrame:
    """Rows of the half-open period; all rows without one."""
    if period is None:
        return df
    lo, hi = (F.lit(p.isoformat(sep=" ")).cast("timestamp") for p in period)
    return df.where((F.col(column) >= lo) & (F.col(column) < hi))
