"""Column builders and SQL functions of the semantic predicates; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EMBED_DIM = 64


def as_column(vector) -> Column:
    """A literal vector, or the column itself."""
    return vector if isinstance(vector, Column) else F.array(*[F.lit(float(x)) for x in vector])


def vec_dot(a, b) -> Column:
    """Inner product accumulated in double."""
    pairs = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def vec_norm(a) -> Column:
    return F.sqrt(F.aggregate(as_column(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vec_cosine(a, b) -> Column:
    """Cosine; 0 if either norm is 0."""
    return F.coalesce(F.try_divide(vec_dot(a, b), vec_norm(a) * vec_norm(b)), F.lit(0.0))


def vec_angular_similarity(a, b) -> Column:
    """1 / (1 + angular distance), the distance being sqrt(2 - 2 cos)."""
    return F.lit(1.0) / (F.lit(1.0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * vec_cosine(a, b))))


def fit_dim(vector: Column, dim: int) -> Column:
    """Cut, or filled with zeros, to `dim` elements."""
    return F.slice(F.concat(vector.cast("array<double>"), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def contains_ci(text: Column, term: str) -> Column:
    return F.contains(F.lower(text), F.lit(term.lower()))


def keyword_score(text: Column, terms: list[str]) -> Column:
    """Share of the terms that the text contains, whatever their case; 0 without terms."""
    if not terms:
        return F.lit(0.0)
    return sum((contains_ci(text, t).cast("int") for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def hashed_buckets(text: Column, dim: int = EMBED_DIM) -> Column:
    """The bucket of every token of a text: the first 16 bits of its MD5, modulo dim."""
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
    return F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int") % dim))


def iot_description(readings: Column) -> Column:
    """'IoT data: k: v, ...' of a map, in key order."""
    entries = F.array_sort(F.map_entries(readings))
    return F.concat(F.lit("IoT data: "), F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), ", "))


#: SQL functions by name: parameters and body; Catalyst inlines them.
SQL_FUNCTIONS = {
    "CAPTION_CONTAINS": ("body STRING, term STRING", "BOOLEAN", "contains(lower(body), lower(term))"),
    "VECTOR_DOT": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "VECTOR_SIMILARITY": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)",
    ),
    "KEYWORD_SCORE": ("body STRING, terms ARRAY<STRING>", "DOUBLE", "coalesce(try_divide(aggregate(terms, 0D, (s, t) -> s + if(contains(lower(body), lower(t)), 1D, 0D)), size(terms)), 0D)"),
    "SEMANTIC_MATCH": ("body STRING, phrase STRING", "BOOLEAN", "exists(filter(split(lower(phrase), '[^a-z0-9\\u00e0-\\u024f\\u4e00-\\u9fff]+'), w -> w <> ''), w -> contains(lower(body), w))"),
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, (params, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
