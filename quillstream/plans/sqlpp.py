"""SQL with semantic predicates: rewritten to SQL functions and given to Spark's own parser."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import register_sql_functions

#: Column that one-argument CAPTION_CONTAINS looks at.
CAPTION = "content"


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _split(sql: str) -> list[str]:
    """Quoted parts (with their quotes) and what lies between, in turn."""
    return re.split(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")", sql)


def rewrite(sql: str, vectors: dict[str, list[float]] | None = None) -> str:
    """Spark SQL of a statement: `;` dropped, "x" as strings, CAPTION_CONTAINS(x) on the caption, metadata->>'k' as a look-up, named query vectors as literals."""
    parts = _split(sql.strip())
    for i in range(1, len(parts), 2):
        if parts[i][0] == '"':
            parts[i] = quote(parts[i][1:-1])
    text = "".join(parts).rstrip().rstrip(";")
    text = re.sub(r"\bCAPTION_CONTAINS\s*\(\s*('(?:[^'\\]|\\.)*')\s*\)", rf"CAPTION_CONTAINS({CAPTION}, \1)", text, flags=re.I)
    text = re.sub(r"\b(\w+)\s*->>\s*('(?:[^'\\]|\\.)*')", r"\1[\2]", text)
    parts = _split(text)
    for i in range(0, len(parts), 2):
        for name, vector in (vectors or {}).items():
            literal = "array(" + ", ".join(f"{float(x)!r}D" for x in vector) + ")"
            parts[i] = re.sub(rf"\b{re.escape(name)}\b", literal, parts[i])
    return "".join(parts)


def run(spark: SparkSession, sql: str, vectors: dict[str, list[float]] | None = None) -> DataFrame:
    """The statement's DataFrame over the registered views. Errors are raised, not swallowed."""
    register_sql_functions(spark)
    return spark.sql(rewrite(sql, vectors))
