"""Text to vector without a model: feature hashing, and descriptions of other media."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EMBED_DIM, iot_description


def embed_text(text: str, dim: int = EMBED_DIM) -> list[float]:
    """A query's vector; the same as embed_column gives."""
    v = [0.0] * dim
    for token in re.split("[^a-z0-9]+", text.lower()):
        if token:
            v[int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % dim] += 1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


def embed_column(text: Column, dim: int = EMBED_DIM) -> Column:
    """Unit vector of token counts in hashed buckets, by Arrow batches; zero for texts without tokens."""

    @F.pandas_udf("array<double>")
    def embed(held: pd.Series) -> pd.Series:
        bucket: dict[str, int] = {}
        out = []
        for one in held:
            counts = Counter(t for t in re.split("[^a-z0-9]+", (one or "").lower()) if t)
            v = np.zeros(dim)
            for token, n in counts.items():
                if token not in bucket:
                    bucket[token] = int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % dim
                v[bucket[token]] += n
            norm = math.sqrt(float(v @ v))
            out.append(v / norm if norm else v)
        return pd.Series(out)

    return embed(text)


def description(df: DataFrame) -> Column:
    """What is embedded of an object: its text, or a description of what it is."""
    meta = F.col("metadata")
    size = F.concat_ws(", ", F.coalesce(meta["width"], F.lit("0")), F.coalesce(meta["height"], F.lit("0")))
    return (
        F.when(F.col("type") == "image", F.concat(F.lit("image with size ("), size, F.lit(")")))
        .when(F.col("type") == "video", F.concat(F.lit("video with "), F.least(F.coalesce(meta["frames"].try_cast("int"), F.lit(0)), F.lit(10)).cast("string"), F.lit(" frames")))
        .when(F.col("type") == "audio", F.concat(F.lit("audio with duration "), F.coalesce(meta["duration"], F.lit("0")), F.lit("s")))
        .when(F.col("type") == "iot", iot_description(meta))
        .otherwise(F.col("text"))
    )


def embed_objects(df: DataFrame, dim: int = EMBED_DIM) -> DataFrame:
    """(object_id, embedding) for every object."""
    return df.select("object_id", embed_column(F.coalesce(description(df), F.lit("")), dim).alias("embedding"))


def embed_batches(df: DataFrame, model, schema: str = "object_id string, embedding array<float>") -> DataFrame:
    """(object_id, embedding) by any model with encode(list of texts) -> rows, one call per Arrow batch."""

    def run(frames):
        for frame in frames:
            yield frame[["object_id"]].assign(embedding=[list(map(float, v)) for v in model.encode(frame["text"].fillna("").tolist())])

    return df.select("object_id", "text").mapInPandas(run, schema)
