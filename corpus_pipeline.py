"""A training-corpus pipeline: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of `documents`; the last returns one row per remaining document with its size, its
source's size and target, and the words that the mix takes of it
(`quillstream.llm.mixing.Mixture.blocks` makes the packed blocks themselves).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from quillstream.llm.common import Scratch, crc_mod, table

#: Near duplicates: five-word shingles, similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def _beside(docs: DataFrame, names: set[str], work) -> DataFrame:
    """work(docs) with the columns of docs; those that clash with the columns `names` that it adds have other names meanwhile."""
    held = {c: f"own_{k}_{c}" for k, c in enumerate(docs.columns) if c.lower() in names}
    out = work(docs.withColumnsRenamed(held))
    return out.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5 stay."""
    scratch = Scratch(spark, "toxicity")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0, scratch)
    scratch.drop()
    return _beside(docs, {"qs_score", "qs_evidence"}, lambda d: toxicity.score(d, model).where("qs_score < 0.5"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document of which no text is left goes."""
    left = (F.col("n_removed") == 0) | (F.trim(F.col("text"), F.lit(" \n\t\r")) != "")
    return _beside(docs, {"n_lines", "n_removed"}, lambda d: line_dedup.dedup_lines(d).where(left).withColumn("n_chars", F.length("text").cast("bigint")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked documents; documents without words stay."""
    found = jaccard_join.jaccard_components(docs, n=SHINGLE, percent=PERCENT)
    found = found.where((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("qs_id"), F.col("n_shingles").alias("qs_n"))
    kept = found.groupBy("qs_id").agg(F.count("*").alias("qs_rows"), F.max("qs_n").alias("qs_n"))
    repeated = kept.where("qs_rows > 1 AND qs_n > 0").limit(1).count()
    out = docs.join(kept, docs.doc_id.eqNullSafe(kept.qs_id), "left_semi").select(*docs.columns)
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found stay."""
    items = table(spark, sf_dir, "benchmark")
    return _beside(docs, {"qs_items", "qs_k1", "qs_k2"}, lambda d: decontaminate.find_items(d, items).where(F.size("qs_items") == 0))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_duplicates), ("benchmark decontamination", drop_benchmark), ("mixing sources to target weights", mix)]

#: Scores, links and permutations are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, str(k))
    return scratch.keep(docs)
