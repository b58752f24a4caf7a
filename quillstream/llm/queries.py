"""Registered queries of the operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language, licences, line_dedup, lm_scoring, media, mixing, secrets, toxicity
from .common import Scratch, crc_mod, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "toxicity")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0, scratch)
    scratch.drop()
    scored = toxicity.score(docs, model)
    held_out = crc_mod("doc_id", 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), F.col("qs_score").alias("score"), (F.col("qs_score") >= 0.5).cast("int").alias("predicted"), F.to_json("qs_evidence").alias("evidence"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.train(docs, crc_mod("doc_id", 4) != 2)
    found = language.identify(docs, net)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of quality 1; background: all documents. The labels grow with the corpus: they are never broadcast."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.score(docs, lm_scoring.train(docs, good))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_mix_sources": op3_mix_sources,
    "op4_language": op4_language,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_media_columns": op7_media_columns,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_secret_scan": op9_secret_scan,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE = {
    "op1_license_scan": licences.sql(),
    "op10_line_dedup": line_dedup.sql(),
}
