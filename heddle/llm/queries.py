"""Queries of the text problems; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import boilerplate, look_alike, near_dup, packing, repeated_lines, sentences, tokenizer, truncation


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture_lines(_t(spark, sf_dir, "articles"), "article_id", "content", "domain")


def p1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.evidence(_t(spark, sf_dir, "articles"), "article_id", "content", "domain")


def p1_without_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.without_cues(_t(spark, sf_dir, "articles"), "article_id", "content", "domain")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_pairs(_t(spark, sf_dir, "articles"), "article_id", "content", host_col="domain")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(_t(spark, sf_dir, "articles"), "article_id", "content", host_col="domain")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(_t(spark, sf_dir, "articles"), host_col="domain")


def p3_share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.share_by_source(_t(spark, sf_dir, "articles"), host_col="domain")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.reasons(_t(spark, sf_dir, "articles"), host_col="domain")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike.look_alike_pairs(_t(spark, sf_dir, "articles"), "article_id", ["title", "content"])


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike.look_alike_classes(_t(spark, sf_dir, "articles"), "article_id", ["title", "content"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_lines(_t(spark, sf_dir, "articles"), "article_id", "content", "source")


def p6_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_lines(_t(spark, sf_dir, "articles"), "article_id", "content", "source", slots=True)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(_t(spark, sf_dir, "documents"), "doc_id", "text")


def p9_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "pack_sizes"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p9_packs(spark, sf_dir), _t(spark, sf_dir, "pack_sizes"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(_t(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_evidence, p1_without_cues, p2_found, p2_classes, p3_found, p3_share_by_source, p3_reasons, p5_found, p5_classes, p6_found, p6_slots, p8_ids, p9_packs, p9_fill, p10_found)}
ORACLES: dict[str, str] = {}
