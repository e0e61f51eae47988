"""Queries of the llm operators. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import boilerplate, langid, leakage, mixture, residue, spelling, stuffing, survivor
from factloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.find_furniture(table(spark, sf_dir, "bodies"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "bodies")).select("body_id")


def p5_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, recall and precision on the weak labels of unseen sites."""
    return residue.validation(table(spark, sf_dir, "bodies"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "links")
    keys = spelling.record_keys(links, "link_id", ["title", "snippet"], ["url"])
    return spelling.copies(keys).select(F.col("keep_id").alias("keep_link_id"), F.col("copy_id").alias("copy_link_id"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "links")
    keys = spelling.record_keys(links, "link_id", ["title", "snippet"], ["url"])
    return spelling.collapse(keys).select(F.col("keep_id").alias("keep_link_id"), "n_copies")


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "links")
    return spelling.summary(spelling.collapse(spelling.record_keys(links, "link_id", ["title", "snippet"], ["url"])))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.survivors(table(spark, sf_dir, "link_clusters"), table(spark, sf_dir, "links"), table(spark, sf_dir, "backend_trust"))


def p6_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.fuse(table(spark, sf_dir, "link_clusters"), table(spark, sf_dir, "links"))


TEXT_FIELDS = ["caption", "transcript", "top_comments"]


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "short_videos")
    profiles = langid.train_profiles(videos, TEXT_FIELDS)
    return langid.segment_languages(videos, profiles, "link_id", TEXT_FIELDS, "lang", whole=["caption"])


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of each video's texts."""
    return langid.document_languages(p1_segments(spark, sf_dir), "link_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = p1_segments(spark, sf_dir).where("label_lang is null or label_lang <> lang")
    return wrong.select("link_id", "field_name", "seg_no", "lang")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.find_stuffed(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_segments, p1_documents, p3_found, p5_found, p5_validation, p4_found, p4_records, p4_summary, p6_found, p6_fused, p8_found, p9_mixture, p9_shares, p10_found)}
