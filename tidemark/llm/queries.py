"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bbit_minhash, line_shapes, name_links, personal_data, phrase_index, spm_codec
from tidemark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "episodes"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.text_classes(table(spark, sf_dir, "episodes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_links.linked_names(table(spark, sf_dir, "entities"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_links.name_classes(table(spark, sf_dir, "entities"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_pieces(table(spark, sf_dir, "episodes"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.redacted(table(spark, sf_dir, "episodes"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_codec.encode_corpus(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_codec.decode_corpus(spm_codec.encode_corpus(table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_shapes.spam_pages(table(spark, sf_dir, "documents"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_shapes.page_shares(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_redacted": p4_redacted, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_found": p8_found, "p9_found": p9_found, "p9_shares": p9_shares}

SQL: dict[str, str] = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
