"""Ranked retrieval across stores: scores by rank, first-wins deduplication, context items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import blank_to_null
from tidemark.sources.tables import materialise, shuffle_partitions


def places(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds ``place`` (from 0) and ``length`` within each key's list, also where one key holds most rows.

    Rows are range-partitioned by key and order and written once; a row's place is the one within its range
    plus the rows of its key in earlier ranges, of which there is one count per range and key.
    """
    n = shuffle_partitions(rows.sparkSession)
    ranges = materialise(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    by_key = Window.partitionBy(*keys)
    ahead = F.sum("_n").over(by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_n").over(by_key).alias("length"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = ranges.withColumn("_within", within).join(offsets, same)
    return joined.withColumn("place", F.col("_within") + F.col("_ahead")).drop("_range", "_r", "_within", "_ahead", *(f"_k{i}" for i in range(len(keys))))


def relevance(ranked: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds ``score`` = 1 - place / length within each key's list, or within the rows of one search if there is no key."""
    if keys:
        return places(ranked, keys, order).withColumn("score", 1 - F.col("place") / F.col("length")).drop("place", "length")
    w = Window.partitionBy(F.lit(0))
    return ranked.withColumn("score", 1 - (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w))


def dedup_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of a key the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rank_episodes(rows: DataFrame) -> DataFrame:
    """``final`` = 0.7 score + 0.3 salience."""
    return rows.withColumn("final", F.round(0.7 * F.col("score") + 0.3 * F.coalesce("salience", F.lit(0.5)), 9))


def fact_items(facts: DataFrame, names: DataFrame, score: DataFrame | None = None) -> DataFrame:
    """Facts as context items: ``source``, ``id``, ``text`` (subject predicate object), ``relevance`` (0.5 by default)."""
    subject = names.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    other = names.select(F.col("id").alias("object_id"), F.col("name").alias("object"))
    joined = facts.join(subject, "subject_id", "left").join(other, "object_id", "left")
    obj = F.coalesce("object", blank_to_null("object_value"), F.col("object_id"))
    out = joined.select("id", F.concat_ws(" ", F.coalesce("subject", "subject_id"), "predicate", obj).alias("text"))
    out = out.join(score, "id", "left") if score is not None else out.withColumn("score", F.lit(None).cast("double"))
    return out.select(F.lit("semantic").alias("source"), "id", "text", F.coalesce("score", F.lit(0.5)).alias("relevance"))


def episode_items(episodes: DataFrame, score: DataFrame | None = None) -> DataFrame:
    """Episodes as context items: the summary, or else the content; source ``episodic_L<level>``."""
    text = F.coalesce(blank_to_null("summary"), F.col("content"))
    out = episodes.select("id", "level", text.alias("text"))
    out = out.join(score, "id", "left") if score is not None else out.withColumn("score", F.lit(None).cast("double"))
    return out.select(F.concat(F.lit("episodic_L"), F.col("level").cast("string")).alias("source"), "id", "text", F.coalesce("score", F.lit(0.5)).alias("relevance"))
