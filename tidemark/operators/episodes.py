"""Episodes: navigation, temporal filters, recency, inverted index, consolidation marks.

Of several deliveries of one id the first recorded counts (null last).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import blank_to_null, latest, moment


def unique_episodes(episodes: DataFrame) -> DataFrame:
    return latest(episodes, ["id"], [F.asc_nulls_last("recorded_at"), F.asc("parent_id")])


def children(episodes: DataFrame) -> DataFrame:
    """Each existing parent's children in order of occurrence: ``parent_id``, ``at``, ``id``."""
    one = unique_episodes(episodes)
    held = one.where(blank_to_null("parent_id").isNotNull()).join(one.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    w = Window.partitionBy("parent_id").orderBy(F.asc_nulls_last("occurred_at"), "id")
    return held.select("parent_id", F.row_number().over(w).cast("long").alias("at"), "id")


def parent_of(episodes: DataFrame) -> DataFrame:
    """Each episode with its parent's id, level and summary; null where there is none."""
    one = unique_episodes(episodes)
    up = one.select(F.col("id").alias("parent_id"), F.col("level").alias("parent_level"), F.col("summary").alias("parent_summary"), F.lit(True).alias("there"))
    out = one.select("id", blank_to_null("parent_id").alias("parent_id")).join(up, "parent_id", "left")
    return out.select("id", F.when(F.col("there"), F.col("parent_id")).alias("parent_id"), "parent_level", "parent_summary")


def temporal(episodes: DataFrame, valid_at: str | None = None, as_of: str | None = None) -> DataFrame:
    """Occurred by ``valid_at`` and recorded by ``as_of``, both inclusive."""
    out = episodes
    if valid_at is not None:
        out = out.where(F.col("occurred_at") <= moment(valid_at))
    if as_of is not None:
        out = out.where(F.col("recorded_at") <= moment(as_of))
    return out


def recent(episodes: DataFrame, level: int | None = 0, limit: int = 10) -> DataFrame:
    """The latest ``limit`` episodes of a level (None: of any), newest first."""
    one = unique_episodes(episodes)
    one = one.where(F.col("level") == level) if level is not None else one
    return one.orderBy(F.desc_nulls_last("occurred_at"), "id").limit(limit)


def recent_per_level(episodes: DataFrame, limit: int = 10) -> DataFrame:
    w = Window.partitionBy("level").orderBy(F.desc_nulls_last("occurred_at"), "id")
    return unique_episodes(episodes).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def inverted_index(episodes: DataFrame, index_type: str, keys_col: str) -> DataFrame:
    """``index_type``, ``key``, ``episode_id``: one row per key of a list column."""
    return unique_episodes(episodes).select(F.lit(index_type).alias("index_type"), F.explode(keys_col).alias("key"), F.col("id").alias("episode_id")).where("key is not null").distinct()


def index_lookup(index: DataFrame, episodes: DataFrame, index_type: str, key: str) -> DataFrame:
    hits = index.where((F.col("index_type") == index_type) & (F.col("key") == key)).select(F.col("episode_id").alias("id"))
    return unique_episodes(episodes).join(hits, "id", "left_semi")


def unconsolidated(episodes: DataFrame, level: int, older_than: str) -> DataFrame:
    """Not consolidated yet and recorded strictly before the cut-off, oldest first."""
    found = unique_episodes(episodes).where((F.col("level") == level) & (F.col("recorded_at") < moment(older_than)) & F.col("consolidated_into").isNull())
    return found.orderBy("recorded_at", "id")


def mark_consolidated(episodes: DataFrame, marks: DataFrame) -> DataFrame:
    """``id``, ``consolidated_into`` after marks (``id``, ``into``) whose both ends exist."""
    one = unique_episodes(episodes).select("id", "consolidated_into")
    targets = one.select(F.col("id").alias("into"))
    valid = marks.join(targets, "into", "left_semi").groupBy("id").agg(F.min("into").alias("into"))
    return one.join(valid, "id", "left").select("id", F.coalesce("into", "consolidated_into").alias("consolidated_into"))
