"""Consolidation: clusters, summaries, patterns, readiness and pruning, as set operations.

Every operator takes its clock (``now``) as a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import HOUR_US, blank_to_null, micros, moment, unit_similarity


def episode_text() -> Column:
    """Content, summary, context and keywords joined by bars, absent parts left out."""
    keywords = F.when(F.size("keywords") > 0, F.concat(F.lit("Keywords: "), F.array_join("keywords", ", ")))
    return F.concat_ws(" | ", F.col("content"), F.concat(F.lit("Summary: "), blank_to_null("summary")), F.concat(F.lit("Context: "), blank_to_null("context_description")), keywords)


def cluster_temporal(episodes: DataFrame, key: str, max_gap_hours: int = 168, max_size: int = 5) -> DataFrame:
    """Sequential clusters by time: a new one after a gap longer than ``max_gap_hours`` or when the last is full.

    Gaps are always boundaries, so the place in a gapless run decides: two windows, no fold.
    Gives key, ``id``, ``run`` and ``part``; rows without time or key belong to none.
    """
    rows = episodes.where(F.col(key).isNotNull() & F.col("occurred_at").isNotNull()).select(key, "id", micros("occurred_at").alias("us"))
    w = Window.partitionBy(key).orderBy("us", "id")
    gap = (F.col("us") - F.lag("us").over(w)) > max_gap_hours * HOUR_US
    runs = rows.withColumn("run", F.sum(F.coalesce(gap, F.lit(False)).cast("long")).over(w))
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy("us", "id")) - 1
    return runs.select(key, "id", "us", "run", F.floor(place / max_size).cast("long").alias("part"))


def cluster_rollup(clusters: DataFrame, episodes: DataFrame, key: str) -> DataFrame:
    """One summary row per cluster of at least two: count, first and last time, hours, mean salience, united keywords and tags."""
    own = episodes.select("id", "salience", "keywords", "tags")
    joined = clusters.join(own, "id")
    none = F.array().cast("array<string>")

    def united(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), none)))))

    out = joined.groupBy(key, "run", "part").agg(
        F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.round(F.avg("salience"), 6).alias("salience"), united("keywords").alias("keywords"), united("tags").alias("tags"),
    )
    return out.where("n > 1").withColumn("hours", F.round((F.col("last_us") - F.col("first_us")) / HOUR_US, 6))


def pattern_strength(occurrences: Column, confidence: Column) -> Column:
    return F.least(F.lit(20.0), (5 + 2 * F.sqrt(occurrences)) * confidence)


def pattern_lifecycle(occurrences: Column) -> Column:
    return F.when(occurrences >= 10, "consolidated").when(occurrences >= 3, "established").otherwise("emerging")


def strengthen(patterns: DataFrame, seen: DataFrame) -> DataFrame:
    """Patterns with new occurrences (``pattern_id``, ``found``): confidence up 0.1 for each new one, to 1."""
    joined = patterns.join(seen, "pattern_id", "left")
    fresh = F.size(F.array_except(F.coalesce("found", F.col("occurrences")), "occurrences"))
    grown = F.least(F.lit(1.0), F.col("confidence") + 0.1 * fresh)
    return joined.select("pattern_id", fresh.cast("long").alias("n_new"), F.round(F.when(fresh > 0, grown).otherwise(F.col("confidence")), 6).alias("confidence"))


def weaken(patterns: DataFrame, recent: DataFrame) -> DataFrame:
    """Patterns none of whose occurrences is among the recent ids lose 0.05, not below 0.1 (a lower one stays).

    recent: ``id``.  A semi-join on exploded occurrences; the recent ids are never gathered.
    """
    seen = patterns.select("pattern_id", F.explode("occurrences").alias("id")).join(recent.select("id").distinct(), "id", "left_semi").select("pattern_id").distinct().withColumn("seen", F.lit(True))
    lower = F.greatest(F.lit(0.1), F.col("confidence") - 0.05)
    joined = patterns.join(seen, "pattern_id", "left")
    return joined.select("pattern_id", F.round(F.when(F.col("seen").isNull() & (lower < F.col("confidence")), lower).otherwise(F.col("confidence")), 6).alias("confidence"))


def strengthen_rows(patterns: DataFrame, occurrences: DataFrame, seen: DataFrame) -> DataFrame:
    """As :func:`strengthen`, with a row per occurrence (``pattern_id``, ``id``), so a pattern may have any number of them."""
    key = ["pattern_id", "id"]
    fresh = seen.select(*key).distinct().join(occurrences.select(*key), key, "left_anti").groupBy("pattern_id").agg(F.count("*").alias("n_new"))
    joined = patterns.join(fresh, "pattern_id", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)).cast("long"))
    grown = F.least(F.lit(1.0), F.col("confidence") + 0.1 * F.col("n_new"))
    return joined.withColumn("confidence", F.round(F.when(F.col("n_new") > 0, grown).otherwise(F.col("confidence")), 6))


def weaken_rows(patterns: DataFrame, occurrences: DataFrame, recent: DataFrame) -> DataFrame:
    """As :func:`weaken`, with a row per occurrence."""
    seen = occurrences.join(recent.select("id").distinct(), "id", "left_semi").select("pattern_id").distinct().withColumn("seen", F.lit(True))
    lower = F.greatest(F.lit(0.1), F.col("confidence") - 0.05)
    joined = patterns.join(seen, "pattern_id", "left")
    return joined.select("pattern_id", F.round(F.when(F.col("seen").isNull() & (lower < F.col("confidence")), lower).otherwise(F.col("confidence")), 6).alias("confidence"))


def match(candidates: DataFrame, patterns: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The best pattern of the same type for each candidate, the smaller id on ties, if alike enough."""
    c, p = candidates.alias("c"), patterns.alias("p")
    pairs = c.join(p, F.col("c.pattern_type") == F.col("p.pattern_type")).select("c.candidate_id", "p.pattern_id", F.round(unit_similarity(F.col("c.embedding"), F.col("p.embedding")), 9).alias("similarity"))
    w = Window.partitionBy("candidate_id").orderBy(F.desc("similarity"), "pattern_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where((F.col("rank") == 1) & (F.col("similarity") >= threshold)).drop("rank")


def detect_patterns(found: DataFrame, patterns: DataFrame, least: int = 3, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Patterns found (``candidate_id``, ``occurrences``, ...) against those known: the known ones with what they gained, and the new ones.

    A match adds its occurrences and 0.1 confidence for each new one; what matches none is new if it
    occurs ``least`` times.
    """
    hit = match(found, patterns, threshold).select("candidate_id", "pattern_id")
    seen = hit.join(found, "candidate_id").groupBy("pattern_id").agg(F.array_distinct(F.flatten(F.collect_list("occurrences"))).alias("found"), F.max("last_seen").alias("_last"))
    gained = strengthen(patterns, seen).select("pattern_id", "n_new", F.col("confidence").alias("_c"))
    grown = patterns.join(gained, "pattern_id").join(seen, "pattern_id", "left")
    grown = grown.withColumns({"confidence": F.col("_c"), "occurrences": F.array_union("occurrences", F.coalesce("found", F.col("occurrences"))), "last_seen": F.greatest("last_seen", "_last")}).drop("_c", "_last", "found")
    fresh = found.join(hit, "candidate_id", "left_anti").where(F.size("occurrences") >= least).drop("candidate_id")
    return grown, fresh


def description_similar(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or more than 0.7 of the smaller set of words shared."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    u, v = F.array_distinct(F.split(x, r"\s+")), F.array_distinct(F.split(y, r"\s+"))
    share = F.size(F.array_intersect(u, v)) / F.nullif(F.least(F.size(u), F.size(v)).cast("double"), F.lit(0.0))
    return (x == y) | F.contains(x, y) | F.contains(y, x) | (share > 0.7)


def should_abstract(stats: DataFrame, now: str, least: int = 3, age_hours: int = 24, coherence: float = 0.3) -> DataFrame:
    """stats: ``n``, ``oldest_us``, ``coherence``; adds ``ready``."""
    old = micros(moment(now)) - F.col("oldest_us") >= age_hours * HOUR_US
    return stats.withColumn("ready", (F.col("n") >= least) & old & (F.coalesce("coherence", F.lit(1.0)) >= coherence))


def should_run(episodes: DataFrame, last: str | None, now: str, least: int = 10, every_hours: int = 24) -> DataFrame:
    """One row: ``n_new`` raw episodes since the last cycle and whether one is due."""
    raw = episodes.where("level = 0")
    if last is None:
        return raw.agg(F.count_distinct("id").alias("n_new")).select("n_new", (F.col("n_new") >= least).alias("due"))
    due = micros(moment(now)) - micros(moment(last)) >= every_hours * HOUR_US
    return raw.where(F.col("recorded_at") > moment(last)).agg(F.count_distinct("id").alias("n_new")).select("n_new", (due | (F.col("n_new") >= least)).alias("due"))


def stale(episodes: DataFrame, now: str, days: int = 30, limit: int = 100) -> DataFrame:
    """The ``limit`` weakest episodes to prune: consolidated, unread raw ones past ``days``, or without strength."""
    old = F.col("occurred_at") < F.expr(f"timestamp_ntz'{now}' - interval {days} days")
    done = (F.col("level") == 0) & blank_to_null("parent_id").isNotNull() & (F.col("access_count") <= 0) & old
    return episodes.where(done | (F.col("consolidation_strength") <= 0)).orderBy("consolidation_strength", "access_count", "id").limit(limit)


def prune_cascade(episodes: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes and links that stay; parents that are gone become null, links at either end go."""
    ids = gone.select("id").distinct()
    left = episodes.join(ids, "id", "left_anti")
    lost = ids.select(F.col("id").alias("parent_id"), F.lit(True).alias("_lost"))
    left = left.join(lost, "parent_id", "left").withColumn("parent_id", F.when(F.col("_lost").isNull(), F.col("parent_id"))).drop("_lost")
    kept = links.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return left, kept
