"""Weighted links between episodes.  The key is (source, target, type); the newest row of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import latest, micros, moment
from tidemark.sources.tables import materialise, shuffle_partitions


def upserted(links: DataFrame) -> DataFrame:
    """One link per (source, target, type): the latest created, then the greatest id."""
    return latest(links.dropDuplicates(["id", "source_id", "target_id", "link_type", "weight", "created_at"]), ["source_id", "target_id", "link_type"], [F.desc("created_at"), F.desc("id"), F.desc("weight")])


def ends(links: DataFrame, link_type: str | None = None) -> DataFrame:
    """Each link from both of its ends: ``episode_id``, ``other_id``, ``link_id``, ``link_type``, ``weight``."""
    own = links.where(F.col("link_type") == link_type) if link_type is not None else links
    there = own.select(F.col("source_id").alias("episode_id"), F.col("target_id").alias("other_id"), F.col("id").alias("link_id"), "link_type", "weight")
    back = own.select(F.col("target_id").alias("episode_id"), F.col("source_id").alias("other_id"), F.col("id").alias("link_id"), "link_type", "weight")
    return there.unionByName(back.where("episode_id <> other_id"))


def linked_episodes(links: DataFrame, link_type: str | None = None) -> DataFrame:
    """The distinct other ends of each episode's links, itself excluded."""
    return ends(links, link_type).where("episode_id <> other_id").select("episode_id", "other_id").distinct()


def weight_delta(links: DataFrame, deltas: DataFrame, all_types: bool = False) -> DataFrame:
    """Adds ``delta`` to the link between ``a`` and ``b``, in either direction, with 0 as floor.

    Of several links of a pair the one with the smallest id is changed, or all with ``all_types``.
    """
    pair = links.withColumn("_a", F.least("source_id", "target_id")).withColumn("_b", F.greatest("source_id", "target_id"))
    change = deltas.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"), "delta").groupBy("_a", "_b").agg(F.sum("delta").alias("delta"))
    first = links.groupBy(F.least("source_id", "target_id").alias("_a"), F.greatest("source_id", "target_id").alias("_b")).agg(F.min("id").alias("_first"))
    joined = pair.join(change, ["_a", "_b"], "left").join(first, ["_a", "_b"])
    hit = F.col("delta").isNotNull() & (F.lit(all_types) | (F.col("id") == F.col("_first")))
    return joined.withColumn("weight", F.when(hit, F.greatest(F.lit(0.0), F.col("weight") + F.col("delta"))).otherwise(F.col("weight"))).drop("_a", "_b", "_first", "delta")


def neighbourhood(links: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Breadth-first: ``start_id``, ``episode_id``, ``distance`` up to ``depth``, the start excluded, each met once."""
    edges = linked_episodes(links)
    front = starts.select(F.col(starts.columns[0]).alias("start_id")).distinct().withColumn("episode_id", F.col("start_id"))
    seen, found = front, None
    for distance in range(1, depth + 1):
        step = front.join(edges, "episode_id").select("start_id", F.col("other_id").alias("episode_id")).distinct().join(seen, ["start_id", "episode_id"], "left_anti")
        front = materialise(step)
        level = front.withColumn("distance", F.lit(distance).cast("long"))
        found = level if found is None else found.unionByName(level)
        seen = seen.unionByName(front)
    return found


def decayed(links: DataFrame, rate: float = 0.1, floor: float = 0.1) -> DataFrame:
    """``weight * (1 - rate)``, no lower than ``floor``; ``changed`` tells whether it moved."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")
    if floor < 0:
        raise ValueError("floor must not be negative")
    new = F.greatest(F.lit(float(floor)), F.col("weight") * (1 - rate))
    return links.withColumn("changed", new != F.col("weight")).withColumn("weight", new)


def pruned(links: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The links that stay: weight not below the threshold."""
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    return links.where(F.col("weight") >= threshold)


def _spans(accessed: DataFrame, now: str, window_us: int, width: int) -> DataFrame:
    """The accesses of the last two windows, by id and bucket of ``width``: ``id``, ``bucket``, ``lo``, ``hi`` (first and last, in microseconds).

    Of two ids' accesses in different buckets the last of the one and the first of the other are nearest.
    """
    recent = accessed.where(F.col("at") >= F.timestamp_micros(F.unix_micros(moment(now).cast("timestamp")) - 2 * window_us).cast("timestamp_ntz"))
    rows = recent.where("id is not null").select("id", micros("at").alias("us"))
    return rows.groupBy("id", F.floor(F.col("us") / width).alias("bucket")).agg(F.min("us").alias("lo"), F.max("us").alias("hi"))


#: Buckets in a window, and rows of a bucket that are met at once: a row is sent once for so many pairs.
_STEPS, _ROWS = 4, 1024


def coaccess_pairs(accessed: DataFrame, now: str, window_us: int) -> DataFrame:
    """Unordered pairs of episodes accessed within ``window_us`` of each other, in the last two windows.

    A range join: each access looks into its own bucket of a part of the window and the next
    ones, by an equality; crowded buckets are dealt into blocks.  Ids in one bucket only, as
    all that were accessed once, meet once, so their pairs are never gathered to be told
    apart; only the pairs of other ids are.  accessed: ``id``, ``at``.
    """
    width = max(1, -(-window_us // _STEPS))
    spans = _spans(accessed, now, window_us, width)
    several = F.count("*").over(Window.partitionBy("id")) > 1
    rows = materialise(spans.withColumn("several", several))
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count("*") / _ROWS).alias("blocks"))
    n, again = rows.agg(F.count("*"), F.coalesce(F.bool_or("several"), F.lit(False))).first()
    tasks = max(shuffle_partitions(rows.sparkSession), -(-n // _ROWS))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        ahead = left.select(F.col("id").alias("a"), F.col("bucket").alias("own"), "hi", F.explode(F.sequence("bucket", F.col("bucket") + _STEPS)).alias("bucket"))
        sent = ahead.join(blocks, "bucket").select("a", "own", "hi", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        dealt = right.join(blocks, "bucket").select(F.col("id").alias("b"), "lo", "bucket", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
        # a number of tasks of their own: few bytes are sent, but many pairs follow
        key = ["bucket", "block"]
        joined = sent.repartition(tasks, *key).join(dealt.repartition(tasks, *key).hint("shuffle_hash"), key)
        same, later = (F.col("own") == F.col("bucket")) & (F.col("a") < F.col("b")), (F.col("own") < F.col("bucket")) & (F.col("a") != F.col("b")) & (F.col("lo") - F.col("hi") <= window_us)
        return joined.where(same | later).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    once, more = rows.where("not several"), rows.where("several")
    pairs = met(once, once)
    if again:
        pairs = pairs.unionByName(met(more, rows).unionByName(met(once, more)).distinct())
    return pairs


def coaccessed_links(links: DataFrame, accessed: DataFrame, now: str, window_us: int) -> DataFrame:
    """Those of :func:`coaccess_pairs` that some link joins; only the links' own ends are looked up, so no other pair is formed."""
    spans = _spans(accessed, now, window_us, max(1, window_us))
    ties = links.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).where("source_id <> target_id").distinct()
    one, two = (spans.select(F.col("id").alias(c), F.col("bucket").alias(f"{c}_bucket"), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi")) for c in ("a", "b"))
    both = ties.join(one, "a").join(two, "b")
    near = (F.col("a_bucket") == F.col("b_bucket")) | F.when(F.col("a_bucket") < F.col("b_bucket"), F.col("b_lo") - F.col("a_hi") <= window_us).otherwise(F.col("a_lo") - F.col("b_hi") <= window_us)
    return both.where(near).select("a", "b").distinct()


def strengthened(links: DataFrame, pairs: DataFrame, cap: float = 10.0) -> DataFrame:
    """``min(cap, w + 0.1 ln(2 + w))`` on the first link of each co-accessed pair (``a``, ``b``)."""
    pair = links.withColumn("_a", F.least("source_id", "target_id")).withColumn("_b", F.greatest("source_id", "target_id"))
    hit = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct().withColumn("_hit", F.lit(True))
    first = pair.groupBy("_a", "_b").agg(F.min("id").alias("_first"))
    joined = pair.join(hit, ["_a", "_b"], "left").join(first, ["_a", "_b"])
    grown = F.least(F.lit(cap), F.col("weight") + 0.1 * F.log(2 + F.col("weight")))
    use = F.col("_hit").isNotNull() & (F.col("id") == F.col("_first"))
    return joined.withColumn("strengthened", use).withColumn("weight", F.when(use, grown).otherwise(F.col("weight"))).drop("_a", "_b", "_first", "_hit")


def maintenance(links: DataFrame, pairs: DataFrame, rate: float = 0.1, floor: float = 0.1, threshold: float = 0.1) -> DataFrame:
    """Strengthen, decay, prune, in that order; one row of counts."""
    return maintenance_report(decayed(strengthened(links, pairs), rate, floor), threshold)


def maintenance_report(aged: DataFrame, threshold: float) -> DataFrame:
    """The counts of strengthened and decayed links, before those below the threshold go."""
    return aged.agg(
        F.count("*").alias("links_before"), F.count_if("strengthened").alias("strengthened"), F.count_if("changed").alias("decayed"),
        F.count_if(F.col("weight") < threshold).alias("pruned"), F.count_if(F.col("weight") >= threshold).alias("links_after"),
    )


def components(pairs: DataFrame) -> DataFrame:
    """``id``, ``component`` (the smallest id it is tied to) from undirected pairs (``a``, ``b``).

    Alternating large-star and small-star steps: edges are hung to ever smaller
    neighbours until nothing moves, in about log(n) rounds, whatever the diameter.
    Each round pre-aggregates the minimum of a node and writes its edges once.
    """
    edges = materialise(pairs.where("a is not null and b is not null").select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        tied = down.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
        fresh = materialise(small.where("u <> v").distinct())
        moved = not fresh.exceptAll(edges).isEmpty() or not edges.exceptAll(fresh).isEmpty()
        edges = fresh
        if not moved:
            break
    hung = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(hung, nodes["id"] == hung["u"], "left").select("id", F.coalesce("component", "id").alias("component"))
