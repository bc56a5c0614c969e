"""Queries over late events, hierarchies and intervals, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import hierarchy as H
from tidemark.operators import intervals as I
from tidemark.operators import kslack as K
from tidemark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "episodes").where("level = 0")
    return K.arrivals(raw, "id", "occurred_at", "recorded_at", "salience")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.late_cases(_raw_events(spark, sf_dir))


def p1_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.daily_figures(_raw_events(spark, sf_dir))


def p1_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.provisional_figures(_raw_events(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.hierarchy(table(spark, sf_dir, "episodes"))
    return tree.where("parent is not null").select("id", "root_id", "depth", "state")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.hierarchy(table(spark, sf_dir, "episodes"), with_paths=True)
    return tree.select("id", "root_id", "depth", "state", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(H.hierarchy(table(spark, sf_dir, "episodes"), with_paths=True))


_FACT_KEYS = ["subject_id", "predicate"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.gaps(table(spark, sf_dir, "facts").where("invalidated_at is null"), _FACT_KEYS)


def p6_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.periods(table(spark, sf_dir, "facts").where("invalidated_at is null"), _FACT_KEYS)


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p1_daily": p1_daily, "p1_provisional": p1_provisional, "p5_found": p5_found, "p5_paths": p5_paths,
    "p5_descendants": p5_descendants, "p6_found": p6_found, "p6_periods": p6_periods,
}

_EVENTS = """
WITH ranked AS (
  SELECT id, epoch_us(occurred_at) AS event_us, epoch_us(recorded_at) AS arrival_us, salience,
         row_number() OVER (PARTITION BY id ORDER BY recorded_at, occurred_at, salience NULLS FIRST) AS rn
  FROM episodes WHERE level = 0 AND id IS NOT NULL AND occurred_at IS NOT NULL AND recorded_at IS NOT NULL),
ev AS (
  SELECT id, event_us, arrival_us, salience, (event_us // 86400000000 + 1) * 86400000000 AS closes_us,
         strftime(make_timestamp(event_us), '%Y-%m-%d') AS period_day
  FROM ranked WHERE rn = 1)
"""

_TREE = """
WITH RECURSIVE nodes AS (
  SELECT id, min(nullif(parent_id, '')) AS parent FROM episodes WHERE id IS NOT NULL GROUP BY id),
tops AS (
  SELECT n.id, n.parent FROM nodes n LEFT JOIN nodes p ON n.parent = p.id WHERE p.id IS NULL),
tree AS (
  SELECT id, id AS root_id, 0::BIGINT AS depth, id AS path FROM tops
  UNION ALL
  SELECT n.id, t.root_id, t.depth + 1, t.path || '/' || n.id FROM nodes n JOIN tree t ON n.parent = t.id),
rest AS (
  SELECT n.id, n.parent FROM nodes n WHERE n.id NOT IN (SELECT id FROM tree)),
chain AS (
  SELECT id, parent AS anc FROM rest
  UNION
  SELECT c.id, r.parent FROM chain c JOIN rest r ON c.anc = r.id),
all_nodes AS (
  SELECT t.id, n.parent, t.root_id, t.depth, t.path,
         CASE WHEN t.depth > 0 THEN 'tree' WHEN n.parent IS NULL THEN 'root' ELSE 'orphan' END AS state
  FROM tree t JOIN nodes n ON n.id = t.id
  UNION ALL
  SELECT r.id, r.parent, '', -1, '', CASE WHEN EXISTS (SELECT 1 FROM chain c WHERE c.id = r.id AND c.anc = r.id) THEN 'cycle' ELSE 'below' END
  FROM rest r)
"""

_HELD = """
WITH held AS (
  SELECT subject_id, predicate, coalesce(epoch_us(valid_from), -9223372036854775808) AS lo, coalesce(epoch_us(valid_to), 9223372036854775807) AS hi
  FROM facts WHERE invalidated_at IS NULL AND (valid_from IS NULL OR valid_to IS NULL OR valid_from < valid_to)),
reach AS (
  SELECT *, max(hi) OVER (PARTITION BY subject_id, predicate ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM held)
"""

SQL: dict[str, str] = {
    "p1_found": _EVENTS + """
SELECT id, period_day, CASE WHEN arrival_us > closes_us + 72 * 3600000000 THEN 'dropped' ELSE 'late' END AS outcome
FROM ev WHERE arrival_us > closes_us""",
    "p1_daily": _EVENTS + """,
kept AS (
  SELECT *, event_us - lag(event_us) OVER w AS gap, salience > lag(salience IGNORE NULLS) OVER w AS rose
  FROM ev WHERE arrival_us <= closes_us + 72 * 3600000000 WINDOW w AS (PARTITION BY period_day ORDER BY event_us, id))
SELECT period_day, count(*) AS n_events, count(*) FILTER (WHERE arrival_us > closes_us) AS n_late,
       coalesce(sum(round_even(salience * 1e6, 0)::BIGINT), 0)::BIGINT AS sum_micro, min(event_us) AS first_us, max(event_us) AS last_us,
       coalesce(max(gap), 0) AS max_gap_us, count(*) FILTER (WHERE rose) AS n_rises
FROM kept GROUP BY period_day""",
    "p1_provisional": _EVENTS + """
SELECT period_day, closes_us + step * 3600000000 AS published_us, count(*) AS n_events, coalesce(sum(round_even(salience * 1e6, 0)::BIGINT), 0)::BIGINT AS sum_micro
FROM ev, (SELECT unnest([0, 24, 48, 72]) AS step) WHERE arrival_us <= closes_us + step * 3600000000 GROUP BY period_day, closes_us, step""",
    "p5_found": _TREE + "SELECT id, root_id, depth, state FROM all_nodes WHERE parent IS NOT NULL",
    "p5_paths": _TREE + "SELECT id, root_id, depth, state, path FROM all_nodes",
    "p5_descendants": _TREE + """
, split AS (SELECT id, depth, string_split(path, '/') AS steps FROM all_nodes WHERE depth > 0)
SELECT a.up AS ancestor_id, s.id AS descendant_id, s.depth - a.at + 1 AS distance
FROM split s, LATERAL (SELECT unnest(s.steps) AS up, unnest(range(1, len(s.steps) + 1)) AS at) a WHERE a.at <= s.depth""",
    "p6_found": _HELD + "SELECT subject_id, predicate, ended AS gap_from_us, lo AS gap_to_us FROM reach WHERE lo > ended",
    "p6_periods": _HELD + """,
marked AS (
  SELECT *, sum(CASE WHEN ended IS NULL OR lo > ended THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, predicate ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM reach)
SELECT subject_id, predicate, nullif(min(lo), -9223372036854775808) AS from_us, nullif(max(hi), 9223372036854775807) AS to_us
FROM marked GROUP BY subject_id, predicate, island""",
}
