"""Queries of the memory engine over the domain tables, with the SQL that checks them.

The clock and query times are parameters of the operators; here they are fixed moments
inside the tables' range, so results can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import consolidation as K
from tidemark.operators import curation as U
from tidemark.operators import entities as E
from tidemark.operators import episodes as P
from tidemark.operators import folds as FD
from tidemark.operators import links as L
from tidemark.operators import retrieval as R
from tidemark.operators import temporal as T
from tidemark.operators import vectors as V
from tidemark.operators import working as W
from tidemark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AT, LATER, NOW = "2025-01-15 00:00:00", "2025-06-01 00:00:00", "2026-01-01 00:00:00"
BUDGET = 200


def query(name: str, sql: str | None = None) -> Callable:
    def add(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


# ---------------------------------------------------------------- facts
_FACT = "id, subject_id, predicate, recorded_at"


@query("facts_current", f"SELECT {_FACT} FROM facts WHERE invalidated_at IS NULL")
def _(s, d):
    return T.facts_current(table(s, d, "facts")).select(*_FACT.split(", "))


@query("facts_by_predicate", "SELECT predicate, count(*) AS n, count(DISTINCT subject_id) AS subjects FROM facts WHERE invalidated_at IS NULL GROUP BY predicate")
def _(s, d):
    return T.facts_current(table(s, d, "facts")).groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("subjects"))


_AS_OF = f"recorded_at <= TIMESTAMP '{AT}' AND (invalidated_at IS NULL OR invalidated_at > TIMESTAMP '{AT}')"
_VALID = f"(valid_from IS NULL OR valid_from <= TIMESTAMP '{LATER}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{LATER}')"


@query("facts_as_of", f"SELECT {_FACT} FROM facts WHERE {_AS_OF}")
def _(s, d):
    return T.facts_as_of(table(s, d, "facts"), AT).select(*_FACT.split(", "))


@query("facts_valid_at", f"SELECT {_FACT} FROM facts WHERE {_VALID}")
def _(s, d):
    return T.facts_valid_at(table(s, d, "facts"), LATER).select(*_FACT.split(", "))


@query("facts_bitemporal", f"SELECT {_FACT} FROM facts WHERE {_AS_OF} AND {_VALID}")
def _(s, d):
    return T.facts_bitemporal(table(s, d, "facts"), AT, LATER).select(*_FACT.split(", "))


@query("fact_history", """
WITH h AS (SELECT id, subject_id, predicate, coalesce(object_id, object_value) AS obj, row_number() OVER w AS step, lag(coalesce(object_id, object_value)) OVER w AS before
  FROM facts WINDOW w AS (PARTITION BY subject_id, predicate ORDER BY recorded_at, id, valid_from NULLS FIRST, valid_to NULLS FIRST))
SELECT id, subject_id, predicate, step, step = 1 OR obj IS DISTINCT FROM before AS changed FROM h""")
def _(s, d):
    return T.fact_history(table(s, d, "facts")).select("id", "subject_id", "predicate", F.col("step").cast("long").alias("step"), "changed")


@query("facts_as_of_batch", """
WITH q AS (SELECT DISTINCT id AS subject_id, created_at + INTERVAL 180 DAY AS asked_at FROM entities)
SELECT q.subject_id, q.asked_at, f.id, f.predicate FROM facts f JOIN q ON f.subject_id = q.subject_id AND f.recorded_at <= q.asked_at AND (f.invalidated_at IS NULL OR f.invalidated_at > q.asked_at)""")
def _(s, d):
    asked = table(s, d, "entities").select(F.col("id").alias("subject_id"), F.expr("created_at + interval 180 days").alias("asked_at")).distinct()
    return T.facts_as_of_batch(table(s, d, "facts"), asked)


@query("fact_invalidate", f"SELECT id, subject_id, CASE WHEN id IN (SELECT id FROM facts WHERE confidence < 0.5) THEN TIMESTAMP '{NOW}' ELSE invalidated_at END AS invalidated_at FROM facts")
def _(s, d):
    facts = table(s, d, "facts")
    return T.invalidate(facts, facts.where("confidence < 0.5"), NOW).select("id", "subject_id", "invalidated_at")


@query("facts_latest", "SELECT id, max(recorded_at) AS recorded_at FROM facts GROUP BY id")
def _(s, d):
    return T.latest_facts(table(s, d, "facts")).select("id", "recorded_at")


_LATEST_FACTS = "WITH one AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC, invalidated_at DESC NULLS LAST) = 1)"


@query("fact_conflicts", _LATEST_FACTS + """,
live AS (SELECT id, subject_id, predicate, nullif(object_id, '') AS oid, nullif(object_value, '') AS val FROM one WHERE invalidated_at IS NULL)
SELECT a.subject_id, a.predicate, count(*) AS n_pairs FROM live a JOIN live b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.id < b.id
WHERE CASE WHEN a.oid IS NOT NULL AND b.oid IS NOT NULL THEN a.oid <> b.oid WHEN a.oid IS NULL AND b.oid IS NULL THEN coalesce(a.val <> b.val, false) WHEN a.oid IS NULL THEN a.val IS NOT NULL ELSE b.val IS NOT NULL END
GROUP BY ALL""")
def _(s, d):
    return T.fact_conflicts(table(s, d, "facts"))


@query("fact_conflicts_overlap", _LATEST_FACTS + """,
live AS (SELECT id, subject_id, predicate, CASE WHEN nullif(object_id, '') IS NOT NULL THEN 'id ' || object_id ELSE 'value ' || nullif(object_value, '') END AS obj, coalesce(epoch_us(valid_from), -4611686018427387904) AS lo, coalesce(epoch_us(valid_to), 4611686018427387904) AS hi
  FROM one WHERE invalidated_at IS NULL AND (valid_from IS NULL OR valid_to IS NULL OR valid_from < valid_to))
SELECT subject_id, predicate, count(*) AS n_facts FROM live f WHERE EXISTS (
  SELECT 1 FROM live e WHERE e.subject_id = f.subject_id AND e.predicate = f.predicate AND e.obj <> f.obj AND e.hi > f.lo AND (e.lo, e.hi, e.id) < (f.lo, f.hi, f.id))
GROUP BY ALL""")
def _(s, d):
    return T.fact_conflicts(table(s, d, "facts"), require_overlap=True)


@query("apply_resolution", f"SELECT id, CASE WHEN id IN (SELECT id FROM facts WHERE confidence >= 0.5 AND predicate IS NOT NULL) THEN TIMESTAMP '{NOW}' ELSE invalidated_at END AS invalidated_at FROM facts")
def _(s, d):
    facts = table(s, d, "facts")
    name = F.when(F.col("confidence") >= 0.5, "temporal_succession").otherwise("guess")  # no strategy: not applied
    answer = F.concat(F.lit('{"strategy": "'), name, F.lit('", "invalidations": ["'), F.col("id"), F.lit('"]}'))
    parsed = U.parse_resolution(facts.where("predicate is not null").select("id", answer.alias("answer")), "answer")
    return T.apply_resolution(facts, parsed, NOW).select("id", "invalidated_at")


@query("conflicting_pairs", _LATEST_FACTS + f""",
live AS (SELECT id, subject_id, predicate, recorded_at, CASE WHEN nullif(object_id, '') IS NOT NULL THEN 'id ' || object_id ELSE 'value ' || nullif(object_value, '') END AS obj FROM one WHERE invalidated_at IS NULL)
SELECT n.id AS new_id, o.id AS old_id FROM live n JOIN live o ON n.subject_id = o.subject_id AND n.predicate = o.predicate AND n.obj <> o.obj AND (o.recorded_at, o.id) < (n.recorded_at, n.id) WHERE n.recorded_at >= TIMESTAMP '{LATER}'""")
def _(s, d):
    live = T.latest_facts(table(s, d, "facts")).where("invalidated_at is null")
    return T.conflicting_pairs(live, live.where(F.col("recorded_at") >= C.moment(LATER))).select("new_id", "old_id")


@query("fact_by_id", _LATEST_FACTS + " SELECT id, subject_id, recorded_at FROM one WHERE confidence < 0.5")
def _(s, d):
    facts = T.latest_facts(table(s, d, "facts"))
    return T.fact_by_id(table(s, d, "facts"), facts.where("confidence < 0.5").select("id")).select("id", "subject_id", "recorded_at")


# ---------------------------------------------------------------- sources, sinks, ids
@query("count_where", "SELECT count(*) AS n, count(*) FILTER (WHERE confidence >= 0.8) AS confident FROM facts WHERE predicate IS NOT NULL")
def _(s, d):
    return table(s, d, "facts").where("predicate is not null").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("confident"))


@query("json_extract", "SELECT event_id, props->>'$.k' AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("row_decode", "SELECT DISTINCT id, coalesce(len(keywords), 0)::BIGINT AS n_keywords, coalesce(len(tags), 0)::BIGINT AS n_tags, metadata IS NULL OR metadata = '{}' AS bare FROM episodes")
def _(s, d):
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return table(s, d, "episodes").select("id", n("keywords").alias("n_keywords"), n("tags").alias("n_tags"), (F.col("metadata").isNull() | (F.col("metadata") == "{}")).alias("bare")).distinct()


_TABLES = ("entities", "facts", "episodes", "episode_links")


@query("export_statistics", " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM {t}" for t in _TABLES))
def _(s, d):
    out = None
    for t in _TABLES:
        one = table(s, d, t).agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids")).select(F.lit(t).alias("tbl"), "n_rows", "n_ids")
        out = one if out is None else out.unionByName(one)
    return out


@query("collection_stats", "SELECT label, count(*) AS n, min(len(embedding))::BIGINT AS dims FROM embeddings GROUP BY label")
def _(s, d):
    return table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dims"))


@query("valid_ids", "SELECT 'entities' AS tbl, count(*) FILTER (WHERE NOT regexp_full_match(id, 'ent_[a-f0-9\\-]+')) AS bad FROM entities UNION ALL SELECT 'episodes', count(*) FILTER (WHERE NOT regexp_full_match(id, 'epi_[a-f0-9\\-]+')) FROM episodes UNION ALL SELECT 'facts', count(*) FILTER (WHERE NOT regexp_full_match(id, 'fct_[a-f0-9\\-]+')) FROM facts")
def _(s, d):
    parts = [("entities", E.ENTITY_ID), ("episodes", E.EPISODE_ID), ("facts", E.FACT_ID)]
    out = None
    for t, p in parts:
        one = E.invalid_ids(table(s, d, t), "id", p).agg(F.count("*").alias("bad")).select(F.lit(t).alias("tbl"), "bad")
        out = one if out is None else out.unionByName(one)
    return out


@query("dangling_references", "SELECT 'subject' AS ref, count(*) AS n FROM facts WHERE subject_id <> '' AND subject_id NOT IN (SELECT id FROM entities) UNION ALL SELECT 'source', count(*) FROM episode_links WHERE source_id <> '' AND source_id NOT IN (SELECT id FROM episodes) UNION ALL SELECT 'target', count(*) FROM episode_links WHERE target_id <> '' AND target_id NOT IN (SELECT id FROM episodes)")
def _(s, d):
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("ref"), "n")
    links, epi = table(s, d, "episode_links"), table(s, d, "episodes")
    return n("subject", E.dangling(table(s, d, "facts"), "subject_id", table(s, d, "entities"))).unionByName(n("source", E.dangling(links, "source_id", epi))).unionByName(n("target", E.dangling(links, "target_id", epi)))


@query("duplicate_ids", "SELECT id, count(*) AS n FROM facts GROUP BY id HAVING count(*) > 1")
def _(s, d):
    return E.duplicates(table(s, d, "facts"))


@query("status_counts", """
SELECT 'entities' AS what, count(DISTINCT id) AS n FROM entities UNION ALL SELECT 'facts', count(DISTINCT id) FROM facts UNION ALL SELECT 'links', count(DISTINCT id) FROM episode_links
UNION ALL SELECT 'episodes_L' || level, count(DISTINCT id) FROM episodes GROUP BY level""")
def _(s, d):
    n = lambda name, t: table(s, d, t).agg(F.count_distinct("id").alias("n")).select(F.lit(name).alias("what"), "n")
    by_level = table(s, d, "episodes").groupBy("level").agg(F.count_distinct("id").alias("n")).select(F.concat(F.lit("episodes_L"), F.col("level").cast("string")).alias("what"), "n")
    return n("entities", "entities").unionByName(n("facts", "facts")).unionByName(n("links", "episode_links")).unionByName(by_level)


# ---------------------------------------------------------------- entities
_ONE_ENTITY = "WITH ent AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, name) = 1)"


@query("entity_by_id", _ONE_ENTITY + " SELECT id, name, entity_type FROM ent WHERE id IN (SELECT object_id FROM facts)")
def _(s, d):
    return E.look_up(E.unique_entities(table(s, d, "entities")), table(s, d, "facts").select("object_id")).select("id", "name", "entity_type")


@query("entity_find", _ONE_ENTITY + " SELECT id, name, created_at FROM ent WHERE contains(lower(name), 'son') OR contains(lower(name), 'an')")
def _(s, d):
    ent = table(s, d, "entities")
    return E.find(ent, "SON").unionByName(E.find(ent, "an")).select("id", "name", "created_at").distinct()


@query("entity_find_typed", _ONE_ENTITY + " SELECT id, name, created_at FROM ent WHERE contains(lower(name), 'a') AND lower(trim(entity_type)) = 'person'")
def _(s, d):
    return E.find(table(s, d, "entities"), "a", "person").select("id", "name", "created_at")


@query("entity_access_rollup", _ONE_ENTITY + """, log AS (SELECT subject_id AS id, count(*) AS n, max(recorded_at) AS "at" FROM facts GROUP BY 1)
SELECT e.id, coalesce(access_count, 0) + coalesce(n, 0) AS access_count, greatest(last_accessed, "at") AS last_accessed FROM ent e LEFT JOIN log l ON e.id = l.id""")
def _(s, d):
    log = table(s, d, "facts").select(F.col("subject_id").alias("id"), F.col("recorded_at").alias("at"))
    return E.access_rollup(E.unique_entities(table(s, d, "entities")), log)


def _communities(s, d):
    """A row per member; a type is a community."""
    return E.unique_entities(table(s, d, "entities")).select(F.lower(F.trim("entity_type")).alias("community_id"), "id")


@query("community_members", _ONE_ENTITY + " SELECT lower(trim(entity_type)) AS community_id, id, name, created_at FROM ent")
def _(s, d):
    return E.member_names(_communities(s, d), table(s, d, "entities")).select("community_id", "id", "name", "created_at")


@query("community_add", _ONE_ENTITY + ", com AS (SELECT lower(trim(entity_type)) AS community_id, id FROM ent) SELECT community_id, count(DISTINCT id) AS n, bool_or(id = 'ent_new') AS added FROM (SELECT * FROM com UNION SELECT DISTINCT community_id, 'ent_new' FROM com UNION SELECT community_id, min(id) FROM com GROUP BY 1) GROUP BY 1")
def _(s, d):
    com = _communities(s, d)
    there = com.groupBy("community_id").agg(F.min("id").alias("id"))  # members already
    grown = E.add_members(com, com.select("community_id", F.lit("ent_new").alias("id")).unionByName(there))
    return grown.groupBy("community_id").agg(F.count("*").alias("n"), F.max(F.col("id") == "ent_new").alias("added"))


@query("entity_resolve", _ONE_ENTITY + """, k AS (SELECT id, lower(trim(name)) AS n, lower(trim(entity_type)) AS t FROM ent),
m AS (SELECT a.id AS new_id, b.id, levenshtein(a.n, b.n) AS edits, row_number() OVER (PARTITION BY a.id ORDER BY levenshtein(a.n, b.n), b.id) AS rn FROM k a JOIN k b ON a.t = b.t AND a.id <> b.id WHERE abs(length(a.n) - length(b.n)) <= 1 AND levenshtein(a.n, b.n) <= 1)
SELECT new_id, id, edits FROM m WHERE rn = 1""")
def _(s, d):
    one = E.unique_entities(table(s, d, "entities"))
    # each entity against all others: an entity is not its own match
    return E.resolve(one, one, others_only=True)


# ---------------------------------------------------------------- episodes
_ONE_EPISODE = "epi AS (SELECT * FROM episodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at NULLS LAST, parent_id NULLS FIRST) = 1)"


@query("episode_by_id", f"WITH {_ONE_EPISODE} SELECT id, level, salience FROM epi WHERE id IN (SELECT source_episode_id FROM facts)")
def _(s, d):
    return E.look_up(P.unique_episodes(table(s, d, "episodes")), table(s, d, "facts").select("source_episode_id")).select("id", "level", "salience")


@query("episode_children", f"WITH {_ONE_EPISODE} SELECT parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY occurred_at NULLS LAST, id) AS at, id FROM epi WHERE parent_id <> '' AND parent_id IN (SELECT id FROM epi)")
def _(s, d):
    return P.children(table(s, d, "episodes"))


@query("episode_parent", f"WITH {_ONE_EPISODE} SELECT e.id, p.id AS parent_id, p.level AS parent_level, p.summary AS parent_summary FROM epi e LEFT JOIN epi p ON p.id = nullif(e.parent_id, '')")
def _(s, d):
    return P.parent_of(table(s, d, "episodes"))


@query("episode_ancestors", """
WITH RECURSIVE nodes AS (SELECT id, min(nullif(parent_id, '')) AS parent FROM episodes GROUP BY id),
tree AS (SELECT n.id, [n.id] AS path FROM nodes n LEFT JOIN nodes p ON n.parent = p.id WHERE p.id IS NULL UNION ALL SELECT n.id, list_append(t.path, n.id) FROM nodes n JOIN tree t ON n.parent = t.id)
SELECT id, path[1] AS root_id, len(path) - 1 AS n_ancestors FROM tree""")
def _(s, d):
    from tidemark.operators.hierarchy import hierarchy

    tree = hierarchy(table(s, d, "episodes"), with_paths=True).where("depth >= 0")
    return tree.select("id", F.get("path", F.lit(0)).alias("root_id"), (F.size("path") - 1).cast("long").alias("n_ancestors"))


@query("episode_recent", f"WITH {_ONE_EPISODE} SELECT id, occurred_at FROM epi WHERE level = 0 ORDER BY occurred_at DESC NULLS LAST, id LIMIT 10")
def _(s, d):
    return P.recent(table(s, d, "episodes")).select("id", "occurred_at")


@query("episode_recent_per_level", f"WITH {_ONE_EPISODE} SELECT level, id, row_number() OVER (PARTITION BY level ORDER BY occurred_at DESC NULLS LAST, id) AS rank FROM epi QUALIFY rank <= 10")
def _(s, d):
    return P.recent_per_level(table(s, d, "episodes")).select("level", "id", F.col("rank").cast("long").alias("rank"))


@query("episode_temporal", f"SELECT DISTINCT id FROM episodes WHERE occurred_at <= TIMESTAMP '{LATER}' AND recorded_at <= TIMESTAMP '{LATER}'")
def _(s, d):
    return P.temporal(table(s, d, "episodes"), LATER, LATER).select("id").distinct()


@query("index_keys", f"WITH {_ONE_EPISODE} SELECT key, count(DISTINCT id) AS n FROM (SELECT id, unnest(keywords) AS key FROM epi) WHERE key IS NOT NULL GROUP BY key")
def _(s, d):
    return P.inverted_index(table(s, d, "episodes"), "keyword", "keywords").groupBy("key").agg(F.count("*").alias("n"))


@query("index_lookup", f"WITH {_ONE_EPISODE} SELECT id, level FROM epi WHERE list_contains(tags, 'masonry') OR list_contains(keywords, 'vault')")
def _(s, d):
    epi = table(s, d, "episodes")
    index = P.inverted_index(epi, "keyword", "keywords").unionByName(P.inverted_index(epi, "tag", "tags"))
    return P.index_lookup(index, epi, "tag", "masonry").unionByName(P.index_lookup(index, epi, "keyword", "vault")).select("id", "level").distinct()


@query("episode_access_rollup", f"WITH {_ONE_EPISODE}, log AS (SELECT source_episode_id AS id, count(*) AS n, max(recorded_at) AS seen FROM facts GROUP BY 1) SELECT e.id, coalesce(access_count, 0) + coalesce(n, 0) AS access_count, greatest(last_accessed, seen) AS last_accessed FROM epi e LEFT JOIN log l ON e.id = l.id")
def _(s, d):
    log = table(s, d, "facts").select(F.col("source_episode_id").alias("id"), F.col("recorded_at").alias("at")).where("id is not null")
    return E.access_rollup(P.unique_episodes(table(s, d, "episodes")), log)


@query("episode_unconsolidated", f"WITH {_ONE_EPISODE} SELECT id, recorded_at FROM epi WHERE level = 0 AND recorded_at < TIMESTAMP '{LATER}' AND consolidated_into IS NULL")
def _(s, d):
    return P.unconsolidated(table(s, d, "episodes"), 0, LATER).select("id", "recorded_at")


@query("mark_consolidated", f"WITH {_ONE_EPISODE} SELECT id, CASE WHEN level = 0 AND parent_id IN (SELECT id FROM epi) THEN parent_id ELSE consolidated_into END AS consolidated_into FROM epi")
def _(s, d):
    epi = P.unique_episodes(table(s, d, "episodes"))
    return P.mark_consolidated(table(s, d, "episodes"), epi.where("level = 0").select("id", F.col("parent_id").alias("into")))


@query("embedding_text", f"WITH {_ONE_EPISODE} SELECT id, concat_ws(' ', content, summary, array_to_string(keywords, ' ')) AS document FROM epi")
def _(s, d):
    return P.unique_episodes(table(s, d, "episodes")).select("id", F.concat_ws(" ", "content", "summary", F.array_join("keywords", " ")).alias("document"))


# ---------------------------------------------------------------- links
_ONE_LINK = "lnk AS (SELECT * FROM (SELECT DISTINCT * FROM episode_links) QUALIFY row_number() OVER (PARTITION BY source_id, target_id, link_type ORDER BY created_at DESC NULLS LAST, id DESC, weight DESC NULLS LAST) = 1)"
_ENDS = "ends AS (SELECT source_id AS episode_id, target_id AS other_id, id AS link_id, link_type, weight FROM lnk UNION ALL SELECT target_id, source_id, id, link_type, weight FROM lnk WHERE source_id <> target_id)"


@query("link_upsert", f"WITH {_ONE_LINK} SELECT id, source_id, target_id, link_type, weight FROM lnk")
def _(s, d):
    return L.upserted(table(s, d, "episode_links")).select("id", "source_id", "target_id", "link_type", "weight")


@query("links_of", f"WITH {_ONE_LINK}, {_ENDS} SELECT episode_id, link_id, weight FROM ends")
def _(s, d):
    return L.ends(L.upserted(table(s, d, "episode_links"))).select("episode_id", "link_id", "weight")


@query("links_of_type", f"WITH {_ONE_LINK}, {_ENDS} SELECT episode_id, link_id, weight FROM ends WHERE link_type = 'semantic'")
def _(s, d):
    return L.ends(L.upserted(table(s, d, "episode_links")), "semantic").select("episode_id", "link_id", "weight")


@query("linked_episodes", f"WITH {_ONE_LINK}, {_ENDS} SELECT DISTINCT episode_id, other_id FROM ends WHERE episode_id <> other_id")
def _(s, d):
    return L.linked_episodes(L.upserted(table(s, d, "episode_links")))


@query("link_weight_delta", f"""
WITH {_ONE_LINK}, f AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, min(id) AS first FROM lnk GROUP BY ALL),
x AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM lnk WHERE link_type = 'causal')
SELECT l.id, CASE WHEN x.a IS NOT NULL AND l.id = f.first THEN greatest(0.0::DOUBLE, weight + -0.25::DOUBLE) ELSE weight END AS weight
FROM lnk l JOIN f ON f.a = least(source_id, target_id) AND f.b = greatest(source_id, target_id) LEFT JOIN x ON x.a = f.a AND x.b = f.b""")
def _(s, d):
    links = L.upserted(table(s, d, "episode_links"))
    pairs = links.where("link_type = 'causal'").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    return L.weight_delta(links, pairs.withColumn("delta", F.lit(-0.25))).select("id", "weight")


def _starts(s, d):
    """The ten most read episodes: a top-k report's start set."""
    return P.unique_episodes(table(s, d, "episodes")).orderBy(F.desc("access_count"), "id").limit(10).select("id")


_BFS = f"WITH {_ONE_EPISODE}, {_ONE_LINK}, {_ENDS}, edges AS (SELECT DISTINCT episode_id, other_id FROM ends WHERE episode_id <> other_id), st AS (SELECT id AS start_id FROM epi ORDER BY access_count DESC NULLS LAST, id LIMIT 10), one AS (SELECT start_id, other_id AS episode_id FROM st JOIN edges ON episode_id = start_id)"


@query("related_depth1", f"WITH {_ONE_EPISODE}, {_ONE_LINK}, {_ENDS} SELECT DISTINCT episode_id AS start_id, other_id AS episode_id, 1::BIGINT AS distance FROM ends WHERE episode_id <> other_id AND episode_id IN (SELECT id FROM epi)")
def _(s, d):
    return L.neighbourhood(L.upserted(table(s, d, "episode_links")), P.unique_episodes(table(s, d, "episodes")).select("id"), 1)


@query("related_depth2", _BFS + ", two AS (SELECT DISTINCT start_id, e.other_id AS episode_id FROM one JOIN edges e ON e.episode_id = one.episode_id WHERE e.other_id <> start_id) SELECT start_id, episode_id, 1::BIGINT AS distance FROM one UNION ALL SELECT start_id, episode_id, 2 FROM two WHERE (start_id, episode_id) NOT IN (SELECT start_id, episode_id FROM one)")
def _(s, d):
    return L.neighbourhood(L.upserted(table(s, d, "episode_links")), _starts(s, d), 2)


@query("link_components")
def _(s, d):
    links = L.upserted(table(s, d, "episode_links"))
    return L.components(links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@query("link_decay", f"WITH {_ONE_LINK} SELECT id, round(greatest(0.1::DOUBLE, weight * 0.9::DOUBLE), 9) AS weight FROM lnk")
def _(s, d):
    return L.decayed(L.upserted(table(s, d, "episode_links"))).select("id", F.round("weight", 9).alias("weight"))


@query("link_prune", f"WITH {_ONE_LINK} SELECT id FROM lnk WHERE weight >= 0.15")
def _(s, d):
    return L.pruned(L.upserted(table(s, d, "episode_links")), 0.15).select("id")


def _accessed(s, d):
    return P.unique_episodes(table(s, d, "episodes")).where("last_accessed is not null").select("id", F.col("last_accessed").alias("at"))


_HOURS = 480
_CO = f"""{_ONE_EPISODE}, acc AS (SELECT id, epoch_us(last_accessed) AS us FROM epi WHERE last_accessed >= TIMESTAMP '{NOW}' - INTERVAL {2 * _HOURS} HOUR),
co AS (SELECT a.id AS a, b.id AS b FROM acc a JOIN acc b ON a.id < b.id AND abs(a.us - b.us) <= {_HOURS * C.HOUR_US})"""


@query("coaccess_pairs", f"WITH {_CO} SELECT a, b FROM co")
def _(s, d):
    return L.coaccess_pairs(_accessed(s, d), NOW, _HOURS * C.HOUR_US)


_FIRST = "f AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, min(id) AS first FROM lnk GROUP BY ALL)"
_GROWN = f"""WITH {_CO}, {_ONE_LINK}, {_FIRST}, hit AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM co),
grown AS (SELECT l.id, hit.a IS NOT NULL AND l.id = f.first AS strengthened, CASE WHEN hit.a IS NOT NULL AND l.id = f.first THEN least(10.0::DOUBLE, weight + 0.1::DOUBLE * ln(2 + weight)) ELSE weight END AS weight
  FROM lnk l JOIN f ON f.a = least(source_id, target_id) AND f.b = greatest(source_id, target_id) LEFT JOIN hit ON hit.a = f.a AND hit.b = f.b)"""


def _pairs(s, d, links):
    """Linked episodes that were accessed together."""
    return L.coaccessed_links(links, _accessed(s, d), NOW, _HOURS * C.HOUR_US)


@query("link_strengthen", _GROWN + " SELECT id, round(weight, 9) AS weight, strengthened FROM grown")
def _(s, d):
    links = L.upserted(table(s, d, "episode_links"))
    return L.strengthened(links, _pairs(s, d, links)).select("id", F.round("weight", 9).alias("weight"), "strengthened")


@query("link_maintenance", _GROWN + """, aged AS (SELECT strengthened, greatest(0.1::DOUBLE, weight * (1 - 0.1::DOUBLE)) AS new, weight AS old FROM grown)
SELECT count(*) AS links_before, count(*) FILTER (WHERE strengthened) AS strengthened, count(*) FILTER (WHERE new <> old) AS decayed, count(*) FILTER (WHERE new < 0.15) AS pruned, count(*) FILTER (WHERE new >= 0.15) AS links_after FROM aged""")
def _(s, d):
    links = L.upserted(table(s, d, "episode_links"))
    return L.maintenance(links, _pairs(s, d, links), threshold=0.15)


# ---------------------------------------------------------------- vectors
def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query("vector_topk", f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - {_cos('embedding', 'e')}, 6) AS distance FROM embeddings, q ORDER BY round(1 - {_cos('embedding', 'e')}, 9), vec_id LIMIT 10")
def _(s, d):
    vec = table(s, d, "embeddings")
    return V.topk(vec, list(vec.where("vec_id = 0").first().embedding)).select("vec_id", F.round("distance", 6).alias("distance"))


@query("vector_topk_filtered", f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, round(1 - {_cos('embedding', 'e')}, 6) AS distance FROM embeddings, q WHERE label IN (1, 4) ORDER BY round(1 - {_cos('embedding', 'e')}, 9), vec_id LIMIT 10")
def _(s, d):
    vec = table(s, d, "embeddings")
    return V.topk(vec.where("label in (1, 4)"), list(vec.where("vec_id = 0").first().embedding)).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("vector_topk_batch", f"SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - {_cos('v.embedding', 'q.embedding')}, 9), v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 10")
def _(s, d):
    vec = table(s, d, "embeddings")
    return V.topk_batch(vec, vec.where("vec_id % 50 = 0")).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("link_candidates", f"WITH near AS (SELECT q.vec_id AS query_id, v.vec_id, {_cos('v.embedding', 'q.embedding')} AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - {_cos('v.embedding', 'q.embedding')}, 9), v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 20) SELECT query_id, vec_id, round((1 + c) / 2, 6) AS weight FROM near WHERE round(1 - c, 9) <= 0.6")
def _(s, d):
    vec = table(s, d, "embeddings")
    near = V.topk_batch(vec, vec.where("vec_id % 50 = 0"), 20).where("distance <= 0.6")
    return near.select("query_id", "vec_id", F.round((2 - F.col("distance")) / 2, 6).alias("weight"))


@query("unit_similarity", f"SELECT a.vec_id AS a, b.vec_id AS b, round((1 + {_cos('a.embedding', 'b.embedding')}) / 2, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    vec = table(s, d, "embeddings")
    a = vec.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b"))
    b = vec.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "b").select("a", "b", F.round(C.unit_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("coherence_by_group", f"SELECT a.label, round(avg((1 + {_cos('a.embedding', 'b.embedding')}) / 2), 6) AS coherence FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def _(s, d):
    return V.coherence(table(s, d, "embeddings"), "label").select("label", F.round("coherence", 6).alias("coherence"))


@query("mean_similarity", f"SELECT a.vec_id, a.label, round(avg((1 + {_cos('a.embedding', 'b.embedding')}) / 2), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY a.vec_id, a.label")
def _(s, d):
    return V.mean_similarity(table(s, d, "embeddings"), "label").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


_VEC = "vec AS (SELECT vec_id, embedding FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings)"


def _with_vectors(rows, vec, n):
    at = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % n
    return rows.withColumn("vec_id", at).join(vec.select("vec_id", "embedding"), "vec_id")


def _nearest(s, d, rows, k=10):
    vec = table(s, d, "embeddings")
    with_vec = _with_vectors(rows, vec, vec.count())
    return V.topk(with_vec, list(vec.where("vec_id = 0").first().embedding), k, id_col="id").drop("embedding")


def _near_sql(src: str, name: str) -> str:
    return f"{name} AS (SELECT s.*, round(1 - {_cos('v.embedding', 'q.embedding')}, 9) AS distance, row_number() OVER (ORDER BY round(1 - {_cos('v.embedding', 'q.embedding')}, 9), s.id) AS rank FROM {src} s, n, vec v, vec q WHERE v.vec_id = ('0x' || substr(md5(s.id), 1, 6))::BIGINT % n.n AND q.vec_id = 0 QUALIFY rank <= 10)"


@query("entity_search", _ONE_ENTITY + f", {_VEC}, {_near_sql('ent', 'near')} SELECT id, name, rank FROM near")
def _(s, d):
    near = _nearest(s, d, E.unique_entities(table(s, d, "entities")))
    return E.newest_per(near.withColumn("_all", F.lit(1)), ["_all"], 10, [F.asc("distance"), F.asc("id")]).select("id", "name", F.col("rank").cast("long").alias("rank"))


@query("episode_search", f"WITH {_ONE_EPISODE}, {_VEC}, l0 AS (SELECT * FROM epi WHERE level = 0), {_near_sql('l0', 'near')} SELECT id, rank FROM near WHERE recorded_at <= TIMESTAMP '{LATER}'")
def _(s, d):
    near = _nearest(s, d, P.unique_episodes(table(s, d, "episodes")).where("level = 0"))
    ranked = E.newest_per(near.withColumn("_all", F.lit(1)), ["_all"], 10, [F.asc("distance"), F.asc("id")])
    return P.temporal(ranked, as_of=LATER).select("id", F.col("rank").cast("long").alias("rank"))


_HYBRID = f"WITH {_ONE_EPISODE}, ent AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, name) = 1), {_VEC}, {_near_sql('ent', 'ne')}, {_near_sql('epi', 'np')}, one AS (SELECT * FROM facts WHERE invalidated_at IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) = 1)"


def _hybrid(s, d):
    rank = lambda df: E.newest_per(df.withColumn("_all", F.lit(1)), ["_all"], 10, [F.asc("distance"), F.asc("id")])
    ent = rank(_nearest(s, d, E.unique_entities(table(s, d, "entities"))))
    epi = R.relevance(rank(_nearest(s, d, P.unique_episodes(table(s, d, "episodes")))), ["_all"], [F.asc("rank")])
    live = C.latest(T.facts_current(table(s, d, "facts")), ["id"], [F.desc("recorded_at")])
    facts = live.join(F.broadcast(ent.select(F.col("id").alias("subject_id"), F.col("rank").alias("entity_rank"))), "subject_id")  # ten entities
    return ent, facts, R.rank_episodes(epi)


@query("hybrid_query", _HYBRID + " SELECT 'fact' AS kind, f.id, ne.rank AS place, 0.0::DOUBLE AS score FROM one f JOIN ne ON f.subject_id = ne.id UNION ALL SELECT 'episode', id, rank, round(0.7::DOUBLE * (1 - (rank - 1) / 10::DOUBLE) + 0.3::DOUBLE * salience, 6) FROM np")
def _(s, d):
    _, facts, epi = _hybrid(s, d)
    a = facts.select(F.lit("fact").alias("kind"), "id", F.col("entity_rank").cast("long").alias("place"), F.lit(0.0).alias("score"))
    return a.unionByName(epi.select(F.lit("episode").alias("kind"), "id", F.col("rank").cast("long").alias("place"), F.round("final", 6).alias("score")))


@query("retrieval_summary", _HYBRID + " SELECT (SELECT count(*) FROM one f JOIN ne ON f.subject_id = ne.id) AS n_facts, (SELECT count(*) FROM np) AS n_episodes, (SELECT string_agg(id, ',' ORDER BY rank) FROM np WHERE rank <= 3) AS first_episodes")
def _(s, d):
    _, facts, epi = _hybrid(s, d)
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "id")))), lambda x: x["id"]), ",")
    return facts.agg(F.count("*").alias("n_facts")).join(epi.agg(F.count("*").alias("n_episodes"), first.alias("first_episodes")), F.lit(True))  # one row each


@query("relevance_score", "SELECT label, vec_id, round(1 - (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) / count(*) OVER (PARTITION BY label)::DOUBLE, 9) AS score FROM embeddings")
def _(s, d):
    return R.relevance(table(s, d, "embeddings"), ["label"], [F.asc("vec_id")]).select("label", "vec_id", F.round("score", 9).alias("score"))


@query("dedup_first", "SELECT id, min(recorded_at) AS recorded_at FROM facts GROUP BY id")
def _(s, d):
    return R.dedup_first(table(s, d, "facts"), ["id"], [F.asc("recorded_at")]).select("id", "recorded_at")


@query("rank_episodes", f"WITH {_ONE_EPISODE}, r AS (SELECT id, level, salience, 1 - (row_number() OVER (PARTITION BY level ORDER BY occurred_at DESC NULLS LAST, id) - 1) / count(*) OVER (PARTITION BY level)::DOUBLE AS score FROM epi) SELECT id, round(round(0.7::DOUBLE * score + 0.3::DOUBLE * coalesce(salience, 0.5::DOUBLE), 9), 6) AS final FROM r")
def _(s, d):
    scored = R.relevance(P.unique_episodes(table(s, d, "episodes")), ["level"], [F.desc_nulls_last("occurred_at"), F.asc("id")])
    return R.rank_episodes(scored).select("id", F.round("final", 6).alias("final"))


@query("context_items", f"""
WITH {_ONE_EPISODE}, ent AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, name) = 1), one AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC, invalidated_at DESC NULLS LAST) = 1)
SELECT 'semantic' AS source, f.id, concat_ws(' ', coalesce(s.name, f.subject_id), predicate, coalesce(o.name, nullif(object_value, ''), object_id)) AS text, 0.5::DOUBLE AS relevance FROM one f LEFT JOIN ent s ON s.id = f.subject_id LEFT JOIN ent o ON o.id = f.object_id
UNION ALL SELECT 'episodic_L' || level, id, coalesce(nullif(summary, ''), content), 0.5 FROM epi""")
def _(s, d):
    names = E.unique_entities(table(s, d, "entities"))
    return R.fact_items(T.latest_facts(table(s, d, "facts")), names).unionByName(R.episode_items(P.unique_episodes(table(s, d, "episodes"))))


# ---------------------------------------------------------------- curation
_SCORE = "concat(access_count % 13 // 10, '.', access_count % 13 % 10)"


def _score():
    n = F.col("access_count") % 13
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


@query("ingest_gate", f"WITH {_ONE_EPISODE} SELECT id, salience >= 0.3 AS stored FROM epi WHERE level = 0")
def _(s, d):
    return P.unique_episodes(table(s, d, "episodes")).where("level = 0").select("id", (F.col("salience") >= 0.3).alias("stored"))


@query("salience_tier", f"WITH {_ONE_EPISODE} SELECT CASE WHEN salience IS NULL OR salience < 0.3 THEN 'none' WHEN salience < 0.6 THEN 'brief' WHEN salience < 0.8 THEN 'full' ELSE 'linked' END AS tier, count(*) AS n FROM epi GROUP BY 1")
def _(s, d):
    return P.unique_episodes(table(s, d, "episodes")).groupBy(U.salience_tier(F.col("salience")).alias("tier")).agg(F.count("*").alias("n"))


@query("salience_parse", f"""WITH {_ONE_EPISODE}, x AS (SELECT id, access_count % 13 / 10.0::DOUBLE AS raw, access_count % 5 = 0 AS bad, access_count % 2 = 0 AS cut FROM epi)
SELECT id, CASE WHEN NOT bad THEN round(CASE WHEN cut AND least(1.0, raw) > 0.3::DOUBLE THEN greatest(0.3::DOUBLE, least(1.0, raw) - 0.1::DOUBLE) ELSE least(1.0, raw) END, 6) END AS score, CASE WHEN NOT bad THEN 'episodic' END AS memory_type, CASE WHEN bad THEN 'invalid answer' END AS error FROM x""")
def _(s, d):
    bad = F.col("access_count") % 5 == 0
    answer = F.concat(F.lit('Here: {"score": '), _score(), F.when(bad, F.lit("")).otherwise(F.lit(', "reasoning": "r"')), F.lit(', "memory_type": "episodic"} done'))
    rows = P.unique_episodes(table(s, d, "episodes")).select("id", answer.alias("answer"), (F.col("access_count") % 2 == 0).alias("cut"))
    return U.parse_salience(rows, "answer", "cut").select("id", F.round("score", 6).alias("score"), "memory_type", "error")


@query("parse_link_eval", f"WITH {_ONE_EPISODE}, x AS (SELECT id, access_count AS n FROM epi) SELECT id, CASE WHEN n % 7 > 0 THEN n % 3 = 0 END AS should_link, CASE WHEN n % 7 > 0 THEN CASE n % 4 WHEN 0 THEN 'causal' WHEN 1 THEN 'temporal' ELSE 'semantic' END END AS link_type, CASE WHEN n % 7 > 0 THEN least(1.0::DOUBLE, n % 13 / 10.0::DOUBLE) END AS weight, CASE WHEN n % 7 = 0 THEN 'invalid answer' END AS error FROM x")
def _(s, d):
    n = F.col("access_count")
    kind = F.when(n % 4 == 0, "causal").when(n % 4 == 1, "temporal").otherwise("odd")
    answer = F.concat(F.lit('```json\n{"should_link": '), F.when(n % 3 == 0, "true").otherwise("false"), F.lit(', "link_type": "'), kind, F.lit('", "weight": '), _score(), F.when(n % 7 == 0, F.lit("")).otherwise(F.lit(', "reasoning": "r"')), F.lit("}\n```"))
    return U.parse_link(P.unique_episodes(table(s, d, "episodes")).select("id", answer.alias("answer")), "answer").select("id", "should_link", "link_type", "weight", "error")


@query("parse_entities", _ONE_ENTITY + " SELECT id, name, entity_type, CASE WHEN access_count % 13 % 2 = 0 THEN 1.0::DOUBLE ELSE access_count % 13 / 10.0::DOUBLE END AS confidence FROM ent WHERE access_count % 13 % 2 = 0 OR access_count % 13 <= 10")
def _(s, d):
    one = E.unique_entities(table(s, d, "entities"))
    n = F.col("access_count") % 13
    item = F.concat(F.lit('{"name": "'), F.col("name"), F.lit('", "type": "'), F.col("entity_type"), F.when(n % 2 == 0, F.lit('"')).otherwise(F.concat(F.lit('", "confidence": '), _score())), F.lit("}"))
    answer = F.when(n % 3 == 0, F.concat(F.lit("List: ["), item, F.lit(', {"name": "no type"}] end'))).when(n % 3 == 1, F.concat(F.lit('{"entities": ['), item, F.lit("]}"))).otherwise(item)
    return U.parse_entities(one.select("id", answer.alias("answer")), "id", "answer")


@query("parse_facts", "SELECT DISTINCT id, subject_id AS subject, predicate, 'v' AS object, 1.0::DOUBLE AS confidence FROM facts WHERE subject_id IS NOT NULL AND predicate IS NOT NULL")
def _(s, d):
    answer = F.concat(F.lit('{"facts": [{"subject": "'), F.col("subject_id"), F.lit('", "predicate": "'), F.col("predicate"), F.lit('", "object": "v"}, {"subject": "x"}, {"subject": "y", "predicate": "p", "object": "o", "confidence": 1.5}]}'))
    return U.parse_facts(table(s, d, "facts").select("id", answer.alias("answer")).distinct(), "id", "answer")


@query("parse_resolution", "SELECT DISTINCT id, CASE WHEN confidence >= 0.5 THEN 'temporal_succession' END AS strategy, CASE WHEN confidence >= 0.5 THEN least(id, subject_id) || ',' || greatest(id, subject_id) END AS invalidate, CASE WHEN confidence < 0.5 THEN 'invalid answer' END AS error FROM facts WHERE confidence IS NOT NULL")
def _(s, d):
    name = F.when(F.col("confidence") >= 0.5, "temporal_succession").otherwise("guess")
    answer = F.concat(F.lit('ok {"strategy": "'), name, F.lit('", "invalidations": ["'), F.col("id"), F.lit('", "'), F.col("subject_id"), F.lit('"]}'))
    parsed = U.parse_resolution(table(s, d, "facts").where("confidence is not null").select("id", answer.alias("answer")).distinct(), "answer")
    return parsed.select("id", "strategy", F.array_join("invalidate", ",").alias("invalidate"), "error").withColumn("invalidate", F.when(F.col("strategy").isNotNull(), F.col("invalidate")))


@query("parse_summary", f"WITH {_ONE_EPISODE} SELECT id, CASE WHEN access_count % 3 > 0 THEN 's' || level END AS parsed_summary, CASE WHEN access_count % 3 = 1 THEN least(1.0::DOUBLE, access_count % 13 / 10.0::DOUBLE) WHEN access_count % 3 = 2 THEN 0.5::DOUBLE END AS parsed_salience FROM epi")
def _(s, d):
    n = F.col("access_count") % 3
    body = F.when(n > 0, F.concat(F.lit('"summary": "s'), F.col("level").cast("string"), F.lit('"'))).otherwise(F.lit('"text": "x"'))
    answer = F.concat(F.lit("```\n{"), body, F.when(n == 1, F.concat(F.lit(', "salience": '), _score())).otherwise(""), F.lit("}\n```"))
    return U.parse_summary(P.unique_episodes(table(s, d, "episodes")).select("id", answer.alias("answer")), "answer").select("id", "parsed_summary", "parsed_salience")


@query("parse_pattern", f"WITH {_ONE_EPISODE} SELECT id, CASE WHEN access_count % 4 > 0 THEN 'd' END AS description, CASE access_count % 4 WHEN 1 THEN 'behavioral' WHEN 2 THEN 'preference' WHEN 3 THEN 'error' END AS pattern_type, CASE WHEN access_count % 4 > 0 THEN least(1.0::DOUBLE, access_count % 13 / 10.0::DOUBLE) END AS confidence FROM epi")
def _(s, d):
    n = F.col("access_count") % 4
    kind = F.when(n == 1, "behavioral").when(n == 2, "preference").when(n == 3, "error").otherwise("mood")
    answer = F.concat(F.lit('```json\n{"description": "d", "pattern_type": "'), kind, F.lit('", "confidence": '), _score(), F.lit("}\n```"))
    return U.parse_pattern(P.unique_episodes(table(s, d, "episodes")).select("id", answer.alias("answer")), "answer").select("id", "description", "pattern_type", "confidence")


@query("evolution_merge", f"WITH {_ONE_EPISODE} SELECT id, concat_ws(' ', nullif(context_description, ''), 'seen again') AS context_description, array_to_string(list_sort(list_distinct(list_concat(coalesce(keywords, []), ['again', 'chat']))), ',') AS keywords, array_to_string(list_sort(list_distinct(coalesce(tags, []))), ',') AS tags, CASE WHEN access_count % 3 = 0 THEN 0.75::DOUBLE ELSE salience END AS salience FROM epi WHERE consolidation_strength <= 9")
def _(s, d):
    one = P.unique_episodes(table(s, d, "episodes")).where("consolidation_strength <= 9")
    new = F.when(F.col("access_count") % 3 == 0, 0.75).otherwise(1.5)
    out = U.evolution_merge(one, F.lit("seen again"), F.array(F.lit("again"), F.lit("chat")), F.array().cast("array<string>"), new)
    return out.select("id", "context_description", F.array_join("keywords", ",").alias("keywords"), F.array_join("tags", ",").alias("tags"), "salience")


@query("evolution_eligible", f"WITH {_ONE_EPISODE}, {_ONE_LINK}, {_ENDS} SELECT DISTINCT episode_id, other_id FROM ends JOIN epi ON epi.id = other_id WHERE episode_id <> other_id AND consolidation_strength <= 9")
def _(s, d):
    firm = P.unique_episodes(table(s, d, "episodes")).where("consolidation_strength <= 9").select(F.col("id").alias("other_id"))
    return L.linked_episodes(L.upserted(table(s, d, "episode_links"))).join(firm, "other_id", "left_semi").select("episode_id", "other_id")


# ---------------------------------------------------------------- consolidation
@query("episode_text", f"WITH {_ONE_EPISODE} SELECT id, concat_ws(' | ', content, 'Summary: ' || nullif(summary, ''), 'Context: ' || nullif(context_description, ''), CASE WHEN len(keywords) > 0 THEN 'Keywords: ' || array_to_string(keywords, ', ') END) AS text FROM epi")
def _(s, d):
    return P.unique_episodes(table(s, d, "episodes")).select("id", K.episode_text().alias("text"))


_CLUSTERS = f"""{_ONE_EPISODE}, tm AS (SELECT parent_id, id, epoch_us(occurred_at) AS us FROM epi WHERE parent_id <> '' AND occurred_at IS NOT NULL),
g AS (SELECT *, coalesce(us - lag(us) OVER w > 168 * 3600000000, false)::INT AS gap FROM tm WINDOW w AS (PARTITION BY parent_id ORDER BY us, id)),
r AS (SELECT *, (sum(gap) OVER (PARTITION BY parent_id ORDER BY us, id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM g),
cl AS (SELECT parent_id, id, us, run, (row_number() OVER (PARTITION BY parent_id, run ORDER BY us, id) - 1) // 5 AS part FROM r)"""


def _clusters(s, d):
    return K.cluster_temporal(P.unique_episodes(table(s, d, "episodes")).where("parent_id <> ''"), "parent_id")


@query("cluster_temporal", f"WITH {_CLUSTERS} SELECT parent_id, id, run, part FROM cl")
def _(s, d):
    return _clusters(s, d).select("parent_id", "id", "run", "part")


@query("cluster_rollup", f"WITH {_CLUSTERS} SELECT cl.parent_id, run, part, count(*) AS n, min(us) AS first_us, max(us) AS last_us, round(avg(salience), 6) AS salience, coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(keywords, []))))), ','), '') AS keywords, round((max(us) - min(us)) / 3600000000::DOUBLE, 6) AS hours FROM cl JOIN epi USING (id) GROUP BY cl.parent_id, run, part HAVING count(*) > 1")
def _(s, d):
    out = K.cluster_rollup(_clusters(s, d), P.unique_episodes(table(s, d, "episodes")), "parent_id")
    return out.select("parent_id", "run", "part", "n", "first_us", "last_us", "salience", F.array_join("keywords", ",").alias("keywords"), "hours")


@query("cluster_semantic")
def _(s, d):
    return FD.cluster_semantic(table(s, d, "embeddings"), threshold=0.55)


@query("should_abstract", f"WITH {_CLUSTERS}, {_VEC}, x AS (SELECT cl.parent_id, cl.id, us, v.embedding FROM cl, n, vec v WHERE v.vec_id = ('0x' || substr(md5(cl.id), 1, 6))::BIGINT % n.n), coh AS (SELECT a.parent_id, round(avg((1 + {_cos('a.embedding', 'b.embedding')}) / 2), 6) AS coherence FROM x a JOIN x b ON a.parent_id = b.parent_id AND a.id < b.id GROUP BY 1), st AS (SELECT parent_id, count(*) AS n, min(us) AS oldest_us FROM cl GROUP BY parent_id) SELECT parent_id, n, n >= 3 AND epoch_us(TIMESTAMP '{NOW}') - oldest_us >= 24 * 3600000000 AND coalesce(coherence, 1) >= 0.5 AS ready FROM st LEFT JOIN coh USING (parent_id)")
def _(s, d):
    vec = table(s, d, "embeddings")
    rows = _with_vectors(_clusters(s, d), vec, vec.count())
    stats = _clusters(s, d).groupBy("parent_id").agg(F.count("*").alias("n"), F.min("us").alias("oldest_us"))
    joined = stats.join(V.coherence(rows, "parent_id").select("parent_id", F.round("coherence", 6).alias("coherence")), "parent_id")
    return K.should_abstract(joined, NOW, coherence=0.5).select("parent_id", "n", "ready")


@query("cluster_sequential")
def _(s, d):
    vec = table(s, d, "embeddings")
    rows = _with_vectors(P.unique_episodes(table(s, d, "episodes")).where("parent_id <> ''").select("id", "parent_id", C.micros("occurred_at").alias("us")), vec, vec.count())
    return FD.cluster_sequential(rows, "parent_id", "id", "us", "embedding", threshold=0.5)


@query("abstraction_pick", f"WITH {_ONE_EPISODE} SELECT id, occurred_at FROM epi WHERE level = 0 AND nullif(parent_id, '') IS NULL ORDER BY occurred_at NULLS LAST, id LIMIT 100")
def _(s, d):
    rows = P.unique_episodes(table(s, d, "episodes")).where((F.col("level") == 0) & C.blank_to_null("parent_id").isNull())
    return rows.orderBy(F.asc_nulls_last("occurred_at"), "id").limit(100).select("id", "occurred_at")


_PATTERNS = f"""occ AS (SELECT DISTINCT coalesce(subject_id, '') || ' ' || coalesce(predicate, '') AS pattern_id, id FROM facts WHERE recorded_at < TIMESTAMP '{LATER}'),
pat AS (SELECT pattern_id, count(*) AS n, round(least(1.0::DOUBLE, 0.3::DOUBLE + 0.01::DOUBLE * count(*)), 6) AS confidence FROM occ GROUP BY pattern_id),
seen AS (SELECT DISTINCT coalesce(subject_id, '') || ' ' || coalesce(predicate, '') AS pattern_id, id FROM facts WHERE recorded_at >= TIMESTAMP '{AT}')"""


def _occurrences(s, d, when):
    pattern = F.concat_ws(" ", F.coalesce("subject_id", F.lit("")), F.coalesce("predicate", F.lit("")))
    return table(s, d, "facts").where(when).select(pattern.alias("pattern_id"), "id").distinct()


def _patterns(s, d):
    """What is said of a subject is a pattern, each fact an occurrence."""
    occ = _occurrences(s, d, F.col("recorded_at") < C.moment(LATER))
    return occ, occ.groupBy("pattern_id").agg(F.count("*").alias("n")).withColumn("confidence", F.round(F.least(F.lit(1.0), 0.3 + 0.01 * F.col("n")), 6))


@query("pattern_strengthen", f"WITH {_PATTERNS}, f AS (SELECT pattern_id, count(*) AS n_new FROM (SELECT * FROM seen EXCEPT SELECT * FROM occ) GROUP BY 1) SELECT pattern_id, coalesce(n_new, 0) AS n_new, round(CASE WHEN n_new > 0 THEN least(1.0::DOUBLE, confidence + 0.1::DOUBLE * n_new) ELSE confidence END, 6) AS confidence FROM pat LEFT JOIN f USING (pattern_id)")
def _(s, d):
    occ, patterns = _patterns(s, d)
    return K.strengthen_rows(patterns, occ, _occurrences(s, d, F.col("recorded_at") >= C.moment(AT))).select("pattern_id", "n_new", "confidence")


@query("pattern_weaken", f"WITH {_PATTERNS}, hit AS (SELECT DISTINCT pattern_id FROM occ WHERE id IN (SELECT id FROM seen)) SELECT pattern_id, round(CASE WHEN pattern_id NOT IN (SELECT pattern_id FROM hit) THEN least(confidence, greatest(0.1::DOUBLE, confidence - 0.05::DOUBLE)) ELSE confidence END, 6) AS confidence FROM pat")
def _(s, d):
    occ, patterns = _patterns(s, d)
    return K.weaken_rows(patterns, occ, _occurrences(s, d, F.col("recorded_at") >= C.moment(AT)).select("id"))


@query("pattern_strength", f"WITH {_PATTERNS} SELECT pattern_id, round(least(20.0::DOUBLE, (5 + 2 * sqrt(n)) * confidence), 6) AS strength, CASE WHEN n >= 10 THEN 'consolidated' WHEN n >= 3 THEN 'established' ELSE 'emerging' END AS stage FROM pat")
def _(s, d):
    _, p = _patterns(s, d)
    return p.select("pattern_id", F.round(K.pattern_strength(F.col("n").cast("double"), F.col("confidence")), 6).alias("strength"), K.pattern_lifecycle(F.col("n")).alias("stage"))


@query("pattern_lifecycle", "SELECT CASE WHEN n >= 10 THEN 'consolidated' WHEN n >= 3 THEN 'established' ELSE 'emerging' END AS stage, count(*) AS n FROM (SELECT subject_id, predicate, count(DISTINCT id) AS n FROM facts GROUP BY ALL) GROUP BY 1")
def _(s, d):
    n = table(s, d, "facts").groupBy("subject_id", "predicate").agg(F.count_distinct("id").alias("n"))
    return n.groupBy(K.pattern_lifecycle(F.col("n")).alias("stage")).agg(F.count("*").alias("n"))


@query("pattern_match", f"WITH s AS (SELECT c.vec_id AS candidate_id, p.vec_id AS pattern_id, round((1 + {_cos('c.embedding', 'p.embedding')}) / 2, 9) AS similarity, row_number() OVER (PARTITION BY c.vec_id ORDER BY round((1 + {_cos('c.embedding', 'p.embedding')}) / 2, 9) DESC, p.vec_id) AS rn FROM embeddings c JOIN embeddings p ON c.label = p.label WHERE c.vec_id % 50 = 0) SELECT candidate_id, pattern_id, round(similarity, 6) AS similarity FROM s WHERE rn = 1 AND similarity >= 0.7")
def _(s, d):
    vec = table(s, d, "embeddings")
    cand = vec.where("vec_id % 50 = 0").select(F.col("vec_id").alias("candidate_id"), F.col("label").alias("pattern_type"), "embedding")
    known = vec.select(F.col("vec_id").alias("pattern_id"), F.col("label").alias("pattern_type"), "embedding")
    return K.match(cand, known).select("candidate_id", "pattern_id", F.round("similarity", 6).alias("similarity"))


@query("description_similar", f"WITH {_ONE_EPISODE}, x AS (SELECT e.id, lower(trim(e.content)) AS x, lower(trim(p.content)) AS y FROM epi e JOIN epi p ON p.id = e.parent_id), t AS (SELECT *, list_distinct(regexp_split_to_array(x, '\\s+')) AS u, list_distinct(regexp_split_to_array(y, '\\s+')) AS v FROM x) SELECT id, x = y OR contains(x, y) OR contains(y, x) OR len(list_intersect(u, v)) / nullif(least(len(u), len(v)), 0)::DOUBLE > 0.7 AS similar FROM t")
def _(s, d):
    one = P.unique_episodes(table(s, d, "episodes"))
    up = one.select(F.col("id").alias("parent_id"), F.col("content").alias("above"))
    return one.join(up, "parent_id").select("id", K.description_similar(F.col("content"), F.col("above")).alias("similar"))


@query("should_run", f"SELECT count(DISTINCT id) AS n_new, count(DISTINCT id) >= 10 OR epoch_us(TIMESTAMP '{LATER}') - epoch_us(TIMESTAMP '{AT}') >= 24 * 3600000000 AS due FROM episodes WHERE level = 0 AND recorded_at > TIMESTAMP '{AT}'")
def _(s, d):
    return K.should_run(table(s, d, "episodes"), AT, LATER)


_STALE = f"{_ONE_EPISODE}, gone AS (SELECT id FROM epi WHERE (level = 0 AND nullif(parent_id, '') IS NOT NULL AND access_count <= 0 AND occurred_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY) OR consolidation_strength <= 0 ORDER BY consolidation_strength, access_count, id LIMIT 100)"


@query("prune_stale", f"WITH {_STALE} SELECT id FROM gone")
def _(s, d):
    return K.stale(P.unique_episodes(table(s, d, "episodes")), NOW).select("id")


@query("prune_links_cascade", f"WITH {_STALE}, {_ONE_LINK} SELECT 'links' AS what, count(*) AS n FROM lnk WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'parents', count(*) FROM epi WHERE id NOT IN (SELECT id FROM gone) AND parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM gone)")
def _(s, d):
    one = P.unique_episodes(table(s, d, "episodes"))
    left, kept = K.prune_cascade(one, L.upserted(table(s, d, "episode_links")), K.stale(one, NOW))
    return kept.agg(F.count("*").alias("n")).select(F.lit("links").alias("what"), "n").unionByName(left.where("parent_id is not null").agg(F.count("*").alias("n")).select(F.lit("parents").alias("what"), "n"))


# ---------------------------------------------------------------- working memory and dialog
_MSG = """lines AS (SELECT strftime(occurred_at, '%Y-%m-%d') AS conv_id, occurred_at, id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS "at" FROM epi WHERE level = 0 AND occurred_at IS NOT NULL),
msg AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY occurred_at, id, "at") AS seq, id,
  CASE WHEN starts_with(line, 'user: ') THEN 'user' WHEN starts_with(line, 'assistant: ') THEN 'assistant' ELSE 'system' END AS role,
  CASE WHEN starts_with(line, 'user: ') THEN substr(line, 7) WHEN starts_with(line, 'assistant: ') THEN substr(line, 12) ELSE line END AS text FROM lines),
tok AS (SELECT *, greatest(1, length(role || ': ' || text) // 4)::BIGINT AS tokens FROM msg)"""
_MESSAGES = f"WITH {_ONE_EPISODE}, {_MSG}"


def _messages(s, d):
    return W.messages(P.unique_episodes(table(s, d, "episodes")))


@query("token_estimate", f"WITH {_ONE_EPISODE} SELECT id, CASE WHEN length(coalesce(content, '')) = 0 THEN 0 ELSE greatest(1, length(content) // 4) END::BIGINT AS tokens FROM epi")
def _(s, d):
    return P.unique_episodes(table(s, d, "episodes")).select("id", C.tokens(F.col("content")).alias("tokens"))


@query("conversation_history", _MESSAGES + " SELECT conv_id, seq, role, text, tokens FROM tok")
def _(s, d):
    return _messages(s, d).select("conv_id", "seq", "role", "text", "tokens")


@query("utilization", _MESSAGES + f" SELECT conv_id, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / {BUDGET}::DOUBLE, 6) AS utilization, sum(tokens) / {BUDGET}::DOUBLE >= 0.8 AS under_pressure FROM tok GROUP BY conv_id")
def _(s, d):
    return W.utilization(_messages(s, d), BUDGET)


@query("dialog_trim", _MESSAGES + f" SELECT conv_id, seq, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY seq DESC) AS after, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS rn FROM tok) WHERE after <= {int(BUDGET * 0.8 * 0.9)} OR rn = 1")
def _(s, d):
    return W.trim(_messages(s, d), BUDGET).select("conv_id", "seq", "tokens")


@query("dialog_trim_replay")
def _(s, d):
    return FD.trim_replay(_messages(s, d), BUDGET)


@query("offload_candidates", _MESSAGES + " SELECT conv_id, seq, role || ': ' || text AS content, 0.5::DOUBLE AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS rn FROM tok) WHERE rn > 2")
def _(s, d):
    return W.offload_candidates(_messages(s, d))


@query("pressure_plan", _MESSAGES + f""", own AS (SELECT conv_id, count(*) AS n, sum(tokens) AS dialog, sum(CASE WHEN rn <= 2 THEN tokens ELSE 0 END) AS last_two FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS rn FROM tok) GROUP BY conv_id),
ex AS (SELECT conv_id, sum(tokens) AS extra FROM tok WHERE role = 'assistant' GROUP BY conv_id),
x AS (SELECT conv_id, n, dialog, last_two, coalesce(extra, 0) AS extra FROM own LEFT JOIN ex USING (conv_id)),
y AS (SELECT *, dialog + extra + 30 AS total, dialog + 30 AS without, total >= {0.8 * BUDGET} AS one, total >= {0.8 * BUDGET} AND dialog + 30 >= {0.8 * BUDGET} AND n > 2 AS two FROM x),
z AS (SELECT *, CASE WHEN two THEN last_two + 12 * (n - 2) + 30 ELSE without END AS after_two FROM y)
SELECT conv_id, total::BIGINT AS tokens_before, one AS clear_retrieved, two AS summarise, one AND after_two >= {0.8 * BUDGET} AS evict_task, (CASE WHEN NOT one THEN total WHEN after_two >= {0.8 * BUDGET} THEN after_two - 30 ELSE after_two END)::BIGINT AS tokens_after FROM z""")
def _(s, d):
    msgs = _messages(s, d)
    return W.pressure_plan(msgs, msgs.where("role = 'assistant'").select("conv_id", "tokens"), 30, BUDGET)


@query("interaction_pairs", _MESSAGES + ", nx AS (SELECT conv_id, seq, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM tok WINDOW w AS (PARTITION BY conv_id ORDER BY seq)) SELECT conv_id, seq, text AS question, answer FROM nx WHERE role = 'user' AND next_role = 'assistant'")
def _(s, d):
    return W.interaction_pairs(_messages(s, d))


_SECTIONS = _MESSAGES + """, mem AS (SELECT conv_id, seq, text, role AS source, tokens AS relevance FROM tok WHERE role <> 'user'),
m AS (SELECT conv_id, string_agg('- ' || text || ' (from ' || source || ')', chr(10) ORDER BY relevance DESC, seq) AS memories FROM mem GROUP BY conv_id),
dlg AS (SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY seq) AS dialog, max(seq) AS n FROM tok GROUP BY conv_id),
ctx AS (SELECT conv_id, 'You remember.' AS system, CASE WHEN n > 2 THEN 'Talk of ' || conv_id END AS task FROM dlg),
ren AS (SELECT conv_id, concat_ws(chr(10) || chr(10), '# System Context' || chr(10) || system, '# Current Task' || chr(10) || task, '# Relevant Memories' || chr(10) || nullif(memories, ''), '# Conversation History' || chr(10) || nullif(dialog, '')) AS rendered
  FROM ctx LEFT JOIN m USING (conv_id) LEFT JOIN dlg USING (conv_id))"""


def _context(s, d):
    """Messages, what is remembered beside them, and the system and task text of each conversation."""
    msgs = _messages(s, d)
    memories = msgs.where("role <> 'user'").select("conv_id", F.col("seq").alias("id"), "text", F.col("role").alias("source"), F.col("tokens").alias("relevance"))
    size = msgs.groupBy("conv_id").agg(F.max("seq").alias("n"))
    task = F.when(F.col("n") > 2, F.concat(F.lit("Talk of "), "conv_id"))
    return msgs, memories, size.select("conv_id", F.lit("You remember.").alias("system"), task.alias("task"))


@query("render_sections", _SECTIONS + " SELECT conv_id, rendered FROM ren")
def _(s, d):
    msgs, memories, context = _context(s, d)
    return W.render_sections(context, memories, msgs)


@query("render_context", _MESSAGES + " SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY tokens DESC, seq) AS context FROM tok GROUP BY conv_id")
def _(s, d):
    return W.render(_messages(s, d).select("conv_id", F.col("seq").alias("id"), "text", F.col("tokens").alias("relevance")))


@query("offload_items", _SECTIONS + """ SELECT conv_id, source, text AS content, relevance::DOUBLE AS relevance, 0 AS priority FROM mem
UNION ALL SELECT conv_id, 'dialog_' || role, text, 0.5, 1 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS rn FROM tok) WHERE rn > 2 UNION ALL SELECT conv_id, 'task_context', task, 0.6, 2 FROM ctx WHERE task IS NOT NULL""")
def _(s, d):
    msgs, memories, context = _context(s, d)
    return W.offload_items(context, memories, msgs)


@query("assemble_prompt", _SECTIONS + """ SELECT conv_id, 0::BIGINT AS "at", 'system' AS role, rendered AS content FROM ren
UNION ALL SELECT conv_id, seq, CASE WHEN seq = max(seq) OVER (PARTITION BY conv_id) THEN 'user' ELSE role END, text FROM tok""")
def _(s, d):
    msgs, memories, context = _context(s, d)
    return W.prompt_messages(W.render_sections(context, memories, msgs), msgs)


@query("set_context", _SECTIONS + " SELECT conv_id, system, CASE WHEN n % 2 = 0 THEN NULL ELSE 'new' END AS task FROM ctx JOIN dlg USING (conv_id)")
def _(s, d):
    msgs, _, context = _context(s, d)
    value = F.when(F.max("seq") % 2 != 0, "new")
    return W.set_context(context, msgs.groupBy("conv_id").agg(value.alias("value")), "task")
