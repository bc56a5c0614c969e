"""Retrieval through the store: entities and their facts, episodes, both with fallbacks and access marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.models import Embedder
from tidemark.operators import entities as E
from tidemark.operators import episodes as P
from tidemark.operators import records as S
from tidemark.operators import retrieval as R
from tidemark.operators import temporal as T
from tidemark.sources.store import Store


def search_entities(store: Store, text: str, k: int = 10, entity_type: str | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Entities by likeness of their vectors, in order (``rank``); by substring of the name if there is no vector."""
    near = S.nearest(store, text, "entity", k, entity_type=entity_type, embedder=embedder)
    one = E.unique_entities(store.read("entities"))
    if near.isEmpty():
        return _ranked(E.find(one, text, entity_type).limit(k), [F.desc("created_at"), F.asc("id")])
    return _ranked(one.join(near, "id"), [F.asc("distance"), F.asc("id")]).drop("distance")


def search_episodes(store: Store, text: str, k: int = 10, level: int | None = None, valid_at: str | None = None, as_of: str | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Episodes by likeness, filtered by time afterwards; the most recent ones if there is no vector."""
    near = S.nearest(store, text, "episode", k, level=level, embedder=embedder)
    one = P.unique_episodes(store.read("episodes"))
    if near.isEmpty():
        found = _ranked(P.recent(one, level, k), [F.desc_nulls_last("occurred_at"), F.asc("id")])
    else:
        found = _ranked(one.join(near, "id"), [F.asc("distance"), F.asc("id")]).drop("distance")
    return P.temporal(found, valid_at, as_of)


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rank`` from 1, over the k rows of one search."""
    return E.newest_per(rows.withColumn("_all", F.lit(1)), ["_all"], 1 << 30, order).drop("_all")


def semantic_query(store: Store, text: str, at: str, k: int = 10, as_of: str | None = None, valid_at: str | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Facts on the k nearest entities, with ``score`` by the entity's place; the access is recorded."""
    entities = search_entities(store, text, k, embedder=embedder)
    facts = T.latest_facts(store.read("facts"))
    facts = T.facts_current(facts) if as_of is None and valid_at is None else T.facts_bitemporal(facts, as_of, valid_at)
    scored = R.relevance(entities, [], [F.asc("rank")]).select(F.col("id").alias("subject_id"), "rank", "score")
    found = facts.join(F.broadcast(scored), "subject_id")  # k entities
    S.record_access(store, entities.select("id"), at, "entity")
    return found.orderBy(F.desc("score"), "rank", "id")


def episodic_query(store: Store, text: str, at: str, k: int = 10, level: int | None = None, as_of: str | None = None, valid_at: str | None = None, embedder: Embedder | None = None) -> DataFrame:
    """The k nearest episodes in order, with ``score`` by place; the access is recorded."""
    found = R.relevance(search_episodes(store, text, k, level, valid_at, as_of, embedder), [], [F.asc("rank")])
    S.record_access(store, found.select("id"), at, "episode")
    return found


def hybrid_query(store: Store, text: str, at: str, k: int = 10, semantic: bool = True, episodic: bool = True, as_of: str | None = None, valid_at: str | None = None, embedder: Embedder | None = None) -> dict[str, DataFrame]:
    """``facts`` by score and ``episodes`` by 0.7 score + 0.3 salience, each id once."""
    out: dict[str, DataFrame] = {}
    if semantic:
        out["facts"] = R.dedup_first(semantic_query(store, text, at, k, as_of, valid_at, embedder), ["id"], [F.desc("score"), F.asc("rank")]).orderBy(F.desc("score"), "id")
    if episodic:
        out["episodes"] = R.rank_episodes(R.dedup_first(episodic_query(store, text, at, k, None, as_of, valid_at, embedder), ["id"], [F.asc("rank")])).orderBy(F.desc("final"), "rank")
    return out
