"""Writing single kinds of records: ids, reference checks, vectors and access marks.

Inserts check what they refer to before anything is written: a fact's subject and object,
an episode's parent and a link's ends must exist.  ``strict`` raises
:class:`MissingReferenceError`; otherwise the rows that refer to nothing are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import blank_to_null, moment
from tidemark.functions.models import Embedder, HashingEmbedder, embed_column
from tidemark.operators import vectors as V
from tidemark.sources.errors import MissingReferenceError
from tidemark.sources.store import Store

# What ids of each kind begin with.
PREFIXES = {"entity": "ent_", "episode": "epi_", "fact": "fct_", "link": "lnk_", "community": "com_"}


def make_id(kind: str, *parts: Column | str) -> Column:
    """An id of a kind that follows from its parts, so that a write that is repeated adds nothing."""
    columns = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(PREFIXES[kind]), F.sha2(F.concat_ws("\x1f", *columns), 256))


def fresh_id(kind: str) -> Column:
    """A random id of a kind."""
    return F.concat(F.lit(PREFIXES[kind]), F.uuid())


def with_references(rows: DataFrame, column: str, target: DataFrame, strict: bool) -> DataFrame:
    """The rows whose reference is absent or exists in ``target`` (``id``)."""
    there = target.select(F.col("id").alias("_there")).distinct()
    joined = rows.join(there, rows[column] == F.col("_there"), "left")
    good = blank_to_null(column).isNull() | F.col("_there").isNotNull()
    if strict and joined.where(~good).limit(1).count():
        raise MissingReferenceError(f"{column} names rows that do not exist")
    return joined.where(good).drop("_there")


def insert_entities(store: Store, rows: DataFrame, embedder: Embedder | None = None) -> int:
    """New entities and their vectors."""
    version = store.insert("entities", rows)
    put_vectors(store, entity_documents(rows), embedder)
    return version


def insert_episodes(store: Store, rows: DataFrame, embedder: Embedder | None = None, strict: bool = True) -> int:
    """New episodes, whose parents must exist, and their vectors; none is consolidated yet."""
    good = with_references(rows, "parent_id", store.read("episodes"), strict) if "parent_id" in rows.columns else rows
    version = store.insert("episodes", good.withColumn("consolidated_into", F.lit(None).cast("string")))
    put_vectors(store, episode_documents(good), embedder)
    return version


def insert_facts(store: Store, rows: DataFrame, now: str, strict: bool = True) -> int:
    """New facts on entities that exist; recorded ``now`` unless they say when."""
    entities = store.read("entities")
    good = with_references(rows.where(blank_to_null("subject_id").isNotNull()), "subject_id", entities, strict)
    if "object_id" in rows.columns:
        good = with_references(good, "object_id", entities, strict)
    recorded = F.coalesce(F.col("recorded_at"), moment(now)) if "recorded_at" in rows.columns else moment(now)
    return store.insert("facts", good.withColumn("recorded_at", recorded))


def insert_links(store: Store, rows: DataFrame, strict: bool = True) -> int:
    """Links whose ends exist; a link of the same ends and type is replaced."""
    episodes = store.read("episodes")
    good = with_references(with_references(rows, "source_id", episodes, strict), "target_id", episodes, strict)
    key = ["source_id", "target_id", "link_type"]
    old = store.read("episode_links").join(good.select("id", *key).withColumnRenamed("id", "_new"), key, "left_semi")
    replaced = old.join(good.select("id"), "id", "left_anti")
    if not replaced.isEmpty():
        store.delete("episode_links", replaced)
    return store.append("episode_links", good)


# ---------------------------------------------------------------- vectors
def episode_documents(episodes: DataFrame) -> DataFrame:
    """``id``, ``kind``, ``level``, ``document``: content, summary and keywords."""
    part = lambda c: F.col(c) if c in episodes.columns else F.lit(None).cast("string")
    keywords = F.array_join("keywords", " ") if "keywords" in episodes.columns else F.lit(None).cast("string")
    return episodes.select("id", F.lit("episode").alias("kind"), part("level").cast("int").alias("level"), F.concat_ws(" ", part("content"), part("summary"), keywords).alias("document"))


def entity_documents(entities: DataFrame) -> DataFrame:
    return entities.select("id", F.lit("entity").alias("kind"), "entity_type", F.concat_ws(" ", "name", "entity_type").alias("document"))


def put_vectors(store: Store, documents: DataFrame, embedder: Embedder | None = None) -> int:
    """Embeds the documents and adds or replaces their vectors."""
    return store.append("vectors", documents.withColumn("embedding", embed_column(embedder or HashingEmbedder())(F.col("document"))))


def drop_vectors(store: Store, ids: DataFrame) -> int:
    return store.delete("vectors", ids.select("id"))


def nearest(store: Store, text: str, kind: str, k: int = 10, level: int | None = None, entity_type: str | None = None, embedder: Embedder | None = None) -> DataFrame:
    """The k nearest records of a kind to a text: ``id``, ``distance``."""
    rows = store.read("vectors").where(F.col("kind") == kind)
    rows = rows.where(F.col("level") == level) if level is not None else rows
    rows = rows.where(F.lower("entity_type") == entity_type.lower()) if entity_type is not None else rows
    query = (embedder or HashingEmbedder()).embed([text])[0]
    return V.topk(rows, query, k, id_col="id").select("id", "distance")


def record_access(store: Store, ids: DataFrame, at: str, kind: str) -> None:
    store.append("access_log", ids.select("id", moment(at).alias("at"), F.lit(kind).alias("kind")))
