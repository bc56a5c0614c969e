"""Queries that drive the store: interactions are ingested with judges that answer by rule, so SQL can check the rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import episodes as P
from tidemark.operators import ingest as I
from tidemark.operators import working as W
from tidemark.plans.memory import _MESSAGES, Query
from tidemark.sources.store import Store
from tidemark.sources.tables import shared_dir, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class FirstWord:
    """Names the first word after ``user: `` as a concept."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"entities": [{"name": w, "type": "concept"}]}) if (w := _first(p)) else "[]" for p in prompts]


class SaysLast:
    """States that the first word is said to be the last word of the text."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"facts": [{"subject": _first(p), "predicate": "said_of", "object": p.rsplit(" ", 1)[-1]}]}) if _first(p) else "[]" for p in prompts]


def _first(prompt: str) -> str:
    return prompt.partition("\nuser: ")[2].partition(" ")[0].partition("\n")[0]


def _filled(s: SparkSession, d: str) -> Store:
    """A new store with the interactions of all raw episodes; two messages that follow each other are one."""
    store = I.open_store(s, f"{shared_dir(s)}/tidemark-store-{uuid.uuid4().hex}")
    pairs = W.interaction_pairs(W.messages(P.unique_episodes(table(s, d, "episodes"))))
    rows = pairs.withColumn("at", F.expr("timestampadd(second, cast(seq as int), cast(to_date(conv_id) as timestamp_ntz))"))
    I.ingest(store, rows, curator=I.Curator(entities=FirstWord(), facts=SaysLast(), least_likeness=2.0))
    return store


_TALK = _MESSAGES + """, nx AS (SELECT conv_id, seq, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM tok WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
talk AS (SELECT conv_id, seq, 'user: ' || coalesce(text, '') || chr(10) || 'assistant: ' || coalesce(answer, '') AS content, conv_id::TIMESTAMP + to_seconds(seq) AS "at" FROM nx WHERE role = 'user' AND next_role = 'assistant'),
kept AS (SELECT *, 'epi_' || sha256(conv_id || chr(31) || seq || chr(31) || content) AS id, split_part(split_part(substr(content, 7), ' ', 1), chr(10), 1) AS w, string_split(content, ' ')[-1] AS z FROM talk WHERE round(least(1.0, length(content) / 500::DOUBLE), 3) >= 0.3::DOUBLE),
ent2 AS (SELECT id AS episode_id, "at", w, z, 'ent_' || sha256(lower(trim(w)) || chr(31) || 'concept') AS eid FROM kept WHERE w <> ''),
fct AS (SELECT 'fct_' || sha256(eid || chr(31) || 'said_of' || chr(31) || z || chr(31) || episode_id) AS id, eid AS subject_id, CASE WHEN lower(trim(z)) = lower(trim(w)) THEN eid END AS object_id, CASE WHEN lower(trim(z)) = lower(trim(w)) THEN NULL ELSE z END AS object_value, "at" FROM ent2)"""


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@query("ingest_episodes", _TALK + " SELECT id, content, round(least(1.0, length(content) / 500::DOUBLE), 3) AS salience FROM kept")
def _(s: SparkSession, d: str) -> DataFrame:
    return _filled(s, d).read("episodes").select("id", "content", "salience")


@query("ingest_entities", _TALK + " SELECT eid AS id, min(\"at\") AS created_at FROM ent2 GROUP BY eid")
def _(s: SparkSession, d: str) -> DataFrame:
    return _filled(s, d).read("entities").select("id", "created_at")


@query("ingest_facts", _TALK + " SELECT id, subject_id, object_id, object_value FROM fct")
def _(s: SparkSession, d: str) -> DataFrame:
    return _filled(s, d).read("facts").select("id", "subject_id", "object_id", "object_value")


@query("ingest_conflicts", _TALK + """, obj AS (SELECT *, coalesce('id ' || object_id, 'value ' || object_value) AS o FROM fct)
SELECT a.id, max(b."at") AS invalidated_at FROM obj a JOIN obj b ON a.subject_id = b.subject_id AND a.o <> b.o AND (a."at", a.id) < (b."at", b.id) GROUP BY a.id""")
def _(s: SparkSession, d: str) -> DataFrame:
    return _filled(s, d).read("facts").where("invalidated_at is not null").select("id", "invalidated_at")


@query("ingest_vectors", _TALK + " SELECT kind, count(*) AS n, min(dims)::BIGINT AS dims FROM (SELECT 'episode' AS kind, id, 64 AS dims FROM kept UNION SELECT 'entity', eid, 64 FROM ent2) GROUP BY kind")
def _(s: SparkSession, d: str) -> DataFrame:
    return _filled(s, d).read("vectors").groupBy("kind").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dims"))


@query("vector_update", "SELECT 'v' || vec_id AS id, label AS level, round(CASE WHEN label = 1 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings WHERE label <> 3")
def _(s: SparkSession, d: str) -> DataFrame:
    store = I.open_store(s, f"{shared_dir(s)}/tidemark-store-{uuid.uuid4().hex}")
    rows = table(s, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.lit("episode").alias("kind"), F.col("label").cast("int").alias("level"), F.col("embedding").cast("array<double>").alias("embedding"))
    store.append("vectors", rows)
    store.append("vectors", rows.where("level = 1").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    store.delete("vectors", rows.where("level = 3"))
    return store.read("vectors").select("id", F.col("level").cast("long").alias("level"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"))
