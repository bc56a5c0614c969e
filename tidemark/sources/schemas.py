"""Schemas of the domain tables and their keys."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

_TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "timestamp_ntz": TimestampNTZType(), "array<string>": ArrayType(StringType()), "array<double>": ArrayType(DoubleType())}


def _struct(ddl: str) -> StructType:
    pairs = (column.split(" ") for column in ddl.split(", "))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, StructType] = {
    name: _struct(ddl)
    for name, ddl in {
        "entities": "id string, name string, entity_type string, created_at timestamp_ntz, last_accessed timestamp_ntz, access_count long, metadata string",
        "facts": "id string, subject_id string, predicate string, object_id string, object_value string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, invalidated_at timestamp_ntz, confidence double, source_episode_id string, metadata string",
        "episodes": "id string, level int, parent_id string, content string, summary string, context_description string, keywords array<string>, tags array<string>, occurred_at timestamp_ntz, recorded_at timestamp_ntz, salience double, access_count long, last_accessed timestamp_ntz, consolidation_strength double, consolidated_into string, metadata string",
        "episode_links": "id string, source_id string, target_id string, link_type string, weight double, created_at timestamp_ntz",
        "retrieval_indices": "id string, index_type string, key string, episode_id string, note string",
        "communities": "id string, name string, description string, entity_ids array<string>, created_at timestamp_ntz, metadata string",
        "community_members": "id string, community_id string",
        "access_log": "id string, at timestamp_ntz, kind string",
        "vectors": "id string, kind string, level int, entity_type string, document string, embedding array<double>",
        "patterns": "id string, description string, pattern_type string, confidence double, occurrences array<string>, embedding array<double>, first_seen timestamp_ntz, last_seen timestamp_ntz",
    }.items()
}
#: Keys other than ``id``; None makes a log, all of whose rows count.
KEYS: dict[str, str | None] = {"access_log": None}
