"""Curation around a model: answers in JSON are parsed, checked and clamped natively.

The model itself is pluggable (:mod:`tidemark.functions.models`).  A parser never fails a
job: an answer that can't be used gives ``error`` instead of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import blank_to_null, braced, fenced

# Kinds of links, strategies and patterns.
LINK_TYPES = ("semantic", "temporal", "causal", "analogical")
STRATEGIES = ("temporal_succession", "confidence_adjustment", "coexistence", "rejection")
PATTERN_TYPES = ("behavioral", "preference", "procedural", "error")


def _field(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


def _number(json: Column, name: str) -> Column:
    return _field(json, name).try_cast("double")


def parse_salience(df: DataFrame, answer: str, truncated: str | None = None) -> DataFrame:
    """``score``, ``reasoning``, ``memory_type``, ``error``; a score from truncated text above 0.3 loses 0.1, not below 0.3."""
    j = braced(F.col(answer))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _number(j, "score")))
    if truncated is not None:
        score = F.when(F.col(truncated) & (score > 0.3), F.greatest(F.lit(0.3), score - 0.1)).otherwise(score)
    bad = _number(j, "score").isNull() | _field(j, "reasoning").isNull() | _field(j, "memory_type").isNull()
    return df.withColumns({"score": F.when(~bad, score), "memory_type": F.when(~bad, _field(j, "memory_type")), "error": F.when(bad, "invalid answer")})


def salience_tier(score: Column) -> Column:
    """none below 0.3, brief below 0.6, full below 0.8, else linked."""
    return F.when(score.isNull() | (score < 0.3), "none").when(score < 0.6, "brief").when(score < 0.8, "full").otherwise("linked")


def parse_link(df: DataFrame, answer: str) -> DataFrame:
    """``should_link``, ``link_type``, ``weight``, ``error``: fence stripped, four keys required, unknown types semantic, weight in [0, 1]."""
    j = fenced(F.col(answer))
    kind, weight = _field(j, "link_type"), _number(j, "weight")
    bad = _field(j, "should_link").isNull() | kind.isNull() | weight.isNull() | _field(j, "reasoning").isNull()
    return df.withColumns(
        {
            "should_link": F.when(~bad, _field(j, "should_link") == "true"), "link_type": F.when(~bad, F.when(kind.isin(*LINK_TYPES), kind).otherwise("semantic")),
            "weight": F.when(~bad, F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight))), "error": F.when(bad, "invalid answer"),
        }
    )


def bracketed(c: Column, wrapper: str) -> Column:
    """The JSON list in an answer: a list, an object holding one under ``wrapper``, or a single object."""
    lst, obj = F.instr(c, "["), F.instr(c, "{")
    listed = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    whole = braced(c)
    inner = _field(whole, wrapper)
    single = F.concat(F.lit("["), whole, F.lit("]"))
    return F.when((lst > 0) & ((obj == 0) | (lst < obj)), listed).when(obj > 0, F.coalesce(inner, single))


def parse_entities(df: DataFrame, id_col: str, answer: str) -> DataFrame:
    """id, ``name``, ``entity_type``, ``confidence`` of the usable rows: name and type given, confidence in [0, 1], 1 by default."""
    rows = F.from_json(bracketed(F.col(answer), "entities"), "array<struct<name:string,type:string,entity_type:string,confidence:double>>")
    each = df.select(F.col(id_col), F.explode(rows).alias("e")).select(id_col, "e.name", F.coalesce("e.type", "e.entity_type").alias("entity_type"), F.coalesce("e.confidence", F.lit(1.0)).alias("confidence"))
    return each.where("name is not null and name <> '' and entity_type is not null and confidence between 0 and 1")


def parse_facts(df: DataFrame, id_col: str, answer: str) -> DataFrame:
    """id, ``subject``, ``predicate``, ``object``, ``confidence`` of the usable rows."""
    rows = F.from_json(bracketed(F.col(answer), "facts"), "array<struct<subject:string,predicate:string,object:string,confidence:double>>")
    each = df.select(F.col(id_col), F.explode(rows).alias("f")).select(id_col, "f.subject", "f.predicate", "f.object", F.coalesce("f.confidence", F.lit(1.0)).alias("confidence"))
    return each.where("subject is not null and predicate is not null and object is not null and confidence between 0 and 1")


def parse_resolution(df: DataFrame, answer: str) -> DataFrame:
    """``strategy``, ``invalidate`` (fact ids), ``error``; an unknown strategy or a missing key is an error."""
    j = braced(F.col(answer))
    strategy = _field(j, "strategy")
    ids = F.from_json(_field(j, "invalidations"), "array<string>")
    bad = strategy.isNull() | ~strategy.isin(*STRATEGIES) | ids.isNull()
    return df.withColumns({"strategy": F.when(~bad, strategy), "invalidate": F.when(~bad, F.sort_array(ids)), "error": F.when(bad, "invalid answer")})


def parse_summary(df: DataFrame, answer: str) -> DataFrame:
    """``summary``, ``salience`` (clamped, 0.5 by default), ``error``; the whole answer must be JSON."""
    j = fenced(F.col(answer))
    text = _field(j, "summary")
    return df.withColumns({"parsed_summary": text, "parsed_salience": F.when(text.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(_number(j, "salience"), F.lit(0.5))))), "error": F.when(text.isNull(), "invalid answer")})


def parse_pattern(df: DataFrame, answer: str) -> DataFrame:
    """``description``, ``pattern_type``, ``confidence`` in [0, 1], ``error`` for a missing description or an unknown type."""
    j = fenced(F.col(answer))
    text, kind = _field(j, "description"), _field(j, "pattern_type")
    bad = text.isNull() | kind.isNull() | ~kind.isin(*PATTERN_TYPES)
    return df.withColumns({"description": F.when(~bad, text), "pattern_type": F.when(~bad, kind), "confidence": F.when(~bad, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(_number(j, "confidence"), F.lit(0.5))))), "error": F.when(bad, "invalid answer")})


def parse_evolution(df: DataFrame, answer: str) -> DataFrame:
    """``changes``, ``context``, ``new_keywords``, ``new_tags``, ``new_salience``, ``error``; an update of type none changes nothing."""
    j = braced(F.col(answer))
    words = lambda name: F.from_json(_field(j, name), "array<string>")
    bad = _field(j, "should_update").isNull() | _field(j, "update_type").isNull()
    changes = ~bad & (_field(j, "should_update") == "true") & (F.lower(_field(j, "update_type")) != "none")
    return df.withColumns({"changes": F.coalesce(changes, F.lit(False)), "context": _field(j, "context"), "new_keywords": words("keywords"), "new_tags": words("tags"), "new_salience": _number(j, "salience"), "error": F.when(bad, "invalid answer")})


def evolution_merge(df: DataFrame, new_context: Column, new_keywords: Column, new_tags: Column, new_salience: Column) -> DataFrame:
    """Context appended with a blank, keywords and tags united and sorted, salience replaced if in [0, 1]."""
    none = F.array().cast("array<string>")

    def united(old: str, new: Column) -> Column:
        return F.array_sort(F.array_distinct(F.concat(F.coalesce(F.col(old), none), F.coalesce(new, none))))

    context = F.concat_ws(" ", blank_to_null("context_description"), blank_to_null(new_context))
    return df.select("id", context.alias("context_description"), united("keywords", new_keywords).alias("keywords"), united("tags", new_tags).alias("tags"), F.when(new_salience.between(0, 1), new_salience).otherwise(F.col("salience")).alias("salience"))
