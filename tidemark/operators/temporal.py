"""Bi-temporal facts: what was known when, and what held when.

Intervals are half-open; a null bound is open.  Without a time given, invalidated
facts are hidden; with an event time alone they are not (they say what was once
believed).  Rows are kept as stored, repeated ones included; an empty table gives
an empty result; columns other than those of a fact pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import blank_to_null, latest, moment


def known_at(when: str | Column) -> Column:
    """Recorded by then and not yet invalidated."""
    t = moment(when) if isinstance(when, str) else when
    return (F.col("recorded_at") <= t) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > t))


def holds_at(when: str | Column) -> Column:
    """Valid then, whether or not invalidated since."""
    t = moment(when) if isinstance(when, str) else when
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def facts_current(facts: DataFrame, predicate: str | None = None) -> DataFrame:
    live = facts.where("invalidated_at is null")
    return live.where(F.col("predicate") == predicate) if predicate is not None else live


def facts_as_of(facts: DataFrame, when: str) -> DataFrame:
    return facts.where(known_at(when))


def facts_valid_at(facts: DataFrame, when: str) -> DataFrame:
    return facts.where(holds_at(when))


def facts_bitemporal(facts: DataFrame, as_of: str | None = None, valid_at: str | None = None) -> DataFrame:
    """Both times given: both conditions; neither: every fact."""
    out = facts
    if as_of is not None:
        out = facts_as_of(out, as_of)
    if valid_at is not None:
        out = facts_valid_at(out, valid_at)
    return out


def fact_history(facts: DataFrame) -> DataFrame:
    """The facts of each subject and predicate in order of recording, with ``step`` and whether the object ``changed``."""
    w = Window.partitionBy("subject_id", "predicate").orderBy("recorded_at", "id", "valid_from", "valid_to")
    before = F.lag(F.coalesce("object_id", "object_value")).over(w)
    now = F.coalesce("object_id", "object_value")
    return facts.withColumn("step", F.row_number().over(w)).withColumn("changed", (F.col("step") == 1) | ~now.eqNullSafe(before))


def facts_as_of_batch(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """Facts known at each asked (``subject_id``, ``asked_at``): an equi-join with the times as residual condition."""
    f, q = facts.alias("f"), asked.alias("q")
    t = F.col("q.asked_at")
    there = (F.col("f.recorded_at") <= t) & (F.col("f.invalidated_at").isNull() | (F.col("f.invalidated_at") > t))
    return f.join(q, (F.col("f.subject_id") == F.col("q.subject_id")) & there).select("q.subject_id", "q.asked_at", "f.id", "f.predicate")


def invalidate(facts: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """The facts with ``invalidated_at`` set on those in ``ids`` (column ``id``), over any earlier stamp."""
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return facts.join(marked, "id", "left").withColumn("invalidated_at", F.when(F.col("_hit"), moment(at)).otherwise(F.col("invalidated_at"))).drop("_hit")


def latest_facts(facts: DataFrame) -> DataFrame:
    """One row per fact id: the one recorded last."""
    return latest(facts, ["id"], [F.desc("recorded_at"), F.desc("invalidated_at")])


def fact_conflicts(facts: DataFrame, require_overlap: bool = False) -> DataFrame:
    """Live facts on one subject and predicate whose objects differ, aggregated per subject and predicate.

    Two objects differ if both have an id and the ids differ, else if both have a value
    and the values differ, else if one has an id and the other a value; an empty string
    is no object.  Groups of equal objects are counted first, so a crowded key costs
    its distinct objects, not its pairs of facts: ``n_pairs`` is the number of
    conflicting pairs of fact ids.  With ``require_overlap`` the valid times of a pair
    must overlap, which needs the pairs themselves (``overlapping_conflicts``).
    """
    if require_overlap:
        return overlapping_conflicts(facts)
    kinds = latest_facts(facts).where("invalidated_at is null").select(
        "subject_id", "predicate", blank_to_null("object_id").alias("oid"), F.when(blank_to_null("object_id").isNull(), blank_to_null("object_value")).alias("value"), blank_to_null("object_value").alias("any_value")
    )
    # by id: ids differ. Both without id: values differ. One with an id, one without: differs if the other has a value
    shape = kinds.groupBy("subject_id", "predicate", "oid", "value").agg(F.count("*").alias("n"))
    per = shape.groupBy("subject_id", "predicate").agg(
        F.sum(F.when(F.col("oid").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"), F.sum(F.when(F.col("oid").isNotNull(), F.col("n") * F.col("n")).otherwise(0)).alias("same_id"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("with_value"), F.sum(F.when(F.col("value").isNotNull(), F.col("n") * F.col("n")).otherwise(0)).alias("same_value"),
    )
    pairs = (F.col("with_id") * F.col("with_id") - F.col("same_id")) / 2 + (F.col("with_value") * F.col("with_value") - F.col("same_value")) / 2 + F.col("with_id") * F.col("with_value")
    return per.select("subject_id", "predicate", pairs.cast("long").alias("n_pairs")).where("n_pairs > 0")


def fact_by_id(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """The latest row of each asked id (first column of ``ids``)."""
    return latest_facts(facts.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi"))


def conflicting_pairs(live: DataFrame, new: DataFrame) -> DataFrame:
    """``new_id``, ``new_at``, ``old_id``: live facts recorded before a new one (``id``) on the same subject and predicate whose objects differ."""
    obj = F.coalesce(F.concat(F.lit("id "), blank_to_null("object_id")), F.concat(F.lit("value "), blank_to_null("object_value")))
    rows = live.select("id", "subject_id", "predicate", "recorded_at", obj.alias("obj")).where("obj is not null")
    n, o = rows.join(new.select("id"), "id", "left_semi").alias("n"), rows.alias("o")
    same = (F.col("n.subject_id") == F.col("o.subject_id")) & (F.col("n.predicate") == F.col("o.predicate"))
    older = F.struct(F.col("o.recorded_at"), F.col("o.id")) < F.struct(F.col("n.recorded_at"), F.col("n.id"))
    return n.join(o, same & older & (F.col("n.obj") != F.col("o.obj"))).select(F.col("n.id").alias("new_id"), F.col("n.recorded_at").alias("new_at"), F.col("o.id").alias("old_id"))


def superseded(live: DataFrame, new: DataFrame) -> DataFrame:
    """``id``, ``at``: live facts that a later new one (``id``) with another object contradicts, and when the last of these was recorded.

    Two maxima per subject and predicate tell it, without pairs: the last new fact, and the last with another object than that.
    """
    obj = F.coalesce(F.concat(F.lit("id "), blank_to_null("object_id")), F.concat(F.lit("value "), blank_to_null("object_value")))
    rows = live.select("id", "subject_id", "predicate", "recorded_at", obj.alias("obj")).where("obj is not null and subject_id is not null and predicate is not null")
    fresh = rows.join(new.select("id"), "id", "left_semi")
    key = ["subject_id", "predicate"]
    last = fresh.groupBy(*key).agg(F.max(F.struct("recorded_at", "id", "obj")).alias("best"))
    other = fresh.join(last, key).where("obj <> best.obj").groupBy(*key).agg(F.max(F.struct("recorded_at", "id", "obj")).alias("second"))
    joined = rows.join(last, key).join(other, key, "left")
    rival = F.when(F.col("best.obj") != F.col("obj"), F.col("best")).otherwise(F.col("second"))
    found = joined.select("id", F.struct("recorded_at", "id").alias("own"), rival.alias("rival"))
    return found.where(F.struct("rival.recorded_at", "rival.id") > F.col("own")).select("id", F.col("rival.recorded_at").alias("at"))


def apply_resolution(facts: DataFrame, resolved: DataFrame, at: str) -> DataFrame:
    """The facts with those stamped that parsed resolutions (``invalidate``: ids) name."""
    return invalidate(facts, resolved.where("error is null").select(F.explode("invalidate").alias("id")), at)


def overlapping_conflicts(facts: DataFrame) -> DataFrame:
    """``n_facts``: live facts that conflict with one before them in time, on one subject and predicate.

    In order of start, a fact conflicts if an earlier one with another object still held.
    Running maxima tell, without forming pairs: the furthest end so far with its object, and
    the furthest end of any other object.  The latter is the maximum over the lesser of each
    fact and the furthest before it, where their objects differ.
    """
    live = latest_facts(facts).where("invalidated_at is null").where("valid_from is null or valid_to is null or valid_from < valid_to")
    obj = F.coalesce(F.concat(F.lit("id "), blank_to_null("object_id")), F.concat(F.lit("value "), blank_to_null("object_value")))
    low, high = F.coalesce(F.unix_micros(F.col("valid_from").cast("timestamp")), F.lit(-(2**62))), F.coalesce(F.unix_micros(F.col("valid_to").cast("timestamp")), F.lit(2**62))
    rows = live.select("id", "subject_id", "predicate", obj.alias("obj"), low.alias("lo"), high.alias("hi")).where("obj is not null")
    prior = Window.partitionBy("subject_id", "predicate").orderBy("lo", "hi", "id").rowsBetween(Window.unboundedPreceding, -1)
    led = rows.withColumn("best", F.max(F.struct("hi", "obj")).over(prior))
    led = led.withColumn("lesser", F.when(F.col("best.obj") != F.col("obj"), F.least("hi", "best.hi"))).withColumn("second", F.max("lesser").over(prior))
    rival = F.when(F.col("best.obj") != F.col("obj"), F.col("best.hi")).otherwise(F.col("second"))
    return led.where(rival > F.col("lo")).groupBy("subject_id", "predicate").agg(F.count("*").alias("n_facts"))
