"""Entities, communities and access counts.  Repeated rows (same id) count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import latest

# How ids are written.
ENTITY_ID = r"^ent_[a-f0-9\-]+$"
EPISODE_ID = r"^epi_[a-f0-9\-]+$"
FACT_ID = r"^fct_[a-f0-9\-]+$"


def unique_entities(entities: DataFrame) -> DataFrame:
    """One row per id: the latest created, then the smaller name."""
    return latest(entities, ["id"], [F.desc("created_at"), F.asc("name")])


def contains_folded(c: Column | str, text: str) -> Column:
    """Case-insensitive containment; % and _ in the text are ordinary characters."""
    return F.contains(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(text.lower()))


def find(entities: DataFrame, name: str, entity_type: str | None = None) -> DataFrame:
    """Entities whose name contains ``name``, newest first."""
    out = unique_entities(entities).where(contains_folded("name", name))
    if entity_type is not None:
        out = out.where(F.lower(F.trim("entity_type")) == entity_type.lower())
    return out.orderBy(F.desc("created_at"), "id")


def look_up(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of the asked ids; asked ids without a row give none."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


def access_rollup(base: DataFrame, log: DataFrame) -> DataFrame:
    """``id``, ``access_count`` and ``last_accessed`` with an append log (``id``, ``at``) added."""
    seen = log.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    out = base.select("id", "access_count", "last_accessed").join(seen, "id", "left")
    return out.select("id", (F.coalesce("access_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("access_count"), F.greatest("last_accessed", "at").alias("last_accessed"))


def community_members(communities: DataFrame, entities: DataFrame) -> DataFrame:
    """Members in list order; missing entities are skipped.  communities: ``community_id``, ``entity_ids``."""
    listed = communities.select("community_id", F.posexplode("entity_ids").alias("at", "id"))
    return listed.join(unique_entities(entities).select("id", "name"), "id").select("community_id", F.col("at").cast("long").alias("at"), "id", "name")


def community_add(communities: DataFrame, new: DataFrame) -> DataFrame:
    """Appends ``id`` to the community's list unless it is there; existing repeats stay."""
    joined = communities.join(new, "community_id", "left")
    ids = F.when(F.col("id").isNull() | F.array_contains("entity_ids", F.col("id")), F.col("entity_ids")).otherwise(F.array_append("entity_ids", F.col("id")))
    return joined.select("community_id", ids.alias("entity_ids"))


def member_names(members: DataFrame, entities: DataFrame) -> DataFrame:
    """The members that exist, with their names; members: a row per ``community_id`` and ``id``, so a community may be of any size."""
    return members.select("community_id", "id").distinct().join(unique_entities(entities).select("id", "name", "created_at"), "id")


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``members`` and the new ones that are not there yet."""
    key = ["community_id", "id"]
    return members.select(*key).unionByName(new.select(*key).distinct().join(members.select(*key), key, "left_anti"))


def invalid_ids(df: DataFrame, id_col: str, pattern: str) -> DataFrame:
    return df.where(F.col(id_col).isNull() | ~F.col(id_col).rlike(pattern))


def dangling(df: DataFrame, ref_col: str, target: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose reference is set but has no target."""
    named = df.where(F.col(ref_col).isNotNull() & (F.col(ref_col) != ""))
    return named.join(target.select(F.col(id_col).alias(ref_col)).distinct(), ref_col, "left_anti")


def duplicates(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that stand in more than one row, with ``n``."""
    return df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def newest_per(df: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """At most ``n`` rows of each key by ``order``, with ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def resolve(new: DataFrame, known: DataFrame, most_edits: int = 1, others_only: bool = False) -> DataFrame:
    """The known entity that each new one is: ``new_id``, ``id``, ``edits``.

    Same type, equal names before similar ones, the smaller id on ties; similar means at
    most ``most_edits`` edits.  Two names within that many edits agree in at least one of
    ``most_edits + 1`` pieces up to a shift, so pieces are the join keys and no cross join is needed.
    ``others_only`` leaves out matches of an id with itself.
    """
    pieces = most_edits + 1

    def keyed(df: DataFrame, id_name: str, shifted: bool) -> DataFrame:
        name = F.lower(F.trim("name"))
        rows = df.where("name is not null and id is not null").select(F.col("id").alias(id_name), name.alias("n"), F.lower(F.trim("entity_type")).alias("t")).distinct()
        size = F.length("n")
        # piece p of a name of length L is the text from floor(p L / pieces) on; lengths may differ by the edits
        lengths = F.explode(F.sequence(F.greatest(F.lit(0), size - most_edits), size + most_edits)) if shifted else F.explode(F.array(size))
        rows = rows.select("*", lengths.alias("cut_for")).select("*", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("p"))
        begin, end = F.floor(F.col("p") * F.col("cut_for") / pieces), F.floor((F.col("p") + 1) * F.col("cut_for") / pieces)
        rows = rows.select("*", begin.alias("begin"), (end - begin).alias("span"))
        shifts = F.explode(F.sequence(F.lit(-most_edits), F.lit(most_edits))) if shifted else F.explode(F.array(F.lit(0)))
        rows = rows.select("*", shifts.alias("shift")).where(F.col("begin") + F.col("shift") >= 0)
        return rows.select(id_name, F.col("n").alias(f"n_{id_name}"), "t", "cut_for", "p", F.substring(F.col("n"), (F.col("begin") + F.col("shift") + 1).cast("int"), F.col("span").cast("int")).alias("piece")).distinct()

    met = keyed(new, "new_id", True).join(keyed(known, "id", False), ["t", "cut_for", "p", "piece"]).select("new_id", "id", "n_new_id", "n_id").distinct()
    near = met.withColumn("edits", F.levenshtein("n_new_id", "n_id", most_edits)).where("edits >= 0")
    near = near.where("new_id <> id") if others_only else near
    w = Window.partitionBy("new_id").orderBy("edits", "id")
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("new_id", "id", F.col("edits").cast("long").alias("edits"))
