"""Ingest and the consolidation cycle over the versioned store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import moment, tokens
from tidemark.functions.models import Embedder, HashingEmbedder, Judge, LengthJudge, embed_column, judge_column
from tidemark.functions.prompts import prompt
from tidemark.operators import consolidation as K
from tidemark.operators import curation as U
from tidemark.operators import episodes as P
from tidemark.operators import links as L
from tidemark.operators import records as S
from tidemark.operators import temporal as T
from tidemark.operators import vectors as V
from tidemark.sources.schemas import KEYS, SCHEMAS
from tidemark.sources.store import Store
from tidemark.sources.tables import materialise


def open_store(spark, root: str) -> Store:
    """The store with all its tables; those that exist keep their rows."""
    store = Store(spark, root)
    for name, schema in SCHEMAS.items():
        store.create(name, schema, KEYS.get(name, "id"))
    return store


def scored(interactions: DataFrame, judge: Judge | None = None, longest: int = 4000) -> DataFrame:
    """interactions: ``conv_id``, ``seq``, ``question``, ``answer``, ``at``.  Adds ``id``, ``content``, ``score``, ``error``.

    The judge sees at most ``longest`` characters and is told off by 0.1 for a cut text.
    """
    content = F.concat(F.lit("user: "), F.coalesce("question", F.lit("")), F.lit("\nassistant: "), F.coalesce("answer", F.lit("")))
    key = F.sha2(F.concat_ws("\x1f", F.col("conv_id").cast("string"), F.col("seq").cast("string"), content), 256)
    rows = interactions.select("*", content.alias("content"), F.concat(F.lit("epi_"), key).alias("id"))
    cut = F.length("content") > longest
    rows = rows.withColumn("cut", cut).withColumn("judged", judge_column(judge or LengthJudge())(F.substring("content", 1, longest)))
    return U.parse_salience(rows, "judged", "cut").drop("cut", "judged")


@dataclass
class Curator:
    """The judges of each step and the embedder; a step without a judge does what needs none.

    Without them nothing is extracted, links follow from likeness alone, nothing evolves,
    and of conflicting facts the one recorded later stands.
    """

    salience: Judge = field(default_factory=LengthJudge)
    entities: Judge | None = None
    facts: Judge | None = None
    link: Judge | None = None
    evolution: Judge | None = None
    resolution: Judge | None = None
    embedder: Embedder = field(default_factory=HashingEmbedder)
    least_salience: float = 0.3
    candidates: int = 20
    least_likeness: float = 0.75
    evolving: int = 5


def ingest(store: Store, interactions: DataFrame, judge: Judge | None = None, least: float = 0.3, curator: Curator | None = None) -> DataFrame:
    """Stores the interactions worth keeping, with what they state; one row per interaction: ``id``, ``stored``, ``score``, ``error``, ``tokens``.

    Salience, episodes, entities, facts, links, evolution, conflicts, in that order.  Each judge sees
    each text once, as every step is written before the next reads it; ids follow from content,
    so the same interactions again add nothing.
    """
    c = curator or Curator(salience=judge or LengthJudge(), least_salience=least)
    rows = materialise(scored(interactions, c.salience).withColumn("stored", F.coalesce(F.col("score") >= c.least_salience, F.lit(False))).select("id", "content", "at", "stored", "score", "error"))
    known = store.read("episodes").select("id")
    fresh = materialise(rows.where("stored").dropDuplicates(["id"]).join(known, "id", "left_anti"))
    episodes = fresh.select("id", F.lit(0).alias("level"), "content", F.col("at").alias("occurred_at"), F.col("at").alias("recorded_at"), F.col("score").alias("salience"), F.lit(0).alias("access_count"), F.lit(5.0).alias("consolidation_strength"))
    store.append("episodes", episodes)
    S.put_vectors(store, S.episode_documents(episodes), c.embedder)
    named = extract_entities(store, fresh, c)
    stated = extract_facts(store, fresh, named, c)
    near = link_episodes(store, fresh, c)
    evolve(store, fresh, near, c)
    resolve_conflicts(store, stated, c)
    return rows.select("id", "stored", "score", "error", tokens(F.col("content")).alias("tokens"))


def extract_entities(store: Store, fresh: DataFrame, c: Curator) -> DataFrame:
    """New entities of the episodes (``id``, ``content``, ``at``); gives ``episode_id``, ``id``, ``name`` of all that are named."""
    if c.entities is None:
        return fresh.select(F.col("id").alias("episode_id"), F.lit("").alias("id"), F.lit("").alias("name")).limit(0)
    answered = fresh.select("id", "at", judge_column(c.entities)(prompt("entities", content=F.col("content"))).alias("answer"))
    found = U.parse_entities(answered, "id", "answer").withColumnRenamed("id", "episode_id")
    # one name and type is one entity
    named = materialise(found.withColumn("id", S.make_id("entity", F.lower(F.trim("name")), F.lower(F.trim("entity_type")))))
    first = named.join(fresh.select(F.col("id").alias("episode_id"), "at"), "episode_id").groupBy("id").agg(F.min(F.struct("at", "name", "entity_type")).alias("e"))
    new = materialise(first.join(store.read("entities").select("id"), "id", "left_anti").select("id", "e.name", "e.entity_type", F.col("e.at").alias("created_at"), F.lit(0).alias("access_count")))
    store.append("entities", new)
    S.put_vectors(store, S.entity_documents(new), c.embedder)
    return named.select("episode_id", "id", "name").distinct()


def extract_facts(store: Store, fresh: DataFrame, named: DataFrame, c: Curator) -> DataFrame:
    """New facts on the entities named in the same episode; an object that is one of them becomes a reference, else a value."""
    if c.facts is None:
        return store.read("facts").limit(0)
    names = named.groupBy("episode_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("entities"))
    asked = fresh.join(names, fresh["id"] == names["episode_id"]).select("id", "at", judge_column(c.facts)(prompt("facts", entities=F.col("entities"), content=F.col("content"))).alias("answer"))
    found = U.parse_facts(asked, "id", "answer").withColumnRenamed("id", "episode_id")
    key = named.select("episode_id", F.lower(F.trim("name")).alias("k"), "id").groupBy("episode_id", "k").agg(F.min("id").alias("id"))
    subject = key.select("episode_id", F.col("k").alias("s"), F.col("id").alias("subject_id"))
    other = key.select("episode_id", F.col("k").alias("o"), F.col("id").alias("object_id"))
    joined = found.withColumn("s", F.lower(F.trim("subject"))).withColumn("o", F.lower(F.trim("object"))).join(subject, ["episode_id", "s"]).join(other, ["episode_id", "o"], "left")
    at = fresh.select(F.col("id").alias("episode_id"), "at")
    rows = joined.join(at, "episode_id").select(
        S.make_id("fact", "subject_id", "predicate", "object", "episode_id").alias("id"), "subject_id", "predicate", "object_id", F.when(F.col("object_id").isNull(), F.col("object")).alias("object_value"),
        F.col("at").alias("valid_from"), F.col("at").alias("recorded_at"), "confidence", F.col("episode_id").alias("source_episode_id"),
    )
    new = materialise(rows.dropDuplicates(["id"]).join(store.read("facts").select("id"), "id", "left_anti"))
    store.append("facts", S.with_references(new, "subject_id", store.read("entities"), strict=False))
    return new


def link_episodes(store: Store, fresh: DataFrame, c: Curator) -> DataFrame:
    """Links from each new episode to its nearest ones of the same level; gives the candidates ``source_id``, ``target_id``, ``rank``, ``likeness``.

    The search compares all new episodes with all; it is made only if a judge or a likeness that can be reached asks for its result.
    """
    if c.link is None and c.evolution is None and c.least_likeness > 1:  # likeness is 1 at most
        return fresh.select(F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit(0).alias("rank"), F.lit(0.0).alias("likeness")).limit(0)
    vectors = materialise(store.read("vectors").where("kind = 'episode'").select("id", "level", "embedding"))
    own = vectors.join(fresh.select("id"), "id", "left_semi")
    near = V.topk_batch(vectors, own, c.candidates, id_col="id").withColumn("likeness", 1 - F.col("distance") / 2)
    levels = vectors.select("id", "level")
    same = near.join(levels.select(F.col("id").alias("query_id"), F.col("level").alias("_a")), "query_id").join(levels.withColumnRenamed("level", "_b"), "id").where(F.col("_a").eqNullSafe(F.col("_b")))
    near = materialise(same.select(F.col("query_id").alias("source_id"), F.col("id").alias("target_id"), "rank", "likeness"))
    if c.link is None:
        made = near.where(F.col("likeness") >= c.least_likeness).select("source_id", "target_id", F.lit("semantic").alias("link_type"), F.col("likeness").alias("weight"))
    else:
        text = store.read("episodes").select("id", "content")
        left, right = text.select(F.col("id").alias("source_id"), F.col("content").alias("left")), text.select(F.col("id").alias("target_id"), F.col("content").alias("right"))
        asked = near.join(left, "source_id").join(right, "target_id")
        answered = asked.select("source_id", "target_id", judge_column(c.link)(prompt("link", left=F.col("left"), right=F.col("right"))).alias("answer"))
        made = U.parse_link(answered, "answer").where("should_link").select("source_id", "target_id", "link_type", "weight")
    at = fresh.select(F.col("id").alias("source_id"), F.col("at").alias("created_at"))
    S.insert_links(store, materialise(made.join(at, "source_id").withColumn("id", S.make_id("link", "source_id", "target_id", "link_type"))), strict=False)
    return near


def evolve(store: Store, fresh: DataFrame, near: DataFrame, c: Curator) -> None:
    """Lets each new episode change its nearest ones, unless they are firm (strength above 9)."""
    if c.evolution is None:
        return
    episodes = store.read("episodes")
    old = episodes.where("coalesce(consolidation_strength, 0) <= 9").withColumnRenamed("id", "target_id")
    asked = near.where(F.col("rank") <= c.evolving).join(fresh.select(F.col("id").alias("source_id"), F.col("content").alias("new")), "source_id").join(old.select("target_id", F.col("content").alias("old")), "target_id")
    answered = asked.select("source_id", "target_id", judge_column(c.evolution)(prompt("evolution", left=F.col("old"), right=F.col("new"))).alias("answer"))
    # of several new episodes that would change one, the first by id does
    first = U.parse_evolution(answered, "answer").where("changes").groupBy("target_id").agg(F.min(F.struct("source_id", "context", "new_keywords", "new_tags", "new_salience")).alias("n"))
    rows = materialise(episodes.join(first.withColumnRenamed("target_id", "id"), "id"))
    merged = U.evolution_merge(rows, F.col("n.context"), F.col("n.new_keywords"), F.col("n.new_tags"), F.col("n.new_salience"))
    changed = rows.drop("n", "context_description", "keywords", "tags", "salience").join(merged, "id")
    store.append("episodes", changed.withColumn("consolidation_strength", F.coalesce("consolidation_strength", F.lit(0.0))))


def resolve_conflicts(store: Store, stated: DataFrame, c: Curator) -> DataFrame:
    """Invalidates what new facts contradict; gives the ids (``id``, ``at``).

    Without a judge the older of two conflicting facts goes; a judge names the facts that go.
    """
    every = T.latest_facts(store.read("facts"))
    live = every.where("invalidated_at is null")
    if c.resolution is None:
        gone = T.superseded(live, stated.select("id"))
    else:
        pairs = materialise(T.conflicting_pairs(live, stated.select("id")))
        say = F.concat_ws(" ", "subject_id", "predicate", F.coalesce("object_id", "object_value"), F.concat(F.lit("("), F.col("id"), F.lit(")")))
        text = every.select("id", say.alias("says"))
        asked = pairs.join(text.select(F.col("id").alias("old_id"), F.col("says").alias("left")), "old_id").join(text.select(F.col("id").alias("new_id"), F.col("says").alias("right")), "new_id")
        answered = asked.select("old_id", "new_id", "new_at", judge_column(c.resolution)(prompt("resolution", left=F.col("left"), right=F.col("right"))).alias("answer"))
        told = U.parse_resolution(answered, "answer").where("error is null")
        gone = told.select("new_at", "old_id", "new_id", F.explode("invalidate").alias("id")).where("id in (old_id, new_id)").select("id", F.col("new_at").alias("at"))
    last = materialise(gone.groupBy("id").agg(F.max("at").alias("at")))
    rows = materialise(every.join(last, "id").withColumn("invalidated_at", F.col("at")).drop("at"))
    if not rows.isEmpty():
        store.append("facts", rows)
    return last


def record_access(store: Store, ids: DataFrame, at: str, kind: str) -> None:
    S.record_access(store, ids, at, kind)


def run_cycle(store: Store, now: str, window_hours: int = 1, rate: float = 0.1, floor: float = 0.1, threshold: float = 0.15, pattern_judge: Judge | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Summaries of raw clusters, patterns, link maintenance, pruning, communities, in that order; one row of counts.

    Every step writes a version before the next one reads.
    """
    raw = store.read("episodes").where("level = 0 and nullif(parent_id, '') is null")
    keyed = raw.withColumn("conv", F.date_trunc("month", F.col("occurred_at").cast("timestamp")).cast("string"))
    clusters = materialise(K.cluster_temporal(keyed, "conv"))
    groups = K.cluster_rollup(clusters, raw, "conv").withColumn("id", F.concat(F.lit("epi_"), F.sha2(F.concat_ws("\x1f", "conv", F.col("run").cast("string"), F.col("part").cast("string"), F.col("first_us").cast("string")), 256)))
    summary = F.concat(F.lit("Summary of "), F.col("n").cast("string"), F.lit(" episodes"))
    made = groups.select("id", F.lit(1).alias("level"), summary.alias("content"), summary.alias("summary"), "keywords", "tags", F.timestamp_micros("first_us").cast("timestamp_ntz").alias("occurred_at"), moment(now).alias("recorded_at"), "salience", F.lit(0).alias("access_count"), F.lit(10.0).alias("consolidation_strength"))
    parent = clusters.join(groups.select("conv", "run", "part", F.col("id").alias("new_parent")), ["conv", "run", "part"]).select("id", "new_parent")
    moved = raw.join(parent, "id").withColumn("parent_id", F.col("new_parent")).drop("new_parent")
    made, moved = materialise(made), materialise(moved)
    n_made, n_moved = made.count(), moved.count()
    store.append("episodes", made.unionByName(moved, allowMissingColumns=True))
    n_patterns = find_patterns(store, clusters.join(groups.select("conv", "run", "part"), ["conv", "run", "part"], "left_semi"), raw, now, pattern_judge, embedder)

    links = L.upserted(store.read("episode_links"))
    log = store.read("access_log").where("kind = 'episode'").select("id", "at")
    pairs = L.coaccessed_links(links, log, now, window_hours * 3_600_000_000)
    aged = materialise(L.decayed(L.strengthened(links, pairs), rate, floor))
    report = L.maintenance_report(aged, threshold).first()
    store.append("episode_links", aged.where(F.col("weight") >= threshold))
    store.delete("episode_links", aged.where(F.col("weight") < threshold))

    every = store.read("episodes")
    gone = materialise(K.stale(P.unique_episodes(every), now))
    n_gone = gone.count()
    _, kept = K.prune_cascade(every, store.read("episode_links"), gone)
    orphaned = every.join(gone.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").withColumn("parent_id", F.lit(None).cast("string"))
    lost_links = store.read("episode_links").join(kept.select("id"), "id", "left_anti")
    orphaned, lost_links = materialise(orphaned), materialise(lost_links)
    store.append("episodes", orphaned)
    store.delete("episode_links", lost_links)
    store.delete("episodes", gone)
    S.drop_vectors(store, gone)
    n_members = update_communities(store)
    row = (n_made, n_moved, n_patterns, report.strengthened, report.decayed, report.pruned, n_gone, n_members)
    return store.spark.createDataFrame([row], "summaries long, consolidated long, patterns long, strengthened long, decayed long, links_pruned long, episodes_pruned long, community_members long")


def find_patterns(store: Store, clusters: DataFrame, raw: DataFrame, now: str, judge: Judge | None, embedder: Embedder | None = None) -> int:
    """What a judge finds to recur in each cluster: known patterns grow, new ones are kept, unseen ones weaken; gives their number."""
    if judge is None:
        return 0
    text = raw.select("id", F.coalesce("summary", "content").alias("text"), "occurred_at")
    per = clusters.select("conv", "run", "part", "id").join(text, "id").groupBy("conv", "run", "part").agg(  # a cluster has five episodes at most
        F.sort_array(F.collect_list(F.struct("occurred_at", "id", "text"))).alias("own"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen")
    )
    asked = per.select(F.concat_ws("/", "conv", F.col("run").cast("string"), F.col("part").cast("string")).alias("candidate_id"), F.transform("own", lambda x: x["id"]).alias("occurrences"), F.array_join(F.transform("own", lambda x: x["text"]), "\n").alias("all"), "first_seen", "last_seen")
    answered = asked.withColumn("answer", judge_column(judge)(prompt("pattern", content=F.col("all"))))
    found = U.parse_pattern(answered, "answer").where("error is null")
    found = materialise(found.withColumn("embedding", embed_column(embedder or HashingEmbedder())(F.col("description"))).select("candidate_id", "description", "pattern_type", "confidence", "occurrences", "embedding", "first_seen", "last_seen"))
    known = store.read("patterns").withColumnRenamed("id", "pattern_id")
    grown, fresh = K.detect_patterns(found, known)
    new = fresh.withColumn("id", F.concat(F.lit("pat_"), F.sha2(F.concat_ws("\x1f", "pattern_type", "description"), 256)))
    lower = K.weaken(grown, raw.select("id")).select("pattern_id", F.col("confidence").alias("_weaker"))
    rows = grown.join(lower, "pattern_id").withColumn("confidence", F.when(F.col("n_new") > 0, F.col("confidence")).otherwise(F.col("_weaker"))).drop("_weaker", "n_new").withColumnRenamed("pattern_id", "id")
    store.append("patterns", materialise(rows.unionByName(new.dropDuplicates(["id"]), allowMissingColumns=True)))
    return found.count()


def update_communities(store: Store) -> int:
    """Entities tied by facts, directly or not, are one community, named after its smallest id; gives the number of members.

    One row per member, so a community may be of any size.
    """
    facts = T.facts_current(T.latest_facts(store.read("facts"))).where("object_id is not null and object_id <> ''")
    members = materialise(L.components(facts.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"))))
    rows = members.select(F.col("id"), F.concat(F.lit("com_"), F.col("component")).alias("community_id"))
    store.reset("community_members")
    store.append("community_members", rows)
    return members.count()


def offload(store: Store, candidates: DataFrame, at: str, least: float = 0.5) -> int:
    """Keeps what is evicted from working memory: candidates (``conv_id``, ``seq``, ``content``, ``relevance``) of enough relevance become episodes."""
    key = F.sha2(F.concat_ws("\x1f", F.col("conv_id").cast("string"), F.col("seq").cast("string"), F.col("content")), 256)
    rows = candidates.where(F.col("relevance") >= least).select(F.concat(F.lit("epi_"), key).alias("id"), "content", "relevance").dropDuplicates(["id"])
    fresh = rows.join(store.read("episodes").select("id"), "id", "left_anti")
    return store.append("episodes", fresh.select("id", F.lit(0).alias("level"), "content", moment(at).alias("occurred_at"), moment(at).alias("recorded_at"), F.col("relevance").alias("salience"), F.lit(0).alias("access_count"), F.lit(5.0).alias("consolidation_strength")))
