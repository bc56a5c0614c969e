import pytest

from tidemark.functions.models import HashingEmbedder, with_retries
from tidemark import cli
from tidemark.operators import records as S
from tidemark.operators.ingest import Curator, ingest, offload, open_store, record_access, run_cycle
from tidemark.operators.search import hybrid_query, search_entities, search_episodes, semantic_query
from tidemark.sources import store as store_module
from tidemark.sources.errors import ConcurrentWriteError, DuplicateKeyError, MissingReferenceError, UnknownTableError
from tidemark.sources.tables import shared_dir
from tidemark.streaming.events import daily_counts, ingest_stream, sessions
from tidemark.streaming.intervals import merged_periods


def test_versions_deletes_compaction(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    assert store.exists("entities") and store.read("entities").count() == 0
    one = spark.createDataFrame([("e1", "A"), ("e2", "B")], "id string, name string")
    store.insert("entities", one)
    with pytest.raises(DuplicateKeyError):
        store.insert("entities", one)
    store.append("entities", spark.createDataFrame([("e1", "A2")], "id string, name string"))
    store.delete("entities", one.where("id = 'e2'"))
    assert [tuple(r) for r in store.read("entities").select("id", "name").collect()] == [("e1", "A2")]
    assert store.read("entities", at_version=1).count() == 2
    store.compact("entities")
    assert [r.name for r in store.read("entities").collect()] == ["A2"]
    open_store(spark, str(tmp_path))  # idempotent
    assert store.read("entities").count() == 1
    store.export_json("entities", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().name == "A2"
    store.reset("entities")
    assert store.read("entities").count() == 0


def talks(spark, at, n=12):
    rows = [("c", i, "question " * (40 if i % 4 else 1), "answer " * 30 if i % 4 else None, at(i)) for i in range(n)]
    return spark.createDataFrame(rows, "conv_id string, seq long, question string, answer string, at timestamp_ntz")


def test_ingest_and_cycle(spark, at, tmp_path):
    store = open_store(spark, str(tmp_path))
    got = ingest(store, talks(spark, at)).collect()
    assert len(got) == 12 and sum(r.stored for r in got) == 9 == store.read("episodes").count()
    ingest(store, talks(spark, at))
    assert store.read("episodes").count() == 9  # the same again adds nothing
    some = [r.id for r in got if r.stored][:2]
    store.append("episode_links", spark.createDataFrame([("l1", *sorted(some), "semantic", 0.5, at(0)), ("l2", some[0], "epi_x", "semantic", 0.05, at(0))], "id string, source_id string, target_id string, link_type string, weight double, created_at timestamp_ntz"))
    record_access(store, spark.createDataFrame([(i,) for i in some], "id string"), str(at(400)), "episode")
    report = run_cycle(store, str(at(400))).first()
    assert report.summaries == 2 and report.consolidated == 9 and report.strengthened == 1 and report.links_pruned == 1
    assert report.episodes_pruned == 9 and store.read("episodes").count() == 2


def test_streams(spark, at, tmp_path):
    talks(spark, at).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = open_store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema("conv_id string, seq long, question string, answer string, at timestamp_ntz").parquet(str(tmp_path / "in"))
    ingest_stream(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.read("episodes").count() == 9

    spark.createDataFrame([("a", at(0), at(1)), ("a", at(3), at(4)), ("a", at(1), at(2)), ("b", None, at(1)), ("b", at(5), at(5))], "k string, f timestamp_ntz, t timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "iv"))
    src = spark.readStream.schema("k string, f timestamp_ntz, t timestamp_ntz").parquet(str(tmp_path / "iv"))
    merged_periods(src, ["k"], "f", "t").writeStream.outputMode("update").format("memory").queryName("periods").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.k, r.place, r.n) for r in spark.table("periods").collect()) == [("a", 0, 2), ("a", 1, 2), ("b", 0, 1)]

    spark.createDataFrame([("a", at(0), 0.5), ("a", at(0), 0.5), ("b", at(0, 3), 0.25), ("c", at(1), 1.0)], "id string, occurred_at timestamp, salience double").coalesce(1).write.parquet(str(tmp_path / "ev"))
    src = spark.readStream.schema("id string, occurred_at timestamp, salience double").parquet(str(tmp_path / "ev"))
    daily_counts(src).writeStream.outputMode("update").format("memory").queryName("days").trigger(availableNow=True).start().awaitTermination()
    assert {(r.period_day, r.n_events, r.value) for r in spark.table("days").collect()} == {("2025-01-01", 2, 0.75), ("2025-01-02", 1, 1.0)}
    events = spark.createDataFrame([(1, at(0)), (1, at(0, 0, 60)), (1, at(0, 2)), (2, at(0))], "user_id long, ts timestamp")
    assert sessions(events).count() == 3


def test_hooks():
    a, b, c = HashingEmbedder(16).embed(["the cat", "the cat", ""])
    assert a == b and sum(x * x for x in a) == pytest.approx(1) and not any(c)
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert with_retries(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(TimeoutError):
        with_retries(lambda: (_ for _ in ()).throw(TimeoutError()), sleep=waits.append)


def test_offload(spark, at, tmp_path):
    store = open_store(spark, str(tmp_path))
    rows = spark.createDataFrame([("c", 1, "user: hi", 0.5), ("c", 2, "user: no", 0.4), ("c", 1, "user: hi", 0.5)], "conv_id string, seq long, content string, relevance double")
    offload(store, rows, str(at(0)))
    offload(store, rows, str(at(1)))
    assert [r.content for r in store.read("episodes").collect()] == ["user: hi"]


def test_intermediate_tables_are_cleared(spark):
    from tidemark.sources.tables import clear, materialise, release

    one, two = materialise(spark.range(3).toDF("id")), materialise(spark.range(4).toDF("id"))
    assert one.count() == 3 and two.count() == 4
    release(one)
    clear(spark)
    path = two._tidemark_path.removeprefix("file://")
    import os

    assert not os.path.exists(path)


def test_of_two_writers_one_fails_and_nothing_is_lost(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    stale = store._manifest("entities")
    store.append("entities", spark.createDataFrame([("e1", "A")], "id string, name string"))
    with pytest.raises(ConcurrentWriteError):
        store._commit("entities", stale)
    assert [r.id for r in store.read("entities").collect()] == ["e1"]
    with pytest.raises(UnknownTableError):
        store.read("nothing")


def test_logs_keep_all_rows_and_many_versions_are_compacted(spark, at, tmp_path):
    store = open_store(spark, str(tmp_path))
    one = spark.createDataFrame([("e1",)], "id string")
    for day in range(3):
        record_access(store, one, str(at(day)), "entity")
    assert store.read("access_log").count() == 3
    store_module.COMPACT_AFTER, before = 4, store_module.COMPACT_AFTER
    try:
        for k in range(6):
            store.append("entities", spark.createDataFrame([("e1", f"A{k}")], "id string, name string"))
    finally:
        store_module.COMPACT_AFTER = before
    assert len(store._manifest("entities")["versions"]) < 4 and [r.name for r in store.read("entities").collect()] == ["A5"]


def test_inserts_check_what_they_refer_to(spark, at, tmp_path):
    store = open_store(spark, str(tmp_path))
    S.insert_entities(store, spark.createDataFrame([("ent_1", "Rosa", "person"), ("ent_2", "Omar", "person")], "id string, name string, entity_type string"))
    fact = "id string, subject_id string, predicate string, object_id string, object_value string"
    S.insert_facts(store, spark.createDataFrame([("fct_1", "ent_1", "knows", "ent_2", None)], fact), str(at(1)))
    assert store.read("facts").first().recorded_at == at(1)
    wrong = spark.createDataFrame([("fct_2", "ent_9", "knows", None, "x"), ("fct_3", "ent_1", "knows", None, "x")], fact)
    with pytest.raises(MissingReferenceError):
        S.insert_facts(store, wrong, str(at(1)))
    S.insert_facts(store, wrong, str(at(2)), strict=False)
    assert sorted(r.id for r in store.read("facts").collect()) == ["fct_1", "fct_3"]
    S.insert_episodes(store, spark.createDataFrame([("epi_1", 0, None, "masonry and vaults"), ("epi_2", 0, "", "juggling")], "id string, level int, parent_id string, content string"))
    with pytest.raises(MissingReferenceError):
        S.insert_episodes(store, spark.createDataFrame([("epi_3", 0, "epi_x", "y")], "id string, level int, parent_id string, content string"))
    link = "id string, source_id string, target_id string, link_type string, weight double"
    S.insert_links(store, spark.createDataFrame([("lnk_1", "epi_1", "epi_2", "semantic", 0.5)], link))
    S.insert_links(store, spark.createDataFrame([("lnk_2", "epi_1", "epi_2", "semantic", 0.9)], link))  # replaces it
    assert [(r.id, r.weight) for r in store.read("episode_links").collect()] == [("lnk_2", 0.9)]
    with pytest.raises(MissingReferenceError):
        S.insert_links(store, spark.createDataFrame([("lnk_3", "epi_1", "epi_9", "semantic", 0.5)], link))
    assert [r.id for r in S.nearest(store, "masonry and vaults", "episode", 1).collect()] == ["epi_1"]
    S.drop_vectors(store, spark.createDataFrame([("epi_1",)], "id string"))
    assert [r.id for r in S.nearest(store, "masonry and vaults", "episode", 1).collect()] == ["epi_2"]
    assert spark.range(1).select(S.fresh_id("link").alias("i")).first().i.startswith("lnk_")


class Rule:
    """Answers by a function and counts what it was asked."""

    def __init__(self, rule):
        self.rule = rule

    def answer(self, prompts):
        return [self.rule(p) for p in prompts]


@pytest.fixture
def one_partition(spark):
    """Many small jobs: one partition each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ingest_takes_every_step(spark, at, tmp_path, one_partition):
    store = open_store(spark, str(tmp_path))
    text = "filler words " * 12
    rows = [("c", 1, f"Rosa works at Acme {text}", "noted", at(1)), ("c", 2, f"Rosa works at Bolt {text}", "noted", at(2)), ("c", 3, "hi", "ho", at(3))]
    talk = spark.createDataFrame(rows, "conv_id string, seq long, question string, answer string, at timestamp_ntz")
    word = lambda p: p.partition("works at ")[2].split(" ")[0]
    curator = Curator(
        entities=Rule(lambda p: '{"entities": [{"name": "Rosa", "type": "person"}, {"name": "%s", "type": "firm"}]}' % word(p)),
        facts=Rule(lambda p: '{"facts": [{"subject": "rosa", "predicate": "works_at", "object": "%s"}, {"subject": "nobody", "predicate": "x", "object": "y"}]}' % word(p)),
        link=Rule(lambda p: '{"should_link": true, "link_type": "temporal", "weight": 0.4, "reasoning": "r"}'),
        evolution=Rule(lambda p: '{"should_update": true, "update_type": "context", "context": "seen again", "keywords": ["again"], "tags": [], "salience": 0.9}'),
    )
    for _ in range(2):  # the second time adds nothing
        assert sorted(r.stored for r in ingest(store, talk, curator=curator).collect()) == [False, True, True]
        assert store.read("episodes").count() == 2 and {r.name for r in store.read("entities").collect()} == {"Rosa", "Acme", "Bolt"}
        facts = {r.recorded_at: r for r in store.read("facts").collect()}
        assert len(facts) == 2 and facts[at(1)].invalidated_at == at(2) and facts[at(2)].invalidated_at is None and facts[at(1)].object_id.startswith("ent_")
        assert store.read("episode_links").count() == 2 and {r.context_description for r in store.read("episodes").collect()} == {"seen again"}
    other = Curator(facts=curator.facts, entities=curator.entities, resolution=Rule(lambda p: '{"strategy": "rejection", "invalidations": ["%s"]}' % p.rpartition("(")[2].split(")")[0]))
    ingest(store, spark.createDataFrame([("c", 9, f"Rosa works at Cask {text}", "noted", at(9))], talk.schema), curator=other)
    assert [r.invalidated_at is None for r in store.read("facts").orderBy("recorded_at").collect()] == [False, True, False]  # the judge rejects the new one

    facts = semantic_query(store, "Rosa person", str(at(20)), k=1).collect()
    assert {r.predicate for r in facts} <= {"works_at"} and store.read("access_log").count() >= 1
    found = hybrid_query(store, "Rosa works at Acme", str(at(20)), k=2)
    assert found["episodes"].count() == 2 and search_episodes(store, "Rosa", as_of=str(at(1))).count() == 1
    store.reset("vectors")
    assert [r.name for r in search_entities(store, "ros").collect()] == ["Rosa"]
    assert search_episodes(store, "anything", k=1).first().occurred_at == at(9)  # the most recent
    report = run_cycle(store, str(at(30)), pattern_judge=Rule(lambda p: '{"description": "works a lot", "pattern_type": "behavioral", "confidence": 0.5}')).first()
    assert report.patterns == 1 and report.summaries == 1 and store.read("patterns").first().occurrences is not None
    held = [r for r in store.read("facts").collect() if r.invalidated_at is None]  # Rosa and Bolt
    assert report.community_members == 2 and {(r.id, r.community_id) for r in store.read("community_members").collect()} == {(i, "com_" + min(held[0].subject_id, held[0].object_id)) for i in (held[0].subject_id, held[0].object_id)}


def test_commands(spark, at, tmp_path, one_partition):
    store = open_store(spark, str(tmp_path / "s"))
    said = cli.chat(store, "What of the masonry vault? " * 20, str(at(1)), [("user", "hello"), ("assistant", "yes")], system="Be kind.")
    assert said.startswith("system: # System Context\nBe kind.") and "User: hello" in said and store.read("episodes").count() == 1
    assert cli.retrieve(store, "masonry vault", str(at(2))).first().source == "episodic_L0"
    assert cli.consolidate(store, str(at(2))) is None and cli.consolidate(store, str(at(2)), force=True).count() == 1
    assert {r.what: r.n for r in cli.status(store).collect()}["episodes_L0"] == 1
    cli.main(["--store", str(tmp_path / "s"), "export", str(tmp_path / "out")])
    assert {r.tbl: r.n_rows for r in spark.read.json(str(tmp_path / "out" / "statistics")).collect()}["episodes"] == 1
    cli.main(["--store", str(tmp_path / "s"), "reset", "--force"])
    assert store.read("episodes").count() == 0 == store.read("vectors").count()


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://x:7077"}.get(name, default)

    with pytest.raises(ValueError):
        shared_dir(type("S", (), {"conf": Conf()})())


class _Changes:
    def answer(self, prompts):
        return ["{}" for _ in prompts]


@pytest.mark.parametrize(("curator", "searches"), [(Curator(least_likeness=2.0), False), (Curator(least_likeness=1.0), True), (Curator(least_likeness=2.0, evolution=_Changes()), True), (Curator(least_likeness=2.0, link=_Changes()), True)])
def test_neighbours_are_searched_only_for_those_who_ask(spark, at, tmp_path, monkeypatch, curator, searches):
    from tidemark.operators import ingest as module

    asked, topk_batch = [], module.V.topk_batch
    monkeypatch.setattr(module.V, "topk_batch", lambda *a, **k: asked.append(1) or topk_batch(*a, **k))
    store = open_store(spark, str(tmp_path))
    same = spark.createDataFrame([("c", i, "question " * 20, "answer " * 30, at(i)) for i in range(3)], "conv_id string, seq long, question string, answer string, at timestamp_ntz")
    ingest(store, same, curator=curator)
    assert bool(asked) == searches and store.read("episodes").count() == 3
    assert store.read("episode_links").count() == (6 if curator.least_likeness == 1.0 else 0)  # equal texts are links at likeness 1
