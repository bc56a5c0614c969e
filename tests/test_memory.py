import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import consolidation as K
from tidemark.operators import curation as U
from tidemark.operators import entities as E
from tidemark.operators import folds as FD
from tidemark.operators import links as L
from tidemark.operators import retrieval as R
from tidemark.operators import temporal as T
from tidemark.operators import vectors as V
from tidemark.operators import working as W
from tidemark.sources.schemas import SCHEMAS

FACTS = SCHEMAS["facts"]


def facts(spark, rows):
    """rows: dicts of the columns that matter."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in FACTS.fields) for r in rows], FACTS)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_facts_known_and_valid(spark, at):
    df = facts(spark, [
        {"id": "A", "subject_id": "s", "predicate": "works_at", "object_value": "A", "recorded_at": at(0), "invalidated_at": at(100)},
        {"id": "B", "subject_id": "s", "predicate": "works_at", "object_value": "B", "recorded_at": at(100)},
        {"id": "L", "subject_id": "s", "predicate": "lives_in", "object_value": "NY", "valid_from": at(10), "valid_to": at(20), "recorded_at": at(50)},
    ])
    assert ids(T.facts_current(df)) == ["B", "L"]
    assert ids(T.facts_current(df, "works_at")) == ["B"]
    assert ids(T.facts_as_of(df, str(at(60)))) == ["A", "L"]
    assert ids(T.facts_as_of(df, str(at(100)))) == ["B", "L"]  # half-open
    assert ids(T.facts_valid_at(df, str(at(15)))) == ["A", "B", "L"]  # invalidated ones stay
    assert "L" not in ids(T.facts_valid_at(df, str(at(20))))
    assert ids(T.facts_bitemporal(df)) == ["A", "B", "L"]
    assert [r.changed for r in T.fact_history(df).where("predicate = 'works_at'").orderBy("step").collect()] == [True, True]
    marked = T.invalidate(df, df.where("id = 'A'"), str(at(7)))
    assert marked.where("id = 'A'").first().invalidated_at == at(7)


def test_conflicts(spark, at):
    base = {"subject_id": "s", "recorded_at": at(0)}
    df = facts(spark, [
        base | {"id": "1", "predicate": "p", "object_value": "Boston"}, base | {"id": "2", "predicate": "p", "object_value": "New York"}, base | {"id": "3", "predicate": "q", "object_value": "x"},
        base | {"id": "4", "predicate": "q", "object_value": "x"}, base | {"id": "5", "predicate": "r", "object_id": "e"}, base | {"id": "6", "predicate": "r", "object_value": "v"},
        base | {"id": "7", "predicate": "r", "object_id": "", "object_value": ""}, base | {"id": "8", "predicate": "t", "object_value": "a"}, base | {"id": "9", "predicate": "t", "object_value": "b", "invalidated_at": at(1)},
    ])
    assert {(r.predicate, r.n_pairs) for r in T.fact_conflicts(df).collect()} == {("p", 1), ("r", 1)}


def test_links(spark, at):
    schema = SCHEMAS["episode_links"]
    df = spark.createDataFrame([("l1", "a", "b", "semantic", 0.5, at(0)), ("l2", "a", "b", "semantic", 0.3, at(1)), ("l3", "b", "c", "causal", 0.05, at(0)), ("l4", "c", "c", "causal", 1.0, at(0)), ("l5", "c", "d", "temporal", 1.0, at(0))], schema)
    one = L.upserted(df)
    assert ids(one) == ["l2", "l3", "l4", "l5"]
    delta = spark.createDataFrame([("b", "a", 0.2), ("c", "b", -0.5)], "a string, b string, delta double")
    got = {r.id: r.weight for r in L.weight_delta(one, delta).collect()}
    assert got["l2"] == pytest.approx(0.5) and got["l3"] == 0.0 and got["l5"] == 1.0
    assert {(r.episode_id, r.other_id) for r in L.linked_episodes(one).collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c")}
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.episode_id, r.distance) for r in L.neighbourhood(one, start, 2).collect()} == {("b", 1), ("c", 2)}
    aged = {r.id: (r.weight, r.changed) for r in L.decayed(one).collect()}
    assert aged["l5"] == (0.9, True) and aged["l3"] == (0.1, True)
    assert ids(L.pruned(one, 0.1)) == ["l2", "l4", "l5"]
    for bad in ({"rate": 1.5}, {"rate": -0.1}, {"floor": -0.1}):
        with pytest.raises(ValueError):
            L.decayed(one, **bad)
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert {r.id: r.weight for r in L.strengthened(one, pairs).collect()}["l2"] == pytest.approx(0.3 + 0.1 * math.log(2.3))


def test_coaccess_finds_every_close_pair_once(spark, at):
    rows = [(f"e{i:02}", at(0, 0, i * i * 7 % 5000)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, at timestamp_ntz")
    got = [tuple(r) for r in L.coaccess_pairs(df, str(at(0)), 300_000_000).collect()]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and abs((x - y).total_seconds()) <= 300}
    assert set(got) == want and len(got) == len(want)


def test_similarity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0], [0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(C.unit_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5, 0.0, 0.0]


def test_topk_batch_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.integers(-2, 3, (120, 4)).astype(float)  # many ties
    rows = [(i, m[i].tolist()) for i in range(120)] + [(500, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in V.topk_batch(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    size = np.linalg.norm(m, axis=1)
    for q in (0, 50, 100):
        if not size[q]:
            assert q not in got
            continue
        order = sorted((round(1 - float(m[q] @ m[i] / size[q] / size[i]), 9), i) for i in range(120) if i != q and size[i])
        assert [v for _, v in sorted(got[q])] == [i for _, i in order[:5]]


def test_coherence(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [1.0, 0.0]), (2, 2, [0.0, 1.0]), (3, 2, [1.0, 1.0])], "vec_id long, label int, embedding array<float>")
    got = {r.label: r.coherence for r in V.coherence(df, "label").collect()}
    half = (1 + 1 / math.sqrt(2)) / 2
    assert got[1] == 1.0 and got[2] == pytest.approx((0.5 + half + half) / 3)


def test_clusters_equal_a_plain_loop(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3), rng.normal(size=6).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: (r.label, r.cluster) for r in FD.cluster_semantic(df, threshold=0.5).collect()}
    for label in range(3):
        cluster, held = -1, []
        for i, own, v in rows:
            if own != label:
                continue
            u = np.array(v) / np.linalg.norm(v)
            if not held or len(held) >= 5 or np.mean([(1 + u @ h) / 2 for h in held]) < 0.5:
                cluster, held = cluster + 1, []
            held.append(u)
            assert got[i] == (label, cluster)


def test_trim_replay_equals_a_plain_loop(spark):
    rows = [(c, i, (i * 37 + len(c)) % 60 + 1) for c in ("a", "bb") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id string, seq long, tokens long")
    got = {(r.conv_id, r.seq): (r.held, r.tokens) for r in FD.trim_replay(df, 200).collect()}
    for c in ("a", "bb"):
        q = []
        for _, i, n in (r for r in rows if r[0] == c):
            q.append(n)
            if sum(q) / 200 >= 0.8:
                while len(q) > 1 and sum(q) > 144:
                    q.pop(0)
            assert got[c, i] == (len(q), sum(q))


def test_parsers(spark):
    def run(f, text, *more):
        return f(spark.createDataFrame([("x", text)], "id string, answer string"), *more)

    r = run(U.parse_link, '```json\n{"should_link": true, "link_type": "odd", "weight": 1.5, "reasoning": "r"}\n```', "answer").first()
    assert (r.should_link, r.link_type, r.weight, r.error) == (True, "semantic", 1.0, None)
    assert run(U.parse_link, '{"should_link": true}', "answer").first().error and run(U.parse_link, "not json", "answer").first().error
    r = run(lambda d, a: U.parse_salience(d.withColumn("cut", F.lit(True)), a, "cut"), 'x {"score": 0.9, "reasoning": "r", "memory_type": "episodic"} y', "answer").first()
    assert r.score == pytest.approx(0.8)
    got = run(U.parse_entities, 'see [{"name": "A", "type": "t"}, {"name": "B"}, {"name": "C", "type": "t", "confidence": 2}]', "id", "answer").collect()
    assert [(r.name, r.confidence) for r in got] == [("A", 1.0)]
    assert run(U.parse_entities, '{"entities": [{"name": "A", "type": "t"}]}', "id", "answer").count() == 1
    assert run(U.parse_entities, None, "id", "answer").count() == run(U.parse_entities, "", "id", "answer").count() == 0
    assert run(U.parse_resolution, '{"strategy": "nonsense", "invalidations": []}', "answer").first().error


def test_patterns(spark):
    df = spark.createDataFrame([(2.0, 0.5), (20.0, 0.9)], "n double, c double")
    low, high = (r[0] for r in df.select(K.pattern_strength(F.col("n"), F.col("c"))).collect())
    assert low == pytest.approx(3.914, abs=1e-3) and 10 < high <= 20
    pairs = [("a b c d", "a b c x", True), ("Same", "same", True), ("abc", "xx abc", True), ("one two", "three four", False), ("", "x", True)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string, w boolean").select(K.description_similar(F.col("a"), F.col("b"))).collect()]
    assert got[1:4] == [True, True, False] and got[0] is True


def test_entities(spark, at):
    schema = SCHEMAS["entities"]
    df = spark.createDataFrame([("ent_1", "50% Off_x", "Person ", at(0), None, 1, None), ("ent_1", "50% Off_x", "Person ", at(0), None, 1, None), ("ent_2", "José", "place", at(1), None, None, None), ("bad", None, None, None, None, None, None)], schema)
    assert ids(E.find(df, "% off_")) == ["ent_1"] and ids(E.find(df, "JOSÉ")) == ["ent_2"] and ids(E.find(df, "50", "person")) == ["ent_1"]
    assert [r.id for r in E.invalid_ids(df, "id", E.ENTITY_ID).collect()] == ["bad"]
    assert E.find(df.limit(0), "x").count() == 0


def test_messages_of_empty_and_odd_texts(spark, at):
    schema = SCHEMAS["episodes"]
    row = lambda i, text, t: (i, 0, None, text, None, None, None, None, t, t, 0.5, 0, None, 5.0, None, None)
    df = spark.createDataFrame([row("a", "user: hi\nassistant: yes", at(0)), row("b", "", at(0)), row("c", None, at(0)), row("d", "x", None)], schema)
    got = [(r.role, r.text) for r in W.messages(df).orderBy("seq").collect()]
    assert got == [("user", "hi"), ("assistant", "yes"), ("system", "")]
    assert W.interaction_pairs(W.messages(df)).first().answer == "yes"


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(80):02}", f"n{rng.randrange(80):02}") for _ in range(60)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("s", "s"), (None, "x")]
    got = {r.id: r.component for r in L.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs[:-1]:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert got == {x: find(x) for x in up}


def test_resolve_equals_brute_force(spark, at):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    rng = random.Random(4)
    names = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    rows = [(f"e{i:02}", n, rng.choice(["t", "T "]), None) for i, n in enumerate(names)] + [("x", None, "t", None)]
    df = spark.createDataFrame(rows, "id string, name string, entity_type string, n string")
    got = {r.new_id: (r.edits, r.id) for r in E.resolve(df, df, 2, others_only=True).collect()}
    for i, n, _, _ in rows[:-1]:
        near = min(((distance(n, m), j) for j, m, _, _ in rows[:-1] if j != i and distance(n, m) <= 2), default=None)
        assert got.get(i) == near


def test_prompts(spark):
    from tidemark.functions.prompts import prompt

    row = spark.createDataFrame([("a" * 600, None)], "l string, r string").select(prompt("link", left=F.col("l"), right=F.col("r")).alias("p")).first()
    assert "a" * 500 in row.p and "a" * 501 not in row.p and row.p.endswith("B: ")
    with pytest.raises(ValueError):
        prompt("link", left=F.lit("x"))


def test_overlapping_conflicts_see_every_other_object(spark, at):
    def brute(rows):
        order = sorted(rows, key=lambda r: (r["valid_from"] or at(-9999), r["valid_to"] or at(9999), r["id"]))
        return sum(any(e["object_value"] != f["object_value"] and (e["valid_to"] or at(9999)) > (f["valid_from"] or at(-9999)) for e in order[:k]) for k, f in enumerate(order))

    one = [("A", at(0), at(100)), ("B", at(10), at(50)), ("A", at(20), at(30))]
    rng = random.Random(4)
    many = [(rng.choice("ABC"), rng.choice([None, *map(at, range(0, 60, 3))]), rng.choice([None, *map(at, range(60, 90, 3))]) if rng.random() < 0.3 else at(60 + rng.randrange(40))) for _ in range(30)]
    short = [(rng.choice("ABC"), at(a := rng.randrange(40)), at(a + 1 + rng.randrange(9))) for _ in range(40)]
    for n, case in enumerate((one, many, short)):
        rows = [{"id": f"f{n}-{k}", "subject_id": "s", "predicate": "p", "object_value": o, "valid_from": lo, "valid_to": hi, "recorded_at": at(0)} for k, (o, lo, hi) in enumerate(case)]
        assert [r.n_facts for r in T.fact_conflicts(facts(spark, rows), require_overlap=True).collect()] == [brute(rows)]
    assert brute([dict(zip(("object_value", "valid_from", "valid_to"), r), id=str(k)) for k, r in enumerate(one)]) == 2


def test_sequential_clusters_equal_a_plain_loop(spark):
    rng = random.Random(9)
    hour = 3_600_000_000
    rows, us = [], 0
    for k in range(60):
        us += rng.choice([1, 24, 167, 168, 169, 400]) * hour
        v = rng.choice([None, [0.0, 0.0], [1.0, 0.1], [-1.0, 0.2], [0.0, 1.0], [1.0]])
        rows.append((rng.choice("ab"), f"e{k:02}", us, v))
    rows += [(None, "x", 5, [1.0, 0.0]), ("a", "y", None, [1.0, 0.0])]

    def alike(a, b):
        if not a or not b or len(a) != len(b) or not math.hypot(*a) or not math.hypot(*b):
            return 0.0
        return (1 + sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)) / 2

    want = {}
    for key in "ab":
        held, last, n = [], None, -1
        for _, i, t, v in sorted((r for r in rows if r[0] == key and r[2] is not None), key=lambda r: (r[2], r[1])):
            if not held or t - last > 168 * hour or len(held) >= 5 or round(sum(alike(v, h) for h in held) / len(held), 12) < 0.4:
                held, n = [], n + 1
            held.append(v)
            last, want[i] = t, n
    df = spark.createDataFrame(rows, "parent_id string, id string, us long, embedding array<double>")
    assert {r.id: r.cluster for r in FD.cluster_sequential(df, "parent_id", "id", "us", "embedding", threshold=0.4).collect()} == want


def test_mean_similarity_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 2.0]), (3, 0, [0.0, 0.0]), (4, 1, None)], "vec_id int, label int, embedding array<double>")
    got = {r.vec_id: round(r.similarity, 6) for r in V.mean_similarity(df, "label").collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.0, 4: 0.0}


def test_places_spread_a_crowded_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, 0, 1, None]), rng.randrange(50), k) for k in range(300)]
    df = spark.createDataFrame(rows, "level int, x int, id int")
    got = {r.id: (r.place, r.length) for r in R.places(df, ["level"], [F.desc("x"), F.asc("id")]).collect()}
    for level in (0, 1, None):
        own = sorted((r for r in rows if r[0] == level), key=lambda r: (-r[1], r[2]))
        assert all(got[r[2]] == (k, len(own)) for k, r in enumerate(own))
    assert R.places(df.limit(0), ["level"], [F.asc("x")]).count() == 0


def test_patterns_found_grow_or_are_new(spark, at):
    schema = "candidate_id string, description string, pattern_type string, confidence double, occurrences array<string>, embedding array<double>, first_seen timestamp_ntz, last_seen timestamp_ntz"
    found = spark.createDataFrame([
        ("c1", "same", "behavioral", 0.5, ["e1", "e9"], [1.0, 0.1], at(0), at(5)), ("c2", "new", "behavioral", 0.5, ["e1", "e2", "e3"], [-1.0, 0.0], at(0), at(5)), ("c3", "few", "preference", 0.5, ["e1"], [1.0, 0.0], at(0), at(5)),
    ], schema)
    known = spark.createDataFrame([("p1", "same", "behavioral", 0.4, ["e1"], [1.0, 0.0], at(0), at(1)), ("p2", "other", "error", 0.4, ["e5"], [1.0, 0.0], at(0), at(1))], schema.replace("candidate_id", "pattern_id"))
    grown, fresh = K.detect_patterns(found, known)
    got = {r.pattern_id: (r.n_new, round(r.confidence, 6), sorted(r.occurrences), r.last_seen) for r in grown.collect()}
    assert got == {"p1": (1, 0.5, ["e1", "e9"], at(5)), "p2": (0, 0.4, ["e5"], at(1))} and [r.description for r in fresh.collect()] == ["new"]


def test_superseded_equals_the_pairs(spark, at):
    rng = random.Random(3)
    rows = [{"id": f"f{k:02}", "subject_id": rng.choice("ab"), "predicate": "p", "object_value": rng.choice(["x", "y", "z", "", None]), "recorded_at": at(rng.randrange(9))} for k in range(60)]
    live = facts(spark, rows)
    new = live.where("id >= 'f30'").select("id")
    pairs = T.conflicting_pairs(live, new).groupBy("old_id").agg(F.max("new_at").alias("at"))
    assert {(r.id, r.at) for r in T.superseded(live, new).collect()} == {(r.old_id, r.at) for r in pairs.collect()}


def test_sections_leave_out_what_is_empty(spark):
    context = spark.createDataFrame([("a", "S", ""), ("b", None, "T")], "conv_id string, system string, task string")
    memories = spark.createDataFrame([("a", k, f"m{k}", "episodic_L0", float(k)) for k in range(7)], "conv_id string, id int, text string, source string, relevance double")
    msgs = spark.createDataFrame([("b", 1, "user", "hi"), ("b", 2, "assistant", "yo"), ("b", 3, "user", "so")], "conv_id string, seq long, role string, text string")
    got = {r.conv_id: r.rendered for r in W.render_sections(context, memories, msgs).collect()}
    assert got["a"] == "# System Context\nS\n\n# Relevant Memories\n" + "\n".join(f"- m{k} (from episodic_L0)" for k in range(6, -1, -1))
    assert got["b"] == "# Current Task\nT\n\n# Conversation History\nUser: hi\nAssistant: yo\nUser: so"
    left = sorted((r.conv_id, r.priority, r.content) for r in W.offload_items(context, memories, msgs).collect())
    assert left == [("a", 0, f"m{k}") for k in range(7)] + [("b", 1, "hi"), ("b", 2, "T")]
    assert {r.conv_id: r.task for r in W.set_context(context, spark.createDataFrame([("b", None), ("c", "new")], "conv_id string, value string"), "task").collect()} == {"a": "", "b": None, "c": "new"}
    assert W.cleared(msgs, context.where("conv_id = 'b'")).count() == 0


def _times(at):
    """Accesses of 40 ids, some once, some many times, with equal and far times among them."""
    import random

    rng = random.Random(3)
    rows = [(f"e{i:02}", at(0, 0, rng.choice([0, 0, 300, rng.randrange(-700, 2500)]))) for i in range(40) for _ in range(1 if i % 3 else 5)] + [(None, at(0))]
    start = at(0, 0, -600)
    want = {(a, b) for a, x in rows for b, y in rows if a and b and a < b and x >= start and y >= start and abs((x - y).total_seconds()) <= 300}
    return rows, want


@pytest.mark.parametrize("crowd", [1024, 3])
def test_coaccess_of_repeated_accesses_and_crowded_moments(spark, at, monkeypatch, crowd):
    monkeypatch.setattr(L, "_ROWS", crowd)
    rows, want = _times(at)
    got = [tuple(r) for r in L.coaccess_pairs(spark.createDataFrame(rows, "id string, at timestamp_ntz"), str(at(0)), 300_000_000).collect()]
    assert set(got) == want and len(got) == len(want)
    instant = {(a, b) for a, x in rows for b, y in rows if a and b and a < b and x == y and x >= at(0)}
    assert {tuple(r) for r in L.coaccess_pairs(spark.createDataFrame(rows, "id string, at timestamp_ntz"), str(at(0)), 0).collect()} == instant


def test_pairs_of_single_accesses_are_not_gathered(spark, at):
    df = spark.createDataFrame([(f"e{i}", at(0, 0, i)) for i in range(9)], "id string, at timestamp_ntz")
    plan = L.coaccess_pairs(df, str(at(0)), 300_000_000)._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith("Aggregate") and "Union" not in plan


def test_linked_pairs_are_found_without_the_others(spark, at):
    rows, want = _times(at)
    ends = [(a, b) for i, (a, b) in enumerate((f"e{i:02}", f"e{j:02}") for i in range(40) for j in range(40)) if i % 7 == 0]
    links = spark.createDataFrame(ends, "source_id string, target_id string")
    df = spark.createDataFrame(rows, "id string, at timestamp_ntz")
    got = L.coaccessed_links(links, df, str(at(0)), 300_000_000)
    assert sorted(map(tuple, got.collect())) == sorted({(min(e), max(e)) for e in ends} & want)
    assert {tuple(r) for r in L.coaccessed_links(links, df, str(at(0)), 0).collect()} == {(min(e), max(e)) for e in ends} & {(a, b) for a, x in rows for b, y in rows if a and b and a < b and x == y and x >= at(0)}
