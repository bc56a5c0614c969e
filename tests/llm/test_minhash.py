import random

import numpy as np

from tidemark.llm import bbit_minhash as B

SCHEMA = "id string, content string, summary string, text string, words int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "k") for r in rows], SCHEMA)


def brute(rows, threshold=0.7, least=12):
    sets = {}
    for i, c, s in rows:
        for f, t in ((0, c), (1, s)):
            if i is not None and t and len(B.words_of(t)) >= least:
                sets.setdefault(f, []).append((i, B.words_of(t)))
    return {tuple(sorted((a, b))) for own in sets.values() for a, x in own for b, y in own if a < b and len(x & y) >= threshold * len(x | y) - 1e-9}


def corpus(rng, n=150):
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.5:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 9)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rng.shuffle(base)
            text = " ".join(base)
        else:
            text = " ".join(rng.sample(vocabulary, rng.randrange(14, 40)))
        rows.append((f"e{i:03}", text, None))
    return rows


def test_equals_brute_force(spark):
    rows = corpus(random.Random(11))
    rows += [("dup1", rows[0][1].upper(), rows[3][1]), ("dup1", rows[0][1].upper(), rows[3][1]), ("dup2", rows[5][1] + "!", rows[3][1]), ("short", "a b c", "a b c"), ("short2", "a b c", ""), ("none", None, None), (None, rows[0][1], None)]
    got = [tuple(r) for r in B.near_duplicates(frame(spark, rows)).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and not set(got) - want
    assert len(set(got)) >= 0.99 * len(want)


def test_crowded_keys_are_compared_block_by_block(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = [(f"e{i:03}", " ".join([*rng.sample(base, 58), f"x{i}"]), None) for i in range(70)]
    sketch = B.sketches(frame(spark, rows), "id", ["content", "summary"], 12)
    few = B.candidates(sketch, 8, 2, 1.0, 0.4, block=8)
    one = B.candidates(sketch, 8, 2, 1.0, 0.4, block=4096)
    a, b = ({tuple(r) for r in x.collect()} for x in (few, one))
    assert a == b and len(a) == 70 * 69 // 2


def test_classes(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [("a", text, None), ("b", text.upper(), None), ("c", text + " more", None), ("d", "x", text)]
    got = {(r.id, r.field): (r.copies, r.links) for r in B.text_classes(frame(spark, rows)).collect()}
    assert got == {("a", "content"): (2, 1), ("b", "content"): (2, 1), ("c", "content"): (1, 1), ("d", "summary"): (1, 0)}


def test_empty_and_very_long(spark):
    assert B.near_duplicates(frame(spark, [])).count() == 0
    long = " ".join(f"w{k}" for k in range(30000))
    got = B.near_duplicates(frame(spark, [("a", long, None), ("b", long + " end", None)])).collect()
    assert [tuple(r) for r in got] == [("a", "b")]


def test_estimate_corrects_chance_agreement():
    rng = np.random.default_rng(0)
    maker = B.Bands(32, 4)
    for share in (0.3, 0.7, 0.9):
        found = []
        for _ in range(60):
            both = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
            k = round(200 * share)
            rest = (200 - k) // 2
            sets = [both[: k + rest], np.concatenate([both[:k], both[k + rest :]])]
            flat = np.concatenate(sets)
            sig = maker.signature(maker.minima(flat, np.array([0, len(sets[0])])))
            found.append(B.estimated_similarity(sig[:1], sig[1:])[0])
        assert abs(np.mean(found) - share) < 0.08


def test_many_copies_go_through_the_first(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(f"c{k}", text, None) for k in range(6)] + [("d", text + " more", None)]
    got = {tuple(r) for r in B.near_duplicates(frame(spark, rows), expand=3).collect()}
    assert got == {("c0", f"c{k}") for k in range(1, 6)} | {("c0", "d")}
    assert B.near_duplicates(frame(spark, rows)).count() == 21


def test_keys_told_crowded_from_a_sample_are_dealt_into_groups(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = [(f"e{i:03}", " ".join([*rng.sample(base, 58), f"x{i}"]), None) for i in range(90)]
    sketch = B.sketches(frame(spark, rows), "id", ["content", "summary"], 12)
    assert B.crowded_keys(sketch, [], 8, 2, 90, 16, sample=90, seen=4)  # there are some
    assert not B.crowded_keys(sketch, [], 8, 2, 90, 4096)
    dealt = B.candidates(sketch, 8, 2, 1.0, 0.4, block=16, sample=90, seen=4)
    whole = B.candidates(sketch, 8, 2, 1.0, 0.4)
    a, b = ({tuple(r) for r in x.collect()} for x in (dealt, whole))
    assert a == b and len(a) == 90 * 89 // 2


def test_differently_written_copies_are_all_paired(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(f"c{k}", text + " " * k, None) for k in range(5)] + [(f"x{k}", text + "!", None) for k in range(4)]
    got = {tuple(r) for r in B.near_duplicates(frame(spark, rows), expand=3).collect()}
    apart = [f"c{k}" for k in range(5)] + ["x0"]  # the four x are one text, x0 stands for them
    assert got == {(a, b) for a in apart for b in apart if a < b} | {("x0", f"x{k}") for k in range(1, 4)}
