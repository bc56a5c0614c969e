import random

from tidemark.operators.hierarchy import descendants, hierarchy


def frame(spark, rows):
    return spark.createDataFrame([(i, p, 7, "root", "s") for i, p in rows], "id string, parent_id string, depth int, root_id string, state string")


def brute(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            old = parent.get(i)
            parent[i] = min([x for x in (old, p or None) if x], default=None)
    out = {}
    for i in parent:
        seen, at = [], i
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            out[i] = ("", -1, "cycle" if at == i else "below")
        else:
            top = seen[-1]
            state = "tree" if len(seen) > 1 else "root" if parent[i] is None else "orphan"
            out[i] = (top, len(seen) - 1, state)
    return out


def check(spark, rows, **options):
    got = hierarchy(frame(spark, rows), **options).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: (r.root_id, r.depth, r.state) for r in got} == brute(rows)


def test_kinds_of_nodes(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", ""), ("o", "missing"), ("p", "o"), ("x", "y"), ("y", "x"), ("z", "x"), ("w", "z"), ("self", "self"), (None, "a"), ("b", "a"), ("b", None)]
    check(spark, rows)


def test_deep_chains_and_long_loops_finish_by_jumps(spark):
    rows = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 90)]
    rows += [(f"l{i}", f"l{(i + 1) % 37}") for i in range(37)] + [("t0", "l5"), ("t1", "t0")]
    check(spark, rows, frontier_levels=3)


def test_random_forests(spark):
    rng = random.Random(3)
    ids = [f"k{i:02}" for i in range(60)]
    rows = [(i, rng.choice([*ids, None, "", "gone"])) for i in ids]
    check(spark, rows, frontier_levels=2)


def test_paths_and_descendants(spark):
    rows = [("a", None)] + [(c, p) for c, p in zip("bcdefg", "abcdef")] + [("h", "b"), ("x", "x")]
    tree = hierarchy(frame(spark, rows), with_paths=True, frontier_levels=2)
    paths = {r.id: "".join(r.path) for r in tree.collect()}
    assert paths == {"a": "a", "b": "ab", "c": "abc", "d": "abcd", "e": "abcde", "f": "abcdef", "g": "abcdefg", "h": "abh", "x": ""}
    got = {tuple(r) for r in descendants(tree).collect()}
    assert got == {(p[i], p[-1], len(p) - 1 - i) for p in paths.values() for i in range(len(p) - 1)}


def test_empty(spark):
    assert hierarchy(frame(spark, [])).count() == 0


def test_the_walk_goes_on_while_it_pays(spark):
    rows = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 20)]
    check(spark, rows)
    check(spark, rows, least_gain=2.0)
    check(spark, rows + [("l0", "l1"), ("l1", "l0")], least_gain=0.0, frontier_levels=50)
