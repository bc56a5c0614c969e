import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import intervals as I

SCHEMA = "subject_id string, predicate string, valid_from timestamp_ntz, valid_to timestamp_ntz, lo int, chunk int"
KEYS = ["subject_id", "predicate"]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25))
@settings(max_examples=200, deadline=None)
def test_map_equals_the_set_of_points(pairs):
    held = I.IntervalMap()
    covered = set()
    for a, b in pairs:
        held.insert(a, b)
        covered |= set(range(a, b))
    assert {p for a, b in zip(held.starts, held.ends) for p in range(a, b)} == covered
    assert all(b < c for b, c in held.gaps()) and held.starts == sorted(held.starts)


def brute(rows):
    from tests.test_kslack import K_us

    out_gaps, out_periods = set(), set()
    by = {}
    for s, p, a, b in rows:
        lo, hi = (I.OPEN_FROM if a is None else K_us(a)), (I.OPEN_TO if b is None else K_us(b))
        if lo < hi:
            by.setdefault((s, p), []).append((lo, hi))
    for key, own in by.items():
        merged = []
        for lo, hi in sorted(own):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        out_gaps |= {(*key, x[1], y[0]) for x, y in zip(merged, merged[1:])}
        out_periods |= {(*key, None if a == I.OPEN_FROM else a, None if b == I.OPEN_TO else b) for a, b in merged}
    return out_gaps, out_periods


def check(spark, rows):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    gaps = [tuple(r) for r in I.gaps(df, KEYS).collect()]
    periods = [tuple(r) for r in I.periods(df, KEYS).collect()]
    want_gaps, want_periods = brute(rows)
    assert set(gaps) == want_gaps and len(gaps) == len(want_gaps)
    assert set(periods) == want_periods and len(periods) == len(want_periods)


def test_bounds(spark, at):
    check(spark, [
        ("a", "p", at(0), at(1)), ("a", "p", at(1), at(2)), ("a", "p", at(3), at(4)), ("a", "q", None, at(1)), ("a", "q", at(2), None), ("b", "p", at(5), at(5)),
        ("b", "p", at(6), at(5)), (None, "p", at(0), at(1)), (None, "p", at(2), at(3)), ("c", None, None, None), ("a", "p", at(0), at(1)),
    ])


def test_a_hot_key_over_many_tasks(spark, at):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        start = rng.uniform(0, 400)
        span = rng.choice([0.2, 0.5, 1, 3, 60 if i % 97 == 0 else 0.1])
        rows.append(("hot" if i % 3 else f"s{i % 40}", "p", at(start), at(start + span)))
    check(spark, rows)


def test_empty(spark):
    check(spark, [])
