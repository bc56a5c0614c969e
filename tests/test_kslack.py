import random

import numpy as np
import pandas as pd

from tidemark.operators import kslack as K

SCHEMA = "id string, occurred_at timestamp_ntz, recorded_at timestamp_ntz, salience double, outcome string, period string"


def events(spark, rows):
    # extra columns carry names the operator uses itself
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return K.arrivals(df, "id", "occurred_at", "recorded_at", "salience")


def test_outcomes_at_the_bounds(spark, at):
    rows = [
        ("in", at(0, 5), at(0, 6), 0.1), ("midnight", at(0, 5), at(1), 0.1), ("late", at(0, 5), at(1, 0, 1), 0.1), ("edge", at(0, 5), at(4), 0.1),
        ("dropped", at(0, 5), at(4, 0, 1), 0.1), ("early", at(5), at(0), 0.1), ("no time", None, at(0), 0.1), (None, at(0), at(9), 0.1), ("no arrival", at(0), None, 0.1),
    ]
    got = {tuple(r) for r in K.late_cases(events(spark, rows)).collect()}
    assert got == {("late", "2025-01-01", "late"), ("edge", "2025-01-01", "late"), ("dropped", "2025-01-01", "dropped")}


def test_first_arrival_of_an_id_counts(spark, at):
    rows = [("a", at(0), at(9), 0.1), ("a", at(0), at(0, 1), 0.1), ("b", at(0), at(9), 0.1), ("b", at(0), at(9), 0.1)]
    assert [tuple(r) for r in K.late_cases(events(spark, rows)).collect()] == [("b", "2025-01-01", "dropped")]


def test_daily_figures_equal_brute_force(spark, at):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        when = at(rng.choice([0, 0, 0, 1, 2]), rng.randrange(24), rng.randrange(3) * 60)
        rows.append((f"e{i:03}", when, at(0, 0, (when - at(0)).total_seconds() + rng.expovariate(1 / 90000.0)), rng.choice([None, 0.2, 0.5, 0.9])))
    got = {r.period_day: r for r in K.daily_figures(events(spark, rows)).collect()}
    day = 86_400_000_000
    for name, r in got.items():
        own = sorted((K_us(w), i, v, K_us(a)) for i, w, a, v in rows if w.strftime("%Y-%m-%d") == name)
        close = (own[0][0] // day + 1) * day
        own = [x for x in own if x[3] <= close + 72 * K.HOUR_US]
        assert r.n_events == len(own)
        assert r.n_late == sum(x[3] > close for x in own)
        assert r.sum_micro == sum(round((x[2] or 0) * 1e6) for x in own)
        assert r.max_gap_us == max([b[0] - a[0] for a, b in zip(own, own[1:])], default=0)
        known = [x[2] for x in own if x[2] is not None]
        assert r.n_rises == sum(b > a for a, b in zip(known, known[1:]))


def K_us(t):
    import datetime as dt

    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def test_provisional_values_grow_to_the_final_one(spark, at):
    rows = [("a", at(0), at(0, 1), 0.5), ("b", at(0), at(1, 5), 0.25), ("c", at(0), at(3, 5), 0.25), ("d", at(0), at(9), 0.25)]
    got = [(r.n_events, r.sum_micro) for r in K.provisional_figures(events(spark, rows)).orderBy("published_us").collect()]
    assert got == [(1, 500000), (2, 750000), (2, 750000), (3, 1000000)]


def test_empty_table(spark):
    none = events(spark, [])
    assert K.late_cases(none).count() == K.daily_figures(none).count() == K.provisional_figures(none).count() == 0


def test_buffer_releases_in_event_order_and_only_what_is_ripe():
    day = K.DAY_US
    buffer = K.KSlackBuffer(slack_us=day)
    rows = pd.DataFrame({"id": ["b", "a", "c"], "event_us": [5, 5, day + 1], "arrival_us": [10, 20, day + 30], "value": [1.0, 2.0, 3.0]})
    ready, seen = buffer.push(rows)
    assert len(ready) == 0 and list(seen["outcome"]) == [0, 0, 0] and buffer.n_held == 3
    ready, seen = buffer.push(pd.DataFrame({"id": ["d"], "event_us": [1], "arrival_us": [2 * day + 1], "value": [0.0]}))
    assert list(ready["id"]) == ["a", "b"] and list(seen["outcome"]) == [2]
    assert list(buffer.flush()["id"]) == ["c"] and np.array_equal(buffer.classify(np.array([0]), np.array([day])), [0])
