"""Streaming form of the interval operator: an ordered disjoint-interval map per key in keyed state.

State is two packed lists per key; each batch inserts its intervals by binary search and
emits the key's periods anew.  Bounds are microseconds; see :mod:`tidemark.operators.intervals`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.intervals import IntervalMap, bounded


def merged_periods(stream: DataFrame, keys: list[str], from_col: str, to_col: str) -> DataFrame:
    """Update mode: for each key that changed, all its periods (keys, ``lo``, ``hi``, ``place``, ``n``)."""
    rows = bounded(stream, keys, from_col, to_col)
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "lo long, hi long, place int, n int"])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = IntervalMap()
        if state.exists:
            lo, hi = (np.frombuffer(b, np.int64).tolist() for b in state.get)
            held = IntervalMap(lo, hi)
        for pdf in batches:
            for lo, hi in zip(pdf["lo"].tolist(), pdf["hi"].tolist(), strict=True):
                held.insert(lo, hi)
        state.update((np.array(held.starts, np.int64).tobytes(), np.array(held.ends, np.int64).tobytes()))
        out = pd.DataFrame({"lo": held.starts, "hi": held.ends})
        for name, value in zip(keys, key, strict=True):
            out[name] = value
        yield out.assign(place=range(len(out)), n=len(out))[[*keys, "lo", "hi", "place", "n"]]

    return rows.groupBy(*keys).applyInPandasWithState(update, schema, "lo binary, hi binary", "update", GroupStateTimeout.NoTimeout)
