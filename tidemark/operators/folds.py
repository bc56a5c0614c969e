"""Order-dependent folds over the rows of a key.

Rows are partitioned by key and sorted inside each partition, then streamed through
a fold with a small state; a key's rows are never gathered in memory, so a crowded key
costs time in its task but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list, start: Callable[[], object], step: Callable[[object, dict], tuple], schema: str, out_types: list[pa.DataType], out_names: list[str]) -> DataFrame:
    """``step(state, row)`` gives (state, values of the output row); the state begins anew with each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, start()
                state, values = step(state, row)
                out.append(values)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(out_types)], names=out_names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def cluster_semantic(vectors: DataFrame, group_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding", max_size: int = 5, threshold: float = 0.3) -> DataFrame:
    """Sequential clusters in id order: a new one when the last is full or too unlike on average.

    Similarity is the mean of (1 + cos) / 2 to the vectors of the current cluster; null and
    zero vectors have similarity 0.  Gives group, id and ``cluster`` (from 0).
    """

    def start() -> dict:
        return {"cluster": -1, "held": []}

    def step(state: dict, row: dict) -> tuple:
        v = np.array(row[vec_col] or [], float)
        size = np.linalg.norm(v) if len(v) else 0.0
        unit = v / size if size else None
        held = state["held"]
        new = not held or len(held) >= max_size
        if not new:
            alike = [(1 + float(unit @ h)) / 2 if unit is not None and h is not None and len(h) == len(unit) else 0.0 for h in held]
            new = sum(alike) / len(alike) < threshold
        if new:
            state["cluster"] += 1
            state["held"] = []
        state["held"].append(unit)
        return state, (row[group_col], row[id_col], state["cluster"])

    types = dict(vectors.dtypes)
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return ordered_fold(
        vectors.select(group_col, id_col, vec_col), [group_col], [id_col], start, step, f"`{group_col}` {types[group_col]}, `{id_col}` {types[id_col]}, cluster long",
        [arrow[types[group_col]], arrow[types[id_col]], pa.int64()], [group_col, id_col, "cluster"],
    )


def cluster_sequential(
    rows: DataFrame, group_col: str, id_col: str, us_col: str, vec_col: str, max_gap_hours: int = 168, max_size: int = 5, threshold: float = 0.3
) -> DataFrame:
    """Sequential clusters in order of time: a new one after a gap longer than ``max_gap_hours``, else when the last is
    full, else when the row is too unlike it on average (mean (1 + cos) / 2 below ``threshold``).

    Null, zero and differently long vectors have similarity 0.  Rows without group or time belong
    to none.  Gives group, id and ``cluster`` (from 0).
    """

    def start() -> dict:
        return {"cluster": -1, "held": [], "us": None}

    def step(state: dict, row: dict) -> tuple:
        v = np.array(row[vec_col] or [], float)
        size = np.linalg.norm(v) if len(v) else 0.0
        unit, held = (v / size if size else None), state["held"]
        new = not held or row[us_col] - state["us"] > max_gap_hours * 3_600_000_000 or len(held) >= max_size
        if not new:
            alike = [(1 + float(unit @ h)) / 2 if unit is not None and h is not None and len(h) == len(unit) else 0.0 for h in held]
            new = round(sum(alike) / len(alike), 12) < threshold
        if new:
            state["cluster"] += 1
            state["held"] = []
        state["held"].append(unit)
        state["us"] = row[us_col]
        return state, (row[group_col], row[id_col], state["cluster"])

    types = dict(rows.dtypes)
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return ordered_fold(
        rows.select(group_col, id_col, us_col, vec_col).dropna(subset=[group_col, us_col]), [group_col], [us_col, id_col], start, step,
        f"`{group_col}` {types[group_col]}, `{id_col}` {types[id_col]}, cluster long", [arrow[types[group_col]], arrow[types[id_col]], pa.int64()], [group_col, id_col, "cluster"],
    )


def trim_replay(messages: DataFrame, budget: int, pressure: float = 0.8, keep: float = 0.9) -> DataFrame:
    """What a dialog holds after each message: ``conv_id``, ``seq``, ``held``, ``tokens``.

    When tokens reach ``pressure`` of the budget, the oldest messages go until at most
    ``keep`` of that is left; the newest always stays.
    """
    from collections import deque

    limit = int(budget * pressure * keep)

    def start() -> dict:
        return {"q": deque(), "sum": 0}

    def step(state: dict, row: dict) -> tuple:
        state["q"].append(row["tokens"])
        state["sum"] += row["tokens"]
        if state["sum"] / budget >= pressure:
            while len(state["q"]) > 1 and state["sum"] > limit:
                state["sum"] -= state["q"].popleft()
        return state, (row["conv_id"], row["seq"], len(state["q"]), state["sum"])

    return ordered_fold(
        messages.select("conv_id", "seq", "tokens"), ["conv_id"], ["seq"], start, step, "conv_id string, seq long, held long, tokens long", [pa.string(), pa.int64(), pa.int64(), pa.int64()], ["conv_id", "seq", "held", "tokens"]
    )
