"""Overlapping and gapped intervals to continuous periods and the holes between them.

Each key keeps an :class:`IntervalMap`, an ordered map of disjoint intervals: an
insertion finds the overlapped intervals by binary search, merges them and so
updates the gaps.  The same map is the keyed state of the streaming form
(:mod:`tidemark.streaming.intervals`).  In batch, rows are range-partitioned by
(key, start), so a key with a third of all rows spreads over many tasks; each
task keeps its own map per key and reports its fragments.  A fragment's place
then depends only on how far earlier tasks reached for the same key: at most one
key crosses a boundary, so that carry table has no more rows than tasks and is
broadcast.

Defined results
---------------
* A null bound is open on that side.  Intervals include their start and exclude
  their end; touching ones are continuous.
* An interval whose start is not before its end holds never and is ignored.
* Null keys form a group of their own.  Repeated rows change nothing.
* An open side gives a period with a null bound and never a hole.
* An empty table gives an empty result.  Extra columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import materialise, shuffle_partitions

OPEN_FROM, OPEN_TO = -(2**63), 2**63 - 1


class IntervalMap:
    """Disjoint half-open intervals in order, kept while intervals arrive in any order."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts, self.ends = starts or [], ends or []

    def insert(self, start: int, end: int) -> None:
        if start >= end:
            return
        first = bisect_left(self.ends, start)  # the first that reaches to start or beyond
        last = bisect_right(self.starts, end)  # past the last that begins by end
        if first < last:
            start, end = min(start, self.starts[first]), max(end, self.ends[last - 1])
        self.starts[first:last] = [start]
        self.ends[first:last] = [end]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))


def bounded(df: DataFrame, keys: list[str], from_col: str, to_col: str) -> DataFrame:
    """The keys with ``lo`` and ``hi`` in microseconds; intervals that hold never are left out."""
    lo = F.coalesce(F.unix_micros(F.col(from_col).cast("timestamp")), F.lit(OPEN_FROM))
    hi = F.coalesce(F.unix_micros(F.col(to_col).cast("timestamp")), F.lit(OPEN_TO))
    return df.select(*keys, lo.alias("lo"), hi.alias("hi")).where("lo < hi")


def _fragments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The disjoint fragments of each task and key: ``lo``, ``hi``, ``before`` (the fragment ahead in the task) and ``chunk``."""
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "lo long, hi long, before long, chunk int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, key, held = TaskContext.get().partitionId(), None, IntervalMap()
        kinds: list[pa.DataType] = []
        names: list[tuple] = []
        sizes: list[int] = []
        lo_out: list[int] = []
        hi_out: list[int] = []
        before: list[int | None] = []

        def close() -> None:
            if held.starts:
                names.append(key)
                sizes.append(len(held.starts))
                lo_out.extend(held.starts)
                hi_out.extend(held.ends)
                before.append(None)
                before.extend(held.ends[:-1])

        def out() -> pa.RecordBatch:
            at = np.repeat(np.arange(len(names)), sizes)
            columns = [pa.array([n[k] for n in names], kinds[k]).take(pa.array(at)) for k in range(len(keys))]
            columns += [pa.array(lo_out, pa.int64()), pa.array(hi_out, pa.int64()), pa.array(before, pa.int64()), pa.array(np.full(len(at), chunk, np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "lo", "hi", "before", "chunk"])

        for rows in batches:
            kinds = [rows.column(k).type for k in range(len(keys))]
            for row in zip(*(column.to_pylist() for column in rows.columns), strict=True):
                if row[:-2] != key:
                    close()
                    key, held = row[:-2], IntervalMap()
                    if len(lo_out) >= 100_000:
                        yield out()
                        for kept in (names, sizes, lo_out, hi_out, before):
                            kept.clear()
                held.insert(row[-2], row[-1])
        close()
        if lo_out:
            yield out()

    n = shuffle_partitions(rows.sparkSession)
    # sorted by start as well, insertions are appends
    return rows.repartitionByRange(n, *keys, "lo").sortWithinPartitions(*keys, "lo").mapInArrow(run, schema)


def coverage(df: DataFrame, keys: list[str], from_col: str, to_col: str) -> DataFrame:
    """Each place where a continuous period starts: keys, ``lo``, ``ended`` (end of the period before, null for none), ``chunk``."""
    rows = bounded(df, keys, from_col, to_col)
    fragments = materialise(_fragments(rows, keys))
    reach = fragments.groupBy(*keys, "chunk").agg(F.max("hi").alias("reach"), F.max("lo").alias("latest"))
    return _starts(fragments, reach, keys), fragments, reach


def _starts(fragments: DataFrame, reach: DataFrame, keys: list[str]) -> DataFrame:
    by_key = Window.partitionBy(*keys).orderBy("chunk")
    # a window over one row per key and task; only keys that cross a task boundary have more than one
    carry = reach.select(*keys, "chunk", F.max("reach").over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("carry")).where("carry is not null")
    # each boundary between tasks is crossed by one key at most: no more rows than tasks
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "chunk"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    ended = F.greatest("f.before", "c.carry")
    placed = fragments.alias("f").join(F.broadcast(carry.alias("c")), on, "left").select(*(f"f.{k}" for k in keys), "f.lo", ended.alias("ended"), "f.chunk")
    return placed.where("ended is null or lo > ended")


def gaps(df: DataFrame, keys: list[str], from_col: str = "valid_from", to_col: str = "valid_to") -> DataFrame:
    """The holes between neighbouring continuous periods: keys, ``gap_from_us``, ``gap_to_us``."""
    starts, _, _ = coverage(df, keys, from_col, to_col)
    return starts.where("ended is not null").select(*keys, F.col("ended").alias("gap_from_us"), F.col("lo").alias("gap_to_us"))


def periods(df: DataFrame, keys: list[str], from_col: str = "valid_from", to_col: str = "valid_to") -> DataFrame:
    """The continuous periods: keys, ``from_us``, ``to_us`` (null where open)."""
    starts, _, reach = coverage(df, keys, from_col, to_col)
    # a period ends where the next start of its key says so: inside the task, at a later task, or at the key's reach
    inside = Window.partitionBy(*keys, "chunk").orderBy("lo")
    led = starts.select("*", F.lead("ended").over(inside).alias("next_end"))
    first = starts.groupBy(*keys, "chunk").agg(F.min("lo").alias("first_lo"), F.min_by("ended", "lo").alias("first_ended"))
    span = reach.alias("r").join(first.alias("s"), [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "chunk"]], "left").select(*(f"r.{k}" for k in keys), "r.chunk", "reach", "first_ended", F.col("first_lo").isNotNull().alias("starts"))
    ahead = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    later = F.first(F.when(F.col("starts"), F.col("first_ended")), ignorenulls=True).over(ahead)
    final = F.max("reach").over(Window.partitionBy(*keys))
    tail = span.select(*keys, "chunk", F.coalesce(later, final).alias("tail_end"))
    out = led.alias("l").join(tail.alias("t"), [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "chunk"]])
    end = F.coalesce("l.next_end", "t.tail_end")
    return out.select(*(f"l.{k}" for k in keys), F.nullif(F.col("l.lo"), F.lit(OPEN_FROM)).alias("from_us"), F.nullif(end, F.lit(OPEN_TO)).alias("to_us"))
