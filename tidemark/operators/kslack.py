"""Per-period aggregates over late and out-of-order events by K-slack reordering.

Rows are split by *event time* (a range partitioning on event time and id, so
that a crowded day or instant spreads over several tasks) and replayed inside
each task in *arrival order* through :class:`KSlackBuffer`.  The buffer holds an
event until the arrival clock passes the end of its period plus the slack, and
then releases the whole period in event order to the final, order-sensitive fold.
While a period waits, the fold of what the buffer holds is published as a
provisional value at fixed instants.  Folds of neighbouring ranges are merged in
event order afterwards; there are at most as many per period as tasks.

Defined results
---------------
* Rows whose id, event time or arrival time is null are no events.
* Of several rows of one id the one that arrived first counts (ties: the smaller
  event time, then the smaller value).
* An event that arrives exactly at the end of its period is in time; exactly at
  the cut-off it is late, not dropped.
* Events of equal time are ordered by id.
* A null value counts as an event and adds 0 to sums; it is passed over by the
  comparison of successive values.
* An empty table gives an empty result.  Extra columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import shuffle_partitions

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
OUTCOMES = ("on_time", "late", "dropped")


@dataclass
class KSlackBuffer:
    """The reordering buffer of one stream; times are int64 microseconds.

    ``push`` takes arrivals in arrival order and gives back the events whose
    period has passed its cut-off, sorted by (event time, id); ``flush`` gives the
    rest.  Too late arrivals are refused: marked, never held.  A period's arrivals
    are kept as runs in arrival order and put in event order once, on release.
    When the clock passes the period's end plus one of ``publish_us``, the count and
    sum of what is held of it go to ``snapshots``.
    """

    slack_us: int
    period_us: int = DAY_US
    publish_us: tuple[int, ...] = ()
    held: dict[int, list[pd.DataFrame]] = field(default_factory=dict)
    n_held: int = 0
    #: (period, instant, events, sum of values in millionths) as published so far
    snapshots: list[tuple[int, int, int, int]] = field(default_factory=list)
    _due: list[tuple[int, int, int]] = field(default_factory=list)  # heap of (instant, period, step)

    def classify(self, event_us: np.ndarray, arrival_us: np.ndarray) -> np.ndarray:
        """0 in time, 1 late, 2 beyond the lateness bound."""
        late_by = arrival_us - (event_us // self.period_us + 1) * self.period_us
        return (late_by > 0).astype(np.int8) + (late_by > self.slack_us)

    def push(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Adds arrivals; returns (released in event order, the arrivals with ``outcome``)."""
        rows = rows.assign(outcome=self.classify(rows["event_us"].to_numpy(), rows["arrival_us"].to_numpy()))
        kept = rows[rows["outcome"] < 2]
        if len(kept):
            period = kept["event_us"].to_numpy() // self.period_us
            order = np.argsort(period, kind="stable")
            kept, period = kept.iloc[order], period[order]
            cuts = np.flatnonzero(np.diff(period)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(period)], strict=True):
                self._hold(int(period[a]), kept.iloc[a:b])
        return self._release(int(rows["arrival_us"].iloc[-1])), rows

    def flush(self) -> pd.DataFrame:
        return self._release(None)

    def _hold(self, period: int, run: pd.DataFrame) -> None:
        if period not in self.held:
            self.held[period] = []
            end = (period + 1) * self.period_us
            for k, step in enumerate(self.publish_us):
                heapq.heappush(self._due, (end + step, period, k))
            heapq.heappush(self._due, (end + self.slack_us, period, len(self.publish_us)))
        self.held[period].append(run)
        self.n_held += len(run)

    def _publish(self, period: int, instant: int) -> None:
        n = micro = 0
        for run in self.held[period]:
            there = int(np.searchsorted(run["arrival_us"].to_numpy(), instant, side="right"))
            n += there
            micro += int(np.rint(np.nan_to_num(run["value"].to_numpy(dtype=float)[:there]) * 1e6).sum())
        if n:
            self.snapshots.append((period, instant, n, micro))

    def _release(self, clock: int | None) -> pd.DataFrame:
        out = []
        # an arrival at an instant itself still counts for it
        while self._due and (clock is None or self._due[0][0] < clock):
            instant, period, step = heapq.heappop(self._due)
            if step < len(self.publish_us):
                self._publish(period, instant)
                continue
            runs = self.held.pop(period)
            whole = pd.concat(runs, ignore_index=True) if len(runs) > 1 else runs[0]
            self.n_held -= len(whole)
            out.append(whole.sort_values(["event_us", "id"], kind="stable"))
        if not out:
            return pd.DataFrame(columns=["id", "event_us", "arrival_us", "value", "outcome"])
        return pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]


def ordered_fold(released: pd.DataFrame, period_us: int) -> pd.DataFrame:
    """The order-sensitive aggregate of released events, one row per period.

    Mergeable with the fold of the next range: it keeps its first and last event.
    """
    period = released["event_us"].to_numpy() // period_us
    event = released["event_us"].to_numpy()
    value = released["value"].to_numpy(dtype=float)
    known = ~np.isnan(value)
    same = np.zeros(len(event), bool)
    same[1:] = period[1:] == period[:-1]
    gap = np.zeros(len(event), np.int64)
    gap[1:] = np.where(same[1:], event[1:] - event[:-1], 0)
    order = np.flatnonzero(known)
    rise = np.zeros(len(event), np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        rise[b] = (period[a] == period[b]) & (value[b] > value[a])
    frame = pd.DataFrame(
        {
            "period": period, "event_us": event, "late": (released["outcome"].to_numpy() == 1).astype(np.int64), "gap": gap, "rise": rise,
            "micro": np.where(known, np.rint(np.nan_to_num(value) * 1e6), 0).astype(np.int64), "value": value,
        }
    )
    g = frame.groupby("period", sort=True)
    return g.agg(
        n_events=("event_us", "size"), n_late=("late", "sum"), sum_micro=("micro", "sum"), first_us=("event_us", "first"), last_us=("event_us", "last"),
        max_gap_us=("gap", "max"), n_rises=("rise", "sum"), first_value=("value", "first"), last_value=("value", "last"),
    ).reset_index()


def arrivals(df: DataFrame, id_col: str, event_col: str, arrival_col: str, value_col: str | None = None) -> DataFrame:
    """The events to replay: ``id``, ``event_us``, ``arrival_us``, ``value``; the first arrival of each id."""
    value = F.col(value_col).cast("double") if value_col else F.lit(None).cast("double")
    rows = df.select(
        F.col(id_col).alias("id"), F.unix_micros(F.col(event_col).cast("timestamp")).alias("event_us"),
        F.unix_micros(F.col(arrival_col).cast("timestamp")).alias("arrival_us"), value.alias("value"),
    ).where("id is not null and event_us is not null and arrival_us is not null")
    first = F.min(F.struct("arrival_us", "event_us", "value")).alias("first")
    return rows.groupBy("id").agg(first).select("id", "first.event_us", "first.arrival_us", "first.value")


_SCHEMA = (
    "kind string, id string, period long, outcome byte, published_us long, n_events long, n_late long, sum_micro long, first_us long, last_us long,"
    " max_gap_us long, n_rises long, first_value double, last_value double"
)
_COLUMNS = [c.strip().split(" ")[0] for c in _SCHEMA.split(",")]


def _replay(events: DataFrame, slack_us: int, period_us: int, emit: tuple[str, ...], publish_us: tuple[int, ...] = ()) -> DataFrame:
    """Runs the buffer over every range; ``emit`` picks from cases, folds and provisional values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer = KSlackBuffer(slack_us, period_us, publish_us)
        folds: list[pd.DataFrame] = []

        def out(kind: str, frame: pd.DataFrame) -> pd.DataFrame:
            whole = frame.assign(kind=kind).reindex(columns=_COLUMNS)
            return whole.astype({"kind": object, "id": object}).where(whole.notna(), None)

        def cases(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if "case" in emit and len(rows):
                yield out("case", rows.assign(period=rows["event_us"] // period_us)[["id", "period", "outcome"]])

        def released(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """What the buffer lets go: late events are told then, and the fold goes on in event order."""
            if len(rows):
                yield from cases(rows[rows["outcome"] == 1])
                if "fold" in emit:
                    folds.append(ordered_fold(rows, period_us))
            if len(folds) > 1000:
                yield out("fold", pd.concat(folds, ignore_index=True))
                folds.clear()
            if buffer.snapshots:
                held = np.array(buffer.snapshots, dtype=np.int64)
                buffer.snapshots.clear()
                if "provisional" in emit:
                    yield out("provisional", pd.DataFrame({"period": held[:, 0], "published_us": held[:, 1], "n_events": held[:, 2], "sum_micro": held[:, 3]}))

        for rows in batches:
            if not len(rows):
                continue
            ready, seen = buffer.push(rows)
            yield from cases(seen[seen["outcome"] == 2])  # refused
            yield from released(ready)
        yield from released(buffer.flush())
        if folds:
            yield out("fold", pd.concat(folds, ignore_index=True))

    n = shuffle_partitions(events.sparkSession)
    ranges = events.repartitionByRange(n, "event_us", "id").sortWithinPartitions("arrival_us", "id")
    return ranges.mapInPandas(run, _SCHEMA)


def _day(period: str = "period") -> F.Column:
    return F.date_format(F.timestamp_micros(F.col(period) * DAY_US), "yyyy-MM-dd").alias("period_day")


def late_cases(events: DataFrame, slack_hours: int = 72) -> DataFrame:
    """``id``, ``period_day``, ``outcome`` of each event that arrived after its day had closed."""
    found = _replay(events, slack_hours * HOUR_US, DAY_US, ("case",))
    return found.select("id", _day(), F.when(F.col("outcome") == 1, "late").otherwise("dropped").alias("outcome"))


def daily_figures(events: DataFrame, slack_hours: int = 72) -> DataFrame:
    """The final figures of each day, from events released in order, corrected by late arrivals within the bound.

    ``sum_micro`` is the sum of values in millionths, ``max_gap_us`` the longest pause between
    successive events and ``n_rises`` how often a value exceeded its predecessor's.
    """
    folds = _replay(events, slack_hours * HOUR_US, DAY_US, ("fold",))
    # a day may be released in several ranges (and, on a slow stream, in several steps): merge in event order
    w = Window.partitionBy("period").orderBy("first_us", "last_us")
    before = F.last("last_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = folds.withColumn("join_gap", F.coalesce(F.col("first_us") - F.lag("last_us").over(w), F.lit(0)))
    joined = joined.withColumn("join_rise", F.coalesce((F.col("first_value") > before).cast("long"), F.lit(0)))
    return joined.groupBy("period").agg(
        F.sum("n_events").alias("n_events"), F.sum("n_late").alias("n_late"), F.sum("sum_micro").alias("sum_micro"), F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"), F.max(F.greatest("max_gap_us", "join_gap")).alias("max_gap_us"), (F.sum("n_rises") + F.sum("join_rise")).alias("n_rises"),
    ).select(_day(), "n_events", "n_late", "sum_micro", "first_us", "last_us", "max_gap_us", "n_rises")


def provisional_figures(events: DataFrame, slack_hours: int = 72, every_hours: int = 24) -> DataFrame:
    """What the buffer publishes of each waiting day: at its end and every ``every_hours`` up to the cut-off."""
    steps = tuple(h * HOUR_US for h in range(0, slack_hours + 1, every_hours))
    found = _replay(events, slack_hours * HOUR_US, DAY_US, ("provisional",), steps)
    return found.groupBy("period", "published_us").agg(F.sum("n_events").alias("n_events"), F.sum("sum_micro").alias("sum_micro")).select(_day(), "published_us", "n_events", "sum_micro")
