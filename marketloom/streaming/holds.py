"""Holds on a credit that end by themselves: keyed state with event-time timers, and the same outcome from a whole log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A hold counts against the balance for so long; afterwards it can still be captured until it is forgotten.
MINUTES, REMEMBERED_HOURS = 10, 24
OUTCOME = "hold_id string, outcome string, at timestamp"
OPEN, EXPIRED, ENDED = 0, 1, 2
_MINUTE = 60_000


def _micros(frame: pd.DataFrame, kind: str) -> np.ndarray:
    return frame.loc[frame["kind"] == kind, "at"].to_numpy("datetime64[us]").astype(np.int64)


def _first(times: np.ndarray, since: int) -> int | None:
    later = times[times >= since]
    return int(later.min()) if len(later) else None


def holds(events: DataFrame, minutes: int = MINUTES, remembered_hours: int = REMEMBERED_HOURS, late: str = "10 minutes") -> DataFrame:
    """Outcomes (hold_id, outcome, at) of events (hold_id, kind, at), kind being hold, capture or release.

    The first hold of an id opens it; holds and ends that repeat, and ends of an id that isn't held, change nothing. A capture or release
    ends it: `captured`, `released`. A timer of event time ends its effect `minutes` after it was opened: `expired`; it may still be
    captured afterwards, while a release then says nothing more. `remembered_hours` after it was opened a second timer drops its state, so
    state is bounded by the ids of that time. Of the events of one batch the earliest count, a capture before a release of the same time;
    between batches the first to come counts. Per id a batch's times are held, eight bytes each. Rows later than the
    watermark of the batch before are dropped; a hold that comes when its time is over has expired at once.
    """
    held, kept = minutes * _MINUTE, remembered_hours * 60 * _MINUTE

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, int]] = []
        opened, stage = state.get if state.exists else (None, OPEN)
        if state.hasTimedOut:
            if stage != OPEN:
                state.remove()
                return
            out.append(("expired", opened + held * 1000))
            stage = EXPIRED
        else:
            times: dict[str, list[np.ndarray]] = {"hold": [], "capture": [], "release": []}
            for frame in batches:
                for kind, found in times.items():
                    found.append(_micros(frame, kind))
            starts, captures, releases = (np.concatenate(x) for x in times.values())
            if opened is None:
                if not len(starts):
                    return
                opened = int(starts.min())
            if stage != ENDED:
                capture, release = _first(captures, opened), _first(releases, opened)
                ends = [t for t in (capture, release) if t is not None]
                end, due = min(ends, default=None), opened + held * 1000
                if stage == OPEN and end is not None and end >= due:
                    out.append(("expired", due))
                    stage = EXPIRED
                if end is not None:
                    if end == capture:
                        out.append(("captured", end))
                    elif stage == OPEN:
                        out.append(("released", end))
                    stage = ENDED
        # timers lie ahead of the watermark; what is due already is done at once
        reached = state.getCurrentWatermarkMs()
        if stage == OPEN and opened // 1000 + held <= reached:
            out.append(("expired", opened + held * 1000))
            stage = EXPIRED
        state.update((opened, stage))
        state.setTimeoutTimestamp(max(opened // 1000 + (held if stage == OPEN else kept), reached + 1))
        if out:
            yield pd.DataFrame({"hold_id": [key[0]] * len(out), "outcome": [o for o, _ in out], "at": [pd.Timestamp(t, unit="us") for _, t in out]})

    keyed = events.select("hold_id", "kind", "at").withWatermark("at", late).groupBy("hold_id")
    return keyed.applyInPandasWithState(step, OUTCOME, "opened long, stage int", "append", GroupStateTimeout.EventTimeTimeout)


def holds_batch(events: DataFrame, until: Column, minutes: int = MINUTES) -> DataFrame:
    """The outcomes from a log of ids none of which is used again after it is forgotten. Holds whose time ends before `until`, the
    watermark that a stream would have reached, are expired."""
    opened = events.where("kind = 'hold'").groupBy("hold_id").agg(F.min("at").alias("opened"))
    ends = events.where("kind <> 'hold'").join(opened, "hold_id").where("at >= opened").groupBy("hold_id")
    first_of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at"))).alias(kind)
    rows = opened.join(ends.agg(first_of("capture"), first_of("release")), "hold_id", "left")
    rows = rows.withColumn("due", F.col("opened") + F.expr(f"interval {minutes} minutes"))
    capture, release, due = F.col("capture"), F.col("release"), F.col("due")
    outcome = lambda name, when, at: F.when(when, F.struct(F.lit(name).alias("outcome"), at.alias("at")))
    found = F.array(
        outcome("expired", F.coalesce(F.least(capture, release) >= due, due < until), due),
        outcome("captured", F.coalesce(capture <= release, capture.isNotNull()), capture),
        outcome("released", F.coalesce(release < capture, release.isNotNull()) & (release < due), release),
    )
    return rows.select("hold_id", F.explode(F.array_compact(found)).alias("o")).select("hold_id", "o.*")
