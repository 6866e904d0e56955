"""The ordered event stream of jobs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("done", "failed")
OUT = "job_id string, seq long, type string, stage string, state string, reason string"
STATE = "seq long, ended boolean"


def _numbering(quiet_ms: int | None):
    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, ended = state.get if state.exists else (0, False)
        rows = pd.concat(list(parts)).sort_values("event_no", kind="stable")
        out = []
        for r in rows.itertuples():
            if ended:
                break
            seq += 1
            out.append((key[0], seq, r.type, r.stage, r.state, r.reason))
            ended = r.type in TERMINAL
        state.update((seq, ended))
        if quiet_ms is not None:
            newest = rows["at_ms"].max()
            state.setTimeoutTimestamp(max(int(newest) if newest == newest else 0, state.getCurrentWatermarkMs()) + quiet_ms)
        yield pd.DataFrame(out, columns=["job_id", "seq", "type", "stage", "state", "reason"])

    return number


def number_events(events: DataFrame, at: str | None = None, quiet_hours: float = 24.0) -> DataFrame:
    """Give the events of each job consecutive numbers across micro-batches; what follows a job's terminal event is dropped.

    ``events``: a stream of job_id, event_no (order of arrival), type, stage, state, reason. Order within a micro-batch is
    event_no; a later batch comes after an earlier one. The state is one number and one flag a job. With ``at``, the time
    column, it is removed once a job, ended or not, has had no event for ``quiet_hours`` of event time, so it is bounded by
    the jobs of that time; an event after that would begin a new count, as later than the watermark it is dropped. Without
    ``at`` the state stays, which suits a run over a finite log only.
    """
    slim = events.select("job_id", "event_no", "type", "stage", "state", "reason", *([at] if at else [])).filter("job_id IS NOT NULL")
    if at is None:
        return slim.groupBy("job_id").applyInPandasWithState(_numbering(None), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    timed = slim.withWatermark(at, f"{int(quiet_hours * 3600)} seconds").withColumn("at_ms", F.unix_millis(at))
    return timed.groupBy("job_id").applyInPandasWithState(_numbering(int(quiet_hours * 3_600_000)), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay_from(numbered: DataFrame, after: int, at: str | None = None, late: str = "24 hours") -> DataFrame:
    """The numbered events past ``after``; repeated deliveries of a number count once.

    Of a stream, ``at`` names its time column: numbers are remembered for ``late`` only, so the state is bounded.
    """
    rows = numbered.filter(numbered.seq > after)
    if at is not None:
        return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["job_id", "seq"])
    if rows.isStreaming:
        raise ValueError("replay_from needs the time column of a stream, or its state would grow for ever")
    return rows.dropDuplicates(["job_id", "seq"])
