"""A monitor of growing counts as a stream: done at the target, stalled after polls without growth."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATUS = "kind string, polls long, best double, idle long, stalled_at long, status string"
STATE = "polls long, best double, idle long, stalled_at long, ended string"


def watch(polls: DataFrame, kind: str, order: list[str], count: str, target: float | None = None, patience: int = 6, silence: str | None = None) -> DataFrame:
    """A row ``STATUS`` for each kind and batch: how many polls it had and how it stands.

    A kind is ``done`` once a poll reaches ``target``, ``stalled`` at the poll that ends ``patience``
    ones without a new maximum (``stalled_at`` stays that poll's number), and else ``growing``; the first
    of both ends it, and later polls are only counted. With ``silence`` (such as ``30 minutes``) a kind
    without a poll for that long on the clock becomes ``silent``. Polls of a batch are taken in ``order``,
    batches as they arrive. Null counts are polls without growth. A batch's polls of one kind are in one
    task's memory, so a long backlog should arrive in several batches.
    """
    wait = None if silence is None else int(pd.Timedelta(silence).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        polls_, best, idle, stalled_at, ended = state.get if state.exists else (0, float("-inf"), 0, None, None)
        if state.hasTimedOut:
            ended = ended or "silent"
        else:
            for value in pd.concat(frames).sort_values(order)[count].tolist():
                polls_ += 1
                grew = value is not None and value == value and value > best
                best, idle = (value, 0) if grew else (best, idle + 1)
                if ended is None and target is not None and best >= target:
                    ended = "done"
                if idle >= patience and stalled_at is None:
                    stalled_at = polls_
                    ended = ended or "stalled"
        state.update((polls_, best, idle, stalled_at, ended))
        if wait is not None and ended is None:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame({"kind": [str(key[0])], "polls": [polls_], "best": [best], "idle": [idle], "stalled_at": pd.array([stalled_at], dtype="Int64"), "status": [ended or "growing"]})

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return polls.where(f"`{kind}` IS NOT NULL").groupBy(kind).applyInPandasWithState(step, STATUS, STATE, "update", timeout)
