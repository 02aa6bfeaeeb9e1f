"""Jobs of several stages: what is done is skipped, what fails is logged, guards stop a run early."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """One step. ``done`` tells that its output is complete, ``guard`` what is missing to begin (or None).

    A ``tolerant`` stage may fail without ending the run; of all tolerant ones at least one has to succeed.
    """

    name: str
    work: Callable[[], object]
    done: Callable[[], bool] = lambda: False
    guard: Callable[[], str | None] = lambda: None
    tolerant: bool = False


EVENTS = "step int, stage string, state string, detail string"


class StageError(RuntimeError):
    """A run that ended early; ``events`` holds what happened until then."""

    def __init__(self, message: str, events: list[tuple]) -> None:
        super().__init__(message)
        self.events = events


def run_stages(stages: list[Stage]) -> list[tuple[int, str, str, str | None]]:
    """The events ``(step, stage, state, detail)`` of a run; a stage that fails, or a guard, ends it."""
    events: list[tuple[int, str, str, str | None]] = []

    def tell(stage: Stage, state: str, detail: str | None = None) -> None:
        events.append((len(events), stage.name, state, detail))

    for stage in stages:
        if stage.done():
            tell(stage, "skipped")
            continue
        if (missing := stage.guard()) is not None:
            tell(stage, "refused", missing)
            raise StageError(f"{stage.name}: {missing}", events)
        try:
            stage.work()
        except Exception as error:  # noqa: BLE001  any failure is logged; only a tolerant stage may go on
            tell(stage, "failed", f"{type(error).__name__}: {error}")
            if not stage.tolerant:
                raise StageError(f"{stage.name}: {error}", events) from error
        else:
            tell(stage, "done")
    tolerant = {s.name for s in stages if s.tolerant}
    if tolerant and not any(name in tolerant and state in ("done", "skipped") for _, name, state, _ in events):
        raise StageError("no tolerant stage succeeded", events)
    return events


def stage_log(spark: SparkSession, events: list[tuple]) -> DataFrame:
    """A run's events as rows; there are as many as stages."""
    return spark.createDataFrame(events, EVENTS)
