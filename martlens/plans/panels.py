"""Run dashboard questions side by side, so that one failure stays its own."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from threading import Semaphore
from time import monotonic
from uuid import uuid4

from py4j.protocol import Py4JError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession


#: What a question can raise: errors of Spark, converted or not, and of its own code.
FAILURES = (PySparkException, Py4JError, AttributeError, ValueError, KeyError, TypeError)


@dataclass(frozen=True)
class Panel:
    """The rows of a question, or why there are none."""

    rows: list[Row] = field(default_factory=list)
    error: str | None = None


def run_panels(
    questions: Mapping[str, Callable[[], DataFrame]], seconds: float | None = None, at_once: int = 4
) -> dict[str, Panel]:
    """Answer questions for display side by side, each with all its rows.

    A panel's question bounds its rows: a top-k, the points of a calendar, or
    the groups of a dimension such as states. Whatever fails while a plan is
    built or run, in Python or in the JVM, is that panel's error alone. Each
    panel runs in a thread and a job group of its own; the jobs of one that
    takes longer than ``seconds`` are cancelled, and the others go on.
    """
    spark = SparkSession.getActiveSession()
    panels: dict[str, Panel] = {}
    begun: dict[str, float] = {}
    groups = {name: f"panel-{uuid4().hex}" for name in questions}
    slots = Semaphore(at_once)

    def late(name: str) -> bool:
        return seconds is not None and name in begun and monotonic() - begun[name] > seconds

    def answer(name: str) -> None:
        with slots:
            if spark is not None:
                spark.sparkContext.setJobGroup(groups[name], f"panel {name}", interruptOnCancel=True)
            begun[name] = monotonic()
            try:
                panels[name] = Panel(questions[name]().collect())
            except FAILURES as failure:
                text = f"cancelled after {seconds} seconds" if late(name) else str(failure)
                panels[name] = Panel(error=text)

    threads = {name: InheritableThread(target=answer, args=(name,)) for name in questions}
    for thread in threads.values():
        thread.start()
    while running := [name for name, thread in threads.items() if thread.is_alive()]:
        # Again and again, as a question may begin another job after a cancelled one.
        for name in filter(late, running):
            if spark is not None:
                spark.sparkContext.cancelJobGroup(groups[name])
        threads[running[0]].join(0.1)
    return {name: panels[name] for name in questions}
