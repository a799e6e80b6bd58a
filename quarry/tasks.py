"""Task control: named work that can be watched and cancelled, on Spark's job groups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Progress:
    """Jobs of a task and the Spark tasks of their stages."""

    jobs: int
    running: int
    failed: int
    tasks: int
    done: int


@contextmanager
def task(spark: SparkSession, name: str, about: str = "") -> Iterator[None]:
    """What this thread runs within it belongs to the task ``name``."""
    sc = spark.sparkContext
    keys = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = {k: sc.getLocalProperty(k) for k in keys}
    sc.setJobGroup(name, about or name, interruptOnCancel=True)
    try:
        yield
    finally:
        for k, v in before.items():
            sc.setLocalProperty(k, v)


def cancel(spark: SparkSession, name: str) -> None:
    """Ends the task's running jobs; who waits for them gets an error."""
    spark.sparkContext.cancelJobGroup(name)


def progress(spark: SparkSession, name: str) -> Progress:
    """How far the jobs of a task have come, as far as the session still remembers them."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(name)) if j]
    stages = [s for s in (tracker.getStageInfo(i) for j in jobs for i in j.stageIds) if s]
    status = [j.status for j in jobs]
    return Progress(len(jobs), status.count("RUNNING"), status.count("FAILED"), sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages))
