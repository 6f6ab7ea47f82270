"""Queries in the background: progress, cancelling, and the result when it is there.

Each job runs under a tag of its own, so that cancelling stops its Spark jobs and no others.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


class Job:
    """A query that runs in a thread; its rows are written to `path` as Parquet."""

    def __init__(self, spark: SparkSession, build: Callable[[SparkSession], DataFrame], path: str):
        self.spark, self.build, self.path = spark, build, path
        self.tag, self.state, self.error = f"job-{uuid.uuid4().hex}", "running", None
        self._cancelled = threading.Event()
        self._thread = InheritableThread(target=self._run)
        self._thread.start()

    def _run(self) -> None:
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            rows = self.build(self.spark)
            if not self._cancelled.is_set():
                rows.write.mode("overwrite").parquet(self.path)
                self.state = "done"
        except Exception as error:
            self.error = error
            self.state = "failed"
        finally:
            if self._cancelled.is_set():
                self.state = "cancelled"
            context.removeJobTag(self.tag)

    def progress(self) -> tuple[int, int]:
        """Tasks done and known of so far, over the session's running stages."""
        tracker = self.spark.sparkContext.statusTracker()
        done = known = 0
        for stage in tracker.getActiveStageIds():
            info = tracker.getStageInfo(stage)
            if info:
                done, known = done + info.numCompletedTasks, known + info.numTasks
        return done, known

    def cancel(self) -> None:
        """Stop before the next step, and the Spark jobs that run."""
        self._cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def result(self, timeout: float | None = None) -> DataFrame | None:
        """The written rows; None while it runs or if it was cancelled. A failure is raised here."""
        self._thread.join(timeout)
        if self.state == "failed":
            raise self.error
        return self.spark.read.parquet(self.path) if self.state == "done" else None
