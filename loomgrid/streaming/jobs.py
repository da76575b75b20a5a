"""Background jobs with progress and cancellation, on Spark's job groups."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

RUNNING, DONE, ERROR, CANCELED = "RUNNING", "DONE", "ERROR", "CANCELED"


class Gone(LookupError):
    """The job was cancelled, or nobody knows it."""


class NotReady(RuntimeError):
    """The job has no result, or not yet."""


@dataclass
class Job:
    state: str = RUNNING
    percent: int = 0
    message: str = ""
    result: object = None


class Jobs:
    """Runs functions in the background; each gets a function that reports (percent, message)."""

    def __init__(self, spark: SparkSession, threads: int = 4):
        self.spark, self.pool, self.lock = spark, ThreadPoolExecutor(threads), threading.Lock()
        self.jobs: dict[str, Job] = {}

    def start(self, work: Callable[[Callable[[int, str], None]], object]) -> str:
        name = uuid.uuid4().hex
        job = self.jobs[name] = Job()

        def report(percent: int, message: str = "") -> None:
            with self.lock:
                if job.state == RUNNING:
                    job.percent, job.message = max(0, min(100, percent)), message

        def run() -> None:
            self.spark.sparkContext.setJobGroup(name, "background job", interruptOnCancel=True)
            try:
                state, result, message = DONE, work(report), ""
            except Exception as error:
                state, result, message = ERROR, None, str(error)
            with self.lock:
                if job.state == RUNNING:
                    job.state, job.result, job.message = state, result, message or job.message
                    job.percent = 100 if state == DONE else job.percent

        self.pool.submit(inheritable_thread_target(self.spark)(run))
        return name

    def status(self, name: str) -> Job:
        job = self.jobs.get(name)
        if job is None:
            raise Gone(name)
        if job.state == RUNNING:
            tracker = self.spark.sparkContext.statusTracker()
            stages = [s for j in tracker.getJobIdsForGroup(name) if (info := tracker.getJobInfo(j)) for k in info.stageIds if (s := tracker.getStageInfo(k))]
            total = sum(s.numTasks for s in stages)
            if total and not job.percent:
                return Job(job.state, min(99, 100 * sum(s.numCompletedTasks for s in stages) // total), job.message)
        return job

    def cancel(self, name: str) -> bool:
        """Stops a running job; a finished one stays as it is, an unknown one counts as cancelled."""
        with self.lock:
            job = self.jobs.get(name)
            if job is None:
                return True
            if job.state != RUNNING:
                return job.state == CANCELED
            job.state = CANCELED
        self.spark.sparkContext.cancelJobGroup(name)
        return True

    def result(self, name: str) -> object:
        """The result of a finished job, once: then the job is forgotten."""
        with self.lock:
            job = self.jobs.get(name)
            if job is None or job.state == CANCELED:
                raise Gone(name)
            if job.state != DONE:
                raise NotReady(job.message or job.state)
            return self.jobs.pop(name).result
