"""Records of what ran, for how long and with what: nested tasks, stopwatches, progress in the log."""

from __future__ import annotations

import contextvars
import json
import logging
import resource
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("recmill")
_current: contextvars.ContextVar[Task | None] = contextvars.ContextVar("recmill_task", default=None)


class Stopwatch:
    """Seconds of wall clock, with stops between."""

    def __init__(self, start: bool = True):
        self._sum, self._began = 0.0, time.perf_counter() if start else None

    def start(self) -> Stopwatch:
        if self._began is None:
            self._began = time.perf_counter()
        return self

    def stop(self) -> float:
        if self._began is not None:
            self._sum, self._began = self._sum + time.perf_counter() - self._began, None
        return self._sum

    def elapsed(self) -> float:
        return self._sum + (time.perf_counter() - self._began if self._began is not None else 0.0)

    def __str__(self) -> str:
        s = self.elapsed()
        return f"{s * 1000:.0f}ms" if s < 1 else f"{s:.2f}s" if s < 60 else f"{int(s // 60)}m{s % 60:02.0f}s"


class Task:
    """A labelled piece of work, used in a ``with`` block: wall and CPU time of the driver, its peak memory, the Spark
    jobs that ran for it, and its subtasks. With ``file`` the record is written there whenever it changes.

    Leaving the block by an exception marks the task as failed, and cancels its Spark jobs.
    """

    def __init__(self, label: str, spark: SparkSession | None = None, file: str | Path | None = None, **data: Any):
        self.label, self.spark, self.file, self.data = label, spark, Path(file) if file else None, data
        self.id, self.parent, self.subtasks = uuid.uuid4().hex, None, []
        self.status, self.started, self.seconds, self.cpu_seconds, self.peak_mb, self.jobs = "pending", None, None, None, None, 0

    def __enter__(self) -> Task:
        self.parent = _current.get()
        if self.parent is not None:
            self.parent.subtasks.append(self)
            self.spark = self.spark or self.parent.spark
        self._token, self._watch, self._cpu = _current.set(self), Stopwatch(), time.process_time()
        self.status, self.started = "running", time.time()
        self._group(self)
        self._write()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.seconds, self.cpu_seconds = self._watch.stop(), time.process_time() - self._cpu
        self.peak_mb = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        self.status = "finished" if kind is None else "cancelled" if issubclass(kind, KeyboardInterrupt) else "failed"
        if self.spark is not None:
            self.jobs = len(self.spark.sparkContext.statusTracker().getJobIdsForGroup(self.id))
            if kind is not None:
                self.spark.sparkContext.cancelJobGroup(self.id)
        if error is not None:
            self.data["error"] = f"{kind.__name__}: {str(error)[:500]}"
        _current.reset(self._token)
        self._group(self.parent)
        log.info("%s %s in %s", self.label, self.status, self._watch)
        self._write()

    def _group(self, task: Task | None) -> None:
        if self.spark is None:
            return
        if task is None:
            for key in ("spark.jobGroup.id", "spark.job.description"):
                self.spark.sparkContext.setLocalProperty(key, None)
        else:
            self.spark.sparkContext.setJobGroup(task.id, task.label, interruptOnCancel=True)

    def record(self) -> dict:
        """The task and its subtasks as plain values; jobs are those of its own and of all below."""
        below = [t.record() for t in self.subtasks]
        return {"id": self.id, "label": self.label, "status": self.status, "started": self.started, "seconds": self.seconds, "cpu_seconds": self.cpu_seconds, "peak_mb": self.peak_mb, "jobs": self.jobs + sum(t["jobs"] for t in below), "data": self.data, "subtasks": below}

    def _write(self) -> None:
        top = self
        while top.parent is not None:
            top = top.parent
        if top.file is not None:
            top.file.write_text(json.dumps(top.record(), default=str))


def current_task() -> Task | None:
    return _current.get()


class Progress:
    """Counts steps and logs them, at most once in ``every`` seconds."""

    def __init__(self, label: str, total: int | None = None, every: float = 5.0):
        self.label, self.total, self.every, self.done, self._said = label, total, every, 0, 0.0

    def update(self, steps: int = 1, **fields: Any) -> None:
        self.done += steps
        now = time.monotonic()
        if now - self._said >= self.every or self.done == self.total:
            self._said = now
            log.info("%s: %s%s%s", self.label, self.done, f" of {self.total}" if self.total else "", "".join(f", {k}={v}" for k, v in fields.items()))

    def __enter__(self) -> Progress:
        return self

    def __exit__(self, *_) -> None:
        log.info("%s: %s done", self.label, self.done)
