"""Jobs over a workspace: one worker, a queue, pause and cancel, records that outlive the program, checkpoints to go on from."""

from __future__ import annotations

import platform
import queue
import sys
import threading
import time
import traceback
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from quillspark.functions.storage import Files
from quillspark.functions.text import redacted, redacted_text
from quillspark.sources.connectors import Connector, Cursor, selected
from quillspark.sources.files import Crawl

STATES = ("queued", "running", "paused", "done", "failed", "cancelled")
OPEN = ("queued", "running", "paused")


class Cancelled(Exception):
    """A job that was asked to end."""


class Control:
    """How a job is paused and cancelled: it asks between its steps; Spark's work of a cancelled one is stopped."""

    def __init__(self, spark: SparkSession | None = None, group: str = ""):
        self._go, self._end = threading.Event(), threading.Event()
        self._go.set()
        self.spark, self.group = spark, group

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def cancel(self) -> None:
        self._end.set()
        self._go.set()
        if self.spark is not None and self.group:
            self.spark.sparkContext.cancelJobGroup(self.group)

    @property
    def paused(self) -> bool:
        return not self._go.is_set()

    @property
    def cancelled(self) -> bool:
        return self._end.is_set()

    def step(self, timeout: float | None = None) -> None:
        """Waits while paused; ends a cancelled job."""
        self._go.wait(timeout)
        if self._end.is_set():
            raise Cancelled


@dataclass
class Job:
    id: str
    kind: str
    state: str = "queued"
    created: float = 0.0
    ended: float | None = None
    settings: dict = field(default_factory=dict)
    result: dict = field(default_factory=dict)
    error: str | None = None


class Records:
    """Job rows and checkpoints as small files below a workspace."""

    def __init__(self, spark: SparkSession, path: str):
        self.files = Files(spark, f"{path.rstrip('/')}/jobs")

    def save(self, job: Job) -> None:
        self.files.write(f"{job.id}.json", {**asdict(job), "settings": redacted("", job.settings)})

    def all(self) -> list[Job]:
        return [Job(**self.files.read(n)) for n in self.files.names() if n.endswith(".json")]

    def recent(self, limit: int = 20, states: tuple[str, ...] = ()) -> list[Job]:
        """Newest first."""
        rows = [j for j in self.all() if not states or j.state in states]
        return sorted(rows, key=lambda j: (-j.created, j.id))[:limit]

    def resumable(self) -> list[Job]:
        return self.recent(1000, OPEN)

    def save_checkpoint(self, source_id: str, job_id: str, **state) -> None:
        self.files.write(f"checkpoints/{job_id}-{source_id}", state)

    def checkpoint(self, source_id: str, job_id: str) -> dict | None:
        name = f"checkpoints/{job_id}-{source_id}"
        return self.files.read(name) if self.files.exists(name) else None

    def clear_checkpoint(self, source_id: str, job_id: str) -> None:
        self.files.delete(f"checkpoints/{job_id}-{source_id}")


class Runner:
    """Runs jobs one after another in a thread of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.records = spark, Records(spark, path)
        self._queue: queue.Queue = queue.Queue()
        self._controls: dict[str, Control] = {}
        self._thread = threading.Thread(target=self._work, daemon=True)
        self._thread.start()

    def submit(self, kind: str, run: Callable[[Job, Control], dict | None], job: Job | None = None, **settings) -> Job:
        """Queues a job, or one of an earlier program again."""
        job = job or Job(uuid.uuid4().hex[:12], kind, created=time.time(), settings=settings)
        job.state = "queued"
        self._controls[job.id] = Control(self.spark, f"job-{job.id}")
        self.records.save(job)
        self._queue.put((job, run))
        return job

    def control(self, job_id: str) -> Control:
        return self._controls[job_id]

    def pause(self, job: Job) -> None:
        self._controls[job.id].pause()
        if job.state == "running":
            self._state(job, "paused")

    def resume(self, job: Job) -> None:
        self._controls[job.id].resume()
        if job.state == "paused":
            self._state(job, "running")

    def cancel(self, job: Job) -> None:
        self._controls[job.id].cancel()

    def wait(self) -> None:
        self._queue.join()

    def close(self) -> None:
        self._queue.put(None)
        self._thread.join()

    def _state(self, job: Job, state: str) -> None:
        job.state = state
        if state not in OPEN:
            job.ended = time.time()
        self.records.save(job)

    def _work(self) -> None:
        while (entry := self._queue.get()) is not None:
            job, run = entry
            control = self._controls[job.id]
            try:
                control.step()
                self._state(job, "running")
                self.spark.sparkContext.setJobGroup(control.group, job.kind, interruptOnCancel=True)
                job.result = run(job, control) or {}
                self._state(job, "done")
            except Cancelled:
                self._state(job, "cancelled")
            except Exception as e:
                job.error = redacted_text(f"{type(e).__name__}: {e}")
                self._state(job, "cancelled" if control.cancelled else "failed")
                traceback.print_exc(limit=3, file=sys.stderr)
            finally:
                self._queue.task_done()
        self._queue.task_done()


def indexing(workspace, sources: list[dict], wanted: list[str] | None = None, full: bool = False) -> Callable[[Job, Control], dict]:
    """A job that crawls the selected sources; it goes on with those that an interrupted run had not finished."""

    def run(job: Job, control: Control) -> dict:
        records, out = Records(workspace.spark, workspace.path), {}
        for s in selected(sources, wanted):
            done = records.checkpoint(s["source_id"], job.id)
            if done and done.get("finished"):
                out[s["source_id"]] = done["result"]
                continue
            control.step()
            made: Crawl | Connector = s["make"]()
            records.save_checkpoint(s["source_id"], job.id, cursor=asdict(Cursor()), finished=False)
            found = workspace.index(made, full)
            records.save_checkpoint(s["source_id"], job.id, finished=True, result=found)
            out[s["source_id"]] = found
        for s in selected(sources, wanted):
            records.clear_checkpoint(s["source_id"], job.id)
        return out

    return run


def environment(spark: SparkSession) -> dict[str, object]:
    """Facts for diagnostics, without secrets."""
    import pyarrow
    import pyspark

    settings = dict(spark.sparkContext.getConf().getAll())
    return {
        "python": platform.python_version(), "system": platform.system(), "machine": platform.machine(), "spark": spark.version, "pyspark": pyspark.__version__, "arrow": pyarrow.__version__,
        "java": spark._jvm.java.lang.System.getProperty("java.version"), "master": spark.sparkContext.master, "cores": spark.sparkContext.defaultParallelism,
        "settings": {k: redacted(k.rpartition(".")[2], v) for k, v in sorted(settings.items()) if k.startswith("spark.sql") or "memory" in k},
    }
