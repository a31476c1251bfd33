"""Work for tenants: bounded parallelism with a time limit, reindex jobs, and what happens when a tenant comes or goes."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from marlstone.functions.vector import Embedders
from marlstone.operators import corpus, index
from marlstone.operators.corpus import ReindexJob

# Tasks of a tenant that run at once, seconds a task may take, and seconds to wait for a new tenant's files.
PARALLEL, TASK_SECONDS, WAIT_SECONDS = 3, 120, 30


class Busy(RuntimeError):
    """A scan of the tenant is under way."""


class Pool:
    """Runs a tenant's tasks, ``parallel`` at once. The Spark jobs of a task that takes longer than ``seconds`` are cancelled, and the
    task counts as failed; the others go on."""

    def __init__(self, spark: SparkSession, parallel: int = PARALLEL, seconds: float = TASK_SECONDS):
        self.spark, self.seconds = spark, seconds
        self.pool = ThreadPoolExecutor(parallel)
        self._open: set = set()

    def _run(self, task: Callable[[], object], tag: str, began: threading.Event):
        context = self.spark.sparkContext
        context.addJobTag(tag)
        began.set()
        try:
            return task()
        finally:
            context.removeJobTag(tag)

    def map(self, tasks: list[Callable[[], object]]) -> list[tuple[object, BaseException | None]]:
        """(result, error) of every task, in order."""
        running = []
        for task in tasks:
            tag, began = f"task-{uuid.uuid4().hex}", threading.Event()
            future = self.pool.submit(inheritable_thread_target(self.spark)(self._run), task, tag, began)
            self._open.add(future)
            running.append((future, tag, began))
        out = []
        for future, tag, began in running:
            try:
                while not (began.is_set() or future.done()):
                    time.sleep(0.01)  # a task's time begins when it runs
                out.append((future.result(self.seconds), None))
            except Late as e:
                self.spark.sparkContext.cancelJobsWithTag(tag)
                out.append((None, TimeoutError(f"task took more than {self.seconds} seconds") if not future.done() else e))
            except Exception as e:
                out.append((None, e))
            self._open.discard(future)
        return out

    def drain(self) -> None:
        """Wait for what runs; nothing new is taken."""
        self.pool.shutdown(wait=True)


class ReindexJobs:
    """Jobs by id. A full reindex drops what the tenant has in index and state and starts its scan again; while a scan runs it is
    refused. Path and folder jobs work on the state rows of their scope."""

    def __init__(self) -> None:
        self._jobs: dict[str, ReindexJob] = {}
        self._scanning: set[str] = set()
        self._lock = threading.Lock()

    def scan(self, user_id: str, work: Callable[[], object]) -> object:
        """Run a scan of the tenant; one at a time."""
        with self._lock:
            if user_id in self._scanning:
                raise Busy(user_id)
            self._scanning.add(user_id)
        try:
            return work()
        finally:
            with self._lock:
                self._scanning.discard(user_id)

    def create(self, state: DataFrame, user_id: str, scope: str, target: str | None, process: Callable[[DataFrame], int], purge: Callable[[str], None] | None = None) -> ReindexJob:
        """Run a job and keep it. ``purge`` drops the tenant's rows of index and state, for a full one."""

        def run() -> ReindexJob:
            if scope == "full" and purge is not None:
                purge(user_id)
            return corpus.reindex(state, user_id, scope, target, process)

        job = self.scan(user_id, run) if scope == "full" else run()
        self._jobs[job.id] = job
        return job

    def get(self, job_id: str) -> ReindexJob | None:
        return self._jobs.get(job_id)

    def rows(self, spark: SparkSession) -> DataFrame:
        """Jobs as a table: id, scope, target, status, counts and times."""
        kind = "id string, scope string, target string, status string, files_processed long, total_files long, errors array<string>, started_at string, completed_at string"
        return spark.createDataFrame([(j.id, j.scope, j.target, j.status, j.files_processed, j.total_files, j.errors, j.started_at, j.completed_at) for j in self._jobs.values()], kind)


@dataclass
class Tenants:
    """Tenants that are served: added ones get an embedder and a pool and are scanned once their files are there; removed ones finish
    what runs, and their rows leave index and state."""

    spark: SparkSession
    embedders: Embedders
    scan: Callable[[str], object]
    jobs: ReindexJobs = field(default_factory=ReindexJobs)
    pools: dict[str, Pool] = field(default_factory=dict)

    def added(self, user_id: str, model: str, key: str, ready: Callable[[], bool], wait: float = WAIT_SECONDS, pause: float = 0.5) -> bool:
        """Whether the tenant's files appeared in time and were scanned."""
        self.embedders.of(user_id, model, key)
        self.pools[user_id] = Pool(self.spark)
        end = time.monotonic() + wait
        while not ready():
            if time.monotonic() >= end:
                return False
            time.sleep(pause)
        self.jobs.scan(user_id, lambda: self.scan(user_id))
        return True

    def removed(self, user_id: str, *tables: DataFrame) -> list[DataFrame]:
        """The tables (index, state) without the tenant's rows."""
        pool = self.pools.pop(user_id, None)
        if pool is not None:
            pool.drain()
        self.embedders.drop(user_id)
        return [index.purge_tenant(t, user_id) for t in tables]
