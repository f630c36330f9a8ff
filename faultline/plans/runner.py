"""Jobs side by side: results as they finish, a time limit each, and one stop for all."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import Any, NamedTuple

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class StopAll(Exception):
    """Raised by a job after which no other one may run."""


class Outcome(NamedTuple):
    key: Any
    value: Any
    error: BaseException | None
    seconds: float

    @property
    def successful(self) -> bool:
        return self.error is None


def run(spark: SparkSession, jobs: Iterable[tuple[Any, Callable[[], Any]]], threads: int = 4, limit: float | None = None, each: Callable[[Outcome], None] | None = None) -> Iterator[Outcome]:
    """Outcomes of jobs (key, function) in the order in which they finish.

    Each job has a job group, so one that takes more than limit seconds is cancelled
    and counts as failed. StopAll cancels what runs and what waits.
    """
    context, stop, groups = spark.sparkContext, threading.Event(), {}

    def work(key: Any, job: Callable[[], Any]) -> Outcome:
        box: dict[str, Any] = {}
        if stop.is_set():
            return Outcome(key, None, StopAll("stopped before it began"), 0.0)
        group, began = f"{key}-{uuid.uuid4().hex[:8]}", time.monotonic()
        groups[key] = group

        def inner() -> None:
            context.setJobGroup(group, str(key), interruptOnCancel=True)
            try:
                box["value"] = job()
            except BaseException as e:  # noqa: BLE001
                box["error"] = e

        thread = InheritableThread(target=inner, name=f"job-{key}", daemon=True)
        thread.start()
        thread.join(limit)
        if thread.is_alive():
            context.cancelJobGroup(group)
            box.setdefault("error", TimeoutError(f"{key} took more than {limit} s"))
        groups.pop(key, None)
        return Outcome(key, box.get("value"), box.get("error"), time.monotonic() - began)

    with ThreadPoolExecutor(threads, thread_name_prefix="runner") as pool:
        open_: set[Future] = {pool.submit(work, key, job) for key, job in jobs}
        while open_:
            done, open_ = wait(open_, return_when=FIRST_COMPLETED)
            for future in done:
                outcome = future.result()
                if isinstance(outcome.error, StopAll) and not stop.is_set():
                    stop.set()
                    for group in list(groups.values()):
                        context.cancelJobGroup(group)
                if each:
                    each(outcome)
                yield outcome
