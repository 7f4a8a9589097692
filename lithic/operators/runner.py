"""Plug-ins of a run: materializers by task, progress callbacks, work in a process of its own with a time limit."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame

Materializer = Callable[[DataFrame], DataFrame]
Progress = Callable[[int, int, str], None]


class Materializers:
    """Rows of tasks by name; a task is registered once."""

    def __init__(self):
        self._by_task: dict[str, Materializer] = {}

    def register(self, task: str) -> Callable[[Materializer], Materializer]:
        def add(f: Materializer) -> Materializer:
            if task in self._by_task:
                raise ValueError(f"{task} is registered already")
            self._by_task[task] = f
            return f

        return add

    def rows(self, records: DataFrame, tasks: Iterable[str], progress: Progress | None = None) -> DataFrame:
        """Rows of the tasks, in one plan; an unknown task raises before anything runs."""
        tasks = list(tasks)
        if unknown := sorted(set(tasks) - set(self._by_task)):
            raise ValueError(f"unknown task: {', '.join(unknown)}")
        out = None
        for k, task in enumerate(tasks, 1):
            part = self._by_task[task](records)
            out = part if out is None else out.unionByName(part)
            if progress:
                progress(k, len(tasks), task)
        if out is None:
            raise ValueError("no task is named")
        return out


def _run(pipe, f: Callable[..., Any], args: tuple) -> None:
    try:
        pipe.send((True, f(*args)))
    except Exception as e:  # the parent gets it as a reason
        pipe.send((False, f"{type(e).__name__}: {e}"))


def isolated(f: Callable[..., Any], *args: Any, seconds: float) -> tuple[bool, Any]:
    """(True, result) of f(*args) in a new process, or (False, reason): its error, a lost process, or 'timeout'."""
    ours, theirs = multiprocessing.get_context("spawn").Pipe()
    worker = multiprocessing.get_context("spawn").Process(target=_run, args=(theirs, f, args), daemon=True)
    worker.start()
    theirs.close()
    try:
        return ours.recv() if ours.poll(seconds) else (False, "timeout")
    except EOFError:
        return False, "worker lost"
    finally:
        worker.kill()
        worker.join()
