"""What a long index run tells while it works: its steps, the tasks of the jobs under way, and a summary."""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

EVERY_S = 15.0


class Progress:
    """A line a step and one every ``every_s`` seconds. A run is set-based, so progress is that of its steps' tasks."""

    def __init__(self, spark: SparkSession, say: Callable[[str], None] | None = None, every_s: float = EVERY_S, clock: Callable[[], float] = time.monotonic):
        self.tracker, self.every_s, self.clock = spark.sparkContext.statusTracker(), every_s, clock
        self.say = say or (lambda line: print(line, file=sys.stderr, flush=True))
        self.sessions, self.name, self.began, self.step_began, self.over = 0, "", 0.0, 0.0, threading.Event()

    def start(self, sessions: int, waiting: int) -> None:
        self.sessions, self.began = sessions, self.clock()
        self.over.clear()
        self.say(f"index: {sessions} sessions, {waiting} to index")
        threading.Thread(target=self._tick, daemon=True).start()

    def _tick(self) -> None:
        while not self.over.wait(self.every_s):
            self.say(self.line())

    def line(self) -> str:
        """The step under way: tasks done of those known, time so far, and the time left if tasks go on like this."""
        infos = [i for s in self.tracker.getActiveStageIds() if (i := self.tracker.getStageInfo(s)) is not None]
        done, tasks, spent = sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos), self.clock() - self.step_began
        left = f", about {spent * (tasks - done) / done:.0f} s left" if done else ""
        return f"index: {self.name}, {done} of {tasks} tasks, {spent:.0f} s{left}"

    def step(self, name: str) -> None:
        self.name, self.step_began = name, self.clock()
        self.say(f"index: {name}, after {self.step_began - self.began:.0f} s")

    def finish(self, stats) -> None:
        self.over.set()
        spent = max(self.clock() - self.began, 1e-3)
        self.say(f"index: {stats.indexed} indexed, {stats.skipped} skipped, {stats.failed} failed, {stats.chunks} chunks, {stats.embedded} embedded, {stats.pending} pending in {spent:.0f} s, {(stats.indexed + stats.failed) / spent:.1f} sessions a second")
