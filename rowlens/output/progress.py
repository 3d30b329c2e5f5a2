"""Progress of a comparison: tasks done and known of the running stages, told to a callback while it goes on."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable

from pyspark.sql import SparkSession


class Progress:
    """Calls ``tell(done, known)`` about twice a second from a thread of its own, where either number has changed."""

    def __init__(self, spark: SparkSession, tell: Callable[[int, int], None], every: float = 0.5):
        self.tracker, self.tell, self.every = spark.sparkContext.statusTracker(), tell, every
        self.over, self.last = threading.Event(), (-1, -1)
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def __enter__(self) -> Progress:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()

    def _watch(self) -> None:
        while not self.over.wait(self.every):
            stages = [s for i in self.tracker.getActiveStageIds() if (s := self.tracker.getStageInfo(i))]
            now = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
            if stages and now != self.last:
                self.last = now
                self.tell(*now)


def on_terminal(done: int, known: int) -> None:
    sys.stderr.write(f"\r{done} of {known} tasks\x1b[K")
    sys.stderr.flush()
