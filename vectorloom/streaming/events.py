"""Progress of running streams and jobs, as rows a caller can poll."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Keeps the most recent events of every query."""

    def __init__(self, keep: int = 1000):
        self._events: deque = deque(maxlen=keep)
        self._lock = threading.Lock()

    def _note(self, kind: str, run, **facts) -> None:
        with self._lock:
            self._events.append({"event": kind, "run": str(run), **facts})

    def onQueryStarted(self, event) -> None:
        self._note("started", event.runId, name=event.name)

    def onQueryProgress(self, event) -> None:
        self._note("progress", event.progress.runId, batch=event.progress.batchId, rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._note("idle", event.runId)

    def onQueryTerminated(self, event) -> None:
        self._note("finished", event.runId, error=event.exception)

    def events(self) -> list[dict]:
        with self._lock:
            return list(self._events)


def watch(spark: SparkSession) -> ProgressLog:
    log = ProgressLog()
    spark.streams.addListener(log)
    return log
