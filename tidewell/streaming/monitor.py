"""Watching running streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Monitor(StreamingQueryListener):
    """Reports batches that take in more rows than they finish with in time, and queries that end with an error.

    tell is called with a kind ("behind" or "failed"), the query's name or id, and the facts. Nothing is dropped when a
    stream falls behind: its source hands out less a batch.
    """

    def __init__(self, tell: Callable[[str, str, dict], None], batches: int = 3) -> None:
        self.tell, self.batches = tell, batches
        self._slow: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self._slow[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        slow = p.inputRowsPerSecond > p.processedRowsPerSecond > 0
        run = str(p.runId)
        self._slow[run] = self._slow.get(run, 0) + 1 if slow else 0
        if self._slow[run] == self.batches:
            self.tell("behind", p.name or str(p.id), {"in": p.inputRowsPerSecond, "done": p.processedRowsPerSecond, "batch": p.batchId})

    def onQueryIdle(self, event) -> None:
        self._slow[str(event.runId)] = 0

    def onQueryTerminated(self, event) -> None:
        self._slow.pop(str(event.runId), None)
        if event.exception:
            self.tell("failed", str(event.id), {"error": event.exception[:500]})
