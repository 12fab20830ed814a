"""What a running stream tells of itself: its start, each micro-batch, and its end, as rows."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "event string, query_id string, name string, batch long, rows_in long, state_rows long, watermark string, error string"


class Status(StreamingQueryListener):
    """Rows (event, query_id, name, batch, rows_in, state_rows, watermark, error) of the last `kept` events of a session's streams; event is
    "start", "progress", "idle" or "end". told, if there is one, is called with each row as it comes."""

    def __init__(self, kept: int = 10_000, told=None) -> None:
        self.rows: deque = deque(maxlen=kept)
        self.names: dict[str, str | None] = {}
        self.told = told

    def _add(self, *row) -> None:
        self.rows.append(row)
        if self.told is not None:
            self.told(row)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.id)] = event.name
        self._add("start", str(event.id), event.name, None, None, None, None, None)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        state = sum(x.numRowsTotal for x in p.stateOperators)
        self._add("progress", str(p.id), p.name, p.batchId, sum(x.numInputRows for x in p.sources), state, dict(p.eventTime).get("watermark"), None)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._add("idle", str(event.id), self.names.get(str(event.id)), None, None, None, None, None)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._add("end", str(event.id), self.names.pop(str(event.id), None), None, None, None, None, event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), SCHEMA)


def watched(spark: SparkSession, run, kept: int = 10_000):
    """(what run() returns, Status of the streams that ran meanwhile). All events have arrived when it returns."""
    status = Status(kept)
    spark.streams.addListener(status)
    try:
        found = run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(status)
    return found, status
