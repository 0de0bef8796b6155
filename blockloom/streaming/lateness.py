"""What streams drop as too late, and how far they lag, kept as a table."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..files import Files

DROPPED = "stream string, batch long, at timestamp, rows_in long, dropped long, watermark timestamp, newest timestamp, lag_s double"


def _seconds(text: str) -> float:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp()


class LateRows(StreamingQueryListener):
    """Writes a line for each batch of the session's streams that has seen event times: what its stateful operators have dropped behind the watermark, and the lag of its newest row.

    An aggregation drops groups, which it has summed by task before: rows of one
    window and key that come together count as one. Lines of a batch are one
    file under the batch's name, so a batch that runs again writes none twice.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.folder = Files(spark), folder.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.eventTime:
            return
        newest = p.eventTime.get("max")
        line = {
            "stream": str(p.id), "batch": p.batchId, "at": p.timestamp, "rows_in": p.numInputRows, "dropped": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            "watermark": p.eventTime.get("watermark"), "newest": newest, "lag_s": _seconds(p.timestamp) - _seconds(newest) if newest else None,
        }
        self.files.put_new(f"{self.folder}/{p.id}-{p.batchId:012d}.json", json.dumps(line) + "\n")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that ``LateRows`` has written, a row a batch."""
    if not Files(spark).glob(f"{folder.rstrip('/')}/*.json"):
        return spark.createDataFrame([], DROPPED)
    return spark.read.schema(DROPPED).json(folder)
