"""Location log fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.locations import location_append


def start_location_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to the log at ``path``, all that is available.

    Every micro-batch is appended as a batch job does it: an event is new when the
    log does not hold it, however late it comes, and a batch that is delivered again
    adds nothing. Only the days of the batch are read from the log, and the stream
    keeps no state of its own.
    """

    def append(batch: DataFrame, _: int) -> None:
        location_append(batch.sparkSession, path, batch)

    return (
        events.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
