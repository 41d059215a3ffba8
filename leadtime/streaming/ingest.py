"""Streams into the archive: each micro-batch is one idempotent ingest, so replays after a failure change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..archive import Archive


def start_ingest(stream: DataFrame, archive: Archive, checkpoint: str, *, model_id: str, model_version: str, mapping=None, once: bool = False) -> StreamingQuery:
    """Write a stream of forecasts (series_id, origin, target, value) to ``archive``; a run must arrive within one batch.

    Rows of a run that come in another batch are a conflict, as in any other ingest.
    """

    def batch(frame: DataFrame, _: int) -> None:
        if not frame.isEmpty():
            archive.ingest(frame, mapping, model_id=model_id, model_version=model_version)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
