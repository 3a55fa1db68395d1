"""An extension: rows that arrive as a stream are checked against a confirmed layout in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.detectors import Detector
from ..model import EngineConfig, SourceColumn
from ..operators.profile import ColumnProfile, profile


def guard_stream(stream: DataFrame, columns: tuple[SourceColumn, ...], detectors: tuple[Detector, ...], config: EngineConfig, report: Callable[[int, list[ColumnProfile]], None], checkpoint: str) -> StreamingQuery:
    """Profiles every micro-batch (record_number and text columns) and hands the profiles to ``report``."""

    def check(batch: DataFrame, number: int) -> None:
        report(number, profile(batch, columns, detectors, config, locations=False))

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
