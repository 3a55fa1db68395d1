"""Any DataFrame (Parquet, JSON, tables) as rows of text cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Limits, SourceStructure
from .base import Rows, columns_of, number_rows


def as_text(column: Column, kind: T.DataType, scale: int = 2) -> Column:
    """A cell's text: dates in ISO form, fractions with a fixed scale."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.cast(f"decimal(38,{scale})").cast("string")
    return column.cast("string")


def from_frame(frame: DataFrame, order: str | None = None, names: list[str] | None = None, scale: int = 2, limits: Limits = Limits()) -> Rows:
    """Rows of a DataFrame; ``order`` names a unique integer column that serves as the record number."""
    names = names or [c for c in frame.columns if c != order]
    columns, warnings = columns_of(names, limits)
    cells = [F.coalesce(as_text(F.col(f"`{n}`"), frame.schema[n].dataType, scale), F.lit("")).alias(f"c{k}") for k, n in enumerate(names)]
    if order:
        rows = frame.select(F.col(order).cast("long").alias("record_number"), F.lit(None).cast("long").alias("physical_line"), *cells)
    else:
        rows = number_rows(frame.select(*cells)).select("record_number", F.lit(None).cast("long").alias("physical_line"), *[f"c{k}" for k in range(len(names))])
    return Rows(rows, SourceStructure("frame", columns, True, warnings=tuple(warnings)))
