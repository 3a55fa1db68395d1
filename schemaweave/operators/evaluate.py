"""Quality of suggestions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARGIN, COVERAGE, AUTO = 0.15, 0.60, 0.90


def judged(labels: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Labels with what was suggested.

    labels: dataset, column_id, expected (null: no match), expected_semantic, abstain. suggestions: dataset, column_id,
    top (targets by rank), decided (null: none), score, margin, coverage, semantic, eligible.
    """
    rows = labels.join(suggestions, ["dataset", "column_id"], "left")
    auto = (F.col("score") >= AUTO) & (F.col("margin") >= MARGIN) & (F.col("coverage") >= COVERAGE) & F.coalesce(F.col("eligible"), F.lit(False))
    return rows.withColumns(
        {
            "top1": F.coalesce(F.get("top", F.lit(0)) == F.col("expected"), F.lit(False)),
            "top3": F.coalesce(F.array_contains(F.slice("top", 1, 3), F.col("expected")), F.lit(False)),
            "auto": F.coalesce(auto, F.lit(False)),
            "none": F.col("decided").isNull(),
        }
    )


def quality(rows: DataFrame) -> DataFrame:
    """All counts and rates in one row."""
    mappable, auto = F.col("expected").isNotNull(), F.col("auto")
    right = auto & F.col("top1")
    n = lambda c, a: F.count_if(c).alias(a)
    rate = lambda a, b: F.try_divide(F.count_if(a), F.count_if(b))
    return rows.agg(
        n(mappable, "mappable"),
        n(mappable & F.col("top1"), "top1"),
        n(mappable & F.col("top3"), "top3"),
        n(auto, "auto_mapped"),
        n(right, "auto_right"),
        rate(right, auto).alias("auto_precision"),
        rate(auto & ~F.col("top1"), ~mappable | ~F.col("top1")).alias("auto_false_rate"),
        n(F.col("abstain"), "abstain"),
        n(F.col("abstain") & ~auto, "abstained"),
        n(~mappable, "no_match"),
        n(~mappable & F.col("none"), "no_match_right"),
        rate(~auto & ~F.col("none"), F.lit(True)).alias("review_rate"),
    )


def confusion(rows: DataFrame) -> DataFrame:
    """expected_semantic, semantic, n; UNKNOWN for none."""
    name = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "UNKNOWN").otherwise(F.col(c))
    return rows.groupBy(name("expected_semantic").alias("expected_semantic"), name("semantic").alias("semantic")).agg(F.count("*").alias("n"))


def failures(rows: DataFrame) -> DataFrame:
    wrong: Column = F.when(F.col("expected").isNotNull(), ~F.col("top1")).otherwise(~F.col("none"))
    return rows.where(wrong).select("dataset", "column_id", "expected", F.get("top", F.lit(0)).alias("suggested"))
