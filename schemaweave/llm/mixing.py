"""Mixing of sources to target weights by capped water-filling, DataFrame functions only.

Sources in code point order (null last) get the weights in turn. The mix is as large as all sources together. With
sources sorted by the level at which each reaches its cap of ``max_epochs`` times its size, the level of the water is
the first one that fits under the next cap; it equals clamping and resharing by weight until no source is above.

A source is taken in whole repetitions of all its documents; the words still missing come from one more, fractional
repetition: documents in the order of a seeded hash up to the words left, the last one in part. The place where a
source is cut is found by sums over hash buckets of a few thousand documents, so no task holds a source. Only one
row per source (one per ``BUCKET_ROWS`` documents in the prefix sums) is ordered in one task.

Defined results: a null or blank text has size 0 and is taken 0 times; a source of size 0 has target 0; rows that
repeat a doc_id share their hash and, at a cut, the words left in proportion; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stash, unused

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 4096
BROADCAST_SOURCES = 100_000
SPAN = float(2**52)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_levels(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """source, source_size, n, target from one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy("full_at", "rank")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    table = F.array(*[F.lit(int(w)) for w in weights])
    return (
        sources.withColumn("rank", F.row_number().over(order))
        .withColumn("weight", F.element_at(table, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(int(max_epochs)))
        .withColumn("full_at", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
        .withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("full_at", "rank", "level"))).over(every)["level"])
        .withColumn("target", F.least(F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight"), F.col("cap").cast("double")))
        .select("source", "source_size", "n", "target")
    )


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """Adds size__, name__ and draw__, the seeded place of a document in its source."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("long")
    return docs.withColumns({"size__": n_words(F.col("text")), "name__": name, "draw__": draw, "source__": F.col("source").cast("string")})


def _with_source(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    right = right.withColumnRenamed("source__", "source_")
    return left.join(F.broadcast(right) if few else right, F.col("source__").eqNullSafe(F.col("source_")), "inner").drop("source_")


def plan_mix(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> tuple[DataFrame, bool]:
    """One row per source: its target, whole repetitions and where the fractional one ends; whether these rows are few."""
    sources = sized.groupBy(F.col("source__").alias("source")).agg(F.sum("size__").alias("source_size"), F.count("*").alias("n"))
    levels = stash(
        water_levels(sources, weights, max_epochs)
        .withColumnRenamed("source", "source__")
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("missing", F.greatest(F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"), F.lit(0)))
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS).cast("long")),
        "levels",
    )
    few = levels.count() <= BROADCAST_SOURCES
    bucket = F.least(F.floor(F.col("draw__") / F.lit(SPAN) * F.col("buckets")).cast("long"), F.col("buckets") - 1)
    dealt = _with_source(sized, levels.select("source__", "missing", "buckets").where("missing > 0"), few).withColumn("bucket", bucket)
    running = Window.partitionBy("source__").orderBy("bucket")
    cuts = (
        dealt.groupBy("source__", "bucket", "missing").agg(F.sum("size__").alias("words"))
        .withColumn("upto", F.sum("words").over(running))
        .where((F.col("upto") >= F.col("missing")) & (F.col("upto") - F.col("words") < F.col("missing")))
        .select("source__", F.col("bucket").alias("cut_bucket"), (F.col("missing") - F.col("upto") + F.col("words")).alias("wanted"))
    )
    inside = _with_source(dealt, cuts, few).where("bucket = cut_bucket").groupBy("source__", "draw__", "name__", "wanted").agg(F.sum("size__").alias("words"))
    exact = Window.partitionBy("source__").orderBy("draw__", "name__")
    edge = (
        inside.withColumn("upto", F.sum("words").over(exact))
        .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("words") < F.col("wanted")))
        .select(F.col("source__").alias("source_"), F.struct("draw__", "name__").alias("edge"), (F.col("wanted") - F.col("upto") + F.col("words")).alias("edge_left"), F.col("words").alias("edge_words"))
    )
    plan = levels.join(edge, F.col("source__").eqNullSafe(F.col("source_")), "left").drop("source_", "n", "buckets", "missing")
    return stash(plan, "mix-plan"), few


def _taken(sized: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Adds source_size, target and taken to sized rows."""
    at = F.struct("draw__", "name__")
    more = F.when(F.col("edge").isNull(), F.lit(0)).when(at < F.col("edge"), F.col("size__")).when(at == F.col("edge"), F.expr("size__ * edge_left div edge_words")).otherwise(F.lit(0))
    return _with_source(sized, plan, few).withColumn("taken", (F.col("whole") * F.col("size__") + more).cast("long")).drop("whole", "edge", "edge_left", "edge_words")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words of each row that the mix takes."""
    sized = stash(_sized(docs, seed).select("doc_id", "size__", "name__", "draw__", "source__"), "sized")
    rows = _taken(sized, *plan_mix(sized, weights, max_epochs))
    return rows.select("doc_id", F.col("source__").alias("source"), F.col("size__").alias("size"), "source_size", "target", "taken")


def repeat(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns; the one fraction of a source is rounded to a whole row."""
    # the columns wait in a struct, so that none of them clashes with a name in the plan
    (own,) = unused(docs, "own_columns")
    rows = _sized(docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own)), seed).drop("doc_id", "text", "source")
    plan, few = plan_mix(stash(rows.drop(own), "sized"), weights, max_epochs)
    times = F.when(F.col("size__") > 0, F.round(F.col("taken") / F.col("size__")).cast("int")).otherwise(0)
    return _taken(rows, plan, few).withColumn("copy__", F.explode(F.array_repeat(F.lit(0), times))).select(f"{own}.*")
