"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of the normalised text. New documents are
reduced to one row per digest, anti-joined to the index by sort-merge (the index side is not shuffled; its buckets are
sorted again, as a bucket has one sorted file for each batch) and the remaining digests are appended. A new index gets so
many buckets that its first batch has about ``BUCKET_ROWS`` digests in each. Hot groups of copies never meet in one task:
groups are counted in two steps over (digest, salt) and joined back to the documents on the same pair.

Defined results: a null text counts as empty and empty texts equal each other; a null doc_id (or one that is no whole
number) sorts after all others; of rows that repeat doc_id and text exactly one stays, the one whose columns have the
smallest hash; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path, on_clean, shuffle_partitions, stash, unused

SPACES = r"[\x20\x09-\x0D]+"
BROADCAST_KEYS = 1_000_000
BUCKETS, BUCKET_ROWS = 64, 4_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def whole_id() -> Column:
    """The doc_id as an integer; null where it is none."""
    return F.col("doc_id").try_cast("long")


def row_key() -> Column:
    """A hash of doc_id and raw text; with the doc_id beside it, it stands for a row."""
    return F.xxhash64(whole_id(), F.col("text").cast("string"))


class DigestIndex:
    """A persistent set of digests with the document that stands for each; reopened by its path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digests_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        rows = groups.select("digest", "keep_id", F.lit(batch).alias("batch"))
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, keep_id, group_size (rows of this batch), kept, text_sha256.

    A text that the index already has keeps the index's document; its rows here are all dropped. Unseen digests are
    appended to the index under ``batch``.
    """
    spark = docs.sparkSession
    batch = batch or uuid.uuid4().hex
    digests = stash(
        docs.select(whole_id().alias("doc_id"), row_key().alias("row_key"), F.monotonically_increasing_id().alias("row_id"), F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest")),
        "digests",
    ).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(shuffle_partitions(spark))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    parts = digests.groupBy("digest", "salt").agg(first.alias("first"), F.count("*").alias("n"))
    groups = stash(
        parts.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("group_size")).select("digest", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row_id").alias("keep_row")),
        "digest-groups",
    )
    if index is None:
        index = DigestIndex(spark, new_path(spark, "digest-index"), max(BUCKETS, groups.count() // BUCKET_ROWS))
        on_clean(spark, f"DROP TABLE IF EXISTS {index.table}")
    index.append(index.unseen(groups), batch)
    known = groups.drop("keep_id").join(index.rows().hint("merge"), "digest").withColumn("keep_row", F.when(F.col("batch") == batch, F.col("keep_row")))
    salted = parts.select("digest", "salt").join(known.drop("batch"), "digest")
    return digests.join(salted, ["digest", "salt"]).select(
        "doc_id",
        "row_key",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Texts are shuffled only where the dropped rows are too many to broadcast."""
    row, own = unused(docs, "row_key", "own_id")
    rows = deduplicate(docs, index).select(F.col("row_key").alias(row), F.col("doc_id").alias(own), "kept")
    gone = stash(rows.groupBy(row, own).agg(F.count_if("kept").alias("stay"), F.count("*").alias("n")).where("n > stay"), "gone")
    n = gone.count()
    if not n:
        return docs
    named = docs.withColumns({row: row_key(), own: whole_id()})

    def joined(some: DataFrame, how: str) -> DataFrame:
        some = some.select(row, own)
        same = [named[row] == some[row], named[own].eqNullSafe(some[own])]
        return named.join(F.broadcast(some) if n <= BROADCAST_KEYS else some, same, how)

    left = joined(gone, "left_anti")
    repeated = gone.where("stay > 0")
    if repeated.limit(1).count():  # rows repeated as a whole, of which one stays
        columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = joined(repeated, "left_semi").groupBy(row, own).agg(F.min_by(columns, F.xxhash64(F.to_json(columns))).alias("r"))
        left = left.unionByName(one.select("r.*", row, own))
    return left.drop(row, own)
