"""Exact deduplication against a persistent digest index.

The index is a Parquet table in shared storage, bucketed and sorted by the
SHA-256 digest of the normalised text (A-Z lower-cased, null as empty). A load is
reduced to one candidate per digest (largest id; counts are combined map-side,
so copies never gather), anti-joined with the index on the digest - a sort-merge
join that reads the index without a shuffle - and the new digests are appended.

``dedup`` runs the loads over digests computed once from the texts. Ids are
loaded from the upper half down, so the largest id of equal texts is the one
that enters the index.

A digest that holds more than a HOT-th of all rows meets its group by broadcast (at
most HOT such groups can exist); the copies of all others fit a task.

Edge cases: null and empty texts are equal; of rows with the same id and equal
text one row stays; null ids lose against any id; an empty table leaves an empty
index; texts that differ only outside A-Z case are different; against an index held
from earlier loads the row that stays is the index's, so its id may be the smaller one.
Ids are numbers. Input columns of any name are kept as they are.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, keep_rows, one_row_per_copy, row_hash, shared_path, stored, text_of

INDEX_BUCKETS = 64
HOT = 10_000


def digest(docs: DataFrame):
    return F.unhex(F.sha2(ascii_lower(text_of(docs)).cast("binary"), 256))


class DigestIndex:
    """Digests of all texts kept so far: (digest, doc_id, th). ``path`` may hold an
    earlier index with the same number of buckets; it is then continued."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = INDEX_BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or shared_path(spark, "digest-index")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, doc_id BIGINT, th BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, load: DataFrame) -> None:
        """``load``: rows (digest, doc_id, th). Digests not yet in the index enter
        with the largest id of the load (ties: the larger ``th``)."""
        best = load.groupBy("digest").agg(F.max(F.struct("doc_id", "th")).alias("b"))
        fresh = (best.select("digest", "b.doc_id", "b.th").hint("merge")
                 .join(self.entries().select("digest"), "digest", "left_anti"))
        (fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forget the table name; the files at ``path`` stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def index_loads(digests: DataFrame, index: DigestIndex, loads: int = 2) -> None:
    """Append ``digests`` in ``loads`` ranges of doc_id, the highest ids first;
    rows without an id come last."""
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        index.append(digests)
        return
    step = max(1, -(-(high - low + 1) // loads))
    for i in range(loads - 1, -1, -1):
        start = low + i * step
        part = F.col("doc_id").between(start, start + step - 1)
        index.append(digests.filter((part | F.col("doc_id").isNull()) if i == 0 else part))


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    digests = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                 F.xxhash64(text_of(docs)).alias("th"), digest(docs).alias("digest")), "digests")
    index = index or DigestIndex(spark)
    index_loads(digests, index)
    kept = stored(index.entries(), "digest-entries")
    index.close()
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = kept.join(sizes, "digest").select("digest", F.col("doc_id").alias("keep_id"), "group_size")
    rows = digests.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "digest-groups")
    least = groups.agg((F.coalesce(F.sum("group_size"), F.lit(0)) / HOT).alias("least")).first()["least"]
    large = F.broadcast(groups.filter(F.col("group_size") > least))  # at most HOT rows
    joined = (rows.join(large, "digest").unionByName(
        rows.join(large.select("digest"), "digest", "left_anti").join(groups.filter(F.col("group_size") <= least), "digest")))
    copies = one_row_per_copy(joined, "n", "copy")
    return copies.select("doc_id", "keep_id", "group_size",
                         (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents whose text entered the index, one row each, all columns."""
    spark = docs.sparkSession
    digests = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                 row_hash(docs).alias("th"), digest(docs).alias("digest")), "digests")
    index = index or DigestIndex(spark)
    index_loads(digests, index)
    kept = stored(index.entries(), "digest-entries")
    index.close()
    return keep_rows(docs, with_id_text(kept))


def with_id_text(kept: DataFrame) -> DataFrame:
    return kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"),
                       F.col("th").alias("__th"))
