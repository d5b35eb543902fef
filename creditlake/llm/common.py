"""Shared helpers of the corpus operators: text rules, shared tables, prefix sums."""
from __future__ import annotations

import string
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
COPY_CHUNK = 65_536


def runs_in_tasks(module: str) -> None:
    """Ship a module's functions with the job, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text, a null counting as empty; an absent column counts as null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, fixes partition-dependent values and survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    writer = df.write.options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row, nulls told from values (maps as JSON)."""
    parts = []
    for field in docs.schema.fields:
        value = F.col(f"`{field.name}`")
        parts += [F.to_json(value) if "map<" in field.dataType.simpleString() else value, value.isNull()]
    return F.xxhash64(*parts)


def with_row_key(docs: DataFrame) -> DataFrame:
    """``__doc`` (the whole row as one struct, so that no column name clashes),
    ``__id`` (id as text, null: a marker no number prints as) and ``__th`` (hash of
    all columns). Rows equal in both are repeated rows."""
    return docs.select(F.struct("*").alias("__doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"),
                       row_hash(docs).alias("__th"))


def attach_documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``plan`` (keyed by ``__id``, ``__th``) with the columns of their
    document. Repeated rows of ``docs`` are collapsed first, so a plan with one
    row per repetition keeps the right number of copies."""
    return (with_row_key(docs).dropDuplicates(["__id", "__th"]).join(plan, ["__id", "__th"])
            .select("__doc.*", *[c for c in plan.columns if c not in ("__id", "__th")]))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each key in ``kept``: the join key holds the id, so
    no group of copies meets in one task, and the text is shuffled once."""
    return (with_row_key(docs).join(kept.select("__id", "__th"), ["__id", "__th"], "left_semi")
            .dropDuplicates(["__id", "__th"]).select("__doc.*"))


def prefix_sums(df: DataFrame, value: str, bucket: str, order: list[str], out: str,
                group: list[str] | None = None) -> DataFrame:
    """Exclusive running sum ``out`` of ``value`` per ``group`` in (bucket, order)
    order, without a window over a whole group.

    Sums per (group, bucket) are combined map-side; their running sum needs as
    many rows per group as there are buckets. Rows are then summed within their
    bucket only. ``bucket`` must not be null and has a fixed number of values.
    """
    keys = [*(group or []), bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__s"))
    over = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(bucket)
    offsets = sums.withColumn("__o", F.coalesce(F.sum("__s").over(over.rowsBetween(Window.unboundedPreceding, -1)),
                                                F.lit(0))).drop("__s")
    right = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__o")
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) if i < len(keys) - 1 else F.col(k) == F.col(f"__k{i}")
          for i, k in enumerate(keys)]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(right, on).withColumn(out, F.col("__o") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("__o", *[f"__k{i}" for i in range(len(keys))]))


def one_row_per_copy(df: DataFrame, n: str, index: str) -> DataFrame:
    """Repeat each row ``n`` times with ``index`` 0..n-1, in chunks, so that no
    array grows with the number of copies."""
    return (df.withColumn("__c", F.explode(F.expr(f"sequence(0L, `{n}` - 1, {COPY_CHUNK}L)")))
            .withColumn(index, F.explode(F.expr(f"sequence(__c, least(__c + {COPY_CHUNK - 1}, `{n}` - 1))")))
            .drop("__c"))
