"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's number x in 0..n-1 is permuted to y; shard = y mod shards and slot =
y div shards, so shard sizes differ by one row at most and slots have no gap.
The permutation is a function of (seed, n) alone: ``place`` gives the shard and
slot of any row number without reading data.

Domain: x splits into (x mod a, x div a) with a = ceil(sqrt(n)), b = ceil(n/a).
Alternating Feistel rounds act on the two parts; a result y >= n is permuted
again (cycle walking) until it falls below n. a*b - n < a, so a walk has at most
a steps; WALK steps always suffice up to n = WALK**2, and beyond that a longer
walk has a chance under WALK**-WALK and raises an error instead of a wrong place.

Row numbers follow a hash bucket of the row's key, then the key itself, so they
do not depend on partitions. Rows equal in the key are counted before they are
numbered: a key that a third of the rows share is one row with a count.

Edge cases: null text has size 1 and crc32 0; null ids are keys like any other;
repeated rows each get their own place; an empty table gives an empty result;
other columns of the input are not read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_documents, one_row_per_copy, prefix_sums, stored, text_of, with_row_key

BUCKETS = 1024
ROUNDS = 6
WALK = 64


def _feistel(x: str, a: str, b: str, seed: int) -> str:
    left, right = f"({x} % {a})", f"({x} div {a})"
    for j in range(ROUNDS):
        if j % 2 == 0:
            left = f"(({left} + pmod(xxhash64({seed}L, {j}L, {right}), {a})) % {a})"
        else:
            right = f"(({right} + pmod(xxhash64({seed}L, {j}L, {left}), {b})) % {b})"
    return f"({right} * {a} + {left})"


def place(df: DataFrame, number: str, total: str, shards: int, seed: int) -> DataFrame:
    """Add ``shard`` and ``slot`` from a row number and the number of rows."""
    walked = (f"aggregate(sequence(1, {WALK}), __y, (v, i) -> "
              f"if(v < `{total}`, v, {_feistel('v', '__a', '__b', seed)}))")
    return (df.withColumn("__a", F.ceil(F.sqrt(F.col(total).cast("double"))).cast("long"))
            .withColumn("__b", F.expr(f"(`{total}` + __a - 1) div __a"))
            .withColumn("__y", F.expr(_feistel(f"`{number}`", "__a", "__b", seed)))
            .withColumn("__y", F.expr(f"if(__y < `{total}`, __y, {walked})"))
            .withColumn("__y", F.expr(f"if(__y < `{total}`, __y, raise_error('cycle walk too long'))"))
            .withColumns({"shard": F.expr(f"cast(__y % {shards} as int)"), "slot": F.expr(f"__y div {shards}")})
            .drop("__a", "__b", "__y"))


def assign_shards(rows: DataFrame, key: list[str], shards: int, seed: int = 17) -> DataFrame:
    """One row per input row: the ``key`` columns, ``row_number``, ``shard``, ``slot``."""
    distinct = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
                      .withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS))), "shard-keys")
    numbered = prefix_sums(distinct, "__n", "__bucket", key, "__first")
    total = distinct.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__total"))
    copies = one_row_per_copy(numbered, "__n", "__copy").withColumns(
        {"row_number": F.col("__first") + F.col("__copy"), "__total": total.scalar()})
    return place(copies, "row_number", "__total", shards, seed).select(*key, "row_number", "shard", "slot")


def document_shards(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """Places of all documents with their size (UTF-8 bytes + 1) and checksum."""
    text = text_of(docs)
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(rows, ["doc_id", "size", "text_crc32"], shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 17, rows_per_file: int = 1_000_000) -> None:
    """Write whole documents under ``path/shard=k`` ordered by slot; a shard is
    written by as many tasks as it has runs of ``rows_per_file`` slots. Input
    columns named like those written here get underscores added."""
    taken = {"row_number", "shard", "slot", "__run", *map(str.lower, docs.columns)}
    for name in [c for c in docs.columns if c.lower() in ("row_number", "shard", "slot", "__run")]:
        free = name + "_"
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        docs = docs.withColumnRenamed(name, free)
    keyed = with_row_key(docs).select("__id", "__th")
    placed = attach_documents(docs, assign_shards(keyed, ["__id", "__th"], shards, seed))
    (placed.withColumn("__run", F.expr(f"slot div {rows_per_file}")).repartition("shard", "__run")
     .sortWithinPartitions("shard", "slot").drop("__run").write.partitionBy("shard").parquet(path))
