"""Merkle manifest of a table, with inclusion proofs, by cogrouped subtree exchange.

Every row is a leaf; the rows of a language form a tree of arity 8, ordered by
doc_id, and the trees' roots (subroots), ordered by language, form one more. A
superblock is HEIGHT levels of a tree: 8 ** HEIGHT consecutive nodes.

Upwards, each superblock is reduced to one digest, and these digests are the next
table of nodes, until a tree has one block. Downwards, the nodes of a superblock
and the one row of outer nodes it needs (the siblings of its root on the way to
the manifest's root) are cogrouped by superblock: ``applyInPandas`` finishes the
local reduction, joins the local siblings with the outer ones into proofs, and
folds the received leaves. The output for the blocks' roots is the outer row of
the superblocks below, so nothing is joined level by level, no group exceeds a
superblock, and the number of passes is the logarithm of the rows to base 4096.

Positions within a tree come from a range partitioning by (tree, doc_id, leaf)
with running counts per partition; equal rows are counted before.

Edge cases: null values are written as ``-``, so null and empty text differ; null
languages form a tree of their own, ordered first; null ids come first in their
tree and are never tampered with; rows with the same id are ordered by their leaf,
and equal rows are leaves each; absent columns count as null and further columns
do not enter the leaf; an empty table gives an empty manifest.
"""
from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, one_row_per_copy, runs_in_tasks, stored

runs_in_tasks(__name__)

ARITY = 8
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "places array<int>, widths array<int>, siblings array<string>"


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def fold(leaf: str, places: list[int], widths: list[int], siblings: list[str]) -> str:
    """The root that a leaf and its proof give: on each level the node stands at
    ``places`` in a run of ``widths`` nodes, the others are the next siblings."""
    at = 0
    for place, width in zip(places, widths):
        others = list(siblings[at:at + width - 1])
        leaf = node([*others[:place], leaf, *others[place:]])
        at += width - 1
    return leaf


def leaf_digest(docs: DataFrame, **replaced: Column) -> Column:
    """SHA-256 of a row's fields, each as byte count, colon and value."""
    def field(name: str) -> Column:
        value = replaced.get(name, F.col(name) if name in docs.columns else F.lit(None)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(field, FIELDS)).cast("binary"), 256))


def leaves(docs: DataFrame, received: Column | None = None) -> DataFrame:
    """tree, lang, doc_id, leaf, received (the leaf of the text as received) and n
    (equal rows), written to the shared folder: the texts are read once."""
    lang = (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string")
    leaf = leaf_digest(docs)
    rows = docs.select(F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("tree"), lang.alias("lang"),
                       F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"),
                       (leaf if received is None else leaf_digest(docs, text=received)).alias("received"))
    keys = ["tree", "lang", "doc_id", "leaf", "received"]
    return stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "merkle-leaves")


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ``order`` columns, n) with ``at``: 0.. within each tree, a row
    for each of the n copies."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = stored(rows.repartitionByRange(parts, "tree", *order).withColumn("__part", F.spark_partition_id()), "merkle-order")
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("tree", "__part").agg(F.sum("n").alias("__n"))  # a tree has a row for each partition at most
    offsets = totals.select("tree", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("tree", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = (ranged.withColumn("__f", F.coalesce(F.sum("n").over(inside), F.lit(0)))
               .join(offsets, ["tree", "__part"]).withColumn("__f", F.col("__f") + F.col("__o")))
    return (one_row_per_copy(counted, "n", "__nth").withColumn("at", F.col("__f") + F.col("__nth"))
            .drop("__f", "__o", "__nth", "__part", "n"))


def levels_of(digests: list[str], forced: bool) -> list[list[str]]:
    """The levels of a superblock: HEIGHT above the nodes if the tree goes on above
    it, else as many as leave one node."""
    levels = [digests]
    while len(levels) <= HEIGHT and (forced or len(levels[-1]) > 1):
        last = levels[-1]
        levels.append([node(last[i:i + ARITY]) for i in range(0, len(last), ARITY)])
    return levels


def block_roots(nodes: DataFrame) -> DataFrame:
    """tree, at (the block's number), digest (of all HEIGHT levels), alone (the
    digest if this is the tree's only block), blocks (of the tree)."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        digests = [d.hex() for d in part.sort_values("at")["digest"]]
        top, alone = levels_of(digests, True)[-1][0], levels_of(digests, False)[-1][0]
        return pd.DataFrame({"tree": part["tree"].iloc[:1], "at": part["block"].iloc[:1],
                             "digest": [bytes.fromhex(top)], "alone": [bytes.fromhex(alone)]})

    made = (nodes.select("tree", "at", "digest", F.expr(f"at div {ARITY ** HEIGHT}").alias("block"))
            .groupBy("tree", "block").applyInPandas(run, "tree string, at long, digest binary, alone binary"))
    made = stored(made, "merkle-blocks")
    return made.join(made.groupBy("tree").agg((F.max("at") + 1).alias("blocks")), "tree")


def raised(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Node tables from ``nodes`` (tree, at, digest) up, and (tree, top, digest): the
    trees' roots, ``top`` being the table whose only block ends the tree."""
    tables, roots = [nodes], None
    while True:
        blocks = block_roots(tables[-1])
        done = blocks.filter("blocks = 1").select("tree", F.lit(len(tables) - 1).alias("top"), F.col("alone").alias("digest"))
        roots = done if roots is None else roots.unionByName(done)
        most = blocks.agg(F.max("blocks")).first()[0]
        if most is None or most == 1:
            return tables, roots
        tables.append(stored(blocks.filter("blocks > 1").select("tree", "at", "digest"), "merkle-nodes"))


def exchanged(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Cogroup the nodes of each superblock (tree, at, digest and, at the leaves,
    lang, doc_id, received) with its outer row (tree, block, forced, subroot,
    root and the proof of the block's root). Returns a row for each node: its
    columns, subroot, root, its proof and the root that ``received`` folds to."""
    leaf = "doc_id" in nodes.columns

    def run(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part, up = part.sort_values("at", ignore_index=True), above.iloc[0]
        digests = [d.hex() for d in part["digest"]]
        levels = levels_of(digests, bool(up["forced"]))
        paths = [(list(up["places"]), list(up["widths"]), list(up["siblings"]))]
        for level in reversed(levels[:-1]):
            below = []
            for i in range(len(level)):
                start = i - i % ARITY
                others = level[start:i] + level[i + 1:start + ARITY]
                places, widths, siblings = paths[i // ARITY]
                below.append(([i - start, *places], [len(others) + 1, *widths], others + siblings))
            paths = below
        out = part.drop(columns=["block", "digest", "received"], errors="ignore")
        out["subroot"], out["root"] = up["subroot"], up["root"]
        out["places"], out["widths"], out["siblings"] = map(list, zip(*paths))
        if leaf:
            out["leaf"] = digests
            out["folded_root"] = [fold(got.hex(), *path) for got, path in zip(part["received"], paths)]
        return out

    schema = ("tree string, at long, subroot string, root string, " + PROOF
              + (", lang string, doc_id long, leaf string, folded_root string" if leaf else ""))
    keyed = nodes.withColumn("block", F.expr(f"at div {ARITY ** HEIGHT}"))
    return keyed.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(run, schema)


def _descend(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Proofs of all nodes of ``tables[0]``. ``tops``: an outer row for the last
    block of each tree, with ``top``."""
    below = None
    for i in range(len(tables) - 1, -1, -1):
        outer = tops.filter(F.col("top") == i).drop("top")
        if below is not None:
            outer = outer.unionByName(below)
        proofs = exchanged(tables[i], outer)
        if not i:
            return proofs
        below = stored(proofs.select("tree", F.col("at").alias("block"), F.lit(True).alias("forced"), "subroot", "root",
                                     "places", "widths", "siblings"), "merkle-outer")


def manifest(docs: DataFrame, received: Column | None = None) -> DataFrame:
    """One row per document: tree, lang, doc_id, at, leaf, subroot, root, the proof
    (places, widths, siblings) and folded_root, the root that the proof and the
    leaf of the ``received`` text give."""
    ranked = stored(positions(leaves(docs, received), ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest"), "merkle-ranked")
    tables, subroots = raised(ranked)
    subroots = stored(subroots.withColumn("n", F.lit(1).cast("long")), "merkle-subroots")
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "n")
    forest = stored(positions(named, ["name"]), "merkle-forest")
    upper, whole = raised(forest.select("tree", "at", "digest"))
    none, empty = F.array().cast("array<int>"), F.array().cast("array<string>")
    hexed = F.lower(F.hex("digest"))
    tops = whole.select("tree", F.lit(0).cast("long").alias("block"), "top", F.lit(False).alias("forced"), F.lit("").alias("subroot"),
                        hexed.alias("root"), none.alias("places"), none.alias("widths"), empty.alias("siblings"))
    proofs = _descend(upper, tops).join(forest.select("at", "name", hexed.alias("own")), "at")
    ends = proofs.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.lit(False).alias("forced"),
                         F.col("own").alias("subroot"), "root", "places", "widths", "siblings")
    return _descend(tables, ends.join(subroots.select("tree", "top"), "tree"))


def tampered_text(docs: DataFrame, divisor: int = 3) -> Column:
    """The text, lower-cased (A-Z) where ``divisor`` divides the crc32 of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == 0
    return F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text")) if "text" in docs.columns else F.lit(None)
