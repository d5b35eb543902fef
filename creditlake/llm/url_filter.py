"""URL rules by a sort-merge range join with a stack of nested rules.

A rule (host, path) becomes one interval of canonical keys: labels of the host
reversed, byte FE, then the path; it ends at the same key followed by byte FF
(no UTF-8 text contains either byte). A url gives one point per host suffix of at
most as many labels as the longest rule host, so "host and all subdomains" needs
no wildcard. Rule starts, rule ends and points are sorted together by range
partitions; intervals of one host nest, so the sweep's stack is a depth (running
sum of starts and ends) plus, per depth, the last rule started there. Depth and
open rules are carried into each range from the ranges before it, one row per
(range, depth). A url's verdict is the longest rule over its points.

Edge cases: null urls and urls without "://" have empty host and path and no
rule; a path that is empty does not start with "/"; equal rules count once;
rules of equal length: the longer host wins; "block" wins over "allow" for one
(host, path) given both; repeated pages each get a row; null page ids are kept;
empty pages give an empty result; without rules every url gets the default.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, one_row_per_copy, stored

START, POINT, END = 0, 1, 2


def _key(labels, path):
    return F.concat(F.array_join(F.reverse(labels), ".").cast("binary"), F.lit(b"\xfe"), path.cast("binary"))


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, n: equal rows once, with their number."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.groupBy(F.col("page_id"), ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)).alias("host"),
                         F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path")).agg(F.count(F.lit(1)).alias("n"))


def sweep(events: DataFrame) -> DataFrame:
    """Points with the innermost open ``rule``. ``events``: key, kind, rule (of
    starts) and the points' own columns."""
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("page_id", "host", "path")
    ranged = stored(events.withColumn("tie", tie).repartitionByRange(parts, "key", "kind", "tie")
                    .withColumns({"pid": F.spark_partition_id(),
                                  "step": F.expr(f"case kind when {START} then 1 when {END} then -1 else 0 end")}),
                    "url-sweep")
    steps = ranged.groupBy("pid").agg(F.sum("step").alias("s"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = steps.select("pid", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    # within a key: starts, then points, then ends of rules that end there
    running = Window.partitionBy("pid").orderBy("key", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    deep = ranged.join(F.broadcast(base), "pid").withColumn("depth", F.col("base") + F.sum("step").over(running))
    last = (deep.groupBy("pid", "depth")
            .agg(F.max(F.when(F.col("kind") == START, F.struct("key", "rule"))).alias("open")))
    earlier = Window.partitionBy("depth").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("pid", "depth", F.last("open.rule", ignorenulls=True).over(earlier).alias("carried"))
    nested = (Window.partitionBy("pid", "depth").orderBy("key", "kind", "tie")
              .rowsBetween(Window.unboundedPreceding, 0))
    top = F.coalesce(F.last("rule", ignorenulls=True).over(nested), F.col("carried"))
    return (deep.join(carried, ["pid", "depth"])
            .withColumn("open_rule", F.when(F.col("depth") > 0, top)).filter(F.col("kind") == POINT))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page. ``rules``: host, path, verdict."""
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("rule", F.struct(
        F.char_length(F.concat("host", "path")).alias("length"), F.char_length("host").alias("host_length"),
        F.concat("host", "path").alias("name"), F.col("verdict")))
    labels = F.split("host", "[.]", -1)
    most = rules.agg(F.coalesce(F.max(F.size(labels)), F.lit(0))).first()[0]  # one number
    urls = url_parts(pages)
    if not most:
        return one_row_per_copy(urls, "n", "copy").select(
            "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    none = F.lit(None)
    edge = rules.withColumn("key", _key(labels, F.col("path"))).select(
        "rule", F.explode(F.array(F.struct(F.col("key"), F.lit(START).alias("kind")),
                                  F.struct(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(END).alias("kind")))).alias("e"))
    edges = edge.select("e.key", "e.kind", F.when(F.col("e.kind") == START, F.col("rule")).alias("rule"),
                        none.cast("long").alias("page_id"), none.cast("string").alias("host"),
                        none.cast("string").alias("path"), none.cast("long").alias("n"))
    suffixes = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most)))
    points = urls.withColumn("k", F.explode(suffixes)).select(
        _key(F.slice(labels, F.size(labels) - F.col("k") + 1, F.col("k")), F.col("path")).alias("key"),
        F.lit(POINT).alias("kind"), none.cast(edges.schema["rule"].dataType).alias("rule"),
        F.col("page_id").cast("long").alias("page_id"), "host", "path", "n")
    found = (sweep(edges.unionByName(points)).groupBy("page_id", "host", "path")
             .agg(F.max("open_rule").alias("best"), F.max("n").alias("n")))
    return one_row_per_copy(found, "n", "copy").select(
        "page_id", "host", "path", F.col("best.name").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
