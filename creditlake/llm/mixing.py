"""Mixing sources to target weights by capped water-filling.

Each source may give at most ``max_epochs`` times its size. The level L starts at
budget / (sum of weights); sources whose share L * weight reaches their cap are
clamped, the rest of the budget is shared again by weight, and so on until no
further source is clamped. L only rises, so one number carries the state from
round to round; each round is one aggregate over the sources.

A source's target is then taken as whole repetitions of all its documents plus a
fractional one: documents in seeded hash order until the words are used up, the last
one whole or not at all, whichever is nearer the target. Running sums go by hash bucket
within a source, so a source with a third of all rows is spread over all tasks; rows
equal in all columns read are counted first, so repeated rows or null ids are one row.

Edge cases: null text has no words; documents without words are never taken and
have size 0; null is a source of its own; an empty table gives an empty result;
repeated rows count each time; sources missing from ``weights`` get weight 0 and
target 0; input columns of any name are kept as they are.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cumulative import running_totals
from .common import WORD, attach_documents, one_row_per_copy, prefix_sums, row_hash, stored, text_of

BUCKET_DIGITS = 3  # of the hexadecimal hash: 4096 buckets a source
SEED = 17


def sized(docs: DataFrame, *more) -> DataFrame:
    """doc_id, source, size (words) and further columns, written to the shared
    folder: sizes are read several times, the texts once."""
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source")
    return stored(docs.select("doc_id", source, F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"),
                              *more), "mix-sizes")


def cycled_weights(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources in code point order, null last, weigh ``weights`` in turn."""
    sources = sizes.groupBy("source").agg(F.lit(1).cast("long").alias("one"))
    named = running_totals(sources.filter("source is not null"), "source", ["one"]).select("source", "cum_one")
    last = sources.filter("source is null").withColumn("cum_one", named.agg(F.count(F.lit(1)) + 1).scalar())
    ranked = named.unionByName(last.select("source", "cum_one"))
    return ranked.select("source", F.element_at(F.array(*map(F.lit, weights)),
                                                ((F.col("cum_one") - 1) % len(weights) + 1).cast("int")).alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, max_epochs: int = 3, budget: int | None = None) -> DataFrame:
    """source, source_size and target words by capped water-filling."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    right = weights.select(F.col("source").alias("__s"), "weight")
    per = (per.join(right, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
           .withColumns({"weight": F.coalesce(F.col("weight"), F.lit(0)).cast("long"),
                         "cap": F.col("source_size") * max_epochs}))
    per = stored(per, "mix-sources")
    whole, words, all_caps = per.agg(F.sum("weight"), F.sum("source_size"),
                                     F.sum(F.when(F.col("weight") > 0, F.col("cap")))).first()
    budget = min(words if budget is None else budget, all_caps or 0) if words else 0
    level = budget / whole if whole else 0.0
    while budget:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        clamped, rest = per.agg(F.sum(F.when(full & (F.col("weight") > 0), F.col("cap"))),
                                F.sum(F.when(~full, F.col("weight")))).first()
        raised = (budget - (clamped or 0)) / rest if rest else level
        if raised <= level:
            break
        level = raised
    share = F.col("weight") * F.lit(level)
    return per.select("source", "source_size", F.when(share >= F.col("cap"), F.col("cap").cast("double"))
                      .otherwise(share).alias("target"))


def mix(sizes: DataFrame, weights: DataFrame, max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """``sizes`` with source_size, target, ``whole`` (full repetitions), ``part`` (its
    size if the fractional one takes it, else 0) and ``taken`` words."""
    goal = targets(sizes, weights, max_epochs).select(F.col("source").alias("__t"), "source_size", "target")
    others = [F.col(c).cast("string") for c in sizes.columns if c not in ("doc_id", "source")]
    unnamed = F.when(F.col("doc_id").isNull(), F.concat_ws(":", *others))
    rows = (sizes.groupBy(*sizes.columns).agg(F.count(F.lit(1)).alias("__n"))
            .withColumns({"__h": F.md5(F.concat_ws(":", F.lit(seed), "doc_id", unnamed)), "__words": F.col("size") * F.col("__n")})
            .withColumn("__bucket", F.substring("__h", 1, BUCKET_DIGITS)))
    order = ["__h", *[c for c in sizes.columns if c != "source"]]
    summed = one_row_per_copy(prefix_sums(rows, "__words", "__bucket", order, "__before", ["source"]), "__n", "__copy")
    joined = summed.join(goal, F.col("source").eqNullSafe(F.col("__t")))
    left = (F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long")
            - F.col("__before") - F.col("__copy") * F.col("size"))
    return (joined.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                              .otherwise(F.lit(0)).cast("long"))
            .withColumn("part", F.when(2 * left >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long")))
            .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
            .select(*sizes.columns, "source_size", "target", "whole", "part", "taken"))


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, cycle: tuple[int, ...] = (5, 2, 1),
                    max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """The mixture itself: each document, whole, as often as it is taken, all its columns."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id")
    sizes = sized(docs, id_text, row_hash(docs).alias("__th"))
    plan = mix(sizes, weights if weights is not None else cycled_weights(sizes, cycle), max_epochs, seed)
    times = (F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
    plan = plan.filter("taken > 0").select("__id", "__th", F.explode(F.array_repeat(F.lit(0), times)))
    return attach_documents(docs, plan.select("__id", "__th"))
