"""Data-quality operators.

The column report is ONE wide aggregate over all columns (null count, skewness)
and ONE narrow one that counts the distinct values of all columns — never a job
per column.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KEY, TARGET, UNEMPLOYED_SENTINEL
from ..functions.exprs import sample_skew, with_scalars

VALUES_PER_TASK = 1_000_000  # values that one task holds at most to tell the distinct ones
_NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns by dtype (numeric)."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() in _NUMERIC]


def string_columns(df: DataFrame) -> list[str]:
    """Columns by dtype (categorical)."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(``__c`` = position in ``cols``, ``__v`` = value as text, ``__n`` rows), nulls left
    out: narrow pairs, combined in every map task, so a common value is one row of it."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def text(c: str) -> Column:
        if types[c] in ("double", "float"):
            return (F.col(c) + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
        return F.to_json(F.col(c)) if types[c] in ("array", "map", "struct") else F.col(c).cast("string")

    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("__c"), text(c).alias("__v"))
                                         for i, c in enumerate(cols)])))
    return pairs.where(F.col("__v").isNotNull()).groupBy("__c", "__v").agg(F.count(F.lit(1)).alias("__n"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """(``__c`` = position of a column in ``df``, ``__d`` = its distinct values, nulls left
    out). A value stands in the field of its type beside its column's position, so rows
    stay narrow whatever the number of columns; rows are dealt out first, so that no task
    holds many more than ``VALUES_PER_TASK`` values, however few the files are."""
    kinds = list(dict.fromkeys(f.dataType for f in df.schema.fields))
    tasks = max(1, math.ceil(df.count() * len(df.columns) / VALUES_PER_TASK))
    one = [F.struct(F.lit(i).alias("__c"), *[(F.col(f"`{f.name}`") if f.dataType == t else F.lit(None).cast(t)).alias(f"__v{k}")
                                             for k, t in enumerate(kinds)]) for i, f in enumerate(df.schema.fields)]
    values = [f"__v{k}" for k in range(len(kinds))]
    pairs = df.repartition(tasks, *[F.col(f"`{c}`") for c in df.columns]).select(F.inline(F.array(*one)))
    given = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])  # ``dropna`` would drop NaN too
    return pairs.where(given).distinct().groupBy("__c").agg(F.count(F.lit(1)).alias("__d"))


def data_quality_report(df: DataFrame) -> DataFrame:
    """Per column dtype, missing %, missing n, non-null cardinality, sample skew
    (0 for a constant column of three values or more)."""
    num = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(df.columns):
        col = F.col(c)
        aggs.append(F.count_if(col.isNull()).alias(f"m{i}"))
        if c in num:
            x = col.cast("double")
            flat = (F.count(x) >= 3) & (F.min(x) == F.max(x))
            aggs.append(F.when(flat, 0.0).otherwise(sample_skew(F.skewness(x), F.count(x))).alias(f"s{i}"))
        else:
            aggs.append(F.lit(None).cast("double").alias(f"s{i}"))
    wide = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [F.struct(F.lit(i).alias("__c"), F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                     F.col(f"m{i}").alias("missing_n"), F.col(f"s{i}").alias("skew"))
            for i, c in enumerate(df.columns)]
    long = wide.select("__n", F.inline(F.array(*rows))).join(distinct_counts(df), "__c", "left")
    return (long.select("column_name", "dtype",
                        (F.try_divide(F.col("missing_n"), F.col("__n")) * 100).alias("missing_pct"),
                        F.col("missing_n").cast("bigint").alias("missing_n"),
                        F.coalesce("__d", F.lit(0)).cast("bigint").alias("cardinality"),
                        "skew")
                .orderBy(F.desc("missing_pct"), "column_name"))


def dtype_distribution(report: DataFrame) -> DataFrame:
    """Number of columns per dtype."""
    return report.groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))


def sentinel_outcome(app: DataFrame) -> DataFrame:
    """C10 (P6 + A14): share of the no-job sentinel and default rate per flag value."""
    flag = F.coalesce(F.col("DAYS_EMPLOYED") >= UNEMPLOYED_SENTINEL, F.lit(False))
    g = (app.withColumn("is_sentinel", flag.cast("int"))
            .groupBy("is_sentinel")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.avg(F.when(F.col(TARGET) == 1, 1.0).otherwise(0.0)).alias("default_rate"),
                 F.avg(F.when(F.col(TARGET) == 0, 1.0).otherwise(0.0)).alias("no_default_rate")))
    from pyspark.sql import Window
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows × columns per table plus a grand total row (one job, union of counts)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
               .select(F.lit(name).alias("table_name"), "n_rows",
                       F.lit(len(df.columns)).cast("bigint").alias("n_cols"))
             for name, df in tables.items()]
    inv = reduce(DataFrame.unionByName, parts)
    total = inv.agg(F.lit("TOTAL").alias("table_name"), F.sum("n_rows").alias("n_rows"),
                    F.sum("n_cols").alias("n_cols"))
    return inv.unionByName(total)


def join_coverage(app: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """J4 (fixes the always-100 % check): share of customers matched by each child
    aggregate. One left join per child against its distinct keys; every side is
    customer-grain and hash-partitioned on the key."""
    keys = app.select(KEY).where(F.col(KEY).isNotNull())
    n_app = app.agg(F.count(F.lit(1)).alias("n_app"))
    parts = []
    for name, child in children.items():
        k = child.select(KEY).where(F.col(KEY).isNotNull()).distinct().withColumn("__m", F.lit(1))
        parts.append(keys.join(k, KEY, "left")
                         .agg(F.count("__m").alias("matched"))
                         .select(F.lit(name).alias("source"), "matched"))
    cov = with_scalars(reduce(DataFrame.unionByName, parts), n_app)
    return cov.select("source", "matched", "n_app",
                      (F.col("matched") / F.col("n_app")).alias("match_rate"))


COVERAGE_MARKERS = {"bureau": "bureau_credit_count", "previous_app": "prev_app_count",
                    "credit_card": "cc_month_count", "installments": "inst_count", "pos_cash": "pos_month_count"}


def join_coverage_from_master(master: DataFrame, markers: dict[str, str] = COVERAGE_MARKERS) -> DataFrame:
    """J4 on the built master: a child's count column is non-null exactly when the
    customer matched that child aggregate, so every match rate comes from one
    pass over the customer-grain master (no aggregate is recomputed)."""
    wide = master.agg(F.count(F.lit(1)).alias("n_app"),
                      *[F.count(F.col(c)).alias(f"m_{i}") for i, c in enumerate(markers.values())])
    rows = [F.struct(F.lit(name).alias("source"), F.col(f"m_{i}").alias("matched"))
            for i, name in enumerate(markers)]
    return wide.select("n_app", F.inline(F.array(*rows))).select(
        "source", "matched", "n_app", (F.col("matched") / F.col("n_app")).alias("match_rate"))
