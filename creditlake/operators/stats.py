"""Hypothesis tests, correlation and stratification (M1–M8).

All tests reduce to sufficient statistics computed in ONE wide aggregate per
grouping (n, mean, sample variance per group and column, map-side combined),
then the statistic is column algebra on the tiny result. p-values use the
incomplete beta in :mod:`creditlake.functions.special` on those few rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FEATURE_GROUPS, TTEST_MIN_GROUP
from ..functions.cumulative import running_totals
from ..functions.exprs import with_scalars
from ..functions.quantiles import quantile_frame
from ..functions.special import f_pvalue, t_pvalue


def _group_moments(df: DataFrame, group_cols: list[str], cols: list[str]) -> list[DataFrame]:
    """For each (binary) group column a frame (column_name, n1, m1, v1, n0, m0, v0):
    group value 1 vs 0, nulls dropped per column (as ``Series.dropna``). One scan
    aggregates count, mean and variance of every column by all group columns
    together (nine cells at most for two); the cells are then merged per group value."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"m_{i}"), F.var_samp(x).alias(f"v_{i}")]
    binary = {f"__g{k}": F.when(F.col(g).isin(0, 1), F.col(g).cast("int")) for k, g in enumerate(group_cols)}
    cells = df.select(*cols, *[c.alias(n) for n, c in binary.items()]).groupBy(*binary).agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("n"), F.col(f"m_{i}").alias("m"),
                     F.col(f"v_{i}").alias("v")) for i, c in enumerate(cols)]
    long = cells.select(*binary, F.inline(F.array(*rows))).withColumn("s", F.coalesce(F.col("v"), F.lit(0.0)) * (F.col("n") - 1))
    out = []
    for g in binary:
        side = Window.partitionBy("column_name", g)
        mean = F.sum(F.col("n") * F.col("m")).over(side) / F.nullif(F.sum("n").over(side).cast("double"), F.lit(0.0))
        spread = F.when(F.col("n") > 0, F.col("s") + F.col("n") * (F.col("m") - F.col("__mean")) ** 2)
        merged = (long.withColumn("__mean", mean).withColumn("__spread", spread).groupBy("column_name", g)
                  .agg(F.sum("n").alias("n"), F.first("__mean").alias("m"), F.sum("__spread").alias("s")))
        of = lambda v, c: F.max(F.when(F.col(g) == v, F.col(c)))
        out.append(merged.groupBy("column_name").agg(*[x for v in (1, 0) for x in (
            F.coalesce(of(v, "n"), F.lit(0)).alias(f"n{v}"), of(v, "m").alias(f"m{v}"),
            F.when(of(v, "n") > 1, of(v, "s") / (of(v, "n") - 1)).alias(f"v{v}"))]))
    return out


def _welch(m: DataFrame) -> DataFrame:
    se2 = F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(se2))
    dfree = F.try_divide(se2 * se2, (F.col("v1") / F.col("n1")) ** 2 / (F.col("n1") - 1)
                         + (F.col("v0") / F.col("n0")) ** 2 / (F.col("n0") - 1))
    return m.withColumns({"t_stat": t, "dof": dfree})


def welch_ttest(df: DataFrame, group_col: str, cols: list[str], with_p: bool = True) -> DataFrame:
    """M1: Welch two-sample t-test (group 1 minus group 0) for each column."""
    out = _welch(_group_moments(df, [group_col], cols)[0])
    out = out.select("column_name", F.col("n1").alias("n_group1"), F.col("n0").alias("n_group0"),
                     F.col("m1").alias("mean_group1"), F.col("m0").alias("mean_group0"), "t_stat", "dof")
    if with_p:
        out = out.withColumn("p_value", t_pvalue(F.col("t_stat"), F.col("dof")))
    return out


def dimension_of(feature: F.Column) -> F.Column:
    """Catalog membership, else prefix rule (first dimension in catalog order)."""
    expr = None
    for dim, names in FEATURE_GROUPS.items():
        cond = feature.isin(*names) | feature.startswith(dim.split("_")[0])
        expr = F.when(cond, dim) if expr is None else expr.when(cond, dim)
    return expr.otherwise("other")


def feature_screen(features: DataFrame, cols: list[str], with_p: bool = True) -> DataFrame:
    """M2: every feature × (default, young) Welch test; a group with ≤30 rows gets p = 1."""
    parts = {}
    for name, moments in zip(("default", "age"), _group_moments(features, ["TARGET", "IS_YOUNG"], cols)):
        t = _welch(moments)
        small = (F.col("n1") <= TTEST_MIN_GROUP) | (F.col("n0") <= TTEST_MIN_GROUP)
        t = t.select("column_name",
                     F.when(small, None).otherwise(F.col("t_stat")).alias(f"t_{name}"),
                     F.when(small, None).otherwise(F.col("dof")).alias(f"dof_{name}"),
                     small.alias(f"small_{name}"))
        parts[name] = t
    out = parts["default"].join(parts["age"], "column_name")
    out = out.withColumnRenamed("column_name", "feature").withColumn("dimension", dimension_of(F.col("feature")))
    if with_p:
        for name in ("default", "age"):
            p = F.when(F.col(f"small_{name}"), 1.0).otherwise(t_pvalue(F.col(f"t_{name}"), F.col(f"dof_{name}")))
            out = out.withColumn(f"p_{name}", p).withColumn(f"sig_{name}", F.col(f"p_{name}") < 0.05)
    return out.drop("small_default", "small_age")


def dimension_power(screen: DataFrame) -> DataFrame:
    """Per dimension, share of significant features; score 0.6·default + 0.4·age."""
    out = (screen.groupBy("dimension")
           .agg(F.count("feature").alias("n_features"),
                F.avg(F.col("sig_default").cast("double")).alias("sig_default_pct"),
                F.avg(F.col("sig_age").cast("double")).alias("sig_age_pct"),
                F.avg("p_default").alias("avg_p_default"), F.avg("p_age").alias("avg_p_age")))
    return (out.withColumn("discriminative_score", F.col("sig_default_pct") * 0.6 + F.col("sig_age_pct") * 0.4)
               .orderBy(F.desc("discriminative_score"), "dimension"))


def anova_two_groups(df: DataFrame, group_col: str, cols: list[str], with_p: bool = True) -> DataFrame:
    """M3: one-way ANOVA F per column from group n, mean, variance (k groups = 2)."""
    m = _group_moments(df, [group_col], cols)[0]
    n = F.col("n1") + F.col("n0")
    grand = (F.col("m1") * F.col("n1") + F.col("m0") * F.col("n0")) / n
    ssb = F.col("n1") * (F.col("m1") - grand) ** 2 + F.col("n0") * (F.col("m0") - grand) ** 2
    ssw = (F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")
    out = m.select("column_name", F.try_divide(ssb / 1, ssw / (n - 2)).alias("f_stat"),
                   F.lit(1).cast("bigint").alias("df_between"), (n - 2).alias("df_within"))
    if with_p:
        out = out.withColumn("p_value", f_pvalue(F.col("f_stat"), F.col("df_between"), F.col("df_within")))
    return out


def kruskal_wallis(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    """M5: Kruskal-Wallis H with tie correction. Average ranks come from the
    distinct-value count table and a distributed running count (no global sort
    in one task)."""
    counts = (df.where(F.col(value_col).isNotNull() & F.col(group_col).isNotNull())
                .groupBy(value_col).pivot(group_col).count().na.fill(0))
    groups = [c for c in counts.columns if c != value_col]
    counts = counts.withColumn("__t", sum((F.col(f"`{g}`") for g in groups), F.lit(0)))
    ranked = running_totals(counts, value_col, ["__t"])
    avg_rank = F.col("cum___t") - F.col("__t") + (F.col("__t") + 1) / 2.0
    per = ranked.agg(*[F.sum(F.col(f"`{g}`") * avg_rank).alias(f"R_{i}") for i, g in enumerate(groups)],
                     *[F.sum(F.col(f"`{g}`")).alias(f"n_{i}") for i, g in enumerate(groups)],
                     F.sum("__t").alias("N"),
                     F.sum(F.col("__t").cast("double") ** 3 - F.col("__t")).alias("ties"))
    big_n = F.col("N").cast("double")
    h = 12.0 / (big_n * (big_n + 1)) * sum((F.col(f"R_{i}") ** 2 / F.col(f"n_{i}") for i in range(len(groups))),
                                           F.lit(0.0)) - 3 * (big_n + 1)
    corr = 1 - F.try_divide(F.col("ties"), big_n ** 3 - big_n)  # a single row has no ranks to compare: null
    return per.select(F.lit(value_col).alias("column_name"), F.lit(len(groups)).alias("k"),
                      F.col("N").alias("n"), F.try_divide(h, corr).alias("h_stat"))


def correlation_with(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """M6: |corr(x, target)| per column in one aggregate, sorted descending."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"c{i}")
                    for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("corr")) for i, c in enumerate(cols)]
    out = wide.select(F.inline(F.array(*rows)))
    return out.withColumn("abs_corr", F.abs("corr")).orderBy(F.desc("abs_corr"), "feature")


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """M7: all pairwise Pearson correlations in one aggregate, long form (a, b, corr)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{k}")
                    for k, (a, b) in enumerate(pairs)])
    rows = []
    for k, (a, b) in enumerate(pairs):
        rows += [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"p{k}").alias("corr")),
                 F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"), F.col(f"p{k}").alias("corr"))]
    rows += [F.struct(F.lit(c).alias("feature_a"), F.lit(c).alias("feature_b"), F.lit(1.0).alias("corr"))
             for c in cols]
    return wide.select(F.inline(F.array(*rows)))


def quantile_strata(df: DataFrame, value_col: str, outcome: str, n_bins: int = 10) -> DataFrame:
    """M8: cut points at the 1/n … (n−1)/n quantiles (one aggregate), right-closed
    buckets, outcome rate per bucket; rows without a value are in no bucket."""
    probs = [i / n_bins for i in range(1, n_bins)]
    q = quantile_frame(df, [(value_col, p, f"__c{i}") for i, p in enumerate(probs)])
    cuts = q.select(F.array(*[F.col(f"__c{i}") for i in range(len(probs))]).alias("__cuts"))
    joined = with_scalars(df.where(F.col(value_col).isNotNull()), cuts)
    bucket = F.aggregate(F.col("__cuts"), F.lit(0), lambda acc, c: acc + F.when(F.col(value_col) > c, 1).otherwise(0))
    return (joined.withColumn("bucket", bucket + 1)
                  .groupBy("bucket")
                  .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(outcome).cast("double")).alias("outcome_rate"),
                       F.min(value_col).alias("min_value"), F.max(value_col).alias("max_value")))
