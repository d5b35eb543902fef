"""Profiling marts and dashboard data.

Every mart is a group-by on a low-cardinality dimension (cohort, tier, band,
segment) over the customer-grain table: partial aggregation leaves a handful of
rows per task before the shuffle, so hot groups never concentrate raw rows.
Windows run only over those aggregated rows. The customer table has one row
per key, so the dashboards' COUNTD(customer) is a plain count here — no
distinct-aggregation stage that would route every key of a hot group to one task. Category dimensions with fixed,
tiny domains (tiers, bands) are literal frames joined with ``broadcast``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import (AGE_BIN_WIDTH, AGE_CHART_RANGE, AGE_FILTER, DIMENSION_SCORES, INCOME_BAND_TOP, INCOME_BANDS, KEY,
                      ROI_COLOR_BELOW, ROI_COLORS, SCORE_BINS, SEGMENT_LABELS, TIER_LABELS, YOUNG_AGE_MAX)
from ..functions.exprs import bin_right_closed
from ..functions.quantiles import quantile_frame

AGE_BAND_BOUNDS = [20, 25, 30, 35, 40, 45, 50, 55, 60, 70]


def _all() -> Window:
    """Window over an already-aggregated (tiny) frame."""
    return Window.partitionBy()


def tier_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(TIER_LABELS)], "tier string, tier_order int")


def segment_label(is_young="IS_YOUNG", owns="owns_realty") -> F.Column:
    """E19 SegmentLabel."""
    y, o = F.col(is_young), F.col(owns)
    expr = None
    for (yy, oo), lab in SEGMENT_LABELS.items():
        cond = (y == yy) & (o == oo)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr.otherwise(SEGMENT_LABELS[(0, 0)])


def income_band(income="income_total") -> F.Column:
    """E20 IncomeBand (left-closed)."""
    x = F.col(income)
    expr = None
    for hi, lab in INCOME_BANDS:
        expr = F.when(x < hi, lab) if expr is None else expr.when(x < hi, lab)
    return expr.otherwise(INCOME_BAND_TOP)


def income_band_index(income="income_total") -> F.Column:
    x = F.col(income)
    expr = None
    for i, (hi, _) in enumerate(INCOME_BANDS):
        expr = F.when(x < hi, i) if expr is None else expr.when(x < hi, i)
    return expr.otherwise(len(INCOME_BANDS))


def roi_color(roi="roi") -> F.Column:
    """E21 ROIColor."""
    x = F.col(roi)
    expr = None
    for lo, lab in ROI_COLORS:
        expr = F.when(x >= lo, lab) if expr is None else expr.when(x >= lo, lab)
    return expr.otherwise(ROI_COLOR_BELOW)


# ------------------------------------------------------------------ cohort marts
def cohort_comparison(app: DataFrame) -> DataFrame:
    """A10: nine metrics for the young (<35) and mature cohorts (cleaned application)."""
    cohort = F.when(F.col("AGE_YEARS") < YOUNG_AGE_MAX, 1).otherwise(0)
    return (app.withColumn("is_young", cohort).groupBy("is_young")
               .agg(F.count(F.lit(1)).alias("sample_size"),
                    F.avg("AGE_YEARS").alias("avg_age"),
                    F.avg("AMT_INCOME_TOTAL").alias("avg_income"),
                    (F.avg("FLAG_OWN_REALTY") * 100).alias("owns_realty_pct"),
                    (F.avg("FLAG_OWN_CAR") * 100).alias("owns_car_pct"),
                    F.avg("CNT_CHILDREN").alias("avg_children"),
                    (F.avg("IS_UNEMPLOYED") * 100).alias("unemployed_pct"),
                    (F.avg("TARGET") * 100).alias("default_rate_pct"),
                    F.avg("AMT_CREDIT").alias("avg_credit")))


def median_by_category(df: DataFrame, cat: str, value: str) -> DataFrame:
    """Median of ``value`` per category, sorted descending (null category dropped)."""
    dwelling = F.lower(F.col(cat)).contains("house") | F.lower(F.col(cat)).contains("apartment")
    med = quantile_frame(df.where(F.col(cat).isNotNull()), [(value, 0.5, "median_value")], [cat])
    return med.withColumn("is_dwelling", dwelling).orderBy(F.desc("median_value"), cat)


def frequency_table(df: DataFrame, col: str, top: int = 10) -> DataFrame:
    """Value counts (nulls excluded), top-N by count (ties by value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
              .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top))


def crosstab_normalized(df: DataFrame, row: str, col: str) -> DataFrame:
    """Row-normalized cross-tab in long form (row value, column value, share)."""
    counts = df.groupBy(F.col(row).alias("row_value"), F.col(col).alias("col_value")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("row_value")))


def tier_outcome(scored: DataFrame) -> DataFrame:
    """A15 (flagship): per tier n, default rate, avg income, avg score, young share;
    empty tiers kept through a right join to the 4-row tier dimension."""
    agg = (scored.groupBy("tier")
                 .agg(F.count(KEY).alias("n_customers"), F.avg("TARGET").alias("default_rate"),
                      F.avg("income_total").alias("avg_income"), F.avg("composite_score").alias("avg_composite"),
                      F.avg("IS_YOUNG").alias("young_pct")))
    dim = tier_dim(scored.sparkSession)
    return (dim.join(agg, "tier", "left")
              .withColumn("n_customers", F.coalesce("n_customers", F.lit(0)).cast("bigint"))
              .orderBy("tier_order"))


def ownership_by_age_band(app: DataFrame) -> DataFrame:
    """Property ownership % per right-closed age band (empty bands kept)."""
    labels = [f"({a}, {b}]" for a, b in zip(AGE_BAND_BOUNDS, AGE_BAND_BOUNDS[1:])]
    band = bin_right_closed("AGE_YEARS", AGE_BAND_BOUNDS, labels)
    agg = (app.withColumn("age_band", band).where(F.col("age_band").isNotNull())
              .groupBy("age_band").agg(F.count(F.lit(1)).alias("n"),
                                       (F.avg("FLAG_OWN_REALTY") * 100).alias("ownership_pct")))
    dim = app.sparkSession.createDataFrame([(lab, i) for i, lab in enumerate(labels)], "age_band string, band_order int")
    return (dim.join(agg, "age_band", "left")
              .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")).orderBy("band_order"))


def dimension_means(scored: DataFrame, by: str) -> DataFrame:
    """Mean of each dimension score per group, long form (group, dimension, mean)."""
    wide = scored.groupBy(by).agg(*[F.avg(c).alias(c) for c in DIMENSION_SCORES])
    return wide.unpivot([by], DIMENSION_SCORES, "dimension", "mean_score")


def radar_normalized(profile: DataFrame, metrics: list[str]) -> DataFrame:
    """Each metric divided by its column maximum (over aggregated rows)."""
    return profile.withColumns({f"{m}_norm": F.try_divide(F.col(m), F.max(m).over(_all())) for m in metrics})


def age_histogram(scored: DataFrame) -> DataFrame:
    """2-year age bins inside the 18–70 dashboard range, split by cohort."""
    lo, hi = AGE_FILTER
    return (scored.where(F.col("AGE_YEARS").between(lo, hi))
                  .withColumn("age_bin", F.floor(F.col("AGE_YEARS") / AGE_BIN_WIDTH) * AGE_BIN_WIDTH)
                  .groupBy("age_bin", "IS_YOUNG").agg(F.count(KEY).alias("n_customers")))


def score_histogram(scored: DataFrame) -> DataFrame:
    """Composite score in 50 equal bins over [0, 100] (100 falls in the last bin)."""
    w = 100.0 / SCORE_BINS
    b = F.least(F.floor(F.col("composite_score") / w), F.lit(SCORE_BINS - 1)).cast("int")
    return scored.groupBy(b.alias("score_bin"), "IS_YOUNG").agg(F.count(F.lit(1)).alias("n"))


def age_chart_histogram(scored: DataFrame) -> DataFrame:
    """Chart bins of 2 years from 20 to 74, the last one closed; ages outside are left out."""
    lo, hi = AGE_CHART_RANGE
    start = F.floor((F.col("AGE_YEARS") - lo) / AGE_BIN_WIDTH) * AGE_BIN_WIDTH + lo
    return (scored.where(F.col("AGE_YEARS").between(lo, hi))
                  .groupBy(F.least(start, F.lit(hi - AGE_BIN_WIDTH)).cast("bigint").alias("age_bin"), "IS_YOUNG")
                  .agg(F.count(F.lit(1)).alias("n_customers")))


def score_range_histogram(scored: DataFrame) -> DataFrame:
    """Composite score in equal bins over the data's own range, the last one closed;
    a range of one value is widened by a half on both sides. Null scores are left out."""
    x = scored.select("composite_score").where(F.col("composite_score").isNotNull())
    x = x.withColumns({"lo": x.agg(F.min("composite_score")).scalar(), "hi": x.agg(F.max("composite_score")).scalar()})
    one = F.col("lo") == F.col("hi")
    x = x.withColumns({"lo": F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")),
                       "hi": F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    width = (F.col("hi") - F.col("lo")) / SCORE_BINS
    place = F.least(F.floor((F.col("composite_score") - F.col("lo")) / width), F.lit(SCORE_BINS - 1)).cast("int")
    return (x.groupBy(place.alias("score_bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
             .select("score_bin", (F.col("lo") + F.col("score_bin") * (F.col("hi") - F.col("lo")) / SCORE_BINS).alias("bin_start"), "n"))


def box_stats(scored: DataFrame, value: str, by: str) -> DataFrame:
    """q1/median/q3, whiskers (most extreme values within 1.5·IQR) and outlier
    count per group — quartiles in one aggregate, whiskers in a second pass."""
    q = quantile_frame(scored, [(value, 0.25, "q1"), (value, 0.5, "median"), (value, 0.75, "q3")], [by])
    j = scored.join(q, by)
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    x = F.col(value)
    return (j.groupBy(by, "q1", "median", "q3")
             .agg(F.min(F.when(x >= lo, x)).alias("whisker_low"), F.max(F.when(x <= hi, x)).alias("whisker_high"),
                  F.count_if((x < lo) | (x > hi)).alias("n_outliers"), F.count(x).alias("n")))


def score_matrix(scored: DataFrame) -> DataFrame:
    """Average composite score per IncomeBand × SegmentLabel."""
    return (scored.withColumns({"income_band": income_band(), "segment_label": segment_label()})
                  .groupBy("income_band", "segment_label").agg(F.avg("composite_score").alias("avg_score"),
                                                               F.count(F.lit(1)).alias("n")))


def tier_income_matrix(scored: DataFrame) -> DataFrame:
    """Average composite score per IncomeBand × tier."""
    return (scored.groupBy(income_band().alias("income_band"), "tier")
                  .agg(F.avg("composite_score").alias("avg_score"), F.count(F.lit(1)).alias("n")))


def segment_mix(scored: DataFrame) -> DataFrame:
    """Customers per SegmentLabel with percent of total."""
    g = scored.groupBy(segment_label().alias("segment_label")).agg(F.count(KEY).alias("n_customers"))
    return g.withColumn("pct_of_total", F.col("n_customers") / F.sum("n_customers").over(_all()) * 100)


def kpi_cards(scored: DataFrame) -> DataFrame:
    """Customers, average score, % young, % owners, % ready."""
    return scored.agg(F.count(KEY).alias("total_customers"),
                      F.avg("composite_score").alias("avg_score"),
                      (F.avg("IS_YOUNG") * 100).alias("pct_young"),
                      (F.avg("owns_realty") * 100).alias("pct_own_home"),
                      (F.avg(F.when(F.col("tier") == TIER_LABELS[-1], 1.0).otherwise(0.0)) * 100).alias("pct_ready"))


def dimension_extremes(scored: DataFrame) -> DataFrame:
    """Highest and lowest average dimension."""
    wide = scored.agg(*[F.avg(c).alias(c) for c in DIMENSION_SCORES])
    long = wide.unpivot([], DIMENSION_SCORES, "dimension", "mean_score")
    return long.agg(F.max_by("dimension", "mean_score").alias("highest_dimension"),
                    F.max("mean_score").alias("highest_mean"),
                    F.min_by("dimension", "mean_score").alias("lowest_dimension"),
                    F.min("mean_score").alias("lowest_mean"))


def tier_distribution(scored: DataFrame) -> DataFrame:
    """Customers per tier in declared order (empty tiers kept)."""
    agg = scored.groupBy("tier").agg(F.count(KEY).alias("n_customers"))
    return (tier_dim(scored.sparkSession).join(agg, "tier", "left")
              .withColumn("n_customers", F.coalesce("n_customers", F.lit(0)).cast("bigint"))
              .orderBy("tier_order"))


def unmet_demand(scored: DataFrame) -> DataFrame:
    """Young non-owners versus everyone else."""
    young_renter = (F.col("AGE_YEARS") < YOUNG_AGE_MAX) & (F.col("owns_realty") == 0)
    return scored.agg(F.count_if(young_renter).alias("young_no_home"),
                      F.count_if(~young_renter).alias("rest"))


def global_rates(scored: DataFrame, n_features: int) -> DataFrame:
    """Overall default rate and the number of model features."""
    return scored.agg(F.count(F.lit(1)).alias("n_customers"), F.avg("TARGET").alias("default_rate"),
                      F.lit(n_features).alias("n_features"))


def customer_dim(scored: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """O1 dim_customer_profile (+ score, tier; + segment when given)."""
    out = scored.select(KEY, "AGE_YEARS", "IS_YOUNG", "income_total", "owns_car", "owns_realty",
                        "years_employed", "income_bracket", "composite_score", "tier",
                        segment_label().alias("segment_label"), income_band().alias("income_band"))
    if segments is not None:
        out = out.join(segments, KEY, "left")
    return out


def behavior_fact(scored: DataFrame) -> DataFrame:
    """O2 fact_behavioral_features."""
    return scored.select(KEY, *DIMENSION_SCORES, "composite_score", "tier")


def balance_proxy(scored: DataFrame, marketing: DataFrame) -> DataFrame:
    """Average survey balance per (age band, income band) attached to each
    customer. The donor is aggregated to at most (age bands × 4 income bands) rows
    before the broadcast, so its size is bounded by the band grid, not the data."""
    donor = (marketing.groupBy(F.floor(F.col("age") / 10).cast("int").alias("age_band"),
                               F.col("income_band").cast("int").alias("income_band_idx"))
                      .agg(F.avg("balance").alias("balance_proxy")))
    cust = scored.select(KEY, F.floor(F.col("AGE_YEARS") / 10).cast("int").alias("age_band"),
                         income_band_index().alias("income_band_idx"))
    return cust.join(F.broadcast(donor), ["age_band", "income_band_idx"], "left")


def feature_actions(importance: DataFrame, actions: DataFrame) -> DataFrame:
    """Feature → (dimension, product action) with defaults."""
    return (importance.join(F.broadcast(actions), "feature", "left")
                      .withColumns({"dimension": F.coalesce("dimension", F.lit("General")),
                                    "action": F.coalesce("action", F.lit("Monitor trend over time"))}))


def dashboard_filter(scored: DataFrame, segment: str | None = None, age_range=AGE_FILTER) -> DataFrame:
    """The dashboard's global filters (age range, segment) pushed into a mart's
    input as ordinary predicates."""
    lo, hi = age_range
    out = scored.where(F.col("AGE_YEARS").between(lo, hi))
    if segment is not None:
        out = out.where(segment_label() == segment)
    return out


def dim_fact(dim: DataFrame, fact: DataFrame) -> DataFrame:
    """Dashboard relationship customer dimension ↔ behaviour fact on the key
    (both customer-grain, co-partitioned on the key by the planner)."""
    return dim.join(fact.drop("composite_score", "tier"), KEY, "inner")


def dimension_label(col: F.Column) -> F.Column:
    """E15: 'savings_consistency_score' → 'Savings Consistency'."""
    return F.initcap(F.regexp_replace(F.regexp_replace(col, "_score", ""), "_", " "))


def channel_by_segment(prev: DataFrame, scored: DataFrame, channel_col: str) -> DataFrame:
    """Channel (contract type) mix per customer segment with share within the
    segment. Applications are pre-aggregated per (customer, channel) before the
    key join, so the join carries counts, not application rows."""
    per_cust = (prev.where(F.col(channel_col).isNotNull())
                    .groupBy(KEY, F.col(channel_col).alias("channel")).agg(F.count(F.lit(1)).alias("n")))
    seg = scored.select(KEY, segment_label().alias("segment_label"))
    g = per_cust.join(seg, KEY).groupBy("segment_label", "channel").agg(F.sum("n").alias("n_applications"))
    return g.withColumn("share_in_segment",
                        F.col("n_applications") / F.sum("n_applications").over(Window.partitionBy("segment_label")))
