"""Six behavioural dimensions, composite score and tiers.

Each builder is a ``withColumns`` over the customer-grain master: column algebra
only (``coalesce``/``when``/``least``/``greatest``/``try_divide``), no UDF, so
the whole feature path compiles into the same codegen stage as the join.

Order of statistics (as in the analysis being reproduced):
1. ``income_total`` alone is median-filled first and feeds bracket, per-member
   income, surplus and debt ratio; other ratios use the raw income.
2. Scores are computed from otherwise un-imputed inputs.
3. Afterwards every numeric feature (scores included) is median-filled.
Both medians come from one-row aggregates attached by a broadcast cross join,
so the plan stays lazy.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (DIMENSION_SCORES, EDUCATION_DEFAULT, EDUCATION_SCORE, HOUSING_DEFAULT,
                      HOUSING_SCORE, INCOME_BRACKET_BOUNDS, KEY, RAW_FEATURES, TARGET,
                      TIER_BOUNDS, TIER_LABELS, UNEMPLOYED_SENTINEL, DAYS_PER_YEAR)
from ..functions.exprs import bin_right_closed, clean_num, clip_, col_or, map_lookup, ratio, with_scalars
from ..functions.quantiles import quantile_frame, select_quantiles

INCOME_FEATURES = ["income_total", "income_to_credit", "income_to_annuity", "annuity_income_ratio",
                   "years_employed", "is_unemployed", "job_stability_score", "income_bracket",
                   "income_per_family_member", "income_stability_score"]
SPENDING_FEATURES = ["atm_monthly_freq", "credit_utilization", "spending_volatility",
                     "atm_dependency_ratio", "spending_discipline_score"]
SAVINGS_FEATURES = ["dpd_free_ratio", "installment_punctuality", "payment_delay_score",
                    "max_dpd_pos", "estimated_surplus_pct", "savings_consistency_score"]
DEBT_FEATURES = ["debt_to_income", "active_credits", "total_credits", "max_overdue_days",
                 "mean_overdue_days", "days_since_latest_credit", "debt_burden_score"]
ASSET_FEATURES = ["owns_car", "owns_realty", "housing_type_score", "education_score",
                  "asset_signal_score"]
BEHAVIORAL_FEATURES = ["prev_app_count", "prev_approved_ratio", "prev_refused_ratio",
                       "prev_app_amt_mean", "credit_type_count", "behavioral_score"]
ENGINEERED = (INCOME_FEATURES + SPENDING_FEATURES + SAVINGS_FEATURES + DEBT_FEATURES
              + ASSET_FEATURES + BEHAVIORAL_FEATURES)
DEMOGRAPHICS = ["AGE_YEARS", "IS_YOUNG", "CNT_CHILDREN"]
FEATURE_COLUMNS = [KEY, TARGET] + ENGINEERED + DEMOGRAPHICS


def _c01(x):
    """``np.clip(x, 0, 1)``."""
    return clip_(x, 0, 1)


def build_income_stability(df: DataFrame) -> DataFrame:
    """F1 — expects ``__income_med`` (median of raw income) on every row."""
    inc_raw = F.col("AMT_INCOME_TOTAL")
    ann = clip_(F.coalesce(col_or(df, "AMT_ANNUITY", None).cast("double"), F.lit(0.0)), lo=0)
    if "YEARS_EMPLOYED" in df.columns:
        years = F.coalesce(F.col("YEARS_EMPLOYED"), F.lit(0.0))
    elif "DAYS_EMPLOYED" in df.columns:
        d = F.col("DAYS_EMPLOYED")
        years = F.coalesce(F.when(d >= UNEMPLOYED_SENTINEL, None).otherwise(F.abs(d)) / DAYS_PER_YEAR,
                           F.lit(0.0))
    else:
        years = F.lit(0.0)
    fam = (F.coalesce(F.col("CNT_CHILDREN"), F.lit(0)) + F.coalesce(F.col("CNT_FAM_MEMBERS"), F.lit(1.0))
           if "CNT_FAM_MEMBERS" in df.columns else F.coalesce(F.col("CNT_CHILDREN"), F.lit(0)) + 1)
    out = df.withColumns({
        "income_total": F.coalesce(inc_raw, F.col("__income_med")),
        "income_to_credit": clip_(ratio(inc_raw, "AMT_CREDIT"), 0, 20),
        "income_to_annuity": clip_(ratio(inc_raw, ann), 0, 100) if "AMT_ANNUITY" in df.columns else F.lit(None).cast("double"),
        "annuity_income_ratio": clip_(ratio(ann, inc_raw), 0, 1) if "AMT_ANNUITY" in df.columns else F.lit(None).cast("double"),
        "years_employed": clip_(years, 0, 50),
        "is_unemployed": F.coalesce(col_or(df, "IS_UNEMPLOYED", 0), F.lit(0)),
    })
    y = F.col("years_employed")
    out = out.withColumns({
        "job_stability_score": F.when(y < 1, 0).when(y < 3, 1).when(y < 7, 2).otherwise(3),
        "income_bracket": bin_right_closed("income_total", INCOME_BRACKET_BOUNDS,
                                           [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]),
        "income_per_family_member": F.col("income_total") / clip_(fam.cast("double"), lo=1),
    })
    return out.withColumn(
        "income_stability_score",
        F.col("job_stability_score") / 3 * 0.5
        + (1 - F.coalesce(F.col("annuity_income_ratio"), F.lit(0.0))) * 0.3
        + F.coalesce(F.col("income_bracket"), F.lit(0.0)) / 5 * 0.2)


def build_spending_discipline(df: DataFrame) -> DataFrame:
    """card usage → spending discipline (a missing source column counts as 0)."""
    has = set(df.columns)
    atm = clip_("atm_monthly_frequency", 0, 30) if "atm_monthly_frequency" in has else F.lit(0.0)
    util = clip_("cc_utilization", 0, 2) if "cc_utilization" in has else F.lit(0.0)
    vol = (clip_(ratio("cc_balance_std", "cc_balance_mean"), 0, 10)
           if {"cc_balance_std", "cc_balance_mean"} <= has else F.lit(0.0))
    dep = (clip_(F.coalesce(F.col("cc_atm_drawings_total"), F.lit(0.0))
                 / clip_(F.coalesce(F.col("cc_limit_mean"), F.lit(1.0)), lo=1), 0, 5)
           if "cc_atm_drawings_mean" in has else F.lit(0.0))
    out = df.withColumns({"atm_monthly_freq": atm, "credit_utilization": util,
                          "spending_volatility": vol, "atm_dependency_ratio": dep})
    score = ((1 - F.col("credit_utilization")) * 0.35
             + (1 - _c01(F.col("atm_monthly_freq") / 10)) * 0.25
             + (1 - _c01(F.col("spending_volatility") / 5)) * 0.25
             + (1 - _c01(F.col("atm_dependency_ratio") / 3)) * 0.15)
    return out.withColumn("spending_discipline_score", _c01(score))


def build_savings_consistency(df: DataFrame) -> DataFrame:
    """delinquency-free share, punctuality, delay score, surplus."""
    has = set(df.columns)
    inc = clip_("income_total", lo=1)
    delay = (_c01(1 - (F.coalesce(F.col("inst_payment_delay_mean"), F.lit(0.0)) + 30) / 60)
             if "inst_payment_delay_mean" in has else F.lit(0.5))
    ann_pct = (F.coalesce(F.col("AMT_ANNUITY"), F.lit(0.0)) / 12 / inc * 100
               if "AMT_ANNUITY" in has else F.lit(20.0))
    cc_pct = (F.coalesce(F.col("cc_payment_mean"), F.lit(0.0)) / inc * 100
              if "cc_payment_mean" in has else F.lit(10.0))
    out = df.withColumns({
        "dpd_free_ratio": F.coalesce(col_or(df, "pos_dpd_zero_ratio", 1.0), F.lit(1.0)),
        "installment_punctuality": F.coalesce(col_or(df, "inst_on_time_ratio", 0.0), F.lit(0.0)),
        "payment_delay_score": delay,
        "max_dpd_pos": clip_(F.coalesce(col_or(df, "pos_sk_dpd_max", 0), F.lit(0)), 0, 365),
        "estimated_surplus_pct": _c01(1 - ann_pct / 100 - cc_pct / 100),
    })
    score = (F.col("dpd_free_ratio") * 0.30 + F.col("installment_punctuality") * 0.30
             + F.col("payment_delay_score") * 0.25 + F.col("estimated_surplus_pct") * 0.15)
    return out.withColumn("savings_consistency_score", _c01(score))


def build_debt_burden(df: DataFrame) -> DataFrame:
    """debt-to-income, active credits, overdue history."""
    has = set(df.columns)
    inc = clip_("income_total", lo=1)
    dti = (clip_(F.try_divide(F.col("bureau_debt_sum_mean"), inc), 0, 20)
           if "bureau_debt_sum_mean" in has else clip_(F.try_divide(F.col("AMT_CREDIT"), inc), 0, 20))
    out = df.withColumns({
        "debt_to_income": dti,
        "active_credits": F.coalesce(col_or(df, "bureau_active_count", 0), F.lit(0)),
        "total_credits": F.coalesce(col_or(df, "bureau_credit_count", 0), F.lit(0)),
        "max_overdue_days": F.coalesce(col_or(df, "bureau_max_overdue_days", 0), F.lit(0)),
        "mean_overdue_days": F.coalesce(col_or(df, "bureau_mean_overdue_days", 0.0), F.lit(0.0)),
        "days_since_latest_credit": F.coalesce(col_or(df, "bureau_days_since_latest", -9999), F.lit(-9999)),
    })
    score = ((1 - _c01(F.col("debt_to_income") / 5)) * 0.40
             + (1 - _c01(F.col("active_credits") / 10)) * 0.25
             + (1 - _c01(F.col("max_overdue_days") / 365)) * 0.35)
    return out.withColumn("debt_burden_score", _c01(score))


def build_asset_signal(df: DataFrame) -> DataFrame:
    """ownership flags, housing and education ordinals, income bracket."""
    def own(c):
        if c not in df.columns:
            return F.lit(0)
        s = F.coalesce(F.col(c).cast("string"), F.lit("N"))
        return F.when(s.isin("Y", "1"), 1).when(s.isin("N", "0"), 0)
    out = df.withColumns({
        "owns_car": own("FLAG_OWN_CAR"),
        "owns_realty": own("FLAG_OWN_REALTY"),
        "housing_type_score": (map_lookup("NAME_HOUSING_TYPE", HOUSING_SCORE, HOUSING_DEFAULT)
                               if "NAME_HOUSING_TYPE" in df.columns else F.lit(HOUSING_DEFAULT)),
        "education_score": (map_lookup("NAME_EDUCATION_TYPE", EDUCATION_SCORE, EDUCATION_DEFAULT)
                            if "NAME_EDUCATION_TYPE" in df.columns else F.lit(EDUCATION_DEFAULT)),
    })
    score = (F.col("owns_realty") * 0.35 + F.col("owns_car") * 0.15
             + F.col("housing_type_score") * 0.25 + F.col("education_score") * 0.15
             + F.coalesce(F.col("income_bracket"), F.lit(0.0)) / 5 * 0.10)
    return out.withColumn("asset_signal_score", _c01(score))


def build_behavioral(df: DataFrame) -> DataFrame:
    """application history."""
    out = df.withColumns({
        "prev_app_count": F.coalesce(col_or(df, "prev_app_count", 0), F.lit(0)),
        "prev_approved_ratio": F.coalesce(col_or(df, "prev_approved_ratio", 0.0), F.lit(0.0)),
        "prev_refused_ratio": F.coalesce(col_or(df, "prev_refused_ratio", 0.0), F.lit(0.0)),
        "prev_app_amt_mean": F.coalesce(col_or(df, "prev_app_amt_mean", 0.0), F.lit(0.0)),
        "credit_type_count": F.coalesce(col_or(df, "bureau_credit_count", 0), F.lit(0)),
    })
    score = (F.col("prev_approved_ratio") * 0.45 + (1 - F.col("prev_refused_ratio")) * 0.30
             + (1 - _c01(F.col("prev_app_count") / 20)) * 0.25)
    return out.withColumn("behavioral_score", _c01(score))


def build_features_unfilled(master: DataFrame) -> DataFrame:
    """F1–F6 + demographics, before the final median fill."""
    med = quantile_frame(master, [("AMT_INCOME_TOTAL", 0.5, "__income_med")])
    df = with_scalars(master, med)
    for step in (build_income_stability, build_spending_discipline, build_savings_consistency,
                 build_debt_burden, build_asset_signal, build_behavioral):
        df = step(df)
    demo = {
        "AGE_YEARS": col_or(df, "AGE_YEARS", None).cast("double"),
        "IS_YOUNG": col_or(df, "IS_YOUNG", None).cast("int"),
        "CNT_CHILDREN": col_or(df, "CNT_CHILDREN", 0),
    }
    df = df.withColumns(demo)
    target = [F.col(TARGET)] if TARGET in df.columns else []
    return df.select(F.col(KEY), *target, *ENGINEERED, *DEMOGRAPHICS)


def build_all_features(master: DataFrame, store=None) -> DataFrame:
    """features with ±inf → null and every numeric feature median-filled.

    ``store`` writes the pre-fill table and reads it back, so the passes over it —
    gaps, medians, fill — do not recompute the child aggregates and the join chain."""
    pre = build_features_unfilled(master)
    cols = [f for f in pre.schema.fields if f.name not in (KEY, TARGET)]
    pre = pre.withColumns({f.name: clean_num(f.name) for f in cols
                           if f.dataType.typeName() in ("double", "float")})
    if store:
        pre = store(pre)
    # a whole-number feature with gaps becomes double, as its median can be fractional
    whole = [f.name for f in cols if f.dataType.typeName() in ("integer", "long", "short", "byte")]
    gaps = pre.agg(F.count(F.lit(1)), *[F.count_if(F.col(c).isNull()).alias(c) for c in whole]).first()
    kinds = {f.name: "double" if f.name in whole and gaps[f.name] else f.dataType for f in cols}
    medians = select_quantiles(pre, [(f.name, 0.5) for f in cols])
    return pre.withColumns({f.name: F.coalesce(F.col(f.name), F.lit(m).cast(kinds[f.name])) for f, m in zip(cols, medians)})


def composite_score(features: DataFrame, weights: dict | None = None) -> F.Column:
    """F8: Σ coalesce(score, 0)·w ×100 clipped to [0, 100]; absent scores skipped."""
    weights = weights or {c: 1 / 6 for c in DIMENSION_SCORES}
    total = F.lit(0.0)
    for c, w in weights.items():
        if c in features.columns:
            total = total + F.coalesce(F.col(c), F.lit(0.0)) * w
    return clip_(total * 100, 0, 100)


def tier_of(score) -> F.Column:
    """[0,30] Exploring, (30,55] Building, (55,75] Almost Ready, (75,100] Ready."""
    return bin_right_closed(score, TIER_BOUNDS, TIER_LABELS, include_lowest=True)


def tier_ordinal(tier) -> F.Column:
    return map_lookup(tier, {lab: i for i, lab in enumerate(TIER_LABELS)})


def score_features(features: DataFrame, weights: dict | None = None) -> DataFrame:
    """F8 + F9 on the feature table."""
    out = features.withColumn("composite_score", composite_score(features, weights))
    return out.withColumn("tier", tier_of("composite_score"))


def append_raw_features(master: DataFrame, features: DataFrame) -> DataFrame:
    """attach the 29 raw aggregates (null → 0, absent → 0) by key join.
    Both sides are customer-grain and partitioned on the key."""
    existing = set(features.columns)
    add = [c for c in RAW_FEATURES if c not in existing]
    raw = master.select(F.col(KEY), *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in master.columns
                                      else F.lit(0).alias(c) for c in add])
    return features.join(raw, KEY, "left")
