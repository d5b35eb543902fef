"""Registered queries: profiling marts, dashboard marts, declared extra features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import KEY
from ..operators import marts as MT
from ..operators import extras as X
from ..operators.cleaning import clean_application
from ..sources.roles import role
from . import master as M
from .oracle import income_band_index_sql, income_band_sql, r4, segment_label_sql, with_ctes
from .registry import register


def app_clean(spark, sf):
    """C8 cleaned application, written once per session (four marts and the
    cohort tests read it; the imputation needs two statistics passes)."""
    return M.materialized(spark, ("app_clean", sf),
                          lambda: clean_application(role(spark, sf, "application")),
                          store=False)


def scored(spark, sf):
    return M.scored_table(spark, sf)


@register("a10_cohort_comparison", with_ctes(f"""
SELECT CASE WHEN AGE_YEARS < 35 THEN 1 ELSE 0 END AS is_young, count(*) AS sample_size,
 {r4('avg(AGE_YEARS)')} AS avg_age, {r4('avg(AMT_INCOME_TOTAL)')} AS avg_income,
 {r4('avg(FLAG_OWN_REALTY) * 100')} AS owns_realty_pct, {r4('avg(FLAG_OWN_CAR) * 100')} AS owns_car_pct,
 {r4('avg(CNT_CHILDREN)')} AS avg_children, {r4('avg(IS_UNEMPLOYED) * 100')} AS unemployed_pct,
 {r4('avg(TARGET) * 100')} AS default_rate_pct, {r4('avg(AMT_CREDIT)')} AS avg_credit
FROM app_clean GROUP BY 1""", "app_clean"))
def q_a10(spark, sf):
    """Young vs mature cohort comparison on the cleaned application."""
    return MT.cohort_comparison(app_clean(spark, sf))


@register("a12_median_income_by_housing", with_ctes(f"""
SELECT NAME_HOUSING_TYPE, {r4('median(AMT_INCOME_TOTAL)')} AS median_value,
 contains(lower(NAME_HOUSING_TYPE), 'house') OR contains(lower(NAME_HOUSING_TYPE), 'apartment') AS is_dwelling FROM app_clean
WHERE AGE_YEARS < 35 AND NAME_HOUSING_TYPE IS NOT NULL GROUP BY 1""", "app_clean"))
def q_a12(spark, sf):
    """Median income by housing type within the young cohort."""
    return MT.median_by_category(app_clean(spark, sf).where(F.col("AGE_YEARS") < 35),
                                 "NAME_HOUSING_TYPE", "AMT_INCOME_TOTAL")


@register("a13_contract_type_top10", with_ctes("""
SELECT NAME_CONTRACT_TYPE AS value, count(*) AS n FROM previous_application WHERE NAME_CONTRACT_TYPE IS NOT NULL
GROUP BY 1 ORDER BY n DESC, value LIMIT 10""", "previous_application"))
def q_a13(spark, sf):
    """Contract-type frequency (channel proxy), top 10."""
    return MT.frequency_table(role(spark, sf, "previous_application"), "NAME_CONTRACT_TYPE", 10)


@register("a14_tier_target_crosstab", with_ctes(f"""
SELECT tier AS row_value, TARGET AS col_value, count(*) AS n,
 {r4('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY tier)')} AS row_share
FROM scored GROUP BY tier, TARGET""", "scored"))
def q_a14(spark, sf):
    """Row-normalized cross-tab tier × outcome."""
    return MT.crosstab_normalized(scored(spark, sf), "tier", "TARGET")


TIER_OUTCOME_SQL = with_ctes(f"""
SELECT d.tier, d.tier_order, CAST(coalesce(a.n_customers, 0) AS BIGINT) AS n_customers,
 {r4('a.default_rate')} AS default_rate, {r4('a.avg_income')} AS avg_income,
 {r4('a.avg_composite')} AS avg_composite, {r4('a.young_pct')} AS young_pct
FROM tiers d LEFT JOIN (SELECT tier, count(SK_ID_CURR) AS n_customers, avg(TARGET) AS default_rate,
   avg(income_total) AS avg_income, avg(composite_score) AS avg_composite, avg(IS_YOUNG) AS young_pct
   FROM scored GROUP BY tier) a USING (tier)""", "scored", "tiers")


@register("a15_tier_outcome", TIER_OUTCOME_SQL)
def q_a15(spark, sf):
    """A15 (flagship): outcome by composite tier with empty tiers kept."""
    return MT.tier_outcome(scored(spark, sf))


@register("a16_ownership_by_age_band", with_ctes(f"""
SELECT d.age_band, d.band_order, CAST(coalesce(a.n, 0) AS BIGINT) AS n, {r4('a.ownership_pct')} AS ownership_pct
FROM (VALUES ('(20, 25]', 0, 20, 25), ('(25, 30]', 1, 25, 30), ('(30, 35]', 2, 30, 35), ('(35, 40]', 3, 35, 40),
  ('(40, 45]', 4, 40, 45), ('(45, 50]', 5, 45, 50), ('(50, 55]', 6, 50, 55), ('(55, 60]', 7, 55, 60),
  ('(60, 70]', 8, 60, 70)) d(age_band, band_order, lo, hi)
LEFT JOIN (SELECT b.age_band, count(*) AS n, avg(c.FLAG_OWN_REALTY) * 100 AS ownership_pct FROM app_clean c
  JOIN (VALUES ('(20, 25]', 20, 25), ('(25, 30]', 25, 30), ('(30, 35]', 30, 35), ('(35, 40]', 35, 40),
  ('(40, 45]', 40, 45), ('(45, 50]', 45, 50), ('(50, 55]', 50, 55), ('(55, 60]', 55, 60), ('(60, 70]', 60, 70))
  b(age_band, lo, hi) ON c.AGE_YEARS > b.lo AND c.AGE_YEARS <= b.hi GROUP BY b.age_band) a USING (age_band)""",
                                                      "app_clean"))
def q_a16(spark, sf):
    """Property ownership by right-closed age band, empty bands kept."""
    return MT.ownership_by_age_band(app_clean(spark, sf))


DIMS = ["income_stability_score", "spending_discipline_score", "savings_consistency_score",
        "debt_burden_score", "asset_signal_score", "behavioral_score"]


@register("a17_dimension_means_by_cohort", with_ctes(
    "\nUNION ALL ".join(f"SELECT IS_YOUNG, '{d}' AS dimension, {r4(f'avg({d})')} AS mean_score FROM scored GROUP BY IS_YOUNG"
                        for d in DIMS), "scored"))
def q_a17(spark, sf):
    """Mean of each dimension score per cohort, long form."""
    return MT.dimension_means(scored(spark, sf), "IS_YOUNG")


@register("a17_dimension_means_by_tier", with_ctes(
    "\nUNION ALL ".join(f"SELECT tier, '{d}' AS dimension, {r4(f'avg({d})')} AS mean_score FROM scored GROUP BY tier"
                        for d in DIMS), "scored"))
def q_a17t(spark, sf):
    """Mean of each dimension score per tier, long form."""
    return MT.dimension_means(scored(spark, sf), "tier")


@register("a19_age_histogram", with_ctes("""
SELECT CAST(floor(AGE_YEARS / 2) * 2 AS BIGINT) AS age_bin, IS_YOUNG, count(DISTINCT SK_ID_CURR) AS n_customers
FROM scored WHERE AGE_YEARS BETWEEN 18 AND 70 GROUP BY 1, 2""", "scored"))
def q_a19(spark, sf):
    """2-year age histogram in the 18–70 range by cohort."""
    return MT.age_histogram(scored(spark, sf))


@register("a19_score_histogram", with_ctes("""
SELECT CAST(least(floor(composite_score / 2.0), 49) AS INTEGER) AS score_bin, IS_YOUNG, count(*) AS n
FROM scored GROUP BY 1, 2""", "scored"))
def q_a19s(spark, sf):
    """Composite score histogram (50 bins) by cohort."""
    return MT.score_histogram(scored(spark, sf))


@register("a19_age_chart_histogram", with_ctes("""
SELECT CAST(least(20 + floor((AGE_YEARS - 20) / 2) * 2, 72) AS BIGINT) AS age_bin, IS_YOUNG, count(*) AS n_customers
FROM scored WHERE AGE_YEARS >= 20 AND AGE_YEARS <= 74 GROUP BY 1, 2""", "scored"))
def q_a19_chart(spark, sf):
    """Age chart, 2-year bins from 20 to 74 by cohort."""
    return MT.age_chart_histogram(scored(spark, sf))


@register("a19_score_range_histogram", with_ctes(f"""
SELECT score_bin, {r4('lo + score_bin * (hi - lo) / 50')} AS bin_start, count(*) AS n FROM (
 SELECT lo, hi, CAST(least(floor((composite_score - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS score_bin
 FROM scored, (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi
               FROM (SELECT min(composite_score) AS a, max(composite_score) AS b FROM scored) r) e
 WHERE composite_score IS NOT NULL) t GROUP BY score_bin, lo, hi""", "scored"))
def q_a19_range(spark, sf):
    """Composite score chart, 50 bins over the data's range."""
    return MT.score_range_histogram(scored(spark, sf))


@register("a20_box_stats_by_tier", with_ctes(f"""
SELECT s.tier, {r4('q1')} AS q1, {r4('med')} AS median, {r4('q3')} AS q3,
 {r4('min(CASE WHEN composite_score >= q1 - 1.5 * (q3 - q1) THEN composite_score END)')} AS whisker_low,
 {r4('max(CASE WHEN composite_score <= q3 + 1.5 * (q3 - q1) THEN composite_score END)')} AS whisker_high,
 CAST(count_if(composite_score < q1 - 1.5 * (q3 - q1) OR composite_score > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers,
 count(composite_score) AS n
FROM scored s JOIN (SELECT tier, quantile_cont(composite_score, 0.25) AS q1, quantile_cont(composite_score, 0.5) AS med,
  quantile_cont(composite_score, 0.75) AS q3 FROM scored GROUP BY tier) q USING (tier)
GROUP BY s.tier, q1, med, q3""", "scored"))
def q_a20(spark, sf):
    """Box-plot statistics of the composite score per tier."""
    return MT.box_stats(scored(spark, sf), "composite_score", "tier")


@register("a21_score_matrix", with_ctes(f"""
SELECT {income_band_sql()} AS income_band, {segment_label_sql()} AS segment_label,
 {r4('avg(composite_score)')} AS avg_score, count(*) AS n FROM scored GROUP BY 1, 2""", "scored"))
def q_a21(spark, sf):
    """Average score per income band × segment."""
    return MT.score_matrix(scored(spark, sf))


@register("a21_tier_income_matrix", with_ctes(f"""
SELECT {income_band_sql()} AS income_band, tier, {r4('avg(composite_score)')} AS avg_score, count(*) AS n
FROM scored GROUP BY 1, 2""", "scored"))
def q_a21_tier(spark, sf):
    """Average score per income band × tier."""
    return MT.tier_income_matrix(scored(spark, sf))


@register("a22_segment_mix", with_ctes(f"""
SELECT segment_label, n_customers, {r4('CAST(n_customers AS DOUBLE) / sum(n_customers) OVER () * 100')} AS pct_of_total
FROM (SELECT {segment_label_sql()} AS segment_label, count(DISTINCT SK_ID_CURR) AS n_customers FROM scored GROUP BY 1) t""",
                                         "scored"))
def q_a22(spark, sf):
    """Segment mix with percent of total."""
    return MT.segment_mix(scored(spark, sf))


@register("a23_kpi_cards", with_ctes(f"""
SELECT count(DISTINCT SK_ID_CURR) AS total_customers, {r4('avg(composite_score)')} AS avg_score,
 {r4('avg(IS_YOUNG) * 100')} AS pct_young, {r4('avg(owns_realty) * 100')} AS pct_own_home,
 {r4("avg(CASE WHEN tier = 'Ready' THEN 1.0 ELSE 0.0 END) * 100")} AS pct_ready FROM scored""", "scored"))
def q_a23(spark, sf):
    """Dashboard KPI cards."""
    return MT.kpi_cards(scored(spark, sf))


@register("a24_dimension_extremes", with_ctes(f"""
SELECT arg_max(dimension, m) AS highest_dimension, {r4('max(m)')} AS highest_mean,
 arg_min(dimension, m) AS lowest_dimension, {r4('min(m)')} AS lowest_mean FROM (
""" + "\nUNION ALL ".join(f"SELECT '{d}' AS dimension, avg({d}) AS m FROM scored" for d in DIMS) + ") t", "scored"))
def q_a24(spark, sf):
    """Highest / lowest average dimension."""
    return MT.dimension_extremes(scored(spark, sf))


@register("a25_tier_distribution", with_ctes("""
SELECT d.tier, d.tier_order, CAST(coalesce(a.n, 0) AS BIGINT) AS n_customers FROM tiers d
LEFT JOIN (SELECT tier, count(DISTINCT SK_ID_CURR) AS n FROM scored GROUP BY tier) a USING (tier)""", "scored", "tiers"))
def q_a25(spark, sf):
    """Tier distribution in declared order."""
    return MT.tier_distribution(scored(spark, sf))


@register("a26_unmet_demand", with_ctes("""
SELECT CAST(count_if(AGE_YEARS < 35 AND owns_realty = 0) AS BIGINT) AS young_no_home,
 CAST(count_if(NOT (AGE_YEARS < 35 AND owns_realty = 0)) AS BIGINT) AS rest FROM scored""", "scored"))
def q_a26(spark, sf):
    """Young renters vs the rest."""
    return MT.unmet_demand(scored(spark, sf))


@register("a28_global_rates", with_ctes(f"""
SELECT count(*) AS n_customers, {r4('avg(TARGET)')} AS default_rate, 48 AS n_features FROM scored""", "scored"))
def q_a28(spark, sf):
    """Global default rate and model feature count."""
    from ..operators.models import model_feature_columns
    feats = model_feature_columns(M.model_table(spark, sf))
    return MT.global_rates(scored(spark, sf), len(feats))


@register("w4_tier_radar", with_ctes(f"""
SELECT tier, {r4('avg_income')} AS avg_income, {r4('default_rate')} AS default_rate,
 {r4('avg_income / max(avg_income) OVER ()')} AS avg_income_norm,
 {r4('default_rate / max(default_rate) OVER ()')} AS default_rate_norm FROM (
 SELECT tier, avg(income_total) AS avg_income, avg(TARGET) AS default_rate FROM scored GROUP BY tier) t""", "scored"))
def q_w4(spark, sf):
    """Tier profile normalized by column maximum (radar data)."""
    prof = scored(spark, sf).groupBy("tier").agg(F.avg("income_total").alias("avg_income"),
                                                 F.avg("TARGET").alias("default_rate"))
    return MT.radar_normalized(prof, ["avg_income", "default_rate"])


@register("o1_dim_customer_profile", with_ctes(f"""
SELECT SK_ID_CURR, {r4('AGE_YEARS')} AS AGE_YEARS, IS_YOUNG, {r4('income_total')} AS income_total, owns_car, owns_realty,
 {r4('years_employed')} AS years_employed, {r4('income_bracket')} AS income_bracket,
 {r4('composite_score')} AS composite_score, tier, {segment_label_sql()} AS segment_label,
 {income_band_sql()} AS income_band FROM scored""", "scored"))
def q_o1(spark, sf):
    """O1: customer dimension for the dashboards (with score, tier, segment)."""
    return MT.customer_dim(scored(spark, sf))


@register("o2_fact_behavioral_features", with_ctes(
    "SELECT SK_ID_CURR, " + ", ".join(f"{r4(d)} AS {d}" for d in DIMS)
    + f", {r4('composite_score')} AS composite_score, tier FROM scored", "scored"))
def q_o2(spark, sf):
    """O2: behaviour fact (six scores, composite, tier)."""
    return MT.behavior_fact(scored(spark, sf))


@register("j10_balance_proxy", with_ctes(f"""
SELECT c.SK_ID_CURR, c.age_band, c.income_band_idx, {r4('d.balance_proxy')} AS balance_proxy FROM
 (SELECT SK_ID_CURR, CAST(floor(AGE_YEARS / 10) AS INTEGER) AS age_band, {income_band_index_sql()} AS income_band_idx FROM scored) c
 LEFT JOIN (SELECT CAST(floor(age / 10) AS INTEGER) AS age_band, income_band AS income_band_idx, avg(balance) AS balance_proxy
   FROM bank_marketing GROUP BY 1, 2) d USING (age_band, income_band_idx)""", "scored", "bank_marketing"))
def q_j10(spark, sf):
    """Survey balance by (age band × income band) attached to customers."""
    return MT.balance_proxy(scored(spark, sf), role(spark, sf, "bank_marketing"))


# ------------------------------------------------------------------ declared features (tag D)
@register("d_declared_features", with_ctes(f"""
SELECT a.SK_ID_CURR,
 {r4('i.income_stability_cv')} AS income_stability_cv, {r4('c.non_essential_spending_ratio')} AS non_essential_spending_ratio,
 {r4('c.credit_utilization_trend')} AS credit_utilization_trend, p.months_since_last_overdue,
 b.credit_inquiry_recency, {r4('v.application_frequency')} AS application_frequency,
 v.contract_type_diversity
FROM application a
LEFT JOIN (SELECT SK_ID_CURR, stddev_samp(AMT_PAYMENT) / avg(AMT_PAYMENT) AS income_stability_cv
   FROM installments_payments GROUP BY 1) i USING (SK_ID_CURR)
LEFT JOIN (SELECT SK_ID_CURR,
   sum(coalesce(AMT_DRAWINGS_ATM_CURRENT, 0) + coalesce(AMT_DRAWINGS_OTHER_CURRENT, 0)) / CASE WHEN sum(AMT_DRAWINGS_CURRENT) IS NOT NULL THEN greatest(sum(AMT_DRAWINGS_CURRENT), 1) END AS non_essential_spending_ratio,
   regr_slope(AMT_BALANCE / CASE WHEN AMT_CREDIT_LIMIT_ACTUAL IS NOT NULL THEN greatest(AMT_CREDIT_LIMIT_ACTUAL, 1) END, MONTHS_BALANCE) AS credit_utilization_trend
   FROM credit_card_balance GROUP BY 1) c USING (SK_ID_CURR)
LEFT JOIN (SELECT SK_ID_CURR, -max(CASE WHEN SK_DPD > 0 THEN MONTHS_BALANCE END) AS months_since_last_overdue
   FROM pos_cash_balance GROUP BY 1) p USING (SK_ID_CURR)
LEFT JOIN (SELECT SK_ID_CURR, -max(DAYS_CREDIT) AS credit_inquiry_recency FROM bureau GROUP BY 1) b USING (SK_ID_CURR)
LEFT JOIN (SELECT SK_ID_CURR, count(*) / greatest((max(DAYS_DECISION) - min(DAYS_DECISION)) / 365.25::DOUBLE, 1.0::DOUBLE) AS application_frequency,
   count(DISTINCT NAME_CONTRACT_TYPE) AS contract_type_diversity FROM previous_application GROUP BY 1) v USING (SK_ID_CURR)""",
    "application", "installments_payments", "credit_card_balance", "pos_cash_balance", "bureau", "previous_application"))
def q_declared(spark, sf):
    """D list + W5 + W6: declared-only features built as per-customer aggregates."""
    roles = M.load(spark, sf)
    return X.declared_features(roles)


@register("s7_csv_sink_customer_dim", with_ctes(f"""
SELECT SK_ID_CURR, {r4('AGE_YEARS')} AS AGE_YEARS, IS_YOUNG, {r4('income_total')} AS income_total, owns_car, owns_realty,
 {r4('years_employed')} AS years_employed, {r4('income_bracket')} AS income_bracket,
 {r4('composite_score')} AS composite_score, tier, {segment_label_sql()} AS segment_label,
 {income_band_sql()} AS income_band FROM scored""", "scored"))
def q_s7(spark, sf):
    """Customer dimension exported as CSV for the BI tool and read back."""
    from ..sources import io as IO
    import hashlib
    dim = MT.customer_dim(scored(spark, sf))
    path = IO.write_csv(dim, IO.shared_path(spark, "dim_customer_" + hashlib.sha1(sf.encode()).hexdigest()[:10]))
    return IO.read_csv(spark, path, dim.schema)


@register("c6_label_encode", with_ctes("""
SELECT SK_ID_CURR, CAST(dense_rank() OVER (ORDER BY coalesce(CODE_GENDER, 'nan')) - 1 AS INTEGER) AS CODE_GENDER_enc,
 CAST(dense_rank() OVER (ORDER BY coalesce(NAME_EDUCATION_TYPE, 'nan')) - 1 AS INTEGER) AS NAME_EDUCATION_TYPE_enc
FROM application""", "application"))
def q_c6(spark, sf):
    """Label encoding in sorted order (null → "nan")."""
    from ..operators.cleaning import label_encode
    app = role(spark, sf, "application").select(KEY, "CODE_GENDER", "NAME_EDUCATION_TYPE")
    return label_encode(app, ["CODE_GENDER", "NAME_EDUCATION_TYPE"])


_HOUSING = ["Co-op apartment", "House / apartment", "Municipal apartment", "Rented apartment", "With parents"]


@register("c7_onehot_drop_first", with_ctes(
    "SELECT SK_ID_CURR, " + ", ".join(
        f"CASE WHEN NAME_HOUSING_TYPE = '{v}' THEN 1 ELSE 0 END AS \"NAME_HOUSING_TYPE_{v}\"" for v in _HOUSING[1:])
    + " FROM application", "application"))
def q_c7(spark, sf):
    """One-hot encoding dropping the first sorted category."""
    from ..operators.cleaning import onehot_drop_first
    return onehot_drop_first(role(spark, sf, "application").select(KEY, "NAME_HOUSING_TYPE"), ["NAME_HOUSING_TYPE"])


@register("p13_filtered_kpis", with_ctes(f"""
SELECT count(SK_ID_CURR) AS total_customers, {r4('avg(composite_score)')} AS avg_score,
 {r4('avg(IS_YOUNG) * 100')} AS pct_young, {r4('avg(owns_realty) * 100')} AS pct_own_home,
 {r4("avg(CASE WHEN tier = 'Ready' THEN 1.0 ELSE 0.0 END) * 100")} AS pct_ready
FROM scored WHERE AGE_YEARS BETWEEN 18 AND 70 AND {segment_label_sql()} = 'Young Renter'""", "scored"))
def q_p13(spark, sf):
    """KPI cards under the dashboard filters (age 18–70, one segment)."""
    return MT.kpi_cards(MT.dashboard_filter(scored(spark, sf), "Young Renter"))


@register("j9_dim_fact", with_ctes(f"""
SELECT SK_ID_CURR, {r4('AGE_YEARS')} AS AGE_YEARS, IS_YOUNG, {r4('income_total')} AS income_total, owns_car, owns_realty,
 {r4('years_employed')} AS years_employed, {r4('income_bracket')} AS income_bracket,
 {r4('composite_score')} AS composite_score, tier, {segment_label_sql()} AS segment_label,
 {income_band_sql()} AS income_band, """ + ", ".join(f"{r4(d)} AS {d}" for d in DIMS) + """ FROM scored""", "scored"))
def q_j9(spark, sf):
    """Customer dimension joined to the behaviour fact on the key."""
    s = scored(spark, sf)
    return MT.dim_fact(MT.customer_dim(s), MT.behavior_fact(s))


@register("m32_channel_by_segment", with_ctes(f"""
SELECT segment_label, channel, n_applications,
 {r4('CAST(n_applications AS DOUBLE) / sum(n_applications) OVER (PARTITION BY segment_label)')} AS share_in_segment FROM (
 SELECT {segment_label_sql()} AS segment_label, p.NAME_CONTRACT_TYPE AS channel, count(*) AS n_applications
 FROM previous_application p JOIN scored s USING (SK_ID_CURR) WHERE p.NAME_CONTRACT_TYPE IS NOT NULL GROUP BY 1, 2) t""",
    "previous_application", "scored"))
def q_m32(spark, sf):
    """Channel-proxy mix per customer segment (channel column found by keyword)."""
    from ..functions.exprs import columns_by_keywords
    prev = role(spark, sf, "previous_application")
    channel = columns_by_keywords(prev, ["CHANNEL", "SELLER", "CLIENT", "TYPE"])[0]
    return MT.channel_by_segment(prev, scored(spark, sf), channel)
