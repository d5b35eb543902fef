"""Registered queries: sources, child aggregates, master, cleaning, features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import KEY
from ..operators import aggregates as A
from ..operators import quality as Q
from ..operators.cleaning import (clean_application, outlier_report,
                                  recode_days_birth, recode_days_employed)
from ..sources.roles import load_roles, role
from . import master as M
from .oracle import FEATURE_TYPES, r4, rounded_select, with_ctes
from .registry import register

# ------------------------------------------------------------------ S: scans
APP_TYPES = {"SK_ID_CURR": "BIGINT", "TARGET": "INTEGER", "AMT_INCOME_TOTAL": "DOUBLE",
             "AMT_CREDIT": "DOUBLE", "AMT_ANNUITY": "DOUBLE", "DAYS_EMPLOYED": "INTEGER",
             "DAYS_BIRTH": "INTEGER", "CODE_GENDER": "VARCHAR", "FLAG_OWN_CAR": "VARCHAR",
             "FLAG_OWN_REALTY": "VARCHAR", "FLAG_DOCUMENT_3": "INTEGER", "CNT_CHILDREN": "INTEGER",
             "CNT_FAM_MEMBERS": "DOUBLE", "NAME_HOUSING_TYPE": "VARCHAR",
             "NAME_EDUCATION_TYPE": "VARCHAR", "SPARSE_COL": "DOUBLE"}


@register("s5_application_scan", with_ctes(f"SELECT {rounded_select(APP_TYPES)} FROM application", "application"))
def q_application(spark, sf):
    """Parquet scan through the application role view."""
    return role(spark, sf, "application")


@register("s9_table_inventory", with_ctes("""
SELECT table_name, n_rows, n_cols FROM (
  SELECT 'application' AS table_name, count(*) AS n_rows, CAST(16 AS BIGINT) AS n_cols FROM application
  UNION ALL SELECT 'bureau', count(*), CAST(9 AS BIGINT) FROM bureau
  UNION ALL SELECT 'bureau_balance', count(*), CAST(3 AS BIGINT) FROM bureau_balance
  UNION ALL SELECT 'previous_application', count(*), CAST(8 AS BIGINT) FROM previous_application
  UNION ALL SELECT 'credit_card_balance', count(*), CAST(10 AS BIGINT) FROM credit_card_balance
  UNION ALL SELECT 'installments_payments', count(*), CAST(6 AS BIGINT) FROM installments_payments
  UNION ALL SELECT 'pos_cash_balance', count(*), CAST(5 AS BIGINT) FROM pos_cash_balance
  UNION ALL SELECT 'bank_marketing', count(*), CAST(3 AS BIGINT) FROM bank_marketing) t
UNION ALL SELECT 'TOTAL', CAST(sum(n_rows) AS BIGINT), CAST(sum(n_cols) AS BIGINT) FROM (
  SELECT count(*) AS n_rows, 16 AS n_cols FROM application
  UNION ALL SELECT count(*), 9 FROM bureau UNION ALL SELECT count(*), 3 FROM bureau_balance
  UNION ALL SELECT count(*), 8 FROM previous_application UNION ALL SELECT count(*), 10 FROM credit_card_balance
  UNION ALL SELECT count(*), 6 FROM installments_payments UNION ALL SELECT count(*), 5 FROM pos_cash_balance
  UNION ALL SELECT count(*), 3 FROM bank_marketing) u""",
    "application", "bureau", "bureau_balance", "previous_application", "credit_card_balance",
    "installments_payments", "pos_cash_balance", "bank_marketing"))
def q_inventory(spark, sf):
    """Rows × cols per role and grand total."""
    return Q.table_inventory(load_roles(spark, sf))


# ------------------------------------------------------------------ A: aggregates
def _agg_sql(cte: str, types: dict[str, str]) -> str:
    return with_ctes(f"SELECT {rounded_select(types)} FROM {cte}", cte)


BB_TYPES = {"SK_ID_BUREAU": "BIGINT", "bureau_months_count": "BIGINT",
            "bureau_status_mean": "DOUBLE", "bureau_worst_status": "DOUBLE"}
BUREAU_TYPES = {"SK_ID_CURR": "BIGINT", "bureau_credit_count": "BIGINT", "bureau_active_count": "BIGINT",
                "bureau_credit_sum_mean": "DOUBLE", "bureau_credit_sum_max": "DOUBLE",
                "bureau_credit_sum_min": "DOUBLE", "bureau_debt_sum_mean": "DOUBLE",
                "bureau_debt_sum_max": "DOUBLE", "bureau_debt_overdue_mean": "DOUBLE",
                "bureau_debt_overdue_max": "DOUBLE", "bureau_max_overdue_days": "INTEGER",
                "bureau_mean_overdue_days": "DOUBLE", "bureau_days_since_latest": "INTEGER",
                "bureau_avg_credit_duration": "DOUBLE", "bureau_worst_status": "DOUBLE",
                "bureau_months_avg": "DOUBLE", "bureau_active_ratio": "DOUBLE"}
PREV_TYPES = {"SK_ID_CURR": "BIGINT", "prev_app_count": "BIGINT", "prev_app_approved": "BIGINT",
              "prev_app_refused": "BIGINT", "prev_app_amt_mean": "DOUBLE", "prev_app_amt_max": "DOUBLE",
              "prev_app_amt_min": "DOUBLE", "prev_app_annuity_mean": "DOUBLE",
              "prev_app_days_min": "INTEGER", "prev_app_days_mean": "DOUBLE",
              "prev_nflag_last_appl_day": "BIGINT", "prev_approved_ratio": "DOUBLE",
              "prev_refused_ratio": "DOUBLE"}
CC_TYPES = {"SK_ID_CURR": "BIGINT", "cc_balance_mean": "DOUBLE", "cc_balance_std": "DOUBLE",
            "cc_balance_min": "DOUBLE", "cc_balance_max": "DOUBLE", "cc_limit_mean": "DOUBLE",
            "cc_atm_drawings_mean": "DOUBLE", "cc_atm_drawings_total": "DOUBLE",
            "cc_atm_drawings_freq": "BIGINT", "cc_current_drawings_mean": "DOUBLE",
            "cc_total_drawings_mean": "DOUBLE", "cc_payment_mean": "DOUBLE", "cc_payment_min": "DOUBLE",
            "cc_min_payment_mean": "DOUBLE", "cc_receipt_sum_mean": "DOUBLE", "cc_recency": "INTEGER",
            "cc_month_count": "BIGINT", "cc_utilization": "DOUBLE", "atm_monthly_frequency": "DOUBLE"}
INST_TYPES = {"SK_ID_CURR": "BIGINT", "inst_payment_mean": "DOUBLE", "inst_instalment_mean": "DOUBLE",
              "inst_overpayment_ratio": "DOUBLE", "inst_payment_delay_mean": "DOUBLE",
              "inst_payment_delay_std": "DOUBLE", "inst_days_late_max": "INTEGER",
              "inst_days_early_max": "INTEGER", "inst_on_time_ratio": "DOUBLE",
              "inst_late_ratio": "DOUBLE", "inst_count": "BIGINT"}
POS_TYPES = {"SK_ID_CURR": "BIGINT", "pos_month_count": "BIGINT", "pos_active_contracts": "BIGINT",
             "pos_sk_dpd_mean": "DOUBLE", "pos_sk_dpd_max": "INTEGER", "pos_sk_dpd_def_mean": "DOUBLE",
             "pos_sk_dpd_def_max": "INTEGER", "pos_dpd_zero_ratio": "DOUBLE"}


@register("a1_bureau_balance", _agg_sql("bb_agg", BB_TYPES))
def q_a1(spark, sf):
    return A.aggregate_bureau_balance(role(spark, sf, "bureau_balance"))


@register("a2_bureau", _agg_sql("bureau_agg", BUREAU_TYPES))
def q_a2(spark, sf):
    return A.aggregate_bureau(role(spark, sf, "bureau"), role(spark, sf, "bureau_balance"))


@register("a3_previous_application", _agg_sql("prev_agg", PREV_TYPES))
def q_a3(spark, sf):
    return A.aggregate_previous_application(role(spark, sf, "previous_application"))


@register("a4_credit_card", _agg_sql("cc_agg", CC_TYPES))
def q_a4(spark, sf):
    return A.aggregate_credit_card(role(spark, sf, "credit_card_balance"))


@register("a5_installments", _agg_sql("inst_agg", INST_TYPES))
def q_a5(spark, sf):
    return A.aggregate_installments(role(spark, sf, "installments_payments"))


@register("a6_pos_cash", _agg_sql("pos_agg", POS_TYPES))
def q_a6(spark, sf):
    return A.aggregate_pos_cash(role(spark, sf, "pos_cash_balance"))


MASTER_TYPES = {**APP_TYPES}
for _t in (BUREAU_TYPES, PREV_TYPES, CC_TYPES, INST_TYPES, POS_TYPES):
    MASTER_TYPES.update({k: v for k, v in _t.items() if k != KEY})


@register("j1_master", with_ctes(f"SELECT {rounded_select(MASTER_TYPES)} FROM master", "master"))
def q_master(spark, sf):
    """Application ⟕ five child aggregates (one row per customer)."""
    return M.master_table(spark, sf)


@register("j4_join_coverage", with_ctes("""
SELECT source, matched, n_app, (round(CAST(matched AS DOUBLE) / n_app + 3e-7, 4) + 0.0::DOUBLE) AS match_rate FROM (
  SELECT 'bureau' AS source, count(DISTINCT a.SK_ID_CURR) FILTER (WHERE b.SK_ID_CURR IS NOT NULL) AS matched FROM application a LEFT JOIN bureau_agg b USING (SK_ID_CURR)
  UNION ALL SELECT 'previous_app', count(*) FILTER (WHERE b.SK_ID_CURR IS NOT NULL) FROM application a LEFT JOIN prev_agg b USING (SK_ID_CURR)
  UNION ALL SELECT 'credit_card', count(*) FILTER (WHERE b.SK_ID_CURR IS NOT NULL) FROM application a LEFT JOIN cc_agg b USING (SK_ID_CURR)
  UNION ALL SELECT 'installments', count(*) FILTER (WHERE b.SK_ID_CURR IS NOT NULL) FROM application a LEFT JOIN inst_agg b USING (SK_ID_CURR)
  UNION ALL SELECT 'pos_cash', count(*) FILTER (WHERE b.SK_ID_CURR IS NOT NULL) FROM application a LEFT JOIN pos_agg b USING (SK_ID_CURR)
) t, (SELECT count(*) AS n_app FROM application) n""", "application", "bureau_agg", "prev_agg", "cc_agg", "inst_agg", "pos_agg"))
def q_coverage(spark, sf):
    """True match rate per child aggregate (one pass over the built master)."""
    return Q.join_coverage_from_master(M.master_table(spark, sf))


# ------------------------------------------------------------------ C: cleaning / quality
_DQ_DTYPES = {"SK_ID_CURR": "bigint", "TARGET": "int", "AMT_INCOME_TOTAL": "double", "AMT_CREDIT": "double",
              "AMT_ANNUITY": "double", "DAYS_EMPLOYED": "int", "DAYS_BIRTH": "int", "CODE_GENDER": "string",
              "FLAG_OWN_CAR": "string", "FLAG_OWN_REALTY": "string", "FLAG_DOCUMENT_3": "int",
              "CNT_CHILDREN": "int", "CNT_FAM_MEMBERS": "double", "NAME_HOUSING_TYPE": "string",
              "NAME_EDUCATION_TYPE": "string", "SPARSE_COL": "double"}


def _dq_sql() -> str:
    parts = []
    for c, t in _DQ_DTYPES.items():
        skew = f"CASE WHEN count({c}) >= 3 AND min({c}) = max({c}) THEN 0.0 ELSE skewness(CAST({c} AS DOUBLE)) END" if t != "string" else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS column_name, '{t}' AS dtype, "
                     f"{r4('CAST(count_if(' + c + ' IS NULL) AS DOUBLE) / count(*) * 100')} AS missing_pct, "
                     f"CAST(count_if({c} IS NULL) AS BIGINT) AS missing_n, "
                     f"count(DISTINCT {c}) AS cardinality, {r4(skew)} AS skew FROM application")
    return with_ctes("\nUNION ALL ".join(parts), "application")


@register("c1_data_quality_report", _dq_sql())
def q_dq(spark, sf):
    """One wide aggregate → per-column report."""
    return Q.data_quality_report(role(spark, sf, "application"))


@register("c2_dtype_distribution", with_ctes("""
SELECT dtype, count(*) AS n_columns FROM (SELECT * FROM (VALUES """ + ", ".join(
    f"('{c}', '{t}')" for c, t in _DQ_DTYPES.items()) + """) v(c, dtype)) GROUP BY dtype"""))
def q_dtypes(spark, sf):
    """Columns per dtype from the quality report."""
    return Q.dtype_distribution(Q.data_quality_report(role(spark, sf, "application")))


@register("c10_sentinel_outcome", with_ctes(f"""
SELECT is_sentinel, n, {r4('default_rate')} AS default_rate, {r4('no_default_rate')} AS no_default_rate,
  {r4('CAST(n AS DOUBLE) / sum(n) OVER ()')} AS share FROM (
  SELECT CAST(coalesce(DAYS_EMPLOYED >= 365243, false) AS INTEGER) AS is_sentinel, count(*) AS n,
   avg(CASE WHEN TARGET = 1 THEN 1.0 ELSE 0.0 END) AS default_rate,
   avg(CASE WHEN TARGET = 0 THEN 1.0 ELSE 0.0 END) AS no_default_rate
  FROM application GROUP BY 1) t""", "application"))
def q_sentinel(spark, sf):
    """Sentinel share and default rate per flag."""
    return Q.sentinel_outcome(role(spark, sf, "application"))


CLEAN_TYPES = {"SK_ID_CURR": "BIGINT", "TARGET": "INTEGER", "AMT_INCOME_TOTAL": "DOUBLE",
               "AMT_CREDIT": "DOUBLE", "AMT_ANNUITY": "DOUBLE", "FLAG_OWN_CAR": "INTEGER",
               "FLAG_OWN_REALTY": "INTEGER", "FLAG_DOCUMENT_3": "INTEGER", "CNT_CHILDREN": "INTEGER",
               "CNT_FAM_MEMBERS": "DOUBLE", "NAME_HOUSING_TYPE": "VARCHAR", "NAME_EDUCATION_TYPE": "VARCHAR",
               "YEARS_EMPLOYED": "DOUBLE", "IS_UNEMPLOYED": "INTEGER", "AGE_YEARS": "DOUBLE",
               "IS_YOUNG": "INTEGER", "IS_FEMALE": "INTEGER"}


@register("c8_clean_application", with_ctes(f"SELECT {rounded_select(CLEAN_TYPES)} FROM app_clean", "app_clean"))
def q_clean(spark, sf):
    """Full application cleaning (recodes, flags, >80 % drop, median/mode fill)."""
    return clean_application(role(spark, sf, "application"))


@register("c9_outlier_report", with_ctes(f"""
SELECT column_name, {r4('lo')} AS lower_fence, {r4('hi')} AS upper_fence, n_clipped FROM (
 SELECT 'AMT_INCOME_TOTAL' AS column_name, q1 - 3.0 * (q3 - q1) AS lo, q3 + 3.0 * (q3 - q1) AS hi,
  (SELECT CAST(count_if(AMT_INCOME_TOTAL < q1 - 3.0 * (q3 - q1) OR AMT_INCOME_TOTAL > q3 + 3.0 * (q3 - q1)) AS BIGINT) FROM application) AS n_clipped
 FROM (SELECT quantile_cont(AMT_INCOME_TOTAL, 0.25) AS q1, quantile_cont(AMT_INCOME_TOTAL, 0.75) AS q3 FROM application) a
 UNION ALL
 SELECT 'AMT_CREDIT', q1 - 3.0 * (q3 - q1), q3 + 3.0 * (q3 - q1),
  (SELECT CAST(count_if(AMT_CREDIT < q1 - 3.0 * (q3 - q1) OR AMT_CREDIT > q3 + 3.0 * (q3 - q1)) AS BIGINT) FROM application)
 FROM (SELECT quantile_cont(AMT_CREDIT, 0.25) AS q1, quantile_cont(AMT_CREDIT, 0.75) AS q3 FROM application) b
 UNION ALL
 SELECT 'AMT_ANNUITY', q1 - 3.0 * (q3 - q1), q3 + 3.0 * (q3 - q1),
  (SELECT CAST(count_if(AMT_ANNUITY < q1 - 3.0 * (q3 - q1) OR AMT_ANNUITY > q3 + 3.0 * (q3 - q1)) AS BIGINT) FROM application)
 FROM (SELECT quantile_cont(AMT_ANNUITY, 0.25) AS q1, quantile_cont(AMT_ANNUITY, 0.75) AS q3 FROM application) c
) t""", "application"))
def q_outliers(spark, sf):
    """IQR fences (factor 3) and clipped counts for the money columns."""
    return outlier_report(role(spark, sf, "application"), ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY"])


# ------------------------------------------------------------------ F: features
FEATURES_TYPES = {"SK_ID_CURR": "BIGINT", "TARGET": "INTEGER", **FEATURE_TYPES}
SCORED_TYPES = {**FEATURES_TYPES, "composite_score": "DOUBLE", "tier": "VARCHAR"}


@register("f7_features", with_ctes(f"SELECT {rounded_select(FEATURES_TYPES)} FROM features", "features"))
def q_features(spark, sf):
    """39 engineered features + demographics, median-filled."""
    return M.features_table(spark, sf)


@register("f9_scored", with_ctes(f"SELECT {rounded_select(SCORED_TYPES)} FROM scored", "scored"))
def q_scored(spark, sf):
    """Composite readiness score and tier per customer."""
    return M.scored_table(spark, sf)


MODEL_INPUT_TYPES = {**FEATURES_TYPES}
for _c in __import__("creditlake.config", fromlist=["RAW_FEATURES"]).RAW_FEATURES:
    MODEL_INPUT_TYPES[_c] = MASTER_TYPES[_c]


@register("f10_model_input", with_ctes(f"SELECT {rounded_select(MODEL_INPUT_TYPES)} FROM model_input", "model_input"))
def q_model_input(spark, sf):
    """Features with the 29 raw aggregates appended."""
    return M.model_table(spark, sf)


# demographic recodes on their own
@register("c3_c4_recodes", with_ctes(f"""
SELECT SK_ID_CURR, abs(CASE WHEN DAYS_EMPLOYED >= 365243 THEN NULL ELSE DAYS_EMPLOYED END) AS DAYS_EMPLOYED,
 {r4('abs(CASE WHEN DAYS_EMPLOYED >= 365243 THEN NULL ELSE DAYS_EMPLOYED END) / 365.25::DOUBLE')} AS YEARS_EMPLOYED,
 CASE WHEN DAYS_EMPLOYED >= 365243 THEN 1 ELSE 0 END AS IS_UNEMPLOYED,
 {r4('abs(DAYS_BIRTH) / 365.25::DOUBLE')} AS AGE_YEARS,
 CASE WHEN abs(DAYS_BIRTH) / 365.25::DOUBLE < 35 THEN 1 ELSE 0 END AS IS_YOUNG FROM application""", "application"))
def q_recodes(spark, sf):
    """C3 + C4: sentinel recode, years employed, age, young flag."""
    app = role(spark, sf, "application").select(KEY, "DAYS_EMPLOYED", "DAYS_BIRTH")
    return recode_days_birth(recode_days_employed(app)).drop("DAYS_BIRTH")


# ------------------------------------------------------------------ S: file sources and sinks
from ..sources import io as IO  # noqa: E402

_SPARK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}
APP_DDL = ", ".join(f"{c} {_SPARK_TYPES[t]}" for c, t in APP_TYPES.items())
MARKETING_DDL = "age int, income_band int, balance double"


def _tag(sf: str) -> str:
    import hashlib
    return hashlib.sha1(sf.encode()).hexdigest()[:10]


@register("s1_csv_scan", with_ctes(f"SELECT {rounded_select(APP_TYPES)} FROM application", "application"))
def q_s1(spark, sf):
    """Application written as CSV (derived from the data), scanned back with a
    declared schema (no inference job)."""
    path = IO.write_csv(role(spark, sf, "application"), IO.shared_path(spark, f"application_csv_{_tag(sf)}"))
    return IO.read_csv(spark, path, APP_DDL)


@register("s3_semicolon_csv", with_ctes(
    "SELECT age, income_band, (round(balance + 3e-7, 4) + 0.0::DOUBLE) AS balance FROM bank_marketing", "bank_marketing"))
def q_s3(spark, sf):
    """S3: ';'-separated survey file; an absent file yields an empty frame."""
    path = IO.write_csv(role(spark, sf, "bank_marketing"), IO.shared_path(spark, f"marketing_{_tag(sf)}"), sep=";")
    missing = IO.read_csv_or_empty(spark, path + "_absent", MARKETING_DDL)
    return IO.read_csv_or_empty(spark, path, MARKETING_DDL).unionByName(missing)


@register("s4_schema_only", with_ctes(f"SELECT {rounded_select(APP_TYPES)} FROM application LIMIT 0", "application"))
def q_s4(spark, sf):
    """Schema-only scan (zero rows)."""
    path = IO.write_csv(role(spark, sf, "application"), IO.shared_path(spark, f"application_csv4_{_tag(sf)}"))
    return IO.schema_only(spark, path, APP_DDL)


@register("s8_materialized_master", with_ctes(f"SELECT {rounded_select(MASTER_TYPES)} FROM master", "master"))
def q_s8(spark, sf):
    """S6 + S8: master written once as parquet in the shared folder, reused after."""
    return IO.materialize_or_reuse(spark, IO.shared_path(spark, f"master_{_tag(sf)}_{M.inputs(spark, sf)}"),
                                   lambda: M.master_table(spark, sf))


def _winsor_sql() -> str:
    cols = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY"]
    q = ", ".join(f"quantile_cont({c}, 0.25) AS {c}__q1, quantile_cont({c}, 0.75) AS {c}__q3" for c in cols)
    sel = ", ".join(
        r4(f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {c}__q1 - 3.0 * ({c}__q3 - {c}__q1)), "
           f"{c}__q3 + 3.0 * ({c}__q3 - {c}__q1)) END") + f" AS {c}" for c in cols)
    return with_ctes(f"SELECT SK_ID_CURR, {sel} FROM application, (SELECT {q} FROM application) q", "application")


@register("c9_winsorized_money", _winsor_sql())
def q_c9w(spark, sf):
    """Money columns winsorized to [Q1 − 3·IQR, Q3 + 3·IQR] (clipped, never dropped)."""
    from ..operators.cleaning import remove_outliers_iqr
    app = role(spark, sf, "application").select(KEY, "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY")
    return remove_outliers_iqr(app, ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY"])
