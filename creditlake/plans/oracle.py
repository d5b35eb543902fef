"""Independent DuckDB SQL for the correctness gate.

Every registered Spark query has a hand-written ANSI-SQL twin built from the CTE
blocks below (roles → child aggregates → master → features → scores). The SQL
is written separately from the DataFrame code so the two engines check each
other; only the role-view text (the test-fixture adapter) is shared.
"""
from __future__ import annotations

from ..config import (CONTRACT_STATUS_MAP, EDUCATION_DEFAULT, EDUCATION_SCORE, HOUSING_DEFAULT,
                      HOUSING_SCORE, RAW_FEATURES, TIER_LABELS)
from ..sources.roles import ROLES, role_sql_duckdb


# ------------------------------------------------------------------ helpers
def clip(x: str, lo=None, hi=None) -> str:
    y = f"({x})"
    if lo is not None:
        y = f"greatest({y}, {lo})"
    if hi is not None:
        y = f"least({y}, {hi})"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE {y} END)"


def c01(x: str) -> str:
    return clip(x, 0, 1)


def ratio(num: str, den: str) -> str:
    return f"(({num}) / {clip(den, 1)})"


def r4(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE) + 3e-7, 4) + 0.0::DOUBLE)"


def dbl(v) -> str:
    return f"CAST({v} AS DOUBLE)"


def case_map(x: str, mapping: dict, default=None, as_double=True) -> str:
    whens = " ".join(f"WHEN {x} = '{k}' THEN {dbl(v) if as_double else v}" for k, v in mapping.items())
    d = "NULL" if default is None else (dbl(default) if as_double else default)
    return f"(CASE {whens} ELSE {d} END)"


# ------------------------------------------------------------------ CTE blocks
def _blocks() -> dict[str, tuple[str, list[str]]]:
    b: dict[str, tuple[str, list[str]]] = {r: (role_sql_duckdb(r), []) for r in ROLES}
    b["bb_agg"] = ("""SELECT SK_ID_BUREAU, count(MONTHS_BALANCE) AS bureau_months_count,
  avg(try_cast(STATUS AS DOUBLE)) AS bureau_status_mean, max(try_cast(STATUS AS DOUBLE)) AS bureau_worst_status
  FROM bureau_balance WHERE SK_ID_BUREAU IS NOT NULL GROUP BY SK_ID_BUREAU""", ["bureau_balance"])
    b["bureau_agg"] = (f"""SELECT *, {ratio('bureau_active_count', 'bureau_credit_count')} AS bureau_active_ratio FROM (
  SELECT b.SK_ID_CURR, count(b.SK_ID_BUREAU) AS bureau_credit_count,
   CAST(count_if(b.CREDIT_ACTIVE = 'Active') AS BIGINT) AS bureau_active_count,
   avg(b.AMT_CREDIT_SUM) AS bureau_credit_sum_mean, max(b.AMT_CREDIT_SUM) AS bureau_credit_sum_max,
   min(b.AMT_CREDIT_SUM) AS bureau_credit_sum_min, avg(b.AMT_CREDIT_SUM_DEBT) AS bureau_debt_sum_mean,
   max(b.AMT_CREDIT_SUM_DEBT) AS bureau_debt_sum_max, avg(b.AMT_CREDIT_SUM_OVERDUE) AS bureau_debt_overdue_mean,
   max(b.AMT_CREDIT_SUM_OVERDUE) AS bureau_debt_overdue_max, max(b.CREDIT_DAY_OVERDUE) AS bureau_max_overdue_days,
   avg(b.CREDIT_DAY_OVERDUE) AS bureau_mean_overdue_days, max(b.DAYS_CREDIT) AS bureau_days_since_latest,
   avg(b.DAYS_CREDIT_ENDDATE - b.DAYS_CREDIT) AS bureau_avg_credit_duration,
   max(bb.bureau_worst_status) AS bureau_worst_status, avg(bb.bureau_months_count) AS bureau_months_avg
  FROM bureau b LEFT JOIN bb_agg bb ON b.SK_ID_BUREAU = bb.SK_ID_BUREAU
  WHERE b.SK_ID_CURR IS NOT NULL GROUP BY b.SK_ID_CURR) t""", ["bureau", "bb_agg"])
    status = case_map("NAME_CONTRACT_STATUS", CONTRACT_STATUS_MAP, 0, as_double=False)
    b["prev_agg"] = (f"""SELECT *, {ratio('prev_app_approved', 'prev_app_count')} AS prev_approved_ratio,
  {ratio('prev_app_refused', 'prev_app_count')} AS prev_refused_ratio FROM (
  SELECT SK_ID_CURR, count(SK_ID_PREV) AS prev_app_count,
   CAST(count_if(s = 1) AS BIGINT) AS prev_app_approved, CAST(count_if(s = -1) AS BIGINT) AS prev_app_refused,
   avg(AMT_APPLICATION) AS prev_app_amt_mean, max(AMT_APPLICATION) AS prev_app_amt_max,
   min(AMT_APPLICATION) AS prev_app_amt_min, avg(AMT_ANNUITY) AS prev_app_annuity_mean,
   min(DAYS_DECISION) AS prev_app_days_min, avg(DAYS_DECISION) AS prev_app_days_mean,
   CAST(coalesce(sum(NFLAG_LAST_APPL_IN_DAY), 0) AS BIGINT) AS prev_nflag_last_appl_day
  FROM (SELECT *, {status} AS s FROM previous_application WHERE SK_ID_CURR IS NOT NULL) p
  GROUP BY SK_ID_CURR) t""", ["previous_application"])
    b["cc_agg"] = (f"""SELECT *, {clip(ratio('cc_balance_mean', 'cc_limit_mean'), 0, 3)} AS cc_utilization,
  {ratio('cc_atm_drawings_freq', 'cc_month_count')} AS atm_monthly_frequency FROM (
  SELECT SK_ID_CURR, avg(AMT_BALANCE) AS cc_balance_mean, stddev_samp(AMT_BALANCE) AS cc_balance_std,
   min(AMT_BALANCE) AS cc_balance_min, max(AMT_BALANCE) AS cc_balance_max,
   avg(AMT_CREDIT_LIMIT_ACTUAL) AS cc_limit_mean, avg(AMT_DRAWINGS_ATM_CURRENT) AS cc_atm_drawings_mean,
   coalesce(sum(AMT_DRAWINGS_ATM_CURRENT), 0.0::DOUBLE) AS cc_atm_drawings_total,
   CAST(count_if(AMT_DRAWINGS_ATM_CURRENT > 0) AS BIGINT) AS cc_atm_drawings_freq,
   avg(AMT_DRAWINGS_CURRENT) AS cc_current_drawings_mean, avg(AMT_DRAWINGS_OTHER_CURRENT) AS cc_total_drawings_mean,
   avg(AMT_PAYMENT_TOTAL_CURRENT) AS cc_payment_mean, min(AMT_PAYMENT_TOTAL_CURRENT) AS cc_payment_min,
   avg(AMT_INST_MIN_REGULARITY) AS cc_min_payment_mean, avg(AMT_RECEIVABLE_PRINCIPAL) AS cc_receipt_sum_mean,
   max(MONTHS_BALANCE) AS cc_recency, count(MONTHS_BALANCE) AS cc_month_count
  FROM credit_card_balance WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR) t""", ["credit_card_balance"])
    b["inst_agg"] = (f"""SELECT SK_ID_CURR, avg(AMT_PAYMENT) AS inst_payment_mean,
   avg(AMT_INSTALMENT) AS inst_instalment_mean, avg({ratio('AMT_PAYMENT', 'AMT_INSTALMENT')}) AS inst_overpayment_ratio,
   avg(d) AS inst_payment_delay_mean, stddev_samp(d) AS inst_payment_delay_std,
   max(d) AS inst_days_late_max, min(d) AS inst_days_early_max,
   avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END) AS inst_on_time_ratio,
   avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) AS inst_late_ratio, count(SK_ID_PREV) AS inst_count
  FROM (SELECT *, DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS d FROM installments_payments WHERE SK_ID_CURR IS NOT NULL) i
  GROUP BY SK_ID_CURR""", ["installments_payments"])
    b["pos_agg"] = ("""SELECT SK_ID_CURR, count(MONTHS_BALANCE) AS pos_month_count,
   count(DISTINCT SK_ID_PREV) AS pos_active_contracts, avg(SK_DPD) AS pos_sk_dpd_mean, max(SK_DPD) AS pos_sk_dpd_max,
   avg(SK_DPD_DEF) AS pos_sk_dpd_def_mean, max(SK_DPD_DEF) AS pos_sk_dpd_def_max,
   avg(CASE WHEN SK_DPD = 0 THEN 1.0 ELSE 0.0 END) AS pos_dpd_zero_ratio
  FROM pos_cash_balance WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR""", ["pos_cash_balance"])
    b["master"] = ("""SELECT * FROM application
  LEFT JOIN bureau_agg USING (SK_ID_CURR) LEFT JOIN prev_agg USING (SK_ID_CURR)
  LEFT JOIN cc_agg USING (SK_ID_CURR) LEFT JOIN inst_agg USING (SK_ID_CURR)
  LEFT JOIN pos_agg USING (SK_ID_CURR)""",
                   ["application", "bureau_agg", "prev_agg", "cc_agg", "inst_agg", "pos_agg"])
    b["fin"] = ("""SELECT * REPLACE (abs(CASE WHEN DAYS_EMPLOYED >= 365243 THEN NULL ELSE DAYS_EMPLOYED END) AS DAYS_EMPLOYED),
   abs(CASE WHEN DAYS_EMPLOYED >= 365243 THEN NULL ELSE DAYS_EMPLOYED END) / 365.25::DOUBLE AS YEARS_EMPLOYED,
   CASE WHEN DAYS_EMPLOYED >= 365243 THEN 1 ELSE 0 END AS IS_UNEMPLOYED,
   abs(DAYS_BIRTH) / 365.25::DOUBLE AS AGE_YEARS, CASE WHEN abs(DAYS_BIRTH) / 365.25::DOUBLE < 35 THEN 1 ELSE 0 END AS IS_YOUNG
  FROM master""", ["master"])
    b["f_inc"] = (f"""SELECT fin.* EXCLUDE (YEARS_EMPLOYED, IS_UNEMPLOYED), coalesce(AMT_INCOME_TOTAL, m.inc_med) AS income_total,
   {clip(ratio('AMT_INCOME_TOTAL', 'AMT_CREDIT'), 0, 20)} AS income_to_credit,
   {clip(ratio('AMT_INCOME_TOTAL', clip('coalesce(AMT_ANNUITY, 0.0::DOUBLE)', 0)), 0, 100)} AS income_to_annuity,
   {clip(ratio(clip('coalesce(AMT_ANNUITY, 0.0::DOUBLE)', 0), 'AMT_INCOME_TOTAL'), 0, 1)} AS annuity_income_ratio,
   {clip('coalesce(fin.YEARS_EMPLOYED, 0.0::DOUBLE)', 0, 50)} AS years_employed,
   coalesce(fin.IS_UNEMPLOYED, 0) AS is_unemployed,
   CAST(coalesce(CNT_CHILDREN, 0) + coalesce(CNT_FAM_MEMBERS, 1.0::DOUBLE) AS DOUBLE) AS fam
  FROM fin, (SELECT median(AMT_INCOME_TOTAL) AS inc_med FROM fin) m""", ["fin"])
    bracket = ("CASE WHEN income_total > 0 AND income_total <= 50000 THEN 0.0::DOUBLE "
               "WHEN income_total > 50000 AND income_total <= 100000 THEN 1.0::DOUBLE "
               "WHEN income_total > 100000 AND income_total <= 150000 THEN 2.0::DOUBLE "
               "WHEN income_total > 150000 AND income_total <= 200000 THEN 3.0::DOUBLE "
               "WHEN income_total > 200000 AND income_total <= 300000 THEN 4.0::DOUBLE "
               "WHEN income_total > 300000 AND income_total <= 1e9 THEN 5.0::DOUBLE END")
    b["f_inc2"] = (f"""SELECT *, CASE WHEN years_employed < 1 THEN 0 WHEN years_employed < 3 THEN 1
   WHEN years_employed < 7 THEN 2 ELSE 3 END AS job_stability_score,
   {bracket} AS income_bracket, income_total / {clip('fam', 1)} AS income_per_family_member
  FROM f_inc""", ["f_inc"])
    inc1 = clip("income_total", 1)
    b["f_all"] = (f"""SELECT *,
   job_stability_score / 3 * 0.5 + (1 - coalesce(annuity_income_ratio, 0.0::DOUBLE)) * 0.3
     + coalesce(income_bracket, 0.0::DOUBLE) / 5 * 0.2 AS income_stability_score,
   {clip('atm_monthly_frequency', 0, 30)} AS atm_monthly_freq,
   {clip('cc_utilization', 0, 2)} AS credit_utilization,
   {clip(ratio('cc_balance_std', 'cc_balance_mean'), 0, 10)} AS spending_volatility,
   {clip('coalesce(cc_atm_drawings_total, 0.0::DOUBLE) / ' + clip('coalesce(cc_limit_mean, 1.0::DOUBLE)', 1), 0, 5)} AS atm_dependency_ratio,
   coalesce(pos_dpd_zero_ratio, 1.0::DOUBLE) AS dpd_free_ratio,
   coalesce(inst_on_time_ratio, 0.0::DOUBLE) AS installment_punctuality,
   {c01('1 - (coalesce(inst_payment_delay_mean, 0.0::DOUBLE) + 30) / 60')} AS payment_delay_score,
   {clip('coalesce(pos_sk_dpd_max, 0)', 0, 365)} AS max_dpd_pos,
   {c01(f'1 - (coalesce(AMT_ANNUITY, 0.0::DOUBLE) / 12 / {inc1} * 100) / 100 - (coalesce(cc_payment_mean, 0.0::DOUBLE) / {inc1} * 100) / 100')} AS estimated_surplus_pct,
   {clip(f'bureau_debt_sum_mean / {inc1}', 0, 20)} AS debt_to_income,
   coalesce(bureau_active_count, 0) AS active_credits,
   coalesce(bureau_credit_count, 0) AS total_credits,
   coalesce(bureau_max_overdue_days, 0) AS max_overdue_days,
   coalesce(bureau_mean_overdue_days, 0.0::DOUBLE) AS mean_overdue_days,
   coalesce(bureau_days_since_latest, -9999) AS days_since_latest_credit,
   CASE coalesce(FLAG_OWN_CAR, 'N') WHEN 'Y' THEN 1 WHEN '1' THEN 1 WHEN 'N' THEN 0 WHEN '0' THEN 0 END AS owns_car,
   CASE coalesce(FLAG_OWN_REALTY, 'N') WHEN 'Y' THEN 1 WHEN '1' THEN 1 WHEN 'N' THEN 0 WHEN '0' THEN 0 END AS owns_realty,
   {case_map('NAME_HOUSING_TYPE', HOUSING_SCORE, HOUSING_DEFAULT)} AS housing_type_score,
   {case_map('NAME_EDUCATION_TYPE', EDUCATION_SCORE, EDUCATION_DEFAULT)} AS education_score,
   coalesce(prev_app_count, 0) AS prev_app_count_f,
   coalesce(prev_approved_ratio, 0.0::DOUBLE) AS prev_approved_ratio_f,
   coalesce(prev_refused_ratio, 0.0::DOUBLE) AS prev_refused_ratio_f,
   coalesce(prev_app_amt_mean, 0.0::DOUBLE) AS prev_app_amt_mean_f,
   coalesce(bureau_credit_count, 0) AS credit_type_count
  FROM f_inc2""", ["f_inc2"])
    b["f_pre"] = (f"""SELECT SK_ID_CURR, TARGET, income_total, income_to_credit, income_to_annuity, annuity_income_ratio,
   years_employed, is_unemployed, job_stability_score, income_bracket, income_per_family_member, income_stability_score,
   atm_monthly_freq, credit_utilization, spending_volatility, atm_dependency_ratio,
   {c01('(1 - credit_utilization) * 0.35 + (1 - ' + c01('atm_monthly_freq / 10') + ') * 0.25 + (1 - ' + c01('spending_volatility / 5') + ') * 0.25 + (1 - ' + c01('atm_dependency_ratio / 3') + ') * 0.15')} AS spending_discipline_score,
   dpd_free_ratio, installment_punctuality, payment_delay_score, max_dpd_pos, estimated_surplus_pct,
   {c01('dpd_free_ratio * 0.30 + installment_punctuality * 0.30 + payment_delay_score * 0.25 + estimated_surplus_pct * 0.15')} AS savings_consistency_score,
   debt_to_income, active_credits, total_credits, max_overdue_days, mean_overdue_days, days_since_latest_credit,
   {c01('(1 - ' + c01('debt_to_income / 5') + ') * 0.40 + (1 - ' + c01('active_credits / 10') + ') * 0.25 + (1 - ' + c01('max_overdue_days / 365') + ') * 0.35')} AS debt_burden_score,
   owns_car, owns_realty, housing_type_score, education_score,
   {c01('owns_realty * 0.35 + owns_car * 0.15 + housing_type_score * 0.25 + education_score * 0.15 + coalesce(income_bracket, 0.0::DOUBLE) / 5 * 0.10')} AS asset_signal_score,
   prev_app_count_f AS prev_app_count, prev_approved_ratio_f AS prev_approved_ratio,
   prev_refused_ratio_f AS prev_refused_ratio, prev_app_amt_mean_f AS prev_app_amt_mean, credit_type_count,
   {c01('prev_approved_ratio_f * 0.45 + (1 - prev_refused_ratio_f) * 0.30 + (1 - ' + c01('prev_app_count_f / 20') + ') * 0.25')} AS behavioral_score,
   CAST(AGE_YEARS AS DOUBLE) AS AGE_YEARS, CAST(IS_YOUNG AS INTEGER) AS IS_YOUNG, CNT_CHILDREN
  FROM f_all""", ["f_all"])
    fill_cols = FEATURE_TYPES
    meds = ", ".join(f"median({c}) AS {c}__med" for c in fill_cols)
    repl = ", ".join(f"coalesce({c}, CAST(m.{c}__med AS {t})) AS {c}" for c, t in fill_cols.items())
    b["features"] = (f"""SELECT SK_ID_CURR, TARGET, {repl}
  FROM f_pre, (SELECT {meds} FROM f_pre) m""", ["f_pre"])
    comp = " + ".join(f"coalesce({c}, 0.0::DOUBLE) * (1.0::DOUBLE / 6)" for c in DIM_SCORES)
    b["scored0"] = (f"SELECT *, {clip(f'(0.0::DOUBLE + {comp}) * 100', 0, 100)} AS composite_score FROM features",
                    ["features"])
    b["scored"] = (f"""SELECT *, CASE WHEN composite_score >= 0 AND composite_score <= 30 THEN '{TIER_LABELS[0]}'
   WHEN composite_score > 30 AND composite_score <= 55 THEN '{TIER_LABELS[1]}'
   WHEN composite_score > 55 AND composite_score <= 75 THEN '{TIER_LABELS[2]}'
   WHEN composite_score > 75 AND composite_score <= 100 THEN '{TIER_LABELS[3]}' END AS tier
  FROM scored0""", ["scored0"])
    raw = ", ".join(f"coalesce(m.{c}, 0) AS {c}" for c in RAW_FEATURES)
    b["model_input"] = (f"SELECT f.*, {raw} FROM features f LEFT JOIN master m USING (SK_ID_CURR)",
                        ["features", "master"])
    b["tiers"] = ("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(TIER_LABELS))
                  + ") AS t(tier, tier_order)", [])
    b["app_c0"] = ("""SELECT SK_ID_CURR, TARGET, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY,
   CASE WHEN upper(trim(FLAG_OWN_CAR)) IN ('Y', '1') THEN 1 ELSE 0 END AS FLAG_OWN_CAR,
   CASE WHEN upper(trim(FLAG_OWN_REALTY)) IN ('Y', '1') THEN 1 ELSE 0 END AS FLAG_OWN_REALTY,
   CASE WHEN FLAG_DOCUMENT_3 IS NULL THEN NULL ELSE least(greatest(FLAG_DOCUMENT_3, 0), 1) END AS FLAG_DOCUMENT_3,
   CNT_CHILDREN, CNT_FAM_MEMBERS, NAME_HOUSING_TYPE, NAME_EDUCATION_TYPE, SPARSE_COL,
   abs(CASE WHEN DAYS_EMPLOYED >= 365243 THEN NULL ELSE DAYS_EMPLOYED END) / 365.25::DOUBLE AS YEARS_EMPLOYED,
   CASE WHEN DAYS_EMPLOYED >= 365243 THEN 1 ELSE 0 END AS IS_UNEMPLOYED,
   abs(DAYS_BIRTH) / 365.25::DOUBLE AS AGE_YEARS,
   CASE WHEN abs(DAYS_BIRTH) / 365.25::DOUBLE < 35 THEN 1 ELSE 0 END AS IS_YOUNG,
   CASE WHEN CODE_GENDER = 'F' THEN 1 ELSE 0 END AS IS_FEMALE FROM application""", ["application"])
    def _mode(c):
        return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS k FROM app_c0 WHERE {c} IS NOT NULL GROUP BY {c}) "
                f"ORDER BY k DESC, v ASC LIMIT 1)")
    def _med(c, t):
        return f"coalesce({c}, CAST((SELECT median({c}) FROM app_c0) AS {t}))"
    b["app_clean"] = (f"""SELECT SK_ID_CURR, TARGET, {_med('AMT_INCOME_TOTAL', 'DOUBLE')} AS AMT_INCOME_TOTAL,
   {_med('AMT_CREDIT', 'DOUBLE')} AS AMT_CREDIT, {_med('AMT_ANNUITY', 'DOUBLE')} AS AMT_ANNUITY,
   FLAG_OWN_CAR, FLAG_OWN_REALTY, FLAG_DOCUMENT_3, {_med('CNT_CHILDREN', 'INTEGER')} AS CNT_CHILDREN,
   {_med('CNT_FAM_MEMBERS', 'DOUBLE')} AS CNT_FAM_MEMBERS,
   coalesce(NAME_HOUSING_TYPE, {_mode('NAME_HOUSING_TYPE')}, 'MISSING') AS NAME_HOUSING_TYPE,
   coalesce(NAME_EDUCATION_TYPE, {_mode('NAME_EDUCATION_TYPE')}, 'MISSING') AS NAME_EDUCATION_TYPE,
   {_med('YEARS_EMPLOYED', 'DOUBLE')} AS YEARS_EMPLOYED, IS_UNEMPLOYED, AGE_YEARS, IS_YOUNG, IS_FEMALE
  FROM app_c0""", ["app_c0"])
    return b


DIM_SCORES = ["income_stability_score", "spending_discipline_score", "savings_consistency_score",
              "debt_burden_score", "asset_signal_score", "behavioral_score"]

# feature column → SQL type (all numeric features after the builders)
FEATURE_TYPES = {
    "income_total": "DOUBLE", "income_to_credit": "DOUBLE", "income_to_annuity": "DOUBLE",
    "annuity_income_ratio": "DOUBLE", "years_employed": "DOUBLE", "is_unemployed": "INTEGER",
    "job_stability_score": "INTEGER", "income_bracket": "DOUBLE", "income_per_family_member": "DOUBLE",
    "income_stability_score": "DOUBLE", "atm_monthly_freq": "DOUBLE", "credit_utilization": "DOUBLE",
    "spending_volatility": "DOUBLE", "atm_dependency_ratio": "DOUBLE", "spending_discipline_score": "DOUBLE",
    "dpd_free_ratio": "DOUBLE", "installment_punctuality": "DOUBLE", "payment_delay_score": "DOUBLE",
    "max_dpd_pos": "INTEGER", "estimated_surplus_pct": "DOUBLE", "savings_consistency_score": "DOUBLE",
    "debt_to_income": "DOUBLE", "active_credits": "BIGINT", "total_credits": "BIGINT",
    "max_overdue_days": "INTEGER", "mean_overdue_days": "DOUBLE", "days_since_latest_credit": "INTEGER",
    "debt_burden_score": "DOUBLE", "owns_car": "INTEGER", "owns_realty": "INTEGER",
    "housing_type_score": "DOUBLE", "education_score": "DOUBLE", "asset_signal_score": "DOUBLE",
    "prev_app_count": "BIGINT", "prev_approved_ratio": "DOUBLE", "prev_refused_ratio": "DOUBLE",
    "prev_app_amt_mean": "DOUBLE", "credit_type_count": "BIGINT", "behavioral_score": "DOUBLE",
    "AGE_YEARS": "DOUBLE", "IS_YOUNG": "INTEGER", "CNT_CHILDREN": "INTEGER",
}

BLOCKS = _blocks()


def with_ctes(body: str, *needs: str) -> str:
    """Prefix ``body`` with every CTE it (transitively) needs, in dependency order."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in BLOCKS[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS (\n{BLOCKS[n][0]}\n)" for n in order)
    return f"WITH {ctes}\n{body.strip()}"


def rounded_select(cols: dict[str, str]) -> str:
    """Select list with the tie-safe rounding on DOUBLE columns."""
    return ", ".join(f"{r4(c)} AS {c}" if t == "DOUBLE" else c for c, t in cols.items())


def segment_label_sql(young="IS_YOUNG", owns="owns_realty") -> str:
    return (f"CASE WHEN {young} = 1 AND {owns} = 0 THEN 'Young Renter' "
            f"WHEN {young} = 0 AND {owns} = 1 THEN 'Mature Homeowner' "
            f"WHEN {young} = 1 AND {owns} = 1 THEN 'Young Homeowner' ELSE 'Mature Renter' END")


def income_band_sql(x="income_total") -> str:
    return (f"CASE WHEN {x} < 50000 THEN 'Low (<50K)' WHEN {x} < 100000 THEN 'Medium (50K-100K)' "
            f"WHEN {x} < 200000 THEN 'High (100K-200K)' ELSE 'Very High (>200K)' END")


def income_band_index_sql(x="income_total") -> str:
    return f"CASE WHEN {x} < 50000 THEN 0 WHEN {x} < 100000 THEN 1 WHEN {x} < 200000 THEN 2 ELSE 3 END"
