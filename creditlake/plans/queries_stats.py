"""Registered queries: statistics (M1–M8), evaluation metrics (M19–M24) and
cohort economics (B1–B7, W1, W2, A27, O3, O4)."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..config import (AVG_LOAN_SIZE, BREAKEVEN_GRID, CORRELATION_EXTRA, DEFAULT_CONVERSION, DIMENSION_SCORES,
                      FEATURE_GROUPS, PENETRATION_SCENARIOS, REACH_RAMP, SENSITIVITY_CONVERSION,
                      SENSITIVITY_LOAN_SIZE, SENSITIVITY_PENETRATION, TARGET)
from ..functions.exprs import pvalue_stars
from ..operators import economics as EC
from ..operators import metrics as ME
from ..operators import stats as ST
from ..operators.features import ENGINEERED
from ..sources.roles import role
from . import master as M
from .oracle import r4, segment_label_sql, with_ctes
from .queries_marts import app_clean, scored
from .registry import register

WELCH_COLS = ["AMT_INCOME_TOTAL", "FLAG_OWN_REALTY", "TARGET", "AMT_CREDIT"]
SCREEN_COLS = [c for c in ENGINEERED]


def _welch_sql(table: str, group: str, cols: list[str], name_col="column_name") -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS {name_col},
  count({c}) FILTER (WHERE {group} = 1) AS n1, avg({c}) FILTER (WHERE {group} = 1) AS m1,
  var_samp({c}) FILTER (WHERE {group} = 1) AS v1,
  count({c}) FILTER (WHERE {group} = 0) AS n0, avg({c}) FILTER (WHERE {group} = 0) AS m0,
  var_samp({c}) FILTER (WHERE {group} = 0) AS v0 FROM {table}""")
    return "\nUNION ALL ".join(parts)


def _t_expr():
    se2 = "(v1 / n1 + v0 / n0)"
    return (f"(m1 - m0) / sqrt({se2})",
            f"{se2} * {se2} / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v0 / n0) * (v0 / n0) / (n0 - 1))")


T_SQL, DOF_SQL = _t_expr()


@register("m1_welch_ttest", with_ctes(f"""
SELECT column_name, n1 AS n_group1, n0 AS n_group0, {r4('m1')} AS mean_group1, {r4('m0')} AS mean_group0,
 {r4(T_SQL)} AS t_stat, {r4(DOF_SQL)} AS dof FROM (
{_welch_sql('app_clean', 'IS_YOUNG', WELCH_COLS)}) t""", "app_clean"))
def q_m1(spark, sf):
    """M1: Welch t (young minus mature) on income, ownership, default, credit."""
    return ST.welch_ttest(app_clean(spark, sf), "IS_YOUNG", WELCH_COLS, with_p=False)


@register("m1_welch_pvalues", None)
def q_m1p(spark, sf):
    """M1 + G4 + E18: the same tests with two-sided p-values and significance stars."""
    out = ST.welch_ttest(app_clean(spark, sf), "IS_YOUNG", WELCH_COLS, with_p=True)
    return out.withColumn("stars", pvalue_stars("p_value"))


def _dimension_sql(x: str) -> str:
    whens = []
    for dim, names in FEATURE_GROUPS.items():
        lst = ", ".join(f"'{n}'" for n in names)
        whens.append(f"WHEN {x} IN ({lst}) OR starts_with({x}, '{dim.split('_')[0]}') THEN '{dim}'")
    return "CASE " + " ".join(whens) + " ELSE 'other' END"


def _screen_sql() -> str:
    blocks = []
    for name, g in (("default", "TARGET"), ("age", "IS_YOUNG")):
        blocks.append(f"""s_{name} AS (SELECT column_name,
   CASE WHEN n1 <= 30 OR n0 <= 30 THEN NULL ELSE {T_SQL} END AS t_{name},
   CASE WHEN n1 <= 30 OR n0 <= 30 THEN NULL ELSE {DOF_SQL} END AS dof_{name} FROM (
   {_welch_sql('features', g, SCREEN_COLS)}) x)""")
    body = ("WITH " + ",\n".join(blocks).replace("WITH ", "") +
            f"""
SELECT d.column_name AS feature, {r4('t_default')} AS t_default, {r4('dof_default')} AS dof_default,
 {r4('t_age')} AS t_age, {r4('dof_age')} AS dof_age, {_dimension_sql('d.column_name')} AS dimension
FROM s_default d JOIN s_age a USING (column_name)""")
    sql = with_ctes("SELECT 1", "features")
    return sql.replace("\nSELECT 1", ",\n" + body[len("WITH "):])


@register("m2_feature_screen", _screen_sql())
def q_m2(spark, sf):
    """M2: every feature × (default, age cohort) Welch t and df; ≤30-row groups skipped."""
    return ST.feature_screen(M.features_table(spark, sf), SCREEN_COLS, with_p=False)


@register("m2_feature_screen_pvalues", None)
def q_m2p(spark, sf):
    """M2 + G4: screen with p-values and significance flags."""
    return ST.feature_screen(M.features_table(spark, sf), SCREEN_COLS, with_p=True)


@register("m4_dimension_power", None)
def q_m4(spark, sf):
    """Per-dimension discriminative power from the screen."""
    return ST.dimension_power(ST.feature_screen(M.features_table(spark, sf), SCREEN_COLS, with_p=True))


def _anova_sql() -> str:
    parts = []
    for c in DIMENSION_SCORES:
        parts.append(f"""SELECT '{c}' AS column_name, n1, n0, m1, m0, v1, v0 FROM (
  SELECT count({c}) FILTER (WHERE TARGET = 1) AS n1, avg({c}) FILTER (WHERE TARGET = 1) AS m1,
   var_samp({c}) FILTER (WHERE TARGET = 1) AS v1, count({c}) FILTER (WHERE TARGET = 0) AS n0,
   avg({c}) FILTER (WHERE TARGET = 0) AS m0, var_samp({c}) FILTER (WHERE TARGET = 0) AS v0 FROM features) x""")
    g = "(m1 * n1 + m0 * n0) / (n1 + n0)"
    ssb = f"(n1 * (m1 - {g}) * (m1 - {g}) + n0 * (m0 - {g}) * (m0 - {g}))"
    ssw = "((n1 - 1) * v1 + (n0 - 1) * v0)"
    return with_ctes(f"""SELECT column_name, {r4(f'{ssb} / 1 / ({ssw} / (n1 + n0 - 2))')} AS f_stat,
 CAST(1 AS BIGINT) AS df_between, n1 + n0 - 2 AS df_within FROM (
{chr(10).join(['UNION ALL ' + p if i else p for i, p in enumerate(parts)])}) t""", "features")


@register("m3_anova", _anova_sql())
def q_m3(spark, sf):
    """M3: one-way ANOVA F of each dimension score by default status."""
    return ST.anova_two_groups(M.features_table(spark, sf), TARGET, DIMENSION_SCORES, with_p=False)


@register("m3_anova_pvalues", None)
def q_m3p(spark, sf):
    """M3 + G4 + E18: ANOVA with p-values and stars."""
    from ..operators.marts import dimension_label
    out = ST.anova_two_groups(M.features_table(spark, sf), TARGET, DIMENSION_SCORES, with_p=True)
    return (out.withColumns({"dimension": dimension_label(F.col("column_name")), "stars": pvalue_stars("p_value")})
               .orderBy(F.desc("f_stat")))


@register("m5_kruskal_wallis", with_ctes(f"""
, c AS (SELECT composite_score AS v, TARGET AS g, count(*) AS n FROM scored GROUP BY 1, 2),
tv AS (SELECT v, sum(n) AS t FROM c GROUP BY v),
r AS (SELECT v, t, sum(t) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - t + (t + 1) / 2.0 AS avg_rank FROM tv),
rg AS (SELECT g, sum(c.n * r.avg_rank) AS rsum, sum(c.n) AS ng FROM c JOIN r USING (v) GROUP BY g),
tot AS (SELECT CAST(sum(t) AS DOUBLE) AS nn, CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM tv)
SELECT 'composite_score' AS column_name, (SELECT CAST(count(*) AS INTEGER) FROM rg) AS k, CAST(nn AS BIGINT) AS n,
 {r4('(12.0 / (nn * (nn + 1)) * (SELECT sum(rsum * rsum / ng) FROM rg) - 3 * (nn + 1)) / (1 - ties / (nn * nn * nn - nn))')} AS h_stat
FROM tot""", "scored").replace("\n, c AS", ",\nc AS", 1))
def q_m5(spark, sf):
    """M5: Kruskal-Wallis H of the composite score across outcome groups."""
    return ST.kruskal_wallis(scored(spark, sf), "composite_score", TARGET)


CORR_COLS = DIMENSION_SCORES + CORRELATION_EXTRA


@register("m6_corr_with_target", with_ctes("\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, {r4(f'corr({c}, TARGET)')} AS corr, {r4(f'abs(corr({c}, TARGET))')} AS abs_corr FROM features"
    for c in CORR_COLS), "features"))
def q_m6(spark, sf):
    """M6: |corr| of scores and key features with the outcome."""
    return ST.correlation_with(M.features_table(spark, sf), TARGET, CORR_COLS)


@register("t3_top12_corr", with_ctes("SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, {r4(f'corr({c}, TARGET)')} AS corr, {r4(f'abs(corr({c}, TARGET))')} AS abs_corr FROM features"
    for c in CORR_COLS) + ") t ORDER BY abs_corr DESC, feature LIMIT 12", "features"))
def q_t3(spark, sf):
    """Top-12 features by absolute correlation with the outcome."""
    return ST.correlation_with(M.features_table(spark, sf), TARGET, CORR_COLS).limit(12)


MATRIX_COLS = DIMENSION_SCORES + ["composite_score"]


def _matrix_sql() -> str:
    parts = []
    for i, a in enumerate(MATRIX_COLS):
        for j, b in enumerate(MATRIX_COLS):
            if a == b:
                parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r4('1.0')} AS corr")
            else:
                parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r4(f'corr({a}, {b})')} AS corr FROM scored")
    return with_ctes("\nUNION ALL ".join(parts), "scored")


@register("m7_corr_matrix", _matrix_sql())
def q_m7(spark, sf):
    """M7: 7×7 correlation matrix of the six scores and the composite."""
    return ST.correlation_matrix(scored(spark, sf), MATRIX_COLS)


@register("m8_quantile_strata", with_ctes(f"""
SELECT 1 + len(list_filter(cuts, lambda c: composite_score > c)) AS bucket, count(*) AS n,
 {r4('avg(CAST(TARGET AS DOUBLE))')} AS outcome_rate, {r4('min(composite_score)')} AS min_value,
 {r4('max(composite_score)')} AS max_value
FROM scored, (SELECT quantile_cont(composite_score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM scored) q
WHERE composite_score IS NOT NULL GROUP BY 1""", "scored"))
def q_m8(spark, sf):
    """M8: composite-score deciles → default rate per stratum."""
    return ST.quantile_strata(scored(spark, sf), "composite_score", TARGET, 10)


# ------------------------------------------------------------------ metrics on a deterministic risk score
def risk_frame(spark, sf):
    """Risk score = 1 − composite/100 (higher = riskier), label = outcome."""
    return scored(spark, sf).select(F.col(TARGET).alias("label"),
                                    (1 - F.col("composite_score") / 100).alias("score"))


_SCORE_CTES = """
, g AS (SELECT 1 - composite_score / 100 AS s, count_if(TARGET = 1) AS pos, count_if(TARGET <> 1) AS neg FROM scored GROUP BY 1),
c AS (SELECT s, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
   CAST(sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS tp,
   CAST(sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fp FROM g),
tot AS (SELECT CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N FROM g)"""


def _score_sql(body: str) -> str:
    return with_ctes(_SCORE_CTES + "\n" + body, "scored").replace("\n\n, g AS", ",\ng AS", 1).replace("\n, g AS", ",\ng AS", 1)


@register("m19_m20_auc", _score_sql(f"""
SELECT {r4('sum(pos * (N - fp + neg / 2.0)) / (max(P) * max(N))')} AS auc_roc,
 {r4('sum(CASE WHEN tp - pos < P THEN pos / P * (tp / (tp + fp) + CASE WHEN (tp - pos) + (fp - neg) = 0 THEN 1.0 ELSE (tp - pos) / ((tp - pos) + (fp - neg)) END) / 2.0 ELSE 0.0 END)')} AS auc_pr,
 CAST(max(P) AS BIGINT) AS n_pos, CAST(max(N) AS BIGINT) AS n_neg FROM c, tot"""))
def q_m19(spark, sf):
    """ROC AUC (rank-sum) and PR AUC (trapezoid) of the risk score."""
    return ME.auc_roc_pr(risk_frame(spark, sf), "label", "score").select(
        "auc_roc", "auc_pr", F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"))


@register("m21_roc_pr_points", _score_sql(f"""
SELECT {r4('s')} AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {r4('fp / N')} AS fpr,
 {r4('tp / P')} AS tpr, {r4('tp / (tp + fp)')} AS precision FROM c, tot"""))
def q_m21(spark, sf):
    """ROC / PR curve points per distinct score."""
    return ME.roc_pr_points(risk_frame(spark, sf), "label", "score").withColumns(
        {"tp": F.col("tp").cast("bigint"), "fp": F.col("fp").cast("bigint")})


GRID = ME.threshold_grid()


def _sweep_sql() -> str:
    vals = ", ".join(f"({i}, {t!r})" for i, t in enumerate(GRID))
    return with_ctes(f"""
SELECT grid_index, {r4('threshold')} AS threshold, tp, fp, P - tp AS fn,
 {r4('CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + (P - tp)) END')} AS f1 FROM (
 SELECT t.grid_index, t.threshold,
  CAST(count_if(1 - s.composite_score / 100 >= t.threshold AND s.TARGET = 1) AS BIGINT) AS tp,
  CAST(count_if(1 - s.composite_score / 100 >= t.threshold AND s.TARGET <> 1) AS BIGINT) AS fp,
  CAST(count_if(s.TARGET = 1) AS BIGINT) AS P
 FROM scored s, (VALUES {vals}) t(grid_index, threshold) GROUP BY 1, 2) x""", "scored")


@register("m22_threshold_sweep", _sweep_sql())
def q_m22(spark, sf):
    """precision/recall/F1 over the 65-point threshold grid (one pass)."""
    return ME.threshold_sweep(risk_frame(spark, sf), "label", "score")


@register("m22_best_threshold", None)
def q_m22b(spark, sf):
    """Threshold with the first maximal F1."""
    return ME.best_threshold(ME.threshold_sweep(risk_frame(spark, sf), "label", "score"))


@register("m23_confusion_matrix", with_ctes("""
SELECT CAST(TARGET AS INTEGER) AS actual, CAST(1 - composite_score / 100 >= 0.5 AS INTEGER) AS predicted, count(*) AS n
FROM scored GROUP BY 1, 2""", "scored"))
def q_m23(spark, sf):
    """Confusion matrix of the risk score at threshold 0.5."""
    return ME.confusion_matrix(risk_frame(spark, sf), "label", "score", 0.5)


def _report_sql() -> str:
    c = "(SELECT {e} FROM cm)"
    cell = lambda a, p: f"CAST(sum(CASE WHEN actual = {a} AND predicted = {p} THEN n ELSE 0 END) AS DOUBLE)"
    return with_ctes(f"""
, cm AS (SELECT CAST(TARGET AS INTEGER) AS actual, CAST(1 - composite_score / 100 >= 0.5 AS INTEGER) AS predicted,
   count(*) AS n FROM scored GROUP BY 1, 2),
cc AS (SELECT {cell(0, 0)} AS c00, {cell(0, 1)} AS c01, {cell(1, 0)} AS c10, {cell(1, 1)} AS c11 FROM cm),
k AS (SELECT *, coalesce(c00 / nullif(c00 + c10, 0), 0) AS p0, coalesce(c00 / nullif(c00 + c01, 0), 0) AS r0,
   coalesce(c11 / nullif(c11 + c01, 0), 0) AS p1, coalesce(c11 / nullif(c11 + c10, 0), 0) AS r1,
   c00 + c01 AS s0, c10 + c11 AS s1, c00 + c01 + c10 + c11 AS tot FROM cc),
f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM k)
SELECT 'No Default' AS label, {r4('p0')} AS precision, {r4('r0')} AS recall, {r4('f0')} AS f1, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT 'Default', {r4('p1')}, {r4('r1')}, {r4('f1')}, CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', {r4('(p0 + p1) / 2')}, {r4('(r0 + r1) / 2')}, {r4('(f0 + f1) / 2')}, CAST(tot AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', {r4('(p0 * s0 + p1 * s1) / tot')}, {r4('(r0 * s0 + r1 * s1) / tot')}, {r4('(f0 * s0 + f1 * s1) / tot')}, CAST(tot AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', {r4('(c00 + c11) / tot')}, {r4('(c00 + c11) / tot')}, {r4('(c00 + c11) / tot')}, CAST(tot AS BIGINT) FROM f""",
                     "scored").replace("\n\n, cm AS", ",\ncm AS", 1).replace("\n, cm AS", ",\ncm AS", 1)


@register("m24_classification_report", _report_sql())
def q_m24(spark, sf):
    """Per-class precision/recall/F1/support, macro/weighted averages, accuracy."""
    return ME.classification_report(ME.confusion_matrix(risk_frame(spark, sf), "label", "score", 0.5))


# ------------------------------------------------------------------ economics
def _markets_sql(where: str = "") -> str:
    inner = (f"SELECT {segment_label_sql()} AS segment_label, count(DISTINCT SK_ID_CURR) AS market_size "
             f"FROM scored GROUP BY 1")
    return f"(SELECT * FROM ({inner}) mm {where}) m"


def _years_sql() -> str:
    return "(VALUES " + ", ".join(f"({y + 1}, {r})" for y, r in enumerate(REACH_RAMP)) + ") yr(year, ramp)"


def _grid_sql(rows) -> str:
    return "(VALUES " + ", ".join(f"('{s}', {float(p)!r}, {float(c)!r}, {float(l)!r})" for s, p, c, l in rows) + \
        ") gr(scenario, penetration, conversion, loan_size)"


def _projection_sql(rows, where="") -> str:
    return f"""SELECT m.segment_label, m.market_size, gr.scenario, gr.penetration, gr.conversion, gr.loan_size, yr.year,
   CAST(floor(m.market_size * gr.penetration * yr.ramp) AS BIGINT) AS active_users,
   CAST(floor(CAST(floor(m.market_size * gr.penetration * yr.ramp) AS BIGINT) * gr.conversion) AS BIGINT) AS converted_loans
  FROM {_markets_sql(where)}, {_grid_sql(rows)}, {_years_sql()}"""


COMM = EC.COMMISSION_RATE


def _pl_cols() -> str:
    return (f"converted_loans * loan_size / 1e6 AS loan_volume_m, converted_loans * loan_size * {COMM!r} / 1e6 AS commission_saved_m, "
            f"2.5 AS fixed_cost_m, active_users * 50 / 1e6 AS variable_cost_m, (2500000.0 + active_users * 50) / 1e6 AS total_cost_m, "
            f"(converted_loans * loan_size * {COMM!r} - (2500000.0 + active_users * 50)) / 1e6 AS net_benefit_m")


def _pl_sql(rows, where="") -> str:
    return f"SELECT *, {_pl_cols()} FROM ({_projection_sql(rows, where)}) p"


DEFAULT_ROWS = [(n, p, DEFAULT_CONVERSION, AVG_LOAN_SIZE) for n, p in PENETRATION_SCENARIOS.items()]
PL_DOUBLES = ["penetration", "conversion", "loan_size", "loan_volume_m", "commission_saved_m", "fixed_cost_m",
              "variable_cost_m", "total_cost_m", "net_benefit_m"]


def _npv_sql(keys: str) -> str:
    return (f"SELECT {keys}, sum(net_benefit_m / pow(1.04, year - 1)) AS npv_m, sum(total_cost_m) AS total_cost_m, "
            f"arg_max(active_users, year) AS final_year_users, arg_max(converted_loans, year) AS final_year_loans")


@register("b1_cohort_projection", with_ctes(
    "SELECT segment_label, market_size, scenario, year, active_users, converted_loans, "
    + ", ".join(f"{r4(c)} AS {c}" for c in PL_DOUBLES) + f" FROM ({_pl_sql(DEFAULT_ROWS)}) t", "scored"))
def q_b1(spark, sf):
    """B1: yearly P&L per segment × scenario × year (market size from the data)."""
    s = scored(spark, sf)
    return EC.project(EC.market_by_segment(s), EC.default_scenarios()).drop("ramp")


@register("b3_scenario_comparison", with_ctes(
    f"SELECT segment_label, scenario, {r4('penetration')} AS penetration, {r4('npv_m')} AS npv_m, "
    f"{r4('total_cost_m')} AS total_cost_m, final_year_users, final_year_loans, "
    f"{r4('CASE WHEN total_cost_m > 0 THEN npv_m / total_cost_m ELSE 0.0 END')} AS roi FROM ("
    + _npv_sql("segment_label, scenario, penetration") + f" FROM ({_pl_sql(DEFAULT_ROWS)}) p "
    "GROUP BY segment_label, scenario, penetration) t", "scored"))
def q_b3(spark, sf):
    """NPV, ROI and final-year users/loans per segment × scenario."""
    return EC.scenario_comparison(scored(spark, sf))


def _sens_rows():
    base_p = PENETRATION_SCENARIOS["baseline"]
    return ([(f"penetration={p}", p, DEFAULT_CONVERSION, AVG_LOAN_SIZE) for p in SENSITIVITY_PENETRATION]
            + [(f"conversion={c}", base_p, c, AVG_LOAN_SIZE) for c in SENSITIVITY_CONVERSION]
            + [(f"loan_size={int(s)}", base_p, DEFAULT_CONVERSION, s) for s in SENSITIVITY_LOAN_SIZE])


WHERE_TARGET = "WHERE mm.segment_label = 'Young Renter'"


@register("b4_sensitivity", with_ctes(
    f"SELECT scenario AS lever, {r4('penetration')} AS penetration, {r4('conversion')} AS conversion, "
    f"{r4('loan_size')} AS loan_size, {r4('npv_m')} AS npv_m, "
    f"{r4('CASE WHEN total_cost_m > 0 THEN npv_m / total_cost_m ELSE 0.0 END')} AS roi FROM ("
    + _npv_sql("scenario, penetration, conversion, loan_size")
    + f" FROM ({_pl_sql(_sens_rows(), WHERE_TARGET)}) p GROUP BY scenario, penetration, conversion, loan_size) t", "scored"))
def q_b4(spark, sf):
    """ROI sensitivity to penetration, conversion and loan size."""
    return EC.sensitivity(scored(spark, sf))


def _breakeven_rows():
    lo, hi, n = BREAKEVEN_GRID
    return [(f"p{i:02d}", float(p), DEFAULT_CONVERSION, AVG_LOAN_SIZE) for i, p in enumerate(np.linspace(lo, hi, n))]


@register("b5_breakeven", with_ctes(f"""
, pl AS ({_pl_sql(_breakeven_rows(), WHERE_TARGET)}),
res AS ({_npv_sql('scenario, penetration')} FROM pl GROUP BY scenario, penetration),
hit AS (SELECT min(CASE WHEN (CASE WHEN total_cost_m > 0 THEN npv_m / total_cost_m ELSE 0.0 END) >= 1.0 THEN penetration END) AS h,
   max(penetration) AS l FROM res),
fb AS (SELECT coalesce(h, l) AS bp, h IS NOT NULL AS reached FROM hit)
SELECT {r4('fb.bp')} AS breakeven_penetration, fb.reached AS breakeven_reached, pl.year, {r4('pl.net_benefit_m')} AS net_benefit_m,
 {r4('sum(pl.net_benefit_m) OVER (PARTITION BY pl.scenario ORDER BY pl.year ROWS UNBOUNDED PRECEDING)')} AS cumulative_net_m
FROM pl JOIN fb ON pl.penetration = fb.bp""", "scored").replace("\n\n, pl AS", ",\npl AS", 1).replace("\n, pl AS", ",\npl AS", 1))
def q_b5(spark, sf):
    """Breakeven penetration on the 50-point grid and cumulative net path."""
    return EC.breakeven(scored(spark, sf))


@register("w2_waterfall", with_ctes(f"""
, pl AS ({_pl_sql(DEFAULT_ROWS)}),
st AS (SELECT segment_label, 1 AS step_order, 'Commission Saved' AS step, commission_saved_m AS amount_m FROM pl WHERE scenario = 'baseline' AND year = 3
  UNION ALL SELECT segment_label, 2, 'Fixed Cost', -fixed_cost_m FROM pl WHERE scenario = 'baseline' AND year = 3
  UNION ALL SELECT segment_label, 3, 'Variable Cost', -variable_cost_m FROM pl WHERE scenario = 'baseline' AND year = 3)
SELECT segment_label, step_order, step, {r4('amount_m')} AS amount_m,
 {r4('sum(amount_m) OVER (PARTITION BY segment_label ORDER BY step_order ROWS UNBOUNDED PRECEDING)')} AS end_m,
 {r4('sum(amount_m) OVER (PARTITION BY segment_label ORDER BY step_order ROWS UNBOUNDED PRECEDING) - amount_m')} AS start_m
FROM st""", "scored").replace("\n\n, pl AS", ",\npl AS", 1).replace("\n, pl AS", ",\npl AS", 1))
def q_w2(spark, sf):
    """Baseline year-3 waterfall per segment."""
    s = scored(spark, sf)
    return EC.waterfall(EC.project(EC.market_by_segment(s), EC.default_scenarios()))


@register("a27_scenario_totals", with_ctes(
    f"SELECT segment_label, scenario, {r4('sum(net_benefit_m)')} AS net_benefit_m, "
    f"{r4('sum(commission_saved_m)')} AS commission_saved_m, {r4('sum(total_cost_m)')} AS total_cost_m, "
    f"CAST(sum(active_users) AS BIGINT) AS active_users FROM ({_pl_sql(DEFAULT_ROWS)}) p GROUP BY 1, 2", "scored"))
def q_a27(spark, sf):
    """P&L sums per segment × scenario."""
    s = scored(spark, sf)
    return EC.scenario_totals(EC.project(EC.market_by_segment(s), EC.default_scenarios()))


@register("o3_financial_projection", with_ctes(f"""
, pl AS ({_pl_sql(DEFAULT_ROWS, WHERE_TARGET)}),
sm AS ({_npv_sql('segment_label, scenario')} FROM pl GROUP BY segment_label, scenario)
SELECT pl.segment_label, pl.market_size, pl.scenario, pl.year, pl.active_users, pl.converted_loans,
 {', '.join(f'{r4("pl." + c)} AS {c}' for c in PL_DOUBLES)},
 {r4('sm.npv_m')} AS npv_m, {r4('CASE WHEN sm.total_cost_m > 0 THEN sm.npv_m / sm.total_cost_m ELSE 0.0 END')} AS roi,
 CASE WHEN (CASE WHEN sm.total_cost_m > 0 THEN sm.npv_m / sm.total_cost_m ELSE 0.0 END) >= 2.0 THEN 'Strong'
      WHEN (CASE WHEN sm.total_cost_m > 0 THEN sm.npv_m / sm.total_cost_m ELSE 0.0 END) >= 1.0 THEN 'Positive'
      ELSE 'Below Breakeven' END AS roi_color
FROM pl JOIN sm USING (segment_label, scenario)""", "scored").replace("\n\n, pl AS", ",\npl AS", 1).replace("\n, pl AS", ",\npl AS", 1))
def q_o3(spark, sf):
    """agg_financial_projection for the young-renter market."""
    return EC.financial_projection(scored(spark, sf)).drop("ramp")


@register("o4_channel_analysis", with_ctes(f"""
SELECT channel, n_applications, {r4('volume')} AS volume, {r4('conversion_rate')} AS conversion_rate,
 {r4(f'volume * {COMM!r}')} AS commission, {r4(f'volume * {COMM!r} / n_applications')} AS avg_commission_per_application,
 {r4('volume / sum(volume) OVER ()')} AS volume_share FROM (
 SELECT NAME_CONTRACT_TYPE AS channel, count(*) AS n_applications, sum(AMT_APPLICATION) AS volume,
  avg(CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN 1.0 ELSE 0.0 END) AS conversion_rate
 FROM previous_application WHERE NAME_CONTRACT_TYPE IS NOT NULL GROUP BY 1) t""", "previous_application"))
def q_o4(spark, sf):
    """Commission exposure per origination channel proxy."""
    return EC.channel_analysis(role(spark, sf, "previous_application"))


@register("o4_channel_by_segment", with_ctes(f"""
SELECT channel, customer_segment, n_applications, {r4('volume')} AS volume,
 {r4(f'volume * {COMM!r} / n_applications')} AS avg_commission, {r4('conversion_rate')} AS conversion_rate FROM (
 SELECT p.NAME_CONTRACT_TYPE AS channel, {segment_label_sql()} AS customer_segment, count(*) AS n_applications,
  sum(p.AMT_APPLICATION) AS volume, avg(CASE WHEN p.NAME_CONTRACT_STATUS = 'Approved' THEN 1.0 ELSE 0.0 END) AS conversion_rate
 FROM previous_application p JOIN scored USING (SK_ID_CURR) WHERE p.NAME_CONTRACT_TYPE IS NOT NULL GROUP BY 1, 2) t""",
                                            "previous_application", "scored"))
def q_o4_segment(spark, sf):
    """Channel × customer segment mart."""
    return EC.channel_segment_mart(role(spark, sf, "previous_application"), scored(spark, sf))


@register("b7_commission_at_reach", with_ctes(f"""
SELECT segment_label, 0.18::DOUBLE AS penetration,
 {r4(f'market_size * 0.18 * {DEFAULT_CONVERSION!r} * {float(AVG_LOAN_SIZE)!r} * {COMM!r}')} AS commission_saved
FROM {_markets_sql(WHERE_TARGET)}""", "scored"))
def q_b7(spark, sf):
    """Commission saved at the chosen reach (slider, one-row grid)."""
    return EC.commission_at_reach(scored(spark, sf))
