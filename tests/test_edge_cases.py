"""Small frames with gaps, ties and zeros, held against hand-computed values."""
from pyspark.sql import functions as F

from creditlake.operators import marts as MT
from creditlake.operators import extras as X
from creditlake.operators import metrics as ME
from creditlake.operators import models as MD
from creditlake.operators import quality as Q
from creditlake.operators.cleaning import handle_missing_values, modes
from creditlake.operators.quality import data_quality_report
from creditlake.operators.stats import quantile_strata

CARDS = ("SK_ID_CURR long, MONTHS_BALANCE int, AMT_BALANCE double, AMT_CREDIT_LIMIT_ACTUAL int, "
         "AMT_DRAWINGS_CURRENT double, AMT_DRAWINGS_ATM_CURRENT double, AMT_DRAWINGS_OTHER_CURRENT double")


def test_unknown_limit_is_no_limit_of_one(spark):
    rows = [(1, -3, 100.0, None, None, 5.0, None), (1, -2, 300.0, None, None, 5.0, None),
            (2, -3, 10.0, 100, 40.0, 10.0, None), (2, -2, 30.0, 100, 0.0, 0.0, 10.0)]
    got = {r["SK_ID_CURR"]: r for r in X.card_spending(spark.createDataFrame(rows, CARDS)).collect()}
    assert got[1]["credit_utilization_trend"] is None and got[1]["non_essential_spending_ratio"] is None
    assert abs(got[2]["credit_utilization_trend"] - 0.2) < 1e-12
    assert abs(got[2]["non_essential_spending_ratio"] - 0.5) < 1e-12


def test_zero_payments_have_no_variation(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 0.0)], "SK_ID_CURR long, AMT_PAYMENT double")
    assert X.income_stability_cv(rows).first()["income_stability_cv"] is None


def test_whole_number_column_is_filled_with_a_fractional_median(spark):
    rows = spark.createDataFrame([(1, 2), (2, None), (3, 3)], "SK_ID_CURR long, n int")
    assert [r["n"] for r in handle_missing_values(rows).orderBy("SK_ID_CURR").collect()] == [2.0, 2.5, 3.0]


def test_quality_report_of_constant_and_empty_columns(spark):
    rows = spark.createDataFrame([(7, 1.0), (7, 2.0), (7, 4.0)], "same int, other double")
    got = {r["column_name"]: r for r in data_quality_report(rows).collect()}
    assert got["same"]["skew"] == 0.0 and got["other"]["skew"] > 0
    empty = data_quality_report(rows.where("same < 0")).collect()
    assert [r["missing_pct"] for r in empty] == [None, None]


def test_strata_leave_rows_without_a_value_out(spark):
    rows = spark.createDataFrame([(float(i), i % 2) for i in range(1, 11)] + [(None, 1)] * 10, "v double, y int")
    got = quantile_strata(rows, "v", "y", 10).collect()
    assert {r["bucket"]: r["n"] for r in got} == {b: 1 for b in range(1, 11)}


def test_best_threshold_without_a_hit_is_one_half(spark):
    rows = spark.createDataFrame([(0, 0.3), (0, 0.9)], "label int, score double")
    best = ME.best_threshold(ME.threshold_sweep(rows)).first()
    assert (best["best_threshold"], best["best_f1"]) == (0.5, 0.0)


def test_validation_fold_is_independent_of_the_key(spark):
    rows = spark.range(1, 50_001).withColumnRenamed("id", "SK_ID_CURR").where(MD.split_bucket() < MD.TRAIN_SHARE)
    n, valid, odd = rows.agg(F.count(F.lit(1)), F.count_if(MD.valid_fold()),
                             F.count_if(MD.valid_fold() & (F.col("SK_ID_CURR") % 2 == 1))).first()
    assert abs(valid / n - MD.VALID_SHARE / 100) < 0.01
    assert abs(odd / valid - 0.5) < 0.05


def test_approval_rows_hold_no_outcome_feature(spark):
    prev = spark.createDataFrame([(1, 10, "Approved", 1.0, 1.0, -5, 1)],
                                 "SK_ID_CURR long, SK_ID_PREV long, NAME_CONTRACT_STATUS string, AMT_APPLICATION double, "
                                 "AMT_ANNUITY double, DAYS_DECISION int, NFLAG_LAST_APPL_IN_DAY int")
    features = spark.createDataFrame([(1, 0, 0.5, 0.5, 0.1)], "SK_ID_CURR long, TARGET int, prev_approved_ratio double, "
                                     "behavioral_score double, debt_to_income double")
    data = MD.approval_model_data(prev, features)
    cols = MD.model_feature_columns(data, ["SK_ID_PREV"])
    assert "debt_to_income" in cols
    assert not [c for c in cols if c.startswith("prev_") or c in ("behavioral_score", "SK_ID_PREV")]


def test_score_chart_of_one_value_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(40.0,), (40.0,), (None,)], "composite_score double")
    assert [tuple(r) for r in MT.score_range_histogram(rows).collect()] == [(25, 40.0, 2)]
    assert MT.score_range_histogram(rows.limit(0)).collect() == []
    rows = spark.createDataFrame([(float(x),) for x in range(101)], "composite_score double")
    got = {r.score_bin: r.n for r in MT.score_range_histogram(rows).collect()}
    assert sum(got.values()) == 101 and got[0] == 2 and got[49] == 3


def test_age_chart_edges(spark):
    ages = [19.9, 20.0, 21.9, 72.0, 74.0, 74.1, None]
    rows = spark.createDataFrame([(a, 0) for a in ages], "AGE_YEARS double, IS_YOUNG int")
    assert {r.age_bin: r.n_customers for r in MT.age_chart_histogram(rows).collect()} == {20: 2, 72: 2}


def test_mode_takes_the_smallest_of_ties_and_null_without_values(spark):
    df = spark.createDataFrame([("b", None, "x"), ("a", None, None), ("a", None, None), ("b", None, ""), (None, None, "")],
                               "t string, none string, `empty text` string")
    assert modes(df, df.columns).first().asDict() == {"t__mode": "a", "none__mode": None, "empty text__mode": ""}
    assert modes(df.limit(0), ["t"]).first()["t__mode"] is None


def test_distinct_counts_hold_few_values_in_a_task(spark, monkeypatch):
    """Rows of one file are dealt out before values are told apart; a row is not
    expanded into one as wide as itself per column."""
    monkeypatch.setattr(Q, "VALUES_PER_TASK", 50)
    nan = float("nan")
    rows = [(i, str(i % 7), [0.0, -0.0, nan, nan, None][i % 5], i % 2 == 0, None, [i % 3]) for i in range(100)]
    df = spark.createDataFrame(rows, "a long, b string, c double, d boolean, e double, f array<int>").coalesce(1)
    got = {r["column_name"]: (r["cardinality"], r["missing_n"]) for r in data_quality_report(df).collect()}
    assert got == {"a": (100, 0), "b": (7, 0), "c": (2, 20), "d": (2, 0), "e": (0, 100), "f": (3, 0)}
    counts = Q.distinct_counts(df)
    plan = counts._jdf.queryExecution().toString()
    assert "Expand" not in plan and "12), REPARTITION_BY_NUM" in plan
    assert {r["__c"]: r["__d"] for r in counts.collect()} == {0: 100, 1: 7, 2: 2, 3: 2, 5: 3}
