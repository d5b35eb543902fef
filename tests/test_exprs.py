"""Semantic traps (pandas → Spark), one literal fixture per rule."""
import math

from pyspark.sql import functions as F

from creditlake.config import INCOME_BRACKET_BOUNDS, TIER_BOUNDS, TIER_LABELS
from creditlake.functions.exprs import bin_right_closed, clip_, flag_yn, r4, ratio, sample_skew
from creditlake.operators.aggregates import aggregate_bureau_balance


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.0,), (7.0,), (99.0,)], "x double")
    got = [r[0] for r in df.select(clip_("x", 1, 10)).collect()]
    assert got == [None, 1.0, 1.0, 7.0, 10.0]


def test_status_coercion_mean_max(spark):
    df = spark.createDataFrame([(1, -1, s) for s in ("0", "1", "C", "X", None)],
                               "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")
    r = aggregate_bureau_balance(df).first()
    assert r["bureau_months_count"] == 5 and r["bureau_status_mean"] == 0.5 and r["bureau_worst_status"] == 1.0


def test_tier_bins_right_closed(spark):
    vals = [0.0, 30.0, 30.01, 55.0, 75.0, 100.0, 101.0]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r[0] for r in df.select(bin_right_closed("s", TIER_BOUNDS, TIER_LABELS, include_lowest=True)).collect()]
    assert got == ["Exploring", "Exploring", "Building", "Building", "Almost Ready", "Ready", None]


def test_income_bracket(spark):
    df = spark.createDataFrame([(0.0,), (50000.0,), (50000.01,), (1e9,)], "x double")
    got = [r[0] for r in df.select(bin_right_closed("x", INCOME_BRACKET_BOUNDS, [0, 1, 2, 3, 4, 5])).collect()]
    assert got == [None, 0, 1, 5]


def test_sample_skew_matches_bias_corrected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (3.0,)], "x double")
    r = df.agg(sample_skew(F.skewness("x"), F.count("x")).alias("g"), F.percentile("x", 0.25).alias("q"),
               F.median("x").alias("m")).first()
    assert abs(r["g"] - 1.763633) < 1e-6 and r["q"] == 1.75 and r["m"] == 2.5


def test_ratio_guards_zero_and_null(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, None), (None, 5.0)], "a double, b double")
    got = [r[0] for r in df.select(ratio("a", "b")).collect()]
    assert got == [10.0, None, None]


def test_flag_normaliser(spark):
    df = spark.createDataFrame([("Y",), ("N",), ("1",), ("0",), (None,), ("x",)], "f string")
    assert [r[0] for r in df.select(flag_yn("f")).collect()] == [1, 0, 1, 0, 0, 0]


def test_null_comparison_counts_as_false_but_stays_in_denominator(spark):
    from creditlake.operators.aggregates import aggregate_installments
    df = spark.createDataFrame([(1, 1, -10, -12.0, 100.0, 100.0), (1, 1, -10, None, 100.0, 50.0),
                                (1, 2, -10, -5.0, 100.0, 100.0)],
                               "SK_ID_CURR long, SK_ID_PREV long, DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT double, "
                               "AMT_INSTALMENT double, AMT_PAYMENT double")
    r = aggregate_installments(df).first()
    assert math.isclose(r["inst_on_time_ratio"], 1 / 3) and math.isclose(r["inst_late_ratio"], 1 / 3)
    assert r["inst_count"] == 3 and math.isclose(r["inst_payment_delay_mean"], 1.5)


def test_tie_safe_rounding(spark):
    df = spark.createDataFrame([(0.12345,), (2.5e-5,)], "x double")
    assert [r[0] for r in df.select(r4("x")).collect()] == [0.1235, 0.0]


def test_with_scalars_attaches_one_row_without_join(spark):
    from creditlake.functions.exprs import with_scalars
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "x double")
    stats = df.agg(F.avg("x").alias("mx"), F.max("x").alias("hx"))
    out = with_scalars(df, stats)
    assert [(r["x"], r["mx"], r["hx"]) for r in out.orderBy("x").collect()] == [(1.0, 3.0, 5.0), (3.0, 3.0, 5.0),
                                                                                (5.0, 3.0, 5.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_literal_rows_explode_grid(spark):
    from creditlake.functions.exprs import literal_rows
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    g = df.select("k", F.explode(literal_rows([(1, 0.5), (2, 1.5)], [("i", "int"), ("v", "double")])).alias("g"))
    assert sorted((r["k"], r["g"]["i"], r["g"]["v"]) for r in g.collect()) == [
        ("a", 1, 0.5), ("a", 2, 1.5), ("b", 1, 0.5), ("b", 2, 1.5)]
