"""Invariants of the customer-360 pipeline and the driver contract (sf0.001)."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from creditlake.plans import master as M


def test_master_one_row_per_customer(spark):
    m = M.master_table(spark, SF_SMALL)
    app = M.load(spark, SF_SMALL)["application"]
    assert m.count() == app.count() == m.select("SK_ID_CURR").distinct().count()


def test_feature_ranges(spark):
    s = M.scored_table(spark, SF_SMALL)
    dims = ["income_stability_score", "spending_discipline_score", "savings_consistency_score",
            "debt_burden_score", "asset_signal_score", "behavioral_score"]
    r = s.agg(*[F.min(c).alias(f"mn_{c}") for c in dims], *[F.max(c).alias(f"mx_{c}") for c in dims],
              F.min("composite_score").alias("cmin"), F.max("composite_score").alias("cmax"),
              F.count_if(F.col("tier").isNull()).alias("no_tier")).first()
    for c in dims[1:]:
        assert 0 <= r[f"mn_{c}"] and r[f"mx_{c}"] <= 1
    assert 0 <= r["cmin"] and r["cmax"] <= 100 and r["no_tier"] == 0


def test_on_time_plus_late_at_most_one(spark):
    from creditlake.operators.aggregates import aggregate_installments
    inst = aggregate_installments(M.load(spark, SF_SMALL)["installments_payments"])
    assert inst.where(F.col("inst_on_time_ratio") + F.col("inst_late_ratio") > 1 + 1e-12).count() == 0


def test_model_feature_count_is_48(spark):
    from creditlake.operators.models import model_feature_columns
    assert len(model_feature_columns(M.model_table(spark, SF_SMALL))) == 48


def test_tier_counts_sum_to_customers(spark):
    import __spark_entry__ as E
    tiers = E.queries()["a25_tier_distribution"](spark, SF_SMALL)
    assert tiers.agg(F.sum("n_customers")).first()[0] == M.scored_table(spark, SF_SMALL).count()
    assert [r["tier"] for r in tiers.orderBy("tier_order").collect()] == [
        "Exploring", "Building", "Almost Ready", "Ready"]


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 4 and "default_rate" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
