"""Scenario goldens: the model reproduces the published scenario results when the
market is the published 1.1 M young renters."""
from pyspark.sql import functions as F

from creditlake.operators import economics as EC


def _markets(spark):
    return spark.createDataFrame([("Young Renter", 1_100_000)], "segment_label string, market_size long")


def test_scenario_npv_roi_goldens(spark):
    res = {r["scenario"]: r for r in EC.npv_roi(EC.project(_markets(spark), EC.default_scenarios()),
                                                ["scenario"]).collect()}
    assert abs(res["pessimistic"]["npv_m"] - 18.2632) < 1e-3 and abs(res["pessimistic"]["roi"] - 1.1204) < 1e-3
    assert abs(res["baseline"]["npv_m"] - 50.1153) < 1e-3 and abs(res["baseline"]["roi"] - 1.8357) < 1e-3
    assert abs(res["optimistic"]["npv_m"] - 72.4151) < 1e-3 and abs(res["optimistic"]["roi"] - 2.0690) < 1e-3


def test_baseline_year_nets(spark):
    proj = EC.project(_markets(spark), EC.default_scenarios()).where(F.col("scenario") == "baseline")
    nets = [round(r["net_benefit_m"], 4) for r in proj.orderBy("year").collect()]
    assert nets == [7.463, 17.7286, 27.695]


def test_conversion_sweep(spark):
    rows = [(f"c{c}", 0.18, c, 450000.0) for c in (0.03, 0.06, 0.09, 0.12)]
    res = EC.npv_roi(EC.project(_markets(spark), rows), ["conversion"])
    got = {r["conversion"]: round(r["roi"], 3) for r in res.collect()}
    assert got == {0.03: 0.441, 0.06: 1.836, 0.09: 3.23, 0.12: 4.624}


def test_breakeven_on_grid(spark):
    import numpy as np
    rows = [(f"p{i}", float(p), 0.06, 450000.0) for i, p in enumerate(np.linspace(0.05, 0.30, 50))]
    res = EC.npv_roi(EC.project(_markets(spark), rows), ["penetration"])
    first = res.where("roi >= 1").agg(F.min("penetration")).first()[0]
    assert abs(first - 0.0755) < 1e-3


def test_breakeven_operator_reports_first_grid_hit(spark):
    from pyspark.sql import Row
    scored = spark.createDataFrame([Row(SK_ID_CURR=i, IS_YOUNG=1, owns_realty=0) for i in range(3)])
    # three young renters never reach ROI 1 → the last grid point is reported, flagged
    out = EC.breakeven(scored).orderBy("year").collect()
    assert len(out) == 3 and out[0]["breakeven_reached"] is False and abs(out[0]["breakeven_penetration"] - 0.30) < 1e-12
