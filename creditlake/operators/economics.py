"""Cohort economics on data.

The market size is not a constant here: it is the number of customers per
segment counted from the customer table. Scenario / sensitivity grids are tiny
parameter frames (a few dozen rows, fixed by the config, so their size is
bounded independent of the data) joined with ``broadcast``; every projection
is column algebra plus a group-by per scenario.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import (AVG_LOAN_SIZE, BREAKEVEN_GRID, BROKER_COMM_TRAIL, BROKER_COMM_UPFRONT, DEFAULT_CONVERSION,
                      DISCOUNT_RATE, FIXED_COST_ANNUAL, KEY, PENETRATION_SCENARIOS, REACH_RAMP,
                      SENSITIVITY_CONVERSION, SENSITIVITY_LOAN_SIZE, SENSITIVITY_PENETRATION,
                      VARIABLE_COST_PER_USER)
from ..functions.exprs import literal_rows
from .marts import roi_color, segment_label

COMMISSION_RATE = BROKER_COMM_UPFRONT + BROKER_COMM_TRAIL
TARGET_SEGMENT = "Young Renter"


def market_by_segment(scored: DataFrame) -> DataFrame:
    """Eligible customers per SegmentLabel (the market each scenario reaches)."""
    return scored.groupBy(segment_label().alias("segment_label")).agg(F.count(KEY).alias("market_size"))


GRID_SCHEMA = [("scenario", "string"), ("penetration", "double"), ("conversion", "double"), ("loan_size", "double")]


def default_scenarios() -> list[tuple]:
    """(scenario, penetration, conversion, loan_size) rows of the three scenarios."""
    return [(n, float(p), float(DEFAULT_CONVERSION), float(AVG_LOAN_SIZE)) for n, p in PENETRATION_SCENARIOS.items()]


def project(markets: DataFrame, grid: list[tuple]) -> DataFrame:
    """B1: yearly P&L per market × scenario × year (amounts in millions).
    The scenario grid and the 3-year ramp are literal arrays (bounded by the
    config) exploded next to each market row — no join. Users and loans are
    truncated to whole numbers as in the original model."""
    years = [(y + 1, float(r)) for y, r in enumerate(REACH_RAMP)]
    base = (markets.withColumn("__g", F.explode(literal_rows([tuple(r) for r in grid], GRID_SCHEMA)))
                   .withColumn("__y", F.explode(literal_rows(years, [("year", "int"), ("ramp", "double")])))
                   .select(*markets.columns, "__g.*", "__y.*"))
    users = F.floor(F.col("market_size") * F.col("penetration") * F.col("ramp")).cast("bigint")
    out = base.withColumn("active_users", users)
    out = out.withColumn("converted_loans", F.floor(F.col("active_users") * F.col("conversion")).cast("bigint"))
    volume = F.col("converted_loans") * F.col("loan_size")
    commission = volume * F.lit(COMMISSION_RATE)
    variable = F.col("active_users") * F.lit(VARIABLE_COST_PER_USER)
    total = F.lit(float(FIXED_COST_ANNUAL)) + variable
    return out.select(
        *[c for c in markets.columns], "scenario", "penetration", "conversion", "loan_size", "year",
        "active_users", "converted_loans",
        (volume / 1e6).alias("loan_volume_m"), (commission / 1e6).alias("commission_saved_m"),
        F.lit(FIXED_COST_ANNUAL / 1e6).alias("fixed_cost_m"), (variable / 1e6).alias("variable_cost_m"),
        (total / 1e6).alias("total_cost_m"), ((commission - total) / 1e6).alias("net_benefit_m"))


def npv_roi(projection: DataFrame, keys: list[str]) -> DataFrame:
    """NPV = Σ net / (1+r)^(year−1); ROI = NPV / Σ total cost; last-year users/loans."""
    disc = F.col("net_benefit_m") / F.pow(F.lit(1 + DISCOUNT_RATE), F.col("year") - 1)
    g = projection.groupBy(*keys).agg(F.sum(disc).alias("npv_m"), F.sum("total_cost_m").alias("total_cost_m"),
                                      F.max_by("active_users", "year").alias("final_year_users"),
                                      F.max_by("converted_loans", "year").alias("final_year_loans"))
    roi = F.when(F.col("total_cost_m") > 0, F.col("npv_m") / F.col("total_cost_m")).otherwise(0.0)
    return g.withColumn("roi", roi)


def financial_projection(scored: DataFrame, segment: str = TARGET_SEGMENT) -> DataFrame:
    """O3 agg_financial_projection: target-segment P&L by scenario × year with NPV,
    ROI and the ROI colour band."""
    markets = market_by_segment(scored).where(F.col("segment_label") == segment)
    proj = project(markets, default_scenarios())
    summary = npv_roi(proj, ["segment_label", "scenario"]).select("segment_label", "scenario", "npv_m", "roi")
    return proj.join(summary, ["segment_label", "scenario"]).withColumn("roi_color", roi_color("roi"))


def scenario_comparison(scored: DataFrame) -> DataFrame:
    """NPV, ROI, last-year users and loans for every segment × scenario."""
    proj = project(market_by_segment(scored), default_scenarios())
    return npv_roi(proj, ["segment_label", "scenario", "penetration"])


def sensitivity(scored: DataFrame, segment: str = TARGET_SEGMENT) -> DataFrame:
    """ROI when one lever moves (penetration / conversion / loan size, the loan
    size recomputed through the model rather than scaled)."""
    base_p = PENETRATION_SCENARIOS["baseline"]
    rows = ([(f"penetration={p}", p, DEFAULT_CONVERSION, float(AVG_LOAN_SIZE)) for p in SENSITIVITY_PENETRATION]
            + [(f"conversion={c}", base_p, c, AVG_LOAN_SIZE) for c in SENSITIVITY_CONVERSION]
            + [(f"loan_size={int(s)}", base_p, DEFAULT_CONVERSION, s) for s in SENSITIVITY_LOAN_SIZE])
    markets = market_by_segment(scored).where(F.col("segment_label") == segment)
    res = npv_roi(project(markets, rows), ["scenario", "penetration", "conversion", "loan_size"])
    return (res.select(F.col("scenario").alias("lever"), "penetration", "conversion", "loan_size", "npv_m", "roi")
               .orderBy(F.desc("roi"), "lever"))


def breakeven(scored: DataFrame, segment: str = TARGET_SEGMENT) -> DataFrame:
    """First grid penetration with ROI ≥ 1 and the cumulative net path."""
    lo, hi, n = BREAKEVEN_GRID
    grid = [(f"p{i:02d}", float(p), float(DEFAULT_CONVERSION), float(AVG_LOAN_SIZE))
            for i, p in enumerate(np.linspace(lo, hi, n))]
    markets = market_by_segment(scored).where(F.col("segment_label") == segment)
    proj = project(markets, grid)
    res = npv_roi(proj, ["scenario", "penetration"])
    # first grid point with ROI >= 1; when none reaches it the search ends on the
    # last grid point, whose path is then reported (as the original grid loop does)
    first = res.agg(F.min(F.when(F.col("roi") >= 1.0, F.col("penetration"))).alias("__hit"),
                    F.max("penetration").alias("__last"))
    first = first.select(F.coalesce("__hit", "__last").alias("breakeven_penetration"),
                         F.col("__hit").isNotNull().alias("breakeven_reached"))
    path = proj.join(F.broadcast(first), F.col("penetration") == F.col("breakeven_penetration"))
    w = Window.partitionBy("scenario").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return path.select("breakeven_penetration", "breakeven_reached", "year", "net_benefit_m",
                       F.sum("net_benefit_m").over(w).alias("cumulative_net_m"))


def waterfall(projection: DataFrame, scenario: str = "baseline", year: int = 3) -> DataFrame:
    """Waterfall steps (commission +, fixed −, variable −) with start/end levels."""
    row = projection.where((F.col("scenario") == scenario) & (F.col("year") == year))
    steps = row.select("segment_label", F.inline(F.array(
        F.struct(F.lit(1).alias("step_order"), F.lit("Commission Saved").alias("step"),
                 F.col("commission_saved_m").alias("amount_m")),
        F.struct(F.lit(2).alias("step_order"), F.lit("Fixed Cost").alias("step"),
                 (-F.col("fixed_cost_m")).alias("amount_m")),
        F.struct(F.lit(3).alias("step_order"), F.lit("Variable Cost").alias("step"),
                 (-F.col("variable_cost_m")).alias("amount_m")))))
    w = Window.partitionBy("segment_label").orderBy("step_order").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("amount_m").over(w)
    return steps.withColumn("end_m", end).withColumn("start_m", F.col("end_m") - F.col("amount_m"))


def scenario_totals(projection: DataFrame) -> DataFrame:
    """Sums by scenario (dashboard P&L sheets)."""
    return projection.groupBy("segment_label", "scenario").agg(
        F.sum("net_benefit_m").alias("net_benefit_m"), F.sum("commission_saved_m").alias("commission_saved_m"),
        F.sum("total_cost_m").alias("total_cost_m"), F.sum("active_users").alias("active_users"))


def channel_analysis(prev: DataFrame) -> DataFrame:
    """Commission exposure per origination channel proxy (contract type):
    volume, commission at upfront + trail, average commission per application,
    share of volume and approval conversion."""
    g = (prev.where(F.col("NAME_CONTRACT_TYPE").isNotNull())
             .groupBy(F.col("NAME_CONTRACT_TYPE").alias("channel"))
             .agg(F.count(F.lit(1)).alias("n_applications"),
                  F.sum("AMT_APPLICATION").alias("volume"),
                  F.avg(F.when(F.col("NAME_CONTRACT_STATUS") == "Approved", 1.0).otherwise(0.0)).alias("conversion_rate")))
    g = g.withColumn("commission", F.col("volume") * F.lit(COMMISSION_RATE))
    return g.withColumns({
        "avg_commission_per_application": F.col("commission") / F.col("n_applications"),
        "volume_share": F.col("volume") / F.sum("volume").over(Window.partitionBy()),
    })


def channel_segment_mart(prev: DataFrame, scored: DataFrame) -> DataFrame:
    """Volume, average commission per application and approval conversion per
    channel and customer segment. Applications are summed per (customer, channel)
    before the key join, so a customer with very many of them is combined map-side;
    applications without a channel or a known customer are left out."""
    approved = F.when(F.col("NAME_CONTRACT_STATUS") == "Approved", 1).otherwise(0)
    per_customer = (prev.where(F.col("NAME_CONTRACT_TYPE").isNotNull())
                        .groupBy(KEY, F.col("NAME_CONTRACT_TYPE").alias("channel"))
                        .agg(F.count(F.lit(1)).alias("n"), F.sum("AMT_APPLICATION").alias("amount"), F.sum(approved).alias("approved")))
    segments = scored.select(KEY, segment_label().alias("customer_segment"))
    g = (per_customer.join(segments, KEY).groupBy("channel", "customer_segment")
         .agg(F.sum("n").alias("n_applications"), F.sum("amount").alias("volume"), F.sum("approved").alias("approved")))
    return g.select("channel", "customer_segment", "n_applications", "volume",
                    (F.col("volume") * F.lit(COMMISSION_RATE) / F.col("n_applications")).alias("avg_commission"),
                    (F.col("approved") / F.col("n_applications")).alias("conversion_rate"))


def commission_at_reach(scored: DataFrame, penetrations: list[float] | None = None,
                        segment: str = TARGET_SEGMENT) -> DataFrame:
    """Slider — commission saved at a chosen reach (market × p × conversion ×
    loan size × commission rate)."""
    ps = [(float(p),) for p in (penetrations or [PENETRATION_SCENARIOS["baseline"]])]
    markets = market_by_segment(scored).where(F.col("segment_label") == segment)
    est = (F.col("market_size") * F.col("penetration") * DEFAULT_CONVERSION * AVG_LOAN_SIZE * COMMISSION_RATE)
    return (markets.withColumn("__p", F.explode(literal_rows(ps, [("penetration", "double")])))
                   .select("segment_label", "__p.penetration", est.alias("commission_saved")))
