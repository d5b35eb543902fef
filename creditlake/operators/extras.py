"""Features the catalog declares but the original code never computed (tag D).

Each is a per-customer aggregate over one child role (partial aggregation,
one shuffle on the key) joined onto the application; no window spans a
customer's whole history in one task (trend = ``regr_slope``, recency = max).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DAYS_PER_YEAR, KEY
from ..functions.exprs import ratio


def income_stability_cv(inst: DataFrame) -> DataFrame:
    """Coefficient of variation of the payment stream (income regularity proxy)."""
    return inst.groupBy(KEY).agg(F.try_divide(F.stddev_samp("AMT_PAYMENT"), F.avg("AMT_PAYMENT")).alias("income_stability_cv"))


def card_spending(cc: DataFrame) -> DataFrame:
    """Non-essential (ATM + other) share of drawings; utilization trend (W5) as the
    least-squares slope of monthly utilization over the month index. Unknown
    drawings or limits give no value."""
    non_ess = F.coalesce(F.col("AMT_DRAWINGS_ATM_CURRENT"), F.lit(0.0)) + F.coalesce(
        F.col("AMT_DRAWINGS_OTHER_CURRENT"), F.lit(0.0))
    util = ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL")
    return cc.groupBy(KEY).agg(
        ratio(F.sum(non_ess), F.sum("AMT_DRAWINGS_CURRENT")).alias("non_essential_spending_ratio"),
        F.regr_slope(util, F.col("MONTHS_BALANCE").cast("double")).alias("credit_utilization_trend"))


def months_since_last_overdue(pos: DataFrame) -> DataFrame:
    """Months since the latest month with days past due (null if never)."""
    return pos.groupBy(KEY).agg((-F.max(F.when(F.col("SK_DPD") > 0, F.col("MONTHS_BALANCE"))))
                                .alias("months_since_last_overdue"))


def credit_inquiry_recency(bureau: DataFrame) -> DataFrame:
    """Days since the latest bureau credit."""
    return bureau.groupBy(KEY).agg((-F.max("DAYS_CREDIT")).alias("credit_inquiry_recency"))


def application_behaviour(prev: DataFrame) -> DataFrame:
    """Applications per year of history and number of distinct contract types.
    Distinct types are counted as two group-bys so a hot customer is spread over
    (customer, type) groups first."""
    span = F.greatest((F.max("DAYS_DECISION") - F.min("DAYS_DECISION")) / F.lit(DAYS_PER_YEAR), F.lit(1.0))
    freq = prev.groupBy(KEY).agg((F.count(F.lit(1)) / span).alias("application_frequency"))
    types = (prev.where(F.col("NAME_CONTRACT_TYPE").isNotNull())
                 .groupBy(KEY, "NAME_CONTRACT_TYPE").agg(F.count(F.lit(1)).alias("__n"))
                 .groupBy(KEY).agg(F.count(F.lit(1)).alias("contract_type_diversity")))
    return freq.join(types, KEY, "left").withColumn(
        "contract_type_diversity", F.coalesce("contract_type_diversity", F.lit(0)).cast("bigint"))


def declared_features(roles: dict[str, DataFrame]) -> DataFrame:
    parts = [income_stability_cv(roles["installments_payments"]),
             card_spending(roles["credit_card_balance"]),
             months_since_last_overdue(roles["pos_cash_balance"]),
             credit_inquiry_recency(roles["bureau"]),
             application_behaviour(roles["previous_application"])]
    base = roles["application"].select(KEY)
    return reduce(lambda l, r: l.join(r, KEY, "left"), parts, base)
