"""Child-table → customer aggregates.

Every aggregate is one ``groupBy().agg()`` on the grain key, so Spark plans a
partial (map-side) aggregate before the shuffle: a hot customer holding a third
of all rows is pre-combined inside each input partition and never reaches one
task as raw rows. Counts of distinct children are done as two explicit
group-bys (customer, child) → customer for the same reason: the distinct
rewrite would otherwise ship every distinct pair of a hot customer to one task.

Pandas semantics kept (SURVEY §1.1): ``count`` skips nulls, a comparison with a
missing value is false but the row stays in the denominator, ``sum`` of
nothing is 0, ``std`` is the sample deviation, groups with a null key vanish.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONTRACT_STATUS_MAP, KEY
from ..functions.exprs import clip_, map_lookup, ratio


def _flag(cond) -> F.Column:
    """Boolean → 1.0/0.0 where a null comparison counts as 0 (pandas ``astype(int)``)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def aggregate_bureau_balance(bb: DataFrame) -> DataFrame:
    """A1: monthly bureau status → one row per bureau credit."""
    status = F.col("STATUS").try_cast("double")
    return (bb.where(F.col("SK_ID_BUREAU").isNotNull())
              .groupBy("SK_ID_BUREAU")
              .agg(F.count("MONTHS_BALANCE").alias("bureau_months_count"),
                   F.avg(status).alias("bureau_status_mean"),
                   F.max(status).alias("bureau_worst_status")))


def aggregate_bureau(bureau: DataFrame, bureau_balance: DataFrame) -> DataFrame:
    """A2 (+J2): bureau credits with their monthly summary → one row per customer."""
    bb = aggregate_bureau_balance(bureau_balance)
    merged = bureau.join(bb, "SK_ID_BUREAU", "left")
    out = (merged.where(F.col(KEY).isNotNull())
           .groupBy(KEY)
           .agg(F.count("SK_ID_BUREAU").alias("bureau_credit_count"),
                F.count_if(F.col("CREDIT_ACTIVE") == "Active").alias("bureau_active_count"),
                F.avg("AMT_CREDIT_SUM").alias("bureau_credit_sum_mean"),
                F.max("AMT_CREDIT_SUM").alias("bureau_credit_sum_max"),
                F.min("AMT_CREDIT_SUM").alias("bureau_credit_sum_min"),
                F.avg("AMT_CREDIT_SUM_DEBT").alias("bureau_debt_sum_mean"),
                F.max("AMT_CREDIT_SUM_DEBT").alias("bureau_debt_sum_max"),
                F.avg("AMT_CREDIT_SUM_OVERDUE").alias("bureau_debt_overdue_mean"),
                F.max("AMT_CREDIT_SUM_OVERDUE").alias("bureau_debt_overdue_max"),
                F.max("CREDIT_DAY_OVERDUE").alias("bureau_max_overdue_days"),
                F.avg("CREDIT_DAY_OVERDUE").alias("bureau_mean_overdue_days"),
                F.max("DAYS_CREDIT").alias("bureau_days_since_latest"),
                F.avg(F.col("DAYS_CREDIT_ENDDATE") - F.col("DAYS_CREDIT")).alias("bureau_avg_credit_duration"),
                F.max("bureau_worst_status").alias("bureau_worst_status"),
                F.avg("bureau_months_count").alias("bureau_months_avg")))
    return out.withColumn("bureau_active_ratio",
                          ratio("bureau_active_count", "bureau_credit_count"))


def aggregate_previous_application(prev: DataFrame) -> DataFrame:
    """A3: previous applications → approval history per customer."""
    status = map_lookup("NAME_CONTRACT_STATUS", CONTRACT_STATUS_MAP, default=0)
    out = (prev.where(F.col(KEY).isNotNull())
           .withColumn("status_numeric", status)
           .groupBy(KEY)
           .agg(F.count("SK_ID_PREV").alias("prev_app_count"),
                F.count_if(F.col("status_numeric") == 1).alias("prev_app_approved"),
                F.count_if(F.col("status_numeric") == -1).alias("prev_app_refused"),
                F.avg("AMT_APPLICATION").alias("prev_app_amt_mean"),
                F.max("AMT_APPLICATION").alias("prev_app_amt_max"),
                F.min("AMT_APPLICATION").alias("prev_app_amt_min"),
                F.avg("AMT_ANNUITY").alias("prev_app_annuity_mean"),
                F.min("DAYS_DECISION").alias("prev_app_days_min"),
                F.avg("DAYS_DECISION").alias("prev_app_days_mean"),
                F.coalesce(F.sum("NFLAG_LAST_APPL_IN_DAY"), F.lit(0).cast("bigint"))
                 .alias("prev_nflag_last_appl_day")))
    return (out.withColumn("prev_approved_ratio", ratio("prev_app_approved", "prev_app_count"))
               .withColumn("prev_refused_ratio", ratio("prev_app_refused", "prev_app_count")))


def aggregate_credit_card(cc: DataFrame) -> DataFrame:
    """A4: monthly card balances → spending pattern per customer."""
    out = (cc.where(F.col(KEY).isNotNull())
           .groupBy(KEY)
           .agg(F.avg("AMT_BALANCE").alias("cc_balance_mean"),
                F.stddev_samp("AMT_BALANCE").alias("cc_balance_std"),
                F.min("AMT_BALANCE").alias("cc_balance_min"),
                F.max("AMT_BALANCE").alias("cc_balance_max"),
                F.avg("AMT_CREDIT_LIMIT_ACTUAL").alias("cc_limit_mean"),
                F.avg("AMT_DRAWINGS_ATM_CURRENT").alias("cc_atm_drawings_mean"),
                F.coalesce(F.sum("AMT_DRAWINGS_ATM_CURRENT"), F.lit(0.0)).alias("cc_atm_drawings_total"),
                F.count_if(F.col("AMT_DRAWINGS_ATM_CURRENT") > 0).alias("cc_atm_drawings_freq"),
                F.avg("AMT_DRAWINGS_CURRENT").alias("cc_current_drawings_mean"),
                F.avg("AMT_DRAWINGS_OTHER_CURRENT").alias("cc_total_drawings_mean"),
                F.avg("AMT_PAYMENT_TOTAL_CURRENT").alias("cc_payment_mean"),
                F.min("AMT_PAYMENT_TOTAL_CURRENT").alias("cc_payment_min"),
                F.avg("AMT_INST_MIN_REGULARITY").alias("cc_min_payment_mean"),
                F.avg("AMT_RECEIVABLE_PRINCIPAL").alias("cc_receipt_sum_mean"),
                F.max("MONTHS_BALANCE").alias("cc_recency"),
                F.count("MONTHS_BALANCE").alias("cc_month_count")))
    return (out.withColumn("cc_utilization", clip_(ratio("cc_balance_mean", "cc_limit_mean"), 0, 3))
               .withColumn("atm_monthly_frequency", ratio("cc_atm_drawings_freq", "cc_month_count")))


def installment_events(inst: DataFrame) -> DataFrame:
    """Per-payment delay, paid ratio and late/on-time flags."""
    delay = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return inst.withColumns({
        "payment_delay": delay,
        "paid_ratio": ratio("AMT_PAYMENT", "AMT_INSTALMENT"),
        "is_late": _flag(delay > 0),
        "is_on_time": _flag(delay <= 0),
    })


def aggregate_installments(inst: DataFrame) -> DataFrame:
    """A5: instalment payments → punctuality per customer."""
    return (installment_events(inst.where(F.col(KEY).isNotNull()))
            .groupBy(KEY)
            .agg(F.avg("AMT_PAYMENT").alias("inst_payment_mean"),
                 F.avg("AMT_INSTALMENT").alias("inst_instalment_mean"),
                 F.avg("paid_ratio").alias("inst_overpayment_ratio"),
                 F.avg("payment_delay").alias("inst_payment_delay_mean"),
                 F.stddev_samp("payment_delay").alias("inst_payment_delay_std"),
                 F.max("payment_delay").alias("inst_days_late_max"),
                 F.min("payment_delay").alias("inst_days_early_max"),
                 F.avg("is_on_time").alias("inst_on_time_ratio"),
                 F.avg("is_late").alias("inst_late_ratio"),
                 F.count("SK_ID_PREV").alias("inst_count")))


def aggregate_pos_cash(pos: DataFrame) -> DataFrame:
    """POS/cash monthly balances → delinquency per customer.

    Two-level plan: (customer, contract) partial sums first — the shuffle key
    includes the contract, so a hot customer spreads over many tasks — then the
    per-customer combine, itself map-side pre-aggregated.
    """
    per_contract = (pos.where(F.col(KEY).isNotNull())
                    .groupBy(KEY, "SK_ID_PREV")
                    .agg(F.count("MONTHS_BALANCE").alias("n_months"),
                         F.sum("SK_DPD").alias("s_dpd"), F.count("SK_DPD").alias("n_dpd"),
                         F.max("SK_DPD").alias("m_dpd"),
                         F.sum("SK_DPD_DEF").alias("s_def"), F.count("SK_DPD_DEF").alias("n_def"),
                         F.max("SK_DPD_DEF").alias("m_def"),
                         F.count_if(F.col("SK_DPD") == 0).alias("n_zero"),
                         F.count(F.lit(1)).alias("n_rows")))
    return (per_contract.groupBy(KEY)
            .agg(F.sum("n_months").alias("pos_month_count"),
                 F.count("SK_ID_PREV").alias("pos_active_contracts"),
                 F.try_divide(F.sum("s_dpd"), F.sum("n_dpd")).alias("pos_sk_dpd_mean"),
                 F.max("m_dpd").alias("pos_sk_dpd_max"),
                 F.try_divide(F.sum("s_def"), F.sum("n_def")).alias("pos_sk_dpd_def_mean"),
                 F.max("m_def").alias("pos_sk_dpd_def_max"),
                 F.try_divide(F.sum("n_zero"), F.sum("n_rows")).alias("pos_dpd_zero_ratio")))


BUREAU_COLS = ["bureau_credit_count", "bureau_active_count", "bureau_credit_sum_mean",
               "bureau_credit_sum_max", "bureau_credit_sum_min", "bureau_debt_sum_mean",
               "bureau_debt_sum_max", "bureau_debt_overdue_mean", "bureau_debt_overdue_max",
               "bureau_max_overdue_days", "bureau_mean_overdue_days", "bureau_days_since_latest",
               "bureau_avg_credit_duration", "bureau_worst_status", "bureau_months_avg",
               "bureau_active_ratio"]
