"""Declarative catalog: every constant the results depend on.

FIXED VALUES — these must equal the values of the analysis being reproduced
(maps, bounds, weights, name lists, business constants). They are stated
plainly, in their natural order, and used by both the Spark operators and the
SQL oracle text.
"""
from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
KEY = "SK_ID_CURR"
TARGET = "TARGET"

YOUNG_AGE_MAX = 35                  # age < 35 is the young cohort
UNEMPLOYED_SENTINEL = 365243        # DAYS_EMPLOYED value meaning "no job"
DAYS_PER_YEAR = 365.25
MISSING_DROP_SHARE = 0.80           # drop a column when more than 80 % is missing
IQR_FACTOR = 3.0

# previous_application status → numeric (other → 0)
CONTRACT_STATUS_MAP = {"Approved": 1, "Canceled": 0, "Refused": -1, "Unused offer": 0}

# housing / education → ordinal signal (default 0.3)
HOUSING_SCORE = {
    "Co-op apartment": 0.3,
    "With parents": 0.1,
    "Municipal apartment": 0.4,
    "House / apartment": 0.7,
    "Rented apartment": 0.2,
    "Office apartment": 0.3,
}
HOUSING_DEFAULT = 0.3
EDUCATION_SCORE = {
    "Lower secondary": 0.1,
    "Secondary / secondary special": 0.3,
    "Incomplete higher": 0.5,
    "Higher education": 0.7,
    "Academic degree": 0.9,
}
EDUCATION_DEFAULT = 0.3

# income bracket: right-closed bins (0,50k], (50k,100k], ... (300k,1e9] → 0..5
INCOME_BRACKET_BOUNDS = [0, 50000, 100000, 150000, 200000, 300000, 1e9]

# composite score tiers: [0,30] (30,55] (55,75] (75,100]
TIER_BOUNDS = [0, 30, 55, 75, 100]
TIER_LABELS = ["Exploring", "Building", "Almost Ready", "Ready"]

DIMENSION_SCORES = [
    "income_stability_score",
    "spending_discipline_score",
    "savings_consistency_score",
    "debt_burden_score",
    "asset_signal_score",
    "behavioral_score",
]

# feature catalog per dimension (names as declared; most differ from built names)
FEATURE_GROUPS = {
    "income_stability": ["income_stability_cv", "days_since_last_job_change",
                         "income_to_credit_ratio", "income_to_annuity_ratio"],
    "spending_discipline": ["non_essential_spending_ratio", "atm_withdrawal_frequency",
                            "credit_utilization_trend", "credit_utilization_mean"],
    "savings_consistency": ["estimated_monthly_surplus", "dpd_free_months_ratio",
                            "installment_punctuality", "months_since_last_overdue"],
    "debt_burden": ["debt_to_income_ratio", "active_credit_count", "max_dpd_ever",
                    "credit_inquiry_recency"],
    "asset_signal": ["owns_car", "owns_realty", "income_band", "balance_proxy"],
    "behavioral": ["application_frequency", "contract_type_diversity",
                   "approved_ratio", "refused_ratio"],
}

# redundant features removed before modelling
DROP_FOR_MODELING = [
    "job_stability_score", "is_unemployed", "income_per_family_member", "income_bracket",
    "income_to_annuity",
    "atm_dependency_ratio", "atm_monthly_freq",
    "installment_punctuality", "payment_delay_score",
    "debt_burden_score",
    "mean_overdue_days",
    "days_since_latest_credit",
    "credit_type_count", "bureau_credit_count",
    "max_dpd_pos",
    "income_stability_score", "spending_discipline_score",
    "savings_consistency_score", "asset_signal_score", "behavioral_score",
    "AGE_YEARS", "IS_YOUNG", "CNT_CHILDREN",
    "composite_score", "tier",
]

# raw aggregates appended next to the engineered features (natural order)
RAW_FEATURES = [
    "bureau_credit_count", "bureau_active_count",
    "bureau_debt_sum_max", "bureau_max_overdue_days",
    "bureau_mean_overdue_days", "bureau_days_since_latest",
    "inst_payment_delay_mean", "inst_payment_delay_std",
    "inst_late_ratio", "inst_count", "inst_days_late_max",
    "inst_payment_mean",
    "cc_balance_mean", "cc_balance_std",
    "cc_atm_drawings_mean", "cc_atm_drawings_total",
    "cc_payment_mean", "cc_min_payment_mean",
    "cc_limit_mean", "cc_month_count",
    "prev_app_approved", "prev_app_refused",
    "prev_app_amt_max", "prev_app_annuity_mean",
    "prev_app_days_mean", "prev_nflag_last_appl_day",
    "pos_month_count", "pos_active_contracts",
    "pos_sk_dpd_max",
]

# features correlated with the target (dimension scores first)
CORRELATION_EXTRA = [
    "income_total", "years_employed", "credit_utilization",
    "dpd_free_ratio", "installment_punctuality", "debt_to_income",
    "owns_realty", "prev_approved_ratio", "estimated_surplus_pct",
]

# clustering inputs of the young cohort; log1p on the first three
CLUSTER_FEATURES = ["income", "credit_amt", "annuity", "age", "children",
                    "on_time_ratio", "cc_utilization", "dpd_zero_ratio",
                    "active_credit_ratio", "prev_approved_ratio"]
CLUSTER_LOG_FEATURES = ["income", "credit_amt", "annuity"]

# business scenario constants
TARGET_MARKET_SIZE = 1_100_000
AVG_LOAN_SIZE = 450_000
BROKER_COMM_UPFRONT = 0.0060
BROKER_COMM_TRAIL = 0.0015
DISCOUNT_RATE = 0.04
FIXED_COST_ANNUAL = 2_500_000
VARIABLE_COST_PER_USER = 50
DEFAULT_CONVERSION = 0.06
REACH_RAMP = [0.33, 0.67, 1.0]      # share of the reach achieved in year 1, 2, 3
PENETRATION_SCENARIOS = {"pessimistic": 0.08, "baseline": 0.18, "optimistic": 0.25}
SENSITIVITY_PENETRATION = [0.08, 0.12, 0.16, 0.18, 0.22, 0.25]
SENSITIVITY_CONVERSION = [0.03, 0.06, 0.09, 0.12]
SENSITIVITY_LOAN_SIZE = [350_000, 450_000, 550_000]
BREAKEVEN_GRID = (0.05, 0.30, 50)   # linspace(start, stop, n)
BROKER_SHARE = 0.675
ANNUAL_MARKET_VOLUME = 350_000_000_000

# classification threshold sweep: 65 points in [0.05, 0.70]
THRESHOLD_GRID = (0.05, 0.70, 65)
VARIANCE_THRESHOLD = 0.001
TTEST_MIN_GROUP = 30                # a group needs more than 30 rows for a test

# dashboard calculated fields
# SegmentLabel: (is_young, owns_realty) → label
SEGMENT_LABELS = {
    (1, 0): "Young Renter",
    (0, 1): "Mature Homeowner",
    (1, 1): "Young Homeowner",
    (0, 0): "Mature Renter",
}
# IncomeBand: left-closed upper bounds
INCOME_BANDS = [(50000, "Low (<50K)"), (100000, "Medium (50K-100K)"), (200000, "High (100K-200K)")]
INCOME_BAND_TOP = "Very High (>200K)"
# ROIColor
ROI_COLORS = [(2.0, "Strong"), (1.0, "Positive")]
ROI_COLOR_BELOW = "Below Breakeven"
# dashboard age filter and histogram bins
AGE_FILTER = (18, 70)
AGE_BIN_WIDTH = 2
SCORE_BINS = 50
AGE_CHART_RANGE = (20, 74)
