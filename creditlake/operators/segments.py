"""Young-cohort segmentation with MLlib K-means."""
from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLUSTER_FEATURES, CLUSTER_LOG_FEATURES, KEY, YOUNG_AGE_MAX
from ..session import cut_lineage
from ..functions.exprs import with_scalars
from ..functions.quantiles import quantile_frame
from .models import population_scale

# FIXED VALUES: segment names, assigned in order of decreasing average income
SEGMENT_NAMES = ["Digitally Confident Spender", "Financially Anxious Renter", "Cautious Observer"]

_SOURCE = {"income": "AMT_INCOME_TOTAL", "credit_amt": "AMT_CREDIT", "annuity": "AMT_ANNUITY",
           "age": "AGE_YEARS", "children": "CNT_CHILDREN", "on_time_ratio": "inst_on_time_ratio",
           "cc_utilization": "cc_utilization", "dpd_zero_ratio": "pos_dpd_zero_ratio",
           "active_credit_ratio": "bureau_active_ratio", "prev_approved_ratio": "prev_approved_ratio"}


def cluster_input(master_with_age: DataFrame) -> DataFrame:
    """Young cohort, 10 renamed features, median fill (young medians),
    log1p on the money columns, assembled + standardized (mean 0, unit population sd)."""
    young = master_with_age.where(F.col("AGE_YEARS") < YOUNG_AGE_MAX).select(
        KEY, *[F.col(src).cast("double").alias(dst) for dst, src in _SOURCE.items()])
    med = quantile_frame(young, [(c, 0.5, f"{c}__med") for c in CLUSTER_FEATURES])
    filled = with_scalars(young, med).select(
        KEY, *[F.coalesce(F.col(c), F.col(f"{c}__med")).alias(c) for c in CLUSTER_FEATURES])
    logged = filled.withColumns({c: F.log1p(c) for c in CLUSTER_LOG_FEATURES})
    vec = VectorAssembler(inputCols=CLUSTER_FEATURES, outputCol="raw", handleInvalid="keep").transform(
        logged.withColumnsRenamed({c: c for c in CLUSTER_FEATURES}))
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(vec)
    widen = ElementwiseProduct(scalingVec=population_scale(vec.count(), len(CLUSTER_FEATURES)),
                               inputCol="scaled", outputCol="features")
    raw_vals = filled.withColumnsRenamed({c: f"raw_{c}" for c in CLUSTER_FEATURES})
    return cut_lineage(widen.transform(scaler.transform(vec)).drop("raw", "scaled").join(raw_vals, KEY))


def inertia_k1(prepared: DataFrame) -> float:
    """k = 1 inertia = Σ‖x − mean‖² by aggregate (MLlib needs k > 1)."""
    n = len(CLUSTER_FEATURES)
    arr = vector_to_array("features")
    means = prepared.agg(*[F.avg(arr[i]).alias(f"m{i}") for i in range(n)])
    j = with_scalars(prepared, means)
    return j.agg(F.sum(sum((arr[i] - F.col(f"m{i}")) ** 2 for i in range(n)))).first()[0]


def elbow(prepared: DataFrame, ks=range(1, 7), restarts: int = 10, seed: int = 42) -> DataFrame:
    """Inertia per k, best of ``restarts`` seeds (k-means|| initialisation)."""
    rows = []
    for k in ks:
        if k == 1:
            rows.append((1, float(inertia_k1(prepared))))
            continue
        best = min(KMeans(k=k, seed=seed + r, featuresCol="features").fit(prepared).summary.trainingCost
                   for r in range(restarts))
        rows.append((k, float(best)))
    return prepared.sparkSession.createDataFrame(rows, "k int, inertia double")


def assign_segments(prepared: DataFrame, k: int = 3, restarts: int = 10, seed: int = 42) -> DataFrame:
    """Best-of-restarts K-means, clusters named by decreasing average income."""
    best = None
    for r in range(restarts):
        m = KMeans(k=k, seed=seed + r, featuresCol="features").fit(prepared)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    out = best.transform(prepared).withColumnRenamed("prediction", "cluster")
    order = (out.groupBy("cluster").agg(F.avg("raw_income").alias("__inc"))
                .withColumn("__rank", F.row_number().over(Window.orderBy(F.desc("__inc"), "cluster")) - 1))
    names = F.element_at(F.array(*[F.lit(n) for n in SEGMENT_NAMES]), F.least(F.col("__rank") + 1, F.lit(len(SEGMENT_NAMES))))
    return out.join(F.broadcast(order.select("cluster", names.alias("segment_name"))), "cluster")


def segment_profile(assigned: DataFrame) -> DataFrame:
    """A11 + E22 + W3: per segment count, means, share, and the rule-based insight."""
    g = (assigned.groupBy("cluster", "segment_name")
                 .agg(F.count(KEY).alias("n"), F.avg("raw_income").alias("avg_income"),
                      F.avg("raw_credit_amt").alias("avg_credit"), F.avg("raw_age").alias("avg_age"),
                      F.avg("raw_on_time_ratio").alias("on_time_ratio"),
                      F.avg("raw_cc_utilization").alias("cc_utilization"),
                      F.avg("raw_dpd_zero_ratio").alias("dpd_zero"),
                      F.avg("raw_prev_approved_ratio").alias("approved_ratio"),
                      F.avg("raw_active_credit_ratio").alias("active_credit_ratio")))
    insight = (F.when((F.col("avg_income") > 150000) & (F.col("cc_utilization") > 0.3), "high earner, heavy spender")
                .when((F.col("dpd_zero") > 0.9) & (F.col("avg_income") < 130000), "low risk, thin credit file")
                .otherwise("repayment capacity without deposit"))
    return g.withColumns({"share": F.col("n") / F.sum("n").over(Window.partitionBy()), "insight": insight})
