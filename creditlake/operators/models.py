"""Default-risk modelling with MLlib.

Data preparation is SQL-checkable column algebra (exclusion list, ±inf → null,
train-only medians, population variance screen, exact stratified split,
balanced class weights). Training uses MLlib estimators; evaluation reuses the
distributed metric operators in :mod:`creditlake.operators.metrics`.
"""
from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DROP_FOR_MODELING, KEY, TARGET, VARIANCE_THRESHOLD
from ..functions.cumulative import running_totals
from ..functions.exprs import clean_num, with_scalars
from ..session import cut_lineage
from ..functions.quantiles import quantile_frame
from .metrics import auc_roc_pr
from .quality import numeric_columns

TRAIN_SHARE = 80          # percent of each stratum that goes to training
CLASSES = 1000            # more values of the target than this are no strata
PATIENCE = 50             # rounds without gain on the validation fold that end the boosting
# ranges of the random search: log-uniform penalty, uniform share of L1 in it
SEARCH_SPACE = {"regParam": (1e-4, 1.0), "elasticNetParam": (0.0, 0.5)}
VALID_SHARE = 10          # percent of the training rows held out for early stopping
ROWS_PER_TASK = 100_000   # inputs too small for one such block per task are merged into fewer tasks
# boosting reads its rows once per tree level: up to TREE_TASKS tasks, smaller blocks pay
TREE_ROWS_PER_TASK, TREE_TASKS = 25_000, 8


def split_order(key: str = KEY) -> F.Column:
    """Deterministic pseudo-random number of a key by integer arithmetic (same value in
    any engine, no overflow for any 64-bit key)."""
    return F.pmod(F.pmod(F.col(key), F.lit(1000003)) * F.lit(2654435761), F.lit(4294967296))


def split_bucket(key: str = KEY) -> F.Column:
    """0..99 from ``split_order``: a split without a look at the data, its shares in expectation."""
    return split_order(key) % 100


def train_rows(df: DataFrame, key: str = KEY) -> F.Column:
    """True for ``TRAIN_SHARE`` percent of each class, rounded to whole rows: those
    with the lowest (``split_order``, key). The last training key of a class is found by
    running counts over the narrow (class, order, key) table; only these cuts, one per
    class, come back and become a condition, so wide rows are neither ranked nor
    joined. Rows of one key stay together."""
    keys = df.groupBy(F.col(TARGET).alias("y"), split_order(key).alias("h"), F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    counts = keys.groupBy("y").agg(F.sum("n").alias("n")).orderBy(F.asc_nulls_first("y")).limit(CLASSES + 1).collect()
    if len(counts) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes to stratify by")
    wanted, before = [], 0
    for r in counts:
        take = (r["n"] * TRAIN_SHARE + 50) // 100
        if take:
            wanted.append(before + take)
        before += r["n"]
    ranked = running_totals(keys.withColumn("__order", F.struct("y", "h", "k")), "__order", ["n"])
    covers = [(F.col("cum_n") >= w) & (F.col("cum_n") - F.col("n") < w) for w in wanted]
    cuts = ranked.filter(reduce(lambda a, b: a | b, covers, F.lit(False))).collect()
    h, k = split_order(key), F.col(key)
    inside = [F.col(TARGET).eqNullSafe(F.lit(c["y"])) & ((h < c["h"]) | ((h == c["h"]) & (k <= F.lit(c["k"])))) for c in cuts]
    return F.coalesce(reduce(lambda a, b: a | b, inside, F.lit(False)), F.lit(False))


def valid_fold(key: str = KEY) -> F.Column:
    """Rows held out for early stopping, by a hash independent of the split bucket."""
    return F.pmod(F.xxhash64(F.col(key), F.lit("validation")), F.lit(100)) < VALID_SHARE


def stratified_folds(df: DataFrame, folds: int) -> DataFrame:
    """Add ``fold``: rows in (class, hash) order are dealt out in turn, so the folds
    of a class differ by one row at most. Ranks come from distributed running totals."""
    order = F.struct(F.col(TARGET), F.xxhash64(F.col(KEY), F.lit("fold")), F.col(KEY))
    ranked = running_totals(df.withColumns({"__order": order, "__one": F.lit(1).cast("long")}), "__order", ["__one"])
    return (ranked.withColumn("fold", F.pmod(F.col("cum___one"), F.lit(folds)).cast("int"))
                  .drop("__order", "__one", "cum___one"))


def in_few_tasks(stored_rows: DataFrame, n: int, least: int = 1) -> DataFrame:
    """Iterative fits run hundreds of jobs over the rows: small inputs go to few
    tasks. ``coalesce`` only merges partitions, so large inputs keep theirs."""
    return stored_rows.coalesce(max(least, math.ceil(n / ROWS_PER_TASK)))


def tree_tasks(n: int) -> int:
    """Least number of tasks that boosting ``n`` rows is dealt to."""
    return max(1, min(TREE_TASKS, math.ceil(n / TREE_ROWS_PER_TASK)))


def model_feature_columns(df: DataFrame, extra_drop: list[str] | None = None) -> list[str]:
    """Numeric columns minus key, target and the redundancy list."""
    exclude = {KEY, TARGET, *DROP_FOR_MODELING, *(extra_drop or [])}
    return [c for c in numeric_columns(df) if c not in exclude]


def prepare_model_data(df: DataFrame,
                       extra_drop: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Features, ±inf → null, medians from the training rows only,
    train/test flag exact per class. Reads ``df`` more than once: pass a stored table."""
    cols = model_feature_columns(df, extra_drop)
    base = df.select(KEY, F.col(TARGET).cast("int").alias(TARGET),
                     *[clean_num(F.col(c).cast("double")).alias(c) for c in cols])
    base = base.withColumn("is_train", train_rows(base))
    # one row of training medians (one scalar per feature) → literal fills
    med = quantile_frame(base.where("is_train"), [(c, 0.5, f"{c}__med") for c in cols]).first()
    filled = base.select(KEY, TARGET, "is_train",
                         *[F.coalesce(F.col(c), F.lit(med[f"{c}__med"]).cast("double")).alias(c) for c in cols])
    return filled, cols


def variance_screen(prepared: DataFrame, cols: list[str]) -> DataFrame:
    """Population variance per feature (one aggregate), kept if > 0.001."""
    wide = prepared.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(cols)]
    return (wide.select(F.inline(F.array(*rows)))
                .withColumn("kept", F.coalesce(F.col("variance") > VARIANCE_THRESHOLD, F.lit(False))))


def split_counts(prepared: DataFrame) -> DataFrame:
    """M14 check: rows per (split, stratum)."""
    return prepared.groupBy("is_train", TARGET).agg(F.count(F.lit(1)).alias("n"))


def class_weights(prepared: DataFrame) -> DataFrame:
    """Balanced weights n / (2·n_c) per class and scale_pos_weight = round(neg/pos)."""
    g = prepared.where("is_train").groupBy(TARGET).agg(F.count(F.lit(1)).alias("n_class"))
    tot = g.agg(F.sum("n_class").alias("n_total"),
                F.sum(F.when(F.col(TARGET) == 0, F.col("n_class"))).alias("neg"),
                F.sum(F.when(F.col(TARGET) == 1, F.col("n_class"))).alias("pos"))
    return with_scalars(g, tot).select(
        TARGET, "n_class", (F.col("n_total") / (2.0 * F.col("n_class"))).alias("weight"),
        F.round(F.try_divide(F.col("neg"), F.col("pos"))).alias("scale_pos_weight"))


def with_weights(prepared: DataFrame) -> DataFrame:
    w = class_weights(prepared).select(TARGET, "weight")
    return prepared.join(F.broadcast(w), TARGET, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def kept_features(prepared: DataFrame, cols: list[str]) -> list[str]:
    """The variance screen decides the model's input columns (a ≤100-row result)."""
    return [r["feature"] for r in variance_screen(prepared, cols).where("kept").select("feature").collect()]


def population_scale(n_rows: int, width: int):
    """Factor from the sample deviation of ``StandardScaler`` to the population one."""
    return Vectors.dense([math.sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0] * width)


def logistic_pipeline(cols: list[str], n_rows: int, max_iter: int = 2000, c_inv_reg: float = 1.0, n_weight: float = 1.0):
    """Scaled (population deviation of the ``n_rows`` training rows), class-balanced
    L2 logistic regression (C = 1 → regParam = 1/(C·Σw))."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True),
        ElementwiseProduct(scalingVec=population_scale(n_rows, len(cols)), inputCol="scaled", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=TARGET, weightCol="weight", maxIter=max_iter,
                           regParam=1.0 / (c_inv_reg * max(n_weight, 1.0)), elasticNetParam=0.0,
                           standardization=False),
    ])


def gbt_pipeline(cols: list[str], max_iter: int = 400, variant: str = "A"):
    """Gradient-boosted trees. A: 400 trees depth 5, lr .05, subsample .8,
    70 % features per split, min 5 rows per node (no split-gain or L1/L2 analogue). B: min 50 rows per
    node; ``boosted_with_patience`` finds its number of trees."""
    if variant == "A":
        gbt = GBTClassifier(featuresCol="raw_features", labelCol=TARGET, weightCol="weight", maxIter=max_iter,
                            maxDepth=5, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.7",
                            minInstancesPerNode=5, seed=42)
    else:
        gbt = GBTClassifier(featuresCol="raw_features", labelCol=TARGET, weightCol="weight", maxIter=max_iter,
                            maxDepth=5, stepSize=0.05, minInstancesPerNode=50, seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="raw_features", handleInvalid="keep"), gbt])


def best_round(losses: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """The round (from 1) with the lowest loss before ``patience`` rounds bring no gain,
    and whether that many rounds were seen."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def boosted_with_patience(train: DataFrame, cols: list[str], max_iter: int = 500, patience: int = PATIENCE):
    """Variant B with as many trees as do best on the validation fold. A longer
    run begins with the trees of a shorter one, so one run of ``max_iter`` rounds shows
    where ``patience`` rounds bring no gain, and the best prefix is fitted last: less
    than twice ``max_iter`` trees in all."""
    learn, check = train.where(~F.col("is_valid")), train.where("is_valid")
    if check.isEmpty() or learn.isEmpty():
        return gbt_pipeline(cols, max_iter, "B").fit(train)
    model = gbt_pipeline(cols, max_iter, "B").fit(learn)
    best, _ = best_round(model.stages[-1].evaluateEachIteration(model.stages[0].transform(check)), patience)
    return model if best == max_iter else gbt_pipeline(cols, best, "B").fit(learn)


def positive_probability(pred: DataFrame) -> DataFrame:
    return pred.withColumn("score", vector_to_array(F.col("probability"))[1])


def training_data(prepared: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows of ``prepare_model_data`` with weight and validation fold, stored once for
    any number of learners, and the features that pass the variance screen."""
    feats = kept_features(prepared, cols)
    return cut_lineage(with_weights(prepared).withColumn("is_valid", valid_fold())), feats


def fit_and_score(data: DataFrame, feats: list[str], kind: str = "lr", max_iter: int | None = None) -> tuple[object, DataFrame]:
    """Fit on the training rows of ``training_data``, return (model, test predictions with score)."""
    train = data.where("is_train")
    test = data.where(~F.col("is_train"))
    n, n_w = train.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if kind == "lr":
        model = logistic_pipeline(feats, n, max_iter or 2000, n_weight=n_w or 1.0).fit(in_few_tasks(train, n))
    elif kind == "gbt_a":
        model = gbt_pipeline(feats, max_iter or 400, "A").fit(in_few_tasks(train, n, tree_tasks(n)))
    else:
        model = boosted_with_patience(in_few_tasks(train, n, tree_tasks(n)), feats, max_iter or 500)
    return model, positive_probability(model.transform(test))


def train_and_score(df: DataFrame, kind: str = "lr", max_iter: int | None = None, extra_drop: list[str] | None = None) -> tuple[object, DataFrame, list[str]]:
    """Prepare ``df`` and fit one learner: (model, test predictions with score, features)."""
    data, feats = training_data(*prepare_model_data(df, extra_drop))
    model, pred = fit_and_score(data, feats, kind, max_iter)
    return model, pred, feats


def model_comparison(results: dict[str, DataFrame]) -> DataFrame:
    """AUC-ROC and AUC-PR per model, best first."""
    parts = [auc_roc_pr(pred, TARGET, "score").select(F.lit(name).alias("model"), "auc_roc", "auc_pr")
             for name, pred in results.items()]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("auc_roc"))


def linear_attributions(model, scored_test: DataFrame, feats: list[str]) -> DataFrame:
    """M26 (re-aimed): exact attribution of a linear model in the standardized space,
    φ_j = β_j·(z_j − mean z_j), as column algebra on the test rows."""
    lr = model.stages[-1]
    beta = lr.coefficients.toArray().tolist()
    z = vector_to_array(F.col("features"))
    means = scored_test.select(z.alias("__z")).agg(
        *[F.avg(F.col("__z")[i]).alias(f"m{i}") for i in range(len(feats))])
    j = with_scalars(scored_test.select(KEY, z.alias("__z")), means)
    return j.select(KEY, *[(F.lit(beta[i]) * (F.col("__z")[i] - F.col(f"m{i}"))).alias(f) for i, f in enumerate(feats)])


def importance(attributions: DataFrame, feats: list[str], top_n: int = 15) -> DataFrame:
    """Mean |attribution| per feature, top-N."""
    wide = attributions.agg(*[F.avg(F.abs(F.col(f))).alias(f) for f in feats])
    return (wide.unpivot([], feats, "feature", "mean_abs_attribution")
                .orderBy(F.desc("mean_abs_attribution"), "feature").limit(top_n))


def search_draws(n: int, seed: int) -> list[dict[str, float]]:
    """``n`` seeded draws from ``SEARCH_SPACE``: the same on every run."""
    rng = random.Random(seed)
    low, high = (math.log(v) for v in SEARCH_SPACE["regParam"])
    return [{"regParam": math.exp(rng.uniform(low, high)), "elasticNetParam": rng.uniform(*SEARCH_SPACE["elasticNetParam"])}
            for _ in range(n)]


def cross_validated_lr(df: DataFrame, folds: int = 5, draws: int = 6, seed: int = 42) -> DataFrame:
    """Random hyper-parameter search, each draw scored by k-fold CV over
    deterministic, stratified folds of the training rows, which are stored once. A fold
    without both classes (fewer than ``folds`` rows of a class) makes the mean AUC a
    count of such folds more than a measure."""
    prepared, cols = prepare_model_data(df)
    feats = kept_features(prepared, cols)
    data = cut_lineage(stratified_folds(with_weights(prepared).where("is_train"), folds))
    n = data.count()
    data = in_few_tasks(data, n)
    pipe = logistic_pipeline(feats, n)
    lr = pipe.getStages()[-1]
    sampled = search_draws(draws, seed)
    grid = [{lr.getParam(k): v for k, v in draw.items()} for draw in sampled]
    ev = BinaryClassificationEvaluator(labelCol=TARGET, rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, foldCol="fold",
                        parallelism=4)
    m = cv.fit(data)
    rows = [(i, d["regParam"], d["elasticNetParam"], float(a)) for i, (d, a) in enumerate(zip(sampled, m.avgMetrics), 1)]
    return df.sparkSession.createDataFrame(rows, "draw int, reg_param double, elastic_net double, mean_auc double")


def approval_model_data(prev: DataFrame, features: DataFrame) -> DataFrame:
    """Approved (1) vs refused (0) previous applications with the customer's
    features attached by key (customer-grain right side). Features computed from the
    previous applications themselves hold the outcome and are left out."""
    lab = (prev.where(F.col("NAME_CONTRACT_STATUS").isin("Approved", "Refused"))
               .select(KEY, "SK_ID_PREV", (F.col("NAME_CONTRACT_STATUS") == "Approved").cast("int").alias(TARGET),
                       "AMT_APPLICATION", "AMT_ANNUITY", "DAYS_DECISION", "NFLAG_LAST_APPL_IN_DAY"))
    leaks = [c for c in features.columns if c.startswith("prev_") or c in ("behavioral_score", "composite_score", "tier")]
    return lab.join(features.drop(TARGET, *leaks), KEY, "left")


def tree_importance(spark, model, feats: list[str], top_n: int = 15) -> DataFrame:
    """G5 re-aimed: split-gain importance of the boosted trees (one value per
    feature, a vector bounded by the feature count)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(feats, imp), key=lambda kv: (-kv[1], kv[0]))[:top_n]
    return spark.createDataFrame([(f, float(v)) for f, v in rows], "feature string, importance double")
