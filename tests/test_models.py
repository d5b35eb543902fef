"""MLlib pipeline checks: planted signal is learned; linear attributions add up."""
import math
from threading import Barrier

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from creditlake.config import CLUSTER_FEATURES
from creditlake.operators import models as MD
from creditlake.operators import segments as SG
from creditlake.operators.metrics import auc_roc_pr
from creditlake.plans import master as M
from creditlake.plans import queries_ml as Q


def _planted(spark):
    """Label = late-payment share above its median, flipped for 10 % of keys."""
    mt = M.model_table(spark, SF_CHECK)
    med = mt.agg(F.percentile("inst_late_ratio", 0.5)).first()[0]
    label = (F.col("inst_late_ratio") > med).cast("int")
    flip = (F.col("SK_ID_CURR") % 10) == 3
    return mt.withColumn("TARGET", F.when(flip, 1 - label).otherwise(label))


def test_cluster_features_have_population_deviation_one(spark):
    prep = SG.cluster_input(M.feature_input(M.master_table(spark, SF_CHECK)))
    values = vector_to_array("features")
    spread = prep.agg(*[F.var_pop(values[i]) for i in range(len(CLUSTER_FEATURES))]).first()
    varying = [v for v in spread if v > 0]
    assert varying and all(abs(v - 1) < 1e-9 for v in varying)
    assert abs(SG.inertia_k1(prep) - prep.count() * len(varying)) < 1e-6


def test_planted_signal_is_learned(spark):
    model, pred, feats = MD.train_and_score(_planted(spark), "lr", 50)
    auc = auc_roc_pr(pred, "TARGET", "score").first()["auc_roc"]
    assert auc > 0.75, auc


def test_linear_attributions_add_up_to_logit(spark):
    model, pred, feats = MD.train_and_score(_planted(spark), "lr", 50)
    lr = model.stages[-1]
    att = MD.linear_attributions(model, pred, feats)
    z = vector_to_array(F.col("features"))
    beta = lr.coefficients.toArray().tolist()
    means = pred.select(*[F.avg(z[i]).alias(f"m{i}") for i in range(len(feats))]).first()
    base = lr.intercept + sum(b * means[f"m{i}"] for i, b in enumerate(beta))
    rows = att.join(pred.select("SK_ID_CURR", "score"), "SK_ID_CURR").limit(20).collect()
    for r in rows:
        logit = base + sum(r[f] for f in feats)
        assert abs(1 / (1 + math.exp(-logit)) - r["score"]) < 1e-9


def test_folds_are_stratified(spark):
    rows = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(200)], f"{MD.KEY} long, {MD.TARGET} int")
    got = MD.stratified_folds(rows, 5).collect()
    per = {c: [sum(r.fold == k and r[MD.TARGET] == c for r in got) for k in range(5)] for c in (0, 1)}
    assert len(got) == 200 and all(max(n) - min(n) <= 1 for n in per.values())


def test_tree_queries_use_the_default_rounds(spark, monkeypatch):
    """The registered queries reach MLlib with the 400 and 500 rounds of the operators."""
    rounds, whole = {}, MD.gbt_pipeline

    class Seen(Exception):
        pass

    def seen(cols, max_iter=None, variant="A"):
        rounds[variant] = whole(cols, max_iter, variant).getStages()[-1].getMaxIter()
        raise Seen

    monkeypatch.setattr(MD, "gbt_pipeline", seen)
    monkeypatch.setattr(Q, "_FITTED", {})
    for query in (Q.q_m17, Q.q_m27g, Q.q_m18):
        try:
            query(spark, SF_SMALL)
        except Seen:
            pass
    assert rounds == {"A": 400, "B": 500}


def test_metrics_report_holds_all_models(spark, monkeypatch):
    pred = spark.createDataFrame([(i, i % 2, (i * 7 % 10) / 10) for i in range(20)], f"{MD.KEY} long, {MD.TARGET} int, score double")
    monkeypatch.setattr(Q, "_scores", lambda spark, sf, kind, *more: (None, pred, []))
    assert {r.model for r in Q.q_s10(spark, SF_SMALL).collect()} == {"LogisticRegression", "GBT-A", "GBT-B"}


def test_boosting_with_patience_fits_no_runs_of_growing_length(spark, monkeypatch):
    """A loss that falls to the end takes one run of all rounds; else the best prefix follows."""
    rounds, losses = [], {}

    class Fitted:
        def __init__(self, n):
            rounds.append(n)
            self.stages, self.n = [self, self], n

        def fit(self, rows):
            return self

        def transform(self, rows):
            return rows

        def evaluateEachIteration(self, rows):
            return [losses.get(i, 1 / (i + 1)) for i in range(self.n)]

    monkeypatch.setattr(MD, "gbt_pipeline", lambda cols, n, variant: Fitted(n))
    train = spark.range(10).selectExpr("id % 5 = 0 as is_valid")
    assert MD.boosted_with_patience(train, ["x"]).n == 500 and rounds == [500]
    rounds.clear()
    losses.update({299: -1.0})
    assert MD.boosted_with_patience(train, ["x"]).n == 300 and rounds == [500, 300]


def _side_by_side(spark, monkeypatch):
    """Scores of learners that each wait until all three are being fitted."""
    pred = spark.createDataFrame([(i, i % 2, (i * 7 % 10) / 10) for i in range(20)], f"{MD.KEY} long, {MD.TARGET} int, score double")
    met = Barrier(3)

    def fitted(spark, sf, kind, *more):
        if kind not in seen:
            met.wait(timeout=20)
            seen.append(kind)
        return None, pred, []

    seen = []
    monkeypatch.setattr(Q, "_training", lambda *a: None, raising=False)
    monkeypatch.setattr(Q, "_scores", fitted)
    return seen


def test_compared_learners_are_fitted_side_by_side(spark, monkeypatch):
    seen = _side_by_side(spark, monkeypatch)
    assert {r.model for r in Q.q_m25(spark, SF_SMALL).collect()} == {"LogisticRegression", "GBT-A", "GBT-B"}
    assert sorted(seen) == ["gbt_a", "gbt_b", "lr"]


def test_a_failed_fit_fails_the_comparison(spark, monkeypatch):
    pred = spark.createDataFrame([(1, 1, 0.5)], f"{MD.KEY} long, {MD.TARGET} int, score double")

    def fitted(spark, sf, kind, *more):
        if kind == "gbt_a":
            raise ValueError(kind)
        return None, pred, []

    monkeypatch.setattr(Q, "_training", lambda *a: None, raising=False)
    monkeypatch.setattr(Q, "_scores", fitted)
    with pytest.raises(ValueError, match="gbt_a"):
        Q.q_m25(spark, SF_SMALL)


def test_learners_share_the_training_rows(spark, monkeypatch):
    """Each learner gets the same stored rows: they are prepared once."""
    screens, whole = [], MD.kept_features

    class Seen(Exception):
        pass

    def seen(*more):
        raise Seen

    monkeypatch.setattr(MD, "kept_features", lambda *a: screens.append(1) or whole(*a))
    for name in ("logistic_pipeline", "gbt_pipeline"):
        monkeypatch.setattr(MD, name, lambda *a, **b: seen())
    for name in ("_FITTED", "_TRAINING"):
        monkeypatch.setattr(Q, name, {}, raising=False)
    for query in (Q.q_m16, Q.q_m17, Q.q_m18):
        with pytest.raises(Seen):
            query(spark, SF_SMALL)
    assert len(screens) == 1


def test_boosting_gets_more_tasks_than_one_block_of_rows(spark):
    assert [MD.tree_tasks(n) for n in (0, 1, 25_000, 25_001, 72_000, 720_000, 21_600_000)] == [1, 1, 1, 2, 3, 8, 8]
    rows = spark.range(0, 100, 1, 12)
    parts = [MD.in_few_tasks(rows, n, MD.tree_tasks(n)).rdd.getNumPartitions() for n in (12_000, 72_000, 720_000, 1_000_000)]
    assert parts == [1, 3, 8, 10]
    assert MD.in_few_tasks(rows, 72_000).rdd.getNumPartitions() == 1


def test_report_fits_the_learners_side_by_side(spark, monkeypatch):
    class Trees:
        featureImportances = Vectors.dense([0.7, 0.3])

    model = Trees()
    model.stages = [model]
    seen = _side_by_side(spark, monkeypatch)
    waiting = Q._scores
    monkeypatch.setattr(Q, "_scores", lambda *a: (model, waiting(*a)[1], ["x", "y"]))
    monkeypatch.setattr(Q, "LEARNERS", {"GBT-A": "gbt_a", "GBT-B": "gbt_b", "GBT-C": "gbt_c"})
    got = Q.q_m29(spark, SF_SMALL).collect()
    assert sorted(seen) == ["gbt_a", "gbt_b", "gbt_c"]
    assert {r.section for r in got} == {"auc_roc", "auc_pr", "best_model", "threshold", "confusion", "top_features"}
    assert sum(r.value for r in got if r.section == "confusion") == 20


def test_metrics_report_fits_the_learners_side_by_side(spark, monkeypatch):
    seen = _side_by_side(spark, monkeypatch)
    assert len(Q.q_s10(spark, SF_SMALL).collect()) == 3
    assert sorted(seen) == ["gbt_a", "gbt_b", "lr"]
