"""Evaluation metrics against brute force on small fixtures."""
import numpy as np
import pandas as pd

from creditlake.functions.cumulative import running_totals
from creditlake.operators import metrics as ME


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _brute_pr_auc(y, s):
    order = np.argsort(-s, kind="mergesort")
    ys, ss = y[order], s[order]
    distinct = np.r_[np.where(np.diff(ss))[0], len(ss) - 1]
    tps = np.cumsum(ys)[distinct]
    fps = (1 + distinct) - tps
    P = ys.sum()
    last = np.searchsorted(tps, tps[-1])
    prec = np.r_[1.0, (tps / (tps + fps))[: last + 1]]
    rec = np.r_[0.0, (tps / P)[: last + 1]]
    return float(np.sum(np.diff(rec) * (prec[1:] + prec[:-1]) / 2))


def test_auc_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) + 0.3 * y, 2)          # ties on purpose
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    r = ME.auc_roc_pr(df, "label", "score").first()
    assert abs(r["auc_roc"] - _brute_auc(y, s)) < 1e-9
    assert abs(r["auc_pr"] - _brute_pr_auc(y, s)) < 1e-9
    flipped = ME.auc_roc_pr(df.selectExpr("label", "-score AS score"), "label", "score").first()
    assert abs(flipped["auc_roc"] - (1 - r["auc_roc"])) < 1e-9


def test_running_totals_match_cumsum(spark):
    vals = np.arange(1000)
    df = spark.createDataFrame(pd.DataFrame({"k": vals[::-1].copy(), "w": vals % 7}))
    out = running_totals(df, "k", ["w"], n_partitions=5).toPandas().sort_values("k")
    assert (out["cum_w"].to_numpy() == np.cumsum(out["w"].to_numpy())).all()


def test_report_from_published_confusion(spark):
    cm = spark.createDataFrame([(0, 0, 48908), (0, 1, 7630), (1, 0, 2991), (1, 1, 1974)],
                               "actual int, predicted int, n long")
    rep = {r["label"]: r for r in ME.classification_report(cm).collect()}
    assert round(rep["Default"]["precision"], 4) == 0.2055 and round(rep["Default"]["recall"], 4) == 0.3976
    assert round(rep["Default"]["f1"], 4) == 0.2710 and round(rep["accuracy"]["f1"], 4) == 0.8273


def test_threshold_sweep_first_best(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.4), (0, 0.1)], "label int, score double")
    best = ME.best_threshold(ME.threshold_sweep(df, "label", "score")).first()
    y = np.array([1, 1, 0, 1, 0]); s = np.array([0.9, 0.8, 0.7, 0.4, 0.1])
    f1s = []
    for t in np.linspace(0.05, 0.70, 65):
        p = s >= t; tp = (p & (y == 1)).sum(); fp = (p & (y == 0)).sum(); fn = ((~p) & (y == 1)).sum()
        f1s.append(0 if tp == 0 else 2 * tp / (2 * tp + fp + fn))
    i = int(np.argmax(f1s))
    assert abs(best["best_f1"] - f1s[i]) < 1e-12 and abs(best["best_threshold"] - np.linspace(0.05, 0.70, 65)[i]) < 1e-12
