"""Binary-classifier evaluation as DataFrame jobs.

Scores are first grouped to distinct values (pos/neg counts per score), so the
only ordered step runs on the distinct-score table through the distributed
running total. Threshold sweeps are a single wide aggregate (one pair of
conditional counts per grid point), not a job per threshold.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import THRESHOLD_GRID
from ..functions.cumulative import running_totals
from ..functions.exprs import with_scalars


def score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col(score).alias("score"))
              .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))


def _desc_cumulative(df: DataFrame, label: str, score: str) -> DataFrame:
    return running_totals(score_groups(df, label, score), "score", ["pos", "neg"], ascending=False)


def auc_roc_pr(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """M19 + M20: ROC AUC (rank-sum, ties count one half) and PR AUC (trapezoid over
    the precision-recall points, starting at recall 0 / precision 1, ending at the
    first point reaching full recall)."""
    cum = _desc_cumulative(df, label, score)
    totals = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = with_scalars(cum, totals)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    prec = F.try_divide(tp, tp + fp)
    prec0 = F.when(tp0 + fp0 == 0, 1.0).otherwise(F.try_divide(tp0, tp0 + fp0))
    roc_term = F.col("pos") * (F.col("N") - fp + F.col("neg") / 2.0)
    pr_term = F.when(tp0 < F.col("P"), F.col("pos") / F.col("P") * (prec + prec0) / 2.0).otherwise(0.0)
    return j.agg((F.sum(roc_term) / (F.first("P") * F.first("N"))).alias("auc_roc"),
                 F.sum(pr_term).alias("auc_pr"),
                 F.first("P").alias("n_pos"), F.first("N").alias("n_neg"))


def roc_pr_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One curve point per distinct score (descending): fpr, tpr, precision, recall."""
    cum = _desc_cumulative(df, label, score)
    totals = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = with_scalars(cum, totals)
    return j.select(F.col("score").alias("threshold"),
                    F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"),
                    F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"),
                    F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"))


def threshold_grid(start=THRESHOLD_GRID[0], stop=THRESHOLD_GRID[1], n=THRESHOLD_GRID[2]) -> list[float]:
    return [float(x) for x in np.linspace(start, stop, n)]


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score",
                    grid: list[float] | None = None) -> DataFrame:
    """precision/recall/F1 at every grid threshold (pred = score ≥ t). Each row is
    counted once, at the number of thresholds it passes; a threshold's counts are the
    sums of the places above it, over a table of one row per threshold."""
    grid = sorted(grid or threshold_grid())
    passed = sum((F.coalesce(F.col(score) >= F.lit(t), F.lit(False)).cast("int") for t in grid), F.lit(0))
    places = (df.select(passed.alias("k"), (F.col(label) == 1).alias("y")).groupBy("k")
                .agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")))
    one = places.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.collect_list(F.struct("k", "pos", "neg")).alias("places"))
    rows = [F.struct(F.lit(i).alias("grid_index"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)]
    long = one.select("P", "places", F.inline(F.array(*rows)))

    def above(count: str) -> F.Column:
        return F.aggregate("places", F.lit(0).cast("long"),
                           lambda acc, p: acc + F.when(p["k"] > F.col("grid_index"), p[count]).otherwise(0))
    long = long.withColumns({"tp": above("pos"), "fp": above("neg")})
    fn = F.col("P") - F.col("tp")
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + fn))
    return long.select("grid_index", "threshold", "tp", "fp", fn.alias("fn"), f1.alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """First grid point with the maximal F1 (ties → smallest threshold);
    0.5 when no threshold finds a positive row."""
    return (sweep.agg(F.max_by(F.struct("threshold", "f1"),
                               F.struct(F.col("f1"), -F.col("grid_index"))).alias("b"))
                 .select(F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(0.5).alias("best_threshold"), F.col("b.f1").alias("best_f1")))


def confusion_matrix(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Counts per (actual, predicted) with pred = score ≥ threshold."""
    pred = (F.col(score) >= F.lit(threshold)).cast("int")
    return (df.groupBy(F.col(label).cast("int").alias("actual"), pred.alias("predicted"))
              .agg(F.count(F.lit(1)).alias("n")))


def classification_report(cm: DataFrame) -> DataFrame:
    """Precision / recall / F1 / support per class, plus accuracy, macro and
    weighted averages — arithmetic on the 4-cell confusion matrix."""
    c = cm.agg(*[F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n")).otherwise(0))
                 .alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)])
    rows = []
    for k in (0, 1):
        tp = F.col(f"c{k}{k}")
        fp = F.col(f"c{1 - k}{k}")
        fn = F.col(f"c{k}{1 - k}")
        prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
        rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        rows.append((F.lit("Default" if k else "No Default"), prec, rec, f1, (tp + fn)))
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    acc = (F.col("c00") + F.col("c11")) / total
    structs = [F.struct(n.alias("label"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f.cast("double").alias("f1"), s.cast("bigint").alias("support")) for n, p, r, f, s in rows]
    macro = [F.struct(F.lit("macro avg").alias("label"), ((rows[0][1] + rows[1][1]) / 2).alias("precision"),
                      ((rows[0][2] + rows[1][2]) / 2).alias("recall"), ((rows[0][3] + rows[1][3]) / 2).alias("f1"),
                      total.cast("bigint").alias("support"))]
    weighted = [F.struct(F.lit("weighted avg").alias("label"),
                         ((rows[0][1] * rows[0][4] + rows[1][1] * rows[1][4]) / total).alias("precision"),
                         ((rows[0][2] * rows[0][4] + rows[1][2] * rows[1][4]) / total).alias("recall"),
                         ((rows[0][3] * rows[0][4] + rows[1][3] * rows[1][4]) / total).alias("f1"),
                         total.cast("bigint").alias("support"))]
    accuracy = [F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"),
                         acc.alias("f1"), total.cast("bigint").alias("support"))]
    return c.select(F.inline(F.array(*(structs + macro + weighted + accuracy))))
