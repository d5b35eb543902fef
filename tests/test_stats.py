"""Test statistics against direct formulas on small fixtures."""
import numpy as np
import pandas as pd

from creditlake.functions.special import f_upper_p, t_two_sided_p
from creditlake.operators import stats as ST


def test_p_values_known():
    assert abs(t_two_sided_p(2.0, 10.0) - 0.07338803) < 1e-7
    assert abs(t_two_sided_p(0.0, 5.0) - 1.0) < 1e-12
    assert abs(f_upper_p(4.0, 1.0, 20.0) - 0.05919) < 1e-4


def test_welch_and_anova(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(1.0, 2.0, 80); b = rng.normal(0.3, 1.0, 120)
    pdf = pd.DataFrame({"g": [1] * 80 + [0] * 120, "x": np.r_[a, b]})
    df = spark.createDataFrame(pdf)
    r = ST.welch_ttest(df, "g", ["x"]).first()
    va, vb = a.var(ddof=1) / 80, b.var(ddof=1) / 120
    t = (a.mean() - b.mean()) / np.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va ** 2 / 79 + vb ** 2 / 119)
    assert abs(r["t_stat"] - t) < 1e-9 and abs(r["dof"] - dof) < 1e-6
    f = ST.anova_two_groups(df, "g", ["x"]).first()
    grand = pdf.x.mean()
    ssb = 80 * (a.mean() - grand) ** 2 + 120 * (b.mean() - grand) ** 2
    ssw = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    assert abs(f["f_stat"] - ssb / (ssw / 198)) < 1e-6


def test_kruskal_with_ties(spark):
    x = np.array([1, 2, 2, 3, 4, 4, 4, 5, 6, 7], dtype=float)
    g = np.array([0, 0, 1, 0, 1, 1, 0, 1, 1, 0])
    df = spark.createDataFrame(pd.DataFrame({"v": x, "g": g}))
    h = ST.kruskal_wallis(df, "v", "g").first()["h_stat"]
    ranks = pd.Series(x).rank().to_numpy()
    n = len(x)
    hh = 12 / (n * (n + 1)) * sum(ranks[g == k].sum() ** 2 / (g == k).sum() for k in (0, 1)) - 3 * (n + 1)
    _, t = np.unique(x, return_counts=True)
    hh /= 1 - (t ** 3 - t).sum() / (n ** 3 - n)
    assert abs(h - hh) < 1e-9


def test_bounded_exact_quantiles_match_pandas(spark):
    from creditlake.functions.quantiles import quantile_frame
    rng = np.random.default_rng(11)
    n = 5000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": np.where(rng.random(n) < 0.6, 0.0, rng.integers(0, 4, n)),
                        "g": rng.integers(0, 3, n)})
    pdf.loc[rng.random(n) < 0.1, "a"] = None
    df = spark.createDataFrame(pdf.astype({"a": "float64", "b": "float64"})).replace(float("nan"), None)
    specs = [("a", 0.5, "a50"), ("a", 0.25, "a25"), ("b", 0.5, "b50"), ("b", 0.9, "b90"), ("a", 1.0, "amax")]
    r = quantile_frame(df, specs, accuracy=500).first()
    for c, p, a in specs:
        assert abs(r[a] - pdf[c].quantile(p)) < 1e-12, a
    g = {row["g"]: row["m"] for row in quantile_frame(df, [("a", 0.5, "m")], group_cols=["g"], accuracy=500).collect()}
    for k, v in pdf.groupby("g")["a"].median().items():
        assert abs(g[k] - v) < 1e-12
