"""Quantile selection, tables keyed by their inputs, exact split, random search, patience."""
import shutil

import numpy as np
import pandas as pd
import pytest

from creditlake.config import KEY, TARGET
from creditlake.functions import quantiles
from creditlake.operators import models, stats
from creditlake.plans import master
from creditlake.sources import io

from conftest import SF_SMALL


def table(spark, n=3000):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[.6, .39, .01]), "a": rng.normal(size=n),
                        "z": np.where(rng.random(n) < .8, 0.0, rng.random(n)), "nul": np.nan})
    pdf.loc[rng.random(n) < .1, "a"] = np.nan
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, a double, z double, nul double")


SPECS = [(c, p, f"{c}{i}") for c in ("a", "z") for i, p in enumerate((0, 0.001, .25, .5, .777, 1))] + [("nul", .5, "nul")]


@pytest.mark.parametrize("accuracy", [50, 10_000])  # many rounds, one round
def test_selected_quantiles_match_pandas(spark, accuracy):
    pdf, df = table(spark)
    row = quantiles.quantile_frame(df.cache(), SPECS, accuracy=accuracy).first()
    for c, p, alias in SPECS:
        want = pdf[c].quantile(p)
        assert (row[alias] is None and np.isnan(want)) or row[alias] == pytest.approx(want, abs=1e-12)


def test_selected_quantiles_in_groups(spark):
    pdf, df = table(spark)
    specs = [("a", .5, "m"), ("z", .9, "q"), ("nul", .5, "nul")]
    got = {r.g: r for r in quantiles.quantile_frame(df.cache(), specs, ["g"], accuracy=100).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, r in got.items():
        assert r.nul is None and r.m == pytest.approx(pdf[pdf.g == g].a.quantile(.5)) and r.q == pytest.approx(pdf[pdf.g == g].z.quantile(.9))


def test_an_unreached_rank_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        quantiles.select_quantiles(table(spark)[1], [("a", 0.37)], accuracy=50)


def test_state_does_not_grow_with_the_rows(spark):
    """What comes back to the driver is a few numbers per quantile at any size."""
    plan = quantiles._Selection("a", 0.5, f=5 * 10 ** 10, n=10 ** 11, above=10 ** 11)
    for _ in range(4):  # each round leaves about 4 / accuracy of the values
        if plan.few(10_000):
            break
        width = max(1, (plan.above - plan.base) * 2 // 10_000)
        plan.settle([(-1.0 / (plan.f - plan.base + 1), plan.f - width, plan.f - width + 1, None), (1.0, plan.f + width, plan.f + width + 1, None)])
    assert plan.few(10_000)


def test_rewritten_inputs_are_read_anew(spark, tmp_path):
    folder = str(tmp_path / "sf")
    shutil.copytree(SF_SMALL, folder)
    before, state = master.master_table(spark, folder).count(), master.inputs(spark, folder)
    assert master.master_table(spark, folder) is master.master_table(spark, folder)
    customers = pd.read_parquet(f"{folder}/customer.parquet")
    customers.head(len(customers) // 2).to_parquet(f"{folder}/customer.parquet")
    assert master.inputs(spark, folder) != state
    after = master.master_table(spark, folder)
    assert after.count() < before
    plan = after.select(KEY, "AMT_CREDIT")._jdf.queryExecution().toString()
    assert plan.split("ReadSchema: ")[1].count(":") == 2  # two of the columns


def test_fingerprint_ignores_order(spark):
    paths = [f"{SF_SMALL}/{t}.parquet" for t in ("customer", "orders")]
    assert io.input_fingerprint(spark, paths) == io.input_fingerprint(spark, paths[::-1])


def test_split_is_exact_per_class(spark):
    rows = [(i * 7919, int(i % 13 == 0)) for i in range(1003)] + [(5, None), (6, None)]
    df = spark.createDataFrame(rows, f"{KEY} long, {TARGET} int")
    got = df.withColumn("t", models.train_rows(df)).groupBy(TARGET).agg({"t": "count", "*": "count"}).collect()
    shares = {r[TARGET]: r for r in df.withColumn("t", models.train_rows(df).cast("int")).groupBy(TARGET).agg({"t": "sum", "*": "count"}).collect()}
    assert len(got) == 3
    for r in shares.values():
        assert abs(r["sum(t)"] - 0.8 * r["count(1)"]) <= 0.5 + 1e-9
    one = spark.createDataFrame([(1, 1)] * 10, f"{KEY} long, {TARGET} int")  # rows of a key stay together
    assert one.where(models.train_rows(one)).count() == 10
    assert df.limit(0).where(models.train_rows(df.limit(0))).count() == 0


def test_random_search_draws():
    draws = models.search_draws(50, 42)
    assert draws == models.search_draws(50, 42) != models.search_draws(50, 43)
    for name, (low, high) in models.SEARCH_SPACE.items():
        assert all(low <= d[name] <= high for d in draws) and len({d[name] for d in draws}) == 50


def test_patience_waits_for_a_recovery():
    dip = [5.0, 4.0, 4.5, 4.6, 4.7, 3.0, 3.1, 3.2, 3.3, 3.4]
    assert models.best_round(dip, 4) == (6, True)
    assert models.best_round(dip, 2) == (2, True)
    assert models.best_round(dip, 5) == (6, False)
    assert models.best_round([1.0], 3) == (1, False)


def test_a_longer_boosting_begins_with_the_shorter_one(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(a + b > 0), float(a), float(b), 1.0) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, f"{KEY} long, {TARGET} int, a double, b double, weight double").coalesce(1)
    short, long = (models.gbt_pipeline(["a", "b"], n, "B").fit(df).stages[-1] for n in (2, 4))
    assert [t.toDebugString.split("\n", 1)[1] for t in short.trees] == [t.toDebugString.split("\n", 1)[1] for t in long.trees][:2]


def test_one_row_has_no_rank_statistic(spark):
    df = spark.createDataFrame([(1.0, "a")], "v double, g string")
    assert stats.kruskal_wallis(df, "v", "g").first()["h_stat"] is None


def test_moments_of_two_groupings_from_one_scan(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.normal(5, 2, 300), "t": rng.integers(0, 2, 300), "y": rng.integers(0, 2, 300)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, t int, y int")
    for g, found in zip(("t", "y"), stats._group_moments(df, ["t", "y"], ["x"])):
        r = found.first()
        for v in (0, 1):
            own = pdf[pdf[g] == v].x.dropna()
            assert (r[f"n{v}"], r[f"m{v}"], r[f"v{v}"]) == pytest.approx((len(own), own.mean(), own.var()))
