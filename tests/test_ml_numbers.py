"""Models of MLlib against NumPy: projections, the optimum of the site model, areas of left-out members, channels that say nothing."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sitegrid.operators import ml as M


def table(spark, x, y, **more):
    rows = [(k, v.tolist(), int(z), *(c[1][k] for c in more.values())) for k, (v, z) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "id long, a array<double>, label int" + "".join(f", {n} {c[0]}" for n, c in more.items()))
    return d.withColumn("features", array_to_vector("a")).persist()


def data(seed, n=150, d=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    return x, (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0.5).astype(int)


def area(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_projection_is_that_of_the_covariance(spark):
    x, y = data(1)
    x = x * [3, 1, 2, 0.5]
    got = np.array([r.pca.toArray() for r in M.project(table(spark, x, y), 2).orderBy("id").collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = x @ vectors[:, np.argsort(-values)[:2]]
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-8)


def test_the_site_model_is_at_its_optimum(spark):
    x, y = data(2)
    m = M.fit_site_model(table(spark, x, y))
    w, b = m.coefficients.toArray(), m.intercept
    by = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    err = by * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(x.T @ err / by.sum() + 0.01 * w).max() < 2e-3 and abs(err.sum() / by.sum()) < 2e-3
    scores = np.array([r.score for r in M.scored(m, table(spark, x, y)).orderBy("id").collect()])
    assert scores == pytest.approx(1 / (1 + np.exp(-(x @ w + b))))


def test_left_out_members_have_the_area_of_a_model_of_the_others(spark):
    x, y = data(3)
    member = (np.arange(len(y)) % 3).astype(str)
    d = table(spark, x, y, member=("string", member.tolist()))
    got = {r.member: r for r in M.leave_one_dataset_out(d, "member").collect()}
    assert set(got) == {"0", "1", "2"}
    for k, r in got.items():
        m = M.fit_site_model(d.where(F.col("member") != k))
        s = x @ m.coefficients.toArray() + m.intercept
        assert (r.n_pos, r.n_neg) == (y[member == k].sum(), (1 - y[member == k]).sum())
        assert r.auroc == pytest.approx(area(y[member == k], s[member == k]))


def test_a_channel_that_says_nothing_costs_nothing(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([np.arange(80) >= 40, np.zeros(80), rng.normal(size=80) * 1e-9]).astype(float)
    y = (np.arange(80) >= 40).astype(int)
    d = table(spark, x, y).withColumn("all", F.lit(0))
    got = {r.channel: r.loss for r in M.channel_importance(M.fit_site_model(d), d.select("id", "label", "all", "a"), ["c0", "c1"], "a", ["all"]).collect()}
    assert got["c1"] == pytest.approx(0) and got["c0"] > 0.2


def test_probe_and_forest_find_what_separates(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 120)
    x = np.column_stack([10.0 * y + rng.normal(size=120), rng.normal(size=120)])
    d = table(spark, x, y)
    got = {r.label: (r.accuracy, r.n) for r in M.probe(d.where("id < 90"), d.where("id >= 90")).collect()}
    assert got == {k: (1.0, int((y[90:] == k).sum())) for k in set(y[90:].tolist())}
    f = d.withColumns({"u": F.col("a")[0], "v": F.col("a")[1], "z": (F.col("label") > 0).cast("int")})
    imp = {r.feature: r.importance for r in M.forest_importance(f, ["u", "v"], "z").collect()}
    assert sum(imp.values()) == pytest.approx(1) and imp["u"] > 0.8


def test_a_forest_reads_parts_of_a_fixed_size(spark, monkeypatch):
    d = spark.range(1000, numPartitions=1).selectExpr("id % 7 AS u", "id % 3 AS v", "cast(id % 7 > 3 AS int) AS y")
    parts, fit = [], M.RandomForestClassifier.fit
    monkeypatch.setattr(M.RandomForestClassifier, "fit", lambda self, x: parts.extend(x.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()) or fit(self, x))
    imp = {r.feature: r.importance for r in M.forest_importance(d, ["u", "v"], "y", rows=100).collect()}
    assert imp["u"] > 0.8 and sum(parts) == 1000 and max(parts) <= 120
