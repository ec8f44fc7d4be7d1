"""Chosen models against NumPy: nearest neighbours, training rounds, mixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sitegrid.operators import models as X

rng = np.random.default_rng(3)


def table(spark, x, **more):
    rows = [(k, v.tolist(), *(c[1][k] for c in more.values())) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>" + "".join(f", {n} {c[0]}" for n, c in more.items()))


@pytest.mark.parametrize("size", [4096, 7])
def test_nearest_are_those_of_all_pairs(spark, size):
    x = np.round(rng.normal(size=(150, 5)), 1)
    x[40:60] = x[3]  # ties
    d = table(spark, x, label=("int", rng.integers(0, 2, 150).tolist())).repartition(5)
    got = X.nearest(d.where("id % 3 = 0"), d, 9, "id", "features", ["label"], size).collect()
    assert len(got) == 50
    for r in got:
        want = sorted((math.sqrt(float(((x[r.query] - y) ** 2).sum())), k) for k, y in enumerate(x))[:9]
        assert [n.id for n in r.nearest] == [k for _, k in want]
        assert [n.distance for n in r.nearest] == pytest.approx([v for v, _ in want])
    few = X.nearest(d.where("id < 2"), d.where("id < 4"), 9, "id", "features", ["label"], size).collect()
    assert sorted(len(r.nearest) for r in few) == [4, 4]
    assert X.nearest(d, d.limit(0), 9, "id", "features", ["label"], size).count() == 0


def test_knn_probe_votes(spark):
    x = rng.normal(size=(120, 4)) * [1, 100, 0.01, 0] + 5  # scales differ, one feature is flat
    y = (x[:, 0] > 5).astype(int)
    d = table(spark, x, label=("int", y.tolist()))
    got = {r.id: r.score for r in X.knn_probe(d.where("id >= 40"), d.where("id < 40"), "id", k=11).collect()}
    m, s = x[40:].mean(0), x[40:].std(0)
    z = (x - m) / np.where(s > 1e-9, s, 1)
    for i in range(40):
        near = np.argsort(((z[40:] - z[i]) ** 2).sum(1), kind="stable")[:11]
        assert got[i] == pytest.approx(y[40:][near].mean())


def auprc(y, p):
    out, tp, at = 0.0, 0, sorted(set(p), reverse=True)
    for t in at:
        here = [a for a, b in zip(y, p) if b == t]
        tp += sum(here)
        out += sum(here) * tp / sum(b >= t for b in p)
    return out / sum(y)


def test_rounds_are_those_of_a_local_loop(spark):
    n = 240
    x = rng.normal(size=(n, 3))
    y = (x @ [1.5, -1, 0.2] + rng.normal(size=n) > 0.8).astype(int)
    d = table(spark, x, label=("int", y.tolist()), pos=("long", (np.arange(n) // 3).tolist())).repartition(3).persist()
    got = X.train_validated(d, ["pos"], rounds=30, patience=3, rate=4.0, frac=0.3)
    from sitegrid.operators import splits

    val = {r.id for r in splits.carve_val(d, 0.3, 1, ["pos"]).where("part = 'val'").collect()}
    assert all(len({(3 * k + j) in val for j in range(3)}) == 1 for k in range(n // 3))
    t = np.array([k not in val for k in range(n)])
    w, rate, best, kept, score, idle, history = np.zeros(4), 4.0, 0, None, -1.0, 0, []
    xb = np.column_stack([x, np.ones(n)])
    up = (t.sum() - y[t].sum()) / y[t].sum()
    for r in range(1, 31):
        z = xb[t] @ w
        by = np.where(y[t] == 1, up, 1.0)
        loss = (by * (np.log1p(np.exp(z)) - y[t] * z)).mean()
        w = w - rate * (xb[t].T @ (by * (1 / (1 + np.exp(-z)) - y[t])) / t.sum() + 1e-4 * np.append(w[:-1], 0))
        p = 1 / (1 + np.exp(-xb @ w))
        pos = sorted({k // 3 for k in val})
        now = auprc([y[3 * k : 3 * k + 3].max() for k in pos], [round(float(p[3 * k : 3 * k + 3].mean()), 12) for k in pos])
        history.append((r, loss, now))
        if now > score + 1e-12:
            best, kept, score, idle = r, w, now, 0
        else:
            idle += 1
            if idle >= 3:
                break
            rate /= 2 if idle % 2 == 0 else 1
    assert got.best == best and len(got.history) == len(history)
    for a, b in zip(got.history, history):
        assert a == pytest.approx(b, abs=1e-9)
    assert got.weights == pytest.approx(kept, abs=1e-9)


def test_validation_without_positives(spark):
    d = table(spark, rng.normal(size=(20, 2)), label=("int", [0] * 20), pos=("long", list(range(20))))
    w = np.array([1.0, 0.0, 0.5])
    p = np.array([r.score for r in X.predicted(d, "features", w).collect()])
    assert X.validation_score(d, "features", "label", ["pos"], w) == pytest.approx((1 - p).mean())


def clusters(spark):
    r = random.Random(2)
    centres = {"unmod": (0, 0), "a": (12, 0), "b": (0, 12)}
    rows = [(k, [r.gauss(centres[z][0], 1), r.gauss(centres[z][1], 1)], z, f"s{k % 2}" if z != "b" else "s0") for k in range(240) for z in [("unmod", "a", "b")[k % 3]]]
    d = spark.createDataFrame(rows, "id long, x array<double>, kind string, source string")
    return d.withColumn("features", array_to_vector("x")).persist(), rows


def test_one_component_has_the_gaussians_likelihood_and_three_are_picked(spark):
    d, rows = clusters(spark)
    sweep = X.bic_sweep(d, 4, seeds=[1])
    x = np.array([r[1] for r in rows])
    cov = np.cov(x.T, bias=True)
    ll = -0.5 * len(x) * (2 * math.log(2 * math.pi) + math.log(np.linalg.det(cov)) + 2)
    assert sweep[0][1] == pytest.approx(ll, rel=1e-4)
    assert sweep[0][2] == pytest.approx(-2 * ll + 5 * math.log(240), rel=1e-4)
    assert min(sweep, key=lambda s: s[2])[0] == 3 and [s[0] for s in sweep] == [1, 2, 3, 4]


def test_cluster_space(spark):
    d, _ = clusters(spark)
    got = {(r.part, r.target): r for r in X.cluster_space(d, "kind", "source", seeds=[2]).collect()}
    assert X.unconfounded(d, "kind", "source") == ["a"]
    assert set(got) == {("all", "kind"), ("all", "source"), ("targeted", "a"), ("targeted", "b")}
    assert got["all", "kind"].ari == pytest.approx(1) and got["all", "kind"].best_k == 3 and abs(got["all", "source"].ari) < 0.3
    assert got["targeted", "a"].ari == pytest.approx(1) and got["targeted", "b"].n == 160
    more = d.withColumn("source", F.concat(F.lit("s"), (F.col("id") % 4).cast("string")))
    parts = {r.part for r in X.cluster_space(more, "kind", "source", seeds=[1]).collect()}
    assert parts == {"all", "unconfounded", "targeted"}


def test_mixtures_are_mllibs_and_share_their_passes(spark):
    from pyspark.ml.clustering import GaussianMixture

    d, _ = clusters(spark)
    d = d.withColumn("some", F.col("kind") != "unmod")
    asked = [(None, 2), (None, 4), ("some", 2)]
    got = X.mixtures(d, asked, "features", [1])
    for on, k in asked:
        rows = d if on is None else d.where(on)
        best = GaussianMixture(k=k, featuresCol="features", seed=1, maxIter=50).fit(rows)
        assert got[on, k].log_likelihood == pytest.approx(best.summary.logLikelihood, rel=1e-9)
        assert got[on, k].means == pytest.approx(np.array([g.mean.toArray() for g in best.gaussians]), rel=1e-6)
        same = best.transform(rows).where(F.col("prediction") != got[on, k].cluster("features"))
        assert same.count() == 0
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    at = [jobs()]
    for rounds in (0, 20):
        X.mixtures(d, asked, "features", [1], rounds=rounds, tol=-1)
        at.append(jobs())
    assert at[2] - at[1] - (at[1] - at[0]) <= 20
