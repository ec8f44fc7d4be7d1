"""Models that are chosen by what they do on held-out rows: training with validation, exact nearest neighbours, mixtures over k."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from sitegrid.operators import ml, ranking, splits

#: As MLlib has it.
EPSILON = 2.0**-52


class Trained(NamedTuple):
    """weights: bias last. history: (round, training loss before its step, validation score after it)."""

    weights: np.ndarray
    best: int
    history: list[tuple[int, float, float]]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def predicted(df: DataFrame, features: str, weights: np.ndarray, out: str = "score") -> DataFrame:
    """The probability of a linear model, as an expression."""
    w = F.array(*map(F.lit, weights[:-1].tolist()))
    z = F.aggregate(F.zip_with(F.col(features), w, lambda x, y: x * y), F.lit(float(weights[-1])), lambda a, x: a + x)
    return df.withColumn(out, 1 / (1 + F.exp(-z)))


def gradient(df: DataFrame, features: str, label: str, weights: np.ndarray, positive: float) -> tuple[np.ndarray, float]:
    """Mean gradient and mean loss of weighted cross-entropy: a vector for each task, summed."""
    d = len(weights)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, loss, n = np.zeros(d), 0.0, 0
        for b in it:
            if len(b):
                x, y = np.column_stack([_matrix(b.column(0)), np.ones(len(b))]), np.asarray(b.column(1)).astype(np.float64)
                z = x @ weights
                by = np.where(y == 1, positive, 1.0)
                g += x.T @ (by * (1 / (1 + np.exp(-z)) - y))
                loss += float((by * (np.logaddexp(0, z) - y * z)).sum())
                n += len(b)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 2)), pa.array([*g, loss, float(n)])], names=["i", "v"])

    s = dict(df.select(features, F.col(label).cast("double")).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect())  # d + 2 numbers
    n = max(1.0, s.get(d + 1, 0.0))
    return np.array([s.get(i, 0.0) for i in range(d)]) / n, s.get(d, 0.0) / n


def validation_score(df: DataFrame, features: str, label: str, position: list[str], weights: np.ndarray) -> float:
    """AUPRC of positions: their mean probability, their largest label. Without positives the mean of 1 - p."""
    p = predicted(df, features, weights).groupBy(*position).agg(F.avg("score").alias("score"), F.max(label).alias("label"))
    r = ranking.average_precision(p, "label", "score", []).first()
    if r is not None and r.auprc is not None:
        return float(r.auprc)
    return float(p.agg(F.avg(1 - F.col("score"))).first()[0] or 0.0)


def train_validated(df: DataFrame, position: list[str], features: str = "features", label: str = "label", frac: float = 0.15, seed: int = 1, rounds: int = 40, patience: int = 5, rate: float = 1.0, decay: float = 1e-4) -> Trained:
    """A linear site model whose rounds are scored on held-out positions; the best round is kept.

    Validation positions are carved by hash, so that all rows of a position are on one side. Positives weigh n_neg / n_pos. Each round is one
    pass over the training rows for the gradient and one over the validation rows; the rate halves when two rounds bring nothing;
    after `patience` rounds without a better score training ends. Features should be on one scale. df is read twice a round:
    give a written table.
    """
    d = splits.carve_val(df, frac, seed, position)
    train, val = d.where("part = 'train'"), d.where("part = 'val'")
    c = train.agg(F.sum(label).alias("p"), F.count("*").alias("n"), F.max(F.size(features)).alias("d")).first()
    w = np.zeros((c.d or 0) + 1)
    positive = (c.n - (c.p or 0)) / max(1, c.p or 0)
    best, kept, score, history, idle = 0, w, -1.0, [], 0
    for r in range(1, rounds + 1):
        g, loss = gradient(train, features, label, w, positive)
        w = w - rate * (g + decay * np.append(w[:-1], 0.0))
        now = validation_score(val, features, label, position, w)
        history.append((r, loss, now))
        if now > score:
            best, kept, score, idle = r, w, now, 0
            continue
        idle += 1
        if idle >= patience:
            break
        if idle % 2 == 0:
            rate /= 2
    return Trained(kept, best, history)


def standardised(df: DataFrame, by: DataFrame, features: str) -> DataFrame:
    """Features less their mean, over their population sd, of the rows of `by`; a flat feature is only centred."""
    e = by.select(F.posexplode(F.col(features).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    one = e.agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("_by"))  # a row of as many numbers as features
    scaled = F.zip_with(F.col(features).cast("array<double>"), "_by", lambda x, s: (x - s["m"]) / s["s"])
    return df.join(F.broadcast(one)).withColumn(features, scaled).drop("_by")


def _blocks(df: DataFrame, key: str, features: str, more: list[str], size: int) -> DataFrame:
    """Rows in blocks of at most `size`: block, keys, the further columns, and a matrix as packed float64."""
    kinds = {c: df.schema[c].dataType for c in (key, *more)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for b in it:
            for lo in range(0, len(b), size):
                part = b.slice(lo, size)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part.column(c)])) for c in (key, *more)]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, pa.array([_matrix(part.column(features)).tobytes()], pa.binary())], names=["block", key, *more, "matrix"])

    schema = StructType([StructField("block", StringType()), *(StructField(c, ArrayType(k)) for c, k in kinds.items()), StructField("matrix", BinaryType())])
    return df.select(key, *more, features).mapInArrow(run, schema)


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str, features: str, carry: list[str], size: int = 4_096) -> DataFrame:
    """Exact k nearest rows of each query by Euclidean distance: query, nearest (distance, key and the columns of carry, nearest first; ties
    to the smaller key).

    Queries and rows are cut into blocks; every block of rows meets every block of queries, as one matrix product that
    leaves k rows for each query. Partial lists are merged in two steps, so that no list grows with the table. Keys must be
    unique in rows, and comparable.
    """
    r = _blocks(rows.where(F.col(features).isNotNull()), key, features, carry, size)
    q = _blocks(queries.where(F.col(features).isNotNull()).select(F.col(key).alias("query"), features), "query", features, [], size)
    lanes = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    r = r.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")).withColumnRenamed("matrix", "_rows")
    q = q.select("query", F.col("matrix").alias("_queries"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    pair = StructType([StructField("distance", DoubleType()), *(StructField(c, rows.schema[c].dataType) for c in (key, *carry))])
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(len(b)):
                one = b.slice(i, 1)
                ids, mine = one.column("query").flatten(), [one.column(c).flatten() for c in (key, *carry)]
                x, y = (np.frombuffer(one.column(c)[0].as_py(), np.float64).reshape(n, -1) for c, n in (("_queries", len(ids)), ("_rows", len(mine[0]))))
                at, dist = _closest(x, y, k, np.argsort(np.argsort(mine[0].to_numpy(zero_copy_only=False), kind="stable"), kind="stable"))
                take = pa.array(at.ravel())
                struct = pa.StructArray.from_arrays([pa.array(dist.ravel()), *(c.take(take) for c in mine)], names=["distance", key, *carry])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * at.shape[1], pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([pa.array([one.column("lane")[0].as_py()] * len(ids), pa.int32()), ids, lists], names=["lane", "query", "nearest"])

    schema = StructType([StructField("lane", IntegerType()), StructField("query", queries.schema[key].dataType), StructField("nearest", ArrayType(pair))])
    met = q.join(r, "lane").select("lane", "query", "_queries", key, *carry, "_rows").mapInArrow(run, schema)
    best = F.slice(F.sort_array(F.flatten(F.collect_list("nearest"))), 1, k).alias("nearest")
    return met.groupBy("query", "lane").agg(best).groupBy("query").agg(best)


def _closest(x: np.ndarray, y: np.ndarray, k: int, rank: np.ndarray, spare: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the k nearest rows of y and their distances. A product picks k and some to spare, differences decide."""
    k = min(k, len(y))
    rough = (y * y).sum(1) - 2 * x @ y.T
    n = min(len(y), k + spare)
    some = np.argpartition(rough, n - 1, axis=1)[:, :n] if n < len(y) else np.tile(np.arange(len(y)), (len(x), 1))
    at, dist = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    for lo in range(0, len(x), 256):
        c = some[lo : lo + 256]
        d = np.sqrt(((x[lo : lo + 256, None] - y[c]) ** 2).sum(2))
        o = np.lexsort((rank[c], d))[:, :k]
        at[lo : lo + 256], dist[lo : lo + 256] = np.take_along_axis(c, o, 1), np.take_along_axis(d, o, 1)
    return at, dist


def knn_probe(train: DataFrame, test: DataFrame, key: str, features: str = "features", label: str = "label", k: int = 25) -> DataFrame:
    """key, label, score of each test row: the share of positives among its k nearest training rows, on standardised features."""
    a = standardised(train.select(key, features, label), train, features)
    b = standardised(test.select(key, features), train, features)
    n = nearest(b, a, k, key, features, [label])
    vote = F.aggregate("nearest", F.lit(0.0), lambda s, x: s + x[label]) / F.size("nearest")
    return test.select(key, label).join(n.select(F.col("query").alias(key), vote.alias("score")), key)


def one_gaussian(df: DataFrame, features: str) -> float:
    """Log likelihood of rows under their own mean and covariance, from sums of products: d * d numbers for each task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in it:
            if len(b):
                x = np.column_stack([_matrix(b.column(0)), np.ones(len(b))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size)), pa.array(total.ravel())], names=["i", "v"])

    rows = df.select(vector_to_array(features).alias("x")).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    s = np.array([r.v for r in rows]).reshape(math.isqrt(len(rows)), -1)
    n, d = s[-1, -1], len(s) - 1
    mean = s[-1, :-1] / n
    return float(-0.5 * n * (d * math.log(2 * math.pi) + np.linalg.slogdet(s[:-1, :-1] / n - np.outer(mean, mean))[1] + d))


class Mixture(NamedTuple):
    """Weights, means and covariances of k Gaussians, and the log likelihood before their last step."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = -np.finfo(np.float64).max

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Weighted density of each row under each Gaussian, by the pseudo-inverse where one is flat; not scaled to 1."""
        out = np.empty((len(x), len(self.weights)))
        for i, (w, mean, cov) in enumerate(zip(self.weights, self.means, self.covariances)):
            v, u = np.linalg.eigh(cov)
            some = v > EPSILON * v.max() * len(v)
            z = (x - mean) @ (u[:, some] / np.sqrt(v[some]))
            out[:, i] = EPSILON + w * np.exp(-0.5 * (len(v) * math.log(2 * math.pi) + np.log(v[some]).sum() + (z * z).sum(1)))
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood of rows, and each Gaussian's sums of shares, of rows and of products: what a step needs, in one vector."""
        p = self.shares(x)
        total = p.sum(1)
        p /= total[:, None]
        return np.concatenate([[np.log(total).sum()], p.sum(0), (p.T @ x).ravel(), *(((p[:, i, None] * x).T @ x).ravel() for i in range(p.shape[1]))])

    def stepped(self, sums: np.ndarray) -> Mixture:
        k, d = self.means.shape
        w, m, c = np.split(sums[1:], [k, k + k * d])
        means = m.reshape(k, d) / w[:, None]
        return Mixture(w / w.sum(), means, c.reshape(k, d, d) / w[:, None, None] - means[:, :, None] * means[:, None, :], float(sums[0]))

    def cluster(self, features: str) -> Column:
        @F.pandas_udf("int")
        def of(x: pd.Series) -> pd.Series:
            return pd.Series(self.shares(np.stack(x)).argmax(1) if len(x) else [])

        return of(vector_to_array(features))


def mixtures(df: DataFrame, asked: list[tuple[str | None, int]], features: str, seeds: list[int], rounds: int = 50, tol: float = 0.01) -> dict[tuple[str | None, int], Mixture]:
    """For each (condition, k) the mixture of k Gaussians of highest likelihood over restarts, of the rows of a boolean column (None: all).

    All mixtures step side by side, each round one pass over all rows that leaves a vector of sums for each task and mixture; a
    mixture ends when its likelihood changes by `tol` or less. MLlib draws where they start, and steps and ends are its own, so that its
    results come out.
    """
    fits: dict[tuple, tuple[Mixture, float]] = {}
    for on, k in dict.fromkeys(asked):
        for seed in seeds:
            m = GaussianMixture(k=k, featuresCol=features, seed=seed, maxIter=0).fit(df if on is None else df.where(on))
            g = m.gaussians
            fits[on, k, seed] = Mixture(np.array(m.weights), np.array([x.mean.toArray() for x in g]), np.array([x.cov.toArray() for x in g])), 0.0
    flags = sorted({on for on, _ in asked if on is not None})
    rows = df.select(vector_to_array(features).alias("x"), *flags).persist()
    for _ in range(rounds):
        going = {key: m for key, (m, before) in fits.items() if abs(m.log_likelihood - before) > tol}
        if not going:
            break

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {key: 0.0 for key in going}  # noqa: B023
            for b in it:
                if len(b):
                    x = _matrix(b.column(0))
                    part = {None: x} | {c: x[np.asarray(b.column(c).fill_null(False)).astype(bool)] for c in flags}
                    for key, m in going.items():  # noqa: B023
                        total[key] = total[key] + m.sums(part[key[0]])
            if all(isinstance(v, np.ndarray) for v in total.values()):
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(list(total.values())).tobytes()], pa.binary())], names=["v"])

        got = sum(np.frombuffer(r.v) for r in rows.mapInArrow(run, "v binary").collect())  # some hundred numbers a mixture and task
        ends = np.cumsum([1 + len(m.weights) * (1 + m.means.shape[1] * (1 + m.means.shape[1])) for m in going.values()])
        for (key, m), v in zip(going.items(), np.split(got, ends[:-1])):
            fits[key] = m.stepped(v), m.log_likelihood
    rows.unpersist()
    return {(on, k): max((fits[on, k, s][0] for s in seeds), key=lambda m: m.log_likelihood) for on, k in asked}


def bic(log_likelihood: float, n: int, k: int, d: int) -> float:
    """-2 log L and log n for each free parameter of k full Gaussians in d dimensions."""
    return -2 * log_likelihood + (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(max(1, n))


def bic_sweep(df: DataFrame, most: int, features: str = "features", seeds: list[int] | None = None) -> list[tuple[int, float, float]]:
    """(k, log likelihood, BIC) for k from 1 to `most`. df is read over and over: give a written or cached projection."""
    return _sweep(df, most, features, mixtures(df, [(None, k) for k in range(2, most + 1)], features, seeds or [1, 2, 3]))


def _sweep(df: DataFrame, most: int, features: str, found: dict[tuple[str | None, int], Mixture]) -> list[tuple[int, float, float]]:
    n, d = df.count(), df.select(features).first()[0].size
    return [(k, ll, bic(ll, n, k, d)) for k in range(1, most + 1) for ll in [one_gaussian(df, features) if k == 1 else found[None, k].log_likelihood]]


def unconfounded(df: DataFrame, kind: str, source: str, none: str = "unmod") -> list:
    """The kinds, but for `none`, that more than one source has."""
    g = df.where(F.col(kind) != none).groupBy(kind).agg(F.count_distinct(source).alias("n")).where("n > 1")
    return sorted(r[0] for r in g.select(kind).collect())  # kinds, not rows


def cluster_space(df: DataFrame, kind: str, source: str, features: str = "features", none: str = "unmod", seeds: list[int] | None = None) -> DataFrame:
    """A report of a mixture clustering: how many components BIC picks, and how the clusters agree with kinds and with sources.

    Rows (part, k, target, ari, nmi, n, best_k). Part `all` has as many components as kinds; part `unconfounded` is of the kinds that
    more than one source has, where there are two of them or more; part `targeted` has two components over all rows but those of
    `none`, held against each kind in turn. best_k is the component count of least BIC over 1 to min(9, kinds + 3), on all rows.
    """
    seeds = seeds or [1, 2, 3]
    kinds = sorted(r[0] for r in df.select(kind).distinct().collect())  # kinds, not rows
    most = min(9, len(kinds) + 3)
    multi = unconfounded(df, kind, source, none)
    d = df.withColumns({"_unconfounded": F.col(kind).isin(multi) if multi else F.lit(False), "_targeted": F.col(kind) != none})
    both = {kind: F.col(kind), source: F.col(source)}
    parts = [("all", None, len(kinds), both)]
    if len(multi) >= 2:
        parts.append(("unconfounded", "_unconfounded", len(multi), both))
    parts.append(("targeted", "_targeted", 2, {str(x): F.col(kind) == x for x in kinds if x != none}))
    found = mixtures(d, [*((None, k) for k in range(2, most + 1)), *((on, k) for _, on, k, _ in parts)], features, seeds)
    best_k = min(_sweep(d, most, features, found), key=lambda r: r[2])[0]
    out = None
    for name, on, k, targets in parts:
        c = (d if on is None else d.where(on)).select(found[on, k].cluster(features).alias("_cluster"), kind, source)
        c = c.groupBy("_cluster", kind, source).agg(F.count("*").alias("_times")).persist()  # rows are read once, not for each target
        for target, value in targets.items():
            r = ml.agreement(c.withColumn("_target", value), "_cluster", "_target", F.col("_times")).select(F.lit(name).alias("part"), F.lit(k).alias("k"), F.lit(target).alias("target"), "ari", "nmi", "n", F.lit(best_k).alias("best_k"))
            out = r if out is None else out.unionByName(r)
    return out


def capped(df: DataFrame, by: list[str], cap: int, key: Column) -> DataFrame:
    """At most cap rows of each group, in the order of a hash key."""
    return ranking.numbered(df, by, key).where(F.col("_rn") <= cap).drop("_rn", "_n")
