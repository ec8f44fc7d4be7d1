"""Queries: models chosen on held-out rows, over all embeddings. Two kinds of embeddings, every third one a source."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sitegrid.operators import ml as M
from sitegrid.operators import models as X
from sitegrid.operators import ranking
from sitegrid.plans.core import q, r6, t


def vectors(s, d):
    return t(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") < 3).cast("int").alias("label"), F.col("label").alias("cluster"))


KNN = """
e AS (SELECT vec_id, CAST(label < 3 AS INT) AS label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
m AS (SELECT list(avg ORDER BY i) AS m, list(sd ORDER BY i) AS sd FROM (SELECT i, avg(a[i]) AS avg, CASE WHEN stddev_pop(a[i]) > 0 THEN stddev_pop(a[i]) ELSE 1 END AS sd FROM (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM e WHERE vec_id % 4 <> 0) GROUP BY i)),
z AS (SELECT vec_id, label, list_transform(range(1, len(a) + 1), lambda i: (a[i] - m[i]) / sd[i]) AS x FROM e, m),
n AS (SELECT q.vec_id, q.label, r.label AS vote, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, r.x), r.vec_id) AS k FROM z q JOIN z r ON q.vec_id % 4 = 0 AND r.vec_id % 4 <> 0),
v AS (SELECT vec_id, any_value(label) AS label, round(sum(vote) / count(*), 6) AS score FROM n WHERE k <= 25 GROUP BY vec_id)
"""


@q("knn_probe", f"WITH {KNN} SELECT * FROM v")
def knn_probe(s, d):
    e = vectors(s, d)
    return X.knn_probe(e.where("vec_id % 4 <> 0"), e.where("vec_id % 4 = 0"), "vec_id").select("vec_id", "label", *r6("score"))


@q("knn_auroc", f"WITH {KNN}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM v) SELECT CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS auroc FROM r")
def knn_auroc(s, d):
    return ranking.auroc(knn_probe(s, d), "label", "score", []).select("n_pos", "n_neg", *r6("auroc"))


@q("train_rounds", None)
def train_rounds(s, d):
    """Rounds of a site model; a position is five embeddings."""
    e = vectors(s, d).withColumn("pos", F.floor(F.col("vec_id") / 5))
    got = X.train_validated(X.standardised(e, e, "features"), ["pos"], rounds=12, frac=0.25)
    rows = [(r, round(loss, 6), round(score, 6), r == got.best) for r, loss, score in got.history]
    return s.createDataFrame(rows, "round int, loss double, auprc double, best boolean")


def kinds(s, d):
    e = vectors(s, d).withColumns({"features": array_to_vector("features"), "kind": F.when(F.col("cluster") < 2, "unmod").otherwise(F.concat(F.lit("k"), (F.col("cluster") % 4).cast("string"))), "source": F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string"))})
    p = M.project(e, 4).select("vec_id", "kind", "source", F.col("pca").alias("features"))
    return p.persist()


@q("bic_sweep", None)
def bic_sweep(s, d):
    return s.createDataFrame([(k, round(ll, 2), round(b, 2)) for k, ll, b in X.bic_sweep(kinds(s, d), 4, seeds=[1])], "k int, log_likelihood double, bic double")


@q("cluster_space", None)
def cluster_space(s, d):
    return X.cluster_space(kinds(s, d), "kind", "source", seeds=[1]).select("part", "k", "target", *r6("ari", "nmi"), "n", "best_k")
