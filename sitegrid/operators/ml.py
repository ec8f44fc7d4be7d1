"""Models over site features with MLlib, and measures of embeddings in SQL."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.functions.scalar import hash_key
from sitegrid.operators import ranking


def fit_site_model(df: DataFrame, features: str = "features", label: str = "label", kind: str = "lr", seed: int = 1, times: Column | None = None):
    """Binary classifier, positives weighted by n_neg / n_pos; times: how many rows each row stands for."""
    k = F.lit(1) if times is None else times
    p = df.agg(F.sum(F.col(label) * k).alias("p"), F.sum(k).alias("n")).first()
    w = (p.n - p.p) / p.p if p.p else 1.0
    d = df.withColumn("_w", F.when(F.col(label) == 1, float(w)).otherwise(1.0) * k)
    m = LogisticRegression(featuresCol=features, labelCol=label, weightCol="_w", maxIter=30, regParam=0.01) if kind == "lr" else GBTClassifier(featuresCol=features, labelCol=label, weightCol="_w", maxIter=10, maxDepth=4, seed=seed)
    return m.fit(d)


def scored(model, df: DataFrame, out: str = "score") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def group_fold(k: int, seed: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(k)).cast("int")


def cross_validated(df: DataFrame, group: list[str], folds: int, seed: int = 1) -> DataFrame:
    """Out-of-fold scores; the rows of a group stay together."""
    d = df.withColumn("fold", group_fold(folds, seed, *group))
    parts = [scored(fit_site_model(d.where(F.col("fold") != k)), d.where(F.col("fold") == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sequence_null(contexts: DataFrame, group: list[str], folds: int = 5) -> DataFrame:
    """AUROC that the sequence alone reaches: one-hot logistic regression with group folds. contexts: context, label. Equal
    rows of a fold are one row with their number."""
    from sitegrid.functions.scalar import onehot

    d = contexts.withColumn("fold", group_fold(folds, 1, *group)).groupBy("fold", "context", "label").agg(F.count("*").alias("k"))
    d = d.withColumn("features", array_to_vector(onehot(F.col("context")).cast("array<double>"))).persist()
    out = None
    for f in range(folds):
        s = scored(fit_site_model(d.where(F.col("fold") != f), times=F.col("k")), d.where(F.col("fold") == f))
        s = s.groupBy("score").agg(F.sum(F.col("k") * F.col("label")).alias("p"), F.sum(F.col("k") * (1 - F.col("label"))).alias("n"))
        out = s if out is None else out.unionByName(s)
    both = out.groupBy(F.lit(0).alias("all"), "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return ranking.auroc_of_counts(both, ["all"]).drop("all")


def leave_one_dataset_out(df: DataFrame, member: str) -> DataFrame:
    """AUROC on each member of a model fitted on all others."""
    out = None
    for r in df.select(member).distinct().orderBy(member).toLocalIterator():  # datasets, not rows
        held = F.col(member) == r[0]
        s = ranking.auroc(scored(fit_site_model(df.where(~held)), df.where(held)), "label", "score", [member])
        out = s if out is None else out.unionByName(s)
    return out


def channel_importance(model, df: DataFrame, names: list[str], array: str, by: list[str], seed: int = 1) -> DataFrame:
    """Loss of AUPRC when one channel is dealt anew among rows: a row takes the value of the row at its own place in another
    hash order."""
    number = lambda d, s: ranking.numbered(d, by, hash_key(s, "id"), "id").withColumnRenamed("_rn", "_i").drop("_n")
    a = number(df.withColumn("_v", F.col(array)), seed)
    base = ranking.average_precision(scored(model, a.withColumn("features", array_to_vector("_v"))), "label", "score", by).withColumnRenamed("auprc", "base")
    out = None
    for j, name in enumerate(names):
        other = number(df, seed + 1 + j).select(*by, "_i", F.get(array, F.lit(j)).alias("_x"))
        mixed = a.join(other, [*by, "_i"]).withColumn("features", array_to_vector(F.transform("_v", lambda v, i: F.when(i == j, F.col("_x")).otherwise(v))))  # noqa: B023
        s = ranking.average_precision(scored(model, mixed), "label", "score", by).join(base, by).select(F.lit(name).alias("channel"), *by, (F.col("base") - F.col("auprc")).alias("loss"))
        out = s if out is None else out.unionByName(s)
    return out


def probe(train: DataFrame, test: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Linear probe on standardised embeddings: accuracy by class."""
    sc = StandardScaler(inputCol=features, outputCol="_s", withMean=True).fit(train)
    m = LogisticRegression(featuresCol="_s", labelCol=label, maxIter=30, regParam=0.01).fit(sc.transform(train))
    return m.transform(sc.transform(test)).groupBy(label).agg(F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def center(df: DataFrame, array: str) -> DataFrame:
    """Element-wise mean, one row."""
    e = df.select(F.posexplode(F.col(array).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return e.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))


def distance_score(df: DataFrame, normals: DataFrame, array: str) -> DataFrame:
    """Distance to the centre of the normals."""
    c = center(normals, array)
    return df.join(F.broadcast(c)).withColumn("score", F.sqrt(squared_distance(F.col(array).cast("array<double>"), F.col("center")))).drop("center")


def project(df: DataFrame, dims: int, features: str = "features") -> DataFrame:
    return PCA(k=dims, inputCol=features, outputCol="pca").fit(df).transform(df)


def clustered(df: DataFrame, k: int, features: str = "features", seed: int = 1) -> tuple[DataFrame, float]:
    """Gaussian mixture clusters and their BIC."""
    m = GaussianMixture(k=k, featuresCol=features, seed=seed, maxIter=20).fit(df)
    n, d = df.count(), m.gaussiansDF.first().mean.size
    free = k - 1 + k * d + k * d * (d + 1) / 2
    import math

    return m.transform(df).withColumnRenamed("prediction", "cluster"), -2 * m.summary.logLikelihood + free * math.log(max(1, n))


def agreement(df: DataFrame, a: str, b: str, times: Column | None = None) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labelings, from their contingency table; times: how many rows each
    row stands for."""
    t = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg((F.count("*") if times is None else F.sum(times)).alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    ent = lambda c, n: -F.sum(F.col(c) / n * F.log(F.col(c) / n))
    ra, rb = (t.groupBy(x).agg(F.sum("n").alias("m")) for x in ("a", "b"))
    tot = F.broadcast(t.agg(F.sum("n").alias("total")))
    s = t.join(tot).agg(pairs("n").alias("s"), ent("n", F.col("total")).alias("hab"), F.max("total").alias("total"))
    sa = ra.join(tot).agg(pairs("m").alias("sa"), ent("m", F.col("total")).alias("ha"))
    sb = rb.join(tot).agg(pairs("m").alias("sb"), ent("m", F.col("total")).alias("hb"))
    one = s.join(F.broadcast(sa)).join(F.broadcast(sb))
    exp = F.col("sa") * F.col("sb") / (F.col("total") * (F.col("total") - 1) / 2)
    return one.select(((F.col("s") - exp) / ((F.col("sa") + F.col("sb")) / 2 - exp)).alias("ari"), ((F.col("ha") + F.col("hb") - F.col("hab")) / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"), F.col("total").alias("n"))


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """F statistic of each feature between classes, from sums alone."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f")).select(label, "f.*")
    g = long.groupBy("feature", label).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    a = g.groupBy("feature").agg(F.sum("n").alias("total"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    j = g.join(a, "feature").groupBy("feature").agg((F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2) / (F.max("k") - 1) / (F.sum(F.col("n") * F.col("v")) / (F.max("total") - F.max("k")))).alias("f"))
    return j


def mutual_information(df: DataFrame, feature: str, label: str, bins: int = 10) -> DataFrame:
    """Of a feature's quantile bins with the label, in nats."""
    cuts = df.agg(F.percentile(F.col(feature).cast("double"), [i / bins for i in range(1, bins)]).alias("c"))
    b = df.join(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("c", lambda x: x <= F.col(feature))))
    return agreement_mi(b, "_b", label)


def agreement_mi(df: DataFrame, a: str, b: str) -> DataFrame:
    t = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    tot = F.broadcast(t.agg(F.sum("n").alias("total")))
    j = t.join(t.groupBy("a").agg(F.sum("n").alias("na")), "a").join(t.groupBy("b").agg(F.sum("n").alias("nb")), "b").join(tot)
    return j.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))


def forest_importance(df: DataFrame, features: list[str], label: str, seed: int = 1, rows: int = 250_000) -> DataFrame:
    """A forest keeps its rows in memory as they are dealt, with a count for each tree, and each task of each round reads a part
    whole: they are dealt first into parts of about `rows` rows, which don't grow with the input."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    d = df.select(label, *features).repartition(parts).withColumn("_f", array_to_vector(F.array(*[F.col(f).cast("double") for f in features])))
    m = RandomForestClassifier(featuresCol="_f", labelCol=label, numTrees=20, seed=seed).fit(d)
    return df.sparkSession.createDataFrame([(f, float(x)) for f, x in zip(features, m.featureImportances.toArray())], "feature string, importance double")


def retype(embeddings: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Real type by motif hit; a site with several types is a collision and keeps none."""
    h = hits.groupBy(*keys).agg(F.min("type").alias("_t"), F.count_distinct("type").alias("_n"))
    return embeddings.join(h, keys, "left").withColumn("type", F.when(F.col("_n") == 1, F.col("_t"))).withColumn("collision", F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_t", "_n")
