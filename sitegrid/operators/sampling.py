"""Samples in hash order of a stable key: the same rows under any partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.functions.scalar import hash_key, unit_hash
from sitegrid.operators import ranking


def sample_uniform(df: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """The n rows of smallest hash. Their hash is at most a bound that some more than n rows are expected to meet, so that
    no more than these are sorted; where it isn't met by n rows (few rows, or many with equal keys), all are."""
    d = df.withColumn("_k", hash_key(seed, *keys))
    bound, below = _bound(d, n)
    some = d if bound is None or below < n else d.where(F.col("_k") <= bound)
    return some.orderBy("_k", *keys).limit(n).drop("_k")


def _bound(d: DataFrame, n: int) -> tuple[str | None, int]:
    """From counts by the hash's first letters: the first prefix by which n rows have come, and how many have."""
    counts = d.groupBy(F.substring("_k", 1, 4).alias("b")).agg(F.count("*").alias("k")).orderBy("b").collect()  # 65,536 at most
    below = 0
    for r in counts:
        below += r.k
        if below >= n:
            return f"{r.b}~", below
    return None, below


def sample_weighted(df: DataFrame, n: int, keys: list[str], weight: Column, seed: int) -> DataFrame:
    """Without replacement: smallest exponential keys -ln(u) / weight."""
    return df.withColumn("_k", F.round(-F.log(unit_hash(seed, *keys)) / weight, 9)).orderBy("_k", *keys).limit(n).drop("_k")


def cap_per_group(df: DataFrame, group: list[str], n: int, keys: list[str], seed: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(hash_key(seed, *keys), *keys)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def cap_negatives(sites: DataFrame, n: int, group: list[str], keys: list[str], seed: int) -> DataFrame:
    """All positives and at most n negatives of each group."""
    return sites.where("label = 1").unionByName(cap_per_group(sites.where("label = 0"), group, n, keys, seed))


def balance(pos: DataFrame, neg: DataFrame, ratio: float, max_total: int, keys: list[str], seed: int) -> DataFrame:
    """At most ratio negatives for a positive, both scaled down together to max_total."""
    p, q = pos.count(), neg.count()
    q = min(q, int(p * ratio))
    if p + q > max_total:
        p, q = int(max_total * p / (p + q)), int(max_total * q / (p + q))
    return sample_uniform(pos, p, keys, seed).withColumn("label", F.lit(1)).unionByName(sample_uniform(neg, q, keys, seed).withColumn("label", F.lit(0)))


def cap_bases(positives: DataFrame, base: str, ratio: float, keys: list[str], seed: int) -> DataFrame:
    """The most frequent base is cut to ratio times the second."""
    top = positives.groupBy(base).count().orderBy(F.desc("count"), base).limit(2).collect()
    if len(top) < 2:
        return positives
    kept = positives.where(F.col(base) == top[0][0])
    return positives.where(~F.col(base).eqNullSafe(top[0][0])).unionByName(sample_uniform(kept, int(ratio * top[1]["count"]), keys, seed))


def oversample(df: DataFrame, condition: Column, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(condition, times).otherwise(1))))


def balanced_draws(df: DataFrame, buckets: list[str], keys: list[str], n: int, seed: int) -> DataFrame:
    """n draws from each bucket, with replacement where it is smaller, in rounds over the buckets."""
    w = Window.partitionBy(*buckets)
    d = df.withColumn("_n", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(hash_key(seed, *keys), *keys)) - 1)
    # row r of a bucket of m takes rounds r, r+m, r+2m, ... below n
    turns = F.when(F.col("_rn") < n, F.sequence(F.col("_rn"), F.lit(n - 1), F.col("_n").cast("int"))).otherwise(F.array().cast("array<int>"))
    return d.withColumn("round", F.explode(turns)).drop("_n", "_rn")


def bootstrap_auroc(df: DataFrame, label: str, score: str, stratum: list[str], n: int, seed: int) -> DataFrame:
    """Percentiles 2.5, 50 and 97.5 of the pooled AUROC over n resamples by stratum, as many rows each, drawn with replacement."""
    counts = drawn_counts(df, label, score, stratum, n, seed).where("label IS NOT NULL AND score IS NOT NULL")
    y, k = F.col("label"), F.col("k")
    a = ranking.auroc_of_counts(counts.groupBy("replicate", "score").agg(F.sum(y * k).alias("p"), F.sum((1 - y) * k).alias("n")), ["replicate"])
    return a.agg(*[F.percentile("auroc", q).alias(x) for q, x in ((0.025, "lo"), (0.5, "mid"), (0.975, "hi"))])


def drawn_counts(df: DataFrame, label: str, score: str, stratum: list[str], n: int, seed: int, block: int = 1024) -> DataFrame:
    """stratum, replicate, label, score, k: how often rows of a label and score are among a resample's draws; those never drawn are
    left out. No row is copied: equal rows are counted, a stratum's draws fall to blocks of its counts, a block's draws to its counts,
    both as multinomial numbers seeded by stratum and block."""
    c = df.groupBy(*stratum, F.col(label).cast("long").alias("label"), F.col(score).cast("double").alias("score")).agg(F.count("*").alias("c")).persist(StorageLevel.DISK_ONLY)
    d = ranking.numbered(c, stratum, hash_key(seed, *stratum, "label", "score"), "label", "score").withColumn("_i", F.floor((F.col("_rn") - 1) / block))
    cells = F.array_sort(F.collect_list(F.struct("_rn", "label", "score", "c")))
    blocks = d.groupBy(*stratum, "_i").agg(cells.alias("_cells"), F.sum("c").alias("_m"))
    names = [f"_{i}" for i in range(len(stratum))]
    of = F.xxhash64(F.lit(seed), *stratum)
    sizes = blocks.select(*[F.col(x).alias(y) for x, y in zip(stratum, names)], F.col("_i").alias("_j"), F.col("_m").alias("_w"), of.alias("_seed"))

    def fall(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_j", ignore_index=True)
        w = p["_w"].to_numpy()
        draws = np.random.default_rng(int(p["_seed"][0]) % 2**64).multinomial(w.sum(), w / w.sum(), n)
        return p.drop(columns=["_w", "_seed"]).assign(_draws=list(draws.T))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.drop("_w", "_seed").schema)
    sizes = sizes.groupBy(*names).applyInPandas(fall, f"{kinds}, _draws array<bigint>")
    on = [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(stratum, names)] + [F.col("_i") == F.col("_j")]
    j = blocks.join(sizes, on).select(*stratum, "_cells", "_draws", F.xxhash64(F.lit(seed), "_i", *stratum).alias("_seed"))

    def draw(seed_: pd.Series, cells_: pd.Series, draws_: pd.Series) -> pd.Series:
        out = []
        for x, row, m in zip(seed_, cells_, draws_):
            w = np.asarray(row, dtype=np.int64)
            out.append(np.random.default_rng(int(x) % 2**64).multinomial(np.asarray(m), w / w.sum()).T.ravel())
        return pd.Series(out)

    k = F.pandas_udf(draw, "array<bigint>")("_seed", F.col("_cells.c"), "_draws")
    e = j.select(*stratum, "_cells", F.posexplode(k).alias("_at", "k")).where("k > 0")
    cell = F.get("_cells", F.floor(F.col("_at") / n).cast("int"))
    return e.select(*stratum, (F.col("_at") % n + 1).alias("replicate"), cell["label"].alias("label"), cell["score"].alias("score"), "k")


def fewshot(df: DataFrame, k: int, group: list[str], keys: list[str], seed: int, replay: int = 0) -> DataFrame:
    """Hashed halves; of the support half k positives and k negatives, nested in k, repeated to about a quarter of a replay
    sample of `replay` rows; the query half whole. Column role: support or query."""
    half = F.substring(hash_key(seed, *keys), 1, 1).isin(*"01234567")
    shots = cap_per_group(df.where(half), [*group, "label"], k, keys, seed + 1)
    times = max(1, -(-replay // (4 * 2 * k))) if replay else 1
    return oversample(shots, F.lit(True), times).withColumn("role", F.lit("support")).unionByName(df.where(~half).withColumns({"copy": F.lit(1), "role": F.lit("query")}))
