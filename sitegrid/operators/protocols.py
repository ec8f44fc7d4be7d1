"""Protocols of evaluation: whole contigs apart, few shots with replay, comparison of folds, chemistry from three call sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.functions.scalar import hash_key
from sitegrid.operators import ranking, sampling, splits


def below(frac: float, tag: int | str, *cols: str) -> Column:
    """Whether the first 32 bits of a hash key are under a share of their range."""
    return F.substring(hash_key(tag, *cols), 1, 8) < F.lit(format(min(math.ceil(frac * 2**32), 2**32 - 1), "08x"))


def split_contigs(df: DataFrame, group: list[str], val: float, test: float, seed: int) -> DataFrame:
    """Column split by whole groups (contigs), stratified by a group's label, the largest of its rows; of three groups of a label or
    more each part has one at least."""
    return splits.split_positions(df, group, val, test, seed)


def split_counts(df: DataFrame, group: list[str], position: list[str]) -> DataFrame:
    """By split: groups, positions, rows."""
    p = df.groupBy("split", *group, *[c for c in position if c not in group]).agg(F.count("*").alias("_n"))
    g = p.groupBy("split", *group).agg(F.count("*").alias("_p"), F.sum("_n").alias("_n"))
    return g.groupBy("split").agg(F.count("*").alias("n_groups"), F.sum("_p").alias("n_positions"), F.sum("_n").alias("n_rows"))


def _lowest(df: DataFrame, site: list[str], k: int, tag: str) -> DataFrame:
    """All rows of the k sites of each label whose hash is lowest; a site's label is the largest of its rows."""
    s = df.groupBy(*site).agg(F.max("label").alias("_y"))
    s = ranking.numbered(s, ["_y"], hash_key(tag, *site), *site).where(F.col("_rn") <= k)
    return df.join(s.select(*site), site, "left_semi")


def few_shot(held: DataFrame, train: DataFrame, k: int, coordinate: list[str], source: list[str], replay: int = 30_000, seed: int = 0, row: list[str] | None = None) -> DataFrame:
    """Rows with role and copy: what a model adapts on with k labelled sites of a fold's held-out data, and what it is scored on.

    Held-out coordinates part once, by hash, into a support and a query half; neither k nor the seed changes that, and all sources of a
    coordinate go together. Shots are all rows of k positive and k negative sites (coordinate and source) of the support half, in a seeded
    order, so that those of a smaller k are among those of a larger one. Of the fold's own training rows a tenth of the coordinates is
    for validation: role replay is a sample of the rest, replay_val one of a sixth of its size. Shots are repeated (copy 1, 2, ...) to
    about a quarter of the replay, 50 times at most. k = 0: the query half alone. row: what tells rows apart, for sampling.
    """
    site = [*coordinate, *source]
    row = row or site
    half = below(0.5, "fs_support", *coordinate)
    one = F.lit(1).alias("copy")
    query = held.where(~half).select("*", one, F.lit("query").alias("role"))
    if not k:
        return query
    shots = _lowest(held.where(half), site, k, f"fsrank:{seed}")
    val = below(0.1, "fs_replayval", *coordinate)
    again = sampling.sample_uniform(train.where(~val), replay, row, 1000 + seed)
    check = sampling.sample_uniform(train.where(val), replay // 6, row, 1000 + seed)
    n = again.agg(F.count("*").alias("_r"))
    times = shots.agg(F.count("*").alias("_s")).join(F.broadcast(n)).select(F.least(F.lit(50), F.greatest(F.lit(1), F.bround(0.25 * F.col("_r") / F.greatest("_s", F.lit(1))).cast("int"))).alias("_times"))
    many = shots.join(F.broadcast(times)).withColumn("copy", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times").withColumn("role", F.lit("shot"))
    return many.unionByName(again.select("*", one, F.lit("replay").alias("role"))).unionByName(check.select("*", one, F.lit("replay_val").alias("role"))).unionByName(query)


def few_shot_pool(held: DataFrame, train: DataFrame, k: int, coordinate: list[str], source: list[str], seed: int = 0) -> DataFrame:
    """Rows with role train or query: the fold's training rows with the shots among them, each row once, and the query half."""
    half = below(0.5, "fs_support", *coordinate)
    query = held.where(~half)
    pool = train.unionByName(_lowest(held.where(half), [*coordinate, *source], k, f"fsrank:{seed}")).distinct()
    return pool.withColumn("role", F.lit("train")).unionByName(query.withColumn("role", F.lit("query")))


def _report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of both labels from tp, fp, fn, tn."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one, zero = div(2 * tp, 2 * tp + fp + fn), div(2 * tn, 2 * tn + fp + fn)
    return counts.select(
        "model", "held_out", div(tp, tp + fp).alias("precision_label1"), div(tp, tp + fn).alias("recall_label1"), one.alias("f1_label1"), (tp + fn).alias("support_label1"),
        div(tn, tn + fn).alias("precision_label0"), div(tn, tn + fp).alias("recall_label0"), zero.alias("f1_label0"), (tn + fp).alias("support_label0"),
        ((one + zero) / 2).alias("macro_f1"), "threshold", (tp + fp + fn + tn).alias("n_test"), "notes",
    )


def lodo_table(base: DataFrame, folds: DataFrame, train: DataFrame, base_threshold: float = 0.5) -> DataFrame:
    """One table of the base model on its test rows (label, score), of each left-out fold (fold, label, score) at the fold's own threshold of
    best F1, and of ZeroR, which always says the majority label of the training rows (label; 0 on ties) on the base's test rows."""
    c = lambda pred: [v.alias(k) for k, v in ranking.counts_at(F.col("label"), pred).items()]
    no = F.lit(None)
    b = base.agg(*c((F.col("score") >= base_threshold).cast("int"))).select(F.lit("Base").alias("model"), F.lit("all (stratified split)").alias("held_out"), "*", F.lit(float(base_threshold)).alias("threshold"), F.lit("").alias("notes"))
    t = ranking.best_threshold(folds, "label", "score", ["fold"]).select("fold", "threshold")
    f = folds.join(t, "fold").withColumn("_p", (F.col("score") >= F.col("threshold")).cast("int")).groupBy("fold", "threshold").agg(*c(F.col("_p")))
    f = f.select(F.lit("LODO").alias("model"), F.col("fold").cast("string").alias("held_out"), "tp", "fp", "fn", "tn", "threshold", F.lit("").alias("notes"))
    most = train.agg((2 * F.sum("label") > F.count("label")).cast("int").alias("_m"))
    z = base.join(F.broadcast(most)).groupBy("_m").agg(*c(F.col("_m"))).select(F.lit("ZeroR").alias("model"), F.lit("base test set").alias("held_out"), "tp", "fp", "fn", "tn", no.cast("double").alias("threshold"), F.concat(F.lit("majority="), F.col("_m")).alias("notes"))
    return _report(b.unionByName(f).unionByName(z))


def chem_map(calls_4mc: DataFrame, calls_5mc: DataFrame, calls_6ma: DataFrame, marks: DataFrame, min_cov: int = 10, min_pct: float = 80.0) -> DataFrame:
    """dataset, contig, pos, strand, chem of confident positives of three call sets (dataset, contig, pos, strand, cov, pct).

    marks (dataset, c_marks: its credible marks on C, has_6ma). A 6mA call counts where the dataset has 6mA. A call of one C mark has it
    if it is credible; where both call and one mark alone is credible it is that one; all else is `untyped`. A dataset that marks doesn't
    list has none.
    """
    keys = ["dataset", "contig", "pos", "strand"]
    sure = lambda d: d.where((F.col("cov") >= min_cov) & (F.col("pct") >= min_pct)).select(*keys).distinct()
    flag = lambda d, c: sure(d).withColumn(c, F.lit(True))
    known = marks.select("dataset", F.coalesce("c_marks", F.array().cast("array<string>")).alias("_m"), F.coalesce("has_6ma", F.lit(False)).alias("_6"))
    j = flag(calls_4mc, "_4").join(flag(calls_5mc, "_5"), keys, "full_outer").join(known, "dataset", "left")
    a, b, m = F.coalesce("_4", F.lit(False)), F.coalesce("_5", F.lit(False)), F.coalesce("_m", F.array().cast("array<string>"))
    has = lambda x: F.array_contains(m, x)
    chem = F.when(a & ~b & has("4mC"), "4mC").when(b & ~a & has("5mC"), "5mC").when(a & b & (F.size(m) == 1), F.get(m, F.lit(0))).otherwise("untyped")
    return j.select(*keys, chem.alias("chem")).unionByName(sure(calls_6ma).join(known.where("_6"), "dataset", "left_semi").withColumn("chem", F.lit("6mA")))


def chem_counts(chems: DataFrame, marks: DataFrame) -> DataFrame:
    """By listed dataset how many sites have each outcome, zeros included."""
    every = marks.select("dataset", F.explode(F.array(*map(F.lit, ("6mA", "4mC", "5mC", "untyped")))).alias("chem"))
    return every.join(chems.groupBy("dataset", "chem").agg(F.count("*").alias("n")), ["dataset", "chem"], "left").select("dataset", "chem", F.coalesce("n", F.lit(0)).alias("n"))
