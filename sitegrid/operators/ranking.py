"""Ranking metrics by group: scores are collapsed to distinct values, and running sums go by score bucket, so that neither
a large group nor a single one is ever one task's rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 64


def running(df: DataFrame, by: list[str], order: str, cols: list[str], descending: bool = False) -> DataFrame:
    """df with inclusive running sums cum_<col> in the order of a numeric column, by group: sums inside buckets of the
    order plus the totals of the buckets before. Ties must have been collapsed; the collapsed rows are kept on disk, since the
    cuts, the sums inside buckets and the totals each need them, and what they come from would run, and be shuffled, for each."""
    df = df.persist(StorageLevel.DISK_ONLY)
    cuts = df.agg(F.percentile_approx(order, [i / STEPS for i in range(1, STEPS)], 1000)).first()[0] or []
    bounds = sorted(set(cuts))
    b = F.size(F.filter(F.array(*[F.lit(float(x)) for x in bounds]), lambda x: x <= F.col(order))) if bounds else F.lit(0)
    d = df.withColumn("_b", -b if descending else b)
    o = F.desc(order) if descending else F.asc(order)
    w = Window.partitionBy(*by, "_b").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    own = d.withColumns({f"cum_{c}": F.sum(c).over(w) for c in cols})
    v = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in cols])
    before = sums.select(*by, "_b", *[F.coalesce(F.sum(c).over(v), F.lit(0)).alias(f"_{c}") for c in cols])
    return own.join(before, [*by, "_b"]).withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_{c}") for c in cols}).drop("_b", *[f"_{c}" for c in cols])


def numbered(df: DataFrame, by: list[str], key: Column, *ties: Column | str) -> DataFrame:
    """df with _rn, its row number from 1 in the order of a key of hex letters, by group, and _n, the group's rows: numbers
    inside buckets of the key's first letters plus the rows of the buckets before."""
    d = df.withColumn("_key", key).withColumn("_b", F.substring("_key", 1, 3))
    own = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_key", *ties)))
    w = Window.partitionBy(*by)  # of at most 4,096 buckets
    sums = d.groupBy(*by, "_b").agg(F.count("*").alias("_k"))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_b").alias("_c"), (F.sum("_k").over(w.orderBy("_b")) - F.col("_k")).alias("_before"), F.sum("_k").over(w).alias("_n"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_b") == F.col("_c")]
    return own.join(sums, on).withColumn("_rn", F.col("_rn") + F.col("_before")).drop("_key", "_b", "_c", "_before", *[f"_{c}" for c in by])


def by_score(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    y = F.col(label).cast("long")
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))


def auroc(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve with tie-averaged ranks; null where a class is absent."""
    return auroc_of_counts(by_score(df, label, score, by), by)


def auroc_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """auroc from by_score's table: score, p, n."""
    r = running(counts, by, "score", ["p", "n"])
    won = F.sum(F.col("p") * (F.col("cum_n") - F.col("n") / 2.0))
    pos, neg = F.sum("p"), F.sum("n")
    return r.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.when((pos > 0) & (neg > 0), won / (pos * neg)).alias("auroc"))


def areas(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """auroc and average_precision in one pass: n_pos, n_neg, auroc, auprc."""
    r = running(by_score(df, label, score, by), by, "score", ["p", "n"], descending=True)
    tp, fp, pos, neg = F.col("cum_p"), F.col("cum_n"), F.sum("p"), F.sum("n")
    # a negative of lower score is won by each positive: all of them less those met so far
    won = pos * neg - F.sum(F.col("p") * (fp - F.col("n") / 2.0))
    return r.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.when((pos > 0) & (neg > 0), won / (pos * neg)).alias("auroc"), F.when(pos > 0, F.sum(tp / (tp + fp) * F.col("p")) / pos).alias("auprc"))


def pr_curve(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """threshold, tp, fp, precision, recall at each distinct score, highest first."""
    r = running(by_score(df, label, score, by), by, "score", ["p", "n"], descending=True)
    total = r.groupBy(*by).agg(F.sum("p").alias("_pos")) if by else r.agg(F.sum("p").alias("_pos"))
    j = r.join(total, by) if by else r.crossJoin(F.broadcast(total))
    return j.select(*by, F.col("score").alias("threshold"), "p", F.col("cum_p").alias("tp"), F.col("cum_n").alias("fp"), (F.col("cum_p") / (F.col("cum_p") + F.col("cum_n"))).alias("precision"), F.when(F.col("_pos") > 0, F.col("cum_p") / F.col("_pos")).alias("recall"), "_pos")


def average_precision(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Sum of precision times the rise in recall; null without positives."""
    return pr_curve(df, label, score, by).groupBy(*by).agg(F.when(F.max("_pos") > 0, F.sum(F.col("precision") * F.col("p")) / F.max("_pos")).alias("auprc"))


def best_threshold(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """The threshold of greatest F1, 2pr/(p+r+1e-8), the lowest on ties; 0.5 where there is one class only."""
    c = pr_curve(df, label, score, by)
    f1 = F.when(F.col("_pos") > 0, F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8), 12)).otherwise(0.0)
    c = c.withColumn("f1", f1)
    one = (F.max("_pos") == 0) | (F.max("fp") == 0)
    return c.groupBy(*by).agg(F.when(one, 0.5).otherwise(F.max_by("threshold", F.struct("f1", -F.col("threshold")))).alias("threshold"), F.when(one, None).otherwise(F.max("f1")).alias("best_f1"))


def roc_grid(df: DataFrame, label: str, score: str, by: list[str], grid: list[float]) -> DataFrame:
    """True positive rate at given false positive rates, linear between the curve's points, which begin at (0, 0)."""
    r = running(by_score(df, label, score, by), by, "score", ["p", "n"], descending=True)
    total = r.groupBy(*by).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n")).where("_p > 0 AND _n > 0")
    pts = r.join(total, by).select(*by, (F.col("cum_n") / F.col("_n")).alias("fpr"), (F.col("cum_p") / F.col("_p")).alias("tpr"))
    pts = pts.unionByName(total.select(*by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    g = F.explode(F.array(*[F.lit(x) for x in grid])).alias("at")
    # of each grid value the points next to it on both sides
    near = pts.select(*by, "fpr", "tpr", g).groupBy(*by, "at").agg(
        F.max(F.when(F.col("fpr") <= F.col("at"), F.struct("fpr", "tpr"))).alias("lo"),
        F.min(F.when(F.col("fpr") > F.col("at"), F.struct("fpr", "tpr"))).alias("hi"),
    )
    t = F.col("lo.tpr") + (F.col("at") - F.col("lo.fpr")) * (F.col("hi.tpr") - F.col("lo.tpr")) / (F.col("hi.fpr") - F.col("lo.fpr"))
    return near.select(*by, F.col("at").alias("fpr"), F.coalesce(t, F.col("lo.tpr")).alias("tpr"))


def median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact median by group, from counts of distinct values: a hot group is no task's rows. Nulls don't count."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("k"))
    r = running(g, by, "_v", ["k"]).join(g.groupBy(*by).agg(F.sum("k").alias("_n")), by)
    at = lambda rank: F.min(F.when(F.col("cum_k") >= rank, F.col("_v")))
    return r.groupBy(*by).agg(((at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2).alias("median"))


def auroc_without(df: DataFrame, label: str, score: str, by: list[str], part: str) -> DataFrame:
    """AUROC by group without each value of a further column in turn (left_out): the pairs of all rows, less those in
    which one row or both are of that part. No row is copied."""
    return auroc_without_of_counts(by_score(df, label, score, [*by, part]), by, part)


def auroc_without_of_counts(counts: DataFrame, by: list[str], part: str) -> DataFrame:
    """auroc_without from by_score's table by group and part: score, p, n."""
    own = running(counts, [*by, part], "score", ["p", "n"])
    all_ = running(counts.groupBy(*by, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), by, "score", ["p", "n"])
    tot = all_.groupBy(*by).agg(F.sum("p").alias("_pos"), F.sum("n").alias("_neg"), F.sum(F.col("p") * (F.col("cum_n") - F.col("n") / 2)).alias("_won"))
    at = all_.select(*by, "score", F.col("p").alias("_p"), F.col("n").alias("_n"), F.col("cum_p").alias("_cp"), F.col("cum_n").alias("_cn"))
    j = own.join(at, [*by, "score"]).join(tot, by)
    lost = F.col("p") * (F.col("_cn") - F.col("_n") / 2) + F.col("n") * (F.col("_pos") - F.col("_cp") + F.col("_p") / 2) - F.col("p") * (F.col("cum_n") - F.col("n") / 2)
    g = j.groupBy(*by, F.col(part).alias("left_out")).agg((F.max("_pos") - F.sum("p")).alias("n_pos"), (F.max("_neg") - F.sum("n")).alias("n_neg"), (F.max("_won") - F.sum(lost)).alias("_won"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return g.select(*by, "left_out", "n_pos", "n_neg", F.when(ok, F.col("_won") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def rank_calibrate(scores: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Average rank over n, by group, joined back by score."""
    d = scores.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.count("*").alias("k"))
    r = running(d, by, "_s", ["k"])
    n = d.groupBy(*by).agg(F.sum("k").alias("_n"))
    r = r.join(n, by).select(*by, "_s", ((F.col("cum_k") - F.col("k") + (F.col("k") + 1) / 2) / F.col("_n")).alias("calibrated"))
    return scores.withColumn("_s", F.col(score).cast("double")).join(r, [*by, "_s"]).drop("_s")


def rank_calibrate_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """rank_calibrate from counts: score, and k, how many rows have it; counts with the column calibrated."""
    d = counts.groupBy(*by, F.col("score").alias("_s")).agg(F.sum("k").alias("_k"))
    r = running(d, by, "_s", ["_k"]).join(d.groupBy(*by).agg(F.sum("_k").alias("_n")), by)
    r = r.select(*by, F.col("_s").alias("score"), ((F.col("cum__k") - F.col("_k") + (F.col("_k") + 1) / 2) / F.col("_n")).alias("calibrated"))
    return counts.join(r, [*by, "score"])


def counts_at(label: Column, pred: Column) -> dict[str, Column]:
    return {"tp": F.count_if((label == 1) & (pred == 1)), "fp": F.count_if((label == 0) & (pred == 1)), "fn": F.count_if((label == 1) & (pred == 0)), "tn": F.count_if((label == 0) & (pred == 0))}


def binary_metrics(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """F1 (micro, of both classes, macro), precision, recall, AUPRC, AUROC at the threshold of best F1; n_pos and n_test.

    All of them come from one pass over the collapsed scores: the curve's point at the threshold has its counts."""
    r = running(by_score(df, label, score, by), by, "score", ["p", "n"], descending=True)
    tp, fp = F.col("cum_p"), F.col("cum_n")
    total = r.groupBy(*by).agg(F.sum("p").alias("_pos"), F.sum("n").alias("_neg"))
    c = r.join(total, by) if by else r.crossJoin(F.broadcast(total))
    precision = tp / (tp + fp)
    recall = tp / F.col("_pos")
    f1 = F.when(F.col("_pos") > 0, F.round(2 * precision * recall / (precision + recall + 1e-8), 12)).otherwise(0.0)
    at = F.max_by(F.struct("score", tp.alias("tp"), fp.alias("fp")), F.struct(f1, -F.col("score")))
    pos, neg = F.max("_pos"), F.max("_neg")
    # of one class only the threshold is 0.5
    half = F.col("score") >= 0.5
    low = F.struct(F.lit(0.5).alias("score"), F.coalesce(F.sum(F.when(half, F.col("p"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(half, F.col("n"))), F.lit(0)).alias("fp"))
    won = F.sum(F.col("p") * (F.col("_neg") - fp + F.col("n") / 2.0))
    c = c.groupBy(*by).agg(
        F.when((pos == 0) | (neg == 0), low).otherwise(at).alias("at"), pos.alias("_pos"), neg.alias("_neg"),
        F.when((pos > 0) & (neg > 0), won / (pos * neg)).alias("auroc"),
        F.when(pos > 0, F.sum(precision * F.col("p")) / pos).alias("auprc"),
    )
    c = c.select(*by, F.col("at.score").alias("threshold"), F.col("at.tp").alias("tp"), F.col("at.fp").alias("fp"), (F.col("_pos") - F.col("at.tp")).alias("fn"), (F.col("_neg") - F.col("at.fp")).alias("tn"), (F.col("_pos") + F.col("_neg")).alias("n_test"), "auroc", "auprc")
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    mod, unmod = div(2 * tp, 2 * tp + fp + fn), div(2 * tn, 2 * tn + fp + fn)
    c = c.select(*by, "threshold", "n_test", (tp + fn).alias("n_pos"), div(tp + tn, tp + tn + fp + fn).alias("micro_f1"), mod.alias("mod_f1"), unmod.alias("unmod_f1"), ((mod + unmod) / 2).alias("macro_f1"), div(tp, tp + fp).alias("mod_prec"), div(tp, tp + fn).alias("mod_rec"), "auroc", "auprc")
    return c
