"""From per-read calls to site scores, tracks and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE = ["contig", "pos", "strand"]


def aggregate_calls(calls: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Largest probability of each read at a site, then n_called, sum_p and n_mod (probability over 0.5)."""
    keys = keys or SITE
    one = calls.groupBy("read_id", *keys).agg(F.max("prob").alias("p"))
    return one.groupBy(*keys).agg(F.count("*").alias("n_called"), F.sum("p").alias("sum_p"), F.count_if(F.col("p") > 0.5).alias("n_mod"))


def aggregate_sites(scores: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Site-level tools in the form of calls: sum_p = score * k, n_mod = k if score >= 0.5."""
    keys = keys or SITE
    m = scores.groupBy(*keys).agg(F.max("score").alias("score"), F.max("n_reads").alias("n_called"))
    return m.select(*keys, "n_called", (F.col("score") * k).alias("sum_p"), F.when(F.col("score") >= 0.5, k).otherwise(0).alias("n_mod"))


def aggregate_by_position(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("label").alias("label"), F.avg("prob").alias("prob"))


def max_over_codes(bedmethyl: DataFrame) -> DataFrame:
    return bedmethyl.where("strand = '+'").groupBy("contig", "pos").agg(F.max("cov").alias("cov"), F.max("frac").alias("frac"))


def dominant_code(bedmethyl: DataFrame, min_cov: int) -> DataFrame:
    """The code of largest share at each site with enough coverage; the earlier file and line win ties."""
    best = F.max_by("code", F.struct("frac", -F.col("file_ord"), -F.col("line")))
    return bedmethyl.where(F.col("cov") >= min_cov).groupBy("contig", "pos").agg(best.alias("code"))


def steady_mean(x: str) -> Column:
    """The mean of a group of bounded size, added up in the order of the values: equal values have equal means, to the last bit."""
    return F.when(F.count(x) > 0, F.aggregate(F.array_sort(F.collect_list(F.col(x).cast("double"))), F.lit(0.0), lambda a, v: a + v) / F.count(x))


def window_track(df: DataFrame, w: int, models: list[str], min_sites: int = 1) -> DataFrame:
    """Means by window of w positions; windows with fewer sites go."""
    g = df.groupBy("contig", F.floor(F.col("pos") / w).alias("win")).agg(*[steady_mean(m).alias(m) for m in models], F.avg("n_reads").alias("covg"), F.count("*").alias("n"))
    return g.where(F.col("n") >= min_sites).withColumn("start", F.col("win") * w)


def track_reference(windows: DataFrame, model: str, q: float = 0.999) -> DataFrame:
    return windows.agg(F.median(model).alias("median"), F.percentile("covg", q).alias("covg_q"))


def box_summary(features: DataFrame, value: str, by: list[str]) -> DataFrame:
    return features.groupBy(*by).agg(*[F.percentile(value, q).alias(n) for n, q in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))], F.count(value).alias("n"))


def census(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by all dimensions and their subtotals; null stands for all."""
    return df.cube(*dims).agg(F.count("*").alias("n"))


def type_counts(images: DataFrame, types: DataFrame, keys: list[str]) -> DataFrame:
    return images.join(types, keys, "left").groupBy(F.coalesce("type", F.lit("untyped_mod")).alias("type")).agg(F.count("*").alias("n"))


def call_rates(scores: DataFrame, by: list[str], k: int) -> DataFrame:
    return scores.groupBy(*by).agg((F.avg("n_called") / k).alias("call_rate"))


def model_summary(cells: DataFrame, own: Column, good: float = 0.9) -> DataFrame:
    """Means over all rows and over own rows, rows at `good` or more; a pending (null) cell makes its mean null."""
    mean = lambda c: F.when(F.count_if(c.isNull()) == 0, F.avg(c))
    x = F.col("auroc")
    return cells.groupBy("model").agg(mean(x).alias("mean_all"), F.when(F.count_if(own & x.isNull()) == 0, F.avg(F.when(own, x))).alias("mean_own"), F.count_if(x >= good).alias("n_good"))


def pivot_models(cells: DataFrame, models: list[str]) -> DataFrame:
    return cells.groupBy("row").pivot("model", models).agg(F.first("auroc"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    n, p = F.count("*"), F.sum(F.col(label))
    return df.agg(p.alias("n_pos"), (n - p).alias("n_neg"), ((n - p) / p).alias("pos_weight"), (n / (2 * p)).alias("w_pos"), (n / (2 * (n - p))).alias("w_neg"))


def call_rate_panel(preds: DataFrame, by: list[str]) -> DataFrame:
    """Share called positive: false positives on controls, recall on native rows."""
    return preds.groupBy(*by).agg(F.avg(F.when(F.col("label") == 0, F.col("pred"))).alias("fpr"), F.avg(F.when(F.col("label") == 1, F.col("pred"))).alias("recall"))


def methyl_counts(letters: DataFrame, meth: str = "ZXH", unmeth: str = "zxh") -> DataFrame:
    """letters: contig, start, xm (a string of call letters); counts by position."""
    e = letters.select("contig", "start", F.posexplode(F.split("xm", "")).alias("i", "c")).where(F.col("c").isin(*meth, *unmeth))
    return e.groupBy("contig", (F.col("start") + F.col("i")).alias("pos")).agg(F.count_if(F.col("c").isin(*meth)).alias("n_meth"), F.count_if(F.col("c").isin(*unmeth)).alias("n_unmeth"))
