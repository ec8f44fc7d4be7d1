"""Benchmark cells, tables, audits and genome maps."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.operators import aggregate, labels, ranges, ranking


def score_rows(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """AUROC, AUPRC, F1 of the call frequency at 0.5 and share of sites called, by (row, model); status ok, pending (no
    score at all) or single-class."""
    a = ranking.areas(blocks, "label", "score", keys)
    hit = (F.col("frequency") >= 0.5).cast("int")
    c = ranking.counts_at(F.col("label"), hit)
    g = blocks.groupBy(*keys).agg(*[v.alias(k) for k, v in c.items()], F.avg((F.col("n_called") > 0).cast("int")).alias("called"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    j = g.join(a, keys, "left")
    status = F.when(F.col("called") == 0, "pending").when(F.col("auroc").isNull(), "single-class").otherwise("ok")
    return j.select(*keys, status.alias("status"), "n_pos", "n_neg", "auroc", "auprc", f1.alias("f1"), "called")


def applicable(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Pairs of two small tables whose base and context fit."""
    return rows.join(F.broadcast(models), F.array_contains("bases", F.col("base")) & ((F.col("model_context") == "any") | (F.col("model_context") == F.col("context"))))


def owns(marks: Column, row_marks: Column, model_context: Column, context: Column) -> Column:
    """The model's marks meet the row's, and a CpG-only model isn't asked elsewhere."""
    return F.arrays_overlap(marks, row_marks) & ~((model_context == "CpG") & (context != "CpG"))


def row_model_grid(rows: DataFrame, models: DataFrame, claims: DataFrame) -> DataFrame:
    """All pairs of rows and models (both of configuration size) with their claims."""
    return rows.join(F.broadcast(models.join(claims, "model", "left")))


def best_specialist(cells: DataFrame) -> DataFrame:
    """By row the best model outside of the row's own family."""
    return cells.where("family <> own_family AND auroc IS NOT NULL").groupBy("row").agg(F.max_by("model", F.struct("auroc", "model")).alias("model"), F.max("auroc").alias("auroc"))


def family_table(cells: DataFrame) -> DataFrame:
    """Best AUROC of each family by row; pending as long as one of its cells is."""
    x = F.col("auroc")
    return cells.groupBy("row", "family").agg(F.when(F.count_if(x.isNull()) > 0, None).otherwise(F.max(x)).alias("auroc"), F.count_if(x.isNull()).alias("n_pending"))


def null_flags(cells: DataFrame, nulls: DataFrame, high: float = 0.9) -> DataFrame:
    """Cells with their row's null score; flagged where the sequence alone reaches `high`."""
    return cells.join(nulls.select("row", F.col("auroc").alias("null_auroc")), "row", "left").withColumn("flag", F.coalesce(F.col("null_auroc") >= high, F.lit(False)))


def leaveout_table(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """In-distribution and left-out AUROC of each row, with the loss."""
    return inside.select("row", F.col("auroc").alias("inside")).join(outside.select("row", F.col("auroc").alias("outside")), "row", "full_outer").withColumn("loss", F.col("inside") - F.col("outside"))


def zero_r(train: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """The majority label of train, scored on test."""
    m = train.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select(F.col("label").alias("pred"))
    return test.join(F.broadcast(m)).groupBy(*by, "pred").agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def confusion(df: DataFrame, label: str, score: str, threshold: float, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), (F.col(score) >= threshold).cast("int").alias("pred")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    c = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("z")).agg(F.count("*").alias("n"))
    s = c.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(0)).alias("hit"))
    p = c.groupBy(F.col("z").alias("label")).agg(F.sum("n").alias("claimed"))
    j = s.join(p, "label", "full_outer").na.fill(0)
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return j.select("label", "support", div(F.col("hit"), F.col("claimed")).alias("precision"), div(F.col("hit"), F.col("support")).alias("recall"), div(2 * F.col("hit"), F.col("claimed") + F.col("support")).alias("f1"))


def fold_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    return ranking.binary_metrics(df, "label", "score", by)


def audit_matching(blocks: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """By row the share of keys that both classes cover."""
    k = blocks.groupBy(row, *keys).agg(F.min("label").alias("a"), F.max("label").alias("b"))
    return k.groupBy(row).agg(F.avg(((F.col("a") == 0) & (F.col("b") == 1)).cast("int")).alias("matched"), F.count("*").alias("n_keys"))


def audit_leakage(blocks: DataFrame, seen: DataFrame, row: str) -> DataFrame:
    """By row the median distance to the nearest trained position, and the share at distance 0."""
    d = ranges.nearest_distance(blocks.select(row, "contig", "pos").distinct(), seen)
    share = d.groupBy(row).agg(F.avg((F.coalesce("distance", F.lit(-1)) == 0).cast("int")).alias("share_seen"))
    return share.join(ranking.median(d, "distance", [row]).withColumnRenamed("median", "median_distance"), row, "left").select(row, "median_distance", "share_seen")


def audit_calls(scores: DataFrame, by: list[str], k: int) -> DataFrame:
    return aggregate.call_rates(scores, by, k)


def audit_pooled(pool: DataFrame, rows: str, by: list[str]) -> DataFrame:
    """Pooled AUROC on calibrated ranks, without each row in turn. Sites of equal score are counted first, so that all else moves counts."""
    y = F.col("label").cast("long")
    c = pool.groupBy(*by, rows, F.col("score").cast("double").alias("score")).agg(F.count("*").alias("k"), F.coalesce(F.sum(y), F.lit(0)).alias("p"), F.coalesce(F.sum(1 - y), F.lit(0)).alias("n")).persist(StorageLevel.DISK_ONLY)
    g = ranking.rank_calibrate_counts(c, by).where("p + n > 0").groupBy(*by, rows, F.col("calibrated").alias("score")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return ranking.auroc_without_of_counts(g, by, rows)


def genome_map(tracks: dict[str, DataFrame], w: int, min_sites: int = 1) -> DataFrame:
    """Windows of the sites that all models share."""
    models = list(tracks)
    first = tracks[models[0]].select("contig", "pos", models[0], "n_reads")
    shared = labels.shared_sites([first, *[tracks[m].select("contig", "pos", m) for m in models[1:]]], ["contig", "pos"])
    return aggregate.window_track(shared, w, models, min_sites)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns with average ranks on ties."""
    d = df.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    n = d.count()

    def rank(c: str) -> DataFrame:
        g = d.groupBy(F.col(c).cast("double").alias(c)).agg(F.count("*").alias("k"))
        r = ranking.running(g, [], c, ["k"]) if n else g.withColumn("cum_k", F.col("k"))
        return r.select(c, (F.col("cum_k") - F.col("k") + (F.col("k") + 1) / 2).alias(f"r{c}"))

    return d.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")}).join(rank("x"), "x").join(rank("y"), "y").agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def genes_in_windows(windows: DataFrame, genes: DataFrame, w: int) -> DataFrame:
    """Genes that overlap each window."""
    g = genes.select("contig", "gene", F.explode(F.sequence(F.floor(F.col("start") / w), F.floor((F.col("end") - 1) / w))).alias("win"))
    return windows.join(g, ["contig", "win"]).select(*windows.columns, "gene")


def deviation_profile(images: DataFrame) -> DataFrame:
    """images (contig, pos, image_idx, w, delta): median over an image's reads at each column, then the mean by position."""
    m = images.groupBy("contig", "pos", "image_idx", "w").agg(F.median("delta").alias("d"))
    return m.groupBy("contig", (F.col("pos") + F.col("w")).alias("pos")).agg(F.avg("d").alias("deviation"), F.count("*").alias("n"))


def offset_scan(diff: DataFrame, hits: DataFrame, least: int = 20) -> DataFrame:
    """diff (contig, pos, d), hits (motif, contig, pos, offset): z of the mean at each offset against all positions."""
    s = diff.agg(F.avg("d").alias("_m"), F.stddev_pop("d").alias("_s"))
    g = hits.join(diff, ["contig", "pos"]).groupBy("motif", "offset").agg(F.avg("d").alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)
    return g.join(F.broadcast(s)).select("motif", "offset", "mean", "n", ((F.col("mean") - F.col("_m")) / (F.col("_s") / F.sqrt("n"))).alias("z"))


def image_summary(rows: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """rows: one per image row, null where masked; number of rows, mean and population sd of each channel (sd 1 if flat)."""
    sd = lambda c: F.when(F.stddev_pop(c) > 1e-12, F.stddev_pop(c)).otherwise(1.0)
    return rows.groupBy(*by).agg(F.count("*").alias("n_reads"), *[x for c in channels for x in (F.avg(c).alias(f"{c}_mean"), sd(c).alias(f"{c}_sd"))])


def kmer_center(pairs: DataFrame, least: int = 10) -> DataFrame:
    """pairs (read_id, offset, observed, expected): the offset whose mean correlation over reads is largest."""
    c = pairs.groupBy("offset", "read_id").agg(F.corr("observed", "expected").alias("r"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    return c.groupBy("offset").agg(F.avg("r").alias("r"), F.count("*").alias("n_reads")).agg(F.max_by("offset", F.struct("r", -F.col("offset"))).alias("offset"), F.max("r").alias("r"))


def evaluate_sites(sites: DataFrame, truth: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """External sites: label by truth, mean score by position, metrics."""
    s = aggregate.aggregate_by_position(labels.label_sites(scores.join(sites, ["contig", "pos"], "left_semi"), truth, ["contig", "pos"]), ["contig", "pos"])
    return ranking.binary_metrics(s, "label", "prob", by)

