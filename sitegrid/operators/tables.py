"""Benchmark tables: every model, every tool with the models it has for a row, and every tool without knowledge of the row.

Inputs, of which sites and scores are large:

- rows: row, chem (a mark, or `mixed`), context (`any`, `cpg`, `noncpg`), samples (array)
- models: model, family, marks (array), context (`any`, `cpg`)
- sites: row, sample, contig, pos, strand, label, is_cpg; a site may stand in a positive and in a negative sample
- scores: sample, model, contig, pos, strand, sum_p, at most one row for each; a site without one scores 0
- present: sample, model: outputs that are in
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.functions.scalar import hash_key
from sitegrid.operators import ranking

SITE = ["sample", "contig", "pos", "strand"]
CELL = ["kind", "row", "column"]
MIXED = ("6mA", "4mC", "5mC")


def marks_of(chem: Column) -> Column:
    return F.when(chem == "mixed", F.array(*map(F.lit, MIXED))).otherwise(F.array(chem))


def trained_for(rows: DataFrame, models: DataFrame) -> DataFrame:
    """row, model, family, context of the models trained for a row: a mark in common, and no model of CpG alone on a row without them."""
    r = rows.select("row", F.col("context").alias("_row"), F.explode(F.array_distinct(marks_of(F.col("chem")))).alias("_mark"))
    m = models.select("model", "family", "context", F.explode(F.array_distinct("marks")).alias("_mark"))
    return r.join(m, "_mark").where(~((F.col("context") == "cpg") & (F.col("_row") == "noncpg"))).select("row", "model", "family", "context").distinct()


def usage(rows: DataFrame, models: DataFrame) -> DataFrame:
    """kind, row, column, model: the models whose best site scores make a cell. Kind `models` has a column for each model; `matched`
    one for each family, with its models trained for the row; `agnostic` one for each family, with all of its models."""
    one = F.lit(1).alias("_one")
    every = rows.select("row", one).join(models.select("model", "family", one), "_one")
    kind = lambda d, name, column: d.select(F.lit(name).alias("kind"), "row", F.col(column).alias("column"), "model")
    return kind(every, "models", "model").unionByName(kind(trained_for(rows, models), "matched", "family")).unionByName(kind(every, "agnostic", "family"))


def grid(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Every cell of the three kinds: its models, whether one of them is trained for the row, and whether it counts CpG sites alone:
    a matched cell does where the row has sites of all contexts and all of its models know CpG only."""
    use, own = usage(rows, models), trained_for(rows, models).select("row", "model", F.lit(1).alias("_own"))
    u = use.join(own, ["row", "model"], "left").join(models.select("model", F.col("context").alias("_context")), "model").join(rows.select("row", F.col("context").alias("_row")), "row")
    cpg = (F.col("kind") == "matched") & (F.max("_row") == "any") & (F.count_if(F.col("_context") != "cpg") == 0)
    known = u.groupBy(*CELL).agg(F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"), F.coalesce(F.max("_own") == 1, F.lit(False)).alias("own"), cpg.alias("cpg_only"))
    cells = use.where("kind = 'agnostic'").select(F.explode(F.array(F.lit("matched"), F.lit("agnostic"))).alias("kind"), "row", "column").unionByName(use.where("kind = 'models'").select(*CELL)).distinct()
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return cells.join(known, CELL, "left").select(*CELL, F.coalesce("models", F.lit("")).alias("models"), no("own"), no("cpg_only"))


def cell_scores(sites: DataFrame, scores: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """cells (kind, row, column, _models and further columns) and each site of the row with its score: the largest of the cell's
    models. A site meets its scores once, as one column for each model that a cell names, and its row's cells in the same task,
    so what aggregates the result by cell collapses it before it is shuffled."""
    names = sorted(r[0] for r in cells.select(F.explode("_models")).distinct().collect())  # of configuration size
    known = scores.groupBy(*SITE).agg(*[F.max(F.when(F.col("model") == m, F.col("sum_p").cast("double"))).alias(f"_p{i}") for i, m in enumerate(names)])
    asked = cells.select("*", *[F.array_contains("_models", m).alias(f"_u{i}") for i, m in enumerate(names)])
    j = sites.select("row", *SITE, "label", "is_cpg").distinct().join(known, SITE, "left").join(F.broadcast(asked), "row")
    none = F.lit(None).cast("double")
    best = F.greatest(none, none, *[F.when(F.col(f"_u{i}"), F.coalesce(f"_p{i}", F.lit(0.0))) for i in range(len(names))])
    return j.withColumn("score", best / k).drop("_models", *[f"_{x}{i}" for x in "pu" for i in range(len(names))])


def models_of(use: DataFrame) -> DataFrame:
    """kind, row, column, _models: a cell's models as an array."""
    return use.groupBy(*CELL).agg(F.collect_set("model").alias("_models"))


def pending(rows: DataFrame, use: DataFrame, present: DataFrame) -> DataFrame:
    """Cells of which the output of any model on any of the row's samples isn't in."""
    need = use.join(rows.select("row", F.explode("samples").alias("sample")), "row")
    return need.join(present.select("sample", "model"), ["sample", "model"], "left_anti").select(*CELL).distinct()


def benchmark_cells(rows: DataFrame, models: DataFrame, sites: DataFrame, scores: DataFrame, present: DataFrame, k: int) -> DataFrame:
    """kind, row, column, models, own, cpg_only, status, auroc, n: all cells of the three tables, in one pass over the sites.

    status: `pending`, `N/A` (no model for the row, or a matched row of one class), `single-class`, `ok`."""
    use, cells = usage(rows, models), grid(rows, models)
    asked = models_of(use).join(cells.select(*CELL, "cpg_only"), CELL)
    d = cell_scores(sites, scores, asked, k).where("is_cpg OR NOT cpg_only")
    a = ranking.auroc(d, "label", "score", CELL)
    late = pending(rows, use, present).withColumn("_late", F.lit(1))
    j = cells.join(a, CELL, "left").join(late, CELL, "left")
    status = F.when(F.col("models") == "", "N/A").when(F.col("_late") == 1, "pending").when(F.col("auroc").isNull(), F.when(F.col("kind") == "matched", "N/A").otherwise("single-class")).otherwise("ok")
    j = j.withColumn("status", status)
    ok = F.col("status") == "ok"
    return j.select(*CELL, "models", "own", "cpg_only", "status", F.when(ok, F.col("auroc")).alias("auroc"), F.when(ok, F.col("n_pos") + F.col("n_neg")).alias("n"))


def with_null(cells: DataFrame, nulls: DataFrame, high: float = 0.9, low: float = 0.75) -> DataFrame:
    """Cells with the row's sequence-only score, and whether it is high, or so low that the row counts as clean."""
    d = cells.join(nulls.select("row", "null_auroc"), "row", "left")
    return d.withColumns({"high_null": F.coalesce(F.col("null_auroc") >= high, F.lit(False)), "clean": F.coalesce(F.col("null_auroc") < low, F.lit(False))})


def matched_means(cells: DataFrame) -> DataFrame:
    """By tool: the mean over the rows that it scores, their number, and that of all rows."""
    return cells.where("kind = 'matched'").groupBy("column").agg(F.avg("auroc").alias("mean"), F.count("auroc").alias("n_scored"), F.count("*").alias("n_rows"))


def _mean(of: Column) -> Column:
    """null as long as any cell isn't in."""
    return F.when(F.count_if(of & (F.col("status") == "pending")) == 0, F.avg(F.when(of, F.col("auroc"))))


def agnostic_means(cells: DataFrame) -> DataFrame:
    """By tool, of with_null's table: the mean over all rows, and over clean ones."""
    return cells.where("kind = 'agnostic'").groupBy("column").agg(_mean(F.lit(True)).alias("mean"), _mean(F.col("clean")).alias("mean_clean"))


def model_means(cells: DataFrame, good: float = 0.9) -> DataFrame:
    """By model: the mean over all rows, over its own, and how many rows reach `good`; null as long as one of them is pending."""
    late = F.count_if(F.col("status") == "pending")
    return cells.where("kind = 'models'").groupBy("column").agg(_mean(F.lit(True)).alias("mean"), _mean(F.col("own")).alias("mean_own"), F.when(late == 0, F.count_if(F.col("auroc") >= good)).alias("n_good"))


def pooled_sites(sites: DataFrame, cap: int = 1_000, seed: int = 0) -> DataFrame:
    """At most cap sites of each row and class, by a seeded hash."""
    w = ["row", "label"]
    d = ranking.numbered(sites, w, hash_key(seed, *SITE), *SITE)
    return d.where(F.col("_rn") <= cap).drop("_rn", "_n")


def pooled_auroc(rows: DataFrame, models: DataFrame, sites: DataFrame, scores: DataFrame, present: DataFrame, k: int, cap: int = 1_000, seed: int = 0) -> DataFrame:
    """By tool the AUROC of one threshold over the pooled sites of all rows, with all of its models; null as long as any is pending."""
    use = usage(rows, models).where("kind = 'agnostic'")
    a = ranking.auroc(cell_scores(pooled_sites(sites, cap, seed), scores, models_of(use), k), "label", "score", ["column"])
    late = pending(rows, use, present).select("column").distinct().withColumn("_late", F.lit(1))
    j = use.select("column").distinct().join(a, "column", "left").join(late, "column", "left")
    return j.select("column", F.when(F.col("_late").isNull(), F.col("auroc")).alias("auroc"), (F.col("n_pos") + F.col("n_neg")).alias("n"))


def leaveout_rows(cells: DataFrame, inside: str, held_out: DataFrame, family_of: DataFrame) -> DataFrame:
    """By row: AUROC of the model `inside`, and of the model that held the row's data out (held_out: row, model; where there is none
    the same one); the best model trained for the row that is of another family, and its AUROC. Ties go to the name that comes first."""
    m = cells.where("kind = 'models' AND auroc IS NOT NULL").select("row", F.col("column").alias("model"), "own", "auroc").join(family_of.select("model", "family"), "model")
    a = m.where(F.col("model") == inside).select("row", F.col("auroc").alias("inside"), F.col("family").alias("_family"))
    h = held_out.select("row", F.col("model").alias("checkpoint"))
    b = m.select("row", F.col("model").alias("checkpoint"), F.col("auroc").alias("outside"))
    d = a.join(h, "row", "left").withColumn("checkpoint", F.coalesce("checkpoint", F.lit(inside))).join(b, ["row", "checkpoint"], "left")
    others = m.where("own").join(a.select("row", "_family"), "row").where("family <> _family")
    w = Window.partitionBy("row").orderBy(F.desc("auroc"), "model")
    best = others.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("row", F.col("model").alias("specialist"), F.col("auroc").alias("specialist_auroc"))
    return d.join(best, "row", "left").select("row", "checkpoint", "inside", "outside", (F.col("inside") - F.col("outside")).alias("loss"), "specialist", "specialist_auroc")
