"""Queries: the benchmark's tables over all line items. A row is a group of suppliers with a positive and a negative sample;
line numbers are models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrid.operators import tables as T
from sitegrid.plans.core import dealt, q, r6, t

K, HIGH, GOOD = 20, 0.6, 0.55
MODELS = [("m0", "A", ["5mC", "6mA"], "any"), ("m1", "A", ["5mC"], "cpg"), ("m2", "B", ["6mA", "4mC"], "any"), ("m3", "C", ["5mC", "5hmC"], "cpg"), ("m4", "C", ["5hmC"], "cpg")]
CHEM, CONTEXT = ["5mC", "6mA", "mixed", "5hmU", "5hmC"], ["any", "cpg", "noncpg"]

INPUTS = """
li AS (SELECT l_suppkey % 20 AS "row", l_suppkey AS contig, l_partkey AS pos, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  'm' || (l_linenumber % 5) AS model, CAST(round(l_discount * 100) AS BIGINT) AS v FROM lineitem),
site AS (SELECT DISTINCT "row", "row" * 2 + label AS sample, contig, pos, strand, label, pos % 2 = 0 AS is_cpg FROM li),
sc AS (SELECT "row" * 2 + label AS sample, model, contig, pos, strand, sum(v * (2 + label)) AS sum_p FROM li GROUP BY ALL),
pres AS (SELECT DISTINCT sample, model FROM sc WHERE NOT (sample % 13 = 5 AND model = 'm2')),
rws AS (SELECT DISTINCT "row", ['5mC', '6mA', 'mixed', '5hmU', '5hmC'][CAST("row" % 5 AS INT) + 1] AS chem, ['any', 'cpg', 'noncpg'][CAST("row" % 3 AS INT) + 1] AS context FROM li),
nul AS (SELECT "row", CASE WHEN "row" % 5 <> 4 THEN "row" * 37 % 100 / 100 END AS null_auroc FROM rws),
mdl(model, family, marks, mc) AS (VALUES ('m0', 'A', ['5mC', '6mA'], 'any'), ('m1', 'A', ['5mC'], 'cpg'), ('m2', 'B', ['6mA', '4mC'], 'any'), ('m3', 'C', ['5mC', '5hmC'], 'cpg'), ('m4', 'C', ['5hmC'], 'cpg')),
pair AS (SELECT rws."row", context, model, family, mc, list_has_any(marks, CASE WHEN chem = 'mixed' THEN ['6mA', '4mC', '5mC'] ELSE [chem] END) AND NOT (mc = 'cpg' AND context = 'noncpg') AS own FROM rws, mdl),
used AS (SELECT 'models' AS kind, model AS "column", * FROM pair UNION ALL SELECT 'matched', family, * FROM pair WHERE own UNION ALL SELECT 'agnostic', family, * FROM pair),
use AS (SELECT used.*, p0.model IS NULL OR p1.model IS NULL AS miss FROM used LEFT JOIN pres p0 ON p0.model = used.model AND p0.sample = used."row" * 2 LEFT JOIN pres p1 ON p1.model = used.model AND p1.sample = used."row" * 2 + 1),
cell AS (SELECT kind, "row", "column", string_agg(model, ',' ORDER BY model) AS models, bool_or(own) AS own, kind = 'matched' AND bool_and(mc = 'cpg') AND any_value(context) = 'any' AS cpg_only, bool_or(miss) AS late FROM use GROUP BY kind, "row", "column"),
"""
CELLS = INPUTS + """
best AS (SELECT u.kind, u."row", u."column", s.sample, s.contig, s.pos, s.strand, s.label, s.is_cpg, max(coalesce(sum_p, 0)) / 20 AS score
  FROM site s JOIN use u ON u."row" = s."row" LEFT JOIN sc ON sc.model = u.model AND sc.sample = s.sample AND sc.contig = s.contig AND sc.pos = s.pos AND sc.strand = s.strand GROUP BY ALL),
rk AS (SELECT best.*, (rank() OVER w + (count(*) OVER (PARTITION BY best.kind, best."row", best."column", score) - 1) / 2.0) AS r FROM best JOIN cell ON cell.kind = best.kind AND cell."row" = best."row" AND cell."column" = best."column" WHERE is_cpg OR NOT cpg_only
  WINDOW w AS (PARTITION BY best.kind, best."row", best."column" ORDER BY score)),
au AS (SELECT kind, "row", "column", count(*) AS n, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0) AS auroc FROM rk GROUP BY ALL),
every AS (SELECT DISTINCT 'matched' AS kind, "row", family AS "column" FROM pair UNION SELECT 'agnostic', "row", family FROM pair UNION SELECT 'models', "row", model FROM pair),
j AS (SELECT every.*, coalesce(models, '') AS models, coalesce(own, false) AS own, coalesce(cpg_only, false) AS cpg_only, auroc, n,
  CASE WHEN models IS NULL THEN 'N/A' WHEN late THEN 'pending' WHEN auroc IS NULL THEN CASE WHEN kind = 'matched' THEN 'N/A' ELSE 'single-class' END ELSE 'ok' END AS status FROM every LEFT JOIN cell USING (kind, "row", "column") LEFT JOIN au USING (kind, "row", "column")),
cells AS (SELECT kind, "row", "column", models, own, cpg_only, status, CASE WHEN status = 'ok' THEN auroc END AS auroc, CASE WHEN status = 'ok' THEN n END AS n FROM j)
"""


def inputs(s, d):
    r = F.col("l_suppkey") % 20
    li = t(s, d, "lineitem").select(r.alias("row"), F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.concat(F.lit("m"), (F.col("l_linenumber") % 5).cast("string")).alias("model"), F.round(F.col("l_discount") * 100).cast("long").alias("v"))
    li = li.withColumn("sample", F.col("row") * 2 + F.col("label"))
    at_site = dealt(s, li, t(s, d, "lineitem").count(), "sample", "contig", "pos", "strand")
    sites = at_site.select("row", "sample", "contig", "pos", "strand", "label", (F.col("pos") % 2 == 0).alias("is_cpg")).distinct()
    scores = at_site.groupBy("sample", "model", "contig", "pos", "strand").agg(F.sum(F.col("v") * (2 + F.col("label"))).alias("sum_p"))
    present = li.select("sample", "model").distinct().where("NOT (sample % 13 = 5 AND model = 'm2')")
    at = lambda names, m: F.get(F.array(*map(F.lit, names)), (F.col("row") % m).cast("int"))
    rows = li.select("row").distinct().select("row", at(CHEM, 5).alias("chem"), at(CONTEXT, 3).alias("context"), F.array(F.col("row") * 2, F.col("row") * 2 + 1).alias("samples"))
    nulls = rows.select("row", F.when(F.col("row") % 5 != 4, F.col("row") * 37 % 100 / 100).alias("null_auroc"))
    return rows, s.createDataFrame(MODELS, "model string, family string, marks array<string>, context string"), sites, scores, present, nulls


def cells(s, d):
    rows, models, sites, scores, present, nulls = inputs(s, d)
    return T.with_null(T.benchmark_cells(rows, models, sites, scores, present, K), nulls, HIGH, 0.5)


TABLE = 'SELECT c."row", "column", models, {0}status, round(auroc, 6) AS auroc, coalesce(n, 0) AS n, null_auroc, coalesce(null_auroc >= 0.6, false) AS high_null FROM cells c JOIN nul ON nul."row" = c."row" WHERE kind = \'{1}\''


@q("matched_table", f"WITH {CELLS} {TABLE.format('cpg_only, ', 'matched')}")
def matched_table(s, d):
    return cells(s, d).where("kind = 'matched'").select("row", "column", "models", "cpg_only", "status", *r6("auroc"), F.coalesce("n", F.lit(0)).alias("n"), "null_auroc", "high_null")


@q("agnostic_table", f"WITH {CELLS} {TABLE.format('', 'agnostic')}")
def agnostic_table(s, d):
    return cells(s, d).where("kind = 'agnostic'").select("row", "column", "models", "status", *r6("auroc"), F.coalesce("n", F.lit(0)).alias("n"), "null_auroc", "high_null")


@q("models_table", f"WITH {CELLS} {TABLE.format('own, ', 'models')}")
def models_table(s, d):
    return cells(s, d).where("kind = 'models'").select("row", "column", "models", "own", "status", *r6("auroc"), F.coalesce("n", F.lit(0)).alias("n"), "null_auroc", "high_null")


@q("matched_means", f"WITH {CELLS} SELECT \"column\", round(avg(auroc), 6) AS mean, count(auroc) AS n_scored, count(*) AS n_rows FROM cells WHERE kind = 'matched' GROUP BY ALL")
def matched_means(s, d):
    return T.matched_means(cells(s, d)).select("column", *r6("mean"), "n_scored", "n_rows")


@q("agnostic_means", f"WITH {CELLS} SELECT \"column\", CASE WHEN count(*) FILTER (status = 'pending') = 0 THEN round(avg(auroc), 6) END AS mean, CASE WHEN count(*) FILTER (status = 'pending' AND null_auroc < 0.5) = 0 THEN round(avg(auroc) FILTER (null_auroc < 0.5), 6) END AS mean_clean FROM cells c JOIN nul ON nul.\"row\" = c.\"row\" WHERE kind = 'agnostic' GROUP BY ALL")
def agnostic_means(s, d):
    return T.agnostic_means(cells(s, d)).select("column", *r6("mean", "mean_clean"))


@q("model_means", f"WITH {CELLS} SELECT \"column\", CASE WHEN count(*) FILTER (status = 'pending') = 0 THEN round(avg(auroc), 6) END AS mean, CASE WHEN count(*) FILTER (status = 'pending' AND own) = 0 THEN round(avg(auroc) FILTER (own), 6) END AS mean_own, CASE WHEN count(*) FILTER (status = 'pending') = 0 THEN CAST(count(*) FILTER (auroc >= 0.55) AS DOUBLE) END AS n_good FROM cells WHERE kind = 'models' GROUP BY ALL")
def model_means(s, d):
    return T.model_means(cells(s, d), GOOD).select("column", *r6("mean", "mean_own"), F.col("n_good").cast("double").alias("n_good"))


POOLED = INPUTS + """
num AS (SELECT *, row_number() OVER (PARTITION BY "row", label ORDER BY md5('0:' || sample || ':' || contig || ':' || pos || ':' || strand)) AS rn FROM site),
best AS (SELECT u."column", s.sample, s.contig, s.pos, s.strand, s.label, max(coalesce(sum_p, 0)) / 20 AS score
  FROM num s JOIN use u ON u."row" = s."row" LEFT JOIN sc ON sc.model = u.model AND sc.sample = s.sample AND sc.contig = s.contig AND sc.pos = s.pos AND sc.strand = s.strand WHERE rn <= 1000 AND kind = 'agnostic' GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY "column" ORDER BY score) + (count(*) OVER (PARTITION BY "column", score) - 1) / 2.0 AS r FROM best),
au AS (SELECT "column", count(*) AS n, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0) AS auroc FROM rk GROUP BY ALL),
l AS (SELECT "column", bool_or(late) AS late FROM cell WHERE kind = 'agnostic' GROUP BY ALL)
"""


@q("pooled_auroc", f"WITH {POOLED} SELECT \"column\", CASE WHEN NOT late THEN round(auroc, 6) END AS auroc, n FROM l LEFT JOIN au USING (\"column\")")
def pooled_auroc(s, d):
    rows, models, sites, scores, present, _ = inputs(s, d)
    return T.pooled_auroc(rows, models, sites, scores, present, K).select("column", *r6("auroc"), "n")


LEFT = CELLS + """, m AS (SELECT "row", "column" AS model, own, auroc, family FROM cells JOIN mdl ON model = "column" WHERE kind = 'models' AND auroc IS NOT NULL),
a AS (SELECT "row", auroc AS inside, CASE WHEN "row" % 4 = 0 THEN 'm1' WHEN "row" % 4 = 1 THEN 'm2' ELSE 'm0' END AS checkpoint FROM m WHERE model = 'm0'),
b AS (SELECT "row", model AS specialist, auroc AS specialist_auroc, row_number() OVER (PARTITION BY "row" ORDER BY auroc DESC, model) AS k FROM m WHERE own AND family <> 'A')
"""


@q("leaveout_rows", f"WITH {LEFT} SELECT a.\"row\", checkpoint, round(inside, 6) AS inside, round(m.auroc, 6) AS outside, round(inside - m.auroc, 6) AS loss, specialist, round(specialist_auroc, 6) AS specialist_auroc FROM a LEFT JOIN m ON m.\"row\" = a.\"row\" AND m.model = checkpoint LEFT JOIN b ON b.\"row\" = a.\"row\" AND k = 1")
def leaveout_rows(s, d):
    c, r = cells(s, d), F.col("row") % 4
    held = c.select("row", F.when(r == 0, "m1").when(r == 1, "m2").alias("model")).where("model IS NOT NULL").distinct()
    models = s.createDataFrame(MODELS, "model string, family string, marks array<string>, context string")
    return T.leaveout_rows(c, "m0", held, models).select("row", "checkpoint", *r6("inside", "outside", "loss"), "specialist", *r6("specialist_auroc"))


@q("paper_table", f"WITH {CELLS} SELECT kind, c.\"row\", \"column\", status, round(auroc, 6) AS auroc, coalesce(null_auroc >= 0.6, false) AS high_null, coalesce(null_auroc < 0.5, false) AS low_null FROM cells c JOIN nul ON nul.\"row\" = c.\"row\"")
def paper_table(s, d):
    return cells(s, d).select("kind", "row", "column", "status", *r6("auroc"), "high_null", F.col("clean").alias("low_null"))
