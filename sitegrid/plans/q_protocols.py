"""Queries: protocols of evaluation and kinetic rows, over all line items and sequences."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from sitegrid.functions import seq as Q
from sitegrid.operators import kinetics as N
from sitegrid.operators import protocols as P
from sitegrid.plans.core import SCORES, q, r6, scores, seqs, t

SITE = ["contig", "pos", "strand"]


@q("split_contigs", f"WITH {SCORES}, g AS (SELECT contig, max(label) AS y FROM scores GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('3:' || contig)) AS rn, count(*) OVER (PARTITION BY y) AS n FROM g), z AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.2, 0)) ELSE round_even(n * 0.2, 0) END AS a, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.1, 0)) ELSE round_even(n * 0.1, 0) END AS b FROM k), p AS (SELECT contig, CASE WHEN rn <= a THEN 'test' WHEN rn <= a + b THEN 'val' ELSE 'train' END AS split FROM z) SELECT split, count(DISTINCT contig) AS n_groups, count(DISTINCT (contig, pos)) AS n_positions, count(*) AS n_rows FROM scores JOIN p USING (contig) GROUP BY split")
def split_contigs(s, d):
    return P.split_counts(P.split_contigs(scores(s, d), ["contig"], 0.1, 0.2, 3), ["contig"], ["contig", "pos"])


FEW = f"""WITH {SCORES}, b AS (SELECT contig % 3 = 0 AS held, contig, pos, strand, label FROM scores),
h AS (SELECT *, substr(md5('fs_support:' || contig || ':' || pos), 1, 8) < '80000000' AS half FROM b WHERE held),
g AS (SELECT contig, pos, strand, max(label) AS y FROM h WHERE half GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('fsrank:2:' || contig || ':' || pos || ':' || strand)) AS rn FROM g),
shot AS (SELECT h.* FROM h JOIN r ON h.contig = r.contig AND h.pos = r.pos AND h.strand = r.strand WHERE half AND rn <= 10),
o AS (SELECT contig, pos, strand, label, substr(md5('fs_replayval:' || contig || ':' || pos), 1, 8) < '1999999a' AS val FROM b WHERE NOT held),
k AS (SELECT *, row_number() OVER (PARTITION BY val ORDER BY md5('1002:' || contig || ':' || pos || ':' || strand)) AS rn FROM o),
m AS (SELECT least(50, greatest(1, CAST(round_even(0.25 * (SELECT count(*) FROM k WHERE NOT val AND rn <= 600) / (SELECT count(*) FROM shot), 0) AS INT))) AS times)
SELECT contig, pos, strand, label, 'query' AS role, 1 AS copy FROM h WHERE NOT half UNION ALL SELECT contig, pos, strand, label, 'shot', CAST(unnest(range(1, times + 1)) AS INT) FROM shot, m
UNION ALL SELECT contig, pos, strand, label, CASE WHEN val THEN 'replay_val' ELSE 'replay' END, 1 FROM k WHERE rn <= CASE WHEN val THEN 100 ELSE 600 END"""


@q("few_shot_replay", FEW)
def few_shot_replay(s, d):
    x = scores(s, d).select(*SITE, "label")
    held = F.col("contig") % 3 == 0
    return P.few_shot(x.where(held), x.where(~held), 10, ["contig", "pos"], ["strand"], replay=600, seed=2).select(*SITE, "label", "role", "copy")


LODO = f"""WITH {SCORES}, d AS (SELECT contig % 4 AS fold, label, score FROM scores), c AS (SELECT fold, score, sum(label) AS p, count(*) - sum(label) AS n FROM d WHERE fold < 3 GROUP BY ALL),
u AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY fold) AS pos FROM c WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
th AS (SELECT fold, arg_max(score, (round(2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos + 1e-8), 12), -score)) AS threshold FROM u GROUP BY fold),
x AS (SELECT 'LODO' AS model, CAST(d.fold AS VARCHAR) AS held_out, threshold, '' AS notes, label, CAST(score >= threshold AS INT) AS z FROM d JOIN th USING (fold)
  UNION ALL SELECT 'Base', 'all (stratified split)', 0.02, '', label, CAST(score >= 0.02 AS INT) FROM d WHERE fold = 3
  UNION ALL SELECT 'ZeroR', 'base test set', NULL, 'majority=' || m, label, m FROM d, (SELECT CAST(2 * sum(label) > count(*) AS INT) AS m FROM d WHERE fold < 3) WHERE fold = 3),
k AS (SELECT model, held_out, threshold, notes, count(*) FILTER (label = 1 AND z = 1) AS tp, count(*) FILTER (label = 0 AND z = 1) AS fp, count(*) FILTER (label = 1 AND z = 0) AS fn, count(*) FILTER (label = 0 AND z = 0) AS tn FROM x GROUP BY ALL)
SELECT model, held_out, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_label1, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_label1, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_label1, tp + fn AS support_label1,
round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS precision_label0, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS recall_label0, round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS f1_label0, tn + fp AS support_label0,
round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1, round(threshold, 6) AS threshold, tp + fp + fn + tn AS n_test, notes FROM k"""


@q("lodo_table", LODO)
def lodo_table(s, d):
    x = scores(s, d).select((F.col("contig") % 4).alias("fold"), "label", "score")
    m = P.lodo_table(x.where("fold = 3"), x.where("fold < 3"), x.where("fold < 3"), 0.02)
    return m.select("model", "held_out", *r6("precision_label1", "recall_label1", "f1_label1"), "support_label1", *r6("precision_label0", "recall_label0", "f1_label0"), "support_label0", *r6("macro_f1", "threshold"), "n_test", "notes")


CHEM = """c AS (SELECT 'd' || (l_suppkey % 6) AS dataset, l_suppkey AS contig, l_partkey AS pos, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_linenumber % 3 AS k, CAST(max(l_quantity) AS INT) AS cov, max(round(l_discount * 1000)) AS pct FROM lineitem GROUP BY ALL),
s AS (SELECT * FROM c WHERE cov >= 10 AND pct >= 40), mk(dataset, m, six) AS (VALUES ('d0', ['4mC', '5mC'], true), ('d1', CAST([] AS VARCHAR[]), false), ('d2', ['4mC'], true), ('d3', ['5mC'], false), ('d4', ['4mC', '5mC'], false)),
j AS (SELECT dataset, contig, pos, strand, bool_or(k = 0) AS a, bool_or(k = 1) AS b FROM s WHERE k < 2 GROUP BY ALL),
m AS (SELECT j.dataset, contig, pos, strand, CASE WHEN a AND NOT b AND list_contains(m, '4mC') THEN '4mC' WHEN b AND NOT a AND list_contains(m, '5mC') THEN '5mC' WHEN a AND b AND len(m) = 1 THEN m[1] ELSE 'untyped' END AS chem FROM j LEFT JOIN mk ON mk.dataset = j.dataset
  UNION ALL SELECT s.dataset, contig, pos, strand, '6mA' FROM s JOIN mk ON mk.dataset = s.dataset AND six WHERE k = 2)"""


def chem_inputs(s, d):
    c = t(s, d, "lineitem").groupBy(F.concat(F.lit("d"), (F.col("l_suppkey") % 6).cast("string")).alias("dataset"), F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), (F.col("l_linenumber") % 3).alias("k")).agg(F.max("l_quantity").cast("int").alias("cov"), F.max(F.round(F.col("l_discount") * 1000)).alias("pct"))
    marks = s.createDataFrame([("d0", ["4mC", "5mC"], True), ("d1", [], False), ("d2", ["4mC"], True), ("d3", ["5mC"], False), ("d4", ["4mC", "5mC"], False)], "dataset string, c_marks array<string>, has_6ma boolean")
    return P.chem_map(c.where("k = 0"), c.where("k = 1"), c.where("k = 2"), marks, 10, 40.0), marks


@q("chem_map", f"WITH {CHEM} SELECT * FROM m")
def chem_map(s, d):
    return chem_inputs(s, d)[0]


@q("chem_counts", f"WITH {CHEM} SELECT mk.dataset, e.chem, count(m.chem) AS n FROM mk CROSS JOIN (SELECT unnest(['6mA', '4mC', '5mC', 'untyped']) AS chem) e LEFT JOIN m ON m.dataset = mk.dataset AND m.chem = e.chem GROUP BY ALL")
def chem_counts(s, d):
    return P.chem_counts(*chem_inputs(s, d))


def kinetics(s, d):
    """Calls at nearly all sites of GATC's A and of TCA's A, and here and there elsewhere."""
    r = seqs(s, d).persist(StorageLevel.DISK_ONLY)  # cut out of the texts once
    cx = Q.base_contexts(r, "A", 3)
    h = F.pmod(F.col("pos") * 31 + F.col("contig") * 17, F.lit(97))
    motif = F.substring("context", 3, 4).isin("GATC") | (F.substring("context", 2, 4) == "TCAA")
    called = F.when(motif, h < 94).otherwise(h < 1)
    calls = cx.where(called).select(*SITE, F.when(h == 0, "other").otherwise("m6A").alias("type"))
    cov = cx.select(*SITE, (h % 41).cast("int").alias("cov"))
    return N.kinetics_rows(r, calls, cov, "m6A", "A", skip=("TC[A]A",), least=20)


@q("kinetics_discovered", None)
def kinetics_discovered(s, d):
    return kinetics(s, d)[0]


@q("kinetics_motifs", None)
def kinetics_motifs(s, d):
    return kinetics(s, d)[1].select("motif", "kmer", "offset", "occurrences", *r6("rate"), "explained", "used")
