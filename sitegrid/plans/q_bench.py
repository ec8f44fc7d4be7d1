"""Queries: benchmark rows, on all positions of the sequences."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from sitegrid.operators import rows as B
from sitegrid.plans.core import SCORES, SEQS, q, r6, scores, seqs
from sitegrid.plans.q_calls import SEEN, seen

POS = "p AS (SELECT contig, n, pos, substr(seq, pos + 1, 1) AS b FROM (SELECT contig, seq, length(seq) AS n, unnest(range(0, length(seq))) AS pos FROM seqs))"
SITES = "s AS (SELECT contig, pos, CASE WHEN b = 'A' THEN '+' ELSE '-' END AS strand FROM p WHERE (b = 'A' AND pos < n * 8 // 10) OR (b = 'T' AND pos < n // 2))"


def kept(s, d):
    """Sequences, cut out of the texts once for all that a query takes from them."""
    return seqs(s, d).persist(StorageLevel.DISK_ONLY)


def positions(r):
    n = F.length("seq")
    return r.where(n > 0).select("contig", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1).cast("array<bigint>")).alias("pos"))


def spans(r):
    n = F.length("seq")
    part = lambda strand, end: F.struct(F.lit(strand).alias("strand"), F.lit(0).cast("long").alias("start"), end.cast("long").alias("end"))
    return r.select("contig", F.explode(F.array(part("+", F.floor(n * 8 / 10)), part("-", F.floor(n / 2)))).alias("x")).select("contig", "x.*")


@q("row_sites_one", f"WITH {SEQS}, {POS}, {SITES}, {SEEN}, l AS (SELECT *, CASE WHEN pos % 7 = 0 THEN 1 ELSE 0 END AS label FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || contig || ':' || pos || ':' || strand)) AS rn FROM l) SELECT contig, pos, strand, label FROM k WHERE (label = 1 OR rn <= 2000) AND (contig, pos) NOT IN (SELECT (contig, pos) FROM seen)")
def row_sites_one(s, d):
    r = kept(s, d)
    p = positions(r).select("contig", "pos")
    return B.row_sites_one(p.where("pos % 7 = 0"), p, r, "A", spans(r), 2000, 5, seen(s, d)).select("contig", "pos", "strand", "label")


@q("row_sites_two", f"WITH {SEQS}, {POS}, {SITES}, {SEEN} SELECT contig, pos, strand, CASE WHEN contig % 2 = 0 THEN 1 ELSE 0 END AS label FROM s WHERE (contig, pos) NOT IN (SELECT (contig, pos) FROM seen)")
def row_sites_two(s, d):
    r = kept(s, d)
    p = positions(r).select("contig", "pos")
    return B.row_sites_two(p.where("contig % 2 = 0"), p.where("contig % 2 = 1"), r, "A", spans(r), spans(r), seen(s, d)).select("contig", "pos", "strand", "label")


@q("bisulfite_rows", f"WITH {SEQS}, {POS}, c AS (SELECT *, pos * 7 % 23 AS m, pos * 5 % 11 AS u FROM p WHERE pos % 3 = 0 AND pos < n * 8 // 10), l AS (SELECT *, m / (m + u) AS frac FROM c WHERE m + u >= 10) SELECT contig, pos, CASE WHEN frac >= 0.9 THEN 1 ELSE 0 END AS label, CASE WHEN b IN ('C', 'G') THEN 1 ELSE 0 END AS n_c_or_g FROM l WHERE frac >= 0.9 OR frac <= 0.1")
def bisulfite_rows(s, d):
    k, r = F.col("pos") % 3, kept(s, d)
    counts = positions(r).select("contig", "pos", F.when(k == 0, "CG").when(k == 1, "CHG").otherwise("CHH").alias("context"), (F.col("pos") * 7 % 23).alias("n_meth"), (F.col("pos") * 5 % 11).alias("n_unmeth"))
    return B.bisulfite_rows(B.on_contigs(counts, r), spans(r), r, "cpg")


@q("matched_sites", f"WITH {SCORES}, m AS (SELECT contig % 5 AS g, pos FROM scores GROUP BY ALL HAVING count(DISTINCT label) = 2) SELECT contig, pos, strand, label FROM scores WHERE (contig % 5, pos) IN (SELECT (g, pos) FROM m)")
def matched_sites(s, d):
    return B.matched_sites(scores(s, d).withColumn("g", F.col("contig") % 5), "g", ["pos"]).select("contig", "pos", "strand", "label")


@q("best_over_models", "WITH c AS (SELECT l_suppkey AS contig, l_partkey AS pos, l_returnflag AS model, max(l_discount) AS v FROM lineitem GROUP BY ALL), r AS (SELECT *, (rank() OVER (PARTITION BY model ORDER BY v) - 1 + (count(*) OVER (PARTITION BY model, v) + 1) / 2.0) / count(*) OVER (PARTITION BY model) AS cal FROM c) SELECT contig, pos, round(max(cal), 6) AS calibrated FROM r GROUP BY ALL")
def best_over_models(s, d):
    from sitegrid.operators import ranking
    from sitegrid.plans.core import t

    c = t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("model")).agg(F.max("l_discount").alias("v"))
    return B.best_over_models(ranking.rank_calibrate(c, "v", ["model"]), ["contig", "pos"]).select("contig", "pos", *r6("calibrated"))
