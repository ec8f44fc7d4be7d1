"""Images of candidate sites. Documents are contigs, orders are reads of their customer's contig, whose signal is the customer's
events in order; reads without events have no signal. Levels are eighths, so that float32 holds them exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrid.operators import images as I
from sitegrid.plans.core import SEQS, q, seqs, t
from sitegrid.plans.q_ml import reads_with_signal

SUMS = {"dwell": (1, "reads"), "n_a": (2, "reads"), "n_c": (3, "reads"), "n_g": (4, "reads"), "n_t": (5, "reads"), "strands": (6, "reads"), "mapqs": (7, "reads"), "matches": (8, "reads"), "levels": (0, "reference"), "ref_a": (2, "reference"), "ref_t": (5, "reference")}


def inputs(s, d):
    _, peaks, sig = reads_with_signal(s, d)
    ref = seqs(s, d).repartition("contig")  # a sequence is made once, not anew for each read beside it
    o = F.col("o_orderkey")
    a = t(s, d, "orders").select(o.alias("read_id"), F.col("o_custkey").alias("contig"), ((o * 37) % 200).alias("start"), ((o * 37) % 200 + 10 + o % 40).alias("end"), (o % 61).alias("mapq"), F.when(o % 2 == 0, "+").otherwise("-").alias("strand"), F.when(o % 9 == 0, 256).otherwise((16 * (o % 2)).cast("int")).alias("flag"), (o % 3).cast("int").alias("hp"))
    own = F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    a = a.join(ref, "contig").withColumn("bases", F.when(F.col("read_id") % 5 == 0, F.translate(own, "A", "C")).otherwise(own)).drop("seq")
    li = t(s, d, "lineitem")
    sites = li.select(F.col("l_suppkey").alias("contig"), ((F.col("l_partkey") * 13) % 217).alias("pos"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"))
    p = F.col("p_size") * 4
    shut = t(s, d, "part").select(F.col("p_partkey").alias("contig"), p.cast("long").alias("start"), (p + 3).cast("long").alias("end"))
    kmer = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]
    levels = s.createDataFrame([(x, (k * 37 % 64) / 8) for k, x in enumerate(kmer) if x != "AAA"], "kmer string, level double")
    return a, peaks, sig, sites, ref, levels, shut


# reads that reach a site with usable segments, in seeded order, dealt into images of three; windows of five, two points a base
IMAGES = rf"""
WITH {SEQS}, n AS (SELECT user_id, count(*) // 4 AS segs FROM events GROUP BY ALL),
r AS (SELECT o_orderkey AS read_id, o_custkey AS contig, (o_orderkey * 37) % 200 AS s, (o_orderkey * 37) % 200 + 10 + o_orderkey % 40 AS e, o_orderkey % 61 AS mapq,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, least(segs, 10 + o_orderkey % 40) AS m, seq FROM orders JOIN n ON user_id = o_custkey JOIN seqs ON seqs.contig = o_custkey WHERE o_orderkey % 9 <> 0 AND o_orderkey % 61 >= 5),
shut AS (SELECT p_partkey AS contig, p_size * 4 AS a, p_size * 4 + 3 AS b FROM part),
k AS (SELECT *, CASE WHEN strand = '+' THEN s ELSE e - m END AS lo, CASE WHEN strand = '+' THEN s + m ELSE e END AS hi FROM r WHERE m > 0 AND NOT EXISTS (SELECT 1 FROM shut WHERE shut.contig = r.contig AND a < e AND s < b)),
c AS (SELECT DISTINCT l_suppkey AS contig, (l_partkey * 13) % 217 AS pos, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem),
site AS (SELECT c.*, seq FROM c JOIN seqs USING (contig) WHERE pos < length(seq) AND substr(seq, CAST(pos AS INT) + 1, 1) IN ('A', 'C', 'T') AND NOT EXISTS (SELECT 1 FROM shut WHERE shut.contig = c.contig AND pos >= a AND pos < b)),
p AS (SELECT site.contig, pos, strand, read_id, lo, hi, s, e, mapq, site.seq, count(*) OVER w AS nr, row_number() OVER (w ORDER BY md5('0:' || read_id), CAST(read_id AS VARCHAR)) AS rn
  FROM site JOIN k USING (contig, strand) WHERE pos >= lo AND pos < hi WINDOW w AS (PARTITION BY site.contig, pos, strand)),
im AS (SELECT *, CAST((rn - 1) // 3 AS INT) AS image_idx FROM p WHERE nr >= 2 AND (rn - 1) // 3 < least(2, greatest(1, nr // 3))),
cell AS (SELECT im.*, x, substr(seq, CAST(x AS INT) + 1, 1) AS ref_base, CASE WHEN read_id % 5 = 0 THEN translate(substr(seq, CAST(x AS INT) + 1, 1), 'A', 'C') ELSE substr(seq, CAST(x AS INT) + 1, 1) END AS base
  FROM im, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) JOIN (SELECT unnest(range(-2, 250)) AS x) ON x = pos + o WHERE x >= lo AND x < hi),
reads AS (SELECT contig, pos, strand, image_idx, 2 * 4 * count(*) AS dwell, 2 * count(*) FILTER (base = 'A') AS n_a, 2 * count(*) FILTER (base = 'C') AS n_c, 2 * count(*) FILTER (base = 'G') AS n_g, 2 * count(*) FILTER (base = 'T') AS n_t,
  2 * sum(CASE WHEN strand = '+' THEN 1 ELSE -1 END) AS strands, 2 * sum(least(mapq, 60)) AS mapqs, 2 * count(*) FILTER (base = ref_base AND base <> '') AS matches FROM cell GROUP BY ALL),
heads AS (SELECT contig, pos, strand, image_idx, count(*) AS n_reads, any_value(seq) AS seq FROM im GROUP BY ALL),
win AS (SELECT heads.*, CAST(pos + o AS INT) AS x FROM heads, (SELECT unnest([-2, -1, 0, 1, 2]) AS o)),
lev AS (SELECT *, CASE WHEN x >= 0 THEN substr(seq, x + 1, 1) ELSE '' END AS b, CASE WHEN x >= 1 THEN substr(seq, x, 3) ELSE '' END AS kmer FROM win),
refs AS (SELECT contig, pos, strand, image_idx, any_value(n_reads) AS n_reads, 2 * count(*) FILTER (b = 'A') AS ref_a, 2 * count(*) FILTER (b = 'T') AS ref_t,
  2 * sum(CASE WHEN length(kmer) = 3 AND kmer <> 'AAA' THEN (((instr('ACGT', kmer[1]) - 1) * 16 + (instr('ACGT', kmer[2]) - 1) * 4 + instr('ACGT', kmer[3]) - 1) * 37 % 64) / 8 ELSE 0 END) AS levels FROM lev GROUP BY contig, pos, strand, image_idx)
SELECT contig, pos, strand, image_idx, n_reads, CAST(dwell AS DOUBLE) AS dwell, CAST(n_a AS DOUBLE) AS n_a, CAST(n_c AS DOUBLE) AS n_c, CAST(n_g AS DOUBLE) AS n_g, CAST(n_t AS DOUBLE) AS n_t, CAST(strands AS DOUBLE) AS strands,
CAST(mapqs AS DOUBLE) AS mapqs, CAST(matches AS DOUBLE) AS matches, CAST(levels AS DOUBLE) AS levels, CAST(ref_a AS DOUBLE) AS ref_a, CAST(ref_t AS DOUBLE) AS ref_t FROM refs JOIN reads USING (contig, pos, strand, image_idx)
"""


@q("pileup_images", IMAGES)
def pileup_images(s, d):
    a, peaks, sig, sites, ref, levels, shut = inputs(s, d)
    im = I.pileup_images(a, peaks, sig, sites, ref, levels, center=1, half_window=2, samples=2, max_reads=3, max_images=2, min_reads=2, min_mapq=5, target="ACT", exclude=shut)
    return I.channel_sums(im, SUMS)
