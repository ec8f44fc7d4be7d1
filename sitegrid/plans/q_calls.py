"""Queries: calls to sites, aggregates, windows of reads, range joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrid.operators import aggregate as A
from sitegrid.operators import labels as L
from sitegrid.operators import ranges as R
from sitegrid.operators import reads as W
from sitegrid.plans.core import ALN, CALLS, IV, METHYL, ONE, SCORES, SITES, TRACK, aln, calls, intervals, methyl, q, r6, scores, sites, t, track

SITE = ["contig", "pos", "strand"]


@q("aggregate_calls", f"WITH {CALLS}, {ONE} SELECT contig, pos, strand, count(*) AS n_called, round(sum(p), 6) AS sum_p, count(*) FILTER (p > 0.5) AS n_mod FROM one GROUP BY ALL")
def aggregate_calls(s, d):
    return A.aggregate_calls(calls(s, d)).select(*SITE, "n_called", *r6("sum_p"), "n_mod")


@q("aggregate_sites", f"WITH {CALLS} SELECT contig, pos, strand, max(read_id) AS n_called, round(max(prob) * 20, 6) AS sum_p, CASE WHEN max(prob) >= 0.5 THEN 20 ELSE 0 END AS n_mod FROM calls GROUP BY ALL")
def aggregate_sites(s, d):
    return A.aggregate_sites(calls(s, d).select(*SITE, F.col("prob").alias("score"), F.col("read_id").alias("n_reads")), 20).select(*SITE, "n_called", *r6("sum_p"), "n_mod")


@q("aggregate_by_position", f"WITH {CALLS} SELECT contig, pos, max(label) AS label, round(avg(prob), 6) AS prob FROM calls GROUP BY ALL")
def aggregate_by_position(s, d):
    return A.aggregate_by_position(calls(s, d), ["contig", "pos"]).select("contig", "pos", "label", *r6("prob"))


def bedmethyl(s, d):
    li = t(s, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos"), F.lower("l_returnflag").alias("code"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), F.col("l_quantity").cast("long").alias("cov"), F.col("l_discount").alias("frac"), F.col("l_linenumber").alias("file_ord"), F.col("l_orderkey").alias("line"))


BED = "bed AS (SELECT l_suppkey AS contig, l_partkey AS pos, lower(l_returnflag) AS code, CASE WHEN l_linestatus='O' THEN '+' ELSE '-' END AS strand, CAST(l_quantity AS BIGINT) AS cov, l_discount AS frac, l_linenumber AS file_ord, l_orderkey AS line FROM lineitem)"


@q("max_over_codes", f"WITH {BED} SELECT contig, pos, max(cov) AS cov, max(frac) AS frac FROM bed WHERE strand = '+' GROUP BY ALL")
def max_over_codes(s, d):
    return A.max_over_codes(bedmethyl(s, d))


@q("dominant_code", f"WITH {BED} SELECT contig, pos, code FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY frac DESC, file_ord, line) AS rn FROM bed WHERE cov >= 10) WHERE rn = 1")
def dominant_code(s, d):
    return A.dominant_code(bedmethyl(s, d), 10)


@q("window_track", f"WITH {TRACK} SELECT contig, pos // 60 AS win, round(avg(score), 6) AS score, round(avg(contig), 6) AS covg, count(*) AS n, (pos // 60) * 60 AS \"start\" FROM track GROUP BY contig, pos // 60 HAVING count(*) >= 2")
def window_track(s, d):
    tr = track(s, d).withColumn("n_reads", F.col("contig"))
    return A.window_track(tr, 60, ["score"], 2).select("contig", "win", *r6("score", "covg"), "n", "start")


@q("track_reference", f"WITH {TRACK}, w AS (SELECT contig, pos // 60 AS win, avg(score) AS score, count(*) AS covg FROM track GROUP BY ALL) SELECT round(median(score), 6) AS median, round(quantile_cont(covg, 0.999), 6) AS covg_q FROM w")
def track_reference(s, d):
    w = track(s, d).groupBy("contig", F.floor(F.col("pos") / 60).alias("win")).agg(F.avg("score").alias("score"), F.count("*").alias("covg"))
    return A.track_reference(w, "score").select(*r6("median", "covg_q"))


@q("box_summary", "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, count(*) AS n FROM lineitem GROUP BY ALL")
def box_summary(s, d):
    b = A.box_summary(t(s, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return b.select("l_returnflag", "l_linestatus", *[F.round(c, 4).alias(c) for c in ("q1", "med", "q3")], "n")


@q("census", "SELECT l_returnflag AS member, l_linestatus AS split, l_linenumber AS label, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
def census(s, d):
    return A.census(t(s, d, "lineitem").select(F.col("l_returnflag").alias("member"), F.col("l_linestatus").alias("split"), F.col("l_linenumber").alias("label")), ["member", "split", "label"])


@q("type_counts", "SELECT coalesce(p_brand, 'untyped_mod') AS type, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey, p_brand FROM part WHERE p_size < 25) ON l_partkey = p_partkey GROUP BY ALL")
def type_counts(s, d):
    types = t(s, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("type"))
    return A.type_counts(calls(s, d), types, ["pos"])


@q("call_rates", f"WITH {SCORES} SELECT contig, strand, round(avg(n_called) / 20, 6) AS call_rate FROM scores GROUP BY ALL")
def call_rates(s, d):
    return A.call_rates(scores(s, d), ["contig", "strand"], 20).select("contig", "strand", *r6("call_rate"))


CELLS = "cells AS (SELECT l_suppkey % 20 AS \"row\", l_returnflag || l_linenumber AS model, l_returnflag AS family, CASE WHEN count(*) % 13 = 0 THEN NULL ELSE round(avg(l_discount) * 10, 6) END AS auroc FROM lineitem GROUP BY ALL)"


def cells(s, d):
    g = t(s, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("row"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("model"), F.col("l_returnflag").alias("family"))
    return g.agg(F.when(F.count("*") % 13 == 0, None).otherwise(F.round(F.avg("l_discount") * 10, 6)).alias("auroc"))


@q("model_summary", f"WITH {CELLS} SELECT model, CASE WHEN count(*) = count(auroc) THEN round(avg(auroc), 6) END AS mean_all, CASE WHEN count(*) FILTER (\"row\" % 3 = 0 AND auroc IS NULL) = 0 THEN round(avg(auroc) FILTER (\"row\" % 3 = 0), 6) END AS mean_own, count(*) FILTER (auroc >= 0.5) AS n_good FROM cells GROUP BY ALL")
def model_summary(s, d):
    return A.model_summary(cells(s, d), F.col("row") % 3 == 0, 0.5).select("model", *r6("mean_all", "mean_own"), "n_good")


@q("pivot_models", f"WITH {CELLS} SELECT \"row\", max(auroc) FILTER (model = 'A1') AS \"A1\", max(auroc) FILTER (model = 'N2') AS \"N2\", max(auroc) FILTER (model = 'R3') AS \"R3\" FROM cells GROUP BY ALL")
def pivot_models(s, d):
    return A.pivot_models(cells(s, d), ["A1", "N2", "R3"])


@q("class_weights", f"WITH {CALLS}, c AS (SELECT CAST(sum(label) AS BIGINT) AS p, count(*) AS n FROM calls) SELECT p AS n_pos, n - p AS n_neg, round((n - p) / p, 6) AS pos_weight, round(n / (2 * p), 6) AS w_pos, round(n / (2 * (n - p)), 6) AS w_neg FROM c")
def class_weights(s, d):
    return A.class_weights(calls(s, d), "label").select("n_pos", "n_neg", *r6("pos_weight", "w_pos", "w_neg"))


@q("call_rate_panel", f"WITH {SCORES} SELECT contig, round(avg(CASE WHEN score >= 0.02 THEN 1 ELSE 0 END) FILTER (label = 0), 6) AS fpr, round(avg(CASE WHEN score >= 0.02 THEN 1 ELSE 0 END) FILTER (label = 1), 6) AS recall FROM scores GROUP BY ALL")
def call_rate_panel(s, d):
    return A.call_rate_panel(scores(s, d).withColumn("pred", (F.col("score") >= 0.02).cast("int")), ["contig"]).select("contig", *r6("fpr", "recall"))


@q("methyl_counts", "WITH l AS (SELECT doc_id % 10 AS contig, doc_id % 100 AS st, regexp_replace(text, '[^zxhZXH.]', '', 'g') AS xm FROM documents), e AS (SELECT contig, st, xm, unnest(range(length(xm))) AS i FROM l) SELECT contig, st + i AS pos, count(*) FILTER (substr(xm, i + 1, 1) IN ('Z','X','H')) AS n_meth, count(*) FILTER (substr(xm, i + 1, 1) IN ('z','x','h')) AS n_unmeth FROM e WHERE substr(xm, i + 1, 1) <> '.' GROUP BY ALL")
def methyl_counts(s, d):
    x = t(s, d, "documents").select((F.col("doc_id") % 10).alias("contig"), (F.col("doc_id") % 100).alias("start"), F.regexp_replace("text", "[^zxhZXH.]", "").alias("xm"))
    return A.methyl_counts(x)


# reads


@q("primary_reads", f"WITH {ALN} SELECT read_id, mapq, strand, qs FROM aln WHERE flag & 2308 = 0 AND mapq >= 20 AND qs >= 5 AND strand = '+'")
def primary_reads(s, d):
    return W.strand_only(W.min_quality(W.primary(aln(s, d)), 20, 5.0), "+").select("read_id", "mapq", "strand", "qs")


@q("select_reads", f"WITH {ALN}, {SITES}, cov AS (SELECT DISTINCT read_id, s.contig, pos, s.strand FROM aln a JOIN sites s ON a.contig = s.contig AND a.strand = s.strand AND pos >= \"start\" AND pos < \"end\"), r AS (SELECT *, row_number() OVER (PARTITION BY contig, pos, strand ORDER BY md5('7:' || read_id), CAST(read_id AS VARCHAR)) AS rank FROM cov) SELECT * FROM r WHERE rank <= 3")
def select_reads(s, d):
    return W.select_covering(aln(s, d), sites(s, d), 3, 7)


@q("to_intervals", f"WITH {SITES}, p AS (SELECT DISTINCT contig, pos FROM (SELECT contig, pos // 2 AS pos FROM sites)), g AS (SELECT *, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS run FROM p) SELECT contig, min(pos) AS \"start\", max(pos) + 1 AS \"end\" FROM g GROUP BY contig, run")
def to_intervals(s, d):
    return R.to_intervals(sites(s, d).withColumn("pos", F.floor(F.col("pos") / 2)), ["contig"])


PAIRS = f"{ALN}, {SITES}, cov AS (SELECT DISTINCT read_id, s.contig, pos, s.strand FROM aln a JOIN sites s ON a.contig = s.contig AND a.strand = s.strand AND pos >= \"start\" AND pos < \"end\")"


@q("partition_reads", f"WITH {PAIRS}, r AS (SELECT *, count(*) OVER (PARTITION BY contig, pos, strand) AS n, row_number() OVER (PARTITION BY contig, pos, strand ORDER BY md5('3:' || read_id), CAST(read_id AS VARCHAR)) AS rn FROM cov) SELECT read_id, contig, pos, strand, CAST((rn - 1) // 2 AS INTEGER) AS image_idx FROM r WHERE (rn - 1) // 2 < least(4, greatest(1, n // 2))")
def partition_reads(s, d):
    return W.partition_covering(aln(s, d), sites(s, d), 2, 4, 3)


@q("order_rows", f"WITH {PAIRS} SELECT contig, pos, strand, string_agg(CAST(read_id AS VARCHAR), ',' ORDER BY read_id % 3, pos, CAST(read_id AS VARCHAR)) AS names FROM cov GROUP BY ALL")
def order_rows(s, d):
    a = aln(s, d).withColumn("hp", (F.col("read_id") % 3).cast("int"))
    return W.order_covering(a, sites(s, d)).select(*SITE, F.array_join("rows.read_id", ",").alias("names"))


@q("cap_reads", f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY contig, pos, strand ORDER BY md5('5:' || read_id), CAST(read_id AS VARCHAR)) AS rn FROM cov) SELECT read_id, contig, pos, strand FROM r WHERE rn <= 2")
def cap_reads(s, d):
    return W.cap_covering(aln(s, d), sites(s, d), 2, 5)


@q("project_calls", f"WITH {ALN} SELECT l_orderkey AS read_id, contig, \"start\" + (CASE WHEN strand = '-' THEN 99 - l_linenumber * 14 ELSE l_linenumber * 14 END) AS pos, count(*) AS n FROM lineitem JOIN aln ON l_orderkey = read_id WHERE (CASE WHEN strand = '-' THEN 99 - l_linenumber * 14 ELSE l_linenumber * 14 END) BETWEEN 0 AND 79 GROUP BY ALL")
def project_calls(s, d):
    blocks = aln(s, d).select("read_id", "contig", F.col("start").alias("ref_start"), F.lit(0).alias("q_start"), F.lit(80).alias("q_end"), F.lit(100).alias("length"), (F.col("strand") == "-").alias("is_reverse"))
    c = t(s, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), (F.col("l_linenumber") * 14).alias("offset"))
    return W.project_calls(c, blocks).groupBy("read_id", "contig", "pos").agg(F.count("*").alias("n"))


@q("label_reads", f"WITH {CALLS}, b AS (SELECT read_id, contig, pos, row_number() OVER (PARTITION BY read_id ORDER BY contig, pos) - 1 AS ordinal FROM (SELECT DISTINCT read_id, contig, pos FROM calls)), s AS (SELECT contig, pos, max(label) AS label FROM calls WHERE pos % 2 = 0 GROUP BY ALL) SELECT read_id, contig, pos, ordinal, label, ordinal - coalesce(lag(ordinal) OVER (PARTITION BY read_id ORDER BY ordinal), -1) - 1 AS skip FROM b JOIN s USING (contig, pos)")
def label_reads(s, d):
    from pyspark.sql import Window

    c = calls(s, d)
    b = c.select("read_id", "contig", "pos").distinct().withColumn("ordinal", (F.row_number().over(Window.partitionBy("read_id").orderBy("contig", "pos")) - 1).cast("long"))
    st = c.where("pos % 2 = 0").groupBy("contig", "pos").agg(F.max("label").alias("label"))
    return W.label_reads(b, st, ["contig", "pos"])


@q("pick_image", f"WITH {SCORES} SELECT contig, pos, strand, n_called AS n_reads FROM scores WHERE label = 1 ORDER BY n_called DESC, contig, pos, strand LIMIT 1")
def pick_image(s, d):
    return W.pick_image(scores(s, d).withColumnsRenamed({"n_called": "n_reads"}).withColumn("image_idx", F.col("strand")), F.col("label") == 1).select(*SITE, "n_reads")


@q("valid_segments", f"WITH {ALN} SELECT read_id, \"start\" - 100 AS \"start\", \"end\" FROM aln WHERE \"start\" - 100 >= 0 AND \"end\" <= 10000")
def valid_segments(s, d):
    return W.valid_segments(aln(s, d).withColumn("start", F.col("start") - 100).withColumn("length", F.lit(10000))).select("read_id", "start", "end")


# ranges


@q("include_regions", f"WITH {SITES}, {IV} SELECT * FROM sites s WHERE EXISTS (SELECT 1 FROM iv WHERE iv.contig = s.contig AND s.pos >= \"start\" AND s.pos < \"end\")")
def include_regions(s, d):
    return R.include_regions(sites(s, d), intervals(s, d).drop("strand"))


@q("exclude_regions", f"WITH {SITES}, {IV} SELECT * FROM sites s WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.contig = s.contig AND s.pos >= \"start\" AND s.pos < \"end\")")
def exclude_regions(s, d):
    return R.exclude_regions(sites(s, d), intervals(s, d).drop("strand"))


@q("scorable", f"WITH {SITES}, {IV} SELECT * FROM sites s WHERE EXISTS (SELECT 1 FROM iv WHERE iv.contig = s.contig AND iv.strand = s.strand AND s.pos >= \"start\" AND s.pos < \"end\")")
def scorable(s, d):
    return R.scorable(sites(s, d), intervals(s, d))


@q("drop_overlapping", f"WITH {ALN}, {IV} SELECT read_id, contig, \"start\", \"end\" FROM aln a WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.contig = a.contig AND a.\"start\" < iv.\"end\" AND a.\"end\" > iv.\"start\")")
def drop_overlapping(s, d):
    return R.drop_overlapping(aln(s, d), intervals(s, d)).select("read_id", "contig", "start", "end")


@q("keep_selected", f"WITH {CALLS}, sel AS (SELECT l_orderkey AS read_id, l_suppkey AS contig, min(l_partkey) AS \"start\", max(l_partkey) AS \"end\" FROM lineitem GROUP BY ALL) SELECT read_id, contig, pos, count(*) AS n FROM calls c WHERE EXISTS (SELECT 1 FROM sel WHERE sel.read_id = c.read_id AND sel.contig = c.contig AND c.pos >= \"start\" AND c.pos < \"end\" + 1 AND \"start\" % 3 = 0) GROUP BY ALL")
def keep_selected(s, d):
    sel = calls(s, d).groupBy("read_id", "contig").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).where("start % 3 = 0")
    return R.keep_selected(calls(s, d), sel).groupBy("read_id", "contig", "pos").agg(F.count("*").alias("n"))


@q("nearest_distance", f"WITH {SITES}, {IV}, p AS (SELECT DISTINCT contig, pos FROM sites), r AS (SELECT DISTINCT contig, \"start\" AS pos FROM iv), lo AS (SELECT p.contig, p.pos, r.pos AS before FROM p ASOF LEFT JOIN r ON p.contig = r.contig AND p.pos >= r.pos), hi AS (SELECT p.contig, p.pos, r.pos AS after FROM p ASOF LEFT JOIN r ON p.contig = r.contig AND p.pos <= r.pos) SELECT contig, pos, least(pos - before, after - pos) AS distance FROM lo JOIN hi USING (contig, pos)")
def nearest_distance(s, d):
    return R.nearest_distance(sites(s, d).select("contig", "pos").distinct(), intervals(s, d).select("contig", F.col("start").alias("pos")), 1000)


@q("exclude_near", f"WITH {SITES}, {IV} SELECT * FROM sites s WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.contig = s.contig AND s.pos BETWEEN \"start\" - 10 AND \"start\" + 10)")
def exclude_near(s, d):
    return R.exclude_near(sites(s, d), intervals(s, d).select("contig", F.col("start").alias("pos")), 10)


# joins on sites


@q("label_sites", f"WITH {SITES} SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey % 25 = s.contig AND (p_partkey * 13) % 10000 = s.pos AND p_size > 25) THEN 1 ELSE 0 END AS label FROM sites s")
def label_sites(s, d):
    gt = t(s, d, "part").where("p_size > 25").select((F.col("p_partkey") % 25).alias("contig"), ((F.col("p_partkey") * 13) % 10000).alias("pos"))
    return L.label_sites(sites(s, d), gt, ["contig", "pos"])


@q("restrict", f"WITH {CALLS} SELECT contig, pos, count(*) AS n FROM calls WHERE (contig, pos) IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_quantity > 45) GROUP BY ALL")
def restrict(s, d):
    cand = t(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos")).distinct()
    return L.restrict(calls(s, d), cand, ["contig", "pos"]).groupBy("contig", "pos").agg(F.count("*").alias("n"))


@q("site_scores", f"WITH {SCORES}, u AS (SELECT contig, pos, '+' AS strand FROM scores UNION SELECT contig, pos, '-' FROM scores) SELECT u.contig, u.pos, u.strand, round(coalesce(sum_p, 0) / 20, 6) AS score, round(coalesce(n_mod, 0) / 20, 6) AS frequency, coalesce(n_called, 0) AS n_called FROM u LEFT JOIN scores s ON u.contig = s.contig AND u.pos = s.pos AND u.strand = s.strand")
def site_scores(s, d):
    sc = scores(s, d)
    u = sc.select("contig", "pos", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand")).distinct()
    return L.site_scores(u, sc.select(*SITE, "sum_p", "n_called", "n_mod"), SITE, 20).select(*SITE, *r6("score", "frequency"), "n_called")


@q("shared_sites", f"WITH {TRACK}, a AS (SELECT contig, pos, max(score) AS a FROM track WHERE model = (SELECT min(model) FROM track) GROUP BY ALL), b AS (SELECT contig, pos, max(score) AS b FROM track WHERE model = (SELECT max(model) FROM track) GROUP BY ALL) SELECT contig, pos, round(a, 6) AS a, round(b, 6) AS b FROM a JOIN b USING (contig, pos)")
def shared_sites(s, d):
    tr = track(s, d)
    ends = tr.agg(F.min("model").alias("lo"), F.max("model").alias("hi"))
    one = lambda e, n: tr.join(F.broadcast(ends.select(F.col(e).alias("model"))), "model").groupBy("contig", "pos").agg(F.max("score").alias(n))
    return L.shared_sites([one("lo", "a"), one("hi", "b")], ["contig", "pos"]).select("contig", "pos", *r6("a", "b"))


SEEN = "seen AS (SELECT DISTINCT c_mktsegment || '::' || (o_custkey % 7) AS member, o_custkey % 25 AS contig, (o_orderkey * 37) % 10000 AS pos FROM orders JOIN customer ON o_custkey = c_custkey)"


def seen(s, d):
    o, c = t(s, d, "orders"), t(s, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(F.concat("c_mktsegment", F.lit("::"), (F.col("o_custkey") % 7).cast("string")).alias("member"), (F.col("o_custkey") % 25).alias("contig"), ((F.col("o_orderkey") * 37) % 10000).alias("pos")).distinct()


@q("seen_positions", f"WITH {SEEN}, smp AS (SELECT n_name AS sample, '.*::' || (n_nationkey % 9) || '$' AS pattern FROM nation) SELECT DISTINCT sample, contig, pos FROM seen JOIN smp ON regexp_matches(member, pattern)")
def seen_positions(s, d):
    smp = t(s, d, "nation").select(F.col("n_name").alias("sample"), F.concat(F.lit(".*::"), (F.col("n_nationkey") % 9).cast("string"), F.lit("$")).alias("pattern"))
    return L.seen_positions(smp, seen(s, d), seen(s, d))


@q("holdout", f"WITH {SITES}, {SEEN} SELECT * FROM sites s WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.contig = s.contig AND seen.pos = s.pos)")
def holdout(s, d):
    return L.holdout(sites(s, d), seen(s, d), ["contig", "pos"])


@q("confidence_label", f"WITH {METHYL} SELECT contig, pos, cov, round(frac, 6) AS frac, CASE WHEN cov < 30 THEN NULL WHEN frac >= 0.6 THEN 1 WHEN frac <= 0.1 THEN 0 END AS label FROM frac")
def confidence_label(s, d):
    return methyl(s, d).select("contig", "pos", "cov", *r6("frac"), L.confidence_label(F.col("cov"), F.col("frac"), 30, 0.6, 0.1).alias("label"))


@q("methyl_ground_truth", f"WITH {METHYL} SELECT contig, pos, CASE WHEN frac >= 0.6 THEN 1 ELSE 0 END AS label FROM frac WHERE cov >= 30 AND (frac >= 0.6 OR frac <= 0.1) AND contig IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def methyl_ground_truth(s, d):
    allow = t(s, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("contig"))
    m = L.restrict(methyl(s, d), allow, ["contig"]).withColumn("label", L.confidence_label(F.col("cov"), F.col("frac"), 30, 0.6, 0.1))
    return m.where("label IS NOT NULL").select("contig", "pos", "label")


@q("assign_chem", f"WITH {CALLS}, im AS (SELECT DISTINCT contig, pos, label FROM calls), a AS (SELECT s_suppkey AS contig, min(s_nationkey) AS k FROM supplier WHERE s_nationkey < 5 GROUP BY ALL), b AS (SELECT p_partkey AS pos, min(p_brand) AS brand FROM part WHERE p_size < 20 GROUP BY ALL) SELECT im.contig, im.pos, im.label, CASE WHEN label = 1 THEN coalesce('n' || k, brand, 'untyped') END AS chem FROM im LEFT JOIN a ON im.contig = a.contig LEFT JOIN b ON im.pos = b.pos")
def assign_chem(s, d):
    im = calls(s, d).select("contig", "pos", "label").distinct()
    a = t(s, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("contig"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("chem"))
    b = t(s, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("chem"))
    sites_ = im.select("contig", "pos").distinct()
    return L.assign_chem(im, [sites_.join(a, "contig").select("contig", "pos", "chem"), sites_.join(b, "pos").select("contig", "pos", "chem")], ["contig", "pos"])


@q("check_chem_base", "SELECT l_orderkey AS id, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linestatus = 'O' THEN '6mA' ELSE 'untyped' END WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN '5mC' ELSE 'untyped' END END AS chem, count(*) AS k FROM lineitem GROUP BY ALL")
def check_chem_base(s, d):
    x = t(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linestatus") == "O", "A").otherwise("C").alias("base"), F.when(F.col("l_returnflag") == "A", "6mA").when(F.col("l_returnflag") == "R", "5mC").alias("chem"))
    return L.check_chem_base(x, {"6mA": "A", "5mC": "C"}).groupBy("id", "n", "chem").agg(F.count("*").alias("k"))


@q("type_map", f"WITH {BED}, dom AS (SELECT contig, pos, code FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY frac DESC, file_ord, line) AS rn FROM bed WHERE cov >= 10) WHERE rn = 1), ts AS (SELECT DISTINCT contig, pos, 'T' AS tt FROM bed WHERE cov < 5) SELECT contig, pos, coalesce(tt, code) AS type FROM dom FULL OUTER JOIN ts USING (contig, pos)")
def type_map(s, d):
    b = bedmethyl(s, d)
    return L.type_map(A.dominant_code(b, 10), b.where("cov < 5"), ["contig", "pos"], "T")


@q("anchors", f"WITH {CALLS} SELECT contig, pos, strand, label, count(*) AS n FROM calls WHERE (contig, pos) IN (SELECT (contig, pos) FROM calls GROUP BY contig, pos HAVING min(label) = 0 AND max(label) = 1) GROUP BY ALL")
def anchors(s, d):
    return L.anchors(calls(s, d), ["contig", "pos"]).groupBy("contig", "pos", "strand", "label").agg(F.count("*").alias("n"))


@q("drop_untyped", f"WITH {CALLS} SELECT contig, label, count(*) AS n FROM calls WHERE label = 0 OR pos % 5 <> 0 GROUP BY ALL")
def drop_untyped(s, d):
    x = calls(s, d).withColumn("chem", F.when(F.col("pos") % 5 == 0, "untyped").otherwise("5mC"))
    return L.drop_untyped(x).groupBy("contig", "label").agg(F.count("*").alias("n"))


@q("control_labels", f"WITH {CALLS} SELECT contig, CASE WHEN contig IN (1, 2, 3) THEN 0 ELSE label END AS label, count(*) AS n FROM calls GROUP BY ALL")
def control_labels(s, d):
    return L.control_labels(calls(s, d), F.col("contig").cast("string"), ["1", "2", "3"]).groupBy("contig", "label").agg(F.count("*").alias("n"))


@q("type_by_calls", f"WITH {BED}, a AS (SELECT contig, pos, max(frac) AS fa FROM bed WHERE code = 'a' GROUP BY ALL), b AS (SELECT contig, pos, max(frac) AS fb FROM bed WHERE code = 'r' GROUP BY ALL) SELECT contig, pos, CASE WHEN fb IS NULL THEN 'a' WHEN fa IS NULL THEN 'r' WHEN fa >= 0.06 AND fb < 0.06 THEN 'a' WHEN fb >= 0.06 AND fa < 0.06 THEN 'r' ELSE 'untyped' END AS type FROM a FULL OUTER JOIN b USING (contig, pos)")
def type_by_calls(s, d):
    b = bedmethyl(s, d)
    one = lambda c: b.where(F.col("code") == c).groupBy("contig", "pos").agg(F.max("frac").alias("frac"))
    return L.type_by_calls(one("a"), one("r"), ["contig", "pos"], "a", "r", 0.06)


REGIONS = """WITH g AS (SELECT c_mktsegment AS organism, CAST(c_nationkey AS VARCHAR) AS contig, CAST(sum(CAST(floor(c_acctbal) AS BIGINT) + 2000) AS BIGINT) AS length FROM customer GROUP BY ALL),
s AS (SELECT *, length / sum(length) OVER (PARTITION BY organism) AS share FROM g),
r AS (SELECT *, sum(share) OVER (PARTITION BY organism ORDER BY md5('11:' || organism || ':' || contig) ROWS UNBOUNDED PRECEDING) AS run,
  max(CASE WHEN share >= 0.06 AND share <= 0.1 THEN (-abs(share - 0.08), contig) END) OVER (PARTITION BY organism) AS band, row_number() OVER (PARTITION BY organism ORDER BY length DESC, contig) = 1 AS big FROM s),
a AS (SELECT *, max(CAST(run <= 0.1 AS INT)) OVER (PARTITION BY organism) AS fits FROM r),
e AS (SELECT organism, contig, length, CASE WHEN band IS NOT NULL THEN CASE WHEN band[2] = contig THEN length END WHEN fits = 1 THEN CASE WHEN run <= 0.1 THEN length END WHEN big THEN CAST(floor(length * 0.08 / share) AS BIGINT) END AS x FROM a)
SELECT organism, contig, 0 AS start, least(x, length) AS "end" FROM e WHERE least(x, length) > 0"""


@q("holdout_regions", REGIONS)
def holdout_regions(s, d):
    c = t(s, d, "customer")
    g = c.groupBy(F.col("c_mktsegment").alias("organism"), F.col("c_nationkey").cast("string").alias("contig")).agg(F.sum(F.floor("c_acctbal").cast("long") + 2000).alias("length"))
    return L.holdout_regions(g, 0.08, 0.02, 11)
