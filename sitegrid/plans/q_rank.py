"""Queries: ranking metrics, samples, sets, splits, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrid.functions.scalar import hash_key, stable_seed
from sitegrid.operators import labels as L
from sitegrid.operators import ranking as K
from sitegrid.operators import report as P
from sitegrid.operators import sampling as S
from sitegrid.operators import splits as X
from sitegrid.plans.core import CALLS, IV, SCORES, SITES, TRACK, calls, dealt, intervals, q, r6, scores, sites, t, track
from sitegrid.plans.q_calls import CELLS, SEEN, cells, seen
from sitegrid.sources import sinks

SITE = ["contig", "pos", "strand"]
D = f"{SCORES}, d AS (SELECT contig, label, score FROM scores)"
CUM = "g AS (SELECT contig, score, sum(label) AS p, sum(1 - label) AS n FROM d GROUP BY ALL), c AS (SELECT *, sum(p) OVER (PARTITION BY contig ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY contig ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY contig) AS pos, sum(n) OVER (PARTITION BY contig) AS neg FROM g), pr AS (SELECT *, tp / (tp + fp) AS precision, CASE WHEN pos > 0 THEN tp / pos END AS recall FROM c)"
AUC = "auc AS (SELECT contig, CAST(max(pos) AS BIGINT) AS n_pos, CAST(max(neg) AS BIGINT) AS n_neg, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(p * (neg - fp + n / 2.0)) / (max(pos) * max(neg)) END AS auroc FROM c GROUP BY contig)"
AP = "ap AS (SELECT contig, CASE WHEN max(pos) > 0 THEN sum(precision * p) / max(pos) END AS auprc FROM pr GROUP BY contig)"
THR = "f AS (SELECT *, CASE WHEN pos > 0 THEN round(2 * precision * recall / (precision + recall + 1e-8), 12) ELSE 0 END AS f1 FROM pr), thr AS (SELECT contig, CASE WHEN max(pos) = 0 OR max(fp) = 0 THEN 0.5 ELSE arg_max(score, (f1, -score)) END AS threshold, CASE WHEN max(pos) = 0 OR max(fp) = 0 THEN NULL ELSE max(f1) END AS best_f1 FROM f GROUP BY contig)"


@q("auroc", f"WITH {D}, {CUM}, {AUC} SELECT contig, n_pos, n_neg, round(auroc, 6) AS auroc FROM auc")
def auroc(s, d):
    return K.auroc(scores(s, d), "label", "score", ["contig"]).select("contig", "n_pos", "n_neg", *r6("auroc"))


@q("auroc_pooled", f"WITH {SCORES}, d AS (SELECT 0 AS contig, label, score FROM scores), {CUM}, {AUC} SELECT n_pos, n_neg, round(auroc, 6) AS auroc FROM auc")
def auroc_pooled(s, d):
    return K.auroc(scores(s, d).withColumn("all", F.lit(0)), "label", "score", ["all"]).select("n_pos", "n_neg", *r6("auroc"))


@q("pr_curve", f"WITH {D}, {CUM} SELECT contig, score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr")
def pr_curve(s, d):
    return K.pr_curve(scores(s, d), "label", "score", ["contig"]).select("contig", "threshold", "tp", "fp", *r6("precision", "recall"))


@q("average_precision", f"WITH {D}, {CUM}, {AP} SELECT contig, round(auprc, 6) AS auprc FROM ap")
def average_precision(s, d):
    return K.average_precision(scores(s, d), "label", "score", ["contig"]).select("contig", *r6("auprc"))


@q("best_threshold", f"WITH {D}, {CUM}, {THR} SELECT contig, threshold, round(best_f1, 6) AS best_f1 FROM thr")
def best_threshold(s, d):
    return K.best_threshold(scores(s, d), "label", "score", ["contig"]).select("contig", "threshold", *r6("best_f1"))


BIN = f"{CUM}, {AUC}, {AP}, {THR}, m AS (SELECT d.contig, max(threshold) AS threshold, count(*) AS n_test, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 1 AND score < threshold) AS fn, count(*) FILTER (label = 0 AND score < threshold) AS tn FROM d JOIN thr USING (contig) GROUP BY d.contig)"
BINSEL = "SELECT contig, threshold, n_test, tp + fn AS n_pos, round((tp + tn) / n_test, 6) AS micro_f1, round(CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END, 6) AS mod_f1, round(CASE WHEN 2*tn+fp+fn > 0 THEN 2*tn/(2*tn+fp+fn) ELSE 0 END, 6) AS unmod_f1, round((CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END + CASE WHEN 2*tn+fp+fn > 0 THEN 2*tn/(2*tn+fp+fn) ELSE 0 END) / 2, 6) AS macro_f1, round(CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0 END, 6) AS mod_prec, round(CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END, 6) AS mod_rec, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM m JOIN auc USING (contig) JOIN ap USING (contig)"


@q("binary_metrics", f"WITH {D}, {BIN} {BINSEL}")
def binary_metrics(s, d):
    m = K.binary_metrics(scores(s, d), "label", "score", ["contig"])
    return m.select("contig", "threshold", "n_test", "n_pos", *r6("micro_f1", "mod_f1", "unmod_f1", "macro_f1", "mod_prec", "mod_rec", "auroc", "auprc"))


@q("fold_metrics", f"WITH {SCORES}, d AS (SELECT contig % 5 AS contig, label, score FROM scores), {BIN} {BINSEL}".replace("SELECT contig, threshold, n_test", "SELECT contig AS fold, threshold, n_test"))
def fold_metrics(s, d):
    m = P.fold_metrics(scores(s, d).withColumn("fold", F.col("contig") % 5), ["fold"])
    return m.select("fold", "threshold", "n_test", "n_pos", *r6("micro_f1", "mod_f1", "unmod_f1", "macro_f1", "mod_prec", "mod_rec", "auroc", "auprc"))


@q("roc_grid", f"WITH {SCORES}, d AS (SELECT contig % 5 AS contig, label, score FROM scores), {CUM}, pts AS (SELECT contig, fp / neg AS fpr, tp / pos AS tpr FROM c WHERE pos > 0 AND neg > 0 UNION ALL SELECT DISTINCT contig, 0.0, 0.0 FROM c WHERE pos > 0 AND neg > 0), gr AS (SELECT unnest([0.001, 0.01, 0.1, 0.5, 1.0]) AS x), n AS (SELECT contig, x, max((fpr, tpr)) FILTER (fpr <= x) AS lo, min((fpr, tpr)) FILTER (fpr > x) AS hi FROM pts, gr GROUP BY ALL) SELECT contig AS fold, CAST(x AS DOUBLE) AS fpr, round(coalesce(lo[2] + (x - lo[1]) * (hi[2] - lo[2]) / (hi[1] - lo[1]), lo[2]), 6) AS tpr FROM n")
def roc_grid(s, d):
    g = K.roc_grid(scores(s, d).withColumn("fold", F.col("contig") % 5), "label", "score", ["fold"], [0.001, 0.01, 0.1, 0.5, 1.0])
    return g.select("fold", "fpr", *r6("tpr"))


CAL = "cal AS (SELECT *, (rank() OVER (PARTITION BY contig ORDER BY score) - 1 + (count(*) OVER (PARTITION BY contig, score) + 1) / 2.0) / count(*) OVER (PARTITION BY contig) AS calibrated FROM scores)"


@q("rank_calibrate", f"WITH {SCORES}, {CAL} SELECT contig, pos, strand, round(calibrated, 6) AS calibrated FROM cal")
def rank_calibrate(s, d):
    return K.rank_calibrate(scores(s, d), "score", ["contig"]).select(*SITE, *r6("calibrated"))


# samples


@q("sample_uniform", f"WITH {SITES} SELECT * FROM sites ORDER BY md5('1:' || contig || ':' || pos || ':' || strand) LIMIT 500")
def sample_uniform(s, d):
    return S.sample_uniform(sites(s, d), 500, SITE, 1)


@q("sample_weighted", f"WITH {SITES} SELECT * FROM sites ORDER BY round(-ln((CAST('0x' || md5('2:' || contig || ':' || pos || ':' || strand)[1:13] AS BIGINT) + 0.5) / 4503599627370496.0) / CASE WHEN strand = '+' THEN 3 ELSE 1 END, 9), contig, pos, strand LIMIT 500")
def sample_weighted(s, d):
    return S.sample_weighted(sites(s, d), 500, SITE, F.when(F.col("strand") == "+", 3).otherwise(1), 2)


@q("cap_per_group", f"WITH {SITES} SELECT contig, pos, strand FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY md5('4:' || contig || ':' || pos || ':' || strand)) AS rn FROM sites) WHERE rn <= 20")
def cap_per_group(s, d):
    return S.cap_per_group(sites(s, d), ["contig"], 20, SITE, 4)


@q("cap_negatives", f"WITH {SCORES} SELECT contig, pos, strand, label FROM (SELECT *, row_number() OVER (PARTITION BY contig, label ORDER BY md5('6:' || contig || ':' || pos || ':' || strand)) AS rn FROM scores) WHERE label = 1 OR rn <= 30")
def cap_negatives(s, d):
    return S.cap_negatives(scores(s, d), 30, ["contig"], SITE, 6).select(*SITE, "label")


@q("pool_sample", f"WITH {SCORES} SELECT contig, pos, strand, label FROM (SELECT *, row_number() OVER (PARTITION BY contig, label ORDER BY md5('8:' || contig || ':' || pos || ':' || strand)) AS rn FROM scores) WHERE rn <= 25")
def pool_sample(s, d):
    return S.cap_per_group(scores(s, d), ["contig", "label"], 25, SITE, 8).select(*SITE, "label")


@q("balance", f"WITH {SCORES}, n AS (SELECT count(*) FILTER (label = 1) AS p, least(count(*) FILTER (label = 0), CAST(floor(count(*) FILTER (label = 1) * 0.5) AS BIGINT)) AS q FROM scores), m AS (SELECT CASE WHEN p + q > 1000 THEN floor(1000.0 * p / (p + q)) ELSE p END AS p, CASE WHEN p + q > 1000 THEN floor(1000.0 * q / (p + q)) ELSE q END AS q FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('9:' || contig || ':' || pos || ':' || strand)) AS rn FROM scores) SELECT contig, pos, strand, label FROM r, m WHERE (label = 1 AND rn <= p) OR (label = 0 AND rn <= q)")
def balance(s, d):
    x = scores(s, d)
    return S.balance(x.where("label = 1").select(*SITE), x.where("label = 0").select(*SITE), 0.5, 1000, SITE, 9)


@q("cap_bases", "WITH c AS (SELECT p_mfgr AS b, count(*) AS k FROM (SELECT *, substr(p_brand, 7, 1) AS p_mfgr FROM part) GROUP BY ALL), r AS (SELECT b, k, row_number() OVER (ORDER BY k DESC, b) AS rk FROM c), lim AS (SELECT max(b) FILTER (rk = 1) AS top, CAST(floor(0.5 * max(k) FILTER (rk = 2)) AS BIGINT) AS n FROM r), o AS (SELECT p_partkey, substr(p_brand, 7, 1) AS base, row_number() OVER (PARTITION BY substr(p_brand, 7, 1) ORDER BY md5('10:' || p_partkey)) AS rn FROM part) SELECT p_partkey, base FROM o, lim WHERE base <> top OR rn <= n")
def cap_bases(s, d):
    p = t(s, d, "part").select("p_partkey", F.substring("p_brand", 7, 1).alias("base"))
    return S.cap_bases(p, "base", 0.5, ["p_partkey"], 10)


@q("oversample", "SELECT n_name, c AS copy FROM nation, (SELECT unnest([1, 2, 3]) AS c) WHERE c = 1 OR n_regionkey = 2")
def oversample(s, d):
    return S.oversample(t(s, d, "nation"), F.col("n_regionkey") == 2, 3).select("n_name", "copy")


@q("balanced_draws", "WITH r AS (SELECT n_name, n_regionkey, count(*) OVER (PARTITION BY n_regionkey) AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY md5('2:' || n_name)) - 1 AS rn FROM nation) SELECT n_name, n_regionkey, CAST(rd AS INTEGER) AS round FROM r, (SELECT unnest(range(12)) AS rd) WHERE rd % n = rn")
def balanced_draws(s, d):
    return S.balanced_draws(t(s, d, "nation").select("n_name", "n_regionkey"), ["n_regionkey"], ["n_name"], 12, 2)


@q("bootstrap_auroc", None)
def bootstrap_auroc(s, d):
    x = scores(s, d).withColumn("row", F.col("contig") % 10)
    return S.bootstrap_auroc(x, "label", "score", ["row"], 300, 3).select(*r6("lo", "mid", "hi"))


@q("fewshot", f"WITH {SCORES}, h AS (SELECT *, md5('5:' || contig || ':' || pos || ':' || strand)[1] < '8' AS half FROM scores), r AS (SELECT *, row_number() OVER (PARTITION BY contig % 5, label ORDER BY md5('6:' || contig || ':' || pos || ':' || strand)) AS rn FROM h WHERE half) SELECT contig, pos, strand, label, 'support' AS role FROM r WHERE rn <= 5 UNION ALL SELECT contig, pos, strand, label, 'query' FROM h WHERE NOT half")
def fewshot(s, d):
    x = scores(s, d).withColumn("g", F.col("contig") % 5)
    return S.fewshot(x, 5, ["g"], SITE, 5).select(*SITE, "label", "role")


# sets


@q("combine_sites", f"WITH {SITES} SELECT contig, pos FROM sites WHERE strand = '+' UNION SELECT contig, pos FROM sites WHERE pos % 2 = 0")
def combine_sites(s, d):
    x = sites(s, d)
    return x.where("strand = '+'").select("contig", "pos").union(x.where("pos % 2 = 0").select("contig", "pos")).distinct()


@q("remaining_sites", f"WITH {SITES} SELECT contig, pos FROM sites EXCEPT SELECT contig, pos FROM sites WHERE strand = '+'")
def remaining_sites(s, d):
    x = sites(s, d)
    return x.select("contig", "pos").distinct().join(x.where("strand = '+'"), ["contig", "pos"], "left_anti")


@q("confirm_motifs", "WITH o AS (SELECT p_brand AS motif, p_partkey AS pos FROM part), c AS (SELECT DISTINCT l_partkey AS pos FROM lineitem WHERE l_discount > 0.05) SELECT motif, count(*) AS occurrences, count(c.pos) AS explained, round(count(c.pos) / count(*), 6) AS rate FROM o LEFT JOIN c USING (pos) GROUP BY ALL")
def confirm_motifs(s, d):
    o = t(s, d, "part").select(F.col("p_brand").alias("motif"), F.col("p_partkey").alias("pos"))
    c = t(s, d, "lineitem").where("l_discount > 0.05").select(F.col("l_partkey").alias("pos"))
    return L.confirm_motifs(o, c, ["pos"]).select("motif", "occurrences", "explained", *r6("rate"))


@q("dedup_sites", f"WITH {CALLS} SELECT contig, pos, strand, 'stranded' AS kind FROM calls GROUP BY ALL UNION ALL SELECT contig, pos, 'any', 'pooled' FROM calls GROUP BY contig, pos")
def dedup_sites(s, d):
    c = calls(s, d)
    a = c.select(*SITE).distinct().withColumn("kind", F.lit("stranded"))
    return a.unionByName(c.select("contig", "pos").distinct().withColumns({"strand": F.lit("any"), "kind": F.lit("pooled")}))


@q("sample_candidates", f"WITH {SITES} SELECT strand, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM sites GROUP BY ALL")
def sample_candidates(s, d):
    x = sites(s, d)
    u = x.where("pos % 3 <> 0").unionByName(x.where("pos % 2 = 0")).unionByName(x.where("pos % 3 = 0")).distinct()
    return u.groupBy("strand").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


@q("append_background", f"WITH {SITES}, {IV} SELECT contig, pos, strand, 'site' AS type FROM sites UNION ALL SELECT DISTINCT contig, \"start\", strand, 'background' FROM iv")
def append_background(s, d):
    b = intervals(s, d).select("contig", F.col("start").alias("pos"), "strand").distinct().withColumn("type", F.lit("background"))
    return sites(s, d).withColumn("type", F.lit("site")).unionByName(b)


@q("disjoint", f"WITH {SITES}, {SEEN} SELECT contig, pos FROM sites INTERSECT SELECT contig, pos FROM seen")
def disjoint(s, d):
    return X.disjoint(sites(s, d), seen(s, d), ["contig", "pos"])


# splits


@q("split_positions", f"WITH {SCORES}, p AS (SELECT contig, pos, max(label) AS y FROM scores GROUP BY ALL), r AS (SELECT *, count(*) OVER (PARTITION BY y) AS n, row_number() OVER (PARTITION BY y ORDER BY md5('12:' || contig || ':' || pos)) AS rn FROM p), z AS (SELECT *, round_even(n * 0.1, 0) AS a, round_even(n * 0.2, 0) AS b FROM r), s AS (SELECT contig, pos, CASE WHEN rn <= b THEN 'test' WHEN rn <= b + a THEN 'val' ELSE 'train' END AS split FROM z) SELECT contig, pos, strand, label, split FROM scores JOIN s USING (contig, pos)")
def split_positions(s, d):
    return X.split_positions(scores(s, d), ["contig", "pos"], 0.1, 0.2, 12).select(*SITE, "label", "split")


@q("carve_val", f"WITH {SITES} SELECT contig, pos, strand, CASE WHEN CAST('0x' || md5('13:' || contig || ':' || pos)[1:8] AS BIGINT) / 4294967296.0 < 0.15 THEN 'val' ELSE 'train' END AS part FROM sites")
def carve_val(s, d):
    return X.carve_val(sites(s, d), 0.15, 13, ["contig", "pos"])


@q("hash_split", None)
def hash_split(s, d):
    return X.hash_split(sites(s, d), 0.2, 5, "contig", "pos")


@q("region_split", f"WITH {SITES}, {IV} SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM iv WHERE iv.contig = s.contig AND s.pos >= \"start\" AND s.pos < \"end\") THEN 'test' ELSE 'train' END AS role FROM sites s")
def region_split(s, d):
    return X.region_split(sites(s, d), intervals(s, d).drop("strand"))


FOLD = "pool AS (SELECT l_suppkey AS contig, l_partkey AS pos, l_linenumber AS k, c_mktsegment AS organism, CASE l_returnflag WHEN 'A' THEN '6mA' WHEN 'R' THEN '5mC' END AS chem, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS label, CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'C' END AS base, 'm' || (o_orderkey % 4) AS member, l_suppkey % 5 = 0 AS in_region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def pool(s, d):
    li, o, c = t(s, d, "lineitem"), t(s, d, "orders"), t(s, d, "customer")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    f = F.col("l_returnflag")
    return j.select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos"), F.col("l_linenumber").alias("k"), F.col("c_mktsegment").alias("organism"), F.when(f == "A", "6mA").when(f == "R", "5mC").alias("chem"), F.when(f == "N", 0).otherwise(1).alias("label"), F.when(F.col("l_linestatus") == "O", "A").otherwise("C").alias("base"), F.concat(F.lit("m"), (F.col("o_orderkey") % 4).cast("string")).alias("member"), (F.col("l_suppkey") % 5 == 0).alias("in_region"))


def fold_counts(x):
    return x.groupBy("fold", "role", "organism", "chem", "base", "label").agg(F.count("*").alias("n"))


FSEL = "SELECT fold, role, organism, chem, base, label, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY ALL"


@q("fold_all", f"WITH {FOLD}, r AS (SELECT *, 'all' AS fold, CASE WHEN in_region THEN 'test' ELSE 'train' END AS role FROM pool) {FSEL}")
def fold_all(s, d):
    return fold_counts(X.fold(pool(s, d), "all"))


@q("fold_loco", f"WITH {FOLD}, r AS (SELECT * EXCLUDE (in_region), 'loco_5mC' AS fold, CASE WHEN chem = '5mC' THEN 'test' WHEN label = 0 THEN CASE WHEN in_region THEN 'test' ELSE 'train' END WHEN in_region THEN NULL ELSE 'train' END AS role FROM pool) {FSEL}")
def fold_loco(s, d):
    return fold_counts(X.fold(pool(s, d), "loco_5mC"))


@q("fold_logo", f"WITH {FOLD}, r0 AS (SELECT *, 'logo_BUILDING' AS fold, CASE WHEN organism = 'BUILDING' THEN 'test' WHEN in_region THEN NULL ELSE 'train' END AS role0 FROM pool), r AS (SELECT *, CASE WHEN member = 'm0' THEN 'test' ELSE role0 END AS role FROM r0 WHERE role0 IS NOT NULL) SELECT fold, role, organism, chem, base, label, count(*) AS n FROM r WHERE role = 'train' OR member <> 'm1' GROUP BY ALL")
def fold_logo(s, d):
    return fold_counts(X.fold(pool(s, d), "logo_BUILDING", controls=["m0"], natives=["m1"]))


@q("fold_core", f"WITH {FOLD}, r AS (SELECT *, 'core_6mA' AS fold, CASE WHEN label = 0 OR chem = '6mA' THEN CASE WHEN in_region THEN 'test' ELSE 'train' END ELSE 'test' END AS role FROM pool) {FSEL}")
def fold_core(s, d):
    return fold_counts(X.fold(pool(s, d), "core_6mA", base_of={"6mA": "A", "5mC": "C"}))


@q("fold_subset", f"WITH {FOLD}, r AS (SELECT *, 'subset_5mC+6mA' AS fold, CASE WHEN label = 0 OR chem IN ('5mC', '6mA') THEN CASE WHEN in_region THEN 'test' ELSE 'train' END ELSE 'test' END AS role FROM pool) {FSEL}")
def fold_subset(s, d):
    return fold_counts(X.fold(pool(s, d), "subset_5mC+6mA"))


SHARE = "CAST('0x' || md5('17:' || contig || ':' || pos)[1:8] AS BIGINT) / 4294967296.0"


@q("fold_mixed", f"WITH {FOLD}, r AS (SELECT *, 'mixed' AS fold, CASE WHEN {SHARE} < 0.15 THEN 'test' ELSE 'train' END AS role FROM pool) {FSEL}")
def fold_mixed(s, d):
    return fold_counts(X.fold(pool(s, d), "mixed"))


@q("fold_base_ratio", f"WITH {FOLD}, r0 AS (SELECT *, 'all' AS fold, CASE WHEN in_region THEN 'test' ELSE 'train' END AS role FROM pool), k AS (SELECT base, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, base) AS rk FROM r0 WHERE role = 'train' AND label = 1 GROUP BY base), c AS (SELECT max(base) FILTER (rk = 1) AS top, 0.5 * max(k) FILTER (rk = 2) / max(k) FILTER (rk = 1) AS share FROM k), r AS (SELECT r0.* FROM r0, c WHERE NOT (role = 'train' AND label = 1 AND base = top) OR {SHARE} < share) {FSEL}")
def fold_base_ratio(s, d):
    return fold_counts(X.fold(pool(s, d), "all", base_ratio=0.5))


@q("leave_one_dataset_out", f"WITH {FOLD}, f AS (SELECT DISTINCT member AS fold FROM pool), r AS (SELECT pool.*, fold, CASE WHEN member = fold AND in_region THEN 'test' WHEN member <> fold AND NOT in_region THEN 'train' END AS role FROM pool, f) SELECT fold, role, label, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY ALL")
def leave_one_dataset_out(s, d):
    return X.leave_one_out(pool(s, d), "member", F.col("in_region")).groupBy("fold", "role", "label").agg(F.count("*").alias("n"))


@q("seen_table", f"WITH {FOLD}, r AS (SELECT member, CASE WHEN in_region THEN 'test' WHEN label = 0 AND k = 1 THEN 'unused' ELSE 'train' END AS split FROM pool) SELECT member, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'unused') AS unused FROM r GROUP BY ALL")
def seen_table(s, d):
    p = pool(s, d).withColumn("split", F.when(F.col("in_region"), "test").when((F.col("label") == 0) & (F.col("k") == 1), "unused").otherwise("train"))
    return X.seen_table(p)


@q("stable_seed", "SELECT c_name, CAST('0x' || sha256(c_name)[1:8] AS BIGINT) AS seed FROM customer")
def stable_seed_q(s, d):
    return t(s, d, "customer").select("c_name", stable_seed(F.col("c_name")).alias("seed"))


@q("read_rank", "SELECT o_orderkey, md5('17:' || o_orderkey) AS rank FROM orders")
def read_rank_q(s, d):
    return t(s, d, "orders").select("o_orderkey", hash_key(17, "o_orderkey").alias("rank"))


# reports


@q("score_rows", f"WITH {SCORES}, d AS (SELECT contig % 7 AS contig, label, score, n_mod / 20.0 AS frequency, n_called FROM scores), {CUM}, {AUC}, {AP}, m AS (SELECT contig, count(*) FILTER (label = 1 AND frequency >= 0.05) AS tp, count(*) FILTER (label = 0 AND frequency >= 0.05) AS fp, count(*) FILTER (label = 1 AND frequency < 0.05) AS fn, avg(CASE WHEN n_called > 0 THEN 1 ELSE 0 END) AS called FROM d GROUP BY ALL) SELECT contig AS \"row\", 'ok' AS status, n_pos, n_neg, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(called, 6) AS called FROM m JOIN auc USING (contig) JOIN ap USING (contig)")
def score_rows(s, d):
    b = scores(s, d).withColumns({"row": F.col("contig") % 7, "frequency": F.col("n_mod") / 2.0})
    return P.score_rows(b, ["row"]).select("row", "status", "n_pos", "n_neg", *r6("auroc", "auprc", "f1", "called"))


@q("zero_r", f"WITH {CALLS}, m AS (SELECT label AS pred FROM calls WHERE pos % 2 = 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) SELECT contig, pred, round(avg(CASE WHEN label = pred THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM calls, m WHERE pos % 2 = 1 GROUP BY ALL")
def zero_r(s, d):
    c = calls(s, d)
    return P.zero_r(c.where("pos % 2 = 0"), c.where("pos % 2 = 1"), ["contig"]).select("contig", "pred", *r6("accuracy"), "n")


@q("confusion", f"WITH {CALLS} SELECT contig, label, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM calls GROUP BY ALL")
def confusion(s, d):
    return P.confusion(calls(s, d), "label", "prob", 0.5, ["contig"])


@q("class_report", "WITH c AS (SELECT l_returnflag AS y, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS z FROM lineitem), l AS (SELECT DISTINCT y AS label FROM c) SELECT label, (SELECT count(*) FROM c WHERE y = label) AS support, round((SELECT count(*) FROM c WHERE y = label AND z = label) / (SELECT count(*) FROM c WHERE z = label), 6) AS precision, round((SELECT count(*) FROM c WHERE y = label AND z = label) / (SELECT count(*) FROM c WHERE y = label), 6) AS recall, round(2 * (SELECT count(*) FROM c WHERE y = label AND z = label) / ((SELECT count(*) FROM c WHERE z = label) + (SELECT count(*) FROM c WHERE y = label)), 6) AS f1 FROM l")
def class_report(s, d):
    m = F.col("l_linenumber") % 3
    x = t(s, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(m == 0, "A").when(m == 1, "N").otherwise("R").alias("z"))
    return P.class_report(x, "y", "z").select("label", "support", *r6("precision", "recall", "f1"))


@q("family_table", f"WITH {CELLS} SELECT \"row\", family, CASE WHEN count(*) = count(auroc) THEN max(auroc) END AS auroc, count(*) - count(auroc) AS n_pending FROM cells GROUP BY ALL")
def family_table(s, d):
    return P.family_table(cells(s, d))


@q("best_specialist", f"WITH {CELLS} SELECT \"row\", arg_max(model, (auroc, model)) AS model, max(auroc) AS auroc FROM cells WHERE family <> CASE WHEN \"row\" % 2 = 0 THEN 'A' ELSE 'N' END AND auroc IS NOT NULL GROUP BY ALL")
def best_specialist(s, d):
    return P.best_specialist(cells(s, d).withColumn("own_family", F.when(F.col("row") % 2 == 0, "A").otherwise("N")))


@q("null_flags", f"WITH {CELLS} SELECT c.\"row\", c.model, c.auroc, n.auroc AS null_auroc, coalesce(n.auroc >= 0.5, false) AS flag FROM cells c LEFT JOIN (SELECT \"row\", auroc FROM cells WHERE model = 'A1') n ON c.\"row\" = n.\"row\"")
def null_flags(s, d):
    c = cells(s, d)
    return P.null_flags(c, c.where("model = 'A1'"), 0.5).select("row", "model", "auroc", "null_auroc", "flag")


@q("leaveout_table", f"WITH {CELLS} SELECT \"row\", a.auroc AS inside, b.auroc AS outside, round(a.auroc - b.auroc, 6) AS loss FROM (SELECT * FROM cells WHERE model = 'N1') a FULL OUTER JOIN (SELECT * FROM cells WHERE model = 'R1') b USING (\"row\")")
def leaveout_table(s, d):
    c = cells(s, d)
    return P.leaveout_table(c.where("model = 'N1'"), c.where("model = 'R1'")).select("row", "inside", "outside", *r6("loss"))


@q("audit_matching", f"WITH {CALLS}, k AS (SELECT contig, pos, strand, min(label) AS a, max(label) AS b FROM calls GROUP BY ALL) SELECT contig, round(avg(CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END), 6) AS matched, count(*) AS n_keys FROM k GROUP BY ALL")
def audit_matching(s, d):
    return P.audit_matching(calls(s, d), "contig", ["pos", "strand"]).select("contig", *r6("matched"), "n_keys")


@q("audit_leakage", f"WITH {SITES}, {SEEN}, p AS (SELECT DISTINCT strand, contig, pos FROM sites), r AS (SELECT DISTINCT contig, pos FROM seen), lo AS (SELECT p.*, r.pos AS before FROM p ASOF LEFT JOIN r ON p.contig = r.contig AND p.pos >= r.pos), hi AS (SELECT p.*, r.pos AS after FROM p ASOF LEFT JOIN r ON p.contig = r.contig AND p.pos <= r.pos), d AS (SELECT strand, least(pos - before, after - pos) AS x FROM lo JOIN hi USING (strand, contig, pos)) SELECT strand, median(x) AS median_distance, round(avg(CASE WHEN x = 0 THEN 1 ELSE 0 END), 6) AS share_seen FROM d GROUP BY ALL")
def audit_leakage(s, d):
    return P.audit_leakage(sites(s, d), seen(s, d), "strand").select("strand", "median_distance", *r6("share_seen"))


@q("audit_calls", f"WITH {SCORES} SELECT strand, round(avg(n_called) / 5, 6) AS call_rate FROM scores GROUP BY ALL")
def audit_calls(s, d):
    return P.audit_calls(scores(s, d), ["strand"], 5).select("strand", *r6("call_rate"))


@q("audit_pooled", f"WITH {SCORES}, s2 AS (SELECT strand AS contig, contig % 6 AS rw, label, score FROM scores), cal AS (SELECT *, (rank() OVER (PARTITION BY contig ORDER BY score) - 1 + (count(*) OVER (PARTITION BY contig, score) + 1) / 2.0) / count(*) OVER (PARTITION BY contig) AS cal FROM s2), d AS (SELECT contig || o.rw AS contig, label, cal AS score FROM cal, (SELECT DISTINCT rw FROM s2) o WHERE o.rw <> cal.rw), {CUM}, {AUC} SELECT contig[1] AS strand, CAST(contig[2:] AS BIGINT) AS left_out, n_pos, n_neg, round(auroc, 6) AS auroc FROM auc")
def audit_pooled(s, d):
    return P.audit_pooled(scores(s, d).withColumn("row", F.col("contig") % 6), "row", ["strand"]).select("strand", "left_out", "n_pos", "n_neg", *r6("auroc"))


MAP = f"{TRACK}, a AS (SELECT contig, pos, max(score) AS a FROM track WHERE model IN ('click', 'view') GROUP BY ALL), b AS (SELECT contig, pos, max(score) AS b FROM track WHERE model NOT IN ('click', 'view') GROUP BY ALL), w AS (SELECT contig, pos // 1440 AS win, avg(a) AS a, avg(b) AS b, count(*) AS n FROM a JOIN b USING (contig, pos) GROUP BY ALL)"


def gmap(s, d):
    tr = track(s, d)
    two = F.col("model").isin("click", "view")
    a = tr.where(two).groupBy("contig", "pos").agg(F.max("score").alias("a")).withColumn("n_reads", F.lit(1))
    b = tr.where(~two).groupBy("contig", "pos").agg(F.max("score").alias("b"))
    return P.genome_map({"a": a, "b": b}, 1440)


@q("genome_map", f"WITH {MAP} SELECT contig, win, round(a, 6) AS a, round(b, 6) AS b, n, win * 1440 AS \"start\" FROM w")
def genome_map(s, d):
    return gmap(s, d).select("contig", "win", *r6("a", "b"), "n", "start")


@q("genes_in_windows", f"WITH {MAP}, g AS (SELECT DISTINCT user_id % 10 AS contig, 'u' || user_id AS gene, min(epoch_us(ts) // 60000000) AS s, max(epoch_us(ts) // 60000000) + 1 AS e FROM events GROUP BY user_id) SELECT w.contig, win, n, gene FROM w JOIN g ON w.contig = g.contig AND win >= s // 1440 AND win <= (e - 1) // 1440")
def genes_in_windows(s, d):
    ev = t(s, d, "events")
    m = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    g = ev.groupBy("user_id").agg(F.min(m).alias("start"), (F.max(m) + 1).alias("end")).select((F.col("user_id") % 10).alias("contig"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("gene"), "start", "end")
    return P.genes_in_windows(gmap(s, d).select("contig", "win", "n"), g, 1440)


@q("spearman", f"WITH {MAP}, r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM w) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r")
def spearman(s, d):
    return P.spearman(gmap(s, d), "a", "b").select(*r6("rho"), "n")


@q("deviation_profile", "WITH m AS (SELECT l_suppkey AS contig, l_partkey AS pos, l_orderkey % 3 AS image_idx, l_linenumber AS w, median(l_discount - l_tax) AS d FROM lineitem GROUP BY ALL) SELECT contig, pos + w AS pos, round(avg(d), 6) AS deviation, count(*) AS n FROM m GROUP BY ALL")
def deviation_profile(s, d):
    li = t(s, d, "lineitem").select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos"), (F.col("l_orderkey") % 3).alias("image_idx"), F.col("l_linenumber").alias("w"), (F.col("l_discount") - F.col("l_tax")).alias("delta"))
    return P.deviation_profile(li).select("contig", "pos", *r6("deviation"), "n")


# scores are exact to six places, so differences are whole numbers of millionths; means are rounded half up to four places
@q("offset_scan", f"WITH {SCORES}, d AS (SELECT contig, pos, CAST(sum(CAST(round(score * 1000000) AS BIGINT) * CASE WHEN strand = '+' THEN 1 ELSE -1 END) AS BIGINT) AS d FROM scores GROUP BY ALL), h AS (SELECT DISTINCT p_brand AS motif, s_suppkey AS contig, p_partkey AS pos, p_size % 4 AS \"offset\" FROM part, supplier WHERE s_suppkey % 10 = 1), g AS (SELECT motif, \"offset\", CAST(sum(d) AS BIGINT) AS t, count(*) AS n FROM h JOIN d USING (contig, pos) GROUP BY ALL HAVING count(*) >= 5) SELECT motif, \"offset\", (2 * t + 100 * n - ((2 * t + 100 * n) % (200 * n) + 200 * n) % (200 * n)) // (200 * n) / 10000 AS mean, n, round((t / n - (SELECT avg(d) FROM d)) / ((SELECT stddev_pop(d) FROM d) / sqrt(n)), 3) AS z FROM g")
def offset_scan(s, d):
    whole = F.round(F.col("score") * 1_000_000).cast("long")
    diff = scores(s, d).groupBy("contig", "pos").agg(F.sum(F.when(F.col("strand") == "+", whole).otherwise(-whole)).alias("d"))
    p = t(s, d, "part").select(F.col("p_brand").alias("motif"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 4).alias("offset"))
    h = p.join(diff.where("contig % 10 = 1").select("contig", "pos"), "pos").distinct()
    x, m = 2 * F.round(F.col("mean") * F.col("n")).cast("long") + 100 * F.col("n"), 200 * F.col("n")
    return P.offset_scan(diff, h, 5).select("motif", "offset", ((x - F.pmod(x, m)) / m / 10000).alias("mean"), "n", F.round("z", 3).alias("z"))


@q("image_summary", "SELECT l_suppkey AS contig, count(*) AS n_reads, round(avg(CASE WHEN l_tax > 0.01 THEN l_discount END), 6) AS a_mean, round(CASE WHEN stddev_pop(CASE WHEN l_tax > 0.01 THEN l_discount END) > 1e-12 THEN stddev_pop(CASE WHEN l_tax > 0.01 THEN l_discount END) ELSE 1 END, 6) AS a_sd, round(avg(l_quantity), 6) AS b_mean, round(stddev_pop(l_quantity), 6) AS b_sd FROM lineitem GROUP BY ALL")
def image_summary(s, d):
    li = t(s, d, "lineitem").select(F.col("l_suppkey").alias("contig"), F.when(F.col("l_tax") > 0.01, F.col("l_discount")).alias("a"), F.col("l_quantity").alias("b"))
    return P.image_summary(li, ["contig"], ["a", "b"]).select("contig", "n_reads", *r6("a_mean", "a_sd", "b_mean", "b_sd"))


@q("kmer_center", "WITH p AS (SELECT l_suppkey AS read_id, l_linenumber % 3 AS \"offset\", l_discount AS o, l_tax + l_discount * (l_linenumber % 3) AS e FROM lineitem), c AS (SELECT \"offset\", read_id, corr(o, e) AS r FROM p GROUP BY ALL HAVING count(*) >= 10), g AS (SELECT \"offset\", avg(r) AS r FROM c GROUP BY ALL) SELECT arg_max(\"offset\", (r, -\"offset\")) AS \"offset\", round(max(r), 6) AS r FROM g")
def kmer_center(s, d):
    m = F.col("l_linenumber") % 3
    li = t(s, d, "lineitem").select(F.col("l_suppkey").alias("read_id"), m.alias("offset"), F.col("l_discount").alias("observed"), (F.col("l_tax") + F.col("l_discount") * m).alias("expected"))
    return P.kmer_center(li).select("offset", *r6("r"))


@q("evaluate_sites", f"WITH {CALLS}, s AS (SELECT DISTINCT contig, pos FROM calls WHERE pos % 2 = 0), tr AS (SELECT DISTINCT contig, pos FROM calls WHERE label = 1), a AS (SELECT contig, pos, avg(prob) AS score FROM calls WHERE pos % 2 = 0 GROUP BY ALL), d AS (SELECT a.contig, CASE WHEN tr.pos IS NULL THEN 0 ELSE 1 END AS label, round(score, 9) AS score FROM a LEFT JOIN tr USING (contig, pos)), {CUM}, {AUC} SELECT contig, n_pos, round(auroc, 6) AS auroc FROM auc")
def evaluate_sites(s, d):
    c = dealt(s, calls(s, d), t(s, d, "lineitem").count(), "contig", "pos")
    a = c.groupBy("contig", "pos").agg(F.round(F.avg("prob"), 9).alias("prob"))
    m = P.evaluate_sites(c.where("pos % 2 = 0").select("contig", "pos").distinct(), c.where("label = 1"), a, ["contig"])
    return m.select("contig", "n_pos", *r6("auroc"))


@q("row_model_grid", f"WITH {CELLS}, m AS (SELECT DISTINCT model, family FROM cells), r AS (SELECT r_regionkey AS \"row\", r_name AS name FROM region) SELECT \"row\", name, m.model, m.family, n_name AS claim FROM r, m LEFT JOIN (SELECT DISTINCT model, n_name FROM cells JOIN nation ON n_nationkey = \"row\") c ON m.model = c.model")
def row_model_grid(s, d):
    c = cells(s, d)
    n = t(s, d, "nation")
    claims = c.join(n, n.n_nationkey == c.row).select("model", F.col("n_name").alias("claim")).distinct()
    rows = t(s, d, "region").select(F.col("r_regionkey").alias("row"), F.col("r_name").alias("name"))
    return P.row_model_grid(rows, c.select("model", "family").distinct(), claims)


@q("owns", "WITH r AS (SELECT r_name, [r_name[1], r_name[2]] AS marks, CASE WHEN r_regionkey % 2 = 0 THEN 'CpG' ELSE 'CHG' END AS ctx FROM region), m AS (SELECT n_name, [n_name[1], n_name[3]] AS mm, CASE WHEN n_nationkey % 2 = 0 THEN 'CpG' ELSE 'any' END AS mc FROM nation) SELECT r_name, n_name, list_has_any(marks, mm) AND NOT (mc = 'CpG' AND ctx <> 'CpG') AS own FROM r, m")
def owns(s, d):
    r = t(s, d, "region").select("r_name", F.array(F.substring("r_name", 1, 1), F.substring("r_name", 2, 1)).alias("marks"), F.when(F.col("r_regionkey") % 2 == 0, "CpG").otherwise("CHG").alias("ctx"))
    m = t(s, d, "nation").select("n_name", F.array(F.substring("n_name", 1, 1), F.substring("n_name", 3, 1)).alias("mm"), F.when(F.col("n_nationkey") % 2 == 0, "CpG").otherwise("any").alias("mc"))
    return r.join(F.broadcast(m)).select("r_name", "n_name", P.owns(F.col("mm"), F.col("marks"), F.col("mc"), F.col("ctx")).alias("own"))


@q("applicable", "WITH r AS (SELECT n_name AS rw, CAST(n_nationkey % 7 AS VARCHAR) AS base, CASE WHEN n_nationkey % 2 = 0 THEN 'CpG' ELSE 'CHG' END AS context FROM nation), m AS (SELECT r_name AS model, [CAST(r_regionkey AS VARCHAR), CAST(r_regionkey + 1 AS VARCHAR)] AS bases, CASE WHEN r_regionkey % 2 = 0 THEN 'CpG' ELSE 'any' END AS mc FROM region) SELECT rw, model FROM r, m WHERE list_contains(bases, base) AND (mc = 'any' OR mc = context)")
def applicable(s, d):
    r = t(s, d, "nation").select(F.col("n_name").alias("rw"), (F.col("n_nationkey") % 7).cast("string").alias("base"), F.when(F.col("n_nationkey") % 2 == 0, "CpG").otherwise("CHG").alias("context"))
    k = F.col("r_regionkey")
    m = t(s, d, "region").select(F.col("r_name").alias("model"), F.array(k.cast("string"), (k + 1).cast("string")).alias("bases"), F.when(k % 2 == 0, "CpG").otherwise("any").alias("model_context"))
    return P.applicable(r, m).select("rw", "model")


@q("upsert", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'X', 0.0 FROM orders WHERE o_orderkey % 10 = 0")
def upsert(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 10 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)})
    return sinks.upsert(o, new, ["o_orderkey"])


@q("chunk_ids", f"WITH {SITES}, n AS (SELECT (count(*) + 6) // 7 AS size FROM sites WHERE strand = '+'), r AS (SELECT *, row_number() OVER (ORDER BY pos, contig) - 1 AS rn FROM sites WHERE strand = '+') SELECT contig, pos, CAST(rn // size AS INTEGER) AS chunk FROM r, n")
def chunk_ids(s, d):
    return sinks.chunk_ids(sites(s, d).where("strand = '+'").select("contig", "pos"), 7, ["contig", "pos"])


@q("manifest", None)
def manifest(s, d):
    return sinks.manifest(t(s, d, "lineitem"))
