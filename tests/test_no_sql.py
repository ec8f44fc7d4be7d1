"""Queries and operators that SQL can't express, against NumPy or plain Python."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrid.operators import ranges, ranking, reads, sampling, splits, tables
from sitegrid.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    p, n = s[y == 1], s[y == 0]
    return float(np.mean((p[:, None] > n) + 0.5 * (p[:, None] == n))) if len(p) and len(n) else None


def test_hash_split_is_crc32(spark):
    got = QUERIES["hash_split"](spark, SF).collect()
    share = lambda r: zlib.crc32(f"5:{r.contig}:{r.pos}".encode()) / 4294967295
    assert got and all(r.role == ("test" if share(r) < 0.2 else "train") for r in got)


def test_nearest_distance_is_that_of_brute_force(spark):
    rng = random.Random(1)
    for width in (16, 1 << 16):
        sites = [(rng.choice("ab") if k else "c", rng.randint(0, 300)) for k in range(80)]
        ref = [(rng.choice("ab"), rng.randint(0, 300)) for _ in range(12)]
        d = ranges.nearest_distance(spark.createDataFrame(sites, "contig string, pos long"), spark.createDataFrame(ref, "contig string, pos long"), width)
        for r in d.collect():
            assert r.distance == min((abs(p - r.pos) for c, p in ref if c == r.contig), default=None)


def test_intervals_join_across_bins(spark):
    rng = random.Random(2)
    at = sorted({rng.randint(0, 120) for _ in range(90)})
    want, start = [], None
    for k, p in enumerate(at):
        start = p if start is None else start
        if k + 1 == len(at) or at[k + 1] != p + 1:
            want.append((start, p + 1))
            start = None
    for width in (1, 4, 7, 64, 1 << 16):
        got = ranges.to_intervals(spark.createDataFrame([("x", p) for p in at], "contig string, pos long"), ["contig"], width).collect()
        assert sorted((r.start, r.end) for r in got) == want, width


def test_reads_with_two_alignments_count_once(spark):
    aln = spark.createDataFrame([(1, "x", "+", 0, 50), (1, "x", "+", 40, 90), (2, "x", "+", 0, 90), (2, "x", "+", 0, 90), (3, "x", "-", 0, 90)], "read_id long, contig string, strand string, start long, end long")
    sites = spark.createDataFrame([("x", "+", 45), ("x", "+", 45), ("x", "+", 80)], "contig string, strand string, pos long")
    a = reads.select_covering(aln, sites, 5, 1).select("read_id", "pos", "rank").collect()
    b = reads.select_reads(reads.covering(aln, sites), 5, 1, ["contig", "pos", "strand"]).select("read_id", "pos", "rank").collect()
    assert sorted(a) == sorted(b) and sorted((r.read_id, r.pos) for r in a) == [(1, 45), (1, 80), (2, 45), (2, 80)]


def test_metrics_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(y), float(np.round(rng.normal(y * 0.5), 1)), int(rng.integers(3))) for g in range(3) for y in rng.integers(0, 2, 80)]
    rows += [(9, 1, 0.7, 0), (9, 1, 0.2, 1), (8, 0, 0.9, 0), (8, 0, 0.1, 1)]  # one class only
    d = spark.createDataFrame(rows, "g int, label int, score double, part int")
    m = {r.g: r for r in ranking.binary_metrics(d, "label", "score", ["g"]).collect()}
    areas = {r.g: r for r in ranking.areas(d, "label", "score", ["g"]).collect()}
    out = {(r.g, r.left_out): r for r in ranking.auroc_without(d, "label", "score", ["g"], "part").collect()}
    med = {r.g: r.median for r in ranking.median(d, "score", ["g"]).collect()}
    for g in m:
        y = np.array([r[1] for r in rows if r[0] == g])
        s = np.array([r[2] for r in rows if r[0] == g])
        part = np.array([r[3] for r in rows if r[0] == g])
        assert m[g].n_test == len(y) and m[g].n_pos == y.sum() and med[g] == pytest.approx(np.median(s))
        for got in (m[g].auroc, areas[g].auroc):
            assert got == (None if auc(y, s) is None else pytest.approx(auc(y, s)))
        for p in set(part.tolist()):
            want = auc(y[part != p], s[part != p])
            assert out[g, p].auroc == (None if want is None else pytest.approx(want))
        hit = s >= m[g].threshold
        tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
        assert m[g].mod_f1 == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0)
    assert m[9].threshold == m[8].threshold == 0.5 and m[9].mod_rec == 0.5 and m[8].unmod_f1 == pytest.approx(2 / 3)


def test_bootstrap_holds_the_auroc(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.normal(y * 1.0), 2)
    d = spark.createDataFrame([(int(a), float(b), k % 4) for k, (a, b) in enumerate(zip(y, s))], "label int, score double, row int")
    r = sampling.bootstrap_auroc(d, "label", "score", ["row"], 60, 1).first()
    assert r.lo < auc(y, s) < r.hi and r.hi - r.lo < 0.15 and r.lo <= r.mid <= r.hi


def test_resamples_keep_strata_and_copy_no_row(spark):
    rows = [(k % 3 if k % 3 else None, (k // 5) % 2, float(k % 7) if k % 11 else None) for k in range(900)]
    d = spark.createDataFrame(rows, "row int, label int, score double")
    got = sampling.drawn_counts(d, "label", "score", ["row"], 50, 2, block=4)
    per = {(r.row, r.replicate): r.k for r in got.groupBy("row", "replicate").agg(F.sum("k").alias("k")).collect()}
    assert len(per) == 150 and set(per.values()) == {300}
    want = {(r.row, r.label, r.score): r["count"] for r in d.groupBy("row", "label", "score").count().collect()}
    mean = {(r.row, r.label, r.score): r.k / 50 for r in got.groupBy("row", "label", "score").agg(F.sum("k").alias("k")).collect()}
    assert mean.keys() == want.keys() and all(abs(mean[x] - want[x]) < 5 * (want[x] / 50) ** 0.5 for x in want)
    again = sampling.drawn_counts(d.repartition(5), "label", "score", ["row"], 50, 2, block=4)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan


def test_samples_sort_few_rows_and_hold_the_smallest(spark):
    d = spark.range(5000).withColumnRenamed("id", "k")
    from sitegrid.functions.scalar import hash_key

    want = [r.k for r in d.orderBy(hash_key(3, "k"), "k").limit(70).collect()]
    assert [r.k for r in sampling.sample_uniform(d, 70, ["k"], 3).collect()] == want
    assert sampling.sample_uniform(d.limit(5), 70, ["k"], 3).count() == 5
    assert sampling.sample_uniform(d.limit(0), 70, ["k"], 3).count() == 0 and sampling.sample_uniform(d, 0, ["k"], 3).count() == 0


def test_base_ratio_thins_the_first_base(spark):
    rows = [("x", k, "A" if k % 5 else "C", 1, "6mA" if k % 5 else "5mC", "o", "m", False) for k in range(2000)] + [("y", k, "A", 0, None, "o", "m", k % 2 == 0) for k in range(50)]
    d = spark.createDataFrame(rows, "contig string, pos long, base string, label int, chem string, organism string, member string, in_region boolean")
    n = {(r.base, r.label): r["count"] for r in splits.fold(d, "all", base_ratio=1.0).groupBy("base", "label").count().collect()}
    assert n["C", 1] == 400 and 340 < n["A", 1] < 460 and n["A", 0] == 50
    roles = {(r.chem, r.role) for r in splits.fold(d, "subset_6mA").select("chem", "role").distinct().collect()}
    assert roles == {("6mA", "train"), ("5mC", "test"), (None, "train"), (None, "test")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) & {"probe", "project", "cluster_report", "forest_importance", "fit_site_model", "sequence_null", "leave_one_dataset_out_model", "discover_motifs", "screened_candidates", "holdout_regions", "build_pileups"}))
def test_same_rows_under_any_partitioning(spark, name):
    """What SQL can't hold against them: rows come, and the same ones whatever the number of partitions."""
    got = []
    for n in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        p = QUERIES[name](spark, SF).toPandas()
        got.append(sorted(tuple(round(v, 3) if isinstance(v, float) else str(v) for v in r) for r in p.itertuples(index=False)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] and len(got[0]) == len(got[1])
    if name in ("screened_candidates", "holdout_regions", "build_pileups", "discover_motifs", "project"):
        assert got[0] == got[1]


def test_a_site_meets_its_scores_once(spark):
    site = ("s", 1, 7, "+")
    sites = spark.createDataFrame([("r", *site, 1, True), ("r", "s", 1, 8, "-", 0, False)], "row string, sample string, contig long, pos long, strand string, label int, is_cpg boolean")
    scores = spark.createDataFrame([("a", *site, 4.0), ("b", *site, 6.0), ("c", *site, -2.0)], "model string, sample string, contig long, pos long, strand string, sum_p double")
    use = spark.createDataFrame([("k", "r", x, m) for x, ms in (("ab", "ab"), ("c", "c"), ("cd", "cd")) for m in ms], "kind string, row string, column string, model string")
    d = tables.cell_scores(sites, scores, tables.models_of(use), 2)
    got = {(r["column"], r.pos): r.score for r in d.collect()}
    assert got == {("ab", 7): 3.0, ("c", 7): -1.0, ("cd", 7): 0.0, ("ab", 8): 0.0, ("c", 8): 0.0, ("cd", 8): 0.0}
