"""Hand-made micro-tables and properties."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegrid.functions import scalar, seq
from sitegrid.operators import aggregate, labels, ranges, ranking, reads, report, rows as bench_rows, sampling, splits
from sitegrid.plans.queries import QUERIES
from sitegrid.sources import sinks, text
from sitegrid.streaming.calls import aggregate_calls_stream

SF = "/root/testdata/sf0.001"
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@FEW
@given(st.sets(st.integers(0, 60), max_size=30))
def test_intervals_and_positions_are_inverse(spark, positions):
    d = spark.createDataFrame([(1, p) for p in positions], "contig long, pos long")
    iv = ranges.to_intervals(d, ["contig"])
    back = iv.select("contig", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    assert rows(back) == sorted((1, p) for p in positions)


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 90)), max_size=25), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 80), st.integers(0, 30)), max_size=8))
def test_bin_join_is_the_nested_loop(spark, sites, iv):
    s = spark.createDataFrame(sites, "contig long, pos long")
    i = spark.createDataFrame([(c, a, a + n) for c, a, n in iv], "contig long, start long, end long")
    inside = [(c, p) for c, p in sites if any(c == x and a <= p < a + n for x, a, n in iv)]
    assert rows(ranges.include_regions(s, i, width=16)) == sorted(inside)
    assert len(inside) + ranges.exclude_regions(s, i, width=16).count() == len(sites)


@FEW
@given(st.lists(st.integers(0, 200), max_size=12), st.lists(st.integers(0, 200), max_size=12))
def test_nearest(spark, a, b):
    s = spark.createDataFrame([(1, x) for x in set(a)], "contig long, pos long")
    r = spark.createDataFrame([(1, x) for x in b], "contig long, pos long")
    got = {x.pos: x.distance for x in ranges.nearest_distance(s, r, 32).collect()}
    assert got == {x: min((abs(x - y) for y in b), default=None) for x in set(a)}


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=30))
def test_auroc_counts_pairs(spark, xs):
    pos, neg = [x for y, x in xs if y], [x for y, x in xs if not y]
    got = ranking.auroc(spark.createDataFrame([(1, y, float(x)) for y, x in xs], "g int, y int, s double"), "y", "s", ["g"]).first().auroc
    if not pos or not neg:
        assert got is None
    else:
        assert got == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))


@pytest.mark.parametrize("n", [1, 2, 7])
def test_partitioning_changes_nothing(spark, n):
    d = spark.range(500).select(F.col("id").alias("read_id"), (F.col("id") % 7).alias("contig"), (F.col("id") % 11).alias("pos"), F.lit("+").alias("strand")).repartition(n)
    a = rows(reads.select_reads(d, 2, 3, ["contig", "pos", "strand"]))
    b = rows(reads.select_reads(d.coalesce(1), 2, 3, ["contig", "pos", "strand"]))
    assert a == b


def test_motifs_over_chunk_seams(spark):
    rng = random.Random(4)
    s = "".join(rng.choice("ACGT") for _ in range(500))
    got = rows(seq.motif_sites(spark.createDataFrame([(1, s)], "contig long, seq string"), "GATC", 1, chunk=37))
    want = [(1, i + 1, "+") for i in range(497) if s[i : i + 4] == "GATC"] + [(1, i + 2, "-") for i in range(497) if s[i : i + 4] == "GATC"]
    assert got == sorted(want)


def test_empty_sequences_and_intervals(spark):
    none = spark.createDataFrame([], "contig long, seq string")
    assert seq.motif_sites(none, "CG", 0).count() == 0
    assert seq.motif_sites(spark.createDataFrame([(1, ""), (2, None)], "contig long, seq string"), "CG", 0).count() == 0
    empty = spark.createDataFrame([(1, 5, 5)], "contig long, start long, end long")
    assert ranges.include_regions(spark.createDataFrame([(1, 5)], "contig long, pos long"), empty).count() == 0


def test_revcomp_and_iupac(spark):
    d = spark.createDataFrame([("ACGTN",)], "s string").select(scalar.revcomp(F.col("s")).alias("r"))
    assert d.first().r == "NACGT"
    assert scalar.iupac_regex("CNG") == "C[ACGT]G"


def test_context_at_the_ends(spark):
    ref = spark.createDataFrame([(1, "ACG")], "contig long, seq string")
    s = spark.createDataFrame([(1, 0, "+"), (1, 2, "-"), (1, 9, "+")], "contig long, pos long, strand string")
    assert sorted((r.pos, r.context) for r in seq.context(s, ref, 2).collect()) == [(0, "NNACG"), (2, "NNCGT")]


def test_duplicate_scores_are_an_error(spark):
    s = spark.createDataFrame([(1, 2, "+")], "contig long, pos long, strand string")
    x = spark.createDataFrame([(1, 2, "+", 1.0, 1, 1)] * 2, "contig long, pos long, strand string, sum_p double, n_called long, n_mod long")
    with pytest.raises(Exception, match="duplicate site"):
        labels.site_scores(s, x, ["contig", "pos", "strand"], 20).collect()


def test_leakage_guard(spark):
    a = spark.range(5)
    splits.assert_disjoint(a, spark.range(5, 9), ["id"])
    with pytest.raises(ValueError):
        splits.assert_disjoint(a, spark.range(4, 9), ["id"])


def test_splits_keep_positions_together(spark):
    d = spark.range(300).select((F.col("id") % 100).alias("pos"), F.lit(1).alias("contig"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    s = splits.split_positions(d, ["contig", "pos"], 0.1, 0.2, 1)
    assert s.count() == 300
    assert s.groupBy("pos").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0


def test_subset_folds():
    assert len(splits.subset_folds(["a", "b", "c", "d", "e"])) == 25


def test_balanced_draws_and_oversample(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v long")
    got = sampling.balanced_draws(d, ["k"], ["v"], 4, 1)
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == {"a": 4, "b": 4}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 note\nACG\nT\n>c2\nGG\n")
    assert rows(text.read_fasta(spark, str(tmp_path / "r.fa"))) == [("c1", "ACGT"), ("c2", "GG")]
    (tmp_path / "s.bed").write_text("#x\nc1\t5\t6\nc1\t5\t6\n\nc2\tbad\n")
    assert rows(text.parse_sites(text.lines(spark, str(tmp_path / "s.bed")))) == [("c1", 5)]
    d = spark.createDataFrame([("c1", 3, 0.5, 1, 9)], "contig string, pos long, score double, label int, n_reads long")
    sinks.write_track(d, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 1
    sinks.write_gt(d, d, str(tmp_path / "g"))
    assert text.parse_sites(text.lines(spark, str(tmp_path / "g" / "gt.bed"))).count() == 1
    sinks.write_chunks(d.unionByName(d.withColumn("pos", F.lit(8).cast("long"))), 2, ["contig", "pos"], str(tmp_path / "c"))
    m = sinks.manifest(d)
    sinks.verify_manifest(d, m)
    with pytest.raises(ValueError):
        sinks.verify_manifest(d.union(d), m)


def test_logits_become_probabilities(spark):
    d = spark.createDataFrame([(0.3,), (2.0,), (-2.0,)], "x double").select(F.round(scalar.to_probability(F.col("x")), 4))
    assert [r[0] for r in d.collect()] == [0.3, 0.8808, 0.1192]


def test_stream_equals_batch(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, id AS read_id, id % 3 AS contig, id % 2 AS pos, '+' AS strand, id / 10.0D AS prob FROM range(10)").write.parquet(str(tmp_path / "in"))
    b = spark.read.parquet(str(tmp_path / "in"))
    q = aggregate_calls_stream(spark.readStream.schema(b.schema).parquet(str(tmp_path / "in")), "ts").writeStream.format("memory").queryName("agg").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("agg").drop("w")) == rows(aggregate_calls_stream(b, "ts").drop("w"))


def test_pending_poisons_the_family(spark):
    c = spark.createDataFrame([(1, "f", "a", 0.5), (1, "f", "b", None), (2, "f", "a", 0.7)], "row int, family string, model string, auroc double")
    assert {r.row: r.auroc for r in report.family_table(c).collect()} == {1: None, 2: 0.7}


def test_each_order_of_a_customer_with_events_is_a_read(spark):
    o, e = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("orders", "events"))
    want = {r.o_orderkey: r.n for r in o.join(e.groupBy("user_id").agg(F.count("*").alias("n")), o.o_custkey == F.col("user_id")).select("o_orderkey", "n").collect()}
    assert len(want) > 100 and {r.read_id: r.n_samples for r in QUERIES["segments"](spark, SF).collect()} == want


def test_the_sequence_null_takes_every_site(spark):
    letters = [re.sub("[^ACGT]", "", (r.text or "").upper()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["sequence_null"](spark, SF).first()
    assert (got.n_pos, got.n_pos + got.n_neg) == (2 * sum(x.count("CG") for x in letters), sum(x.count("C") + x.count("G") for x in letters))


def test_row_numbers_by_hash_bucket_are_those_of_one_window(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    got = ranking.numbered(d, ["g"], scalar.hash_key(1, "id"), "id")
    want = {r.id: (r.rn, r.n) for r in d.selectExpr("id", "row_number() OVER (PARTITION BY g ORDER BY md5(concat('1:', id))) AS rn", "count(*) OVER (PARTITION BY g) AS n").collect()}
    assert {r.id: (r._rn, r._n) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["split_positions", "bootstrap_auroc", "channel_importance"])
def test_no_window_orders_a_whole_stratum(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
    windows = [x for x in plan.splitlines() if "Window [row_number()" in x]
    assert windows and all("_b#" in x for x in windows)


def test_lowest_reads_come_from_pieces(spark):
    rng = random.Random(4)
    aln = [(i, 1, "+", a, a + rng.choice([0, 1, 7, 64, 300])) for i in range(60) for a in [rng.randrange(-50, 400)]]
    a = spark.createDataFrame(aln + aln[:9], "read_id long, contig long, strand string, start long, end long")
    s = spark.createDataFrame([(1, "+", p) for p in range(-60, 500, 7)], "contig long, strand string, pos long")
    pairs = reads.covering(a, s).distinct()
    names = ["read_id", "contig", "pos", "strand"]
    site = names[1:]
    assert rows(reads.cap_covering(a, s, 2, 5).select(names)) == rows(reads.cap_reads(pairs, site, 2, 5).select(names))
    for width in (1, 8, 1024):
        assert rows(reads.select_covering(a, s, 3, 7, width)) == rows(reads.select_covering(a, s, 3, 7))
    assert rows(reads.partition_covering(a, s, 2, 4, 3)) == rows(reads.partition_reads(pairs, site, 2, 4, 3))
    hp = a.withColumn("hp", F.when(F.col("read_id") % 3 > 0, (F.col("read_id") % 3).cast("int")))
    p = pairs.join(hp.select("read_id", "hp").distinct(), "read_id").withColumn("start", F.col("pos"))
    assert sorted(map(str, reads.order_covering(hp, s, 16).select(*site, "rows").collect())) == sorted(map(str, reads.order_rows(p, site).select(*site, "rows").collect()))


def test_a_sites_reads_are_filtered_once(spark):
    s = spark.createDataFrame([(1, p, "+") for p in (0, 5, 9, 10, 40, 300)], "contig long, pos long, strand string")
    one = [(i, 1, "+", 0, 6 + i % 7, i % 3) for i in range(12)]
    for aln in (one, one + one[:5] + [(0, 1, "+", 3, 41, 0), (0, 1, "+", 5, 20, 7)]):  # each read once, and some of them twice
        a = spark.createDataFrame(aln, "read_id long, contig long, strand string, start long, end long, hp int")
        got = reads.order_covering(a, s)
        want = {p: sorted({(h, str(i)) for i, _, _, lo, hi, h in aln if lo <= p < hi}) for p in (0, 5, 9, 10, 40, 300)}
        assert {r.pos: [(x.hp, x.read_id) for x in r.rows] for r in got.collect()} == {p: w for p, w in want.items() if w}
        assert got._jdf.queryExecution().optimizedPlan().toString().count("filter(_a#") == 1


def test_letters_and_positions_as_bits(spark):
    rng = random.Random(5)
    texts = ["", "A", "A" * 64, "T" * 63 + "A", "A" + "T" * 63, "NA", "\U0001d400A", "1A1"] + ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(65))) for _ in range(40)]
    bits = lambda places: sum(1 << i for i in places) - (1 << 64 if 63 in places else 0)
    got = spark.createDataFrame([(x,) for x in texts], "seq string").select("seq", seq.letter_bits("A").alias("a"), seq.letter_bits("GT").alias("gt")).collect()
    assert all(r.a == bits({i for i, x in enumerate(r.seq) if x == "A"}) and r.gt == bits({i for i, x in enumerate(r.seq) if x in "GT"}) for r in got)
    at = [-65, -64, -1, 0, 63, 64, 200, 200, 70_000]
    over = [(0, 64), (63, 65), (-9, 3), (100, 100), (90, 80), (65_000, 70_000), (69_999, 70_001)]
    pts = spark.createDataFrame([(1, p) for p in at], "contig long, pos int")
    iv = spark.createDataFrame([(1, lo, hi) for lo, hi in over] + [(2, None, 4)], "contig long, start long, end long")
    m = ranges.marks(ranges.point_bits(pts, p=F.lit(True), odd=F.col("pos") % 2 == 1), ranges.span_bits(iv, s=F.lit(True))).collect()
    places = {c: {r["_w"] * 64 + i for r in m for i in range(64) if r[c] >> i & 1} for c in ("p", "odd", "s")}
    assert places == {"p": set(at), "odd": {63}, "s": {x for lo, hi in over for x in range(max(0, lo), hi)}}


@pytest.mark.parametrize("base", ["A", "N"])
def test_row_sites_meet_the_reference_as_bits(spark, base):
    rng = random.Random(6)
    ref = spark.createDataFrame([(i, "".join(rng.choice("ACGTNacgt") for _ in range(n))) for i, n in enumerate((0, 1, 64, 65, 700))] + [(4, "A" * 70), (None, "A"), (9, None)], "contig long, seq string")
    at = lambda k, lo: spark.createDataFrame([(rng.randrange(5), rng.randrange(lo, 720)) for _ in range(k)] + [(None, 1), (9, 0)], "contig long, pos long")
    cand, truth, seen = at(900, -70), at(300, -70), at(200, 0)
    spans = spark.createDataFrame([(c, x, a, a + rng.randrange(200)) for c in range(5) for x in "+-" for a in [rng.randrange(-30, 600) for _ in range(4)]], "contig long, strand string, start long, end long")
    site = ["contig", "pos", "strand"]
    every = lambda d: ranges.scorable(seq.assign_strand(d.distinct(), ref, base).select(*site), spans)
    d = labels.label_sites(every(cand), truth, ["contig", "pos"])
    one = d.where("label = 1").unionByName(sampling.sample_uniform(d.where("label = 0"), 20, site, 5))
    gone = lambda x: x.join(seen.distinct(), ["contig", "pos"], "left_anti")
    two = every(cand).withColumn("label", F.lit(1)).unionByName(every(truth).withColumn("label", F.lit(0)))
    for s, cut in ((None, lambda x: x), (seen, gone)):
        got = bench_rows.row_sites_one(truth, cand, ref, base, spans, 20, 5, s)
        assert rows(got.select(*site, "label")) == rows(cut(one).select(*site, "label"))
        assert rows(bench_rows.row_sites_two(cand, truth, ref, base, spans, spans, s).select(*site, "label")) == rows(cut(two).select(*site, "label"))
        joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in f" {x.strip()} "]
        assert not any("pos#" in x for x in joins)


def test_calls_and_their_flanks_as_bits(spark):
    at = [-70, -64, 0, 2, 63, 64, 130, 191, 192]
    pts = spark.createDataFrame([(1, p, "+" if p % 2 else "-") for p in at + [64]] + [(None, 3, "+"), (2, None, "+")], "contig long, pos int, strand string")
    for flank in (0, 3, 70):
        m = ranges.marks(ranges.near_bits(pts, flank, "near", p=F.lit(True), plus=F.col("strand") == "+")).where("contig = 1").collect()
        places = {c: {r["_w"] * 64 + i for r in m for i in range(64) if r[c] >> i & 1} for c in ("near", "p", "plus")}
        assert places == {"near": {x for p in at for x in range(p - flank, p + flank + 1)}, "p": set(at), "plus": {63, 191}}


def test_kinetic_calls_meet_the_reference_as_bits(spark):
    plan = QUERIES["kinetics_discovered"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and not any("pos#" in x for x in joins)


def test_intervals_are_merged_in_bins(spark):
    iv = spark.createDataFrame([(1, 0, 5), (1, 3, 9), (1, 9, 20), (1, 40, 40), (1, 3, 9)] + [(1, 50, 60)] * 500, "contig long, start long, end long")
    got = sorted((r["_b"], r["_s"], r["_e"]) for r in ranges.merged(iv, ["contig"], 16).collect())
    assert got == [(0, 0, 16), (1, 16, 20), (3, 50, 60)]


def test_contexts_of_a_base_are_contexts_of_its_sites(spark):
    rng = random.Random(2)
    ref = spark.createDataFrame([(i, "".join(rng.choice("ACGTN") for _ in range(n))) for i, n in enumerate((0, 1, 5, 199, 200, 201, 950))], "contig long, seq string")
    want = seq.context(seq.base_sites(ref, "A"), ref, 3).select("contig", "pos", "strand", "context")
    assert rows(seq.base_contexts(ref, "A", 3)) == rows(want)
    assert rows(seq.chunked(ref, 3, 200_000)) == rows(seq.chunked(ref, 3))
    assert "Join" not in seq.base_contexts(ref, "A", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert seq.context(seq.base_sites(ref, "A"), ref, 3)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_windows_of_equal_values_tie(spark):
    values = [0.1, 0.7, 0.3, 0.2, 0.6, 0.11254, 1e9, -1e9]
    d = [(c, i, v, 1) for c in range(40) for i, v in enumerate(random.Random(c).sample(values, len(values)))]
    got = aggregate.window_track(spark.createDataFrame(d, "contig long, pos long, a double, n_reads int").repartition(7), 10, ["a"])
    assert len({r.a for r in got.collect()}) == 1
    none = aggregate.window_track(spark.createDataFrame([(1, 1, None, 1)], "contig long, pos long, a double, n_reads int"), 10, ["a"]).first()
    assert none.a is None and none.n == 1


def test_scores_are_shuffled_once(spark):
    from sitegrid.plans import core, q_tables

    count = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert count(core.scores(spark, SF)) == 1
    _, _, sites, scores, _, _ = q_tables.inputs(spark, SF)
    assert count(sites) == count(scores) == 1
    assert count(scores.groupBy("sample", "contig", "pos", "strand").count().join(sites, ["sample", "contig", "pos", "strand"])) == 2


def test_pooled_audit_counts_equal_scores_first(spark):
    rng = random.Random(5)
    d = [(rng.choice("ab"), rng.randrange(4), rng.choice([0, 1, None]), rng.choice([None, 0.1, 0.4, 0.5, 0.9])) for _ in range(600)]
    pool = spark.createDataFrame(d, "strand string, row int, label int, score double")
    want = ranking.auroc_without(ranking.rank_calibrate(pool, "score", ["strand"]), "label", "calibrated", ["strand"], "row")
    got = report.audit_pooled(pool, "row", ["strand"])
    line = lambda r: (r.strand, r.left_out, r.n_pos, r.n_neg, round(r.auroc, 12))
    assert sorted(map(line, got.collect())) == sorted(map(line, want.collect()))
    counts = report.ranking.rank_calibrate_counts(spark.createDataFrame([(1, 0.5, 3), (1, 0.7, 1)], "g int, score double, k long"), ["g"])
    assert {r.score: r.calibrated for r in counts.collect()} == {0.5: 0.5, 0.7: 1.0}
