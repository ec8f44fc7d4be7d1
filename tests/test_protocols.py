"""Kinetic rows against a plain search over a planted genome; few shots, pools and reports on small tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitegrid.operators import kinetics as N
from sitegrid.operators import protocols as P

SITE = ["contig", "pos", "strand"]
COMP = str.maketrans("ACGTN", "TGCAN")


def occurrences(ref, kmer, off):
    out = set()
    for c, s in ref.items():
        for strand, x in (("+", s), ("-", s.translate(COMP)[::-1])):
            out |= {(c, p if strand == "+" else len(s) - 1 - p, strand) for m in re.finditer(f"(?={kmer})", x) for p in [m.start() + off]}
    return out


def context(ref, c, p, strand, f):
    s = "N" * f + ref[c] + "N" * f
    w = s[p : p + 2 * f + 1]
    return w if strand == "+" else w.translate(COMP)[::-1]


def search(ref, calls, base, sizes, rate, least):
    left, out = set(calls), []
    f = max(sizes)
    while True:
        n = Counter()
        for c, p, strand in left:
            w = context(ref, c, p, strand, f)
            if w[f] == base and "N" not in w:
                n.update({(w[f - o : f - o + k], o) for k in sizes for o in range(k)})
        ok = []
        for (kmer, o), k in n.items():
            if k >= least:
                occ = occurrences(ref, kmer, o)
                if len(occ & calls) / len(occ) >= rate:
                    ok.append((-k, len(kmer), kmer, o, occ))
        if not ok:
            return out
        _, _, kmer, o, occ = min(ok, key=lambda x: x[:4])
        out.append((N.label(kmer, o), kmer, o, len(occ), len(occ & calls) / len(occ), len(left & occ), occ))
        left -= occ


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    ref = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("x", 3000), ("y", 1200), ("tiny", 5))}
    calls = {}
    for kmer, o in (("GATC", 1), ("TCTAC", 3), ("GGAC", 2)):
        for k in sorted(occurrences(ref, kmer, o)):
            if rng.random() < 0.97:
                calls[k] = "m6A"
    for c, s in ref.items():
        for p in range(len(s)):
            if rng.random() < 0.01:
                calls.setdefault((c, p, rng.choice("+-")), rng.choice(["m4C", "modified_base", "m6A"]))
    cov = {(c, p, z): rng.randint(5, 60) for c, s in ref.items() for p in range(len(s)) for z in "+-" if rng.random() < 0.9}
    return ref, calls, cov


@pytest.mark.parametrize("skip", [(), ("GG[A]C",)])
def test_kinetics_rows_are_those_of_a_plain_search(spark, planted, skip):
    ref, calls, cov = planted
    sizes, least = (4, 5), 5
    frames = spark.createDataFrame(list(ref.items()), "contig string, seq string"), spark.createDataFrame([(*k, v) for k, v in calls.items()], "contig string, pos long, strand string, type string"), spark.createDataFrame([(*k, v) for k, v in cov.items()], "contig string, pos long, strand string, cov int")
    rows, motifs = N.kinetics_rows(*frames, "m6A", "A", skip, sizes, flank=2, min_cov=20, rate=0.85, least=least)
    own = {k for k, v in calls.items() if v == "m6A"}
    want = search(ref, own, "A", sizes, 0.85, least)
    got = [tuple(r) for r in motifs.collect()]
    assert [r[:4] + r[5:6] for r in got] == [w[:4] + w[5:6] for w in want] and len(want) >= 3
    assert [r[4] for r in got] == pytest.approx([w[4] for w in want]) and [r[6] for r in got] == [w[0] not in skip for w in want]
    pos = {}
    for w in want:
        if w[0] not in skip:
            for k in w[6] & own:
                pos.setdefault(k, w[0])
    near = {(c, p + d) for c, p, _ in calls for d in range(-2, 3)}
    neg = {(c, p, z) for (c, p, z), n in cov.items() if n >= 20 and (c, p) not in near and (ref[c][p] if z == "+" else ref[c][p].translate(COMP)) == "A"}
    assert Counter((r.contig, r.pos, r.strand, r.label, r.motif) for r in rows.collect()) == Counter([(*k, 1, m) for k, m in pos.items()] + [(*k, 0, None) for k in neg])


def test_no_calls_no_motifs(spark, planted):
    ref, _, cov = planted
    none = spark.createDataFrame([], "contig string, pos long, strand string, type string")
    rows, motifs = N.kinetics_rows(spark.createDataFrame(list(ref.items()), "contig string, seq string"), none, spark.createDataFrame([(*k, v) for k, v in cov.items()], "contig string, pos long, strand string, cov int"), "m6A", "A")
    assert motifs.count() == 0 and {r.label for r in rows.select("label").distinct().collect()} == {0}


def sites(spark):
    rng = random.Random(1)
    rows = [(c, p, src, int(rng.random() < 0.4), n) for c in ("a", "b") for p in range(60) for src in ("s1", "s2") for n in range(rng.randint(1, 3))]
    return spark.createDataFrame(rows, "contig string, pos long, source string, label int, image int").withColumn("label", F.when((F.col("source") == "s2"), 0).otherwise((F.col("pos") % 3 == 0).cast("int")))


def test_shots_are_nested_and_apart_from_the_query(spark):
    d = sites(spark)
    held, train = d.where("contig = 'a'"), d.where("contig = 'b'")
    make = lambda k, seed=0: P.few_shot(held, train, k, ["contig", "pos"], ["source"], replay=60, seed=seed, row=["contig", "pos", "source", "image"]).collect()
    few, more, none = make(3), make(6), make(0)
    of = lambda rows, role: {(r.pos, r.source, r.image) for r in rows if r.role == role}
    assert of(few, "shot") < of(more, "shot")
    assert of(few, "query") == of(more, "query") == of(none, "query") and {r.role for r in none} == {"query"}
    for rows, k in ((few, 3), (more, 6)):
        assert not {p for p, _, _ in of(rows, "shot")} & {p for p, _, _ in of(rows, "query")}
        shots = [r for r in rows if r.role == "shot"]
        images = len(of(rows, "shot"))
        for y in (0, 1):
            assert len({(r.pos, r.source) for r in shots if r.label == y}) == k
        whole = {(r.pos, r.source, r.image) for r in held.collect()}
        assert of(rows, "shot") == {w for w in whole if w[:2] in {x[:2] for x in of(rows, "shot")}}  # all rows of a site
        n = sum(r.role == "replay" for r in rows)
        times = max(1, min(50, round(0.25 * n / images)))
        assert {r.copy for r in shots} == set(range(1, times + 1)) and len(shots) == times * images
        assert n == 60 and sum(r.role == "replay_val" for r in rows) <= 10
        assert not {p for p, _, _ in of(rows, "replay")} & {p for p, _, _ in of(rows, "replay_val")}
    assert of(make(3, 1), "shot") != of(few, "shot")
    assert {r.copy for r in P.few_shot(held, train, 1, ["contig", "pos"], ["source"], replay=100_000, seed=0, row=["pos", "source", "image"]).collect() if r.role == "shot"} <= set(range(1, 51))
    pool = P.few_shot_pool(held, train, 3, ["contig", "pos"], ["source"]).collect()
    assert {(r.pos, r.source, r.image) for r in pool if r.role == "train" and r.contig == "a"} == of(few, "shot")
    assert sum(r.role == "train" for r in pool) == train.count() + len(of(few, "shot"))


def test_split_contigs_keeps_groups_whole(spark):
    d = spark.createDataFrame([(f"c{k}", p, int(k % 2 == 0 and p == 1)) for k in range(14) for p in range(k + 2)], "contig string, pos long, label int")
    s = P.split_contigs(d, ["contig"], 0.1, 0.2, 1)
    by = {r.contig: set() for r in s.collect()}
    for r in s.collect():
        by[r.contig].add(r.split)
    assert all(len(v) == 1 for v in by.values()) and len(by) == 14
    for rest in (0, 1):
        parts = Counter(next(iter(v)) for c, v in by.items() if int(c[1:]) % 2 == rest)
        assert parts == {"train": 5, "val": 1, "test": 1}
    n = {r.split: r for r in P.split_counts(s, ["contig"], ["contig", "pos"]).collect()}
    assert sum(r.n_groups for r in n.values()) == 14 and sum(r.n_positions for r in n.values()) == d.distinct().count() == sum(r.n_rows for r in n.values())


def test_lodo_table_of_a_few_rows(spark):
    rows = lambda x: spark.createDataFrame(x, "fold string, label int, score double")
    base = rows([("b", 1, 0.9), ("b", 1, 0.4), ("b", 0, 0.6), ("b", 0, 0.1)]).drop("fold")
    folds = rows([("f", 1, 0.3), ("f", 0, 0.2), ("g", 0, 0.7), ("g", 0, 0.1)])
    got = {(r.model, r.held_out): r for r in P.lodo_table(base, folds, rows([("t", 0, 0.0), ("t", 1, 0.0)])).collect()}
    b, f, g, z = (got[k] for k in (("Base", "all (stratified split)"), ("LODO", "f"), ("LODO", "g"), ("ZeroR", "base test set")))
    assert (b.precision_label1, b.recall_label1, b.f1_label0, b.n_test, b.threshold) == (0.5, 0.5, 0.5, 4, 0.5)
    assert (f.threshold, f.macro_f1) == (0.3, 1.0) and (g.threshold, g.f1_label1, g.support_label1, g.recall_label0) == (0.5, 0.0, 0, 0.5)
    assert (z.notes, z.recall_label0, z.precision_label0, z.f1_label1, z.threshold) == ("majority=0", 1.0, 0.5, 0.0, None)
