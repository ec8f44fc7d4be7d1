"""Ground truth: labels from confidence, membership, chemistry maps, motifs and call sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.functions import seq
from sitegrid.functions.scalar import hash_key, revcomp_str
from sitegrid.operators import ranges
from sitegrid.operators.sampling import balance


def confidence_label(cov: Column, frac: Column, min_cov: int, hi: float, lo: float) -> Column:
    """1 at a share of hi or more, 0 at lo or less, else and under min_cov null."""
    return F.when(cov < min_cov, None).when(frac >= hi, 1).when(frac <= lo, 0)


def label_sites(sites: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    return sites.join(truth.select(*keys).distinct().withColumn("_y", F.lit(1)), keys, "left").withColumn("label", F.coalesce("_y", F.lit(0))).drop("_y")


def restrict(rows: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(candidates, keys, "left_semi")


def site_scores(sites: DataFrame, scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Left join; a site without a score is 0. A key that occurs twice in scores is an error."""
    s = scores.groupBy(*keys).agg(F.count("*").alias("_c"), F.first("sum_p").alias("sum_p"), F.first("n_called").alias("n_called"), F.first("n_mod").alias("n_mod"))
    s = s.withColumn("sum_p", F.when(F.col("_c") > 1, F.raise_error(F.concat(F.lit("duplicate site: "), F.concat_ws(",", *keys)))).otherwise(F.col("sum_p"))).drop("_c")
    j = sites.join(s, keys, "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.withColumns({"score": z("sum_p") / k, "frequency": z("n_mod") / k, "n_called": z("n_called")}).drop("sum_p", "n_mod")


def shared_sites(tracks: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on), tracks)


def seen_positions(samples: DataFrame, members: DataFrame, seen: DataFrame) -> DataFrame:
    """Trained positions by sample: regular expressions meet the distinct member names, of which there are few."""
    names = members.select("member").distinct()
    hit = samples.join(F.broadcast(names), F.expr("member RLIKE pattern")).select("sample", "member").distinct()
    return seen.join(F.broadcast(hit), "member").select("sample", "contig", "pos").distinct()


def holdout(blocks: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return blocks.join(seen, keys, "left_anti")


def assign_chem(images: DataFrame, maps: list[DataFrame], keys: list[str], default: str = "untyped") -> DataFrame:
    """The first map that knows a positive's site names its chemistry; negatives have none."""
    d = images
    for i, m in enumerate(maps):
        d = d.join(m.select(*keys, F.col("chem").alias(f"_chem{i}")).dropDuplicates(keys), keys, "left")
    found = F.coalesce(*[F.col(f"_chem{i}") for i in range(len(maps))], F.lit(default))
    return d.withColumn("chem", F.when(F.col("label") == 1, found)).drop(*[f"_chem{i}" for i in range(len(maps))])


def check_chem_base(images: DataFrame, base_of: dict[str, str], base: str = "base") -> DataFrame:
    """A chemistry on another base than its own becomes untyped."""
    m = F.create_map(*[F.lit(x) for kv in base_of.items() for x in kv])
    return images.withColumn("chem", F.when(F.col("chem").isNull() | (F.col("chem") == "untyped") | (m[F.col("chem")] == F.col(base)), F.col("chem")).otherwise("untyped"))


def type_map(dominant: DataFrame, t_sites: DataFrame, keys: list[str], t_type: str) -> DataFrame:
    """Dominant codes, overruled at t_sites."""
    t = t_sites.select(*keys).distinct().withColumn("_t", F.lit(t_type))
    return dominant.join(t, keys, "full_outer").select(*keys, F.coalesce("_t", "code").alias("type"))


def anchors(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that have both a positive and a negative."""
    both = df.groupBy(*keys).agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a = 0 AND _b = 1").select(*keys)
    return df.join(both, keys, "left_semi")


def drop_untyped(images: DataFrame) -> DataFrame:
    return images.where("label = 0 OR (chem IS NOT NULL AND chem NOT IN ('', 'untyped'))")


def control_labels(df: DataFrame, member: Column, controls: list[str]) -> DataFrame:
    return df.withColumn("label", F.when(member.isin(controls), 0).otherwise(F.col("label")))


def type_by_calls(a: DataFrame, b: DataFrame, keys: list[str], a_type: str, b_type: str, strong: float) -> DataFrame:
    """Only one side calls: its type; both: the side with a share of `strong` or more alone, else untyped."""
    j = a.select(*keys, F.col("frac").alias("_a")).join(b.select(*keys, F.col("frac").alias("_b")), keys, "full_outer")
    A, B = F.col("_a"), F.col("_b")
    t = F.when(B.isNull(), a_type).when(A.isNull(), b_type).when((A >= strong) & (B < strong), a_type).when((B >= strong) & (A < strong), b_type).otherwise("untyped")
    return j.select(*keys, t.alias("type"))


def motif_ground_truth(ref: DataFrame, motifs: list[tuple[str, int]], overlapping: bool = True) -> DataFrame:
    """contig, pos, strand of all motifs' modified bases, each once."""
    return reduce(lambda a, b: a.unionByName(b), [seq.motif_sites(ref, m, o, overlapping) for m, o in motifs]).distinct()


def background(ref: DataFrame, base: str, motifs: list[tuple[str, int]]) -> DataFrame:
    """Positions of a base that no motif's modified base is."""
    return seq.base_sites(ref, base).join(motif_ground_truth(ref, motifs), ["contig", "pos", "strand"], "left_anti")


def motif_rows(ref: DataFrame, motif: str, offset: int, design: str) -> tuple[DataFrame, DataFrame]:
    """Truth, and candidates: the truth itself (two samples) or every such base (one sample)."""
    gt = seq.motif_sites(ref, motif, offset)
    return gt, gt if design == "two" else seq.base_sites(ref, motif[offset])


def confirm_motifs(occurrences: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """By motif: occurrences, how many are called, the rate."""
    c = calls.select(*keys).distinct().withColumn("_c", F.lit(1))
    g = occurrences.join(c, keys, "left").groupBy("motif").agg(F.count("*").alias("occurrences"), F.count("_c").alias("explained"))
    return g.withColumn("rate", F.col("explained") / F.col("occurrences"))


def screened_candidates(ref: DataFrame, truth: DataFrame, pileup: DataFrame, motif: str, min_cov: int, max_frac: float, ratio: float, max_total: int, seed: int) -> DataFrame:
    """Positives, and as negatives A and C outside of truth and motif with coverage and no code over max_frac."""
    ac = seq.base_sites(ref, "A").where("strand = '+'").unionByName(seq.base_sites(ref, "C").where("strand = '+'")).select("contig", "pos")
    clean = pileup.where((F.col("cov") >= min_cov) & (F.col("frac") <= max_frac)).select("contig", "pos")
    neg = ac.join(clean, ["contig", "pos"], "left_semi").join(truth, ["contig", "pos"], "left_anti").join(seq.motif_cover(ref, motif), ["contig", "pos"], "left_anti")
    return balance(truth.select("contig", "pos").distinct(), neg, ratio, max_total, ["contig", "pos"], seed)


def make_candidates(ref: DataFrame, base: str, strand: str = "both") -> DataFrame:
    d = seq.base_sites(ref, base)
    return d if strand == "both" else d.where(F.col("strand") == strand)


def validate_sites(sites: DataFrame, ref: DataFrame, base: str) -> DataFrame:
    """Listed sites with ok = the base stands at pos on the site's strand."""
    want = F.when(F.col("strand") == "-", F.lit(revcomp_str(base))).otherwise(F.lit(base))
    return seq.base_at(sites, ref).withColumn("ok", F.coalesce(F.col("base") == want, F.lit(False)))


def coord_check(sites: DataFrame, ref: DataFrame) -> DataFrame:
    """Share of each base under the sites, by strand."""
    b = seq.base_at(sites, ref)
    g = b.groupBy("strand").agg(F.count("*").alias("n"), *[F.avg((F.coalesce("base", F.lit("?")) == x).cast("int")).alias(f"share_{x.lower()}") for x in "ACGT"])
    return g


def kinetics_rows(ref: DataFrame, calls: DataFrame, covered: DataFrame, motifs: list[tuple[str, int]], flank: int, base: str) -> DataFrame:
    """Called motif sites are positives; covered, uncalled ones of the base away from any call negatives."""
    pos = motif_ground_truth(ref, motifs).join(calls, ["contig", "pos", "strand"], "left_semi")
    neg = ranges.exclude_near(seq.base_sites(ref, base).join(covered, ["contig", "pos", "strand"], "left_semi"), calls, flank)
    neg = neg.join(pos, ["contig", "pos", "strand"], "left_anti")
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


def discover_motifs(windows: DataFrame, sizes: list[int], center: int, top: int = 60, least: int = 50, min_rate: float = 0.9, background_windows: DataFrame | None = None) -> list[tuple[str, int, int]]:
    """Greedy: of the k-mers around called positions (windows: id, context) the one that explains most calls at a rate of
    min_rate among all windows (background_windows), shorter first on ties; then again without what it explains.
    Windows are collapsed to distinct contexts with their number, and words of all windows counted, once; a round aggregates
    what is left of the called contexts; `top` candidates come to the driver."""
    whole = background_windows if background_windows is not None else windows
    parts = [F.struct(F.lit(k).alias("k"), F.lit(o).alias("o"), F.substring("context", center - o + 1, k).alias("kmer")) for k in sizes for o in range(k)]

    def words(d: DataFrame, n: str) -> DataFrame:
        return d.select("n", F.explode(F.array(*parts)).alias("m")).groupBy("m.kmer", "m.o", "m.k").agg(F.sum("n").alias(n))

    left = calls = windows.groupBy("context").agg(F.count("*").alias("n")).persist()
    every = words(whole.groupBy("context").agg(F.count("*").alias("n")), "all").drop("k").persist()
    found = []
    try:
        while True:
            c = words(left, "n").where(F.col("n") >= least).orderBy(F.desc("n"), "k", "kmer", "o").limit(top)
            best = c.join(every, ["kmer", "o"]).where(F.col("n") >= min_rate * F.col("all")).orderBy(F.desc("n"), "k", "kmer", "o").first()
            if best is None:
                return found
            found.append((best.kmer, best.o, best.n))
            left = left.where(F.substring("context", center - best.o + 1, len(best.kmer)) != best.kmer)
    finally:
        calls.unpersist()
        every.unpersist()


def holdout_regions(contigs: DataFrame, frac: float, slack: float, seed: int) -> DataFrame:
    """By organism: a whole contig whose share lies in the band frac +- slack; else contigs in hash order as long as their sum
    stays under frac + slack; else a window of the largest contig from its start."""
    o = Window.partitionBy("organism")
    d = contigs.withColumn("_share", F.col("length") / F.sum("length").over(o))
    band = (F.col("_share") >= frac - slack) & (F.col("_share") <= frac + slack)
    d = d.withColumn("_band", F.max(F.when(band, F.struct(-F.abs(F.col("_share") - frac), "contig"))).over(o))
    run = F.sum("_share").over(o.orderBy(hash_key(seed, "organism", "contig")).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_run", run).withColumn("_any", F.max((F.col("_run") <= frac + slack).cast("int")).over(o))
    big = F.row_number().over(o.orderBy(F.desc("length"), "contig")) == 1
    d = d.withColumn("_big", big)
    end = F.when(F.col("_band").isNotNull(), F.when(F.col("_band.contig") == F.col("contig"), F.col("length"))).when(F.col("_any") == 1, F.when(F.col("_run") <= frac + slack, F.col("length"))).when(F.col("_big"), F.floor(F.col("length") * frac / F.col("_share")))
    return d.withColumn("start", F.lit(0)).withColumn("end", F.least(end, F.col("length"))).where("end > 0").select("organism", "contig", "start", "end")
