"""Benchmark rows: the labelled sites that each row of the benchmark scores."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.functions import seq
from sitegrid.functions.scalar import revcomp_str
from sitegrid.operators import ranges, sampling

SITE = ["contig", "pos", "strand"]


def in_context(sites: DataFrame, kind: str) -> DataFrame:
    """FIL-7 on a table: `cpg` keeps context CG, any other kind the contexts CHG and CHH."""
    return sites.where(F.col("context").isin(["CG"] if kind == "cpg" else ["CHG", "CHH"]))


def on_contigs(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """FIL-8: sites on known contigs."""
    return sites.join(contigs.select("contig").distinct(), "contig", "left_semi")


def bisulfite_rows(counts: DataFrame, spans: DataFrame, ref: DataFrame, kind: str, min_cov: int = 10, positive: float = 0.9, negative: float = 0.1) -> DataFrame:
    """contig, pos, label (1: in the truth; 0: a candidate only), n_c_or_g (1 where the reference has C or G there).

    counts (contig, pos, context, n_meth, n_unmeth); spans (contig, strand, start, end): what the selected reads cover.
    Sites in context, with coverage min_cov or more, that either strand's spans cover; the share of methylated reads is at
    least `positive` or at most `negative`, those between are dropped. A position with both labels is in both blocks.
    """
    cov = F.col("n_meth") + F.col("n_unmeth")
    d = in_context(counts, kind).where(cov >= min_cov).withColumn("frac", F.col("n_meth") / cov)
    d = ranges.include_regions(d, spans.select("contig", "start", "end"))
    label = F.when(F.col("frac") >= positive, 1).when(F.col("frac") <= negative, 0)
    d = d.withColumn("label", label).where("label IS NOT NULL").select("contig", "pos", "label").distinct()
    based = seq.base_at(d.withColumn("strand", F.lit("+")), ref).select("contig", "pos", "label", F.coalesce(F.col("base").isin("C", "G"), F.lit(False)).cast("int").alias("n_c_or_g"))
    return based


def _words(sites: DataFrame, ref: DataFrame, base: str, spans: DataFrame, *more: DataFrame) -> DataFrame:
    """contig, _w and longs whose bit i stands for position 64 * _w + i: the sites on the strand that has the base there, where a
    span of that strand covers it (_plus, _minus; N: A and C are +, G and T are -), and the bits of more (ranges.point_bits).
    No table of single positions is shuffled."""
    plus, minus = ("AC", "GT") if base == "N" else (base, revcomp_str(base))
    words = seq.chunked(ref.select("contig", "seq"), 0, ranges.WORD).select("contig", F.floor(F.col("start") / ranges.WORD).alias("_w"), seq.letter_bits(plus).alias("_p"), seq.letter_bits(minus).alias("_m"))
    bits = ranges.marks(ranges.point_bits(sites, _site=F.lit(True)), ranges.span_bits(spans, _plus=F.col("strand") == "+", _minus=F.col("strand") == "-"), *more)
    bits = bits.withColumns({c: F.col(c).bitwiseAND(F.col("_site")) for c in ("_plus", "_minus")}).where("_plus != 0 OR _minus != 0").drop("_site")
    return words.join(bits, ["contig", "_w"]).withColumns({"_plus": F.col("_plus").bitwiseAND(F.col("_p")), "_minus": F.col("_minus").bitwiseAND(F.col("_m"))}).drop("_p", "_m")


def _spread(words: DataFrame, keep: Column | None = None, **more: str) -> DataFrame:
    """contig, pos, strand of the words' sites, or of those in the bits `keep`; the bits of further columns as 0 or 1."""
    d = words if keep is None else words.withColumns({c: F.col(c).bitwiseAND(keep) for c in ("_plus", "_minus")})
    d = d.where("_plus != 0 OR _minus != 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(ranges.WORD - 1))).alias("_i"))
    bit = lambda c: F.getbit(c, F.col("_i"))
    d = d.where((bit("_plus") == 1) | (bit("_minus") == 1))  # a letter is the base on one strand alone
    return d.select("contig", (F.col("_w") * ranges.WORD + F.col("_i")).alias("pos"), F.when(bit("_plus") == 1, "+").otherwise("-").alias("strand"), *[bit(c).cast("int").alias(n) for n, c in more.items()])


def scorable_sites(sites: DataFrame, ref: DataFrame, base: str, spans: DataFrame) -> DataFrame:
    """Positions on the strand that has the base there, where that strand is covered."""
    return _spread(_words(sites, ref, base, spans))


def row_sites_one(truth: DataFrame, candidates: DataFrame, ref: DataFrame, base: str, spans: DataFrame, cap: int, seed: int, seen: DataFrame | None = None) -> DataFrame:
    """OP-18, a row of one sample: its candidates are the sites, those in the truth the positives; negatives beyond cap go by
    the seeded hash of the site, so that all tools score the same; then what a pool has seen is left out. Words of sites are kept
    on disk (persist), since negatives are counted before they are taken."""
    more = [ranges.point_bits(truth, _truth=F.lit(True)), *_seen_bits(seen)]
    words = _words(candidates, ref, base, spans, *more).persist(StorageLevel.DISK_ONLY)
    truth_ = F.col("_truth")
    if seen is None:
        return _spread(words, truth_, label="_truth").unionByName(sampling.sample_uniform(_spread(words, F.bitwise_not(truth_), label="_truth"), cap, SITE, seed))
    negatives = sampling.sample_uniform(_spread(words, F.bitwise_not(truth_), label="_truth", _seen="_seen"), cap, SITE, seed)
    return _spread(words, truth_.bitwiseAND(F.bitwise_not("_seen")), label="_truth").unionByName(negatives.where("_seen = 0").drop("_seen"))


def row_sites_two(positives: DataFrame, negatives: DataFrame, ref: DataFrame, base: str, pos_spans: DataFrame, neg_spans: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """OP-18, a row of two samples: all sites of the first are positive, all of the second negative; without what was seen."""
    rest = None if seen is None else F.bitwise_not("_seen")
    side = lambda sites, spans, y: _spread(_words(sites, ref, base, spans, *_seen_bits(seen)), rest).withColumn("label", F.lit(y))
    return side(positives, pos_spans, 1).unionByName(side(negatives, neg_spans, 0))


def _seen_bits(seen: DataFrame | None) -> list[DataFrame]:
    return [] if seen is None else [ranges.point_bits(seen, _seen=F.lit(True))]


def matched_sites(blocks: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """JOIN-20: by row the sites whose key both classes have."""
    both = blocks.groupBy(row, *keys).agg(F.count_distinct("label").alias("_n")).where("_n = 2").drop("_n")
    return blocks.join(both, [row, *keys], "left_semi")


def best_over_models(calibrated: DataFrame, keys: list[str], score: str = "calibrated") -> DataFrame:
    """WIN-9: a site's largest calibrated rank over models."""
    return calibrated.groupBy(*keys).agg(F.max(score).alias(score))
