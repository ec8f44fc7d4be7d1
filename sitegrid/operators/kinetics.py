"""Rows from kinetic calls: motifs are sought among the calls, called sites of a motif are positives."""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.functions import seq
from sitegrid.operators import ranges

SITE = ["contig", "pos", "strand"]


class Motif(NamedTuple):
    name: str
    kmer: str
    offset: int
    occurrences: int
    rate: float
    explained: int


def label(kmer: str, offset: int) -> str:
    return f"{kmer[:offset]}[{kmer[offset]}]{kmer[offset + 1 :]}"


def _words(context: str, center: int, sizes: list[int]) -> Column:
    """Every word that covers the centre: kmer and the centre's offset in it."""
    return F.array(*[F.struct(F.substring(context, center - o + 1, k).alias("kmer"), F.lit(o).alias("offset")) for k in sizes for o in range(k)])


def _counts(d: DataFrame, center: int, sizes: list[int], *sums: Column) -> DataFrame:
    """d (context, n): rows by word. Words with an N don't count."""
    e = d.select("*", F.explode(_words("context", center, sizes)).alias("w")).where(~F.contains("w.kmer", F.lit("N")))
    return e.groupBy("w.kmer", "w.offset").agg(*sums)


def greedy_motifs(contexts: DataFrame, sizes: list[int], center: int, rate: float = 0.9, least: int = 50, top: int = 60) -> list[Motif]:
    """contexts (context, called) of every site of a base, 2 * center + 1 letters on the site's strand.

    Each round takes, of the `top` words that most calls not yet explained have, those with `least` such calls or more, of whose
    occurrences a share of `rate` or more is called, and of these the one with most, the shortest on ties; its calls are then
    explained. Contexts near a contig's end (an N in them) don't count for finding a word, but do as its occurrences.

    Contexts are collapsed to distinct ones and occurrences counted by word once: 4^k words of each size and offset at most, whatever
    the genome. A round counts words of contexts that hold unexplained calls.
    """
    d = contexts.groupBy("context").agg(F.count("*").alias("n"), F.count_if("called").alias("calls")).persist()
    every = _counts(d, center, sizes, F.sum("n").alias("occurrences"), F.sum("calls").alias("called")).persist()
    left, found = d.where(F.col("calls") > 0), []
    try:
        while True:
            c = _counts(left.where(~F.contains("context", F.lit("N"))), center, sizes, F.sum("calls").alias("n"))
            c = c.where(F.col("n") >= least).orderBy(F.desc("n"), F.length("kmer"), "kmer", "offset").limit(top)
            share = F.col("called") / F.col("occurrences")
            best = c.join(every, ["kmer", "offset"]).where(share >= rate).orderBy(F.desc("n"), F.length("kmer"), "kmer", "offset").first()
            if best is None:
                return found
            has = F.substring("context", center - best.offset + 1, len(best.kmer)) == best.kmer
            explained = left.where(has).agg(F.sum("calls")).first()[0]
            found.append(Motif(label(best.kmer, best.offset), best.kmer, best.offset, best.occurrences, best.called / best.occurrences, explained))
            left = left.where(~has)
    finally:
        d.unpersist()
        every.unpersist()


def kinetics_rows(ref: DataFrame, calls: DataFrame, coverage: DataFrame, kind: str, base: str, skip: tuple[str, ...] = (), sizes: tuple[int, ...] = (4, 5, 6, 7), flank: int = 3, min_cov: int = 20, rate: float = 0.9, least: int = 50, top: int = 60) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (contig, pos, strand, label, motif) and motifs (motif, kmer, offset, occurrences, rate, explained, used).

    calls (contig, pos, strand, type); coverage (contig, pos, strand, cov). Positives: calls of the kind at a site of a motif; the
    first one found, but for those in skip (spilled over from another mark), names it. Negatives: sites of the base with coverage on
    their strand, and no call of any kind, on either strand, within flank letters. All other sites are neither. ref has a contig once.

    Calls and coverage meet words of 64 letters as bits (ranges.marks), once, so no table of sites is shuffled; the words are kept on
    disk (persist), since motifs are sought before sites are told apart.
    """
    center = max(sizes)
    strand = {"_plus": F.col("strand") == "+", "_minus": F.col("strand") == "-"}
    own = {f"_own{n}": (F.col("type") == kind) & c for n, c in strand.items()}
    deep = ranges.point_bits(coverage.where(F.col("cov") >= min_cov), **{f"_deep{n}": c for n, c in strand.items()})
    bits = ranges.marks(ranges.near_bits(calls, flank, "_near", **own), deep)
    words = seq.base_words(ref, center, ranges.WORD).withColumn("_w", F.floor(F.col("start") / ranges.WORD)).join(bits, ["contig", "_w"], "left").persist(StorageLevel.DISK_ONLY)
    bit = lambda n: F.coalesce(F.getbit(n, F.col("_i")), F.lit(0)) == 1
    mine = lambda n: F.when(F.col("strand") == "+", bit(f"{n}_plus")).otherwise(bit(f"{n}_minus"))
    cx = seq.word_contexts(words, base, center).select(*SITE, "context", mine("_own").alias("called"), (mine("_deep") & ~bit("_near")).alias("quiet"))
    found = greedy_motifs(cx.select("context", "called"), list(sizes), center, rate, least, top)
    first = F.coalesce(*[F.when(F.substring("context", center - m.offset + 1, len(m.kmer)) == m.kmer, F.lit(m.name)) for m in found if m.name not in skip], F.lit(None).cast("string"))
    sites = cx.where("called OR quiet").withColumn("motif", F.when(F.col("called"), first)).where("quiet OR motif IS NOT NULL")  # no call is quiet
    rows = sites.select(*SITE, F.col("called").cast("int").alias("label"), "motif")
    motifs = ref.sparkSession.createDataFrame([(*m, m.name not in skip) for m in found], "motif string, kmer string, offset int, occurrences long, rate double, explained long, used boolean")
    return rows, motifs
