"""Sequences as rows (contig, start, seq): chunks that overlap by motif length, so that no row is a chromosome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.functions.scalar import iupac_regex, revcomp, revcomp_str

CHUNK = 100_000
FINE = 1_000  # letters of the chunks in which single places are looked up: a letter of a text is reached from its beginning


def _cut(d: DataFrame, letters: int, chunk: int, overlap: int) -> DataFrame:
    """d (contig, start, seq and further columns): pieces of chunk + overlap letters that begin within the first `letters` ones."""
    n = F.greatest(F.lit(0), F.floor((F.least(F.length("seq"), F.lit(letters)) - 1) / chunk)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((F.col("start") + i.cast("long") * chunk).alias("start"), F.substring(F.col("seq"), i * chunk + 1, F.lit(chunk + overlap)).alias("seq")))
    more = [c for c in d.columns if c not in ("contig", "start", "seq")]
    return d.select("contig", *more, F.explode(parts).alias("_p")).select("contig", *more, "_p.start", "_p.seq")  # a row has its chunk alone


def chunked(ref: DataFrame, overlap: int = 31, chunk: int = CHUNK) -> DataFrame:
    """ref (contig, seq and further columns) in chunks of `chunk` letters plus `overlap` of the next. Short chunks are cut from long
    ones, so that a contig isn't walked through from its beginning for each. A null sequence has none (`least` would take its length
    for the largest number)."""
    d = ref.where("seq IS NOT NULL").withColumns({"start": F.lit(0).cast("long"), "seq": F.upper("seq")})
    fine = max(chunk, FINE // chunk * chunk)
    step = max(fine, CHUNK // fine * fine)
    d = _cut(d, 2**31 - 1, step, overlap)
    for whole, part in ((step, fine), (fine, chunk)):
        d = d if whole == part else _cut(d, whole, part, overlap)
    return d


def letter_bits(letters: str, column: str = "seq") -> Column:
    """The first 64 letters of a text as a long: bit i is set where letter i is one of `letters`."""
    b = F.reverse(F.rpad(F.translate(F.regexp_replace(column, f"[^{letters}]", "0"), letters, "1" * len(letters)), 64, "0"))
    half = lambda at: F.conv(F.substring(b, at, 32), 2, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def _hits(seq: Column, regex: str, k: int, overlapping: bool) -> Column:
    """Offsets of matches: all, or those a left-to-right search without overlap gives."""
    if overlapping:
        every = F.sequence(F.lit(0), F.length(seq) - k)
        # candidates by a look-ahead in one pass: text before each match, cut at zero-width places
        parts = F.split(seq, f"(?={regex})")
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
        found = F.filter(ends, lambda e: (e <= F.length(seq) - k) & F.substring(seq, e + 1, F.lit(k)).rlike(f"^{regex}$"))
        return F.when(F.length(seq) < k, F.array().cast("array<int>")).when(F.lit(k) == 1, F.filter(every, lambda e: F.substring(seq, e + 1, F.lit(1)).rlike(f"^{regex}$"))).otherwise(F.array_distinct(found))
    parts = F.split(seq, regex)
    step = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, p: F.struct((s["at"] + F.length(p) + k).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(p))).alias("out")))
    return F.filter(step["out"], lambda e: e + k <= F.length(seq))


def motif_sites(ref: DataFrame, motif: str, offset: int, overlapping: bool = True, chunk: int = FINE) -> DataFrame:
    """contig, pos, strand of the modified base of an IUPAC motif, on both strands; pos on the forward axis.

    Overlapping search is by chunks. The search without overlap depends on all that lies before it, so it takes whole contigs.
    """
    k = len(motif)
    if k == 1:
        return _letters(ref, motif.upper(), chunk)
    parts = chunked(ref, k - 1, chunk) if overlapping else ref.select("contig", F.lit(0).cast("long").alias("start"), F.upper("seq").alias("seq"))
    out = None
    for strand, m, at in (("+", motif, offset), ("-", revcomp_str(motif), k - 1 - offset)):
        e = parts.select("contig", "start", F.explode(_hits(F.col("seq"), iupac_regex(m), k, overlapping)).alias("_i"))
        e = e.select("contig", (F.col("start") + F.col("_i") + at).alias("pos")).distinct().withColumn("strand", F.lit(strand))
        out = e if out is None else out.unionByName(e)
    return out


def _letters(ref: DataFrame, code: str, chunk: int) -> DataFrame:
    """motif_sites of one letter, in one pass: places are listed by chunk, made distinct there, and spread at last."""
    at = lambda m: F.array_compact(F.transform(F.split("seq", ""), lambda x, i: F.when(x.rlike(f"^{iupac_regex(m)}$") if m not in "ACGT" else x == m, i)))
    d = chunked(ref, 0, chunk).select("contig", "start", at(code).alias("_f"), at(revcomp_str(code)).alias("_r"))
    d = d.groupBy("contig", "start").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("_f", "_r")])
    one = lambda c, x: F.transform(c, lambda i: F.struct(i.alias("i"), F.lit(x).alias("strand")))
    e = d.select("contig", "start", F.explode(F.concat(one("_f", "+"), one("_r", "-"))).alias("_p"))
    return e.select("contig", (F.col("start") + F.col("_p.i")).alias("pos"), "_p.strand")


def motif_cover(ref: DataFrame, motif: str, chunk: int = FINE) -> DataFrame:
    """Positions that an occurrence on either strand covers."""
    k = len(motif)
    first = motif_sites(ref, motif, 0, chunk=chunk)
    lo = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("pos") - (k - 1))
    return first.select("contig", F.explode(F.sequence(lo, lo + (k - 1))).alias("pos")).distinct()


def base_sites(ref: DataFrame, base: str, chunk: int = FINE) -> DataFrame:
    """Every position of a base, its complement on the reverse strand."""
    return motif_sites(ref, base, 0, chunk=chunk)


def _beside(sites: DataFrame, chunks: DataFrame, chunk: int, how: str) -> DataFrame:
    """sites (with _c) and the chunk of each. Sites, of which there may be one for each letter, are shuffled once and not sorted:
    a table of chunks is built in each task, of which AQE's partitions hold some 64 MB."""
    c = chunks.withColumn("_c", F.floor(F.col("start") / chunk)).withColumnRenamed("start", "_start")
    return sites.join(c.hint("shuffle_hash"), ["contig", "_c"], how)


def base_at(sites: DataFrame, ref: DataFrame, chunk: int = FINE) -> DataFrame:
    """sites with the reference base at pos; null outside of the reference."""
    j = _beside(sites.withColumn("_c", F.floor(F.col("pos") / chunk)), chunked(ref.select("contig", "seq"), 0, chunk), chunk, "left")
    b = F.substring("seq", (F.col("pos") - F.col("_start") + 1).cast("int"), F.lit(1))
    return j.withColumn("base", F.when((F.col("pos") >= 0) & (F.length(b) == 1), b)).drop("_c", "_start", "seq")


def assign_strand(sites: DataFrame, ref: DataFrame, base: str, chunk: int = FINE) -> DataFrame:
    """+ where the base stands, - where its complement does, dropped elsewhere; N: A and C are +, G and T are -."""
    plus, minus = (["A", "C"], ["G", "T"]) if base == "N" else ([base], [revcomp_str(base)])
    d = base_at(sites, ref, chunk)
    return d.withColumn("strand", F.when(F.col("base").isin(plus), "+").when(F.col("base").isin(minus), "-")).where("strand IS NOT NULL")


def context(sites: DataFrame, ref: DataFrame, w: int, chunk: int = FINE) -> DataFrame:
    """The 2w+1 letters around pos on the site's strand, N beyond the ends."""
    c = chunked(ref.select("contig", "seq", F.length("seq").alias("_len")), 2 * w, chunk)
    lo = F.greatest(F.lit(0), F.col("pos") - w)
    j = _beside(sites.where("pos >= 0").withColumn("_c", F.floor(lo / chunk)), c, chunk, "inner").where("pos < _len")
    part = F.substring("seq", (lo - F.col("_start") + 1).cast("int"), (F.least(F.col("_len"), F.col("pos") + w + 1) - lo).cast("int"))
    left = F.repeat(F.lit("N"), F.greatest(F.lit(0), w - F.col("pos")).cast("int"))
    text = F.rpad(F.concat(left, part), 2 * w + 1, "N")
    return j.withColumn("context", F.when(F.col("strand") == "-", revcomp(text)).otherwise(text)).drop("_c", "_start", "seq", "_len")


def base_words(ref: DataFrame, w: int, chunk: int) -> DataFrame:
    """contig, start, seq: every `chunk` letters of a contig with w more on both sides, N beyond the ends."""
    edge = F.repeat(F.lit("N"), F.lit(w))
    return chunked(ref.where(F.length("seq") > 0).select("contig", F.concat(edge, "seq", edge).alias("seq")), 2 * w, chunk)


def word_contexts(words: DataFrame, base: str, w: int) -> DataFrame:
    """base_words as contig, pos, strand, context, _i (the place in the word) and the words' further columns. A word is turned over
    once for all of its sites."""
    more = [c for c in words.columns if c not in ("contig", "start", "seq")]
    c = words.withColumns({"_rc": revcomp(F.col("seq")), "_n": F.length("seq")})
    mid = F.split(F.substring("seq", F.lit(w + 1), F.greatest(F.lit(0), F.col("_n") - 2 * w)), "")
    e = c.select(*c.columns, F.posexplode(mid).alias("_i", "_x")).where(F.col("_x").isin(base, revcomp_str(base)))
    back, long = F.col("_x") != base, F.lit(2 * w + 1)
    text = F.when(back, F.substring("_rc", F.col("_n") - F.col("_i") - 2 * w, long)).otherwise(F.substring("seq", F.col("_i") + 1, long))
    return e.select("contig", (F.col("start") + F.col("_i")).alias("pos"), F.when(back, "-").otherwise("+").alias("strand"), text.alias("context"), "_i", *more)


def base_contexts(ref: DataFrame, base: str, w: int, chunk: int = 200) -> DataFrame:
    """context of base_sites: contig, pos, strand, context, from chunks with w letters more on both sides, so that nothing is
    shuffled. ref has a contig once."""
    return word_contexts(base_words(ref, w, chunk), base, w).drop("_i")


def is_cpg(sites: DataFrame, ref: DataFrame, chunk: int = FINE) -> DataFrame:
    return context(sites, ref, 1, chunk).withColumn("is_cpg", F.substring("context", 2, 2) == "CG").drop("context")


def expected_level(sites: DataFrame, ref: DataFrame, levels: DataFrame, k: int, center: int, chunk: int = FINE) -> DataFrame:
    """The level of the k-mer that holds pos at `center`, on the site's strand; the level table has 4^k rows."""
    w = max(center, k - 1 - center)
    c = context(sites, ref, w, chunk).withColumn("kmer", F.substring("context", w - center + 1, k)).drop("context")
    return c.join(F.broadcast(levels) if k <= 9 else levels, "kmer", "left")


def normalize_levels(levels: DataFrame) -> DataFrame:
    s = levels.agg(F.avg("level").alias("_m"), F.stddev_pop("level").alias("_d"))
    return levels.join(F.broadcast(s)).withColumn("level", (F.col("level") - F.col("_m")) / F.col("_d")).drop("_m", "_d")
