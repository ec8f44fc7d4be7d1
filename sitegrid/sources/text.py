"""Text inputs. parse_* take a DataFrame of lines (column value); read_* take a path. Lines that don't fit are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.functions.scalar import code_sum, to_probability


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def _fields(df: DataFrame, sep: str = "\t", comment: str = "#") -> DataFrame:
    v = F.rtrim(F.col("value"))
    return df.where((F.length(F.trim("value")) > 0) & ~v.startswith(comment)).select(F.split(v, sep).alias("f"))


def _s(i: int) -> Column:
    return F.get("f", F.lit(i))


def _n(i: int, kind: str = "bigint") -> Column:
    return _s(i).try_cast(kind)


def parse_sites(df: DataFrame) -> DataFrame:
    return _fields(df).select(_s(0).alias("contig"), _n(1).alias("pos")).where("pos IS NOT NULL").distinct()


def parse_intervals(df: DataFrame) -> DataFrame:
    return _fields(df).where(~_s(0).startswith("track")).select(_s(0).alias("contig"), _n(1).alias("start"), _n(2).alias("end")).where("start IS NOT NULL AND end IS NOT NULL")


def parse_peaks(df: DataFrame) -> DataFrame:
    """read_id, then borders."""
    return _fields(df).select(_s(0).alias("read_id"), F.transform(F.slice("f", 2, F.size("f")), lambda x: x.cast("bigint")).alias("peaks"))


def parse_moves(df: DataFrame) -> DataFrame:
    """read_id, moves with the stride first (comma-separated), a tag that ends in the offset: border where a move is 1, and the end."""
    d = _fields(df).select(_s(0).alias("read_id"), F.split(_s(1), ",").alias("m"), F.element_at(F.split(_s(2), ":"), -1).cast("bigint").alias("o"))
    stride = F.get("m", F.lit(0)).cast("bigint")
    moves = F.slice("m", 2, F.greatest(F.lit(0), F.size("m") - 1))
    ones = F.filter(F.transform(moves, lambda x, i: F.when(x == "1", F.col("o") + i * stride)), lambda x: x.isNotNull())
    return d.select("read_id", F.concat(ones, F.array(F.col("o") + F.size(moves) * stride)).alias("peaks"))


def parse_levels(df: DataFrame) -> DataFrame:
    return _fields(df).where(F.lower(_s(0)) != "kmer").select(F.upper(_s(0)).alias("kmer"), _n(1, "double").alias("level")).where("level IS NOT NULL")


def parse_methyl(df: DataFrame, fmt: str) -> DataFrame:
    """contig, pos, cov, frac (0 to 1) from `encode` (coverage and percent in columns 9 and 10) or `bismark` (percent, counts)."""
    f = _fields(df)
    if fmt == "encode":
        d = f.select(_s(0).alias("contig"), _n(1).alias("pos"), _n(9).alias("cov"), (_n(10, "double") / 100).alias("frac"))
    elif fmt == "bismark":
        d = f.select(_s(0).alias("contig"), (_n(1) - 1).alias("pos"), (_n(4) + _n(5)).alias("cov"), (_n(3, "double") / 100).alias("frac"))
    else:
        raise ValueError(f"unknown layout: {fmt}")
    return d.where("pos IS NOT NULL AND cov IS NOT NULL AND frac IS NOT NULL")


def parse_bedmethyl(df: DataFrame) -> DataFrame:
    d = _fields(df).where(F.size("f") >= 11).select(_s(0).alias("contig"), _n(1).alias("pos"), _s(3).alias("code"), _n(4).alias("score"), _s(5).alias("strand"), _n(9).alias("n_valid"), (_n(10, "double") / 100).alias("frac"))
    return d.where("pos IS NOT NULL AND n_valid IS NOT NULL AND frac IS NOT NULL")


def parse_fasta(records: DataFrame) -> DataFrame:
    """records: one per contig, without the leading >."""
    d = records.where(F.length(F.trim("value")) > 0)
    name = F.split(F.split("value", r"\r?\n", 2)[0], r"\s+")[0]
    return d.select(name.alias("contig"), F.upper(F.regexp_replace(F.coalesce(F.get(F.split("value", r"\r?\n", 2), F.lit(1)), F.lit("")), r"\s", "")).alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return parse_fasta(spark.read.text(path, lineSep=">"))


def parse_gff(df: DataFrame, feature: str | None = None) -> DataFrame:
    """0-based half-open features with their attributes as a map."""
    f = _fields(df).where(F.size("f") >= 9)
    d = f.select(_s(0).alias("contig"), _s(2).alias("type"), (_n(3) - 1).alias("start"), _n(4).alias("end"), _n(5, "double").alias("score"), _s(6).alias("strand"), F.str_to_map(_s(8), F.lit(";"), F.lit("=")).alias("attr"))
    d = d.where("start IS NOT NULL AND end IS NOT NULL")
    return d if feature is None else d.where(F.col("type") == feature)


def parse_kinetics(df: DataFrame) -> DataFrame:
    """Comma-separated with a header; 1-based positions, strand 0 or 1."""
    return _fields(df, ",").select(F.regexp_replace(_s(0), '"', "").alias("contig"), (_n(1) - 1).alias("pos"), F.when(_s(2) == "0", "+").when(_s(2) == "1", "-").alias("strand"), _n(9).alias("cov")).where("pos IS NOT NULL AND cov IS NOT NULL AND strand IS NOT NULL")


#: Names that a site list's columns go by. Fixed values.
ALIASES = {"contig": ("contig", "chrom", "chromosome", "ref_name", "chr"), "pos": ("pos", "position", "ref_pos", "start"), "strand": ("strand",)}


def parse_site_list(df: DataFrame, header: list[str] | None = None, strand: str = "+") -> DataFrame:
    """Columns by header names, or contig, pos and strand in this order; the header's own line drops out as it has no position."""
    names = [h.lower() for h in header] if header else ["contig", "pos", "strand"]
    at = {k: next((names.index(a) for a in v if a in names), None) for k, v in ALIASES.items()}
    s = _s(at["strand"]) if at["strand"] is not None else F.lit(None).cast("string")
    d = _fields(df).select(_s(at["contig"]).alias("contig"), _n(at["pos"]).alias("pos"), F.coalesce(F.when(s.isin("+", "-"), s), F.lit(strand)).alias("strand"))
    return d.where("pos IS NOT NULL")


def parse_bisulfite(df: DataFrame, contigs: list[str] | None = None) -> DataFrame:
    f = _fields(df)
    d = f.select(_s(0).alias("contig"), _n(1).alias("pos"), _n(3).alias("n_meth"), _n(4).alias("n_unmeth"), _s(5).alias("strand"), _s(8).alias("ctx")).where("pos IS NOT NULL AND n_meth IS NOT NULL")
    return d if contigs is None else d.where(F.col("contig").isin(contigs))


def parse_calls(df: DataFrame, layout: str) -> DataFrame:
    """read_id, contig, pos, prob from one of five tools' layouts; unaligned calls drop out."""
    f = _fields(df, "," if layout == "C" else "\t")
    if layout == "A":
        d = f.select(_s(4).alias("read_id"), _s(0).alias("contig"), _n(1).alias("pos"), _n(8, "double").alias("prob"))
    elif layout == "B":
        d = f.select(_s(0).alias("read_id"), _s(1).alias("contig"), _n(2).alias("pos"), _n(3, "double").alias("prob"))
    elif layout == "C":
        d = f.select(_s(0).alias("read_id"), _s(1).alias("contig"), _n(2).alias("pos"), _n(3, "double").alias("prob"))
    elif layout == "D":  # read offsets: to be projected
        d = f.select(_s(0).alias("read_id"), F.lit(None).cast("string").alias("contig"), _n(1).alias("pos"), to_probability(_n(2, "double")).alias("prob"))
    elif layout == "E":  # a column for each code
        d = f.select(_s(0).alias("read_id"), _s(1).alias("contig"), _n(2).alias("pos"), code_sum(_n(3, "double"), _n(4, "double")).alias("prob"))
    else:
        raise ValueError(f"unknown layout: {layout}")
    return d.where("pos >= 0 AND prob IS NOT NULL")


def parse_site_scores(plus: DataFrame, minus: DataFrame) -> DataFrame:
    one = lambda d, s: _fields(d).select(_s(0).alias("contig"), _n(1).alias("pos"), F.lit(s).alias("strand"), _n(2, "double").alias("score"), _n(4).alias("n_reads")).where("pos IS NOT NULL AND score IS NOT NULL")
    return one(plus, "+").unionByName(one(minus, "-"))


def parse_track(df: DataFrame, model: str) -> DataFrame:
    return _fields(df).select(_s(0).alias("contig"), _n(1).alias("pos"), _n(2, "double").alias(model), _n(4).alias("n_reads")).where(F.col("pos").isNotNull() & F.col(model).isNotNull())


def parse_config(df: DataFrame, names: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """Tab-separated settings; columns in `lists` become arrays."""
    return _fields(df).select(*[(F.split(_s(i), ",") if n in lists else _s(i)).alias(n) for i, n in enumerate(names)])


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """Positions that were trained on; the filter reaches the scan."""
    return spark.read.parquet(path).where("split = 'train'").select("member", "contig", "pos")


def pool_shapes(pool: DataFrame, shape: list[str]) -> DataFrame:
    """Members whose images differ in shape from the pool's first: none, if the pool is sound."""
    s = pool.groupBy("member").agg(F.collect_set(F.concat_ws("x", *shape)).alias("shapes"))
    return s.where(F.size("shapes") > 1)


def contigs(ref: DataFrame) -> DataFrame:
    return ref.groupBy("contig").agg(F.max(F.length("seq")).alias("length"))


def parse_fai(df: DataFrame) -> DataFrame:
    return _fields(df).select(_s(0).alias("contig"), _n(1).alias("length")).where("length IS NOT NULL")


def parse_sam(df: DataFrame) -> DataFrame:
    """Text alignments: one row each, 0-based start, end from the CIGAR's reference-consuming operations."""
    f = _fields(df, comment="@").where(F.size("f") >= 11)
    ops = F.transform(F.regexp_extract_all(_s(5), F.lit(r"(\d+[MDN=X])"), F.lit(1)), lambda x: F.regexp_extract(x, r"\d+", 0).cast("bigint"))
    flag = _n(1, "int")
    d = f.select(_s(0).alias("read_id"), flag.alias("flag"), _s(2).alias("contig"), (_n(3) - 1).alias("start"), _n(4, "int").alias("mapq"), F.aggregate(ops, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("_span"), _s(9).alias("seq"))
    return d.withColumn("end", F.col("start") + F.col("_span")).withColumn("strand", F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")).drop("_span")
