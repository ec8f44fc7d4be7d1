"""Interval and position joins that stay linear: bins on the axis make range predicates equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1024
WORD = 64  # positions of one long in `marks`


def _bins(lo: Column, hi: Column, width: int) -> Column:
    """Bins that the half-open [lo, hi) touches; none if it is empty."""
    return F.when(hi > lo, F.sequence(F.floor(lo / width), F.floor((hi - 1) / width))).otherwise(F.array().cast("array<bigint>"))


def point_bits(points: DataFrame, **names: Column) -> DataFrame:
    """For `marks`: a bit for each point (contig, pos), in the columns whose condition the point meets."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(WORD)).cast("int"))
    return points.select("contig", F.shiftright(F.col("pos").cast("long"), 6).alias("_w"), *[F.when(c, bit).alias(n) for n, c in names.items()])


def span_bits(spans: DataFrame, **names: Column) -> DataFrame:
    """For `marks`: the bits from 0 on that spans (contig, start, end) cover, in the columns whose condition the span meets. Long
    spans are cut in two steps, so that none is listed word by word in one row."""
    far = WORD * BIN
    s, e = F.greatest(F.col("start").cast("long"), F.lit(0)), F.col("end").cast("long")
    d = spans.select("contig", s.alias("_s"), e.alias("_e"), *[c.alias(n) for n, c in names.items()]).where("_e > _s")
    for width, b in ((far, "_f"), (WORD, "_w")):
        d = d.select("contig", "_s", "_e", *names, F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor((F.col("_e") - 1) / width))).alias(b))
        lo = F.col(b) * width
        d = d.select("contig", b, F.greatest("_s", lo).alias("_s"), F.least("_e", lo + width).alias("_e"), *names)
    return d.select("contig", "_w", *[F.when(F.col(n), _mask("_s", "_e")).alias(n) for n in names])


def _mask(lo: str, hi: str) -> Column:
    """The bits of [lo, hi), which lies in the word _w."""
    ones, at = F.lit(-1).cast("long"), F.col("_w") * WORD
    left = F.call_function("shiftleft", ones, (F.col(lo) - at).cast("int"))
    return left.bitwiseAND(F.call_function("shiftrightunsigned", ones, (at + WORD - F.col(hi)).cast("int")))


def near_bits(points: DataFrame, flank: int, near: str, **names: Column) -> DataFrame:
    """point_bits, and as the column `near` the positions within flank of a point, from one pass over the points."""
    p = F.col("pos").cast("long")
    d = points.select("contig", p.alias("_p"), *[c.alias(n) for n, c in names.items()], F.explode(F.sequence(F.shiftright(p - flank, 6), F.shiftright(p + flank, 6))).alias("_w"))
    at = F.col("_w") * WORD
    d = d.withColumns({"_s": F.greatest(F.col("_p") - flank, at), "_e": F.least(F.col("_p") + flank + 1, at + WORD)})
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_p") - at).cast("int"))
    here = (F.col("_p") >= at) & (F.col("_p") < at + WORD)
    return d.select("contig", "_w", _mask("_s", "_e").alias(near), *[F.when(here & F.col(n), bit).alias(n) for n in names])


def marks(*parts: DataFrame) -> DataFrame:
    """Positions as bits: contig, _w and each column of the parts (point_bits, span_bits) as a long, whose bit i stands for position
    64 * _w + i. Bits are put together before they are shuffled, so what moves is a row for 64 positions, however often they occur."""
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in d.columns if c not in ("contig", "_w")]
    return d.groupBy("contig", "_w").agg(*[F.coalesce(F.bit_or(c), F.lit(0).cast("long")).alias(c) for c in names])


def merged(intervals: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """What intervals cover, as pieces (keys, _b, _s, _e) that neither overlap nor leave their bin. Of equal starts the longest is
    kept first, so a bin's window sorts `width` rows at most, however many intervals lie there; a bin has width / 2 pieces at most."""
    cut = intervals.select(*keys, "start", "end", F.explode(_bins(F.col("start"), F.col("end"), width)).alias("_b"))
    cut = cut.select(*keys, "_b", F.greatest("start", F.col("_b") * width).alias("_s"), F.least("end", (F.col("_b") + 1) * width).alias("_e")).groupBy(*keys, "_b", "_s").agg(F.max("_e").alias("_e"))
    w = Window.partitionBy(*keys, "_b").orderBy("_s")
    far = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("_new", F.when(F.col("_s") <= far, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    return cut.groupBy(*keys, "_b", "_g").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).drop("_g")


def inside(sites: DataFrame, intervals: DataFrame, keys: list[str], how: str, width: int = BIN) -> DataFrame:
    """sites whose pos lies in any interval of the same keys (left_semi) or in none (left_anti)."""
    iv = merged(intervals, keys, width).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.floor(F.col("pos") / width) == F.col("_b"), F.col("pos") >= F.col("_s"), F.col("pos") < F.col("_e")]
    return sites.join(iv, on, how)


def include_regions(sites: DataFrame, intervals: DataFrame, keys: list[str] | None = None, width: int = BIN) -> DataFrame:
    return inside(sites, intervals, keys or ["contig"], "left_semi", width)


def exclude_regions(sites: DataFrame, intervals: DataFrame, keys: list[str] | None = None, width: int = BIN) -> DataFrame:
    return inside(sites, intervals, keys or ["contig"], "left_anti", width)


def scorable(sites: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """Sites in a covered interval of their own strand."""
    return inside(sites, spans, ["contig", "strand"], "left_semi", width)


def overlapping(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Ids of left (read_id, contig, start, end) that overlap any interval of right."""
    a = left.select("read_id", "contig", "start", "end", F.explode(_bins(F.col("start"), F.col("end"), width)).alias("_b"))
    b = merged(right, ["contig"], width).withColumnsRenamed({"contig": "_c", "_b": "_bb"})
    on = (F.col("contig") == F.col("_c")) & (F.col("_b") == F.col("_bb")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))
    return a.join(b, on, "left_semi").select("read_id").distinct()


def drop_overlapping(aln: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """Whole reads go if any part of them overlaps an interval."""
    return aln.join(overlapping(aln, intervals, width), "read_id", "left_anti")


def keep_selected(calls: DataFrame, selection: DataFrame) -> DataFrame:
    """Calls at positions selected for their read: equal read and contig, start <= pos < end."""
    s = selection.select(F.col("read_id").alias("_r"), F.col("contig").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (F.col("read_id") == F.col("_r")) & (F.col("contig") == F.col("_c")) & (F.col("pos") >= F.col("_s")) & (F.col("pos") < F.col("_e"))
    return calls.join(s, on, "left_semi")


def to_intervals(sites: DataFrame, keys: list[str], width: int = 1 << 16) -> DataFrame:
    """Runs of consecutive positions as half-open intervals.

    Runs are found inside bins of the axis; those that touch at a bin's edge are joined by a window over runs that reach an
    edge, of which a bin has two at most. No contig is one task's positions.
    """
    w = Window.partitionBy(*keys, "_b").orderBy("pos")
    runs = sites.select(*keys, "pos").distinct().withColumn("_b", F.floor(F.col("pos") / width))
    runs = runs.withColumn("_run", F.col("pos") - F.row_number().over(w))
    runs = runs.groupBy(*keys, "_b", "_run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    edge = (F.col("start") % width == 0) | (F.col("end") % width == 0)
    v = Window.partitionBy(*keys).orderBy("start")
    new = (F.col("start") != F.coalesce(F.lag("end").over(v), F.lit(-1))).cast("long")
    cut = runs.where(edge).withColumn("_new", new).withColumn("_group", F.sum("_new").over(v))
    joined = cut.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.where(~edge).select(*keys, "start", "end").unionByName(joined.select(*keys, "start", "end"))


def nearest_distance(sites: DataFrame, ref: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Distance of each site to the nearest position of ref on its contig; null where there is none.

    Windows run over (contig, bin), so that no contig is one task; what a bin doesn't hold comes from the last and first
    positions of the bins around it, of which there are few.
    """
    bin_ = F.floor(F.col("pos") / width)
    r = ref.select("contig", "pos").distinct().withColumn("_b", bin_)
    ends = r.groupBy("contig", "_b").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    all_bins = ends.unionByName(sites.select("contig", bin_.alias("_b")).distinct(), allowMissingColumns=True).groupBy("contig", "_b").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    w = Window.partitionBy("contig").orderBy("_b")
    back = Window.partitionBy("contig").orderBy(F.desc("_b"))  # what follows, as what precedes in falling order: frames only grow
    around = all_bins.select("contig", "_b", F.last("_hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("_lo", True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    both = sites.withColumn("_b", bin_).withColumn("_site", F.lit(True)).unionByName(r.withColumn("_site", F.lit(False)), allowMissingColumns=True)
    p = F.when(~F.col("_site"), F.col("pos"))
    v = Window.partitionBy("contig", "_b").orderBy("pos")
    u = Window.partitionBy("contig", "_b").orderBy(F.desc("pos"))
    near = both.withColumns({"_l": F.last(p, True).over(v.rangeBetween(Window.unboundedPreceding, 0)), "_r": F.last(p, True).over(u.rangeBetween(Window.unboundedPreceding, 0))}).where("_site").join(around, ["contig", "_b"], "left")
    d = F.least(F.col("pos") - F.coalesce("_l", "_before"), F.coalesce("_r", "_after") - F.col("pos"))
    return near.withColumn("distance", d).drop("_b", "_site", "_l", "_r", "_before", "_after")


def exclude_near(sites: DataFrame, calls: DataFrame, flank: int) -> DataFrame:
    """Sites farther than flank from any call on either strand."""
    near = calls.select("contig", F.explode(F.sequence(F.col("pos") - flank, F.col("pos") + flank)).alias("pos")).distinct()
    return sites.join(near, ["contig", "pos"], "left_anti")
