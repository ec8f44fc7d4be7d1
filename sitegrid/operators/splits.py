"""Leakage-safe splits and leave-one-group-out folds."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.functions.scalar import hash_fraction, hash_key
from sitegrid.operators import ranges, ranking


def split_positions(df: DataFrame, keys: list[str], val: float, test: float, seed: int) -> DataFrame:
    """Column split by position, stratified by its label (the largest of its rows): all rows of a position go together.
    Every stratum of three positions or more has one at least in each part."""
    p = df.groupBy(*keys).agg(F.max("label").alias("_y"))
    p = ranking.numbered(p, ["_y"], hash_key(seed, *keys), *keys)
    size = lambda share: F.when(F.col("_n") >= 3, F.greatest(F.lit(1), F.bround(F.col("_n") * share))).otherwise(F.bround(F.col("_n") * share))
    p = p.withColumn("split", F.when(F.col("_rn") <= size(test), "test").when(F.col("_rn") <= size(test) + size(val), "val").otherwise("train"))
    return df.join(p.select(*keys, "split"), keys)


def hash_split(df: DataFrame, frac: float, seed: int, *cols: str) -> DataFrame:
    return df.withColumn("role", F.when(hash_fraction(*cols, seed=seed) < frac, "test").otherwise("train"))


def carve_val(df: DataFrame, frac: float, seed: int, keys: list[str]) -> DataFrame:
    """A validation share of train by position hash."""
    u = F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return df.withColumn("part", F.when(u < frac, "val").otherwise("train"))


def region_split(df: DataFrame, regions: DataFrame) -> DataFrame:
    inside = ranges.include_regions(df, regions).withColumn("role", F.lit("test"))
    return inside.unionByName(ranges.exclude_regions(df, regions).withColumn("role", F.lit("train")))


def leave_one_out(df: DataFrame, group: str, region: Column) -> DataFrame:
    """(row, fold, role) for every value of group: its rows are test in the region, all others train outside of it."""
    folds = df.select(F.col(group).alias("fold")).distinct()
    d = df.withColumn("_region", region).join(F.broadcast(folds))
    role = F.when((F.col(group) == F.col("fold")) & F.col("_region"), "test").when((F.col(group) != F.col("fold")) & ~F.col("_region"), "train")
    return d.withColumn("role", role).where("role IS NOT NULL").drop("_region")


def subset_folds(chems: list[str], least: int = 2, most: int = 4) -> list[tuple[str, list[str]]]:
    return [("+".join(c), list(c)) for n in range(least, most + 1) for c in combinations(sorted(chems), n)]


def site_share(*keys: str) -> Column:
    """A number from 0 to 1 by site, the same for all rows of it."""
    return F.conv(F.substring(hash_key(17, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fold(df: DataFrame, name: str, in_region: str = "in_region", base_ratio: float | None = None, base_of: dict[str, str] | None = None, controls: list[str] | None = None, natives: list[str] | None = None, oversampled: dict[str, int] | None = None) -> DataFrame:
    """Role of each row (chem, organism, label, base, member, in_region) in a fold.

    all: every row in the region is test. mixed: the same by hash of the site. loco_X: chemistry X is never trained on, and its
    rows are test; logo_X: organism X likewise. core_A+B and subset_A+B: only these chemistries are trained on, all others are test.
    Then, in this order: positives of the most frequent base of train are cut, by hash of the site, to about base_ratio times
    those of the second; controls go to the test part; native members leave it; a base without a positive in train keeps no
    negatives there (a model would learn the base); a chemistry may be repeated in train.
    """
    region = F.col(in_region)
    kind, _, what = name.partition("_")
    chem = F.coalesce("chem", F.lit(""))
    if kind == "all":
        role = F.when(region, "test").otherwise("train")
    elif kind == "mixed":
        role = F.when(site_share("contig", "pos") < 0.15, "test").otherwise("train")
    elif kind == "loco":
        role = F.when(chem == what, "test").when(F.col("label") == 0, F.when(region, "test").otherwise("train")).when(region, None).otherwise("train")
    elif kind == "logo":
        role = F.when(F.col("organism") == what, "test").when(region, None).otherwise("train")
    elif kind in ("core", "subset"):
        keep = what.split("+")
        role = F.when((F.col("label") == 0) | chem.isin(keep), F.when(region, "test").otherwise("train")).otherwise("test")
    else:
        raise ValueError(f"unknown fold: {name}")
    d = df.withColumn("role", role).where("role IS NOT NULL")
    if base_ratio is not None:
        mine = (F.col("role") == "train") & (F.col("label") == 1)
        top = d.where(mine).groupBy("base").count().orderBy(F.desc("count"), "base").limit(2).collect()
        if len(top) == 2 and top[0]["count"] > base_ratio * top[1]["count"]:
            share = base_ratio * top[1]["count"] / top[0]["count"]
            d = d.where(~(mine & F.col("base").eqNullSafe(top[0]["base"])) | (site_share("contig", "pos") < share))
    if controls:
        d = d.withColumn("role", F.when(F.col("member").isin(controls), "test").otherwise(F.col("role")))
    if natives:
        d = d.where((F.col("role") == "train") | ~F.col("member").isin(natives))
    if base_of is not None:
        own = d.where("role = 'train' AND label = 1").select("base").distinct()
        d = d.where("role = 'test'").unionByName(d.where("role = 'train'").join(F.broadcast(own), "base", "left_semi").select(d.columns))
    if oversampled:
        m = F.create_map(*[F.lit(x) for kv in oversampled.items() for x in kv])
        times = F.when(F.col("role") == "train", F.coalesce(m[chem], F.lit(1))).otherwise(1)
        d = d.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")
    return d.withColumn("fold", F.lit(name))


def disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both hold: none, if nothing leaks."""
    return a.select(*keys).intersect(b.select(*keys))


def assert_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    if not disjoint(a, b, keys).limit(1).isEmpty():
        raise ValueError(f"keys in both parts: {', '.join(keys)}")


def seen_table(pool: DataFrame) -> DataFrame:
    """Census of a pool by member and split, to be held against expected counts."""
    return pool.groupBy("member").pivot("split", ["train", "test", "unused"]).count().na.fill(0)
