"""Pools of image tables and tables of signals: one logical table over members, with a contract."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType, StructType

SHAPE = ("height", "width", "channels")
IMAGES = StructType().add("contig", "string").add("pos", "long").add("image_idx", "integer").add("n_reads", "long").add("label", "integer").add("height", "integer").add("width", "integer").add("channels", "integer").add("tensor", "binary")


class Pool(NamedTuple):
    """images: all rows with their member and its place in the list. members: member, file, images, positives."""

    images: DataFrame
    members: DataFrame


def shapes(images: DataFrame) -> DataFrame:
    """member, shape, n: how many images of each shape a member has; tensors that don't fill their shape are shape `broken`."""
    full = F.octet_length("tensor") == 4 * F.col("height").cast("long") * F.col("width") * F.col("channels")
    return images.groupBy("member", F.when(full, F.concat_ws("x", *SHAPE)).otherwise("broken").alias("shape")).agg(F.count("*").alias("n"))


def _missing(have: StructType, want: StructType) -> list[str]:
    types = {f.name: f.dataType for f in have.fields}
    same = lambda a, b: a == b or (isinstance(a, NumericType) and isinstance(b, NumericType))
    return [f.name for f in want.fields if f.name not in types or not same(types[f.name], f.dataType)]


def read_pool(spark: SparkSession, paths: dict[str, str], members: list[str] | None = None, check: bool = True, schema: StructType = IMAGES) -> Pool:
    """Image tables, one Parquet folder for each member, as one table.

    members: which of them, in this order; no other folder is read. Columns beyond the contract are left out, numbers of other width are
    cast. A folder that lacks a column, an empty list, or an image of another shape than the first member's is an error that names it;
    check=False skips the pass over shapes, for a pool that has been checked.
    """
    names = list(paths) if members is None else list(members)
    if not names:
        raise ValueError("no members")
    unknown = [n for n in names if n not in paths]
    if unknown:
        raise ValueError(f"unknown members: {', '.join(unknown)}")
    out = None
    for i, name in enumerate(names):
        d = spark.read.parquet(paths[name])
        if gone := _missing(d.schema, schema):
            raise ValueError(f"{name} lacks {', '.join(gone)}")
        d = d.select(F.lit(name).alias("member"), F.lit(i).alias("file"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        out = d if out is None else out.unionByName(d)
    if check:
        contract(out, names)
    g = out.groupBy("member", "file").agg(F.count("*").alias("images"), F.count_if(F.col("label") > 0).alias("positives"))
    return Pool(out, g)


def contract(images: DataFrame, names: list[str]) -> None:
    """All images of the pool have one shape, that of the first member's most frequent."""
    s = shapes(images).collect()  # a few shapes of each member
    own = [r for r in s if r.member == names[0]] or s
    if not own:
        return
    want = max(own, key=lambda r: (r.n, r["shape"]))["shape"]
    wrong = sorted(f"{r.member}: {r['shape']} ({r.n})" for r in s if r["shape"] != want or r["shape"] == "broken")
    if wrong:
        raise ValueError(f"images are {want}, but not all: {'; '.join(wrong)}")


def select(pool: Pool, condition: Column) -> Pool:
    """Rows of some members: a filter on member or file prunes whole folders."""
    return Pool(pool.images.where(condition), pool.members.where(condition))


def source_keys(images: DataFrame) -> DataFrame:
    """Rows with source: the member, contig and position, so that one coordinate of two members are two sources."""
    return images.withColumn("source", F.concat_ws("::", "member", "contig", F.col("pos").cast("string")))


def read_signals(spark: SparkSession, paths: list[str], ids: DataFrame | None = None) -> DataFrame:
    """read_id, signal (array of double) from Parquet tables of (read_id, signal) or (read_id, signal, scale, offset).

    Raw numbers of the second kind become (x + offset) * scale. ids (read_id): only these reads. A read that stands twice is an error
    where its signal is used, not a silent choice.
    """
    out = None
    for p in paths:
        d = spark.read.parquet(p)
        kind = {f.name: f.dataType for f in d.schema.fields}
        if not isinstance(kind.get("read_id"), (StringType, NumericType)) or not isinstance(kind.get("signal"), ArrayType) or not isinstance(kind["signal"].elementType, NumericType):
            raise ValueError(f"{p} isn't a table of signals")
        x = F.col("signal").cast("array<double>")
        if {"scale", "offset"} <= set(kind):
            x = F.transform(x, lambda v: (v + F.col("offset")) * F.col("scale"))
        d = d.select("read_id", x.alias("signal"))
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no signals")
    if ids is not None:
        out = out.join(ids.select("read_id").distinct(), "read_id", "left_semi")
    g = out.groupBy("read_id").agg(F.count("*").alias("_n"), F.first("signal").alias("signal"))
    twice = F.raise_error(F.concat(F.lit("two signals of read "), F.col("read_id").cast("string")))
    return g.select("read_id", F.when(F.col("_n") > 1, twice.cast("array<double>")).otherwise(F.col("signal")).alias("signal"))
