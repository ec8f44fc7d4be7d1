"""Outputs: ground-truth pairs, equal chunks, image tables, tracks, metric tables, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_gt(gt: DataFrame, candidates: DataFrame, path: str) -> None:
    for name, d in (("gt", gt), ("cand", candidates)):
        d.select("contig", "pos").distinct().orderBy("contig", "pos").write.mode("overwrite").option("sep", "\t").csv(f"{path}/{name}.bed")


def chunk_ids(df: DataFrame, n: int, order: list[str], block: int = 1 << 20) -> DataFrame:
    """Rows in `order` dealt into at most n equal contiguous chunks (column chunk). Row numbers come from ranges of the first
    order column: sizes of the ranges give offsets, so that no single window orders all rows."""
    from pyspark.sql import Window

    total = df.count()
    size = max(1, -(-total // n))
    key = F.xxhash64(*order)
    parts = max(1, min(1024, total // 10_000))
    cuts = df.select(order[-1]).where(F.col(order[-1]).isNotNull()).agg(F.percentile_approx(F.col(order[-1]).cast("double"), [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    b = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < F.col(order[-1]))) if cuts else F.lit(0)
    d = df.withColumn("_b", b)
    before = d.groupBy("_b").count().withColumn("_o", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    w = Window.partitionBy("_b").orderBy(order[-1], *order[:-1], key)
    return d.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(before), "_b").withColumn("chunk", F.floor((F.col("_o") + F.col("_rn") - 1) / size).cast("int")).drop("_b", "_rn", "_o")


def write_chunks(df: DataFrame, n: int, order: list[str], path: str) -> None:
    chunk_ids(df, n, order).repartition("chunk").sortWithinPartitions("chunk", *order).write.mode("overwrite").partitionBy("chunk").option("sep", "\t").csv(path)


def write_images(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("member", "strand").option("compression", "zstd").parquet(path)


def write_track(df: DataFrame, path: str) -> None:
    df.select("contig", "pos", "score", "label", "n_reads").write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_windows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same keys; all other old rows stay."""
    return old.join(new, keys, "left_anti").unionByName(new)


def manifest(df: DataFrame) -> DataFrame:
    """Row count and a content hash that no order of rows changes; doubled rows count."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum"))


def verify_manifest(df: DataFrame, expected: DataFrame) -> None:
    if manifest(df).first() != expected.first():
        raise ValueError("content differs from its manifest")
