"""What the operators of this folder share: table access, the shared folder, normal forms of text."""

from __future__ import annotations

import ctypes
import re
import uuid

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see.

    A cluster names it in spark.checkpoint.dir. Where that is unset, tests and one machine use a folder under the warehouse;
    on a cluster, whose warehouse may be local to the driver, it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back()  # the driver's share of a stage
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that written() made in this application. Results that are still lazy read them: write these first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and what they keep adds up over stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def ascii_lower(text: str) -> str:
    """A-Z only; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def least_count(counts: DataFrame, size: int) -> int:
    """The smallest count (column n) such that at most `size` rows have it or more."""
    left, least = size, None
    for r in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toLocalIterator():
        if (left := left - r.k) < 0:
            break
        least = r.n
    return least if least is not None else (1 << 31) - 1
