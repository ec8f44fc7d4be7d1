"""Runs in chunks that can be taken up again: a chunk is done when its mark says so, and done chunks aren't made again."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.sources.sinks import manifest

MARK = "done.json"


def _fs(spark: SparkSession, path: str):
    """Hadoop's view of a path, so that any store will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one step: under another name, then renamed."""
    fs, p = _fs(spark, path)
    tmp = p.suffix(".part")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"can't rename to {path}")


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())  # a mark is one line


def done(spark: SparkSession, root: str, chunk: str, verify: bool = False) -> bool:
    """Whether a chunk is complete: it has its mark, and, if asked, the content that the mark says."""
    text = _read_text(spark, f"{root}/{chunk}/{MARK}")
    if text is None:
        return False
    return not verify or json.loads(text)["content"] == _content(spark.read.parquet(f"{root}/{chunk}/data"))


def _content(df: DataFrame) -> list[str]:
    r = manifest(df.select(*sorted(df.columns))).first()
    return [str(r.n), str(r.xor), str(r["sum"])]


def run_chunks(spark: SparkSession, root: str, chunks: Iterable[str], make: Callable[[str], DataFrame], verify: bool = False, settings: dict | None = None) -> list[str]:
    """Makes each chunk that isn't done, in order; the names of those made.

    A chunk's table is written whole, then its mark, with rows, content hash and settings. A run that dies leaves the chunk that it was at
    without a mark; the next run makes that one anew and goes on. Marks of other settings are an error: their chunks aren't this run's.
    """
    made, want = [], settings or {}
    for c in chunks:
        text = _read_text(spark, f"{root}/{c}/{MARK}")
        if text is not None:
            if json.loads(text)["settings"] != want:
                raise ValueError(f"chunk {c} was made with other settings")
            if not verify or done(spark, root, c, True):
                continue
        make(c).write.mode("overwrite").parquet(f"{root}/{c}/data")
        content = _content(spark.read.parquet(f"{root}/{c}/data"))
        _write_text(spark, f"{root}/{c}/{MARK}", json.dumps({"rows": int(content[0]), "content": content, "settings": want}))
        made.append(c)
    return made


def read_chunks(spark: SparkSession, root: str, chunks: list[str]) -> DataFrame:
    """All chunks as one table with their number in column chunk; a chunk that isn't done is an error."""
    open_ = [c for c in chunks if not done(spark, root, c)]
    if open_:
        raise ValueError(f"not done: {', '.join(open_)}")
    out = None
    for i, c in enumerate(chunks):
        d = spark.read.parquet(f"{root}/{c}/data").withColumn("chunk", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out


def merge_chunks(spark: SparkSession, root: str, chunks: list[str], columns: list[str], order: list[str], out: str, sep: str = "\t", parts: int | None = None) -> int:
    """Writes all chunks in order as text under one header: parts that give one file when they are put together by name.

    Rows go by chunk, then by `order`. They are dealt by ranges, so that no task holds all; the header is the first row of the first part.
    Returns how many rows.
    """
    d = read_chunks(spark, root, chunks).select(F.lit(1).alias("_h"), "chunk", *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
    n = d.count()
    blank = [F.lit(None).cast(d.schema[f"_{i}"].dataType).alias(f"_{i}") for i in range(len(order))]
    head = spark.range(1).select(F.lit(0).alias("_h"), F.lit(-1).alias("chunk"), *blank, F.lit(sep.join(columns)).alias("value"))
    keys = ["_h", "chunk", *[f"_{i}" for i in range(len(order))], "value"]
    whole = head.unionByName(d)
    k = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole.repartitionByRange(k, *keys).sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(out)
    return n
