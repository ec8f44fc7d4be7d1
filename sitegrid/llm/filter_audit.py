"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

1. One pass over the texts gives each document the set of the filters that it fails (bits A to D), and its text's SHA-256.
2. Filter E (a copy of a smaller id's text) fails where the document isn't the first of its text. Firsts are the least id
   for each digest; documents find theirs by digest and id together, so that no task gets a group of copies.
3. Each document becomes a 32-bit word: bit S is set if it survives the subset S of the filters. Carry-save adders count
   each of the 32 positions over many words at once (positional_popcounts), by part and label: rows of a few dozen numbers for
   each task.
4. Every figure of every order is a difference of two subsets' survivors; the Shapley value is the weighted sum of a filter's
   removals over all subsets of the others, times the number of orders.

Cases: null text is empty (it fails A alone, and E after the first empty one); null lang is the part ''; a row without an id
never fails E, hides no other row and has no labels; repeated rows count one by one, none fails E for its own repeats; an id
labelled several times has a label if one row says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sitegrid.llm.common import table, written

FILTERS = "ABCDE"
LABELS = ("all", "good", "toxic")
SUBSETS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
_CAPITALS = bytes(range(65, 91))


def fails(raw: bytes, chars: int) -> int:
    """Bits of the filters A to D that a text fails. bytes.split parts at the six ASCII white space characters."""
    words = raw.split()
    n = len(words)
    return (n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * n) << 1 | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MAX_CAPITALS * chars) << 2 | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


def with_fails(docs: DataFrame, id_col: str, part_col: str, text_col: str) -> DataFrame:
    """i, part, fails (A to D), digest for each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in it:
            bits, digests = [], []
            for t in batch.column(2):
                raw = b"" if (t := t.as_py()) is None else t.encode()
                bits.append(fails(raw, len(t or "")))
                digests.append(sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=["i", "part", "fails", "digest"])

    fields = [StructField("i", docs.schema[id_col].dataType), *StructType.fromDDL("part string, fails int, digest binary").fields]
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(run, StructType(fields))


def positional_popcounts(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits. Three words of one weight become a sum and a carry until two are left."""
    counts, weight = np.zeros(32, np.int64), 0
    level = np.asarray(words, np.uint32)
    while len(level):
        carries = [level[:0]]
        while (n := len(level) // 3):
            a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
            x = a ^ b
            carries.append(a & b | x & c)
            level = np.concatenate([x ^ c, level[3 * n :]])
        counts += (level[:, None] >> np.arange(32, dtype=np.uint32) & 1).sum(0, dtype=np.int64) << weight
        level, weight = np.concatenate(carries), weight + 1
    return counts


#: For each set of failed filters the word of the subsets survived.
SURVIVES = np.array([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], np.uint32)


def survivors(rows: DataFrame) -> DataFrame:
    """part, subset and the survivors by label, from part, fails (all filters), good, toxic."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in it:
            parts = batch.column(0).dictionary_encode()
            code, words = np.asarray(parts.indices), SURVIVES[np.asarray(batch.column(1))]
            marks = [np.ones(len(code), bool), *(np.asarray(batch.column(k).cast(pa.int8())).astype(bool) for k in (2, 3))]
            for k, part in enumerate(parts.dictionary.to_pylist()):
                total[part] = total.get(part, 0) + np.stack([positional_popcounts(words[(code == k) & m]) for m in marks])
        for part, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part] * SUBSETS, pa.string()), pa.array(range(SUBSETS), pa.int32()), *map(pa.array, n)], names=["part", "subset", *LABELS])

    counts = rows.select("part", "fails", "good", "toxic").mapInArrow(run, "part string, subset int, all long, good long, toxic long")
    return counts.groupBy("part", "subset").agg(*(F.sum(f"`{c}`").alias(c) for c in LABELS))


def orders() -> list[dict]:
    """Every step of every order: the subset of filters before it, and its filter."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[x] for x in order), "step": step + 1, "before": before, "bit": 1 << k})
            before |= 1 << k
    return out


def audit(rows: DataFrame) -> DataFrame:
    """The report, from part, fails (all five), good, toxic."""
    by_part = survivors(rows).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *LABELS))).alias("n"))  # 32 rows
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order:string,step:int,before:int,bit:int>>")
    every, first = SUBSETS - 1, by_part.select("part", "n", F.explode(steps).alias("s")).select("part", "n", "s.*")
    at = lambda s, label="all": F.col("n")[s][label]
    lost = lambda label: at(F.col("before"), label) - at(F.col("before").bitwiseOR(F.col("bit")), label)
    # orders in which exactly the filters of a subset come before a given other one
    weight = F.from_json(F.lit(json.dumps([[24, 6, 4, 6, 24, 0][s.bit_count()] for s in range(SUBSETS)])), "array<long>")

    def removals(s: Column) -> Column:
        return F.when(s.bitwiseAND(F.col("bit")) != 0, F.lit(0).cast("long")).otherwise(weight[s] * (at(s) - at(s.bitwiseOR(F.col("bit")))))

    return first.select(
        "part", "filter_order", "step",
        at(F.col("before").bitwiseOR(F.col("bit"))).alias("kept"),
        lost("all").alias("removed"),
        (at(F.lit(0)) - at(F.col("bit")) - lost("all")).alias("redundant"),
        (at(F.lit(every).bitwiseXOR(F.col("bit"))) - at(F.lit(every))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.aggregate(F.sequence(F.lit(0), F.lit(every)), F.lit(0).cast("long"), lambda acc, s: acc + removals(s)).alias("shapley"),
    )


def with_all_fails(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """part, fails (all five bits), good, toxic for each row of docs. labels: doc_id, quality, toxic."""
    d = written(with_fails(docs, id_col, part_col, text_col), "fails")
    firsts = d.where("i IS NOT NULL").groupBy("digest").agg(F.min("i").alias("i")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("i")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = d.where("i IS NOT NULL").join(firsts, ["i", "digest"], "left").join(marks, "i", "left")
    copy = F.when(F.col("first").isNull(), F.lit(16)).otherwise(F.lit(0))
    no = F.lit(False)
    known = known.select("part", (F.col("fails") + copy).alias("fails"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return known.unionByName(d.where("i IS NULL").select("part", "fails", no.alias("good"), no.alias("toxic")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(with_all_fails(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
