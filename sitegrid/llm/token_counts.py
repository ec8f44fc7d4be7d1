"""Token counts without ids: pieces are counted once for each distinct pre-token, and joined to documents' frequencies.

1. The DICT most frequent pre-tokens of all texts go through the tokenizer: a dictionary of bounded size for all tasks.
2. Documents are cut into pre-tokens, in chunks (chunks.py): each document's frequencies of the distinct pre-tokens of its
   chunk. Those of the dictionary are joined there; the others stay in a table of chunks. It is written, so that nothing
   later depends on how a task ran.
3. The distinct pre-tokens of that table go through the tokenizer once each. Their counts are joined to the chunks'
   pre-tokens, a row for each (chunk, pre-token), go back to their chunk, and frequency times count is summed for each document.

Special strings in a text (such as <|endoftext|>) are one token each and part the text, as the library has it by default.
A pre-token whose count doesn't arrive is an error, never a zero.

Cases: null and empty text have no tokens and no bytes; repeated rows and ids are counted row by row; other columns are
left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sitegrid.llm.chunks import chunks_of, frequent, loosen, rows_and_text, squeeze
from sitegrid.llm.common import table, written

DICT, SPECIAL, BATCH = 300_000, "<|endoftext|>", 1_000


def pieces(words: DataFrame, vocabulary: str) -> DataFrame:
    """w with its number of pieces k. vocabulary: the text of the tokenizer's JSON file."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(shared.value)
        t.no_truncation()
        t.no_padding()
        for batch in it:
            w = batch.column("w")
            for lo in range(0, len(w), BATCH):
                part = w.slice(lo, BATCH)
                k = [len(e) for e in t.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part, pa.array(k, pa.int32())], names=["w", "k"])

    return words.mapInArrow(count, "w string, k int")


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, special: str = SPECIAL, id_col: str = "doc_id", text_col: str = "text", size: int = DICT) -> DataFrame:
    """id, n_bytes, n_tokens for each row of docs."""
    sc = docs.sparkSession.sparkContext
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_special = F.size(F.split(text, rf"\Q{special}\E", -1)) - 1 if special else F.lit(0)
    d = docs.select(F.col(id_col).alias("i"), F.octet_length(text).cast("long").alias("b"), n_special.cast("long").alias("s"), text.alias("t"))
    tasks = 2 * sc.defaultParallelism
    top = written(pieces(frequent(d, F.col("t"), pattern, special, size).repartition(tasks), vocabulary), "pieces").toArrow().combine_chunks()  # at most `size` words
    shared = sc.broadcast([top[c].combine_chunks() if len(top) else pa.array([], kind) for c, kind in (("w", pa.string()), ("k", pa.int32()))])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk its documents with what the dictionary counts, its other words, and who has them how often."""
        import uuid

        words, k = shared.value
        k = np.asarray(k).astype(np.int64)
        for chunk in chunks_of(it, pattern, special, in_order=False):
            at, rest = chunk.split(words)
            code, count, starts = at[chunk.codes], chunk.counts, chunk.starts
            new = code >= len(k)
            n = np.concatenate([[0], np.cumsum(np.append(k, 0)[np.minimum(code, len(k))] * count)])[starts]
            rows = chunk.rows
            rows = pa.StructArray.from_arrays([rows.field("i"), rows.field("b"), pa.array(np.diff(n) + np.asarray(rows.field("s")))], names=["i", "b", "n"])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows, rest)]
            numbers = np.concatenate([[0], np.cumsum(new)])[starts], code[new] - len(k), count[new]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, *(pa.array([squeeze(x)], pa.binary()) for x in numbers)], names=["chunk", "rows", "words", "starts", "codes", "counts"])

    row = StructType([StructField("i", docs.schema[id_col].dataType), *StructType.fromDDL("b long, n long").fields])
    chunk_type = StructType([StructField("chunk", StringType()), StructField("rows", ArrayType(row)), *StructType.fromDDL("words array<string>, starts binary, codes binary, counts binary").fields])
    chunks = written(rows_and_text(d, ["i", "b", "s"], F.col("t")).mapInArrow(cut, chunk_type), "chunks")
    asked = chunks.select("chunk", F.posexplode("words").alias("at", "w"))
    known = pieces(asked.select("w").distinct(), vocabulary)
    told = asked.join(known, "w").groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("k").alias("k"))  # CHUNK_WORDS at most, and a document's
    whole = chunks.select("chunk", "rows", "starts", "codes", "counts", F.size("words").alias("n_words")).join(told, "chunk", "left")

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in range(len(batch)):
                rows, at, k = (batch.column(c).slice(b, 1).flatten() for c in ("rows", "at", "k"))
                pieces_of = np.full(batch.column("n_words")[b].as_py(), -1, np.int64)
                pieces_of[np.asarray(at)] = k
                if (pieces_of < 0).any():
                    raise ValueError("a pre-token has no count")
                starts, codes, counts = (loosen(batch.column(c)[b].as_py()) for c in ("starts", "codes", "counts"))
                n = np.diff(np.concatenate([[0], np.cumsum(pieces_of[codes] * counts)])[starts]) + np.asarray(rows.field("n"))
                yield pa.RecordBatch.from_arrays([rows.field("i"), rows.field("b"), pa.array(n)], names=[id_col, "n_bytes", "n_tokens"])

    fields = [StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("n_bytes long, n_tokens long").fields]
    return whole.mapInArrow(sums, StructType(fields))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    got = token_counts(table(spark, sf_dir, "documents"), vocabulary, p.PATTERN)
    return got.withColumn("over_limit", F.col("n_tokens") > 512)
