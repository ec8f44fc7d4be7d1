"""Byte-level BPE: encoding and decoding by ranked merges.

Texts are cut into pre-tokens by the tokenizer's pattern, in chunks in which each distinct pre-token stands once
(chunks.py). The ranked merges are one fold with Spark's higher-order functions over the bytes of a distinct word. Its state is
an array with a number for each piece, from high to low bits: the rank of the piece that it makes with the next one, the place
of its first byte, its id. The least number is the pair of lowest rank, the leftmost of equal ones; a step joins this pair.
Ranks come from a map from pairs of ids to the joined piece's rank, dealt into small buckets so that a look-up is short.
Decoding looks each id's bytes up in an array and concatenates them. Both come by a broadcast join with rows of many words.
Then ids and bytes of the words are put in the order of each text.

The fold runs once for each of the DICT most frequent words of the corpus; these go to all tasks as a dictionary of bounded
size. Other words are folded once in each chunk that has them, by the same expression: most are in one or two, and one
fold for the whole corpus would need the coded texts written and shuffled, about twice the input. So no text is
shuffled, and any word gets the same ids either way. Chunks are written before they are folded, with the columns asked for:
cutting and putting together never run in one task, which would hold two Python workers, and a lost executor's chunks
needn't be cut again.

The fold's arrays are copied at each step, so its time is quadratic in a word's length. Words over LONG bytes, such as a line
without a space, are merged by a heap instead (merge_long): the same rule, the same ids.

Bytes are held as strings with one character (U+0000 to U+00FF) per byte. Cases: null text is empty; an empty text has no
tokens; repeated rows stay as they are; of docs' columns one named like the result is replaced; an empty table gives no
rows; a text that its ids don't give back is an error.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from sitegrid.llm.chunks import chunks_of, frequent, loosen, rows_and_text, squeeze
from sitegrid.llm.common import give_back, table, written

DICT, BUCKETS, LONG = 300_000, 32_749, 128
NONE = 1 << 25  # over all ranks
_ID, _PLACE = 1 << 17, 1 << 20


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def joins(ranks: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """Of each piece every pair of pieces that it is made of, and its own rank."""
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                yield a, b, rank


class Ranks:
    """Map of pairs and array of pieces for expressions. All 256 single bytes must be pieces.

    They are a table with one row, joined to rows of many words. As literals they stood in full in each text of a plan that the driver
    makes, and it keeps these: 8 MB and more for each write."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        pieces = [""] * (max(ranks.values()) + 1)
        if len(pieces) > _ID:
            raise ValueError(f"more than {_ID} pieces")
        for b, r in ranks.items():
            pieces[r] = b.decode("latin-1")
        pairs = np.fromiter((x for a, b, r in joins(ranks) for x in (a * _ID + b, r)), np.int64).reshape(-1, 2)
        bucket = pairs[:, 0] % BUCKETS
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        maps = pa.MapArray.from_arrays(pa.array(starts, pa.int32()), pa.array(pairs[order, 0]), pa.array(pairs[order, 1], pa.int32()))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        self.table = written(spark.createDataFrame(pa.table({"_pairs": one(maps), "_pieces": one(pa.array(pieces))})), "bpe-ranks")
        self.bytes = F.from_json(F.lit(json.dumps([ranks[bytes([i])] for i in range(256)])), "array<int>")  # a literal

    def each(self, df: DataFrame, words: str, make: Callable[[Column, Column, Column], Column], out: str) -> DataFrame:
        """df and make(word, map, pieces) of each word of an array."""
        pairs = F.col("_pairs").cast("array<map<bigint,bigint>>")  # also makes objects of packed rows, which are faster to look up
        made = F.transform(F.array(pairs), lambda m: F.transform(words, lambda w: make(w, m, F.col("_pieces"))))[0]
        return df.join(F.broadcast(self.table)).select(*df.columns, made.alias(out))

    def rank(self, m: Column, a: Column, b: Column) -> Column:
        """Of the piece that a and b make, NONE if there is none. m: the map, bound once for all its uses."""
        key = a * _ID + b
        return F.coalesce(m[(key % BUCKETS).cast("int")][key], F.lit(NONE))

    def merged(self, m: Column, word: Column) -> Column:
        """Ids of a word, given as one character for each byte."""
        bind = lambda x, f: F.transform(F.array(x), f)[0]
        id_of = lambda x: x % _ID
        high = _ID * _PLACE
        state = lambda a: F.struct(a.alias("a"), F.array_min(a).alias("m"))
        single = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: self.bytes[F.ascii(F.substring(word, i, F.lit(1)))].cast("bigint"))
        pairs = lambda p: F.transform(p, lambda x, i: self.rank(m, x, F.get(p, i + 1)) * high + i * _ID + x)

        def join(a: Column, least: Column) -> Column:
            new = F.shiftright(least, 37)  # the rank: the joined piece's id

            def of(x: Column, i: Column) -> Column:
                first = self.rank(m, new, id_of(F.get(a, i + 2))) * high + least % high - least % _ID + new
                before = self.rank(m, id_of(x), new) * high + x % high
                return F.when(x == least, first).when(F.get(a, i + 1) == least, before).when(F.get(a, i - 1) != least, x).when(i == 0, x)

            return F.filter(F.transform(a, of), lambda x: x.isNotNull())

        step = lambda acc, _: F.when(acc["m"] < NONE * high, bind(join(acc["a"], acc["m"]), state)).otherwise(acc)
        fold = F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), bind(bind(single, pairs), state), step)["a"]
        return F.when(F.length(word) < 2, single).otherwise(F.transform(fold, id_of))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word: pairs wait in a heap by rank and place, pieces are linked to their neighbours."""
    n = len(word)
    end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # of the piece that starts here: its end, the start of the one before
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = end[i]
        if j < 0 or j >= n or end[j] != stop:  # one of the two has been joined to another since
            continue
        end[i], end[j] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(queue, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def with_ids(docs: DataFrame, text: Column, ranks: dict[bytes, int], pattern: str, out: str = "bpe", size: int = DICT, keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those of keep) and a struct column: n_tokens, ids (decimal, joined by one space), decoded
    (bytes from the ids)."""
    sc = docs.sparkSession.sparkContext
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    tables = Ranks(docs.sparkSession, ranks)

    def coded(w: Column, m: Column, pieces: Column) -> Column:
        """n, ids and bytes of a word; null if it is long."""
        text = lambda ids: F.array_join(F.transform(ids, lambda i: pieces[i]), "")
        made = lambda ids: F.struct(F.size(ids).alias("n"), F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"), F.encode(text(ids), "ISO-8859-1").alias("bytes"))
        short = lambda x: F.transform(F.array(tables.merged(m, x)), made)[0]
        return F.when(F.octet_length(w) <= LONG, F.transform(F.array(F.decode(F.encode(w, "UTF-8"), "ISO-8859-1")), short)[0])

    top = frequent(docs, text, pattern, "", size).where(F.octet_length("w") <= LONG)
    parts = 4 * sc.defaultParallelism
    groups = top.groupBy(F.pmod(F.xxhash64("w"), F.lit(parts)).alias("part")).agg(F.collect_list("w").alias("words")).repartition(parts)  # at most `size` words in all
    top = written(tables.each(groups, "words", coded, "e").select(F.inline(F.arrays_zip("words", "e")).alias("w", "e")), "bpe-words")
    if not top.where(~F.coalesce(F.col("e.bytes") == F.encode("w", "UTF-8"), F.lit(False))).isEmpty():
        raise ValueError("ids don't give their word back")
    rows = top.select("w", "e.n", "e.ids").toArrow()  # at most `size` words
    column = lambda c, kind: rows[c].combine_chunks().cast(kind) if len(rows) else pa.array([], kind)
    shared = sc.broadcast((ranks, column("w", pa.string()), column("n", pa.int64()), column("ids", pa.binary())))
    del rows
    give_back()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(it, pattern):
            at, rest = chunk.split(shared.value[1])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (chunk.rows, rest)]
            made = pa.RecordBatch.from_arrays([*lists, *(pa.array([squeeze(x)], pa.binary()) for x in (chunk.starts, at[chunk.codes]))], names=["rows", "words", "starts", "codes"])
            del chunk, at, rest, lists  # the next one is cut without them
            yield made
        give_back()

    def put_together(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, top, top_n, top_ids = shared.value
        back = {r: b for b, r in ranks.items()}
        for batch in it:
            for k in range(len(batch)):
                rows, words, e = (batch.column(c).slice(k, 1).flatten() for c in ("rows", "words", "e"))
                n, ids, raw = (e.field(c) for c in ("n", "ids", "bytes"))
                n, ids = np.array(n.fill_null(0)).astype(np.int64), ids.cast(pa.binary())
                if e.null_count:
                    got = [merge_long(w.encode(), ranks) for w in words.filter(e.is_null()).to_pylist()]
                    n[np.asarray(e.is_null())] = [len(x) for x in got]
                    ids = pc.replace_with_mask(ids, e.is_null(), pa.array([" ".join(map(str, x)).encode() for x in got], pa.binary()))
                    raw = pc.replace_with_mask(raw, e.is_null(), pa.array([b"".join(back[i] for i in x) for x in got], pa.binary()))
                check(raw, words)
                codes, starts = (loosen(batch.column(c)[k].as_py()) for c in ("codes", "starts"))
                place = pa.array(codes)
                joined = lambda a, b, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), pa.concat_arrays([a, b]).take(place)), by)  # noqa: B023, E731
                total = np.concatenate([[0], np.cumsum(np.concatenate([np.asarray(top_n), n])[codes])])[starts]
                made = pa.StructArray.from_arrays([pa.array(np.diff(total)), joined(top_ids, ids, b" "), joined(top.cast(pa.binary()), raw, b"")], names=["n_tokens", "ids", "decoded"])
                yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in range(len(kept))), made], names=[*kept, out])
                del rows, words, e, n, ids, raw, codes, starts, place, total, made
                give_back()

    fields = [docs.schema[c] for c in kept]
    chunk_type = StructType([StructField("rows", ArrayType(StructType(fields))), *StructType.fromDDL("words array<string>, starts binary, codes binary").fields])
    chunks = written(rows_and_text(docs, kept, text).mapInArrow(cut, chunk_type), "bpe-chunks")
    return tables.each(chunks, "words", coded, "e").mapInArrow(put_together, StructType([*fields, StructField(out, StructType.fromDDL("n_tokens long, ids binary, decoded binary"))]))


def check(decoded: pa.Array, words: pa.Array) -> None:
    if not decoded.equals(words.cast(pa.binary())):
        raise ValueError("ids don't give their word back")


def digests(docs: DataFrame, text: Column, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    df = with_ids(docs, text, ranks, pattern, keep=["doc_id"])
    return df.select("doc_id", F.col("bpe.n_tokens").alias("n_tokens"), F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, F.col("text"), vocabulary(p.path("byte_bpe_50k.tiktoken")), p.PATTERN)
