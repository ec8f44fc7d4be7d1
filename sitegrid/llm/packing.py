"""Best-fit packing of documents into sequences of a fixed number of tokens, with a swap-based local search.

1. Texts are encoded in their partitions. A text is cut at ASCII white space, which no token crosses and no step of the
   tokenizer looks across; each distinct word goes through the tokenizer once for each worker (memo.py), many words in one call.
   A document is its ids and an end id. Only a document over the capacity is cut; what is left of it is its last piece.
2. Pieces (numbers only; no ids, no texts) are dealt into chunks of CHUNK pieces as they were written, without a shuffle. In a
   chunk each piece goes, the longest first, to the fullest sequence that takes it. Then pieces of the emptiest underfull sequence are
   moved to others, or exchanged one for one or two for one, always the exchange that fills most; each raises the sum of
   squared fills, so the search ends; it goes on until no sequence empties any more (search).
3. Each chunk hands its KEEP emptiest underfull sequences on. They are gathered in tasks of about CHUNK pieces, whole, and
   searched on together, round by round, until one task has them all. All other sequences stay as they are.

A row of the packed table is a sequence with its pieces. Everything but the encoding is linear in pieces. A search stops after
PATIENCE sequences in a row couldn't be emptied: this bounds effort, and leaves no piece out.

Cases: null and empty texts are documents of the end id alone; repeated rows and ids are packed row by row; special strings in
a text are their tokens, as the library has it by default; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sitegrid.llm.common import give_back, table, written
from sitegrid.llm.memo import Memo, byte_of, kept

CAPACITY, END = 4_096, 1
CHUNK, KEEP, PATIENCE = 50_000, 64, 32
MEMO_WORDS, CALL_WORDS, CALL_CHARS = 1_000_000, 2_000, 1_000_000
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]{1,200})([.,;:!?]?)").fullmatch  # composed letters whose lower case is one letter
MARK = "\ue000"  # stands between words in one call


class Words:
    """The tokenizer, for distinct words.

    Most words are letters with at most one stop after them. Their letters, in lower case, are a token sequence of their own
    whatever stands beside them, and its last token alone has the vocabulary's word end: many go through the model in one call,
    which needs no normal form. All others go through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark = self.one(MARK)
        bare = json.loads(vocabulary)
        end = bare["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(bare["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in bare["model"]["vocab"].items() if t.endswith(end)]] = True
        self.bare = Tokenizer.from_str(json.dumps(bare | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.spelling = {b: c for c, b in byte_of().items()}
        self.stops = {x: self.one(x) for x in ".,;:!?"} | {"": np.zeros(0, np.uint32)}
        self.cores: dict[str, int] = {}
        self.core_ids: list[np.ndarray] = []

    def one(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)

    def many(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word by one call: a mark's ids follow each word, and come from a mark alone."""
        got = np.array(self.tokenizer.encode_batch_fast([" ".join(f"{w} {MARK}" for w in words)], add_special_tokens=False)[0].ids, np.uint32)
        n = len(got) - len(self.mark) + 1
        hits = np.ones(max(0, n), bool)
        for k, x in enumerate(self.mark):
            hits &= got[k : n + k] == x
        ends = np.flatnonzero(hits)
        if len(ends) != len(words):
            raise ValueError("words and marks differ")
        return [got[a:b] for a, b in zip([0, *(ends[:-1] + len(self.mark))], ends, strict=True)]

    def letters(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of lower-case letters."""
        spelt = " ".join(words).encode().decode("latin-1").translate({b: c for b, c in self.spelling.items() if b != 32})
        got = np.array(self.bare.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[got]) + 1
        if len(ends) != len(words):
            raise ValueError("words and word ends differ")
        return [got[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def calls(words: list[str]) -> Iterator[slice]:
        lo = 0
        while lo < len(words):
            hi, chars = lo, 0
            while hi < len(words) and hi - lo < CALL_WORDS and chars < CALL_CHARS:
                chars += len(words[hi])
                hi += 1
            yield slice(lo, hi)
            lo = hi

    def ids_of(self, raw: list[bytes]) -> list[np.ndarray]:
        if len(self.cores) > MEMO_WORDS:
            self.cores, self.core_ids = {}, []
        made: list = [None] * len(raw)
        others, cores = [], self.cores
        for k, w in enumerate(raw):
            if m := PLAIN(w := w.decode()):
                made[k] = cores.setdefault(m[1].lower(), len(cores)), m[2]
            elif MARK in w or len(w) > CALL_CHARS // 10:
                made[k] = self.one(w)
            else:
                others.append((k, w))
        new = list(islice(cores, len(self.core_ids), None))
        for part in self.calls(new):
            self.core_ids += self.letters(new[part])
        for part in self.calls(rest := [w for _, w in others]):
            for (k, _), x in zip(others[part], self.many(rest[part]), strict=True):
                made[k] = x
        return [(np.concatenate([self.core_ids[x[0]], self.stops[x[1]]]) if x[1] else self.core_ids[x[0]]) if isinstance(x, tuple) else x for x in made]


def memo(vocabulary: str) -> Memo:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    return kept("packing", vocabulary, lambda: Memo(lambda t: t.encode().split(), Words(vocabulary).ids_of, MEMO_WORDS))


def pieces(docs: DataFrame, vocabulary: str, end: int = END, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32. vocabulary: the text of a tokenizer's JSON file in which no token crosses white space."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = memo(shared.value)
        for batch in it:
            at, rows, texts, size = [], [], [], 0

            def cut():
                for k, ids in zip(at, m.encode(texts), strict=True):  # noqa: B023
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for p, lo in enumerate(range(0, len(ids), capacity)):
                        part = ids[lo : lo + capacity]
                        rows.append((k, p, lo, len(part), zlib.crc32(part.tobytes())))  # noqa: B023

            for k, t in enumerate(batch.column(1)):
                at.append(k)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= CALL_CHARS or k + 1 == len(batch):
                    cut()
                    at, texts, size = [], [], 0
            k, *columns = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)
        give_back()

    fields = [StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("piece int, start long, length long, ids_crc32 long").fields]
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, StructType(fields))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: the longest items first, each to the fullest bin that takes it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    some = 0  # bit r: a bin has room r
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        if above := some >> n:
            r = n + (above & -above).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                some &= ~(1 << r)
            bins[b].append(k)
        else:
            r, b = capacity, len(bins)
            bins.append([k])
        if r - n:
            free[r - n].append(b)
            some |= 1 << (r - n)
    return bins


class Search:
    """Exchanges between underfull bins. A bin is a dict from length to its items."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.capacity, self.bins = capacity, []
        self.fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
        for b in bins:
            by: dict[int, list[int]] = defaultdict(list)
            for k in b:
                by[int(lengths[k])].append(k)
            self.bins.append(by)

    def offers(self, j: int) -> tuple[np.ndarray, dict[int, tuple[int, ...]]]:
        """What one or two items of bin j come to: the largest such sum up to each length, and the items' lengths for each sum."""
        own = sorted(self.bins[j])
        sums = {a + b: (a, b) for x, a in enumerate(own) for b in own[x:] if a + b <= self.capacity and (a != b or len(self.bins[j][a]) > 1)}
        sums |= {a: (a,) for a in own}
        within = np.zeros(self.capacity + 1, np.int64)
        within[list(sums)] = list(sums)
        return np.maximum.accumulate(within), sums

    def takers(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each underfull bin what it can give back: nothing, or an item (its length)."""
        rows = [(i, a) for i in np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist() for a in (0, *self.bins[i])]
        return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)

    def move(self, source: int, target: int, lengths: tuple[int, ...]) -> None:
        for n in lengths:
            self.bins[target][n].append(self.bins[source][n].pop())
            if not self.bins[source][n]:
                del self.bins[source][n]
            self.fill[source] -= n
            self.fill[target] += n

    def drain(self, j: int) -> bool:
        """Fills other bins from bin j, the best exchange first, until it is empty or no exchange is left."""
        bins, gives = self.takers()
        bins, gives = bins[bins != j], gives[bins != j]
        while self.fill[j] and len(bins):
            within, sums = self.offers(j)
            gain = within[np.minimum(self.capacity - self.fill[bins] + gives, self.capacity)] - gives
            gain = np.where((gain > 0) & (self.fill[bins] + gain > self.fill[j]), gain, 0)
            best = int(np.lexsort((-self.fill[bins], -gain))[0]) if gain.any() else -1
            if best < 0:
                return False
            i, give = int(bins[best]), int(gives[best])
            taken = sums[give + int(gain[best])]
            if give:
                self.move(i, j, (give,))
            self.move(j, i, taken)
            stay = bins != i
            again = [0, *self.bins[i]] if self.fill[i] < self.capacity else []
            bins, gives = np.concatenate([bins[stay], np.full(len(again), i)]), np.concatenate([gives[stay], np.array(again, np.int64)])
        return not self.fill[j]

    def run(self) -> list[list[int]]:
        stuck: set[int] = set()
        while len(stuck) < PATIENCE:
            under = [i for i in np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist() if i not in stuck]
            total = int((self.capacity - self.fill[self.fill > 0]).sum())
            if not under or total < self.capacity:  # less room than a bin in all: none can empty
                break
            j = min(under, key=lambda i: self.fill[i])
            if self.drain(j):
                stuck.clear()
            else:
                stuck.add(j)
        return [[k for items in b.values() for k in items] for b in self.bins if b]


def search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return Search(bins, lengths, capacity).run()


def _rows(bins: list[list[int]], items: pa.StructArray, lengths: np.ndarray, first: int, keep: int, capacity: int) -> pa.RecordBatch:
    """A row for each bin: sequence, open, n, pieces with their offsets. The `keep` emptiest underfull ones are open."""
    fill = np.array([lengths[b].sum() for b in bins], np.int64)
    under = [i for i in np.argsort(fill, kind="stable").tolist() if fill[i] < capacity][:keep]
    is_open = np.zeros(len(bins), bool)
    is_open[under] = True
    order = np.concatenate([np.array(b, np.int64) for b in bins])
    sizes = np.array([len(b) for b in bins])
    ends = np.cumsum(lengths[order])
    offset = ends - lengths[order] - np.repeat(np.concatenate([[0], np.cumsum(fill)[:-1]]), sizes)
    taken = items.take(pa.array(order))
    struct = pa.StructArray.from_arrays([*(taken.field(c) for c in range(len(taken.type))), pa.array(offset, pa.int64())], names=[*(f.name for f in taken.type), "offset"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), struct)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(bins)), pa.int64()), pa.array(is_open), pa.array(sizes, pa.int64()), lists], names=["sequence_id", "open", "n", "pieces"])


def _task(round_: int) -> int:
    from pyspark import TaskContext

    return round_ << 56 | TaskContext.get().partitionId() << 32


def packed(rows: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK, keep: int = KEEP) -> DataFrame:
    """sequence_id and its pieces (rows' columns and an offset), from pieces with a column length."""
    inner = StructType([*rows.schema.fields, StructField("offset", LongType())])
    out = StructType([*StructType.fromDDL("sequence_id long, open boolean, n long").fields, StructField("pieces", ArrayType(inner))])

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, kept, count = _task(0), [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]  # noqa: B023
            lengths = np.asarray(t.column("length")).astype(np.int64)
            return _rows(search(best_fit(lengths, capacity), lengths, capacity), t.to_struct_array(), lengths, first, keep, capacity)  # noqa: B023

        for batch in it:
            for lo in range(0, len(batch), chunk):
                part = batch.slice(lo, chunk)
                kept.append(part)
                count += len(part)
                if count >= chunk:
                    yield (got := flush())
                    first, kept, count = first + len(got), [], 0
        if count:
            yield flush()

    def merge(round_: int, last: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = [b for b in it if len(b)]
            if not batches:
                return
            t = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
            lists = t.column("pieces")
            items = lists.flatten()
            items = pa.StructArray.from_arrays([items.field(c) for c in range(len(items.type) - 1)], names=[f.name for f in items.type][:-1])
            lengths = np.asarray(items.field("length")).astype(np.int64)
            edges = np.cumsum([0, *np.asarray(t.column("n")).tolist()]).tolist()
            bins = search([list(range(a, b)) for a, b in zip(edges, edges[1:])], lengths, capacity)
            yield _rows(bins, items, lengths, _task(round_), 0 if last else keep, capacity)

        return run

    n_pieces = rows.count()
    done, now, tasks = [], written(rows.coalesce(max(1, -(-n_pieces // chunk))).mapInArrow(pack, out), "packed"), None
    for round_ in range(1, 100):
        left = now.where("open").agg(F.sum("n")).first()[0] or 0
        more = max(1, -(-left // chunk))
        done.append(now.where("NOT open"))
        last = more == 1 or (tasks is not None and 2 * more > tasks)
        now, tasks = written(now.where("open").coalesce(more).mapInArrow(merge(round_, last), out), "packed"), more
        if last:
            break
    whole = now
    for d in done:
        whole = whole.unionByName(d)
    return whole.select("sequence_id", "pieces")


def pack(docs: DataFrame, vocabulary: str, end: int = END, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece, with its sequence and its place there."""
    rows = written(pieces(docs, vocabulary, end, capacity, id_col, text_col), "pieces")
    return packed(rows, capacity).select("sequence_id", F.explode("pieces").alias("p")).select("p.*", "sequence_id")


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    with open(p.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    got = pack(table(spark, sf_dir, "documents"), vocabulary)
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
