"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes, and how often in the corpus.

1. Texts are encoded by both tokenizers in their partitions. Byte offsets where tokens of both end cut them into groups; every
   A token of a group is linked with every B token of it. A text's records are its distinct linked pairs, each with its number of
   links. Texts are gathered in chunks of about CHUNK records: a chunk's distinct pairs, sorted by A id, then B id, with the
   number of texts that hold each, stand once; its texts refer to them by number. Chunks are written as zstd columns.
2. The pairs of each chunk are dealt by radix of the A id into cells, as sorted zstd runs. Cells come from the exact loads of
   each A id (as many numbers as there are ids) and hold about CELL pairs of chunks each; an A id with more is parted by B id. As a
   chunk counts a pair once however many of its texts hold it, a hot pair is one record for each chunk.
3. A cell merges its runs by a heap, in the order of A ids: a pair's counts add up, and when an A id is done its largest count is known
   (of an id that is parted the largest of its cells counts). The counts go back to the chunk that each run is from.
4. Each chunk meets its counts, and every text sums them over its links.

Cases: null and empty texts, and texts whose tokens don't give back a space and the text, byte for byte, by both tokenizers, have
no tokens: zeros and ''. Repeated rows and ids count as documents of their own. Special strings in a text are plain text. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sitegrid.llm.chunks import finder
from sitegrid.llm.common import give_back, table, written
from sitegrid.llm.memo import Memo, byte_of, kept, spread

CHUNK, CELL = 2_000_000, 1_000_000
CALL_BYTES, DENSE = 1_000_000, 4_096
PAIR_BITS = 40
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def put(numbers: np.ndarray) -> bytes:
    """Numbers as a zstd frame, byte by byte of equal weight; sorted ones are better given as differences."""
    import zstandard

    planes = np.ascontiguousarray(np.asarray(numbers, np.int64)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def got(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


class Encoders:
    """A: a byte-level BPE from a tokenizer's JSON text. B: a piece model with byte fallback, which adds a space, from its bytes."""

    def __init__(self, a_json: str, b_model: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        model, back = json.loads(a_json)["model"], byte_of()
        ranks = {bytes(back[c] for c in piece): i for piece, i in model["vocab"].items()}
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][x] for x in joined]
        if ids != sorted(ids):
            raise ValueError("ids of A aren't in the order of its merges")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        n = self.b.get_piece_size()
        spelt = [self.b.id_to_piece(i) for i in range(n)]
        self.a_bytes = self.table({i: b for b, i in ranks.items()})
        self.b_bytes = self.table({i: bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode() for i, p in enumerate(spelt)})
        self.a_sizes, self.b_sizes = (np.array([len(v) for v in x.to_pylist()], np.int64) for x in (self.a_bytes, self.b_bytes))
        if (len(self.a_bytes) * len(self.b_bytes)) >> PAIR_BITS:
            raise ValueError("vocabularies are too large")
        bpe = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})  # of equal merges, and quicker
        self.a = Memo(finder(pattern), lambda words: [np.array(bpe.encode_ordinary(w), np.uint32) for w in words])
        self.names = pa.array([f"{i}{end}" for end in (",", "|", ";", "") for i in range(max(len(self.a_bytes), n))], pa.binary())

    @staticmethod
    def table(pieces: dict[int, bytes]) -> pa.Array:
        return pa.array([pieces.get(i, b"") for i in range(max(pieces) + 1)], pa.binary())

    @staticmethod
    def same(pieces: pa.Array, sizes: np.ndarray, ids: np.ndarray, starts: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether each text's ids give its bytes, and it has some."""
        whole = memoryview(pieces.take(pa.array(ids)).buffers()[2] or b"").cast("B")
        at = np.concatenate([[0], np.cumsum(sizes[ids])])[starts].tolist()
        return np.array([len(r) > 0 and whole[x:y] == r for x, y, r in zip(at[:-1], at[1:], raw, strict=True)], bool)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text n_a, n_b, n_groups, n_links and the digest of its groups; of each linked pair of a text its text's place, the
        pair as a number, and its links, by text and pair."""
        from hashlib import sha256

        raw = [b" " + t.encode() if t else b"" for t in texts]
        a_ids = [x.astype(np.int64) for x in self.a.encode([" " + t if t else "" for t in texts])]
        b_ids = [np.array(x, np.int64) for x in self.b.encode([t or "" for t in texts], num_threads=1)]
        flat = lambda lists: (np.concatenate([np.zeros(0, np.int64), *lists]), np.cumsum([0, *map(len, lists)]))
        ok = self.same(self.a_bytes, self.a_sizes, *flat(a_ids), raw) & self.same(self.b_bytes, self.b_sizes, *flat(b_ids), raw)
        none = np.zeros(0, np.int64)
        (a, a_at), (b, b_at) = (flat([x if k else none for x, k in zip(ids, ok, strict=True)]) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        ga, gb = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        p, q = np.bincount(ga, minlength=len(ends)), np.bincount(gb, minlength=len(ends))
        text_ends = np.cumsum([len(r) if k else 0 for r, k in zip(raw, ok, strict=True)])
        g_at = np.concatenate([[0], np.searchsorted(ends, text_ends, "right")])
        links = np.concatenate([[0], np.cumsum(p * q)])
        numbers = np.stack([np.diff(a_at), np.diff(b_at), np.diff(g_at), links[g_at[1:]] - links[g_at[:-1]]])

        # the groups spelt out: A tokens of a group, then its B tokens
        a_first, b_first = np.cumsum(p) - p, np.cumsum(q) - q
        last_a, last_b = np.arange(len(a)) + 1 == (a_first + p)[ga], np.arange(len(b)) + 1 == (b_first + q)[gb]
        final = np.zeros(len(b), bool)
        final[b_at[1:][np.diff(b_at) > 0] - 1] = True
        width = len(self.names) // 4
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + b_first[ga]] = a + width * last_a
        codes[np.arange(len(b)) + (a_first + p)[gb]] = b + width * np.where(final, 3, 2 * last_b)
        spelt = self.names.take(pa.array(codes))
        whole, at = memoryview(spelt.buffers()[2] or b""), np.frombuffer(spelt.buffers()[1] or bytes(4), np.int32)[: len(codes) + 1]
        cuts = at[(a_at + b_at)].tolist() if len(codes) else [0] * (len(texts) + 1)
        digests = [sha256(whole[x:y]).hexdigest() if k else "" for x, y, k in zip(cuts[:-1], cuts[1:], ok, strict=True)]

        return numbers, digests, *self.pairs(a, b, ga, gb, p, q, a_first, b_first, g_at)

    def pairs(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, p: np.ndarray, q: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, g_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = np.repeat(np.arange(len(g_at) - 1), np.diff(g_at))
        n_b, keys, links = len(self.b_bytes), [], []
        for g in np.flatnonzero(p * q > DENSE):  # distinct ids of a large group, each with its number
            (x, nx), (y, ny) = np.unique(a[a_first[g] : a_first[g] + p[g]], return_counts=True), np.unique(b[b_first[g] : b_first[g] + q[g]], return_counts=True)
            keys.append((text[g] << PAIR_BITS) + (x[:, None] * n_b + y).ravel())
            links.append((nx[:, None] * ny).ravel())
        small = np.flatnonzero(p * q <= DENSE)
        n = (p * q)[small]
        g = np.repeat(small, n)
        k = spread(np.zeros(len(n), np.int64), n)
        keys.append((text[g] << PAIR_BITS) + a[a_first[g] + k // q[g]] * n_b + b[b_first[g] + k % q[g]])
        links.append(np.ones(len(g), np.int64))
        keys, links = np.concatenate(keys), np.concatenate(links)
        order = np.argsort(keys, kind="stable")
        keys, links = keys[order], links[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        total = np.add.reduceat(links, first) if len(first) else links
        keys = keys[first]
        return keys >> PAIR_BITS, keys & ((1 << PAIR_BITS) - 1), total


class Cells:
    """Where a pair is counted: by the loads of the A ids."""

    def __init__(self, loads: np.ndarray, cell: int):
        self.parts = np.maximum(1, -(-loads // cell))
        self.first = np.zeros(len(loads), np.int64)
        now, held = 0, 0
        for k, (n, parts) in enumerate(zip(loads.tolist(), self.parts.tolist(), strict=True)):
            if parts > 1 or held + n > cell:
                now, held = now + (held > 0), 0
            self.first[k] = now
            if parts > 1:
                now += parts
            else:
                held += n
        self.number = int(now) + 1

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.first[a] + b % self.parts[a]


def merged(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of sorted runs (A ids, B ids, counts) the sums over all runs in each run's order, the A ids, and the largest sum of each."""
    starts = [np.flatnonzero(np.diff(a, prepend=-1)).tolist() + [len(a)] for a, _, _ in runs]
    out = [np.zeros(len(a), np.int64) for a, _, _ in runs]
    heap = [(int(a[0]), r, 0) for r, (a, _, _) in enumerate(runs) if len(a)]
    heapq.heapify(heap)
    ids, tops = [], []
    while heap:
        now, pieces = heap[0][0], []
        while heap and heap[0][0] == now:
            _, r, k = heap[0]
            lo, hi = starts[r][k], starts[r][k + 1]
            pieces.append((r, lo, hi))
            if hi < len(runs[r][0]):
                heapq.heapreplace(heap, (int(runs[r][0][hi]), r, k + 1))
            else:
                heapq.heappop(heap)
        if len(pieces) == 1:
            r, lo, hi = pieces[0]
            out[r][lo:hi] = sums = runs[r][2][lo:hi]
        else:
            b = np.concatenate([runs[r][1][lo:hi] for r, lo, hi in pieces])
            _, where = np.unique(b, return_inverse=True)
            sums = np.zeros(where.max() + 1, np.int64)
            np.add.at(sums, where, np.concatenate([runs[r][2][lo:hi] for r, lo, hi in pieces]))
            at = 0
            for r, lo, hi in pieces:
                out[r][lo:hi] = sums[where[at : at + hi - lo]]
                at += hi - lo
        ids.append(now)
        tops.append(int(sums.max()))
    return out, np.array(ids, np.int64), np.array(tops, np.int64)


def chunks(docs: DataFrame, a_json: str, b_model: bytes, pattern: str, id_col: str, text_col: str, chunk: int = CHUNK) -> DataFrame:
    """chunk, its texts (rows) with their numbers, its distinct pairs, and which text has which."""
    shared = docs.sparkSession.sparkContext.broadcast((a_json, b_model, pattern))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = kept("alignment", shared.value, lambda: Encoders(*shared.value))
        n_b = len(e.b_bytes)
        ids, numbers, digests, sizes, pairs, links, count = [], [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            n = np.concatenate(numbers, 1)  # noqa: B023
            rows = pa.StructArray.from_arrays([pa.concat_arrays(ids), *map(pa.array, n), pa.array(digests, pa.string())], names=["i", *COUNTS, "groups_sha256"])  # noqa: B023
            every, code, held = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)  # noqa: B023
            a, b = np.divmod(every, n_b)
            blobs = [np.diff(a, prepend=0), b, held, np.concatenate(sizes), code, np.concatenate(links)]  # noqa: B023
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), *(pa.array([put(x)], pa.binary()) for x in blobs)], names=["chunk", "rows", "a", "b", "held", "sizes", "codes", "links"])

        for batch in it:
            lo, size, texts = 0, 0, []
            for k, t in enumerate(batch.column(1)):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= CALL_BYTES or k + 1 == len(batch):
                    n, sha, text, pair, link = e.align(texts)
                    ids.append(batch.column(0).take(pa.array(range(lo, k + 1))))  # a copy, without the texts' memory
                    numbers.append(n)
                    digests += sha
                    sizes.append(np.bincount(text, minlength=len(texts)))
                    pairs.append(pair)
                    links.append(link)
                    count += len(pair)
                    lo, size, texts = k + 1, 0, []
                    if count >= chunk:
                        yield flush()
                        ids, numbers, digests, sizes, pairs, links, count = [], [], [], [], [], [], 0
        if ids:
            yield flush()
        give_back()

    row = StructType([StructField("i", docs.schema[id_col].dataType), *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string").fields])
    kind = StructType([StructField("chunk", StringType()), StructField("rows", ArrayType(row)), *StructType.fromDDL("a binary, b binary, held binary, sizes binary, codes binary, links binary").fields])
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, kind)


def loads(chunk_rows: DataFrame) -> np.ndarray:
    """How many pairs of chunks each A id has: as many numbers as there are ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in it:
            for raw in batch.column(0):
                n = np.bincount(np.cumsum(got(raw.as_py())))
                total = n + np.pad(total, (0, len(n) - len(total))) if len(n) > len(total) else total + np.pad(n, (0, len(total) - len(n)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["a", "n"])

    rows = chunk_rows.select("a").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(max([0, *rows["a"].to_pylist()]) + 1, np.int64)
    out[np.asarray(rows["a"])] = np.asarray(rows["n"])
    return out


def counted(chunk_rows: DataFrame, cells: Cells) -> DataFrame:
    """For each chunk and cell the counts of its pairs (chunk, cell, counts), and for each cell its A ids' largest (chunk is null)."""

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in range(len(batch)):
                a, b, held = (got(batch.column(c)[r].as_py()) for c in ("a", "b", "held"))
                a = np.cumsum(a)
                cell = cells.of(a, b)
                order = np.argsort(cell, kind="stable")
                cell = cell[order]
                edges = [*np.flatnonzero(np.diff(cell, prepend=-1)).tolist(), len(cell)]
                parts = [order[x:y] for x, y in zip(edges, edges[1:])]
                columns = [[put(np.diff(a[o], prepend=0)) for o in parts], [put(b[o]) for o in parts], [put(held[o]) for o in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(cell[edges[:-1]], pa.int64()), pa.array([batch.column("chunk")[r].as_py()] * len(parts), pa.string()), *(pa.array(c, pa.binary()) for c in columns)], names=["cell", "chunk", "a", "b", "held"])

    def merge(t: pa.Table) -> pa.Table:
        runs = [(np.cumsum(got(a)), got(b), got(n)) for a, b, n in zip(*(t[c].to_pylist() for c in ("a", "b", "held")), strict=True)]
        sums, ids, tops = merged(runs)
        cell = t["cell"][0].as_py()
        return pa.table({"chunk": pa.array([*t["chunk"].to_pylist(), None], pa.string()), "cell": pa.array([cell] * (len(runs) + 1), pa.int64()), "counts": pa.array([*map(put, sums), put(tops)], pa.binary()), "a": pa.array([None] * len(runs) + [put(ids)], pa.binary())})

    runs = chunk_rows.select("chunk", "a", "b", "held").mapInArrow(deal, "cell long, chunk string, a binary, b binary, held binary")
    return runs.groupBy("cell").applyInArrow(merge, "chunk string, cell long, counts binary, a binary")


def largest(counts: DataFrame, size: int) -> np.ndarray:
    """The largest count of each A id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, n in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(got(a.as_py())), pa.array(got(n.as_py()))], names=["a", "n"])

    rows = counts.where("chunk IS NULL").select("a", "counts").mapInArrow(run, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[np.asarray(rows["a"])] = np.asarray(rows["n"])
    return out


def aligned(docs: DataFrame, a_json: str, b_model: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, cell: int = CELL) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs."""
    chunk_rows = written(chunks(docs, a_json, b_model, pattern, id_col, text_col, chunk), "aligned")
    cells = Cells(loads(chunk_rows), cell)
    counts = written(counted(chunk_rows, cells), "pair-counts")
    shared = docs.sparkSession.sparkContext.broadcast((cells, largest(counts, len(cells.first))))
    told = counts.where("chunk IS NOT NULL").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("cell", "counts"))).alias("told"))  # a chunk's cells
    names = [id_col, *COUNTS, "n_best", "count_sum", "groups_sha256"]

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, top = shared.value
        for batch in it:
            for r in range(len(batch)):
                a, b, sizes, codes, links = (got(batch.column(c)[r].as_py()) for c in ("a", "b", "sizes", "codes", "links"))
                a = np.cumsum(a)
                back = [got(x["counts"]) for x in batch.column("told")[r].as_py() or []]
                n = np.full(len(a), -1, np.int64)
                n[np.argsort(cells.of(a, b), kind="stable")] = np.concatenate([np.zeros(0, np.int64), *back])
                best = n == top[a]
                edges = np.concatenate([[0], np.cumsum(sizes)])
                over = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])  # noqa: B023, E731
                rows = batch.column("rows").slice(r, 1).flatten()
                yield pa.RecordBatch.from_arrays([rows.field("i"), *(rows.field(c) for c in COUNTS), pa.array(over(links * best[codes])), pa.array(over(links * n[codes])), rows.field("groups_sha256")], names=names)

    fields = [StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields]
    return chunk_rows.drop("held").join(told, "chunk", "left").mapInArrow(finish, StructType(fields))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(p.path("piece_bpe_32k.model"), "rb") as g:
        return aligned(table(spark, sf_dir, "documents"), f.read(), g.read(), p.PATTERN)
