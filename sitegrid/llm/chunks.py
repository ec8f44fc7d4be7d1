"""Documents in chunks: the distinct pre-tokens of a chunk stand once in it, its documents refer to them by number.

Pre-tokens are cut as the `regex` module does it, which classes every code point as the tokenizers' own engines do; texts
without characters beyond U+FFFF by the faster `re`, given the same classes character by character. A chunk ends
with the document that brings it to CHUNK_CHARS characters or CHUNK_WORDS distinct pre-tokens, so its size is bounded but
for its last document. Null text is empty; documents without pre-tokens are in chunks like all others.

What holds for a frequent pre-token goes to all tasks with a dictionary of at most so many words as asked. Its words are
counted over all texts by Spark's own regular expressions; should these cut some text otherwise, a word of the dictionary
stays unused, and one that it lacks is treated like any rarer one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.llm.common import least_count, written

CHUNK_CHARS, CHUNK_WORDS = 4_000_000, 400_000
_PLANE = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))


def squeeze(numbers: np.ndarray) -> bytes:
    import zstandard

    planes = np.ascontiguousarray(np.asarray(numbers, np.int32)).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def loosen(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


class Chunk:
    """rows: the documents' columns; starts and codes: numbers of the words of each document, in order or each once, then
    with counts."""

    def __init__(self):
        self._rows, self._codes, self._counts, self._starts, self._n, self._chars = [], [], [], [0], 0, 0
        self._place: defaultdict[str, int] = defaultdict()
        self._place.default_factory = self._place.__len__

    def add(self, words: list[str], chars: int, in_order: bool) -> None:
        if not in_order:
            words = Counter(words)
            self._counts.append(np.fromiter(words.values(), np.int32, len(words)))
        self._codes.append(np.fromiter(map(self._place.__getitem__, words), np.int32, len(words)))
        self._n += len(words)
        self._chars += chars
        self._starts.append(self._n)

    def full(self) -> bool:
        return self._chars >= CHUNK_CHARS or len(self._place) >= CHUNK_WORDS

    def take(self, rows: pa.Array) -> None:
        self._rows.append(rows)

    rows = property(lambda self: pa.concat_arrays(self._rows))
    starts = property(lambda self: np.array(self._starts, np.int32))
    codes = property(lambda self: np.concatenate([np.zeros(0, np.int32), *self._codes]))
    counts = property(lambda self: np.concatenate([np.zeros(0, np.int32), *self._counts]))

    def split(self, dictionary: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each word of the chunk stands: in the dictionary, or after its end in the array of all others."""
        words = pa.array(list(self._place), pa.string())
        at = np.array(pc.fill_null(pc.index_in(words, value_set=dictionary), -1), np.int32)
        new = at < 0
        at[new] = len(dictionary) + np.arange(new.sum(), dtype=np.int32)
        return at, words.filter(pa.array(new))


def finder(pattern: str):
    """findall of the pattern. Its classes (\\p{..}, \\s, \\S) are spelt out for `re` from what `regex` says of each character."""
    import regex

    def ranges(prop: str) -> str:
        out: list[list[int]] = []
        for c in (ord(x) for x in regex.findall(prop, _PLANE)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in out)

    parts, inside = [], False
    for m in re.finditer(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        x = m[0]
        inside = (inside or x == "[") and x != "]"
        if x == r"\S":
            if inside:
                raise ValueError(r"\S in a class")
            x = rf"[^{ranges(chr(92) + 's')}]"
        elif x == r"\s" or x.startswith(r"\p"):
            x = ranges(x) if inside else f"[{ranges(x)}]"
        parts.append(x)
    near, far, beyond = re.compile("".join(parts)).findall, regex.compile(pattern).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda t: near(t) if t.isascii() or not beyond(t) else far(t)


def chunks_of(it: Iterator[pa.RecordBatch], pattern: str, special: str = "", in_order: bool = True) -> Iterator[Chunk]:
    """From batches of (row, text). special: a string that parts a text and is in no pre-token."""
    find = finder(pattern)
    chunk, some = Chunk(), False
    for batch in it:
        rows, texts, start = batch.column(0), batch.column(1), 0
        for k in range(len(batch)):
            t = texts[k].as_py() or ""
            chunk.add([w for part in t.split(special) for w in find(part)] if special and special in t else find(t), len(t), in_order)
            some = True
            if chunk.full() or k + 1 == len(batch):
                chunk.take(rows.take(pa.array(range(start, k + 1))))  # a copy, without the texts' memory
                start = k + 1
            if chunk.full():
                yield chunk
                chunk, some = Chunk(), False
    if some:
        yield chunk


def rows_and_text(docs: DataFrame, keep: list[str], text: Column) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"))


def java_pattern(pattern: str) -> str:
    """The same pattern for Java: there \\s is ASCII unless it is spelt out."""
    space = r"\p{IsWhite_Space}"
    return pattern.replace(r"[^\s", f"[^{space}").replace(r"\s", space).replace(r"(?!\S)", rf"(?![^{space}])").replace(r"\S", rf"[^{space}]")


def frequent(docs: DataFrame, text: Column, pattern: str, special: str, size: int) -> DataFrame:
    """w: the most frequent pre-tokens of all texts, at most size of them."""
    find = lambda t: F.regexp_extract_all(t, F.lit(java_pattern(pattern)), F.lit(0))
    words = find(text) if not special else F.flatten(F.transform(F.split(text, re.escape(special)), find))
    counts = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    counts = written(counts, "words")
    return counts.where(F.col("n") >= least_count(counts, size)).select("w")
