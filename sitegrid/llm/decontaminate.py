"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items.

A text is lower-cased (A-Z) and cut into words; the words joined by single spaces are scanned once by the
automaton of all windows (13 words of an item; all its words if it has fewer). A hit maps back to word numbers
and to character offsets in the original text.

Cases: null or wordless text has no words and no hits; an item without words has no window; repeated items and
windows count once per item id; an empty benchmark hits nothing. Benchmarks beyond MAX_BYTES are dealt into blocks
with one automaton each, whose hits are united: no item is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.llm.common import give_back, table

WINDOW = 13
#: Bytes of benchmark text in one automaton, about 150 times that in memory.
MAX_BYTES = 1_000_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: all but the other ASCII characters
HITS = "n_words long, ranges array<struct<first:int,last:int,start:int,end:int>>, item_ids array<string>"


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def windows_of(text: str | None, size: int = WINDOW) -> set[str]:
    """As the automaton has them: Latin-1 images of the bytes, a space at both ends."""
    w = words_of(text)
    runs = [w[i : i + size] for i in range(len(w) - size + 1)] if len(w) >= size else [w] if w else []
    return {f" {b' '.join(r).decode('latin-1')} " for r in runs}


def automaton(items: list[tuple[str, str]], size: int = WINDOW):
    """Each window's value: its number of words and the ids of its items."""
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for item, text in items:
        for w in windows_of(text, size):
            owners.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, ids in owners.items():
        a.add_word(w, (w.count(" ") - 1, tuple(sorted(ids))))
    if owners:
        a.make_automaton()
    return a


def scan(a, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words; merged ranges of hit words, both ends included; ids of items with a hit."""
    words = words_of(text)
    if not words or not len(a):
        return len(words), [], []
    line = f" {b' '.join(words).decode('latin-1')} "
    found = list(a.iter(line))
    if not found:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found]) - 1
    return len(words), merge([(int(e) - n + 1, int(e)) for e, (_, (n, _)) in zip(last, found)]), sorted({i for _, (_, ids) in found for i in ids})


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text, half open, of ranges of words."""
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    return [(len(raw[: at[s][0]].decode()), len(raw[: at[e][1]].decode())) for s, e in ranges]


def blocks(bench: DataFrame, id_col: str, text_col: str, max_bytes: int) -> list[list[tuple[str, str]]]:
    """The items, read once, in blocks that end where they reach max_bytes."""
    b = bench.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    out: list[list[tuple[str, str]]] = [[]]
    size = 0
    for r in b.orderBy("i", "t").toLocalIterator():
        if size >= max_bytes:
            out.append([])
            size = 0
        out[-1].append((r.i, r.t))
        size += len(r.t.encode())
    return out


def located(text: str | None, ranges: list[tuple[int, int]]) -> list[dict]:
    """Ranges of words with the characters of the original text that they cover."""
    return [{"first": f, "last": n, "start": a, "end": b} for (f, n), (a, b) in zip(ranges, spans(text, ranges))] if ranges else []


def with_hits(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, max_bytes: int = MAX_BYTES, out: str = "hits") -> DataFrame:
    """docs and a struct column (replacing one of its name): n_words, ranges of hit words with their character offsets in the
    text (start, end; half open), item_ids as strings. No shuffle, all other columns stay."""
    sc = docs.sparkSession.sparkContext

    def one(items):
        shared = sc.broadcast(items)

        @F.pandas_udf(HITS)
        def hits(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            a = automaton(shared.value, size)
            for texts in it:
                rows = [scan(a, t) for t in texts]
                yield pd.DataFrame({"n_words": [r[0] for r in rows], "ranges": [located(t, r[1]) for t, r in zip(texts, rows)], "item_ids": [r[2] for r in rows]})
            del a
            give_back()

        return hits(F.col(text_col))

    @F.pandas_udf(HITS)
    def united(a: pd.DataFrame, b: pd.DataFrame, texts: pd.Series) -> pd.DataFrame:
        pairs = lambda xs: [(x["first"], x["last"]) for x in xs]
        return pd.DataFrame({"n_words": a.n_words, "ranges": [located(t, merge(pairs(x) + pairs(y))) for x, y, t in zip(a.ranges, b.ranges, texts)], "item_ids": [sorted({*x, *y}) for x, y in zip(a.item_ids, b.item_ids)]})

    first, *rest = [one(items) for items in blocks(bench, item_col, item_text, max_bytes)]
    for other in rest:
        first = united(first, other, F.col(text_col))
    return docs.withColumn(out, first)


def n_hit(hits: str = "hits"):
    return F.aggregate(F.col(f"{hits}.ranges"), F.lit(0).cast("long"), lambda a, r: a + (r["last"] - r["first"] + 1))


def contaminated(hits: str = "hits"):
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(f"{hits}.n_words"))


def hit_chars(hits: str = "hits"):
    """Characters of the original text from the first to the last letter of each hit range."""
    return F.aggregate(F.col(f"{hits}.ranges"), F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort("hits.item_ids"), ",").cast("binary")
    return df.select("doc_id", F.col("hits.n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("hits.item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), contaminated().alias("contaminated"), hit_chars().alias("hit_chars"))
