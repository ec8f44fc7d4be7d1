"""Language ID by cross-parsing entropy.

For each language the suffix automaton of a sample of labelled text is built. A text is parsed against each automaton
from left to right into the longest phrases that occur in the sample; a character that the sample doesn't have is a phrase of
its own. The language that needs the fewest phrases, each at the cost of a pointer into its sample, wins. Texts are
lower-cased; runs of characters that are not letters are one space.

The automata are fitted on at most SAMPLE_CHARS characters a language, taken in pieces of PIECE from about
SAMPLE_DOCS documents (by hash of doc_id, whatever the size of the input). Every letter of the samples counts; transitions by
the DENSE most frequent ones are an array, all others a sorted table. Predictions parse whole texts, in parts of at
most PART and segments of SEGMENT characters (a phrase ends with its segment), all segments of a batch side by side.

Cases: null text and text without a letter get `und` and score 0; equal costs go to the smaller name; a null label isn't
learned from; without any learned language all is `und`; with one learned language its score is 1; repeated rows get equal
results; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.llm.common import give_back, remainder, table

SAMPLE_CHARS, SAMPLE_DOCS, PIECE, SEGMENT, DENSE, PART = 20_000, 64, 1_024, 2_048, 64, 500_000
UND = "und"

_KIND = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (space: 32) of all texts one after another, where each begins, its number of letters."""
    low = [t.lower() for t in texts]
    n = np.array([len(t) for t in low], np.int64)
    cps = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    letter = _KIND[cps]
    first = np.zeros(len(cps), np.bool_)
    begin = np.cumsum(n) - n
    first[begin[n > 0]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:]  # one space after each run of letters
    at = np.concatenate([[0], np.cumsum(keep)])
    lat = np.concatenate([[0], np.cumsum(letter)])
    out = np.where(letter, cps, 32)[keep]
    return out, at[begin], lat[begin + n] - lat[begin]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions letter -> state of each state. The first state is 0, to which none leads."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Model:
    """Names, the letters' codes (from 1; 0: no sample has it), transitions of all automata, and their sizes.

    States of all automata are numbered through; `root` has the first of each. dense[state, code] serves codes below its
    width, the sorted keys state * letters + code with their targets all others; a target equal to the root is none."""

    def __init__(self, samples: dict[str, list[str]], chars: int = SAMPLE_CHARS, dense: int = DENSE):
        cps = {k: normal([" ".join(v)])[0][:chars] for k, v in sorted(samples.items())}
        cps = {k: v for k, v in cps.items() if len(v)}
        self.names = list(cps)
        seen = Counter()
        for v in cps.values():
            seen.update(v.tolist())
        self.code = {c: i + 1 for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
        self.letters = len(self.code) + 1
        automata = [suffix_automaton([self.code[c] for c in v.tolist()]) for v in cps.values()]
        self.root = np.cumsum([0, *(len(a) for a in automata)])[:-1].astype(np.int64)
        width = min(dense, self.letters)
        owner = np.repeat(self.root, [len(a) for a in automata])
        self.dense = np.repeat(owner[:, None], width, 1).astype(np.int32)
        sparse = {}
        for first, a in zip(self.root.tolist(), automata):
            for state, d in enumerate(a):
                for c, to in d.items():
                    if c < width:
                        self.dense[first + state, c] = first + to
                    else:
                        sparse[(first + state) * self.letters + c] = first + to
        self.keys = np.array(sorted(sparse), np.int64)
        self.to = np.array([sparse[k] for k in self.keys.tolist()], np.int32)
        self.bits = np.array([np.log2(len(v) + 1) for v in cps.values()])

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states for states and codes of one shape; the root where there is none."""
        width = self.dense.shape[1]
        if self.letters <= width:
            return self.dense.take(state * width + c)
        rare = c >= width
        to = self.dense.take(state * width + np.where(rare, 0, c))  # code 0 leads nowhere
        if rare.any():
            key = state[rare].astype(np.int64) * self.letters + c[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[rare] = np.where(self.keys[at] == key, self.to[at], to[rare])
        return to

    def phrases(self, codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases of each segment, by language: all segments step by step side by side."""
        order = np.argsort(-length, kind="stable")
        b, n = begin[order], length[order]
        root = self.root.astype(np.int32)[:, None]
        state = np.repeat(root, len(b), 1)
        count = np.zeros((len(self.names), len(b)), np.int32)
        alive = len(b)
        for t in range(int(n[0]) if len(n) else 0):
            while alive and n[alive - 1] <= t:
                alive -= 1
            c = np.broadcast_to(codes[b[:alive] + t], (len(root), alive))
            s = state[:, :alive]
            to = self.step(s, c)
            stuck = to == root
            count[:, :alive] += stuck | (s == root)  # a phrase begins here
            language, text = np.nonzero(stuck)
            to[language, text] = self.step(root[language, 0], c[language, text])
            state[:, :alive] = to
        out = np.zeros_like(count)
        out[:, order] = count
        return out

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cost of each text by language, and its number of letters."""
        cps, begin, has = normal(texts)
        end = np.append(begin[1:], len(cps))
        lut = np.zeros(max([int(cps.max()) if len(cps) else 0, *self.code]) + 1, np.int32)
        lut[list(self.code)] = list(self.code.values())
        n = end - begin
        parts = np.maximum(1, -(-n // SEGMENT))
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        b = begin[owner] + nth * SEGMENT
        got = self.phrases(lut[cps], b, np.minimum(end[owner] - b, SEGMENT))
        return np.stack([np.bincount(owner, weights=g, minlength=len(texts)) for g in got]) * self.bits[:, None], has

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Texts are taken in batches of about PART characters; a longer one in parts of PART."""
        if not self.names:
            return [(UND, 0.0)] * len(texts)
        cost, has = np.zeros((len(self.names), len(texts))), np.zeros(len(texts), np.int64)
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            c, h = self.costs([x for _, x in held])
            at = [k for k, _ in held]
            np.add.at(cost, (slice(None), at), c)
            np.add.at(has, at, h)
            held.clear()

        for k, t in enumerate(texts):
            for lo in range(0, max(1, len(t)), PART):
                held.append((k, t[lo : lo + PART]))
                size += len(held[-1][1]) + 1
                if size >= PART:
                    flush()
                    size = 0
        if held:
            flush()
        win = np.argmin(cost, axis=0)
        rest = np.partition(cost, 1, axis=0)[1] if len(self.names) > 1 else np.full(len(texts), np.inf)
        sure = 1 - cost[win, np.arange(len(texts))] / np.maximum(rest, 1e-300)
        return [(self.names[w], float(s)) if h else (UND, 0.0) for w, s, h in zip(win, sure, has)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """From all rows of docs with a label: counts by language, then a share by hash that gives about sample_docs each."""
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    counts = {r.l: r.n for r in d.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return Model({})
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(span, int(span * sample_docs / n) + 1))])
    h = F.pmod(F.xxhash64("i"), F.lit(span))
    start = 1 + F.pmod(F.xxhash64("i", F.lit(1)), F.greatest(F.lit(1), F.length("t") - PIECE))
    some = d.where(h < share[F.col("l")]).select("l", F.substring("t", start, F.lit(PIECE)).alias("t"), h.alias("h"), "i").orderBy("h", "i").limit(4 * sample_docs * len(counts)).collect()
    by: dict[str, list[str]] = {}
    for r in some:
        by.setdefault(r.l, []).append(r.t)
    return Model(by)


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """Struct of lang_pred and score for every whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            yield pd.DataFrame(shared.value.predict([t or "" for t in texts]), columns=["lang_pred", "score"])
        give_back()

    return of(text)


def trained(docs: DataFrame) -> Model:
    return fit(docs.where(remainder(F.col("doc_id"), 3) != 1))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), predict(spark, trained(docs), F.col("text")).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score")
