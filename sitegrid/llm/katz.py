"""Language-model scoring: Katz back-off with Good-Turing discounts and exactly normalised back-off weights.

Words (lower-cased A-Z) and one end per text are the tokens; a text begins after an end. Training texts give
- a table of word counts (hash, count), N tokens and V distinct ones;
- P(w): counts up to TOP_R Good-Turing discounted, the rest as they are; what is left goes to one unknown word;
- every (history, word) pair of the training texts is counted, whatever the words: no word is pooled;
- alpha(h), so that P(. | h) sums to 1 exactly over all words and one unknown word: a pair that was seen has its
  discounted count over count(h) + 1, any other alpha(h) * P(w). The one more count leaves something to back off to after
  any history. A history that was never seen has count 0 and alpha 1.

Scoring evaluates that recursion for every token of every whole text. Work goes by chunks of texts: a chunk's pairs are
counted by document, packed, and dealt to buckets, which count them and answer each chunk with sums by document. The DICT
most frequent words have numbers and known counts; this bounds the driver's arrays and changes no result. Pairs of two such
words are dealt by history, or by pair where the history is frequent; those of two of the HOT most frequent, of which
there are at most HOT^2, stay with their chunk and meet their counts by broadcast. Pairs that end in a rarer word are dealt
by that word, so that its bucket holds all of its tokens and knows its count; other pairs of a rarer history by the history.
alpha(h) of rarer histories is a table, which documents meet by a join.

Cases: null and empty text is one end token; repeated rows are counted and scored row by row; with no training text every word
is unknown, P(unknown) is 1 and the score 0; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.llm.common import least_count, remainder, table, written
from sitegrid.llm.near_dedup import mix, word_hashes

DICT, HOT, TOP_R = 600_000, 1_024, 5
CHUNK_TOKENS, BUCKET_PAIRS = 600_000, 1_600_000
END = np.uint64(0xE2D)  # its words' hashes are mixed; this one is not one of them
_W = 1 << 20  # over DICT
_RARE = np.uint64(1 << 63)  # set in a rarer word's id, its hash; others' ids are numbers below _W


def pack(**arrays: np.ndarray) -> bytes:
    import io

    import zstandard

    f = io.BytesIO()
    np.savez(f, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(f.getvalue())


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    import io

    import zstandard

    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(raw))) as z:
        return {k: z[k] for k in z.files}


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for counts r = 0..TOP_R from how many types have each count (n[r]); 1 beyond. Katz's formula over Good-Turing
    counts where it gives falling counts, else absolute discounting by n1 / (n1 + 2 n2)."""
    d = np.ones(TOP_R + 1)
    if n[1] and n[2:].all():
        a = (TOP_R + 1) * n[TOP_R + 1] / n[1]
        for r in range(1, TOP_R + 1):
            d[r] = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a < 1 else 0
    if not ((d[1:] > 0) & (d[1:] < 1)).all():
        b = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d[1:] = 1 - b / np.arange(1, TOP_R + 1)
    return d


class Unigrams:
    """P(w) from a count, and what base_score needs."""

    def __init__(self, total: int, distinct: int, of: np.ndarray):
        self.total, self.distinct, self.d = total, distinct, discounts(of)
        small = np.arange(1, TOP_R + 1)
        lost = float((of[1 : TOP_R + 1] * small * (1 - self.d[1:])).sum())
        self.unknown = lost / total if total else 1.0
        self.shrink = 1.0
        if total and not lost:  # only frequent words: one more count for the unknown one
            self.unknown, self.shrink = 1 / (total + 1), total / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c)
        d = np.where(c <= TOP_R, self.d[np.minimum(c, TOP_R)], 1.0)
        return np.where(c > 0, d * c * self.shrink / max(1, self.total), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(c) + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def tokens(text: str | None) -> np.ndarray:
    return np.append(word_hashes(text), END)


def chunks(it: Iterator[pd.DataFrame], size: int) -> Iterator[list[tuple]]:
    held, n = [], 0
    for rows in it:
        for r in rows.itertuples(index=False):
            held.append((r.i, r.train, tokens(r.t)))
            n += len(held[-1][2])
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def count_words(docs: DataFrame) -> DataFrame:
    """w (hash), n (count) of the training texts' tokens, as a table."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(it, 2 * CHUNK_TOKENS):
            w, n = np.unique(np.concatenate([t for _, _, t in chunk]), return_counts=True)
            yield pd.DataFrame({"w": w.view(np.int64), "n": n})

    return written(docs.where("train").mapInPandas(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "unigrams")


def counts_of_counts(df: DataFrame, col: str) -> np.ndarray:
    out = np.zeros(TOP_R + 2, np.int64)
    for r in df.where(F.col(col) <= TOP_R + 1).groupBy(col).count().collect():
        out[r[0]] = r[1]
    return out


class Words:
    """The dictionary of frequent words: sorted hashes, numbers (1 on, by rank), and counts by number."""

    def __init__(self, w: np.ndarray, n: np.ndarray):
        w = w.astype(np.int64).view(np.uint64)
        rank = np.lexsort((w, -n))
        number = np.zeros(len(w), np.int32)
        number[rank] = np.arange(1, len(w) + 1)
        order = np.argsort(w)
        self.w, self.number = w[order], number[order]
        self.n = np.append(0, n[rank]).astype(np.int64)

    def find(self, w: np.ndarray) -> np.ndarray:
        """Numbers; 0: not in the dictionary."""
        if not len(self.w):
            return np.zeros(len(w), np.int64)
        at = np.minimum(np.searchsorted(self.w, w), len(self.w) - 1)
        return np.where(self.w[at] == w, self.number[at], 0).astype(np.int64)


POSTED = "chunk long, bucket int, payload binary"


def distinct(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each first of equal (keys, doc) stands, in order of keys, and how many are equal."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (*keys, doc)], axis=0)
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def post(docs: DataFrame, shared, buckets: int) -> DataFrame:
    """Packed pairs by chunk and bucket; -1: a chunk's documents; -2: its pairs of hot words."""

    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, uni = shared.value
        big = np.append(True, words.n[1:] > max(1, uni.total // (4 * buckets)))
        for chunk in chunks(it, CHUNK_TOKENS):
            name = uuid.uuid4().int >> 66
            n = np.array([len(t) for _, _, t in chunk])
            doc = np.repeat(np.arange(len(chunk)), n)
            w = np.concatenate([t for _, _, t in chunk])
            x = words.find(w)
            c = words.n[x]
            sums = lambda v: np.bincount(doc, weights=v, minlength=len(chunk))
            ids = [i for i, _, _ in chunk]
            train = np.array([bool(t) for _, t, _ in chunk])
            rows = [(-1, pack(i=np.array(["" if i is None else i for i in ids]), train=train, n=n, known=sums(c > 0), base=sums(np.where(x > 0, uni.base(c), 0.0))))]
            w = np.where(x > 0, x.astype(np.uint64), w | _RARE)
            h = np.concatenate([w[:1], w[:-1]])
            end = words.find(np.array([END]))[0]
            h[np.cumsum(n) - n] = end if end else END | _RARE
            rare = (h >= _RARE) | (w >= _RARE)

            def deal(b: np.ndarray, packed) -> None:
                by = np.argsort(b, kind="stable")
                cut = np.flatnonzero(np.append(True, np.diff(b[by]) != 0)) if len(by) else []
                for lo, hi in zip(cut, np.append(cut[1:], len(by))):
                    rows.append((int(b[by[lo]]), packed(by[lo:hi])))  # noqa: B023

            # pairs counted by document
            k = (h[~rare] * np.uint64(_W) + w[~rare]).astype(np.int64)
            d = doc[~rare]
            at, f = distinct(d, k)
            k, d, f = k[at], d[at].astype(np.int32), f.astype(np.int32)
            kh, kw = k // _W, k % _W
            b = (mix(np.where(big[kh], k, kh).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            b[(kh <= HOT) & (kw <= HOT)] = -2
            deal(b, lambda at: pack(k=np.diff(k[at], prepend=0), d=d[at], f=f[at], train=train, m=np.array([len(chunk)])))  # noqa: B023
            rh, rw, rd = h[rare], w[rare], doc[rare]
            at, rf = distinct(rd, rh, rw)
            rh, rw, rd, rf = rh[at], rw[at], rd[at].astype(np.int32), rf.astype(np.int32)
            b = (mix(np.where(rw >= _RARE, rw, rh)) % np.uint64(buckets)).astype(np.int64)
            deal(b, lambda at: pack(h=rh[at], w=rw[at], d=rd[at], f=rf[at], train=train, m=np.array([len(chunk)])))  # noqa: B023
            yield pd.DataFrame({"chunk": name, "bucket": [b for b, _ in rows], "payload": [x for _, x in rows]})

    return written(docs.mapInPandas(of, POSTED), "pairs")


def pair_stats(h: np.ndarray, c: np.ndarray, p: np.ndarray) -> pd.DataFrame:
    """Of seen pairs (history, count, P of the word): for each history how many have each small count, the sum of larger
    ones, the sum of P."""
    hs, at = np.unique(h, return_inverse=True)
    out = {"h": hs.view(np.int64), "p": np.bincount(at, weights=p, minlength=len(hs)), "more": np.bincount(at, weights=np.where(c > TOP_R, c, 0), minlength=len(hs)).astype(np.int64)}
    out |= {f"n{r}": np.bincount(at[c == r], minlength=len(hs)) for r in range(1, TOP_R + 2)}
    return pd.DataFrame(out)


SMALL = [f"n{r}" for r in range(1, TOP_R + 2)]
STATS = ["p", "more", *SMALL]
ANSWER = ["kind", "chunk", "payload", "d", "h", "seen", "unseen", *STATS]  # kind 0: to a chunk; 1: statistics of h; 2: a document's tokens after h


def doc_sums(x: dict, h: np.ndarray, c: np.ndarray, p: np.ndarray, n: np.ndarray, **more: np.ndarray) -> bytes:
    """A chunk's sums by document: log10 of shares without discounts, tokens by small count; and its unseen pairs. What
    depends on a rarer history alone is left out."""
    m, d, f = int(x["m"][0]), x["d"], x["f"].astype(float)
    seen, known = c > 0, h < _RARE
    nh = np.where(known, n[np.where(known, h, 0).astype(np.int64)], 0)
    s = f * np.where(seen, np.log10(np.maximum(c, 1)) - np.log10(nh + 1), np.log10(p))
    small = [np.bincount(d[c == r], weights=f[c == r], minlength=m).astype(np.int32) for r in range(1, TOP_R + 1)]
    left = ~seen & known
    return pack(s=np.bincount(d, weights=s, minlength=m), small=np.stack(small), ud=d[left], uh=h[left].astype(np.int32), uf=x["f"][left], **more)


def load(raw: bytes) -> dict:
    x = unpack(raw)
    if "k" in x:
        x["k"] = np.cumsum(x["k"])
    return x


def counted(xs: list[dict], key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys of all xs: firsts of the distinct ones, which each is, their counts in training texts."""
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    return first, at, np.bincount(at, weights=np.concatenate([x["f"] * x["train"][x["d"]] for x in xs]), minlength=len(first)).astype(np.int64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train=None) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score, score for each row of docs; train: a condition."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("string").alias("i"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("t"))
    unigrams = count_words(d)
    total, types = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    uni = Unigrams(total, types, counts_of_counts(unigrams, "n"))
    top = unigrams.where(F.col("n") >= least_count(unigrams, DICT)).toArrow()  # at most DICT words
    words = Words(top["w"].to_numpy(), top["n"].to_numpy())
    buckets = 1 + 10 * total // 9 // BUCKET_PAIRS
    shared = spark.sparkContext.broadcast((words, uni))
    posted = post(d, shared, buckets)

    # pairs of hot words: counts are at most HOT^2 numbers
    def count_hot(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((HOT + 1, HOT + 1), np.int64)
        for rows in it:
            for raw in rows.payload:
                x = load(raw)
                np.add.at(n, (x["k"] // _W, x["k"] % _W), x["f"] * x["train"][x["d"]])
        h, w = np.nonzero(n)
        yield pd.DataFrame({"k": h * _W + w, "c": n[h, w]})

    hot_rows = posted.where("bucket = -2").select("chunk", "payload")
    hot = hot_rows.select("payload").mapInPandas(count_hot, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow().to_pandas().sort_values("k")
    hot_k, hot_c = hot.k.to_numpy(np.int64), hot.c.to_numpy(np.int64)

    # all other pairs: counted in their bucket, which answers with sums for each chunk and with statistics of its histories
    def bucket(rows: pd.DataFrame) -> pd.DataFrame:
        words, uni = shared.value
        loaded = [(name, load(raw)) for name, raw in zip(rows.chunk, rows.payload)]
        out = []
        if both := [x for x in loaded if "k" in x[1]]:
            xs = [x for _, x in both]
            key = np.concatenate([x["k"] for x in xs])
            first, at, c = counted(xs, key)
            h, p = (key // _W).astype(np.uint64), uni.p(words.n[key % _W])
            cut = np.cumsum([0, *(len(x["k"]) for x in xs)])
            for (name, x), lo, hi in zip(both, cut, cut[1:]):
                out.append(pd.DataFrame({"kind": 0, "chunk": name, "payload": [doc_sums(x, h[lo:hi], c[at[lo:hi]], p[lo:hi], words.n)]}))
            out.append(pair_stats(h[first][c > 0], c[c > 0], p[first][c > 0]).assign(kind=1))
        if both := [x for x in loaded if "w" in x[1]]:
            xs = [x for _, x in both]
            h, w, f, d = (np.concatenate([x[v] for x in xs]) for v in "hwfd")
            first, at, c = counted(xs, mix(h) * np.uint64(0x9E3779B97F4A7C15) + w)
            rare = w >= _RARE
            _, w_at, w_n = counted(xs, w)  # all tokens of a rarer word are here
            n = np.where(rare, w_n[w_at], words.n[np.where(rare, 0, w).astype(np.int64)])
            p, seen = uni.p(n), c[at] > 0
            cut = np.cumsum([0, *(len(x["w"]) for x in xs)])
            for (name, x), lo, hi in zip(both, cut, cut[1:]):
                own = f[lo:hi] * rare[lo:hi]
                sums = lambda v: np.bincount(x["d"], weights=v, minlength=int(x["m"][0]))  # noqa: B023, E731
                more = {"known": sums(own * (n[lo:hi] > 0)), "base": sums(own * uni.base(n[lo:hi]))}
                out.append(pd.DataFrame({"kind": 0, "chunk": name, "payload": [doc_sums(x, h[lo:hi], c[at[lo:hi]], p[lo:hi], words.n, **more)]}))
            out.append(pair_stats(h[first][c > 0], c[c > 0], p[first][c > 0]).assign(kind=1))
            r = h >= _RARE
            names = np.repeat(np.array([name for name, _ in both], np.int64), np.diff(cut))
            out.append(pd.DataFrame({"kind": 2, "chunk": names[r], "d": d[r], "h": h[r].view(np.int64), "seen": (f * seen)[r], "unseen": (f * ~seen)[r]}))
        return pd.concat([pd.DataFrame({"payload": pd.Series([None] * len(x), dtype=object)} | {v: np.zeros(len(x), float if v == "p" else np.int64) for v in ANSWER if v != "payload"}).assign(**{v: x[v].to_numpy() for v in x}) for x in out], ignore_index=True)[ANSWER]

    schema = "kind int, chunk long, payload binary, d int, h long, seen int, unseen int, p double, more long, " + ", ".join(f"{s} int" for s in SMALL)
    answered = written(posted.where("bucket >= 0").select("bucket", "chunk", "payload").groupBy("bucket").applyInPandas(bucket, schema), "bigrams")
    hot_stats = pair_stats(hot_k // _W, hot_c, uni.p(words.n[hot_k % _W]))
    stats = answered.where("kind = 1").select("h", *STATS).union(spark.createDataFrame(hot_stats, "h long, p double, more long, " + ", ".join(f"{s} long" for s in SMALL)))
    d2 = discounts(np.array([0, *(v or 0 for v in stats.agg(*[F.sum(s) for s in SMALL]).first())]))
    n = F.col("more") + sum(F.col(f"n{r}") * r for r in range(1, TOP_R + 1))
    held = F.col("more") + sum(F.col(f"n{r}") * (r * float(d2[r])) for r in range(1, TOP_R + 1))
    histories = stats.groupBy("h").agg(*[F.sum(s).alias(s) for s in STATS]).select("h", n.alias("n"), ((1 - held / (n + 1)) / (1 - F.col("p"))).alias("alpha"))
    own = histories.where("h > 0").select("h", "alpha").toArrow()  # at most DICT rows
    alpha = np.ones(len(words.n))
    alpha[own["h"].to_numpy()] = own["alpha"].to_numpy()
    last = spark.sparkContext.broadcast((d2, alpha, hot_k, hot_c))

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        words, uni = shared.value
        d2, alpha, hot_k, hot_c = last.value
        meta = unpack(rows.payload[rows.kind == -1].iloc[0])
        s, known, base = np.zeros(len(meta["n"])), meta["known"], meta["base"]
        for kind, raw in zip(rows.kind, rows.payload):
            if kind == -1:
                continue
            if kind == -2:
                x = load(raw)
                at = np.minimum(np.searchsorted(hot_k, x["k"]), max(0, len(hot_k) - 1))
                c = np.where(hot_k[at] == x["k"], hot_c[at], 0) if len(hot_k) else np.zeros(len(x["k"]), np.int64)
                raw = doc_sums(x, (x["k"] // _W).astype(np.uint64), c, uni.p(words.n[x["k"] % _W]), words.n)
            x = unpack(raw)
            s += x["s"] + (x["small"] * np.log10(d2[1:])[:, None]).sum(0)
            s += np.bincount(x["ud"], weights=x["uf"] * np.log10(alpha[x["uh"]]), minlength=len(s))
            if "base" in x:
                known, base = known + x["known"], base + x["base"]
        return pd.DataFrame({"chunk": rows.chunk.iloc[0], "d": np.arange(len(s)), "i": [v or None for v in meta["i"].tolist()], "train": meta["train"], "n_tokens": meta["n"], "known": known.astype(np.int64), "base": base, "score": s})

    parts = posted.where("bucket < 0").select("chunk", F.col("bucket").alias("kind"), "payload").union(answered.where("kind = 0").select("chunk", "kind", "payload"))
    by_doc = parts.groupBy("chunk").applyInPandas(finish, "chunk long, d int, i string, train boolean, n_tokens long, known long, base double, score double")
    after = answered.where("kind = 2").select("chunk", "d", "h", "seen", "unseen").join(histories.where("h < 0"), "h")  # without a row: n is 0, alpha 1
    after = after.groupBy("chunk", "d").agg(F.sum(F.col("unseen") * F.log10("alpha") - F.col("seen") * F.log10(F.col("n") + 1)).alias("s2"))
    return by_doc.join(after, ["chunk", "d"], "left").select(F.col("i").cast(docs.schema[id_col].dataType).alias(id_col), "train", "n_tokens", F.col("known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = score(table(spark, sf_dir, "documents"), train=remainder(F.col("doc_id"), 10) != 0)
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
