"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional codeword from each of BOOKS codebooks, chosen by beam search over
the residuals; the squared norm of the sum is stored beside the codes. A query has one table of inner products per
codebook, so |q-x|^2 is |q|^2 + norm - 2 * (sum of BOOKS table entries). In each task the RERANK best of a batch by
these are measured exactly on the original vectors, and the ten best of a query go on.

Codebooks are fitted on a sample of at most MAX_FIT vectors (smallest hash of the id); every row is coded and searched.
Queries are taken in blocks of BLOCK, each of which scans the index once.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length
than most; a query id that occurs twice asks once, with the smaller vector; rows with the query's id are never its
candidates; equal distances go by the smaller id; with under k candidates all are given; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegrid.llm.common import table, written

MAX_FIT = 8_192
BOOKS, WORDS, BEAM, RERANK, BLOCK = 12, 256, 8, 192, 2_048


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = assign(x, c)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) by beam search: at each codebook the best `beam` partial sums of a vector go on."""
    n, (m, k, d) = len(x), books.shape
    codes, rest = np.zeros((n, 1, 0), np.int16), x[:, None, :]
    for b in range(m):
        c = books[b]
        cost = (rest * rest).sum(2)[:, :, None] + (c * c).sum(1) - 2 * rest @ c.T
        flat = cost.reshape(n, -1)
        w = min(beam if b < m - 1 else 1, flat.shape[1])
        top = np.argpartition(flat, w - 1, axis=1)[:, :w] if w < flat.shape[1] else np.argsort(flat, axis=1)
        frm, code = top // k, top % k
        codes = np.concatenate([np.take_along_axis(codes, frm[:, :, None], 1), code[:, :, None].astype(np.int16)], 2)
        rest = np.take_along_axis(rest, frm[:, :, None], 1) - c[code]
    return codes[:, 0, :].astype(np.uint8)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[b][codes[:, b]] for b in range(len(books)))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 5) -> np.ndarray:
    """Residual k-means, then rounds of beam-search coding and a joint least-squares fit of all codewords."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    words = max(1, min(words, len(x)))
    out, rest = [], x.copy()
    for _ in range(books):
        c = kmeans(rest, words, rng)
        out.append(c)
        rest = rest - c[assign(rest, c)]
    b = np.stack(out)
    for _ in range(rounds):
        at = encode(x, b) + np.arange(books) * words
        gram = np.zeros((books * words, books * words), np.float32)
        for i in range(books):
            for j in range(books):
                np.add.at(gram, (at[:, i], at[:, j]), 1)
        rhs = np.zeros((books * words, x.shape[1]), np.float32)
        for i in range(books):
            np.add.at(rhs, at[:, i], x)
        old = b.reshape(books * words, -1)
        lam = 0.1  # towards the old codewords: a word without members stays
        b = np.linalg.solve(gram + lam * np.eye(len(gram), dtype=np.float32), rhs + lam * old).reshape(b.shape).astype(np.float32)
    return b


def usable(v: pd.Series, dim: int) -> np.ndarray:
    def ok(a) -> bool:
        if a is None or len(a) != dim:
            return False
        a = np.asarray(a, dtype=float)  # None becomes nan
        return bool(np.isfinite(a).all() and a.any())

    return v.map(ok).to_numpy(bool)


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", max_fit: int = MAX_FIT) -> tuple[DataFrame, np.ndarray, int]:
    """The index (id, original vector, codes, norm of their sum) as a table, the codebooks, the dimension."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    most = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most.d if most else 0
    fine = v.where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    sample = np.array([r.v for r in fine.orderBy(F.xxhash64("id"), "id").limit(max_fit).toLocalIterator()], np.float32)  # max_fit rows
    books = fit(sample) if len(sample) else np.zeros((BOOKS, 1, dim), np.float32)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def code(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            for lo in range(0, len(rows), 1024):
                r = rows.iloc[lo : lo + 1024]
                c = encode(np.stack(r.v.to_numpy()).astype(np.float32), shared.value)
                yield pd.DataFrame({"id": r.id, "v": r.v, "codes": [a.tobytes() for a in c], "norm": (decode(c, shared.value) ** 2).sum(1)})

    return written(fine.mapInPandas(code, "id long, v array<float>, codes binary, norm float"), "aq-index"), books, dim


def best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, dist))[:k]


def search_block(index: DataFrame, books: np.ndarray, queries: list[tuple[int, np.ndarray]], k: int, rerank: int = RERANK) -> DataFrame:
    """The k nearest of each query within each task's rows."""
    shared = index.sparkSession.sparkContext.broadcast((books, np.array([q for q, _ in queries]), np.stack([v for _, v in queries]).astype(np.float64)))

    def near(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, qid, q = shared.value
        luts = np.einsum("bkd,qd->bkq", b, q.astype(np.float32))
        held = [(np.zeros(0, np.int64), np.zeros(0))] * len(qid)
        for whole in it:
            whole = whole.sort_values("id", kind="stable")
            for lo in range(0, len(whole), 4096):
                rows = whole.iloc[lo : lo + 4096]
                codes = np.frombuffer(b"".join(rows.codes), np.uint8).reshape(len(rows), -1)
                ids, x = rows.id.to_numpy(np.int64), np.stack(rows.v.to_numpy()).astype(np.float64)
                guess = np.repeat(rows.norm.to_numpy(np.float32)[:, None], len(qid), 1)
                for m in range(len(luts)):
                    guess -= 2 * luts[m][codes[:, m]]
                r = min(rerank + 1, len(rows))
                edge = np.partition(guess, r - 1, axis=0)[r - 1]
                for j in range(len(qid)):
                    at = np.flatnonzero(guess[:, j] <= edge[j])
                    at = at[np.argsort(guess[at, j], kind="stable")[:r]]  # rows come by id: equal codes by the smaller id
                    at = at[ids[at] != qid[j]]
                    d = np.sqrt(((x[at] - q[j]) ** 2).sum(1))
                    i, d = np.concatenate([held[j][0], ids[at]]), np.concatenate([held[j][1], d])
                    top = best(d, i, k)
                    held[j] = i[top], d[top]
        n = [len(i) for i, _ in held]
        yield pd.DataFrame({"query_id": np.repeat(qid, n), "vec_id": np.concatenate([i for i, _ in held]), "score": np.concatenate([d for _, d in held])})

    return index.mapInPandas(near, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where is_query(id column) holds, against all rows."""
    index, books, _ = build(vectors, id_col, vec_col)
    asked = index.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    n = -(-asked.count() // block)
    found = None
    for b in range(n):  # one scan of the index for each block of queries
        some = [(r.id, np.array(r.v)) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).toLocalIterator()]
        if some:
            part = search_block(index, books, some, k)
            found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
