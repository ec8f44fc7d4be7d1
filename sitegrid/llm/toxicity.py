"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and their beginnings of 4, 5 and 6 letters (insults come
inflected), hashed into 2^20 buckets. score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the buckets of a
text that the model keeps: the second sum holds what two terms mean only together.

Training takes at most MAX_TRAIN labelled rows (those with the smallest hash of doc_id, whatever the size of the
input), keeps the FEATURES buckets that differ most between the classes, and runs Adam on the log loss.

Cases: null and empty texts score by the bias; repeated labels of one document count once, toxic if any is; of texts with
one id the smallest is learned from, and each is scored;
null labels count as none; with no labels or a single class the score is the smoothed base rate.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.llm.common import give_back, remainder, table

#: Bound on labelled rows that are learned from.
MAX_TRAIN = 8_000
FEATURES, RANK, EPOCHS, BUCKETS = 1_024, 8, 250, 1 << 20
#: Words that a task remembers the terms of, for speed.
MEMO = 20_000

_WORD = re.compile(r"[^\W\d_]+")


def terms_of_word(word: str) -> set[int]:
    return {zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in {word, *("^" + word[:k] for k in (4, 5, 6) if len(word) > k)}}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def buckets(text: str | None) -> list[int]:
    return sorted({b for w in words_of(text) for b in terms_of_word(w)})


@dataclass
class Model:
    """bias, and for each kept bucket its weight and factors."""

    bias: float
    index: dict[int, int] = field(default_factory=dict)
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK)))

    def margin(self, ids: list[int]) -> float:
        if not ids:
            return self.bias
        v = self.v[ids]
        s = v.sum(0)
        return float(self.bias + self.w[ids].sum() + 0.5 * (s @ s - (v * v).sum()))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_rows(rows: list, labels: np.ndarray, features: int = FEATURES, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """rows: sorted bucket arrays of the training texts."""
    n, pos = len(rows), int(labels.sum())
    bias = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    if not pos or pos == n:
        return Model(bias)
    d, p = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r, y in zip(rows, labels, strict=True):  # a row has a bucket once; no copy of all rows is made
        d[r] += 1
        p[r] += y
    q = pos / n
    chi2 = np.where(d >= 2, (p - d * q) ** 2 / np.maximum(d * q * (1 - q), 1e-9), 0)
    kept = np.argsort(-chi2, kind="stable")[:features]
    kept = np.sort(kept[chi2[kept] > 3.84])
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    x = np.zeros((n, len(kept)), np.float32)
    for i, r in enumerate(rows):
        at = place[r]
        x[i, at[at >= 0]] = 1
    rng = np.random.default_rng(seed)
    params = [np.array([bias], np.float32), np.zeros(len(kept), np.float32), rng.normal(0, 0.02, (len(kept), RANK)).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    y = labels.astype(np.float32)
    for step in range(1, epochs + 1):
        b, w, v = params
        xv = x @ v
        err = (sigmoid(b + x @ w + 0.5 * ((xv * xv).sum(1) - x @ (v * v).sum(1))) - y) / n
        xe = x.T @ err
        grads = [np.array([err.sum()], np.float32), xe + 1e-4 * w, x.T @ (xv * err[:, None]) - v * xe[:, None] + 1e-3 * v]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            params[k] = params[k] - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(float(params[0][0]), {int(f): i for i, f in enumerate(kept)}, params[1].astype(float), params[2].astype(float))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Learns from labels' rows, at most max_train of them; the texts of these alone are joined, by broadcast."""
    one = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg(F.max("y").alias("y"))
    sample = one.orderBy(F.xxhash64("i"), "i").limit(max_train)

    @F.pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(buckets)

    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(sample), "i")
    one_text = texts.groupBy("i").agg(F.max("y").alias("y"), F.min("t").alias("t"))  # of an id that occurs twice the smallest text
    got = one_text.select("i", "y", of("t").alias("b")).toArrow().sort_by("i").combine_chunks()  # at most max_train documents
    b = got["b"].combine_chunks() if len(got) else pa.array([], pa.list_(pa.int32()))
    flat, at = np.asarray(b.flatten()), np.asarray(b.offsets) - (b.offsets[0].as_py() if len(b) else 0)
    model = fit_rows([flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], np.asarray(got["y"]).astype(float))
    del got, b, flat
    give_back()
    return model


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """Probability of label 1 of every whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, known = shared.value, {}
        for texts in it:
            out = []
            for t in texts:
                ids: set[int] = set()
                for w in words_of(t):
                    got = known.get(w)
                    if got is None:
                        if len(known) >= MEMO:
                            known.clear()
                        got = known[w] = tuple(m.index[b] for b in terms_of_word(w) if b in m.index)
                    if got:
                        ids.update(got)
                out.append(float(sigmoid(m.margin(sorted(ids)))))
            yield pd.Series(out)
        known.clear()
        give_back()

    return of(text)


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """From labels whose document isn't held out."""
    return fit(docs, table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score(spark, trained(spark, sf_dir, docs), F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
