"""MinHash near-dedup: an inverted join on the coordinates of signatures.

1. Each text becomes its set of word shingles (64-bit hashes), the set's size, a 128-bit fingerprint and a MinHash
   signature: COORDS coordinates to post, and two bits of each of FINE further ones to compare by. Equal sets are one class, told
   apart by fingerprint and numbered: copies cost nothing further. Ids only name what is found.
2. Classes are posted under every pair (coordinate, value). Two that match in MATCH of COORDS coordinates share a
   posting among any COORDS - MATCH + 1 of each, so only the prefix of that length is merged: each one's rarest postings
   by the global order (length of the list, key). Lists of one end there. All other lists are skipped; their collisions
   are counted by comparing the two signatures.
3. Lists are merged through hubs: in each round every list that still spans several components has its members compared
   with one of them (first the one with the longest lists, which is in the middle of a group of copies), and the links
   found unite components; a list within one component is done. After ROUNDS rounds what spans components is joined in
   full, member by member, which leaves no pair out and is small because groups of near copies have collapsed by then.
4. Pairs over the match threshold are confirmed on the full sets: |A & B| >= similarity * |A | B|. Components follow by
   alternating large and small stars.

Match thresholds are five standard deviations under what a pair right at the asked similarity expects, so it is missed in
a few cases of a million; nothing is capped.

Cases: lower-casing is A-Z only; fewer words than a shingle are one shingle; null, empty and blank texts have an empty set and
stay alone; repeated rows are copies; rows of one id with different texts are documents of their own, each in the group of its
text; ids may be of any ordered type; an empty table gives no rows. A row without an id takes part like any other; it is no
group's name: its group's is the smallest id in it, or null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitegrid.llm.common import give_back, table, written

COORDS, FINE, ROUNDS = 32, 1024, 3

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_A = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64)
_A32 = _rng.integers(1, 1 << 31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B32 = _rng.integers(0, 1 << 32, FINE, dtype=np.uint32)
_BASE = (int(_rng.integers(1, 1 << 62)) * 8 + 5) % (1 << 64)
_INV = pow(_BASE, -1, 1 << 64)
_GAP = np.zeros(256, np.bool_)
_GAP[[32, *range(9, 14)]] = True


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest text needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up), 1 << 16)
            one = np.ones(n, np.uint64)
            with np.errstate(over="ignore"):
                up, down = one.copy(), one.copy()
                up[1:], down[1:] = _U(_BASE), _U(_INV)
                cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    @classmethod
    def forget(cls) -> None:
        cls.up = cls.down = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word: polynomial over its bytes, from running sums over the whole text."""
    raw = (text or "").encode("utf-8", "replace").lower()
    if not raw:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(raw, np.uint8)
    gap = _GAP[a]
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    _Powers.to(len(a) + 1)
    x = _BYTE[a]
    x[gap] = 0
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _Powers.up[: len(a)], dtype=np.uint64)])
    return mix((c[end] - c[start]) * _Powers.down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * _U(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """Smallest values under COORDS multiply-shift hashes."""
    out = np.full(COORDS, 0xFFFFFFFF, np.uint64)
    for lo in range(0, len(s), 4096):
        out = np.minimum(out, (((s[lo : lo + 4096, None] * _A) + _B) >> _U(32)).min(axis=0))
    return out.astype(np.uint32)


def fine_bits(s: np.ndarray) -> np.ndarray:
    """Two bits of each of FINE smallest values, 32 to a word."""
    low = np.full(FINE, 0xFFFFFFFF, np.uint32)
    h = (s >> _U(32)).astype(np.uint32)
    for lo in range(0, len(h), 128):
        low = np.minimum(low, (h[lo : lo + 128, None] * _A32 + _B32).min(axis=0))
    two = (low & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return np.bitwise_or.reduce(two << (_U(2) * np.arange(32, dtype=np.uint64)), axis=1).view(np.int64)


def least_matches(n: int, percent: int, chance: float = 0.0) -> int:
    """Of n coordinates, which agree by chance at `chance` where the sets differ."""
    p = percent / 100 + (1 - percent / 100) * chance
    return max(1, int(n * p - 5 * (n * p * (1 - p)) ** 0.5))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
    return a, b


def slices(it: Iterator[pa.RecordBatch], n: int = 500) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts, n rows at a time."""
    for batch in it:
        for lo in range(0, len(batch), n):
            yield batch.column(0).slice(lo, n), batch.column(1).slice(lo, n)
    _Powers.forget()
    give_back()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """id, n (size of the set), f1 and f2 (its fingerprint), sig (COORDS numbers) and bits (of FINE
    more); both null for an empty set."""

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(it):
            n, f1, f2, sig, bits = [], [], [], [], []
            for t in texts:
                s = shingles(t.as_py(), size)
                f = fingerprint(s)
                n.append(len(s))
                f1.append(f[0])
                f2.append(f[1])
                sig.append(signature(s).view(np.int32) if len(s) else None)
                bits.append(fine_bits(s) if len(s) else None)
            longs = [pa.array(x, pa.int64()) for x in (n, f1, f2)]
            yield pa.RecordBatch.from_arrays([ids, *longs, pa.array(sig, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))], names=["i", "n", "f1", "f2", "sig", "bits"])

    fields = StructType.fromDDL("n long, f1 long, f2 long, sig array<int>, bits array<long>").fields
    return docs.mapInArrow(sketch, StructType([docs.schema[0], *fields]))


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for all nodes of the edges (a, b), by alternating large and small stars."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = written(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), "low")
        e = written(e.join(low.where("k > 1").select("u", "m"), "u", "left").select(F.when(F.col("m").isNull() | (F.col("m") == F.col("v")), F.col("u")).otherwise(F.col("v")).alias("u"), F.coalesce("m", "v").alias("v")).where("u <> v").distinct(), "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.count_distinct("u"), F.max("u")).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def agreeing(a: str, b: str) -> Column:
    """How many of COORDS coordinates agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def fine_agreeing(a: str, b: str) -> Column:
    """How many of FINE pairs of bits agree."""
    ones = F.lit(0x5555555555555555)

    def differ(i: int) -> Column:
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))

    return F.lit(FINE) - sum((differ(i) for i in range(1, FINE // 32)), differ(0))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """i (id), n (size of the set), comp (smallest id of the group), one row for each row of docs."""
    spark = docs.sparkSession
    match, fine = least_matches(COORDS, percent), least_matches(FINE, percent, 0.25)
    # j finds a class's text again: it is of the id, or of the text where there is none
    d = docs.select(F.col(id_col).alias("i"), F.coalesce(F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.xxhash64(text_col)).alias("j"), F.col(text_col).alias("t"))
    sk = written(sketches(d.select(F.struct("i", "j").alias("id"), "t"), size).select("id.*", "n", "f1", "f2", "sig", "bits"), "sketches")
    full = sk.where("n > 0")
    classes = full.groupBy("f1", "f2", "n").agg(F.min("i").alias("lo"), F.min("j").alias("j"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    posts = classes.select("rep", F.posexplode("sig").alias("c", "x")).select("rep", (F.shiftleft(F.col("c").cast("long"), 32) + (F.col("x").cast("long").bitwiseAND(0xFFFFFFFF))).alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("len")).where("len > 1")
    shared = posts.join(lists, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("len", "key"))).alias("l"))  # COORDS at most
    prefix = F.slice("l", 1, F.greatest(F.lit(0), F.size("l") - F.lit(match - 1)))
    # of COORDS postings those in `l` are shared; the rarer, unshared ones fill the prefix of COORDS - match + 1 first
    weight = F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + x["len"])
    head = shared.select("rep", weight.alias("weight"), prefix.alias("l")).withColumn("keys", F.col("l.key"))
    posts = written(head.select("rep", "weight", "keys", F.explode("keys").alias("key")), "postings")
    long = posts.groupBy("key").agg(F.count("*").alias("len")).where("len > 1").drop("len")
    posts = written(posts.join(long, "key"), "lists").join(classes.select("rep", "n", "sig", "bits"), "rep")
    posts = written(posts, "posted")
    wanted = classes.select("rep", "j", "f1", "f2").join(posts.select("rep").distinct(), "rep", "left_semi")

    def set_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(it):
            got = [shingles(t.as_py(), size) for t in texts]
            own = pa.array([fingerprint(s) == (r["f1"], r["f2"]) for s, r in zip(got, rows.to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.field("rep").filter(own), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64())).filter(own)], names=["rep", "s"])

    found = d.select("j", "t").join(wanted, "j").select(F.struct("rep", "f1", "f2").alias("row"), "t")
    sets = written(found.mapInArrow(set_of, "rep long, s array<long>").dropDuplicates(["rep"]), "sets")

    def linked(a: str, b: str) -> Column:
        """100 * intersection >= percent * union."""
        return F.size(F.array_intersect(a, b)) * (100 + percent) >= percent * (F.size(a) + F.size(b))

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
        both = with_a.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
        return both.where(linked("sa", "sb")).select("a", "b")

    def similar(a: str, b: str):
        return (100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")) & (fine_agreeing(f"{a}.bits", f"{b}.bits") >= fine) & (agreeing(f"{a}.sig", f"{b}.sig") >= match)

    comps = spark.createDataFrame([], "node long, comp long")
    for k in range(rounds + 1):
        now = posts.join(comps, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "rep")).drop("node")
        spread = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        now = written(now.join(spread, "key"), "open")
        if now.isEmpty():
            break
        if k < rounds:
            order = F.struct((-F.col("weight") if k == 0 else F.xxhash64("rep", F.lit(k))).alias("by"), "rep", "n", "sig", "bits", "comp")
            hubs = now.groupBy("key").agg(F.min(order).alias("h")).select("key", "h.rep", "h.n", "h.sig", "h.bits", "h.comp")
            pairs = now.alias("x").join(hubs.alias("y"), "key").where("x.comp <> y.comp").where(similar("x", "y"))
            pairs = pairs.select(F.col("y.rep").alias("a"), F.col("x.rep").alias("b")).distinct()
        else:
            # a pair counts in the first of its common lists alone
            first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
            on = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & similar("x", "y") & first
            pairs = now.alias("x").join(now.alias("y"), on).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
        links = written(confirmed(pairs), "links")
        if not links.isEmpty():
            comps = components(links.union(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
    named = classes.join(comps, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", "lo", F.coalesce("comp", "rep").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("lo").alias("lowest"))
    named = named.join(lowest, "comp").select("f1", "f2", "n", F.lit(True).alias("_known"), "lowest")
    got = sk.join(written(named, "named"), ["f1", "f2", "n"], "left")
    return got.select("i", "n", F.when(F.col("_known"), F.col("lowest")).otherwise(F.col("i")).alias("comp"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return got.select(F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("i").eqNullSafe(F.col("comp")).alias("kept"))
