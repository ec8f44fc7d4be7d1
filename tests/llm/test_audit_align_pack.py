"""Filter audit, cross-tokenizer alignment and packing against brute force and the tokenizers' own libraries."""

import hashlib
import itertools
import json
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrid.llm import alignment, filter_audit, memo, packing, registry

SF = "/root/testdata/sf0.001"
ODD = ["a\U0002ebf0b word", "xᲉy z", "ab" * 90 + " " + "q" * 3000, "", None, " \n\t ", "a", "<|endoftext|> x<|startoftext|>y", "naïve  café 日本語 😀😀 ½²", "don't I'll 'sx O'Neil's", "=" * 300, "word " * 5000, "\x1cx\x1dy \x00", "  two  spaces \n\n x", "ABC abc ÀÉ ΣΑΣ İx", "ab ", "é ́x Å.", "▁x ▁", "Straße, ÄÖÜ! x.y. z?! ..", "x y z\x85w", "ℵ µm ªº ßß", "a" * 5000]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def paths():
    import public_tokenizers as p

    return p


# filter audit


def test_positional_popcounts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 100, 10_007):
        w = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert filter_audit.positional_popcounts(w).tolist() == [int(((w >> b) & 1).sum()) for b in range(32)]


def brute_audit(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    out = []
    facts = []
    for i, t, lang in rows:
        t = t or ""
        w = words(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        facts.append((i, lang or "", f))
    for part in {p for _, p, _ in facts}:
        own = [(i, f) for i, p, f in facts if p == part]
        removed_by = Counter()
        rows_of = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order):
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                removed_by[k] += len(gone)
                failing = [x for x in own if x[1][k]]
                rows_of.append((k, [part, "".join(order), step + 1, len(left), len(gone), len(failing) - len(gone), sum(not any(v for z, v in x[1].items() if z != k) for x in failing), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]))
        out += [(*r, removed_by[k]) for k, r in rows_of]
    return Counter(out)


def test_audit_is_that_of_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "Cc", "DDD", "#", "word", "x1"] + [f"w{k}" for k in range(200)]) for _ in range(rng.choice([3, 99, 100, 101, 150]))) for _ in range(30)] + ["", None, "ONE", "x\x00y", " \t\n"]
    rows = [(rng.choice([None, k, k % 7]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(300)]
    rows += [(5, texts[0], "en")] * 3  # repeated rows
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(300)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(spark, rows).withColumns({c: F.lit(9) for c in ("part", "fails", "i", "first", "good")})
    got = filter_audit.audit(filter_audit.with_all_fails(d, lab))
    assert Counter(map(tuple, got.collect())) == brute_audit(rows, labels)
    assert filter_audit.audit(filter_audit.with_all_fails(d.limit(0), lab)).count() == 0


# alignment


def brute_alignment(rows):
    from tokenizers import Tokenizer
    import sentencepiece

    p = paths()
    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    with open(p.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = memo.byte_of()
    a_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}

    def b_of(i):
        s = sp.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if re.fullmatch("<0x..>", s) else s.replace("▁", " ").encode()

    per, df = [], Counter()
    for i, text, *_ in rows:
        links, digest, n = Counter(), "", (0, 0, 0)
        raw = (" " + (text or "")).encode()
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        if text and b"".join(a_of[x] for x in a) == raw == b"".join(map(b_of, b)):
            ends = [list(itertools.accumulate(len(of(x)) for x in ids)) for ids, of in ((a, a_of.get), (b, b_of))]
            groups, lo = [], [0, 0]
            for e in sorted(set(ends[0]) & set(ends[1])):
                hi = [next(k for k, x in enumerate(z) if x == e) + 1 for z in ends]
                groups.append((a[lo[0] : hi[0]], b[lo[1] : hi[1]]))
                lo = hi
            for x, y in groups:
                links.update(itertools.product(x, y))
            n = len(a), len(b), len(groups)
            digest = hashlib.sha256(";".join("|".join(",".join(map(str, z)) for z in g) for g in groups).encode()).hexdigest()
        per.append((i, n, links, digest))
        df.update(links.keys())
    top = defaultdict(int)
    for (a, _), c in df.items():
        top[a] = max(top[a], c)
    return Counter((i, *n, sum(k.values()), sum(m for p, m in k.items() if df[p] == top[p[0]]), sum(m * df[p] for p, m in k.items()), s) for i, n, k, s in per)


@pytest.mark.parametrize(("chunk", "cell"), [(2_000_000, 1_000_000), (50, 7)])
def test_alignment_is_that_of_brute_force(spark, chunk, cell):
    """Small chunks and cells part A ids by B ids, and give the same."""
    rows = [(k if k % 5 else None, t, "en") for k, t in enumerate(ODD)] + [(3, "the same text, again", "en")] * 4
    rows += [(100 + r.doc_id, r.text, "en") for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    p = paths()
    with open(p.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(p.path("piece_bpe_32k.model"), "rb") as g:
        a_json, model = f.read(), g.read()
    d = docs(spark, rows).withColumns({c: F.lit(1) for c in ("n_a", "chunk", "rows")}).repartition(3)
    got = alignment.aligned(d, a_json, model, p.PATTERN, chunk=chunk, cell=cell)
    assert Counter(map(tuple, got.collect())) == brute_alignment(rows)
    assert alignment.aligned(d.limit(0), a_json, model, p.PATTERN).count() == 0


def test_large_groups_count_distinct_ids(monkeypatch):
    """Groups over DENSE pairs go by distinct ids; so do all with DENSE at 0."""
    p = paths()
    with open(p.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(p.path("piece_bpe_32k.model"), "rb") as g:
        e = alignment.Encoders(f.read(), g.read(), p.PATTERN)
    texts = [t for t in ODD if t] + ["❤️" * 40 + " x"]
    want = e.align(texts)
    monkeypatch.setattr(alignment, "DENSE", 0)
    assert all(np.array_equal(x, y) for x, y in zip(want, e.align(texts), strict=True))


def test_cells_hold_what_they_may():
    loads = np.array([3, 0, 25, 4, 4, 4, 11, 1])
    c = alignment.Cells(loads, 10)
    held = Counter()
    for a, n in enumerate(loads):
        for b in range(n):
            held[int(c.of(np.array([a]), np.array([b]))[0])] += 1
    assert max(held.values()) <= 10 and set(held) <= set(range(c.number))


# packing


def brute_pieces(rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(paths().path("word_bpe_49k.json"))
    out = Counter()
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, lo in enumerate(range(0, len(ids), capacity)):
            part = ids[lo : lo + capacity]
            out[i, k, lo, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    return out


def vocabulary():
    with open(paths().path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pieces_are_the_librarys_and_sequences_are_full(spark, capacity):
    rows = [(k if k % 4 else None, t, "en") for k, t in enumerate(ODD)] + [(7, "repeated row", "en")] * 3
    rows += [(100 + r.doc_id, r.text, "en") for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    d = docs(spark, rows).withColumns({c: F.lit(1) for c in ("piece", "length", "offset", "open", "n")}).repartition(3)
    got = packing.pack(d, vocabulary(), capacity=capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pieces(rows, capacity)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [0, *itertools.accumulate(n for _, n in x)][:-1] and sum(n for _, n in x) <= capacity
    assert len(by) <= -(-sum(r.length for r in got) // capacity) + 1
    assert packing.pack(d.limit(0), vocabulary()).count() == 0


def test_every_character_is_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(paths().path("word_bpe_49k.json"))
    rng = random.Random(4)
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"{c} a{c} {c}b x{c}y {c}." for c in chars] + ["".join(rng.choice(chars) for _ in range(60)) for _ in range(300)]
    m = packing.memo(vocabulary())
    for got, text in zip(m.encode(texts), texts, strict=True):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids, ascii(text)


def least_bins(lengths, capacity):
    """By search over all ways: the fewest bins."""
    best = len(lengths)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + rest[0] <= capacity and bins[k] not in bins[:k]:
                go(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]])
        go(rest[1:], [*bins, rest[0]])

    go(sorted(lengths, reverse=True), [])
    return best


def test_search_keeps_items_and_comes_close_to_the_fewest_bins():
    rng = random.Random(5)
    extra = 0
    for _ in range(60):
        n = [rng.randint(10, 60) for _ in range(12)]
        x = np.array(n)
        first = packing.best_fit(x, 100)
        bins = packing.search(first, x, 100)
        assert sorted(k for b in bins for k in b) == list(range(12)) and all(x[b].sum() <= 100 for b in bins)
        assert len(bins) <= len(first)
        extra += len(bins) - least_bins(n, 100)
    assert extra <= 6


def test_search_empties_a_bin_by_exchanges():
    """Best fit leaves three bins; only one for one and two for one make two of them."""
    x = np.array([60, 40, 55, 45])
    assert len(packing.search([[0], [1, 2], [3]], x, 100)) == 2
    x = np.array([50, 30, 30, 20, 40, 30])
    assert len(packing.search([[0, 2], [1, 3, 4], [5]], x, 100)) == 2


def test_rounds_go_on_with_what_chunks_leave(spark):
    rng = random.Random(6)
    rows = [(k, 0, 0, rng.randint(1, 400), k) for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(12)
    got = packing.packed(d, capacity=1000, chunk=200, keep=8).collect()
    assert sorted(p.doc_id for r in got for p in r.pieces) == list(range(3000)) and len({r.sequence_id for r in got}) == len(got)
    assert len(got) <= -(-sum(r[3] for r in rows) // 1000) + 1


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_alignment", "op13_best_fit"])
def test_registered_queries(spark, name):
    got = registry.queries()[name](spark, SF)
    d = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    if name == "op11_filter_audit":
        labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
        assert Counter(map(tuple, got.collect())) == brute_audit(d, labels)
    elif name == "op12_alignment":
        assert Counter(map(tuple, got.collect())) == brute_alignment(d)
    else:
        assert Counter(tuple(r)[:5] for r in got.collect()) == brute_pieces(d, 4096)


def test_clean_removes_what_was_written(spark, tmp_path, monkeypatch):
    import os

    from sitegrid.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    assert common.written(spark.range(3).toDF("x"), "some").count() == 3 and os.listdir(f"{tmp_path}/{spark.sparkContext.applicationId}")
    common.clean(spark)
    assert not os.path.exists(f"{tmp_path}/{spark.sparkContext.applicationId}")
