"""Column functions: hashes, signal arithmetic, sequence letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC letters and the bases that each stands for; complements. Fixed values.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "[AG]", "Y": "[CT]", "S": "[CG]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}
COMPLEMENT = ("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")


def iupac_regex(motif: str) -> str:
    return "".join(IUPAC[c] for c in motif.upper())


def iupac_regex_col(motif: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    return F.array_join(F.transform(F.split(F.upper(motif), ""), lambda c: table[c]), "")


def revcomp_str(s: str) -> str:
    return s.upper().translate(str.maketrans(*COMPLEMENT))[::-1]


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), *COMPLEMENT))


def hash_key(seed: int | str, *cols: Column | str) -> Column:
    """A stable hash order: 32 hex letters, which compare as the number they spell."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in cols]))


def read_rank(read_id: Column, seed: int, algo: str = "md5") -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), read_id.cast("string"))
    return F.md5(text) if algo == "md5" else F.sha2(text, 256)


def hash_fraction(*cols: Column | str, seed: int = 0) -> Column:
    """In [0, 1]: CRC-32 of the joined values over its largest value."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    return F.crc32(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary")) / F.lit(4294967295.0)


def stable_seed(name: Column) -> Column:
    """First 32 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(name.cast("string"), 256), 1, 8), 16, 10).cast("long")


def unit_hash(seed: int, *cols: Column | str) -> Column:
    """A uniform number in (0, 1) from the first 13 hex letters of hash_key."""
    return (F.conv(F.substring(hash_key(seed, *cols), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def zscore(a: Column) -> Column:
    """(x - mean) / population sd; a flat signal is all zero."""
    return F.transform(F.array(F.struct(a.alias("a"), mean(a).alias("m"))), lambda s: F.transform(F.array(F.struct(s["a"].alias("a"), s["m"].alias("m"), F.sqrt(mean(F.transform(s["a"], lambda x: (x - s["m"]) * (x - s["m"])))).alias("d"))), lambda t: F.transform(t["a"], lambda x: F.when(t["d"] > 0, (x - t["m"]) / t["d"]).otherwise(0.0)))[0])[0]


def mad_normalize(a: Column) -> Column:
    """(x - median) / (1.4826 * median absolute deviation); a flat signal is only centred."""
    return F.transform(F.array(F.struct(a.alias("a"), median(a).alias("m"))), lambda s: F.transform(F.array(F.struct(s["a"].alias("a"), s["m"].alias("m"), (1.4826 * median(F.transform(s["a"], lambda x: F.abs(x - s["m"])))).alias("d"))), lambda t: F.transform(t["a"], lambda x: F.when(t["d"] > 0, (x - t["m"]) / t["d"]).otherwise(x - t["m"])))[0])[0]


def resample(a: Column, n: int) -> Column:
    """n points at even steps from first to last value, linear between values."""
    last = F.size(a) - 1

    def at(i: Column) -> Column:
        x = i * last / F.lit(max(1, n - 1))
        lo = F.least(F.floor(x), last).cast("int")
        hi = F.least(lo + 1, last)
        return F.get(a, lo) + (x - lo) * (F.get(a, hi) - F.get(a, lo))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def onehot(seq: Column, letters: str = "ACGT") -> Column:
    return F.flatten(F.transform(F.split(seq, ""), lambda b: F.array(*[(b == x).cast("int") for x in letters])))


def base_of_onehot(block: Column, letters: str = "ACGT", least: float = 0.5) -> Column:
    best = F.array_max(block)
    return F.when(best >= least, F.get(F.array(*[F.lit(x) for x in letters]), (F.array_position(block, best) - 1).cast("int"))).otherwise("N")


def to_probability(x: Column) -> Column:
    """Values outside [0, 1] are taken for logits."""
    return F.when((x >= 0) & (x <= 1), x).otherwise(1 / (1 + F.exp(-x)))


def code_sum(*codes: Column) -> Column:
    return F.least(F.lit(1.0), sum((F.coalesce(c, F.lit(0.0)) for c in codes), F.lit(0.0)))


def parse_member(member: Column) -> Column:
    """organism::dataset|strand as a struct."""
    head = F.split(member, r"\|")
    return F.struct(F.split(head[0], "::")[0].alias("organism"), F.split(head[0], "::")[1].alias("dataset"), F.get(head, 1).alias("strand"))


def read_channels(dwell: Column, mapq: Column, base: Column, ref: Column) -> Column:
    return F.struct(F.log1p(dwell).alias("log_dwell"), (F.least(mapq, F.lit(60)) / 60).alias("mapq"), (base == ref).cast("int").alias("matches"))


def mirror(columns: Column) -> Column:
    """Reverses an image's columns (array of structs base, value) and complements their bases."""
    return F.reverse(F.transform(columns, lambda c: F.struct(F.translate(c["base"], *COMPLEMENT).alias("base"), c["value"].alias("value"))))


def delta_channels(observed: Column, expected: Column, half_window: int) -> Column:
    """Difference to the expected level at the centre, and its mean over the window."""
    d = F.zip_with(observed, expected, lambda o, e: o - e)
    return F.struct(F.get(d, F.lit(half_window)).alias("center_delta"), mean(d).alias("window_delta"))


def mask_bases(bases: Column, half_window: int, flank_only: bool) -> Column:
    return F.transform(bases, lambda b, i: F.when((i == half_window) & F.lit(flank_only), b).otherwise(F.lit("N")))


def parse_bases(text: str) -> list[str]:
    """Free-form lists of bases: AC, A,C or a c."""
    return sorted({c for c in text.upper() if c in "ACGTN"})


def signal_clip(x: str) -> tuple[Column, Column]:
    """Aggregates: 2nd and 98th percentile, at least one apart."""
    lo, hi = F.percentile(x, 0.02), F.percentile(x, 0.98)
    return lo, F.greatest(hi, lo + 1)
