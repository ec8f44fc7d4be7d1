"""Pileup records: segments of reads at candidate sites, cut, normalised, resampled and stacked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitegrid.operators import ranges, reads

MANY = 4_096  # sites of a batch, some more


def segments(aln: DataFrame, peaks: DataFrame, signal: DataFrame) -> DataFrame:
    """Reads that have all of alignment, borders and signal."""
    return aln.join(peaks, "read_id").join(signal, "read_id")


def cut(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """n points of each segment [lo, hi), from its first to its last sample, linear between samples."""
    last = hi - lo - 1
    at = np.arange(n) * (last / max(1, n - 1))[:, None]
    at[:, n - 1 :] = last[:, None] if n > 1 else 0
    i = np.minimum(at.astype(np.int64), last[:, None])
    here, after = x[lo[:, None] + i], x[lo[:, None] + np.minimum(i + 1, last[:, None])]
    return (after - here) * (at - i) + here


def normalised(signal: np.ndarray, norm: str) -> np.ndarray:
    if norm == "zscore":
        d = signal.std()
        return (signal - signal.mean()) / d if d > 0 else signal - signal.mean()
    if norm == "mad":
        m = np.median(signal)
        d = 1.4826 * np.median(np.abs(signal - m))
        return (signal - m) / d if d > 0 else signal - m
    return signal


def cut_signal(segs: DataFrame, asked: str, half_window: int, n: int, norm: str = "mad") -> DataFrame:
    """segs (read_id, contig, start, strand, mapq, hp, peaks, signal, asked: the sites contig, pos, strand, image_idx): one row for
    each asked site of the alignment's contig and strand, with a cell for each base around it that has samples: pos, samples (n
    points), dwell. Reads stream through in Arrow batches, and a read's row has all it needs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = np.arange(-half_window, half_window + 1)
        for batch in it:
            lists, col = batch.column(asked), {c: batch.column(c) for c in ("contig", "strand", "read_id", "mapq", "hp")}
            reader = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            sites = lists.flatten()
            own = pc.and_(*(pc.equal(sites.field(c), col[c].take(pa.array(reader))) for c in ("contig", "strand")))
            sites, reader = sites.filter(own), reader[np.asarray(pc.fill_null(own, False))]
            first, where = np.searchsorted(reader, np.arange(len(batch) + 1)), sites.field("pos").to_numpy()
            start, plus = (batch.column(c).to_pylist() for c in ("start", "strand"))
            kept, cells, wait = [], [], 0

            def sent() -> pa.RecordBatch:
                rows, at = np.concatenate([k for k, _ in kept]), [np.concatenate([c[j] for c in cells]) for j in range(3)]
                points = pa.ListArray.from_arrays(pa.array(np.arange(len(at[0]) + 1) * n, pa.int32()), pa.array(at[1].ravel()))
                made = pa.StructArray.from_arrays([pa.array(at[0]), points, pa.array(at[2])], names=["pos", "samples", "dwell"])
                ends = np.concatenate([[0], np.cumsum(np.concatenate([k for _, k in kept]))])
                who = pa.array(reader[rows])
                return pa.RecordBatch.from_arrays([*(sites.field(c).take(pa.array(rows)) for c in ("contig", "pos", "strand", "image_idx")), *(col[c].take(who) for c in ("read_id", "mapq", "hp")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)], names=names)

            for r in range(len(batch)):
                if first[r] == first[r + 1]:
                    continue
                x = normalised(batch.column("signal").slice(r, 1).flatten().to_numpy(zero_copy_only=False).astype(float), norm)
                p = batch.column("peaks").slice(r, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                for lo in range(first[r], first[r + 1], MANY):
                    hi = min(lo + MANY, int(first[r + 1]))
                    pos = where[lo:hi, None] + around
                    i = pos - start[r] if plus[r] == "+" else len(p) - 2 - (pos - start[r])
                    ok = (i >= 0) & (i < len(p) - 1)
                    i = np.where(ok, i, 0)
                    if len(p) < 2:
                        continue
                    ok &= (p[i] >= 0) & (p[i] < p[i + 1]) & (p[i + 1] <= len(x))
                    some, i = np.flatnonzero(ok.any(1)), i[ok]
                    if len(some):
                        kept.append((some + lo, ok.sum(1)[some]))
                        cells.append((pos[ok], cut(x, p[i], p[i + 1], n), p[i + 1] - p[i]))
                        wait += len(some)
                    if wait >= MANY:
                        yield sent()
                        kept, cells, wait = [], [], 0
            if wait:
                yield sent()

    names = ["contig", "pos", "strand", "image_idx", "read_id", "mapq", "hp", "cells"]
    d = segs.select("read_id", "contig", "strand", F.col("start").cast("long").alias("start"), "mapq", "hp", F.col("peaks").cast("array<bigint>").alias("peaks"), F.col("signal").cast("array<double>").alias("signal"), asked)
    one = d.schema[asked].dataType.elementType
    kind = StructType([*(one[c] for c in names[:4]), *(d.schema[c] for c in names[4:7]), *StructType.fromDDL("cells array<struct<pos:long,samples:array<double>,dwell:long>>").fields])
    return d.mapInArrow(run, kind)


def build_pileups(aln: DataFrame, peaks: DataFrame, signal: DataFrame, sites: DataFrame, half_window: int = 1, n: int = 5, max_reads: int = 30, max_images: int = 4, min_reads: int = 1, exclude: DataFrame | None = None, seed: int = 0, norm: str = "mad") -> DataFrame:
    """contig, pos, strand, image_idx, n_reads, rows: for each candidate site images of up to max_reads reads, each row the
    samples of the bases around the site.

    Candidates and exclusions come first; each site's reads are chosen by pieces of their spans (reads.select_covering) and dealt into
    images before any signal moves. A signal is shuffled once to all sites that ask for it, finished rows once to their image.
    """
    a = reads.primary(aln)
    if exclude is not None:
        a = ranges.drop_overlapping(a, exclude)
    a = a.join(peaks.select("read_id"), "read_id", "left_semi").join(signal.select("read_id"), "read_id", "left_semi")
    site = ["contig", "pos", "strand"]
    img = reads.partition_covering(a, sites, max_reads, max_images, seed)
    asked = img.groupBy("read_id").agg(F.collect_list(F.struct("contig", F.col("pos").cast("long").alias("pos"), "strand", "image_idx")).alias("asked"))  # of one read
    row = cut_signal(segments(a, peaks, signal).join(asked, "read_id"), "asked", half_window, n, norm)
    image = ["contig", "pos", "strand", "image_idx"]
    row = row.repartition(*image).groupBy(*image, "read_id").agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"), F.max("mapq").alias("mapq"), F.max("hp").alias("hp"))  # once, though a read have several alignments
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("hp", F.lit(1 << 30)).alias("hp"), "read_id", "mapq", "cells")))
    made = row.groupBy(*image).agg(F.count("*").alias("n_reads"), rows.alias("rows"))  # max_reads at most
    return made.where(F.col("n_reads") >= min_reads)


def score_images(images: DataFrame, predictor, column: str, out: str = "score") -> DataFrame:
    """Any model over batches of images: predictor takes a 2-D array and gives a score for each row."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(predictor(np.stack(x.to_numpy()).astype(float)), dtype=float)

    return images.withColumn(out, run(F.col(column)))
