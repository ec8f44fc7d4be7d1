"""Pools of images, tables of signals, chunked runs that are taken up again: files written and read back."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrid.sources import pool, runs, sinks


def images(spark, n, shape, member="m1", broken=0):
    size = 4 * shape[0] * shape[1] * shape[2]
    rows = [("c1", k, k % 2, 3, int(k % 3 == 0), *shape, bytearray(size - (k < broken)), member, "+" if k % 2 else "-") for k in range(n)]
    return spark.createDataFrame(rows, "contig string, pos long, image_idx int, n_reads long, label int, height int, width int, channels int, tensor binary, member string, strand string")


def test_a_pool_is_one_table_of_its_members(spark, tmp_path):
    for m, n in (("a", 6), ("b", 4)):
        sinks.write_images(images(spark, n, (2, 3, 9), m).withColumn("more", F.lit(1)), f"{tmp_path}/{m}")
    paths = {m: f"{tmp_path}/{m}" for m in ("a", "b")}
    p = pool.read_pool(spark, paths)
    assert [tuple(r) for r in p.members.orderBy("file").collect()] == [("a", 0, 6, 2), ("b", 1, 4, 2)]
    assert p.images.count() == 10 and "more" not in p.images.columns
    assert {r.source for r in pool.source_keys(p.images.where("pos = 1")).collect()} == {"a::c1::1", "b::c1::1"}
    one = pool.select(p, F.col("member") == "b")
    assert one.images.count() == 4 and one.images.inputFiles() and {r.member for r in one.members.collect()} == {"b"}
    plan = one.images._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1  # the other folder isn't read
    assert pool.read_pool(spark, paths, ["b"]).members.count() == 1


def test_members_of_other_shapes_are_named(spark, tmp_path):
    made = {"a": images(spark, 3, (2, 3, 9)), "b": images(spark, 3, (2, 4, 9)), "c": images(spark, 3, (2, 3, 9), broken=1), "d": images(spark, 3, (2, 3, 9)).drop("tensor")}
    for m, d in made.items():
        d.drop("member").write.parquet(f"{tmp_path}/{m}")
    paths = {m: f"{tmp_path}/{m}" for m in made}
    for members, word in ((["a", "b"], "b: 2x4x9"), (["b", "a"], "a: 2x3x9"), (["a", "c"], "c: broken"), (["a", "d"], "d lacks tensor"), (["a", "z"], "unknown members: z"), ([], "no members")):
        with pytest.raises(ValueError, match=word):
            pool.read_pool(spark, paths, members)
    assert pool.read_pool(spark, paths, ["a", "b"], check=False).images.count() == 6
    assert [tuple(r) for r in pool.shapes(pool.read_pool(spark, paths, ["c"], check=False).images).orderBy("shape").collect()] == [("c", "2x3x9", 2), ("c", "broken", 1)]


def test_signals(spark, tmp_path):
    spark.createDataFrame([("r1", [1.0, 2.0]), ("r2", [])], "read_id string, signal array<double>").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([("r3", [10, 20], 0.5, -4.0)], "read_id string, signal array<short>, scale double, offset double").write.parquet(f"{tmp_path}/b")
    spark.createDataFrame([("r1", [9.0])], "read_id string, signal array<double>").write.parquet(f"{tmp_path}/again")
    spark.createDataFrame([("r1", "x")], "read_id string, signal string").write.parquet(f"{tmp_path}/no")
    p = lambda *x: [f"{tmp_path}/{y}" for y in x]
    got = {r.read_id: r.signal for r in pool.read_signals(spark, p("a", "b")).collect()}
    assert got == {"r1": [1.0, 2.0], "r2": [], "r3": [3.0, 8.0]}
    assert [r.read_id for r in pool.read_signals(spark, p("a", "b"), spark.createDataFrame([("r3",)], "read_id string")).collect()] == ["r3"]
    with pytest.raises(Exception, match="two signals of read r1"):
        pool.read_signals(spark, p("a", "again")).collect()
    for wrong in (p("no"), []):
        with pytest.raises(ValueError):
            pool.read_signals(spark, wrong)


def text_of(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_a_run_that_dies_gives_the_same_file(spark, tmp_path):
    def make(c, calls, die=None):
        calls.append(c)
        if c == die:
            raise RuntimeError("killed")
        k = int(c[1:])
        return spark.createDataFrame([(f"chr{p % 2}", 100 * k + p, p / 7 if p else None) for p in range(30)][::-1], "contig string, pos long, score double").repartition(3)

    chunks = [f"c{k}" for k in range(4)]
    calls = []
    assert runs.run_chunks(spark, f"{tmp_path}/x", chunks, lambda c: make(c, calls), settings={"k": 1}) == chunks
    n = runs.merge_chunks(spark, f"{tmp_path}/x", chunks, ["contig", "pos", "score"], ["contig", "pos"], f"{tmp_path}/x.tsv", parts=5)
    lines = text_of(f"{tmp_path}/x.tsv").splitlines()
    assert n == 120 and lines[0] == "contig\tpos\tscore" and len(lines) == 121 and lines[1] == "chr0\t0\t"
    keys = [(int(x.split("\t")[1]) // 100, x.split("\t")[0], int(x.split("\t")[1])) for x in lines[1:]]
    assert keys == sorted(keys)

    calls = []
    with pytest.raises(RuntimeError):
        runs.run_chunks(spark, f"{tmp_path}/y", chunks, lambda c: make(c, calls, "c2"), settings={"k": 1})
    os.makedirs(f"{tmp_path}/y/c2/data", exist_ok=True)  # what a killed writer leaves
    with pytest.raises(ValueError, match="not done: c2, c3"):
        runs.read_chunks(spark, f"{tmp_path}/y", chunks)
    calls = []
    assert runs.run_chunks(spark, f"{tmp_path}/y", chunks, lambda c: make(c, calls), settings={"k": 1}) == ["c2", "c3"] == calls
    runs.merge_chunks(spark, f"{tmp_path}/y", chunks, ["contig", "pos", "score"], ["contig", "pos"], f"{tmp_path}/y.tsv", parts=5)
    assert text_of(f"{tmp_path}/y.tsv") == text_of(f"{tmp_path}/x.tsv")

    with pytest.raises(ValueError, match="other settings"):
        runs.run_chunks(spark, f"{tmp_path}/y", chunks, lambda c: make(c, []), settings={"k": 2})
    make("c1", []).limit(3).write.mode("overwrite").parquet(f"{tmp_path}/y/c1/data")  # content that isn't the mark's
    assert runs.done(spark, f"{tmp_path}/y", "c1") and not runs.done(spark, f"{tmp_path}/y", "c1", verify=True)
    assert runs.run_chunks(spark, f"{tmp_path}/y", chunks, lambda c: make(c, []), verify=True, settings={"k": 1}) == ["c1"]
    assert runs.read_chunks(spark, f"{tmp_path}/y", chunks).count() == 120


def test_float32_tensors_come_back(spark, tmp_path):
    x = np.arange(54, dtype="<f4")
    d = images(spark, 1, (2, 3, 9)).drop("tensor").withColumn("tensor", F.lit(bytearray(x.tobytes())))
    sinks.write_images(d, f"{tmp_path}/a")
    r = pool.read_pool(spark, {"a": f"{tmp_path}/a"}).images.first()
    assert np.frombuffer(r.tensor, "<f4").tolist() == x.tolist()
