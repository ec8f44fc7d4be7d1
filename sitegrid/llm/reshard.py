"""Sharding by minimum-cost flow: from old shard sizes and new capacities to the transfers that move the fewest bytes.

1. Rows get a size (UTF-8 bytes of the text plus 8). Sizes are summed by old shard; capacities of the new shards are
   equal shares unless given.
2. A minimum-cost flow (old shards to new ones; a byte that stays costs 0, one that moves costs 1) says how many bytes
   go from each old shard to each new one. It works on sums by shard alone.
3. Rows over EPS of a capacity are few (at most shards / EPS, whatever the input): they take their places one by one
   along that flow, largest first, each of several equal ones for itself. A second flow over what is left corrects for
   their lumps.
4. All other rows of an old shard stand in blocks (by hash); running sizes inside and across blocks are cut where the
   flow says. A shard is off its capacity by a few rows of at most EPS of it.

Law: `bytes`. Equal texts are a group of rows like any other: they may part, as sizes must be near equal whatever the
groups. Cases: null texts have size 8 and checksum 0; null old shards count as shard 0; repeated rows each take a slot;
an empty table gives no rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegrid.llm.common import table, written

EPS, MAX_BLOCKS, LEAST_BLOCK, FILE_ROWS = 0.005, 65_536, 256, 20_000


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes from i to j, by successive shortest paths; sums of supply and demand are equal. Sizes: shards by shards."""
    n, m = len(supply), len(demand)
    left, need, flow = list(supply), list(demand), defaultdict(int)
    while any(left):
        # Bellman-Ford from all sources with supply left; back along flow at the negative cost
        dist = {("s", i): 0 for i in range(n) if left[i]}
        came: dict = {}
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if ("s", i) in dist:
                    for j in range(m):
                        d = dist["s", i] + cost(i, j)
                        if d < dist.get(("t", j), float("inf")):
                            dist["t", j], came["t", j], changed = d, ("s", i), True
            for (i, j), f in flow.items():
                if f and ("t", j) in dist and dist["t", j] - cost(i, j) < dist.get(("s", i), float("inf")):
                    dist["s", i], came["s", i], changed = dist["t", j] - cost(i, j), ("t", j), True
        end = min((j for j in range(m) if need[j] and ("t", j) in dist), key=lambda j: (dist["t", j], j))
        path, at = [], ("t", end)
        while at in came:
            path.append((came[at], at))
            at = came[at]
        amount = min([left[at[1]], need[end], *(flow[b[1], a[1]] for a, b in path if a[0] == "t")])
        for a, b in path:
            if a[0] == "s":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[at[1]] -= amount
        need[end] -= amount
    return {k: f for k, f in flow.items() if f}


def shares(total: int, n: int, taken: list[int]) -> list[int]:
    """How total is spread over n shards that hold `taken` already so that they end as level as they can."""
    order = sorted(range(n), key=lambda j: (taken[j], j))
    out, use = [0] * n, n
    while use > 1 and taken[order[use - 1]] * use > total + sum(taken[j] for j in order[:use]):
        use -= 1  # this one is over the level already
    level, more = divmod(total + sum(taken[j] for j in order[:use]), use)
    for k, j in enumerate(order[:use]):
        out[j] = level + (k >= use - more) - taken[j]
    if min(out) < 0:  # by one, from the remainder
        for j in range(n):
            while out[j] < 0:
                out[max(range(n), key=lambda k: out[k])] -= 1
                out[j] += 1
    return out


def moved_less(i: int, j: int) -> int:
    return int(i != j)


def plan_large(large: list, sizes: dict[int, int], shards: int, eps_total: int) -> dict:
    """(id, crc, size, old, number among equals) -> shard, largest first, along the flow of all bytes."""
    supply = [sizes.get(i, 0) for i in range(shards)]
    flow = defaultdict(int, min_cost_flow(supply, shares(eps_total, shards, [0] * shards), moved_less))
    room, out = shares(eps_total, shards, [0] * shards), {}
    for key, size, old in sorted(large, key=lambda x: (-x[1], str(x[0]))):
        to = max(range(shards), key=lambda j: (min(room[j], flow[old, j]) >= size, min(room[j], size) if flow[old, j] else 0, room[j], j == old))
        out[key] = to
        room[to] -= size
        flow[old, to] = max(0, flow[old, to] - size)
    return out


def assign(rows: DataFrame, shards: int = 24, id_col: str = "doc_id", size_col: str = "size", crc_col: str = "text_crc32", old_col: str = "old_shard", eps: float = EPS) -> DataFrame:
    """rows (id, size, checksum, old shard) with shard and slot."""
    spark = rows.sparkSession
    r = rows.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("size"), F.col(crc_col).alias("crc"), F.coalesce(F.pmod(F.col(old_col).cast("int"), F.lit(shards)), F.lit(0)).alias("old"))
    by_old = {x.old: (x.b, x.n) for x in r.groupBy("old").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}  # a row for each shard
    total, count = sum(b for b, _ in by_old.values()), sum(n for _, n in by_old.values())
    is_big = F.col("size") > F.lit(int(eps * total / shards))
    equal = Window.partitionBy("id", "crc", "size", "old").orderBy("size")
    big = r.where(is_big).withColumn("same", F.row_number().over(equal))  # under shards / eps rows
    large = [((x.id, x.crc, x.size, x.old, x.same), x.size, x.old) for x in big.toLocalIterator()]
    placed = plan_large(large, {i: b for i, (b, _) in by_old.items()}, shards, total)
    taken, lumps = [0] * shards, [0] * shards
    for key, size, old in large:
        taken[placed[key]] += size
        lumps[old] += size
    supply = [by_old.get(i, (0, 0))[0] - lumps[i] for i in range(shards)]
    flow = min_cost_flow(supply, shares(sum(supply), shards, taken), moved_less)
    cuts: list[list[tuple[int, int]]] = []  # by old shard: up to which running size rows go where; what stays comes first
    for i in range(shards):
        cuts.append([])
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            at += flow[i, j]
            cuts[i].append((at, j))
        cuts[i] = [*cuts[i][:-1], (1 << 62, cuts[i][-1][1] if cuts[i] else i)]
    block_rows = max(LEAST_BLOCK, -(-count // MAX_BLOCKS))
    parts = F.array(*[F.lit(-(-by_old.get(i, (0, 0))[1] // block_rows) or 1) for i in range(shards)])
    h = F.xxhash64("id", "crc", "size")
    place = spark.createDataFrame([(*k, to) for k, to in placed.items()], f"id {r.schema['id'].dataType.simpleString()}, crc long, size long, old int, same int, to int")
    on = [F.col("a.id").eqNullSafe(F.col("p.id")), *(F.col(f"a.{c}") == F.col(f"p.{c}") for c in ("crc", "size", "old", "same"))]
    placed_rows = big.alias("a").join(F.broadcast(place).alias("p"), on).select("a.id", "a.size", "a.crc", "a.old", "to")
    blocks = r.where(~is_big).withColumn("to", F.lit(None).cast("int")).unionByName(placed_rows)
    blocks = blocks.withColumns({"h": h, "block": F.pmod(h, parts[F.col("old")]).cast("int")})
    blocks = blocks.withColumn("load", F.when(F.col("to").isNull(), F.col("size")).otherwise(0))
    inside = Window.partitionBy("old", "block").orderBy("h", "id", "crc", "size")
    run = blocks.withColumn("run", F.sum("load").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("load"))
    sums = blocks.groupBy("old", "block").agg(F.sum("load").alias("b"))  # at most MAX_BLOCKS and some rows
    before = sums.withColumn("before", F.sum("b").over(Window.partitionBy("old").orderBy("block")) - F.col("b")).drop("b")
    at = run.join(F.broadcast(before), ["old", "block"]).withColumn("at", F.col("run") + F.col("before") + F.floor(F.col("load") / 2))
    ways = F.array(*[F.array(*[F.struct(F.lit(hi).cast("long").alias("hi"), F.lit(j).alias("j")) for hi, j in c]) for c in cuts])
    got = at.withColumn("shard", F.coalesce("to", F.filter(ways[F.col("old")], lambda c: F.col("at") < c["hi"])[0]["j"]).cast("int"))
    w = Window.partitionBy("old", "block", "shard").orderBy("h", "id", "crc", "size")
    got = written(got.withColumn("rn", F.row_number().over(w)).select("id", "crc", "size", "old", "block", "shard", "rn"), "reshard")
    counts = got.groupBy("shard", "old", "block").agg(F.count("*").alias("n"))
    first = counts.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("old", "block")) - F.col("n")).drop("n")
    return got.join(first, ["shard", "old", "block"]).select(F.col("id").alias(id_col), F.col("size").alias(size_col), F.col("crc").alias(crc_col), "shard", (F.col("first") + F.col("rn") - 1).cast("long").alias("slot"), F.col("old").alias("old_shard"))


def text_rows(docs: DataFrame, old: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), old.alias("old_shard"))


def rewrite(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", old: Column | None = None) -> None:
    """Writes the shards that a transfer touches, one folder each; the files of all others stay as they are.

    A row meets its slot by id, size, checksum, old shard (where given; null is 0) and its number among rows equal in these,
    so that null and repeated ids keep each of their rows once. Without `old`, rows equal in the others must be equal as a whole."""
    touched = plan.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    cols = [F.col(c) for c in docs.columns]
    rows = docs.withColumns({"_id": F.col(id_col), "_old": F.lit(0) if old is None else F.coalesce(old.cast("int"), F.lit(0)), "_h": F.xxhash64(*cols)})
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = rows.withColumns({"_size": (F.octet_length(raw) + 8).cast("long"), "_crc": F.crc32(raw)})
    slots = plan.select(F.col(id_col).alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.lit(0).alias("_old") if old is None else F.col("old_shard").alias("_old"), "shard", "slot")
    key = ["_id", "_size", "_crc", "_old"]
    number = lambda d, *by: d.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    slots = number(slots, "shard", "slot").join(F.broadcast(touched), "shard", "left_semi")
    both = number(rows, "_h").alias("a").join(slots.alias("b"), F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._size") == F.col("b._size")) & (F.col("a._crc") == F.col("b._crc")) & (F.col("a._old") == F.col("b._old")) & (F.col("a._n") == F.col("b._n")))
    rows = both.select(*[F.col(f"a.{c}") for c in docs.columns], "shard", "slot").repartition("shard", F.floor(F.col("slot") / FILE_ROWS))
    rows.sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def op8_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = written(text_rows(docs, F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(24)).cast("int")), "sizes")
    return assign(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
