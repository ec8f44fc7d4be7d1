"""Registry of queries with their SQL, and how the operators' inputs are bound to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


#: Rows of one task where nearly every row is a group of its own.
ROWS = 250_000


def dealt(s: SparkSession, df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about `rows` rows, shuffled once by keys into parts of a fixed size: what groups or joins by these keys and others
    needs no further shuffle, and no task's table of groups grows with the input."""
    return df.repartition(max(s.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)


CALLS = "calls AS (SELECT l_orderkey AS read_id, l_suppkey AS contig, l_partkey AS pos, CASE WHEN l_linestatus='O' THEN '+' ELSE '-' END AS strand, l_discount*10 AS prob, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS label FROM lineitem)"
ONE = "one AS (SELECT read_id, contig, pos, strand, max(prob) AS p, max(label) AS label FROM calls GROUP BY ALL)"
SCORES = f"{CALLS}, {ONE}, scores AS (SELECT contig, pos, strand, count(*) AS n_called, sum(p) AS sum_p, count(*) FILTER (p > 0.5) AS n_mod, max(label) AS label, round(sum(p) / 20, 6) AS score FROM one GROUP BY ALL)"
ALN = "aln AS (SELECT o_orderkey AS read_id, o_custkey % 25 AS contig, (o_orderkey * 37) % 10000 AS \"start\", (o_orderkey * 37) % 10000 + 50 + o_orderkey % 200 AS \"end\", o_orderkey % 61 AS mapq, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE o_orderkey % 9 WHEN 0 THEN 4 WHEN 1 THEN 256 WHEN 2 THEN 2048 ELSE 16 * (o_orderkey % 2) END AS flag, round(o_totalprice / 10000, 3) AS qs FROM orders)"
IV = "iv AS (SELECT p_partkey % 25 AS contig, p_size * 150 AS \"start\", p_size * 150 + 60 AS \"end\", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)"
SITES = "sites AS (SELECT DISTINCT l_suppkey % 25 AS contig, (l_partkey * 13) % 10000 AS pos, CASE WHEN l_linestatus='O' THEN '+' ELSE '-' END AS strand FROM lineitem)"
SEQS = "seqs AS (SELECT doc_id AS contig, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
TRACK = "track AS (SELECT user_id % 10 AS contig, epoch_us(ts) // 60000000 AS pos, event_type AS model, value / 500 AS score FROM events)"
METHYL = "methyl AS (SELECT l_suppkey AS contig, l_partkey AS pos, CAST(sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0 END) AS BIGINT) AS n_meth, CAST(sum(CASE WHEN l_returnflag='R' THEN 0 ELSE l_quantity END) AS BIGINT) AS n_unmeth FROM lineitem GROUP BY ALL), frac AS (SELECT contig, pos, n_meth + n_unmeth AS cov, n_meth / (n_meth + n_unmeth) AS frac FROM methyl)"


def calls(s, d) -> DataFrame:
    return t(s, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), (F.col("l_discount") * 10).alias("prob"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


def scores(s, d) -> DataFrame:
    c = dealt(s, calls(s, d), t(s, d, "lineitem").count(), "contig", "pos")  # counted from the files' footers
    one = c.groupBy("read_id", "contig", "pos", "strand").agg(F.max("prob").alias("p"), F.max("label").alias("label"))
    return one.groupBy("contig", "pos", "strand").agg(F.count("*").alias("n_called"), F.sum("p").alias("sum_p"), F.count_if(F.col("p") > 0.5).alias("n_mod"), F.max("label").alias("label")).withColumn("score", F.round(F.col("sum_p") / 20, 6))


def aln(s, d) -> DataFrame:
    o = F.col("o_orderkey")
    start = (o * 37) % 10000
    m = o % 9
    return t(s, d, "orders").select(o.alias("read_id"), (F.col("o_custkey") % 25).alias("contig"), start.alias("start"), (start + 50 + o % 200).alias("end"), (o % 61).alias("mapq"), F.when(o % 2 == 0, "+").otherwise("-").alias("strand"), F.when(m == 0, 4).when(m == 1, 256).when(m == 2, 2048).otherwise((16 * (o % 2)).cast("int")).alias("flag"), F.round(F.col("o_totalprice") / 10000, 3).alias("qs"))


def intervals(s, d) -> DataFrame:
    p = F.col("p_size") * 150
    return t(s, d, "part").select((F.col("p_partkey") % 25).alias("contig"), p.cast("long").alias("start"), (p + 60).cast("long").alias("end"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"))


def sites(s, d) -> DataFrame:
    return t(s, d, "lineitem").select((F.col("l_suppkey") % 25).alias("contig"), ((F.col("l_partkey") * 13) % 10000).alias("pos"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand")).distinct()


def seqs(s, d) -> DataFrame:
    return t(s, d, "documents").select(F.col("doc_id").alias("contig"), F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("seq"))


def track(s, d) -> DataFrame:
    return t(s, d, "events").select((F.col("user_id") % 10).alias("contig"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).alias("pos"), F.col("event_type").alias("model"), (F.col("value") / 500).alias("score"))


def methyl(s, d) -> DataFrame:
    r = F.col("l_returnflag") == "R"
    m = t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos")).agg(F.sum(F.when(r, F.col("l_quantity")).otherwise(0)).cast("long").alias("n_meth"), F.sum(F.when(r, 0).otherwise(F.col("l_quantity"))).cast("long").alias("n_unmeth"))
    return m.withColumn("cov", F.col("n_meth") + F.col("n_unmeth")).withColumn("frac", F.col("n_meth") / F.col("cov"))
