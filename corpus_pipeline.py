"""Corpus pipeline: from raw documents to tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents; the
last returns token digests. run() applies them in order, each written as Parquet and read again.

- toxicity drops documents scored 0.5 or more; learned from labels, held-out rows left out. Null and empty texts score by
  the base rate and stay; each of several rows with one id is scored by itself.
- language drops documents without a language (`und`: null texts and those without a letter) and fills in a missing lang.
- near_dedup keeps the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more); of rows that
  have both id and text in common one stays; documents without an id stay, as do those without a word.
- decontaminate drops documents of whose words at least a twentieth lie in windows of the benchmark; documents without a
  word stay, with an empty benchmark all do.
- byte_bpe encodes and decodes what is left, row by row.

Further columns stay, whatever their names, up to the last stage. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.llm import byte_bpe, decontaminate, language, near_dedup, toxicity
from sitegrid.llm.common import fresh, table, written

SHINGLE, PERCENT = 5, 80

#: Stages two to five learn, group and fold; SQL can't express them.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, c = toxicity.trained(spark, sf_dir, docs), fresh(docs, "score")
    return docs.withColumn(c, toxicity.score(spark, model, F.col("text"))).where(F.col(c) < 0.5).drop(c)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    c = fresh(docs, "found")
    found = docs.withColumn(c, language.predict(spark, language.trained(docs), F.col("text")))
    kept = found.where(F.col(f"{c}.lang_pred") != language.UND)
    return kept.withColumn("lang", F.coalesce("lang", f"{c}.lang_pred")).drop(c)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_duplicates(docs, size=SHINGLE, percent=PERCENT)
    stay = groups.where("i = comp").select(F.col("i").alias("doc_id")).distinct()
    one = docs.where("doc_id IS NOT NULL").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    c = fresh(docs, "hits")
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), out=c)
    return found.where(~decontaminate.contaminated(c)).drop(c)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return byte_bpe.digests(docs, F.col("text"), byte_bpe.vocabulary(p.path("byte_bpe_50k.tiktoken")), p.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
