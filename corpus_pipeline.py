"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the next one's
``docs``. All but the last return the columns of ``documents``; columns beside those are carried along.

Defined results: rows with null or empty texts aren't toxic, are no copies, hold no passages and no personal data, so
they stay, with size 0 in the mix; of equal rows one stays; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, jaccard, mixing, pii, toxicity
from sluice.llm.shared import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject. One walk scores and filters, so no text is shuffled."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_ordinary(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest doc_id."""
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    found = jaccard.near_duplicates(rows.select(F.struct("doc_id", "_row").alias("key"), "text"), k=5, percent=80, key="key")
    first = F.struct(F.col("key.doc_id").isNull(), F.col("key.doc_id"), F.col("key._row"))
    kept = found.where("label is not null").groupBy("label").agg(F.min_by("key._row", first).alias("_row")).select("_row")
    kept = kept.union(found.where("label is null").select("key._row"))
    return rows.join(kept, "_row", "left_semi").drop("_row")


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, neither exact nor edited."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows the text."""
    found = pii.find_pii(docs)
    clean = found.withColumn("text", pii.redact(F.col("text"), F.array_sort(F.concat("base", "more")))).drop("base", "more")
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each, by target weights of their sources."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_leaked), ("pii", redact_pii), ("mixing", mix)]

#: The models and the signature trees aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
