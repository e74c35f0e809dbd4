"""From raw documents to token ids: quality, near copies, personal data, mixture, encoding.

Each stage takes what the one before it kept and returns the columns of ``documents``; the
last returns token ids and the text they stand for.  Between stages the rows are written
as Parquet, so a stage that is lost is made again from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm import bpe, mixing, neardup, pii, quality
from tripline.llm.queries import learnable, vocabulary
from tripline.session import materialize


#: Parts that an encoding task keeps: fewer than by itself, as executors have run other stages before.
CACHED = 60_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score passes; the model is learned as for the query of that operator."""
    model = quality.train(learnable(docs, 4, 2), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), and all that have none."""
    return neardup.deduplicate(docs, percent=80)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data, and terms that reveal it, replaced in the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; the one at the end of a quota in part."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and the text decoded from them."""
    rows = docs.select("doc_id", "lang", "source", "text")
    encoded = bpe.encode(rows, vocabulary(), keep_text=False, decoded_text="text", cached=CACHED)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_copies),
    ("PII", hide_personal_data),
    ("mixing sources", mix_sources),
    ("BPE", encode),
]

#: A learned classifier is no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
