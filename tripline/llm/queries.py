"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm import (
    bpe,
    exact_topk,
    hardneg,
    hnsw,
    jaccard,
    langid,
    mixing,
    neardup,
    pii,
    quality,
    spelling,
    textscore,
    tokenfile,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)``; ``sql`` is its equivalent, if any."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_source_mix", mixing.SQL)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query("op4_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    decoded = bpe.decode(encoded, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.new_folder(spark)
    tokenfile.write(table(spark, sf_dir, "documents"), folder, vocabulary())
    rows = tokenfile.read(spark, folder).join(F.broadcast(tokenfile.shard_starts(spark, folder)), "shard")
    return rows.select(
        "doc_id",
        (F.col("shard_start") + F.col("in_shard")).alias("start"),
        "n_tokens",
        F.crc32("ids").alias("ids_crc32"),
    )


def learnable(docs: DataFrame, divisor: int, kept_out: int) -> DataFrame:
    return docs.where(textscore.remainder(F.col("doc_id"), divisor) != kept_out)


def _held_out(divisor: int, remainder: int):
    return F.coalesce(textscore.remainder(F.col("doc_id"), divisor) == remainder, F.lit(False))


@query("op1_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(learnable(docs, 5, 0), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, machine, keep_text=False)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


@query("op7_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(learnable(docs, 4, 2))
    out = langid.predict(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score", "accepted")


@query("op9_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(learnable(docs, 4, 2), table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep_text=False)
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


@query("op6_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_all(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op3_nearest_vectors")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op10_exact_top_k", exact_topk.SQL)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_jaccard_join", jaccard.SQL)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_hard_negatives", hardneg.SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
