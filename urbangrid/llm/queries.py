"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import fresh_path, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents")).drop("span_list", "text_key")


def op2_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram import score

    return score(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import compare

    return compare(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codec import digests

    return digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codec import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idfiles import read_ids, write_ids

    folder = fresh_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), folder)
    return read_ids(spark, folder, digest=True)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_ngram_scores, op3_embedding_near_dedup, op4_simhash_fingerprints, op5_minhash_near_dedup, op6_bpe_speculate_verify, op7_token_counts, op8_packing, op9_quality_classifier, op10_token_id_files, op11_importance_resampling, op12_conversation_repair, op13_sharding)}
ORACLES: dict[str, str] = {
    "op1_secret_scan": oracles.secrets_sql(),
    "op3_embedding_near_dedup": oracles.embeddings_sql(),
    "op5_minhash_near_dedup": oracles.near_duplicates_sql(),
    "op11_importance_resampling": oracles.resample_sql(),
    "op12_conversation_repair": oracles.repair_sql(),
}
