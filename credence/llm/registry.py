"""The queries of this subpackage by name, with production parameters, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import host_rules, importance, licences, mixing, pii, sentencepiece_bpe, simhash, token_binary, tree_forest, warc_fixity
from credence.llm.common import scratch_dir


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as Simple-8b files and read back: doc_id, start, n_tokens, ids_crc32."""
    files = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_binary.write_token_files(table(spark, sf_dir, "documents"), files, tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_binary.read_token_files(spark, files).withColumnRenamed("key", "doc_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate class: doc_id, fingerprint, component_id."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("draws")


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight and whether the resampling keeps it."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the rules' spans, and all spans."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op4_tree_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links and its near-duplicate class, within its label."""
    return tree_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on every document, and the verdict on it by its source's failures."""
    return host_rules.verdicts(table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest and the licence that it is the text of, if any."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of archives of all pages against a replica with damaged, lost and repeated records."""
    records = warc_fixity.records(table(spark, sf_dir, "pages"))
    return warc_fixity.audit(records, warc_fixity.harmed(records))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_host_rules": op3_host_rules,
    "op4_tree_forest": op4_tree_forest,
    "op5_simhash": op5_simhash,
    "op6_licences": op6_licences,
    "op7_mixing": op7_mixing,
    "op8_token_binary": op8_token_binary,
    "op9_importance": op9_importance,
    "op10_pii": op10_pii,
}
ORACLES: dict[str, str] = {
    "op2_warc_fixity": warc_fixity.ORACLE,
    "op3_host_rules": host_rules.ORACLE,
    "op4_tree_forest": tree_forest.ORACLE,
    "op6_licences": licences.ORACLE,
    "op7_mixing": mixing.ORACLE,
}
