"""A corpus made ready for training: five stages, each on all that the one before it kept.

STAGES names them in order. Each takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import importance, mixing, pii, sentencepiece_bpe, simhash
from credence.llm.common import materialise
from credence.llm.registry import table, tokenizer


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with columns c0, c1 and so on, and a number for each row, the same whenever they are read."""
    return materialise(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the importance resampling keeps; it decides by doc_id and text, so rows that are equal in both share a verdict.

    A null text counts as empty and has weight 0, a null doc_id is a key like any other; rows
    that tie with the last one kept are kept too; an empty table gives an empty one.
    """
    key, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("print", F.sha2(F.coalesce(text, F.lit("")), 256))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", key)
    found = importance.resample(rows, labels, text, key, row="print").where("kept")
    kept = found.select(F.col(key).alias("_key"), F.col("print").alias("_print")).distinct()
    met = (F.col("print") == F.col("_print")) & F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(kept, met, "left_semi").drop("print").toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more): the one with the smallest doc_id.

    Repeated rows are one group and leave one row; of equal ids the row read first stays, and a
    null doc_id only where no other is in the group; null, empty and wordless texts are one group;
    an empty table gives an empty one.
    """
    rows = _numbered(docs)
    key, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    found = simhash.similar_texts(rows, text, "row").join(rows.select("row", key), "row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col(key).isNull(), key, "row"))["row"].alias("row"))
    return rows.join(first, "row", "left_semi").drop("row").toDF(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced with its kind in brackets.

    A null text stays null and an empty one empty; equal texts get equal ones; repeated rows stay.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its shards, cut where its blocks end.

    Texts without words, null ones among them, are taken no words and have no row; a null source is
    the last one; repeated rows count each; an empty table gives an empty one.
    """
    out = mixing.mixed_rows(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, with their number, their digest and that of the text they decode to.

    A null text counts as empty, which has the end id alone; repeated rows stay.
    """
    return sentencepiece_bpe.round_trip(docs, tokenizer("piece_bpe_32k.model"), with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", private), ("mixing", mixture), ("tokens", tokens)]

#: The stages' models, fingerprints and tokens are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
