"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in two bits or fewer have a middle within one bit of both.
So every distinct fingerprint emits itself and its 64 variants of one flipped bit, rows
are shuffled on the variants, and those that meet are compared. A variant has 65
fingerprints near it at most, so no group is large whatever the data; copies meet
before, as they share a fingerprint. In a variant's group all pairs are within two
bits, so the pairs of neighbours in ascending order connect what all pairs would.

Two bits of three words find equal texts and hardly any other copy: near copies of a
similarity of 0.8 differ in some ten bits, and balls of that radius can't be emitted.
``similar_texts``, which the pipeline uses, takes five words, and lets texts meet by their
fingerprint's class and by bands of minima of their shingles; it links only those whose
shingles are that similar.

Defined results: null, empty and wordless texts have fingerprint zero and link like any
other; a text of fewer words than a shingle has its whole sequence for one; texts may
have any length; rows with a key met before stay and get the same component; an empty
table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.llm import near_copies
from credence.llm.common import begin, bound_batches, connected_components, materialise, raw_texts, release

SHINGLE, SEED = 3, 42
#: Shingles whose bits are counted at a time.
SLICE = 1 << 15


def fingerprint(raw: bytes) -> int:
    """The 64-bit SimHash of a text's shingles of words, repeats included, as a signed number."""
    return fingerprint_of(raw.lower().split())  # of bytes: A-Z alone are lowered, and white space is ASCII's


def fingerprint_of(words: list[bytes], width: int = SHINGLE) -> int:
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    set_ = np.zeros(64, np.int64)
    for i in range(0, n, SLICE):
        some = h[i : i + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_ += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) of every row."""

    def run(batches):
        begin("simhash")
        for batch in batches:
            fp = [fingerprint(t) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["key", "fp"])

    bound_batches(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"key {dict(df.dtypes)[key]}, fp long").withColumnRenamed("key", key)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints two bits apart or fewer, enough of them to connect all that are."""
    masks = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]])
    near = prints.select("fp").distinct().select("fp", F.explode(masks).alias("mask"))
    near = near.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    met = near.withColumn("other", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    pairs = met.where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) of every row; component_id is the smallest key reachable by links."""
    prints = materialise(fingerprints(df, text, key), "simhash")
    roots = connected_components(links(prints), "simhash-links")
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(first, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(key, "fp", "component_id")


def similar_texts(df: DataFrame, text: str = "text", key: str = "row", width: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """(key, component_id) of every row; component_id is the smallest key reachable by similar texts.

    ``key`` is a whole number, another one for each row, and the same whenever ``df`` is read.
    """
    drawn = materialise(near_copies.sketches(df, text, key, fingerprint_of, width), "copies-sketches")
    heads = drawn.groupBy("digest").agg(F.min("node").alias("head"))
    nodes = materialise(drawn.join(heads.select(F.col("head").alias("node")), "node", "left_semi").where("n > 0").drop("digest"), "copies-nodes")
    classes = connected_components(links(nodes), "simhash-links").withColumnRenamed("node", "fp")
    by_print = nodes.join(classes, "fp", "left").select("node", "n", F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("band"))
    by_band = nodes.select("node", "n", F.explode("bands").alias("band"))
    met = by_band.unionByName(by_print)
    shared = met.groupBy("band").agg(F.min("node").alias("_low"), F.max("node").alias("_high")).where("_low != _high").select("band")
    met = materialise(met.join(shared, "band"), "copies-bands")
    roots = near_copies.linked(df, met, text, key, width, similarity)
    release(nodes)
    component = F.col("head") if roots is None else F.coalesce("component", "head")
    rooted = heads if roots is None else heads.join(roots.withColumnRenamed("node", "head"), "head", "left")
    rooted = rooted.select("digest", component.alias("component_id"))
    return drawn.join(rooted, "digest").select(F.col("node").alias(key), "component_id")
