"""A quality classifier by importance resampling.

Two generative models of hashed word n-grams are counted: one of the target (documents
labelled good, a bounded sample of the labelled rows) and one of the raw corpus (all
documents). The log importance weight of a document is the sum, over its uni- and
bigrams, of the log ratio of the two models. Gumbel noise makes the weights a sample
without replacement when the top k are taken; k is the number of documents whose weight
reaches the cut that best parts labelled good from labelled poor rows.

The top k is found by narrowing a histogram of the keys, so no order of all rows is
made and nothing that grows with the rows reaches the driver.

Defined results: rows that share a labelled key count once for the cut, with their mean
weight; null, empty and wordless texts have no n-grams and weight 0; equal
texts have equal weights, and noise of their own by key; rows that tie with the last
key taken are taken too; without labelled good rows all weights are 0, without labelled
poor ones, or with no good ones, all rows are kept; an empty table gives an empty one;
texts may have any length; other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import Cache, begin, bound_batches, materialise, raw_texts, worker_cache

#: Buckets of hashed n-grams, added counts, seed of the noise, most labelled rows, and how much more a lost good row costs.
BUCKETS, SMOOTHING, SEED, MOST_LABELLED, GOOD_COST = 1 << 14, 1.0, 5, 20_000, 5.0
CACHE_WORDS = 200_000
TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff]+")


@worker_cache
def _words() -> Cache:
    """The hashes of a word's tokens (letters and digits, or marks), 4 bytes each."""
    return Cache(lambda w: np.array([xxhash.xxh32_intdigest(t) for t in TOKEN.findall(w)], "<u4").tobytes(), CACHE_WORDS)


def buckets(raw: bytes, n: int = BUCKETS) -> np.ndarray:
    """The bucket of every uni- and bigram of a text's tokens."""
    known = _words()
    h = np.frombuffer(b"".join([known[w] for w in raw.split()]), "<u4").astype(np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return (np.concatenate([h, pairs]) % np.uint64(n)).astype(np.int64)


def fit(df: DataFrame, good: set, text: str = "text", key: str = "doc_id", n: int = BUCKETS) -> np.ndarray:
    """Log ratio of the target's and the corpus's smoothed share of each bucket; counts cover all rows."""

    def run(batches):
        begin("importance", _words)
        raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                seen = np.bincount(buckets(t, n), minlength=n)
                raw += seen
                if k in good:
                    target += seen
        there = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(raw[there]), pa.array(target[there])], ["bucket", "raw", "target"])

    bound_batches(df.sparkSession)
    counts = df.select(key, text).mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(n), np.zeros(n)
    for row in counts.collect():  # one row for each bucket at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(n)
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * n))
    return share(target) - share(raw)


def weigh(df: DataFrame, ratio: np.ndarray, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """(key, n_grams, log_weight) of every row, and the column ``row`` where one is named."""
    n = len(ratio)
    more = [row] if row else []

    def run(batches):
        begin("importance", _words)
        for batch in batches:
            found = [buckets(t, n) for t in raw_texts(batch.column(1))]
            counts = [pa.array([len(b) for b in found], pa.int64()), pa.array([float(ratio[b].sum()) for b in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *batch.columns[2:]], ["key", "n_grams", "log_weight", *more])

    bound_batches(df.sparkSession)
    schema = ", ".join([f"key {dict(df.dtypes)[key]}, n_grams long, log_weight double", *(f"{c} {dict(df.dtypes)[c]}" for c in more)])
    return df.select(key, text, *more).mapInArrow(run, schema).withColumnRenamed("key", key)


def best_cut(good: list[float], poor: list[float], cost: float = GOOD_COST) -> float:
    """The weight that parts good from poor rows at the least cost, half-way to the next row below."""
    if not good or not poor:
        return float("-inf")
    value = np.array(good + poor)
    loss = np.array([cost / len(good)] * len(good) + [-1.0 / len(poor)] * len(poor))
    order = np.argsort(value, kind="stable")
    value, loss = value[order], loss[order]
    # Cutting just above place i loses the good rows up to there and is rid of the poor ones.
    total = np.concatenate([[0.0], np.cumsum(loss)])
    real = np.concatenate([[True], value[1:] > value[:-1], [True]])
    i = int(np.flatnonzero(real)[np.argmin(total[real])])
    if i == 0:
        return float("-inf")
    return float(value[i - 1] + value[i]) / 2 if i < len(value) else float(np.nextafter(value[-1], np.inf))


def top_key(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 20_000) -> float:
    """The k-th largest value of a column: histograms of ``bins`` counts narrow it down to ``few`` rows."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0  # rows above ``high``
    while True:
        width = (high - low) / bins
        inside = df.where(F.col(column).between(low, high))
        if width <= 0 or low + width <= low:
            return high
        bin_ = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).alias("bin")
        counts = inside.groupBy(bin_).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for row in counts:
            if above + row["n"] >= k:
                break
            above += row["n"]
        if row["low"] == row["high"]:
            return row["low"]
        low, high = row["low"], row["high"]
        if row["n"] <= few:
            values = sorted((r[0] for r in df.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return values[k - above - 1]


def labelled_sample(labels: DataFrame, key: str = "doc_id", good: str = "quality", most: int = MOST_LABELLED) -> tuple[list, list]:
    """Keys of at most ``most`` labelled rows, as (good, poor), in a seeded order by key."""
    rows = labels.where(F.col(key).isNotNull() & F.col(good).isNotNull()).select(key, good).orderBy(F.xxhash64(key), key).limit(most).collect()
    return [r[key] for r in rows if r[good] == 1], [r[key] for r in rows if r[good] != 1]


def resample(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, buckets: int = BUCKETS, row: str | None = None) -> DataFrame:
    """(key, n_grams, log_weight, gumbel_key, kept) of every row, and the column ``row`` where one is named."""
    spark = df.sparkSession
    good, poor = labelled_sample(labels, key)
    ratio = fit(df, set(good), text, key, buckets)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + 0.5) / float(1 << 53)
    scored = weigh(df, ratio, text, key, row).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    scored = materialise(scored, "importance")
    known = spark.createDataFrame([(k, 1) for k in good] + [(k, 0) for k in poor], f"{key} {dict(df.dtypes)[key]}, good int")
    seen = scored.join(known, key).groupBy(key, "good").agg(F.avg("log_weight").alias("w")).collect()  # one row for each labelled key
    cut = best_cut([r["w"] for r in seen if r["good"]], [r["w"] for r in seen if not r["good"]])
    k = scored.where(F.col("log_weight") >= F.lit(cut)).count()
    if not k:
        return scored.withColumn("kept", F.lit(False))
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(top_key(scored, "gumbel_key", k)))
