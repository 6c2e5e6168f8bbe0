"""Exact similarity of texts that share a key: a Jaccard similarity of word shingles of a threshold or more.

Equal words meet by digest. ``simhash.similar_texts`` gives keys that similar texts share:
the class of their fingerprint, and bands of minima of their shingles under random
permutations. Texts that share a key are candidates, and only exact Jaccard similarity of
their shingles' 64-bit hashes links them. A pair at the threshold shares none of 40 bands
of 6 with probability (1 - 0.8^6)^40, or 5e-6; one of similarity 0.3 meets with 0.03.

A group's members are compared with one of them first, and what is linked by then closes
most groups. The others are compared in blocks: a task takes two parts of a group, counts
what their sets share by a matrix product, and gives links that connect them, not pairs.
The comparing grows with the square of a group's size, and its rows with that square over a
part's size, as each member goes to as many blocks as there are parts.

Defined results: null, empty and wordless texts are copies of each other; a text of fewer
words than a shingle has its whole sequence for one; texts may have any length; an empty
table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import begin, bound_batches, connected_components, materialise, raw_texts, release

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, MINIMA = 40, 6
#: Leaders that a group's members are compared with, and members of a part in the blocks.
ROUNDS, SMALL = 1, 512
#: Different shingles whose product is made at a time.
WIDE = 1 << 12
#: Shingles that are permuted at a time, and bits that mark candidates.
SLICE, MARKS = 1 << 10, 1 << 22


@functools.lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * MINIMA
    return rng.integers(0, 1 << 63, n, np.uint64)[:, None] * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)[:, None]


def shingles(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a sequence's shingles, in ascending order."""
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in parts), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A signed number for each band of a set's minima; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    times, plus = _permutations()
    least = np.full(len(times), np.uint64((1 << 64) - 1))
    for i in range(0, len(hashes), SLICE):
        least = np.minimum(least, ((hashes[None, i : i + SLICE] ^ plus) * times).min(axis=1))
    rows = least.astype("<u8").reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64).view(np.int64)


def _words(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # of bytes: A-Z alone are lowered, and white space is ASCII's


def sketches(df: DataFrame, text: str, key: str, simhash_of: Callable[[list[bytes], int], int], width: int = SHINGLE) -> DataFrame:
    """(node, digest, n, fp, bands) of every row: digest of its words; number, fingerprint and bands of its shingles."""

    def run(batches):
        begin("near_copies")
        for batch in batches:
            digest, n, prints, found = [], [], [], []
            for raw in raw_texts(batch.column(1)):
                words = _words(raw)
                hashes = shingles(words, width)
                digest.append(xxhash.xxh128_digest(b" ".join(words)))
                n.append(len(hashes))
                prints.append(simhash_of(words, width))
                found.append(bands(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(prints, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "digest", "n", "fp", "bands"])

    bound_batches(df.sparkSession)
    return df.select(F.col(key).cast("long"), text).mapInArrow(run, "node long, digest binary, n int, fp long, bands array<long>")


def marks(keys: DataFrame, bits: int = MARKS) -> np.ndarray:
    """A bit for each place that a key's hash meets; of bounded size whatever the keys."""
    place = F.pmod(F.xxhash64("node"), F.lit(bits))
    placed = keys.select(F.floor(place / 32).cast("int").alias("at"), (place % 32).cast("int").alias("bit"))
    words = placed.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word"))
    found = np.zeros(bits // 32, "<u4")
    for row in words.collect():  # one row for each word at most
        found[row["at"]] = row["word"]
    return np.unpackbits(found.view(np.uint8), bitorder="little").view(bool)


def shingle_sets(df: DataFrame, keys: DataFrame, text: str, key: str, width: int = SHINGLE) -> DataFrame:
    """(node, hashes) of every row among the keys (node), and of a few others; texts stay where they are."""
    marked = np.packbits(marks(keys))

    def run(batches):
        begin("near_copies")
        known = np.unpackbits(marked).view(bool)
        for batch in batches:
            some = batch.filter(pa.array(known[batch.column(2).to_numpy()]))
            found = [shingles(_words(raw), width).view(np.int64) for raw in raw_texts(some.column(1))]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "hashes"])

    bound_batches(df.sparkSession)
    number = F.col(key).cast("long")
    return df.select(number, text, F.pmod(F.xxhash64(number), F.lit(MARKS))).toDF("node", "text", "place").mapInArrow(run, "node long, hashes array<long>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as that."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("_a"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(one, "a").join(two, "b").where(both / (F.size("_a") + F.size("_b") - both) >= F.lit(similarity)).select("a", "b")


def open_groups(met: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(band, node, n, label) of the groups whose members are in several components yet; written."""
    placed = met.withColumn("label", F.col("node")) if roots is None else met.join(roots, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    several = placed.groupBy("band").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low != _high").select("band")
    return materialise(placed.join(several, "band"), "copies-open")


def led(still: DataFrame, turn: int) -> DataFrame:
    """Each member beside its group's leader, another one in each turn and the same in all groups that it leads."""
    leaders = still.groupBy("band").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node"), "node", "label", "n")).alias("_first"))
    return still.join(leaders.select("band", F.col("_first.node").alias("_node"), F.col("_first.label").alias("_label"), F.col("_first.n").alias("_n")), "band")


def alone(still: DataFrame) -> DataFrame:
    """The groups without those that have the same members as another one; told apart by number and two sums of hashes."""
    total = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")) for i in range(2)]
    kinds = still.groupBy("band").agg(F.count("*").alias("_size"), F.struct(*total).alias("_sums"))
    first = kinds.groupBy("_size", "_sums").agg(F.min("band").alias("band")).select("band", "_size")
    return still.join(first, "band")


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Numbers of elements that each of some sets shares with each of others."""
    rows = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    _, column, times = np.unique(np.concatenate([*one, *two]), return_inverse=True, return_counts=True)
    shared = times > 1
    place, several = np.cumsum(shared) - 1, shared[column]
    rows, column = rows[several], place[column[several]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for i in range(0, int(shared.sum()), WIDE):
        low, high = np.searchsorted(column, [i, i + WIDE])
        held = np.zeros((len(one) + len(two), WIDE), np.float32)
        held[rows[low:high], column[low:high] - i] = 1
        out += held[: len(one)] @ held[len(one) :].T
    return out


def least_reachable(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, itself linked, the smallest row reachable."""
    found = np.arange(len(near))
    while True:
        after = np.where(near, found, len(near)).min(axis=1)
        if (after == found).all():
            return found
        found = after


def in_blocks(still: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect the similar members of each group; a task compares two parts of a group at most.

    A part has about ``SMALL`` members, so a group of m gives m * m / SMALL rows to compare,
    and each comparison at most one link for each member.
    """
    parts = F.ceil(F.col("_size") / F.lit(SMALL)).cast("int")
    each = alone(still).withColumn("_parts", parts).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), "_parts").cast("int"))
    each = each.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    each = each.select("band", F.least("part", "_other").alias("one"), F.greatest("part", "_other").alias("two"), "part", "node", "label").join(sets, "node")

    def run(pdf):
        begin("near_copies")
        left, right = (pdf[pdf["part"] == pdf[side].iloc[0]] for side in ("one", "two"))
        a, b = ([np.asarray(x) for x in side["hashes"]] for side in (left, right))
        if pdf["label"].nunique() < 2 or not a or not b:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        both = overlaps(a, b)
        size = np.array([len(x) for x in a], np.float64)[:, None] + np.array([len(x) for x in b], np.float64)[None, :]
        near = both / (size - both) >= similarity
        node = np.concatenate([left["node"], right["node"]])
        square = np.eye(len(node), dtype=bool)
        square[: len(a), len(a) :] = near
        square[len(a) :, : len(a)] = near.T
        first = least_reachable(square)
        links = pd.DataFrame({"a": node, "b": node[first]}, dtype="int64")
        return links[links["a"] != links["b"]]

    return each.groupBy("band", "one", "two").applyInPandas(run, "a long, b long")


def linked(df: DataFrame, met: DataFrame, text: str, key: str, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame | None:
    """(node, component) of rows whose texts are similar to another's; ``met`` (band, node, n) has the keys that they share."""
    sets = materialise(shingle_sets(df, met.select("node"), text, key, width), "copies-sets")
    roots: DataFrame | None = None

    def unite(edges: DataFrame) -> None:
        nonlocal roots
        before = roots
        if before is not None:
            edges = edges.union(before.where("node != component").select("node", "component"))
        roots = materialise(connected_components(edges, "copies"), "copies-roots")
        if before is not None:
            release(before)

    for turn in range(ROUNDS + 1):
        still = open_groups(met, roots)
        if still.isEmpty():
            break
        if turn < ROUNDS:
            pairs = led(still, turn).where("label != _label").where(F.least("n", "_n") / F.greatest("n", "_n") >= F.lit(similarity))
            pairs = pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
            unite(similar(pairs, sets, similarity))
        else:
            unite(in_blocks(still, sets, similarity))
        release(still)
    release(met)
    release(sets)
    return roots
