"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. Each source's documents are laid end to end in a seeded order and cut
into blocks of equal length, the last one shorter; documents are cut where blocks end. A
pass draws blocks in a permuted order of its own (that of a seeded digest): the first
passes draw all of a source's blocks, the last one as many as its target still needs, the
last of them in part. The quotas of blocks of all sources together are split among the
output shards: at each node of a binary tree the left half's share of blocks is drawn
without replacement from what the node has (a multivariate hypergeometric draw), down to
single shards. So every shard has its exact number of blocks, and the sources' quotas
come out exactly over all shards. Each shard draws the next blocks of a source's permuted
order, and has exactly their words; a document is taken as often, and as far, as shards
draw blocks that hold it. Rows of a shard are shuffled by a seeded order of their own.

The driver holds a row for each source. It splits the top of the tree, until its nodes
have ``TOP_CELLS`` quotas; tasks split the rest, so neither shards nor blocks are limited.
A node of over ``MOST_DRAWN`` blocks, more than the generator draws from, is halved in
proportion instead of by drawing.

Defined results: null texts have size 0 and so has an empty one; they are taken 0 words;
a null source is a source of its own, the last one; sources without words have target 0;
repeated rows count each (they are counted before they are laid out, so they don't meet
in a task one by one); ties of the seeded order hold equal keys and texts; an empty table
gives an empty one; texts may have any length; other columns pass through ``mixed_rows``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from credence.llm.common import WORD, begin, bound_batches, buckets_of, exclusive_offsets, materialise, word_count

WEIGHTS, SHARE, CEILING, SEED = (5, 2, 1), 1.5, 2.0, 7
#: Words in a block and in a shard.
BLOCK_WORDS, SHARD_WORDS = 1 << 12, 1 << 18
#: Quotas above which the driver leaves the tree to tasks, and blocks up to which a node is split by drawing.
TOP_CELLS, MOST_DRAWN = 1 << 16, 10**9 - 1
#: Blocks of a source that one row stands for until they are spread out.
RUN = 1 << 12


def targets(sizes: list[int], weights: list[float], share: float = SHARE, ceiling: float = CEILING) -> list[float]:
    """Shares of ``share`` times all sizes by weight; none above ``ceiling`` times its size, the excess reshared."""
    size, weight = np.array(sizes, np.float64), np.array(weights, np.float64)
    if not len(size):
        return []
    cap, total = ceiling * size, share * size.sum()
    order = np.argsort(cap / weight, kind="stable")  # those that fill up first
    left = total - np.concatenate([[0.0], np.cumsum(cap[order])[:-1]])
    open_ = weight.sum() - np.concatenate([[0.0], np.cumsum(weight[order])[:-1]])
    full = np.zeros(len(size), bool)
    full[order] = left * weight[order] / open_ > cap[order]
    rest, weights_left = total - cap[full].sum(), weight[~full].sum()
    return [float(c) if f else float(rest * w / weights_left) for c, w, f in zip(cap, weight, full)]


def halved(have: np.ndarray, low: int, high: int, seed: int) -> tuple[int, np.ndarray]:
    """(first shard of the right half, what the left one draws) of a node's quotas, none of them zero."""
    mid = (low + high) // 2
    total = int(have.sum())
    take = total * (mid - low) // (high - low)
    if not take:
        return mid, np.zeros_like(have)
    if total <= MOST_DRAWN:
        return mid, np.random.default_rng([seed, low, high]).multivariate_hypergeometric(have, take, method="marginals")
    share = [divmod(int(h) * (mid - low), high - low) for h in have]
    left = np.array([whole for whole, _ in share], np.int64)
    order = sorted(range(len(have)), key=lambda i: (-share[i][1], i))
    left[order[: take - int(left.sum())]] += 1
    return mid, left


def leaves_of(low: int, high: int, of: np.ndarray, have: np.ndarray, start: np.ndarray, seed: int, most: int = 0) -> Iterator[tuple]:
    """Nodes (low, high, sources, quotas, first places) below one: single shards, or those with at most ``most`` quotas."""
    stack = [(low, high, of, have, start)]
    while stack:
        low, high, of, have, start = stack.pop()
        if high - low == 1 or len(of) * (high - low) <= most:
            yield low, high, of, have, start
            continue
        mid, left = halved(have, low, high, seed)
        right = have - left
        a, b = left > 0, right > 0
        stack.append((mid, high, of[b], right[b], start[b] + left[b]))
        stack.append((low, mid, of[a], left[a], start[a]))


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) that each shard (rows) gets, drawn down a binary tree."""
    out, quotas = np.zeros((shards, len(quotas)), np.int64), np.asarray(quotas, np.int64)
    of = np.flatnonzero(quotas)
    for low, _, of, have, _ in leaves_of(0, shards, of, quotas[of], np.zeros(len(of), np.int64), seed):
        out[low, of] = have
    return out


def plan(totals: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> dict:
    """What is to be taken of each source; ``totals``: (source, size) of each."""
    totals = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in totals]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], share, ceiling)
    take = [min(math.floor(t + 0.5), math.floor(ceiling * n)) for t, n in zip(target, sizes)]
    blocks = [-(-n // block_words) for n in sizes]
    return {"sources": [s for s, _ in totals], "sizes": sizes, "targets": target, "take": take, "block": block_words, "blocks": blocks, "shards": max(1, -(-sum(take) // shard_words))}


def source_key(source: Column) -> Column:
    """A text for each source, null included."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def identities(df: DataFrame, text: str, source: str, key: str, seed: int, more: list[str]) -> tuple[Column, Column]:
    """Columns id and place: a digest of each row's key, source, text and ``more`` columns, and its place in the seeded order."""
    known = F.coalesce(F.col(key).cast("string"), F.lit("-"))
    print_ = F.md5(F.coalesce(F.col(text), F.lit("")))
    rest = F.xxhash64(*more).cast("string") if more else F.lit("")
    return F.md5(F.concat_ws("|", known, source_key(F.col(source)), print_, F.col(text).isNull().cast("string"), rest)), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), print_))


def ranked_blocks(spark: SparkSession, p: dict, seed: int) -> DataFrame:
    """(number, pass, block, len, before): every pass's blocks of each source; before: words of those ahead in the pass's permuted order."""
    runs = []
    for i, (s, n, t, b) in enumerate(zip(p["sources"], p["sizes"], p["take"], p["blocks"])):
        name = "" if s is None else f"={s}"
        for turn in range(-(-t // n) if n else 0):
            runs += [(i, turn, name, a, min(b, a + RUN) - 1, n) for a in range(0, b, RUN)]
    runs = spark.createDataFrame(runs, "number long, pass int, name string, first long, last long, size long")
    blocks = runs.select("number", "pass", "name", "size", F.explode(F.sequence("first", "last")).alias("block"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "name", F.col("pass").cast("string"), F.col("block").cast("string")))
    lane = F.concat_ws("/", F.col("number").cast("string"), F.col("pass").cast("string"))
    length = F.least(F.lit(p["block"]), F.col("size") - F.col("block") * p["block"])
    bucket, bits = buckets_of(F.col("digest"), sum(b * -(-t // n) for b, t, n in zip(p["blocks"], p["take"], p["sizes"]) if n))
    rows = blocks.withColumn("digest", digest).withColumn("lane", lane).withColumn("len", length).withColumn("bucket", bucket)
    return exclusive_offsets(rows, "lane", "bucket", ["digest", "block"], "len", "before", bits).select("number", "pass", "block", "len", "before")


def drawn_blocks(spark: SparkSession, p: dict, seed: int) -> DataFrame:
    """(number, pass, block, keep, shard, place): the blocks that shards draw, with the words kept of each and its place in the source's order."""
    needed = spark.createDataFrame([(i, t, n, b) for i, (t, n, b) in enumerate(zip(p["take"], p["sizes"], p["blocks"]))], "number long, take long, size long, blocks long")
    ranked = ranked_blocks(spark, p, seed).join(needed, "number")
    left = F.col("take") - F.col("pass") * F.col("size") - F.col("before")  # words that the pass still needs when a block's turn comes
    rank = F.ceil(F.col("before") / F.lit(p["block"])).cast("long")  # only the shorter block can make it a fraction
    drawn = ranked.where(left > 0).select("number", "pass", "block", F.least("len", left).alias("keep"), (F.col("pass") * F.col("blocks") + rank).alias("place"))
    drawn = materialise(drawn, "mixing-blocks")
    quotas = np.zeros(len(p["sources"]), np.int64)
    for r in drawn.groupBy("number").count().collect():  # one row for each source
        quotas[r["number"]] = r["count"]
    of = np.flatnonzero(quotas)
    top = [(low, high, *(x.tolist() for x in rest)) for low, high, *rest in leaves_of(0, p["shards"], of, quotas[of], np.zeros(len(of), np.int64), seed, TOP_CELLS)] if len(of) else []

    def run(batches):
        for batch in batches:
            for low, high, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                out: list[tuple] = []
                for shard, _, of, have, start in leaves_of(low, high, *(np.array(x, np.int64) for x in rest), seed):
                    out += zip(of.tolist(), [shard] * len(of), start.tolist(), (start + have - 1).tolist())
                    if len(out) > 4096:
                        yield cells(out)
                        out = []
                if out:
                    yield cells(out)

    nodes = spark.createDataFrame(top, "low long, high long, of array<long>, have array<long>, start array<long>").repartition(max(1, min(len(top), 4096)))
    split = nodes.mapInArrow(run, "number long, shard long, first long, last long")
    shards = split.select("number", "shard", F.explode(F.sequence("first", "last")).alias("place"))
    return materialise(drawn.join(shards, ["number", "place"]).select("number", "pass", "block", "keep", "shard", "place"), "mixing-drawn")


def cells(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["number", "shard", "first", "last"])


def pieces_of(df: DataFrame, text: str, source: str, key: str, seed: int, more: list[str], options: dict) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): rows (id, key, source, size, n, number, source_size, target), one for equal ones; pieces (id, copy, pass, shard, place, first, words)."""
    spark = df.sparkSession
    identity, order = identities(df, text, source, key, seed, more)
    rows = df.select(identity.alias("id"), F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order.alias("order"))
    rows = rows.groupBy("id").agg(*(F.first(c).alias(c) for c in ("key", "source", "size", "order")), F.count("*").alias("n"))
    rows = materialise(rows, "mixing")
    totals = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("n")).collect()]  # one row for each source
    p = plan(totals, **options)
    known = [("" if s is None else f"={s}", i, n, t) for i, (s, n, t) in enumerate(zip(p["sources"], p["sizes"], p["targets"]))]
    known = spark.createDataFrame(known, "name string, number long, source_size long, target double")
    rows = rows.withColumn("name", source_key(F.col("source"))).join(known, "name").drop("name")
    bucket, bits = buckets_of(F.col("order"), rows.count())
    sized = rows.where("size > 0").withColumn("bucket", bucket).withColumn("all", F.col("size") * F.col("n"))
    laid = exclusive_offsets(sized, "number", "bucket", ["order", "id"], "all", "begin", bits)
    each = laid.select("id", "number", "size", "begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    each = each.withColumn("begin", F.col("begin") + F.col("copy") * F.col("size"))
    block = F.lit(p["block"])
    spans = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))
    cut = each.select("*", F.explode(spans).alias("block"))
    edge = F.col("block") * block
    start = F.greatest("begin", edge)
    # A block holds at most its words' number of rows, so no key of this join has more.
    met = cut.join(drawn_blocks(spark, p, seed), ["number", "block"]).withColumn("words", F.least(F.col("begin") + F.col("size"), edge + F.col("keep")) - start)
    return rows, met.where("words > 0").select("id", "copy", "pass", "shard", "place", (start - F.col("begin")).alias("first"), "words")


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, **options) -> DataFrame:
    """Every row with what the mix takes of it.

    (key, source, size, source_size, target, taken, draws); draws has a struct for each
    part of the row that a shard draws: pass, shard, place (of its block in the source's
    permuted order), first (word of the row) and words. taken is the sum of these words.
    """
    rows, pieces = pieces_of(df, text, source, key, seed, [], options)
    draw = F.struct("pass", "shard", "place", "first", "words").alias("draw")
    base = rows.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"), F.struct("key", "source", "size", "source_size", "target").alias("row"))
    found = base.withColumn("draw", F.lit(None).cast(pieces.select(draw).schema["draw"].dataType)).unionByName(pieces.select("id", "copy", draw), allowMissingColumns=True)
    # A row is its own key here, with a draw for each of its blocks and passes.
    whole = found.groupBy("id", "copy").agg(F.first("row", ignorenulls=True).alias("row"), F.coalesce(F.sum("draw.words"), F.lit(0)).alias("taken"), F.array_sort(F.collect_list("draw")).alias("draws"))
    return whole.select(F.col("row.key").alias(key), "row.source", "row.size", "row.source_size", "row.target", "taken", "draws")


def mixed_rows(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, shard by shard, each shard in a seeded order.

    Where a row lies across blocks, each block's part of its words is a row of its own.
    """
    names = [f"c{i}" for i in range(len(df.columns))]  # no name of the input meets one of these below
    key_, text_, source_ = (names[df.columns.index(c)] for c in (key, text, source))
    given = df.toDF(*names)
    more = [n for n in names if n not in (key_, text_, source_)]
    rows, pieces = pieces_of(given, text_, source_, key_, seed, more, options)
    identity, _ = identities(given, text_, source_, key_, seed, more)
    # Rows that are equal in all columns have one identity and may stand for each other: one of them stays, before the shuffle where they meet.
    one = given.withColumn("_id", identity).withColumn("_turn", F.row_number().over(Window.partitionBy("_id").orderBy("_id"))).where("_turn = 1").drop("_turn")
    place = F.xxhash64(F.lit(seed), "id", "copy", "pass", "first")
    sizes = pieces.join(rows.select("id", "size"), "id").select("id", "shard", place.alias("_place"), "first", "words", "size")
    joined = one.join(sizes, F.col("_id") == F.col("id")).select(*names, "first", "words", "size", F.col("shard").alias("_shard"), "_place")
    at, last = names.index(text_), len(names)
    placed = StructType([*given.schema.fields, StructField("_shard", LongType()), StructField("_place", LongType())])

    def cut(batches):
        begin("mixing")
        for batch in batches:
            texts, first, words, sizes = (batch.column(i).to_pylist() for i in (at, *range(last, last + 3)))
            out = pa.array([t if w == n else part(t, a, w) for t, a, w, n in zip(texts, first, words, sizes)], pa.string())
            columns = [out if i == at else batch.column(i) for i in (*range(last), last + 3, last + 4)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_shard", "_place"])

    bound_batches(df.sparkSession)
    # Texts are cut before they move to their shards, so that only their parts do.
    moved = joined.mapInArrow(cut, placed).repartition("_shard").sortWithinPartitions("_shard", "_place")
    return moved.select(*names).toDF(*df.columns)


WORDS = re.compile(WORD.encode())


def part(text: str, first: int, n: int) -> str:
    """Words ``first`` to ``first + n`` of a text, as they stand there; what is ahead of the first word or behind the last one goes with it."""
    raw = text.encode()
    begin, end = 0, len(raw)
    for i, m in enumerate(WORDS.finditer(raw)):
        if i == first and first:
            begin = m.start()
        if i == first + n - 1:
            end = m.end()
        if i == first + n:
            return raw[begin:end].decode()
    return raw[begin:].decode()


#: The same rows as ``mix`` gives, by DuckDB, without the draws: passes that take a whole source, and the last one's blocks.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                  md5(concat_ws(':', '{SEED}', doc_id::VARCHAR, md5(coalesce(text, '')))) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2.0::DOUBLE * source_size AS cap,
             (1.5::DOUBLE * sum(source_size) OVER ())::DOUBLE AS total FROM n),
o AS (SELECT *, total - coalesce(sum(cap) OVER k, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER k, 0) AS weights FROM w
      WINDOW k AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, rest * w / weights > cap AS whole FROM o),
t AS (SELECT source, source_size, CASE WHEN whole THEN cap ELSE (total - coalesce(sum(cap) FILTER (whole) OVER (), 0)) * w
             / (sum(w) FILTER (NOT whole) OVER ())::DOUBLE END::DOUBLE AS target FROM f),
q AS (SELECT *, least(floor(target + 0.5), floor(2.0 * source_size))::BIGINT AS take FROM t),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE take // source_size END AS passes, CASE WHEN source_size = 0 THEN 0 ELSE take % source_size END AS last FROM q),
b AS (SELECT source, last, source_size, passes, unnest(range((source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})) AS block FROM r),
l AS (SELECT *, least({BLOCK_WORDS}, source_size - block * {BLOCK_WORDS}) AS len,
             md5(concat_ws(':', '{SEED}', CASE WHEN source IS NULL THEN '' ELSE '=' || source END, passes::VARCHAR, block::VARCHAR)) AS digest FROM b),
k AS (SELECT source, block, greatest(0, least(len, last - coalesce(sum(len) OVER (PARTITION BY source ORDER BY digest, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS keep FROM l),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM d),
c AS (SELECT id, source, begin, begin + size AS fin, unnest(range(begin // {BLOCK_WORDS}, (begin + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM p WHERE size > 0),
x AS (SELECT id, sum(greatest(0, least(fin, c.block * {BLOCK_WORDS} + keep) - greatest(begin, c.block * {BLOCK_WORDS}))) AS more
      FROM c JOIN k ON c.source IS NOT DISTINCT FROM k.source AND c.block = k.block GROUP BY id)
SELECT doc_id, p.source, size, source_size, target, (passes * size + coalesce(more, 0))::BIGINT AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source LEFT JOIN x USING (id)
"""
