"""Token ids in a binary form: word-aligned Simple-8b coding with offsets by block.

A segment holds the ids of some consecutive documents:

    magic "S8B1" | documents, ids, blocks, words, exceptions: uint64 each
    document keys: int64 each | whether a key is there: uint8 each | ids of each document: uint64 each
    first word of each block, and one more: uint64 each
    words: uint64 each | exceptions: uint64 each

All numbers are little-endian. A block covers 1,024 ids (the last one fewer), and no
word crosses a block, so that any block decodes alone. The top four bits of a word are
a selector that says how many ids of which width follow from the lowest bit up. Ids
that need over 60 bits go to the exceptions, with their place there in an escape word.

Segments are rows of a table (pid, seq, n_ids, payload) that Spark's own writer makes,
so any file system that Spark reaches holds them. Rows come in ascending key order over
(pid, seq); ties of keys come in the order of their texts' hashes, null keys first. Rows
of one key spread over as many partitions as they need.

Defined results: null and empty texts have the end id alone; texts may have any length;
repeated rows stay; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.llm.common import begin, bound_batches, texts, worker_cache

# How many ids of which width a word holds, by selector. The last selector is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 14
BLOCK = 1024
MAGIC = b"S8B1"


def selector_of(ids: np.ndarray) -> np.ndarray:
    """The narrowest selector that holds each id; the escape where none does."""
    return np.searchsorted(np.uint64(1) << WIDTHS[:ESCAPE].astype(np.uint64), ids, side="right").astype(np.int8)


NARROWEST = selector_of(np.arange(1 << 17, dtype=np.uint64))


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block and one more, exceptions) of unsigned 64-bit ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.uint64), np.empty(0, np.uint64)
    wide = BLOCK + int(COUNTS[0])  # blocks lie apart by the longest word, so that words may reach beyond a block's end
    value = np.zeros((blocks, wide), np.uint64)
    value[: n // BLOCK, :BLOCK] = ids[: n // BLOCK * BLOCK].reshape(-1, BLOCK)
    value[-1, : n - (blocks - 1) * BLOCK] = ids[(blocks - 1) * BLOCK :]
    value = value.ravel()
    largest = int(ids.max())
    least = (NARROWEST[value.astype(np.int64)] if largest < len(NARROWEST) else selector_of(value)).reshape(blocks, wide)
    most = {1: least}  # most[c]: the largest of the c selectors from here on, for powers of two
    chosen = np.full((blocks, BLOCK), ESCAPE, np.int8)
    for k in range(ESCAPE - 1, -1, -1):
        c = int(COUNTS[k])
        half = 1 << (c.bit_length() - 1)
        while half not in most:
            have = max(most)
            below = most[have]
            most[2 * have] = np.maximum(below[:, : below.shape[1] - have], below[:, have:])
        whole = np.maximum(most[half][:, :BLOCK], most[half][:, c - half : c - half + BLOCK]) if c > half else most[half][:, :BLOCK]
        np.copyto(chosen, np.int8(k), where=whole <= k)
    chosen = chosen.ravel()
    step = COUNTS[chosen].astype(np.int32)
    starts, cursor = [], np.arange(blocks, dtype=np.int32) * BLOCK
    last = np.minimum(cursor + BLOCK, n)
    while len(cursor):  # one word of every block at a time
        starts.append(cursor)
        cursor = cursor + step[cursor]
        open_ = cursor < last
        if not open_.all():
            cursor, last = cursor[open_], last[open_]
    starts = np.sort(np.concatenate(starts)).astype(np.int64)
    selector = chosen[starts]
    words = selector.astype(np.uint64) << np.uint64(60)
    at = starts + starts // BLOCK * (wide - BLOCK)
    for k in range(ESCAPE):
        if len(rows := np.flatnonzero(selector == k)):
            here, packed = at[rows], words[rows]
            for j in range(int(COUNTS[k])):
                packed |= value[here + j] << np.uint64(j * int(WIDTHS[k]))
            words[rows] = packed
    rows = np.flatnonzero(selector == ESCAPE)
    words[rows] |= np.arange(len(rows), dtype=np.uint64)
    first = np.searchsorted(starts, np.arange(blocks + 1) * BLOCK).astype(np.uint64)
    return words, first, value[at[rows]]


def unpack(words: np.ndarray, first: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The ids again; every selector's words are decoded at once."""
    if not n:
        return np.zeros(0, np.uint64)
    blocks, wide = len(first) - 1, BLOCK + int(COUNTS[0])
    out = np.zeros(blocks * wide, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(COUNTS[selector])])
    block = np.repeat(np.arange(blocks), np.diff(first.astype(np.int64)))
    start = before[:-1] - before[first.astype(np.int64)[block]] + block * wide
    for k in range(ESCAPE):
        if len(rows := np.flatnonzero(selector == k)):
            here, packed, mask = start[rows], words[rows], np.uint64((1 << int(WIDTHS[k])) - 1)
            for j in range(int(COUNTS[k])):
                out[here + j] = packed >> np.uint64(j * int(WIDTHS[k])) & mask
    rows = np.flatnonzero(selector == ESCAPE)
    out[start[rows]] = exceptions[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out.reshape(blocks, wide)[:, :BLOCK].ravel()[:n]


def segment(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment's bytes."""
    words, first, exceptions = pack(ids)
    head = MAGIC + struct.pack("<5Q", len(keys), len(ids), len(first) - 1, len(words), len(exceptions))
    there = np.array([k is not None for k in keys], np.uint8)
    numbers = np.array([k or 0 for k in keys], "<i8")
    return b"".join([head, numbers.tobytes(), there.tobytes(), lengths.astype("<u8").tobytes(), first.astype("<u8").tobytes(), words.astype("<u8").tobytes(), exceptions.astype("<u8").tobytes()])


class Segment:
    """A segment read from its bytes; blocks decode alone or all at once."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        docs, self.n, blocks, words, exceptions = struct.unpack_from("<5Q", payload, 4)
        at = 44
        self.keys = np.frombuffer(payload, "<i8", docs, at)
        self.there = np.frombuffer(payload, "u1", docs, at := at + 8 * docs)
        self.lengths = np.frombuffer(payload, "<u8", docs, at := at + docs)
        self.first = np.frombuffer(payload, "<u8", blocks + 1, at := at + 8 * docs)
        self.words = np.frombuffer(payload, "<u8", words, at := at + 8 * (blocks + 1))
        self.exceptions = np.frombuffer(payload, "<u8", exceptions, at + 8 * words)

    def ids(self) -> np.ndarray:
        return unpack(self.words, self.first, self.exceptions, self.n)

    def block(self, b: int) -> np.ndarray:
        """The ids of one block."""
        words = self.words[int(self.first[b]) : int(self.first[b + 1])]
        return unpack(words, np.array([0, len(words)]), self.exceptions, min(BLOCK, self.n - b * BLOCK))


#: The words that byte-level tokenizers of this kind cut texts into; a fixed value, that of their published encoder.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of white space in a row from which the library encodes a long text.
LONG_BLANK = re.compile(r"\s{2000}")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=1 << 16)
def settled(c: str) -> bool:
    """Whether all editions of Unicode since 3.2 count a character as the same kind: letter, number, mark, or white space."""
    then, now = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
    return then[0] == now[0] and then != "Cn" and c != "\u180e"


class TextEncoder:
    """Ids of whole texts by a byte-level tokenizer, equal to the tokenizers library's.

    Where the file's merges are in the order of their ids, and it cuts words by the usual
    pattern alone, a faster library merges by the same ranks. Texts that hold an added
    token's string, a character that editions of Unicode class differently, or very much
    white space in a row go to the tokenizers library.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], "<u4").tobytes()
        self.fast = self._fast(json.loads(self.library.to_str()))

    def _fast(self, file: dict):
        """The faster encoder; None where the file asks for anything that it doesn't do."""
        import tiktoken

        model, cutter = file["model"], file["pre_tokenizer"] or {}
        usual = model["type"] == "BPE" and not (file["normalizer"] or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        if not usual or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            return None
        vocab, byte = model["vocab"], byte_of()
        pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if [vocab.get(m) for m in pairs] != list(range(256, 256 + len(pairs))):
            return None
        ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items() if piece not in self.added}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        if any(a in text for a in self.added) or not (text.isascii() or all(map(settled, set(text)))):
            return False
        return len(text) < 2000 or not LONG_BLANK.search(text)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last."""
        out = []
        for t in batch:
            if self.fast is not None and self._plain(t):
                ids = self.fast.encode_to_numpy(t, disallowed_special=())
            else:
                ids = self.library.encode(t, add_special_tokens=False).ids
            out.append(np.asarray(ids, "<u4").tobytes() + self.end)
        return out


@worker_cache
def encoder(path: str, end_id: int) -> TextEncoder:
    return TextEncoder(path, end_id)


def write_token_files(df: DataFrame, out: str, path: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> None:
    """Encode every text and write the segments, in ascending key order, below ``out``."""

    def run(batches):
        begin("token_binary", encoder)
        pid = TaskContext.get().partitionId()
        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = encoder(path, end_id).encode(texts(batch.column(1)))
            lengths = np.array([len(x) // 4 for x in coded], np.uint64)
            ids = np.frombuffer(b"".join(coded), "<u4")
            payload = segment(batch.column(0).to_pylist(), lengths, ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())],
                ["pid", "seq", "n_ids", "payload"],
            )
            seq += 1

    bound_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    # Rows of one key, even equal ones, are dealt by hash and place; those places stay the same when a task runs again.
    ordered = rows.repartitionByRange("key", "hash", "row").sortWithinPartitions("key", "hash", "text").select("key", "text")
    ordered.mapInArrow(run, "pid int, seq long, n_ids long, payload binary").write.parquet(out)


def read_token_files(spark: SparkSession, files: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document in the files; start counts the ids of all before it."""
    table = spark.read.parquet(files)

    def run(batches):
        for batch in batches:
            for pid, seq, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = Segment(payload)
                ids = s.ids().astype("<u4").tobytes()
                ends = np.cumsum(s.lengths.astype(np.int64))
                starts = ends - s.lengths.astype(np.int64)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                m = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, pid, np.int32)), pa.array(np.full(m, seq, np.int64)), pa.array(s.keys, mask=s.there == 0), pa.array(starts), pa.array(s.lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["pid", "seq", "key", "inside", "n_tokens", "ids_crc32"],
                )

    bound_batches(spark, 64)
    documents = table.select("pid", "seq", "payload").mapInArrow(run, "pid int, seq long, key long, inside long, n_tokens long, ids_crc32 long")
    sizes = table.select("pid", "seq", "n_ids")
    by_task = sizes.groupBy("pid").agg(F.sum("n_ids").alias("n"))  # a row for each written partition
    base = by_task.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.withColumn("before", before).join(base, "pid").select("pid", "seq", (F.col("before") + F.col("base")).alias("begin"))
    return documents.join(begins, ["pid", "seq"]).select("key", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
