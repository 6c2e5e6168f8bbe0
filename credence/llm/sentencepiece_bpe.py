"""SentencePiece merge-type (BPE) encoding and decoding by backtracking.

An encoding is right if and only if every two neighbouring pieces come out unchanged
when their joined text is merged anew. So the encoder walks through the text, takes
the longest piece that an Aho-Corasick automaton finds at a position, checks it with
the piece before it by re-merging the two, tries shorter ones, and steps back where
none fits; a bitfield keeps the positions from which no way leads on, so that each is
tried once.

Texts are cut, before that, where no piece of the vocabulary can span the cut; equal
parts are encoded once and kept in a cache of bounded size.

Defined results: null and empty texts give the end id alone and decode to an empty
text. Characters outside the vocabulary become the ids of their UTF-8 bytes. Texts may
have any length. Rows, repeated or not, are independent of each other; no other column
is read, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from credence.llm.common import Cache, begin, bound_batches, texts, worker_cache

SPACE = "▁"
#: Entries of the caches in each Python worker.
CACHE_PARTS, CACHE_WORDS, CACHE_PAIRS = 20_000, 170_000, 170_000


class PieceCodec:
    """Encoder and decoder for a SentencePiece model of the merge type with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end_id = model.eos_id()
        self.text_of: dict[int, str] = {}
        self.byte_of: dict[int, int] = {}
        self.id_of: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text_of[i] = piece
                self.id_of[piece] = i
        if len(self.byte_of) != 256:
            raise ValueError("a model with byte fallback is asked for")
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        # Merges are made by falling score; of equal scores the one further left goes first, so they share a rank.
        scores = {p: model.get_score(i) for p, i in self.id_of.items()}
        place = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: place[x] for p, x in scores.items()}
        #: For a piece and one that may follow it: the longest that fits, of the latter and the shorter ones it begins with.
        self.fitting: dict[tuple[str, str], str | None] = {}
        self.halves: dict[str, int] = {}
        # Pieces of two characters and more that merges end in, and the next shorter one that each begins with.
        self.shorter: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        real = [p for p in self.id_of if len(p) > 1 and self.half(p)]
        for piece in real:
            self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        for piece in real:
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 1, -1) if self.halves.get(piece[:k])), piece[0])
        self.parts = self._cuts()

    def _cuts(self) -> re.Pattern:
        """A pattern whose matches tile any text so that no piece spans two of them."""
        letter = re.compile(r"[^\W\d_]")
        mixed = set()
        for piece in self.id_of:
            body = piece.lstrip(SPACE)
            if len({bool(letter.match(c)) for c in body}) > 1:
                mixed |= {c for c in body if letter.match(c)}
        word = rf"[^\W\d_{re.escape(''.join(sorted(mixed)))}]"
        other = rf"(?:(?!{word})[^{SPACE}])+"
        tiles = re.compile(rf"{SPACE}*{word}+|{SPACE}*{other}|{SPACE}+", re.S)
        if len(mixed) > 64 or any(not tiles.fullmatch(p) for p in self.id_of):
            tiles = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        if any(not tiles.fullmatch(p) for p in self.id_of):
            tiles = re.compile(".+", re.S)
        return tiles

    def merge(self, text: str) -> tuple[list[str], int]:
        """The pieces of a short text, merge after merge, and how long the left half of the last merge is."""
        out, half = list(text), 0
        rank = self.rank
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                r = rank.get(out[i] + out[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            half = len(out[at])
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out, half

    def compatible(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay as they are when their text is merged anew.

        The merges of both are undone from the latest to the first; of equal ranks the one
        further right is the later one. Before each of them the pair that meets at the
        border must not be one that merges earlier.
        """
        rank, limit = self.rank, len(self.rank)
        while True:
            r = rank.get(left + right)
            if r is not None and r < limit:
                return False
            a = rank[left] if len(left) > 1 else -1
            b = rank[right] if len(right) > 1 else -1
            if a > b:
                limit, left = a, left[self.half(left) :]
            elif b >= 0:
                limit, right = b + 1, right[: self.half(right)]
            else:
                return True

    def longest_fitting(self, left: str, piece: str) -> str | None:
        """The longest piece that can follow ``left``, of a piece and the shorter ones that it begins with."""
        known, walked = self.fitting, []
        while piece is not None:
            found = known.get((left, piece), "")
            if found != "":
                piece = found
                break
            walked.append((left, piece))
            if self.compatible(left, piece):
                break
            piece = self.shorter.get(piece)
        if len(known) >= CACHE_PAIRS:
            known.clear()
        known.update(dict.fromkeys(walked, piece))
        return piece

    def half(self, piece: str) -> int:
        """Length of the left half of the merge that makes a piece; 0 if no merges end in it."""
        known = self.halves.get(piece)
        if known is None:
            out, known = self.merge(piece)
            known = self.halves[piece] = known if out == [piece] else 0
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of an escaped text, by backtracking."""
        n, longest = len(text), list(text)
        for end, (before, piece) in self.automaton.iter(text):
            longest[end - before] = piece  # ends rise, so the longest piece of a start comes last
        failed, any_failed = bytearray((n >> 3) + 1), False  # a bit for each position
        known, shorter = self.fitting, self.shorter
        out: list[str] = []
        at, piece, left = 0, longest[0] if n else "", ""
        while at < n:
            while piece is not None:
                if left:
                    fits = known.get((left, piece), "")
                    piece = self.longest_fitting(left, piece) if fits == "" else fits
                    if piece is None:
                        break
                end = at + len(piece)
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    break
                piece = shorter.get(piece)
            if piece is not None:
                out.append(piece)
                at, left = end, piece
                piece = longest[at] if at < n else ""
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece = out.pop()  # its end is marked now, so a shorter one follows
                at -= len(piece)
                left = out[-1] if out else ""
        return out

    def part_ids(self, text: str) -> list[int]:
        pieces, id_of = self.pieces(text), self.id_of
        try:
            return [id_of[p] for p in pieces]
        except KeyError:  # a character outside the vocabulary
            ids = []
        for piece in pieces:
            i = id_of.get(piece)
            if i is None:
                ids.extend(self.id_of_byte[b] for b in piece.encode())
            else:
                ids.append(i)
        return ids

    def split(self, text: str) -> list[str]:
        """The parts of a text that can be encoded one by one."""
        return self.parts.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end id last."""
        return [i for part in self.split(text) for i in self.part_ids(part)] + [self.end_id]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids. Bytes that aren't UTF-8 become U+FFFD; other ids that stand for no text give none."""
        text_of = self.text_of
        try:
            out = [text_of[i] for i in ids]
        except KeyError:  # bytes, or ids without text
            out, run = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(utf8(run))
                    run = bytearray()
                out.append(text_of.get(i, ""))
            if run:
                out.append(utf8(run))
        text = "".join(out)
        if first and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


def utf8(run: bytes) -> str:
    """Bytes as text, one U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(run[at : at + n]).decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@worker_cache
def codec(path: str) -> PieceCodec:
    """The codec of a model file; one for each worker."""
    return PieceCodec(path)


#: What is kept of a part: the decimal form of its ids, and the text they decode to unless it is the part as it reads.
Kept = str | tuple[str, str]


def _kept(ids: str, decoded: str, part: str) -> Kept:
    return ids if decoded == part.replace(SPACE, " ") else (ids, decoded)


def _unfolded(kept: list[Kept], parts: list[str]) -> tuple[str, str]:
    """The decimal form of the ids of parts, and the text they decode to."""
    both = [(k, p.replace(SPACE, " ")) if isinstance(k, str) else k for k, p in zip(kept, parts)]
    return " ".join([ids for ids, _ in both]), "".join([decoded for _, decoded in both])


@worker_cache
def _parts(path: str) -> Cache:
    """What is kept of a part; that of parts with one space before them is in ``_words``."""
    c = codec(path)

    def compute(part: str) -> Kept:
        ids = c.part_ids(part)
        return _kept(" ".join(map(str, ids)), c.decode(ids, first=False), part)

    return Cache(compute, CACHE_PARTS)


@worker_cache
def _words(path: str) -> Cache:
    """The same for a word with a space before it; its first part is a word, too."""
    parts = _parts(path)
    find = codec(path).parts.findall

    def compute(word: str) -> Kept:
        found = find(SPACE + word)
        if len(found) == 1:
            return parts.compute(found[0])
        return _kept(*_unfolded([words[found[0][1:]], *[parts[p] for p in found[1:]]], found), SPACE + word)

    words = Cache(compute, CACHE_WORDS)
    return words


def _joined(path: str, text: str) -> tuple[str, str]:
    """The decimal form of a text's ids, the end id last, and the text they decode to."""
    c, words = codec(path), _words(path)
    if not text:
        return str(c.end_id), ""
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        parts, others = c.split(text), _parts(path)
        kept = [words[p[1:]] if p[0] == SPACE != p[1:2] else others[p] for p in parts]
    else:
        parts = text.split(" ")
        kept = list(map(words.__getitem__, parts))
        if tuple in set(map(type, kept)):
            parts = [SPACE + p for p in parts]
    if tuple in set(map(type, kept)):
        ids, decoded = _unfolded(kept, parts)
        decoded = decoded[1:]
    else:
        ids, decoded = " ".join(kept), text.replace(SPACE, " ")
    return f"{ids} {c.end_id}", decoded


def _id_lists(joined: list[str]) -> pa.Array:
    """Lists of ids from their decimal forms, without an object for each id."""
    offsets = np.concatenate([[0], np.cumsum([ids.count(" ") + 1 for ids in joined])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromstring(" ".join(joined), np.int32, sep=" ")))


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids): the ids of every text, the end id last."""

    def run(batches):
        begin("sentencepiece_bpe", codec, _parts, _words)
        for batch in batches:
            joined = [_joined(path, t)[0] for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _id_lists(joined)], ["key", "ids"])

    bound_batches(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"key {dict(df.dtypes)[key]}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text): the text of every list of ids; null gives an empty text."""

    def run(batches):
        begin("sentencepiece_bpe", codec, _parts, _words)
        c = codec(path)
        for batch in batches:
            out = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "text"])

    bound_batches(df.sparkSession)
    return df.select(key, ids).mapInArrow(run, f"key {dict(df.dtypes)[key]}, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded in one pass; ids too where asked."""

    def run(batches):
        begin("sentencepiece_bpe", codec, _parts, _words)
        for batch in batches:
            joined = [_joined(path, t) for t in texts(batch.column(1))]
            counts = pa.array([ids.count(" ") + 1 for ids, _ in joined], pa.int64())
            ids_hex = pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in joined], pa.string())
            text_hex = pa.array([hashlib.sha256(decoded.encode()).hexdigest() for _, decoded in joined], pa.string())
            columns = [batch.column(0), counts, ids_hex, text_hex]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, _id_lists([ids for ids, _ in joined])], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    bound_batches(df.sparkSession)
    schema = f"key {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
