"""Byte-level BPE encoding and decoding, exact and in linear time.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over
the vocabulary finds every token that begins at each byte.  The encoder takes
the longest token that may follow its predecessor and backtracks where none
may.  Two tokens may be neighbours when merging their joint bytes by rank would
keep the border between them; that test is memoised.  The result equals that of
merging pairs by rank, without its quadratic cost on long pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import cache, small_batches, task

#: Texts longer than this are split piece by piece, for bounded memory.
LONG = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Pieces(dict):
    """Piece of text -> packed ids, filled on demand; holds at most LIMIT pieces."""

    LIMIT = 150_000

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        packed = array("I", self.encoder.encode_bytes(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = packed
        return packed


class Words(dict):
    """What stands between two lone spaces -> packed ids of a space and it; holds at most LIMIT words."""

    LIMIT = 250_000

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        packed = b"".join(map(self.encoder.pieces.__getitem__, self.encoder.split.findall(" " + word)))
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = packed
        return packed


class Vocabulary:
    """Token ranks, and for every token the two tokens whose merge makes it; made once, on the driver."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        #: By rank; None for a byte, and where merging never makes the token.
        self.halves = [self.merged_from(t) if len(t) > 1 else None for t in self.tokens]

    def merged_from(self, text: bytes) -> tuple[int, int] | None:
        """Merges by rank, all ranks below that of the whole text, down to two parts."""
        own, get = self.ranks[text], self.ranks.get
        parts = [text[k : k + 1] for k in range(len(text))]
        joined = [get(a + b, own) for a, b in zip(parts, parts[1:])]
        while len(parts) > 2:
            rank = min(joined)
            if rank >= own:
                return None
            at = joined.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = get(parts[at - 1] + parts[at], own)
            if at < len(joined):
                joined[at] = get(parts[at] + parts[at + 1], own)
        return (get(parts[0]), get(parts[1])) if parts[0] in self.ranks and parts[1] in self.ranks else None


#: Fixed value: a pattern in which a lone space always begins a piece and belongs to what follows, so that no piece
#: depends on anything beyond the spaces around it.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_double = re.compile(r" \s|\s ")


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.ranks, self.tokens, self.halves = vocabulary.ranks, vocabulary.tokens, vocabulary.halves
        self.split, self.spaced = regex.compile(pattern), pattern == SPACED
        self.automaton = ahocorasick.Automaton()
        for rank, token in enumerate(self.tokens):
            if len(token) == 1 or self.halves[rank]:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.lengths = list(map(len, self.tokens))
        self.compatible: dict[int, bool] = {}
        self.pieces, self.words = Pieces(self), Words(self)

    def may_follow(self, left: int, right: int) -> bool:
        """Would merging by rank keep the border between these neighbours?

        The later of the two tokens' last merges is undone again and again;
        then the parts that face each other over the border must not merge
        before what was just undone (of equal ranks the left pair merges first).
        """
        tokens, halves, get, limit = self.tokens, self.halves, self.ranks.get, len(self.tokens)
        while get(tokens[left] + tokens[right], limit) >= limit:
            half_left, half_right = halves[left], halves[right]
            if half_left is None and half_right is None:
                return True
            if half_right is None or (half_left is not None and left > right):
                limit, left = left, half_left[1]
            else:
                limit, right = right + 1, half_right[0]
        return False

    def encode_bytes(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        lengths, known, size = self.lengths, self.compatible, len(piece)
        # at each byte the tokens that begin there, short to long; those that lead nowhere are taken off its end
        begins: list[list[int]] = [[] for _ in piece]
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            begins[end + 1 - lengths[rank]].append(rank)
        begins.append([-1])
        chosen: list[int] = []
        at, last = 0, -1
        while at < size:
            here = begins[at]
            while here:
                token = here[-1]
                if begins[at + lengths[token]]:
                    if last < 0:
                        break
                    key = last << 32 | token
                    fits = known.get(key)
                    if fits is None:
                        if len(known) > 500_000:
                            known.clear()
                        known[key] = fits = self.may_follow(last, token)
                    if fits:
                        break
                here.pop()
            if here:
                chosen.append(token)
                at += lengths[token]
                last = token
            else:
                if not chosen:
                    raise ValueError("the vocabulary lacks a byte")
                at -= lengths[chosen.pop()]
                begins[at].pop()
                last = chosen[-1] if chosen else -1
        return chosen

    def encode_packed(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text as little-endian unsigned 32-bit integers, in parts."""
        if len(text) > LONG:
            found = self.split.finditer(text)
            while part := b"".join(self.pieces[m[0]] for m in islice(found, LONG // 8)):
                yield part
        elif self.spaced and " " in text and not (text[0].isspace() or text[-1].isspace() or _double.search(text)):
            first, *rest = text.split(" ")
            yield b"".join(map(self.pieces.__getitem__, self.split.findall(first)))
            yield b"".join(map(self.words.__getitem__, rest))
        else:
            yield b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    def encode(self, text: str) -> list[int]:
        return [i for part in self.encode_packed(text) for i in memoryview(part).cast("I")]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[tuple, Encoder] = {}
cache("bpe", _encoders.clear)


def encoder_for(held, pattern: str) -> Encoder:
    """This worker's encoder for a broadcast vocabulary."""
    key = (held.id if hasattr(held, "id") else id(held), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(held.value, pattern)
    return _encoders[key]


@task("bpe", keep=True)
def _digests(batches, held, pattern):
    encoder = encoder_for(held, pattern)
    for batch in batches:
        counts, ids_hash, text_hash = [], [], []
        for text in batch.column("text").to_pylist():
            n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            for packed in encoder.encode_packed(text or ""):
                n += len(packed) // 4
                of_ids.update(packed)
                of_text.update(encoder.decode(memoryview(packed).cast("I")))
            counts.append(n)
            ids_hash.append(of_ids.hexdigest())
            text_hash.append(of_text.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


@task("bpe", keep=True)
def _encoded(batches, held, pattern):
    encoder = encoder_for(held, pattern)
    for batch in batches:
        ids = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


@task("bpe", keep=True)
def _decoded(batches, held, pattern):
    encoder = encoder_for(held, pattern)
    for batch in batches:
        texts = [encoder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "bytes"])


def _run(df: DataFrame, column: str, body, ranks: dict[bytes, int], pattern: str, types: str) -> DataFrame:
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(Vocabulary(ranks))  # of the fixed size of a vocabulary file
    id_type = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", column).mapInArrow(lambda batches: body(batches, held, pattern), f"doc_id {id_type}, {types}")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids of every row of ``docs(doc_id, text)``; a null text is encoded like an empty one, to no ids."""
    return _run(docs, "text", _encoded, ranks, pattern, "ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, bytes of every row of ``encoded(doc_id, ids)``; null ids are decoded like none."""
    return _run(encoded, "ids", _decoded, ranks, pattern, "bytes binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs(doc_id, text)``.

    Whole texts are encoded and their ids decoded again, part by part, so that
    very long texts need bounded memory.  Null texts count as empty; repeated
    rows give repeated rows; further columns are ignored.
    """
    return _run(docs, "text", _digests, ranks, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string")
