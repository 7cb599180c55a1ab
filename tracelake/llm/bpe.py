"""Byte-level BPE encoding by backtracking from longest matches, and decoding.

The vocabulary's byte strings are mapped to Latin-1, so that an Aho-Corasick automaton over them
reports, in one pass over a piece, every token that starts at every place.  A sequence of tokens is
what the merges give if and only if each adjacent pair, merged on its own, stays those two tokens;
the encoder therefore takes the longest token that is compatible with the one before, backs off to
shorter ones, and steps back where none fits.  Places found hopeless are never entered again, so
the work is linear in the piece.  Pair compatibility is memoised.

Texts are cut by the tokenizer's own pattern, and whole pieces are memoised per worker in a table
that is emptied when it reaches a fixed size.

Defined results: a null text counts as empty (no ids); repeated rows each get a row; a null
``doc_id`` is passed through; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_OTHER_BLANK = regex.compile(r" (?=\s|\Z)").search


class BytePairEncoder:
    """Encoder for a rank file (base64 token and rank per line) and a splitting pattern."""

    def __init__(self, rank_file: str, pattern: str, memo: int = 300_000):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.split = regex.compile(pattern).findall
        self.blank_opens = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" in pattern
        self.limit = memo
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        # Halves of each token in its last merge, and the token that two halves make.
        self.halves: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        for rank in sorted(self.ranks.values()):
            token = self.tokens[rank]
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i], rank), self.ranks.get(token[i:], rank)
                if a < rank and b < rank and self._stay_apart(a, b):
                    self.halves[rank], self.joins[a, b] = (a, b), rank
                    break

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b ends with just a and b.

        Merges are undone from the last one backwards; at each stage a merge across the border must
        not come before the one undone (of equal ranks the left one comes first).
        """
        before = 1 << 60
        while True:
            if self.joins.get((a, b), before) < before:
                return False
            if a > b:
                if a not in self.halves:
                    return True
                before, a = a, self.halves[a][1]
            else:
                if b not in self.halves:
                    return True
                before, b = b + 1, self.halves[b][0]

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= 2 * self.limit:
                self.pairs.clear()
            found = self.pairs[a, b] = self._stay_apart(a, b)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, rank) in self.automaton.iter(piece.decode("latin-1")):
            starting[end - length + 1].append((length, rank))  # ends ascend, so lengths do
        hopeless = bytearray(n + 1)
        path: list[tuple[int, int, int]] = []  # (place, next choice, token)
        at, choice = 0, len(starting[0]) - 1
        while at < n:
            options = starting[at]
            while choice >= 0:
                length, rank = options[choice]
                if not hopeless[at + length] and (not path or self.compatible(path[-1][2], rank)):
                    break
                choice -= 1
            if choice >= 0:
                path.append((at, choice - 1, rank))
                at += length
                choice = len(starting[at]) - 1 if at < n else -1
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a single byte")
                hopeless[at] = 1
                at, choice, _ = path.pop()
        return [token for _, _, token in path]

    def _encode_pieces(self, text: str) -> bytes:
        memo, out = self.pieces, []
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= 64:
                    if len(memo) >= self.limit:
                        memo.clear()
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A blank that a visible character follows always opens a piece in patterns with `` ?`` and
        ``\\s+(?!\\S)``, so where all blanks are such, the text falls into chunks at its blanks.
        """
        if not self.blank_opens or _OTHER_BLANK(text):
            return self._encode_pieces(text)
        chunks = text.split(" ")
        memo, out = self.chunks, [self._encode_pieces(chunks[0])]
        for chunk in chunks[1:]:
            ids = memo.get(chunk)
            if ids is None:
                ids = self._encode_pieces(" " + chunk)
                if len(chunk) <= 64:
                    if len(memo) >= self.limit:
                        memo.clear()
                    memo[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(rank_file, pattern)


def encode_column(documents: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"]).mapInArrow(run, "doc_id long, ids binary")


def decode_column(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``decoded`` (binary) from the output of ``encode_column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for b in batches:
            texts = [bpe.decode(i or b"") for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(encoded["doc_id"], encoded["ids"]).mapInArrow(run, "doc_id long, decoded binary")


def encoding_digests(documents: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Token count and digests of ids and of the bytes decoded from them, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                counts, ids_hex, text_hex = [], [], []
                for text in part.column("text").to_pylist():
                    ids = bpe.encode(text or "")
                    counts.append(len(ids) // 4)
                    ids_hex.append(hashlib.sha256(ids).hexdigest())
                    text_hex.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"]).mapInArrow(run, schema)
