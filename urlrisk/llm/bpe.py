"""Byte-level BPE encoding and decoding.

Bytes are read as Latin-1 characters, so that one automaton over the vocabulary
finds every token at every place of a piece of text.  From each place the
longest match is tried first; a shorter one, or a step back, follows where the
match may not stand beside the token before it.  Adjacency answers are memoised
and a place from which no encoding leads on is never tried again, so the work is
linear in the length of the text.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from urlrisk.llm.common import Memo, map_arrow
from urlrisk.llm.merges import Merges

_SLICE = 1 << 20
_SAFE = regex.compile(r"(?<=[^\s]) (?=[^\s])")


class _Irregular(Exception):
    """The text has white space other than single spaces between words."""


class ByteBpe:
    """Encoder and decoder for a file of base64 tokens and ranks and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.merges = Merges(self.ranks, {chr(i) for i in range(256)})
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ranks))
        #: The longest usable token that begins a string, and the next shorter one of a token.
        self.begins = Memo(self._begin)
        self.shorter = Memo(lambda token: self._begin(token[:-1]))
        self.pattern = regex.compile(pattern)
        self.pieces = Memo(self._piece)
        self.chunks = Memo(self._chunk)

    def _begin(self, text: str) -> str:
        while text and not (text in self.ranks and self.merges.usable(text)):
            text = text[:-1]
        return text

    def _merge(self, piece: str) -> list[str]:
        """Tokens of one piece: longest matches with backtracking."""
        if piece in self.ranks:
            return [piece]
        fits, begins, shorter = self.merges.fits, self.begins, self.shorter
        reach, widest, many = self.automaton.longest_prefix, self.longest, len(piece)
        dead: set[int] = set()
        path: list[str] = []
        place, last = 0, None
        token = begins[piece[:reach(piece[:widest])]]
        while place < many:
            while token and (place + len(token) in dead or last is not None and not fits[last, token]):
                token = shorter[token]
            if token:
                path.append(token)
                place += len(token)
                last = token
                if place < many:
                    rest = piece[place:place + widest]
                    token = begins[rest[:reach(rest)]]
            else:
                dead.add(place)
                token = path.pop()
                place -= len(token)
                last = path[-1] if path else None
                token = shorter[token]
        return path

    def _piece(self, piece: str) -> bytes:
        data = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        ids = [self.ranks[token] for token in self._merge(data)]
        return pack(f"<{len(ids)}I", *ids)

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and the text up to the next space."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Irregular
        return self._ids(" " + chunk)

    def _slice(self, text: str, first: bool) -> bytes:
        """Ids of a part of a text that borders on others at single spaces; all but the first begin with theirs."""
        body = text if first else text[1:]
        chunks = body.split(" ")
        try:
            head = chunks.pop(0) if first else None
            if head is not None and (not head or head[-1].isspace()):
                raise _Irregular
            rest = b"".join(map(self.chunks.__getitem__, chunks))
        except _Irregular:
            return self._ids(text)
        return (self._ids(head) if head is not None else b"") + rest

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        text = text or ""
        if len(text) <= _SLICE:
            return self._slice(text, True) if text else b""
        parts, start = [], 0
        while start < len(text):
            cut = _SAFE.search(text, start + _SLICE) if start + _SLICE < len(text) else None
            end = cut.start() if cut else len(text)
            parts.append(self._slice(text[start:end], start == 0))
            start = end
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    """The coder of this Python process; the files are small and installed on every machine."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, n_tokens) of every whole text; ids are little-endian 32-bit integers.

    A null or empty text has no ids.  Rows stay as they are, repeated and null
    keys included; an empty table gives an empty table; other columns are not
    read, whatever their names.  No row leaves its partition.
    """
    schema = docs.select(key).schema

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode_text = coder(path, pattern).encode
        ids = [encode_text(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
            [key, "ids", "n_tokens"])

    return map_arrow(docs.select(key, text), rows, f"`{key}` {schema[0].dataType.simpleString()}, ids binary, n_tokens bigint")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids; null ids give null, bytes that are no UTF-8 become replacement characters."""
    schema = encoded.select(key).schema

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode_ids = coder(path, pattern).decode
        texts = [None if i is None else decode_ids(i).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return map_arrow(encoded.select(key, ids), rows, f"`{key}` {schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes decoded from those ids.

    Encodes and decodes batch by batch, so that ids never have to be stored; the
    cases of ``encode`` hold.
    """
    schema = docs.select(key).schema

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path, pattern)
        counts, of_ids, of_bytes = [], [], []
        for value in batch.column(1):
            ids = bpe.encode(value.as_py())
            counts.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
            [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(key, text), rows,
                     f"`{key}` {schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
