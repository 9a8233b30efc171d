"""Exact byte-pair encoding by backtracking (problem 8).

Each piece of the tokenizer's own pre-split is encoded left to right: an
Aho-Corasick automaton over the reversed vocabulary gives the longest token that
begins at each byte; a token is taken if it may stand behind the one before (pair
compatibility: re-merging the seam would never join across it), else the next
shorter one, else the encoder steps back.  A bit per position keeps it from
trying a position twice, so a piece takes linear time and the result is that of
the merge loop.  Decoding slices one byte string by an offset table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Byte-level pre-split of this vocabulary (a fixed value).
PRE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces up to this many bytes are remembered in a worker, up to so many pieces.
CACHED_BYTES, CACHED_PIECES = 64, 400_000


def byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, vocabulary: bytes) -> None:
        model = json.loads(vocabulary)["model"]
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = {t for t in model["vocab"] if any(c not in letters for c in t)} | {"<|endoftext|>"}
        self.id_of = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        n = max(self.id_of.values()) + 1
        self.bytes_of: list[bytes] = [b""] * n
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        # ids of merged tokens follow the order of the merges, so they serve as ranks
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(n)]
        self.joined: dict[int, int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            ia, ib = self.id_of[raw(a)], self.id_of[raw(b)]
            to = self.id_of[raw(a) + raw(b)]
            if ia << 32 | ib not in self.joined:
                self.joined[ia << 32 | ib] = to
            if self.halves[to] == (to, to):
                self.halves[to] = (ia, ib)
        first = min(i for b, i in self.id_of.items() if len(b) > 1)
        if any(i > first for b, i in self.id_of.items() if len(b) == 1):
            raise ValueError("single bytes must come before merged tokens")
        self.shorter: list[int] = [-1] * n
        for b, i in self.id_of.items():
            for k in range(len(b) - 1, 0, -1):
                if (j := self.id_of.get(b[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.automaton.add_word(b[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(PRE_SPLIT).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.fits: dict[int, bool] = {}
        self.blob = b"".join(self.bytes_of)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])]).tolist()

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand behind ``left``: no merge across the seam comes before theirs."""
        key = left << 32 | right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = 1 << 31
        while True:
            if self.joined.get(a << 32 | b, limit) < limit:
                return False
            # undo the later of the two merges next to the seam; what it made bounds what may join
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def piece(self, data: bytes) -> list[int]:
        n = len(data)
        if (whole := self.id_of.get(data)) is not None:
            return [whole]
        longest = [-1] * n
        for end, token in self.automaton.iter(data[::-1].decode("latin-1")):
            at = n - 1 - end
            if longest[at] < 0 or len(self.bytes_of[token]) > len(self.bytes_of[longest[at]]):
                longest[at] = token
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = pos + len(self.bytes_of[token])
                if open_[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    pos = end
                    token = longest[end] if end < n else -1
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                    continue
                open_[pos] = 0
                out.pop()
                pos -= len(self.bytes_of[last])
                token = last
                # the token before is tried again, shorter: its end is closed now
                break
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                data = piece.encode("utf-8", "surrogatepass")
                ids = tuple(self.piece(data))
                if len(data) <= CACHED_BYTES:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        blob, at = self.blob, self.offsets
        return b"".join([blob[at[i] : at[i + 1]] for i in ids]).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


_built: dict[str, Encoder] = {}


def _held(path: str, shared: Broadcast) -> Encoder:
    """Built once in a worker, from what the driver read: executors need no vocabulary folder."""
    if path not in _built:
        _built.clear()
        _built[path] = Encoder(shared.value)
    return _built[path]


def _shared(df: DataFrame, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary, some MB


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, ids)`` of every row, in one narrow stage; an empty list for null and empty text.

    A null key is kept; repeated rows are encoded each; texts of any length are encoded whole.
    """
    path = f"{folder}/{name}.json"
    shared = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _held(path, shared).encode
        for batch in batches:
            # pieces of a batch, so that few very long texts do not swell one output batch
            texts = batch.column(1).to_pylist()
            ids = [encode(x) for x in texts]
            flat = np.fromiter((i for x in ids for i in x), np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id BIGINT, ids ARRAY<INT>")


def decoded(df: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, text)`` back from ``(doc_id, ids)``; null ids give null, an empty list the empty text."""
    path = f"{folder}/{name}.json"
    shared = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _held(path, shared).decode
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id BIGINT, text STRING")
