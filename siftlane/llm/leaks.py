"""Evaluation passages inside a training corpus (problem 9).

Winnowing: of the hashes of all runs of ``K`` words, the least in every window of
``WINDOW`` successive ones is a fingerprint, so two texts that share a run of
``K + WINDOW - 1`` words share a fingerprint.  Shared fingerprints give a diagonal
(position in the document less position in the item), which is then extended: the
item leaks if some stretch of at least ``MIN_WORDS`` words on the diagonal has at
most one word in ``ONE_IN`` replaced.  Such a stretch always holds an unbroken run
of six words: of 20 words two at most are replaced, which leaves three runs with
18 words, and likewise for longer stretches.  So no leak is missed.

An item of fewer than ``MIN_WORDS`` words counts where it stands whole, with at most one
word in ``ONE_IN`` replaced.  It has no window to spare: all its runs of ``K`` words (of as
many as it has, if fewer) are compared with all those of the document.  With one word
in eight replaced, and none at its ends, one of them is always unbroken.

The held-out items are the stated query set: they are dealt into blocks of bounded
size, and each block meets all documents in one narrow stage, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm import charforms
from siftlane.llm import commonform as cf

K, WINDOW = 4, 3
MIN_WORDS, ONE_IN = 20, 8
#: Most characters of item texts that one block may hold: what is broadcast stays below about 100 MB.
BLOCK_CHARS = 8_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 300_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        out = []
        for w in cf.words(text):
            h = known.get(w)
            if h is None:
                if len(known) >= self.most:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, np.uint64)


def grams(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    if len(words) < k:
        return words[:0]
    h = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        h = (h * _MIX) ^ words[i : len(words) - k + 1 + i]
    h ^= h >> np.uint64(29)
    return h * _MIX


def winnow(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """``(positions, fingerprints)``: the rightmost least gram of every window."""
    h = grams(words, k)
    if not len(h):
        return np.zeros(0, np.int64), h
    if len(h) <= window:
        at = np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
        return at, h[at]
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))
    return at, h[at]


def passage(same: np.ndarray, least: int = MIN_WORDS, one_in: int = ONE_IN) -> bool:
    """Whether some stretch of ``least`` words or more, like at both ends, has at most one in ``one_in`` unlike."""
    if len(same) < least:
        return False
    level = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - one_in))])
    # a stretch neither begins nor ends with a replaced word: that may as well be a word around a shorter quote
    start = np.where(same, level[:-1], np.iinfo(np.int64).max)
    lowest = np.minimum.accumulate(start)
    return bool((same[least - 1 :] & (level[least:] >= lowest[: len(same) - least + 1])).any())


class Items:
    """The fingerprints and words of one block of items."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        words = Words()
        self.ids = ids
        self.words = [words(x) for x in charforms.unify(texts)[0]]
        found: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}  # by run length: 0 for the fingerprints of long items
        for i, w in enumerate(self.words):
            if len(w) >= MIN_WORDS:
                found.setdefault(0, []).append((i, *winnow(w)))
            elif len(w):
                k = min(K, len(w))
                h = grams(w, k)
                found.setdefault(k, []).append((i, np.arange(len(h)), h))
        #: ``(run length, sorted hashes, item and place of each)``.
        self.indexes = []
        for k, rows in sorted(found.items()):
            h = np.concatenate([x for _, _, x in rows])
            order = np.argsort(h, kind="stable")
            owner = np.concatenate([np.full(len(x), i) for i, x, _ in rows])
            self.indexes.append((k, h[order], owner[order], np.concatenate([x for _, x, _ in rows])[order]))

    def leaked(self, words: np.ndarray) -> list[int]:
        diagonals: set[tuple[int, int]] = set()
        for k, prints, owner, place in self.indexes:
            if k:
                h = grams(words, k)
                at = np.arange(len(h))
            else:
                at, h = winnow(words)
            lo, hi = np.searchsorted(prints, h, "left"), np.searchsorted(prints, h, "right")
            met = hi > lo
            diagonals |= {(int(owner[j]), int(p) - int(place[j])) for p, a, b in zip(at[met], lo[met], hi[met]) for j in range(a, b)}
        out = set()
        for i, shift in diagonals:
            if i in out:
                continue
            item = self.words[i]
            a, b = max(0, -shift), min(len(item), len(words) - shift)
            # an item shorter than a passage counts if it is there as a whole
            least = min(MIN_WORDS, len(item))
            if b - a >= least and passage(item[a:b] == words[a + shift : b + shift], least):
                out.add(i)
        return sorted(self.ids[i] for i in out)


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list[int], list[str]]]:
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in items.toLocalIterator():
        if ids and size + len(r[1]) > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds a passage of an item.

    Null and empty texts hold and leak nothing; repeated documents count by themselves; an
    item of fewer than ``MIN_WORDS`` words, down to one, leaks where it stands whole (one word
    in eight may differ); one without any word leaks nowhere.
    """
    spark = docs.sparkSession
    src = docs.where(F.length(text) > 0).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.where(F.length(text) > 0).select(F.col(item_id).cast("long"), text)
    out = None
    for ids, texts in _blocks(asked, block_chars):
        shared = spark.sparkContext.broadcast(Items(ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, words = shared.value, Words()
            for batch in batches:
                found_docs, found_items = [], []
                unified, _ = charforms.unify(batch.column(1).to_pylist())
                for d, x in zip(batch.column(0).to_pylist(), unified):
                    hit = block.leaked(words(x))
                    found_docs += [d] * len(hit)
                    found_items += hit
                yield pa.RecordBatch.from_arrays([pa.array(found_docs, pa.int64()), pa.array(found_items, pa.int64())], ["doc_id", "item_id"])

        part = src.mapInArrow(run, "doc_id BIGINT, item_id BIGINT")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "doc_id BIGINT, item_id BIGINT")
