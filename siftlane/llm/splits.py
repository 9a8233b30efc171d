"""Same or nearly the same records in two splits (problem 6).

Content-defined chunks: a rolling hash runs over the words of a record's common form
from every word on, and cuts the chunk as soon as the corpus knows the run ``RARE``
times at most (by a sketch of all runs), else after ``LONGEST`` words.  Where a chunk
ends thus follows from its own words alone.  Chunk digests are joined across the
splits, shared chunk lengths are summed into overlap fractions, and an exact word edit
distance confirms.

Chunks overlap, one for each word: of chunks side by side each edit breaks two or more,
so that at 15 % of edits two like records need not share one.  Of these chunks an edit
breaks those that cover it.  With ``D`` the most that a record's allowed edits can break
and ``K`` chunks, ``K - D`` are shared with any like record; if that is positive, the
rarest shared one is among the ``D + 1`` rarest of both (prefix filter over one global
order), and only these are joined.  Records where it is not (the shortest) are cut at
mean length one as well: of their words ``e + 1`` are joined.  So no pair is missed.
The sketch only sets lengths and order: its collisions cost time, never a pair.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions.text import strip
from siftlane.llm import commonform as cf
from siftlane.llm.copies import with_forms
from siftlane.session import written

MAX_DIFFERENCE = 0.15
#: Counters of the sketch of runs, 4 bytes each; the only thing sent to the driver and broadcast.
SKETCH_BITS = 20
SKETCH = 1 << SKETCH_BITS
BLOCKS = 64
#: A chunk is cut where its run of words is so rare, or so long.
RARE, LONGEST = 8, 3
#: A chunk met more often than this is dealt over one salt for each such number, up to a bound.
HOT, MOST_SALTS = 2_000, 64


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolled(words: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(hash, whole)`` of the runs of 1 to ``LONGEST`` words from each word on; ``whole`` where the record has so many."""
    out = [(mixed(words), np.ones(len(words), bool))]
    h = words
    for k in range(1, LONGEST):
        h = h * _ODD
        h[: len(h) - k] ^= words[k:]
        whole = np.zeros(len(words), bool)
        whole[: len(words) - k] = row[k:] == row[: len(row) - k]
        out.append((mixed(h), whole))
    return out


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


class Hashes:
    """Word hashes of many records at once, remembered up to a bound."""

    def __init__(self, most: int = 300_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(hash of each word, number of words of each record)``."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        flat: list[int] = []
        sizes: list[int] = []
        for form in forms:
            words = cf.words_of_form(form)
            sizes.append(len(words))
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = word_hash(w)
                flat.append(h)
        return np.array(flat, np.uint64), np.array(sizes, np.int64)


def frequencies(forms: DataFrame) -> np.ndarray:
    """How often each run of 1 to ``LONGEST`` words stands in the records, hashed into ``SKETCH`` counters."""
    per = SKETCH // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        hashes = Hashes()
        for batch in batches:
            words, sizes = hashes(batch.column(0).to_pylist())
            if len(words):
                for h, whole in rolled(words, np.repeat(np.arange(len(sizes)), sizes)):
                    total += np.bincount(slots(h[whole]), minlength=SKETCH)
        packed = [zlib.compress(np.minimum(total[i * per : (i + 1) * per], 2**31 - 1).astype(np.int32).tobytes(), 1) for i in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], ["block", "packed"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in rows["packed"].to_pylist())
        return pa.table({"block": rows["block"][:1], "packed": pa.array([zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)], pa.binary())})

    kind = "block INT, packed BINARY"
    out = np.zeros(SKETCH, np.int32)
    for r in forms.select("form").mapInArrow(count, kind).groupBy("block").applyInArrow(added, kind).collect():  # BLOCKS rows
        out[r["block"] * per : (r["block"] + 1) * per] = np.frombuffer(zlib.decompress(r["packed"]), np.int32)
    return out


class Chunks:
    """The chunks of many records: ``start``, ``size``, ``digest`` and corpus ``count`` of each, ``row`` its record."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
        row = np.repeat(np.arange(len(sizes)), sizes)
        self.size = np.zeros(len(words), np.int64)
        self.digest = np.zeros(len(words), np.uint64)
        self.count = np.zeros(len(words), np.int64)
        for k, (h, whole) in enumerate(rolled(words, row), 1):
            met = counts[slots(h)]
            here = whole & (self.size == 0) & ((met <= RARE) | (k == LONGEST))
            self.size[here], self.digest[here], self.count[here] = k, h[here], met[here]
        kept = self.size > 0  # the last words of a record open none if they are common
        self.start = np.flatnonzero(kept)
        self.size, self.digest, self.count, self.row = self.size[kept], self.digest[kept], self.count[kept], row[kept]

    def covering(self, n: int) -> np.ndarray:
        """How many chunks cover each of ``n`` words."""
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, self.start, 1)
        np.add.at(step, self.start + self.size, -1)
        return np.cumsum(step[:-1])


def ranks(group: np.ndarray) -> np.ndarray:
    """The place of each entry within its run of equal values."""
    here = np.arange(len(group))
    begins = np.ones(len(group), bool)
    begins[1:] = group[1:] != group[:-1]
    return here - np.maximum.accumulate(np.where(begins, here, 0))


def rarest(row: np.ndarray, digest: np.ndarray, count: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(entries, occurrence)``: the ``most[row]`` first of each record in the global order; the k-th time of a digest is an entry of its own."""
    order = np.lexsort((digest, row))
    nth = np.empty(len(row), np.int64)
    nth[order] = ranks(np.stack([row[order].astype(np.uint64), digest[order]], 1).view("u8,u8").ravel()) if len(row) else nth
    order = np.lexsort((digest, nth, count, row))
    first = order[ranks(row[order]) < most[row[order]]]
    return first, nth[first]


def overlap(a: str, b: str, counts: np.ndarray) -> float:
    """The share of the longer record's words that lie in chunks of the other record too."""
    words, sizes = Hashes()([a, b])
    c = Chunks(words, sizes, counts)
    shared = np.isin(c.digest, np.intersect1d(c.digest[c.row == 0], c.digest[c.row == 1]))
    c.start, c.size = c.start[shared], c.size[shared]
    inside = c.covering(len(words)) > 0
    return float(max(inside[: sizes[0]].sum(), inside[sizes[0] :].sum()) / max(1, sizes.max())) if sizes[0] != sizes[1] else float(inside[: sizes[0]].sum() / max(1, sizes[0]))


def allowed(n: int, most: float = MAX_DIFFERENCE) -> int:
    """The most words that may differ where the longer record has ``n``."""
    return int(most * n + 1e-9)


def distance(a: list[str], b: list[str], most: int) -> int:
    """Word edit distance, bit-parallel over the words of ``a``; above ``most`` any larger number."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b))
    at: dict[str, int] = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << k)
    m = len(a)
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for w in b:
        eq = at.get(w, 0)
        x = eq | down
        diag = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(diag | up))
        minus = up & diag
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = ((plus << 1) | 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(x | plus))
        down = plus & x
    return score


def prefixes(forms: list[str], counts: np.ndarray, most: float, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """``(record, key, size in words, corpus count)`` of the chunks that are joined, and the ``words, bits`` of each record.

    ``bits`` are 64 bits of its set of words.  Records of which no word may differ have none: like ones are the same.
    """
    words, sizes = hashes(forms)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # of the longer of two like records
    edits = (most * np.floor(sizes / (1 - most) + 1e-9) + 1e-9).astype(np.int64)
    c = Chunks(words, sizes, counts)
    covered = c.covering(len(words))
    order = np.lexsort((-covered, row))
    worst = ranks(row[order]) < edits[row[order]]
    broken = np.bincount(row[order][worst], covered[order][worst], len(sizes)).astype(np.int64)
    number = np.bincount(c.row, minlength=len(sizes))
    live = edits[c.row] > 0
    row_c, digest, size, count = c.row[live], c.digest[live], c.size[live], c.count[live]
    at, nth = rarest(row_c, digest, count, broken + 1)
    found = [(row_c[at], mixed(digest[at] + nth.astype(np.uint64) * _ODD), size[at], count[at])]
    weak = (number <= broken) & (edits > 0)
    if weak.any():
        single = weak[row]
        row_w, word = row[single], words[single]
        met = counts[slots(mixed(word))]
        at, nth = rarest(row_w, word, met, edits + 1)
        found.append((row_w[at], mixed(mixed(word[at]) + nth.astype(np.uint64) * _ODD), np.ones(len(at), np.int64), met[at]))
    bits = np.zeros(len(sizes), np.uint64)
    np.bitwise_or.at(bits, row, np.uint64(1) << (words >> np.uint64(58)))
    return *(np.concatenate(x) for x in zip(*found)), sizes, bits


def _keys(classes: DataFrame, counts: np.ndarray, most: float, every_salt: bool) -> DataFrame:
    """``(key, cid, size, n, bits)``: the chunks of each record that are joined.

    With each go the record's length and bits, by which unlike records part inside the
    join, before any text is fetched.  A hot chunk is dealt over salts by its record, or
    stands once for each salt on the other side.
    """
    shared = classes.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            row, key, size, count, n, bits = prefixes(batch.column(1).to_pylist(), shared.value, most, hashes)
            salts = np.clip(count // HOT, 1, MOST_SALTS)
            if every_salt:
                row, key, size = (np.repeat(x, salts) for x in (row, key, size))
                salt = ranks(np.repeat(np.arange(len(salts)), salts))
            else:
                salt = (mixed(ids[row].astype(np.uint64)) % salts.astype(np.uint64)).astype(np.int64)
            key = mixed(key + salt.astype(np.uint64) * _ODD)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row]), pa.array(size.astype(np.int8)), pa.array(n[row].astype(np.int32)), pa.array(bits[row].view(np.int64))], ["key", "cid", "size", "n", "bits"])

    return classes.select("cid", "form").mapInArrow(run, "key BIGINT, cid BIGINT, size TINYINT, n INT, bits BIGINT")


def _verify(pairs: DataFrame, counts: np.ndarray, most: float) -> DataFrame:
    """Overlap fraction by chunks and exact difference of each candidate; keeps the true ones."""
    shared = pairs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, over, diff = [], [], [], []
            for ca, cb, fa, fb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                wa, wb = cf.words_of_form(fa), cf.words_of_form(fb)
                size = max(len(wa), len(wb))
                e = allowed(size, most)
                if sum((Counter(wa) & Counter(wb)).values()) < size - e:
                    continue
                d = distance(wa, wb, e)
                if d <= e:
                    a.append(ca)
                    b.append(cb)
                    over.append(overlap(fa, fb, shared.value))
                    diff.append(d / size)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(over, pa.float64()), pa.array(diff, pa.float64())], ["ca", "cb", "overlap", "difference"])

    return pairs.select("ca", "cb", "fa", "fb").mapInArrow(run, "ca BIGINT, cb BIGINT, overlap DOUBLE, difference DOUBLE")


def spelt(label: Column) -> Column:
    """A label in one spelling; null where it is missing or blank."""
    t = F.lower(strip(label))
    return F.when(t.isin("1", "phishing"), "1").when(t.isin("0", "legit"), "0").when(t != "", t)


def split_overlaps(df: DataFrame, id_col: str = "row_id", text_col: str = "text", split_col: str = "split_name", source_col: str = "source", label_col: str = "label", train: tuple[str, ...] = ("train",), held: tuple[str, ...] = ("validation", "test"), most: float = MAX_DIFFERENCE) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``.

    ``links(ca, cb, overlap, difference)``: records of the training split ``ca`` and of a
    held-out split ``cb`` that are the same or differ in at most ``most`` of their words.
    ``members(id, cid, held, split, source, label)``: the rows of each record; a column
    that ``df`` lacks is null.  Rows of other or null splits, null texts and texts without
    words take no part; repeated rows are members each.
    """
    split = F.lower(F.trim(F.col(split_col)))
    given = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    told = (split.isin(*held).alias("held"), split.alias("split"), given(source_col).alias("source"), spelt(given(label_col)).alias("label"))
    rows = df.where(split.isin(*train, *held)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *told)
    forms = with_forms(rows, "id", "text", "held", "split", "source", "label")
    base = written(forms, "split-forms")
    classes = base.groupBy("root", "form").agg(F.min("id").alias("cid"), F.bool_or(~F.col("held")).alias("train"), F.bool_or("held").alias("held"))
    classes = written(classes, "split-classes")
    counts = frequencies(classes)
    left = _keys(classes.where("train"), counts, most, False).toDF("key", "ca", "sa", "na", "wa")
    right = _keys(classes.where("held"), counts, most, True).toDF("key", "cb", "sb", "nb", "wb")
    edits = F.floor(most * F.greatest("na", "nb") + 1e-9)
    # each differing word changes two bits of the word sets at most
    near = (F.abs(F.col("na") - F.col("nb")) <= edits) & (F.bit_count(F.col("wa").bitwiseXOR(F.col("wb"))) <= 2 * edits)
    pairs = left.join(right, "key").where(near & (F.col("ca") != F.col("cb"))).groupBy("ca", "cb").agg(F.sum("sa").alias("shared"))
    # the few pairs left are kept, so that fetching their texts does not run the join again
    pairs = written(pairs, "split-pairs")
    train_texts = classes.where("train").select(F.col("cid").alias("ca"), F.col("form").alias("fa"))
    held_texts = classes.where("held").select(F.col("cid").alias("cb"), F.col("form").alias("fb"))
    pairs = pairs.join(train_texts, "ca").join(held_texts, "cb")
    same = classes.where("train AND held").select(F.col("cid").alias("ca"), F.col("cid").alias("cb"), F.lit(1.0).alias("overlap"), F.lit(0.0).alias("difference"))
    links = _verify(pairs, counts, most).unionByName(same)
    members = base.select("id", "root", "held", "split", "source", "label").join(classes.select("root", "cid"), "root").select("id", "cid", "held", "split", "source", "label")
    return links, members


def row_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(row_id_a, row_id_b)``, the smaller first, for every two rows of linked records."""
    a = members.where(~F.col("held")).select(F.col("cid").alias("ca"), F.col("id").alias("ia"))
    b = members.where("held").select(F.col("cid").alias("cb"), F.col("id").alias("ib"))
    return links.select("ca", "cb").join(a, "ca").join(b, "cb").select(F.least("ia", "ib").alias("row_id_a"), F.greatest("ia", "ib").alias("row_id_b"))


def overlaps(links: DataFrame) -> DataFrame:
    """``(record_a, record_b, overlap, difference)`` of every two linked records: of the training split and of a held-out one.

    A record goes by its smallest row id; ``overlap`` is the share of the longer record's words in shared chunks.
    """
    return links.select(F.col("ca").alias("record_a"), F.col("cb").alias("record_b"), "overlap", "difference")


def conflicts(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every two rows of linked records whose labels are both given and not the same: the training row ``a``, the held-out row ``b``."""

    def side(held: bool, end: str) -> DataFrame:
        rows = members.where((F.col("held") == held) & F.col("label").isNotNull())
        return rows.select(F.col("cid").alias(f"c{end}"), F.col("id").alias(f"row_id_{end}"), *(F.col(c).alias(f"{c}_{end}") for c in ("split", "source", "label")))

    both = links.select("ca", "cb").join(side(False, "a"), "ca").join(side(True, "b"), "cb").where("label_a <> label_b")
    return both.select("row_id_a", "row_id_b", *(f"{c}_{end}" for c in ("split", "source", "label") for end in "ab"))


def split_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(split_name, source, n_rows, overlapping, pairs, conflicts)`` of each split and source, a null source being one.

    ``n_rows`` are the rows that take part, ``overlapping`` those with a row on the other
    side, ``pairs`` their pairs of rows, and ``conflicts`` those whose labels are both
    given and not the same.  A pair counts once in its training row's split and source
    and once in its held-out row's.  Rows are counted by record before the join.
    """
    rows = members.groupBy("cid", "held", "split", "source", "label").agg(F.count("*").alias("n"))
    by = members.groupBy("cid", "held", "label").agg(F.count("*").alias("m")).withColumnsRenamed({"cid": "other", "label": "with"})
    ends = links.select(F.col("ca").alias("cid"), F.col("cb").alias("other"), F.lit(False).alias("side")).unionByName(links.select(F.col("cb").alias("cid"), F.col("ca").alias("other"), F.lit(True).alias("side")))
    seen = ends.join(by, (ends["other"] == by["other"]) & (ends["side"] != by["held"])).groupBy("cid", "side", "with").agg(F.sum("m").alias("m"))
    # the links of a record by the label on the other side
    per = seen.groupBy("cid", F.col("side").alias("held")).agg(F.sum("m").alias("pairs"), F.sum(F.when(F.col("with").isNotNull(), F.col("m")).otherwise(0)).alias("labelled"))
    same = seen.where(F.col("with").isNotNull()).select("cid", F.col("side").alias("held"), F.col("with").alias("label"), F.col("m").alias("agree"))
    n = F.col("n")
    out = rows.join(per, ["cid", "held"], "left").join(same, ["cid", "held", "label"], "left")
    clash = F.when(F.col("label").isNotNull(), n * (F.coalesce("labelled", F.lit(0)) - F.coalesce("agree", F.lit(0)))).otherwise(0)
    return out.groupBy(F.col("split").alias("split_name"), "source").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("pairs").isNotNull(), n).otherwise(0)).alias("overlapping"), F.sum(n * F.coalesce("pairs", F.lit(0))).alias("pairs"), F.sum(clash).alias("conflicts"))
