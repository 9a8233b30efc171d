"""Texts cut by a field limit or a broken transfer (problem 10).

1. Lengths are recomputed under several encodings (characters, bytes, UTF-16 units,
   HTML escapes, JSON escapes, CRLF line ends) and counted by source, each different
   text once.  A hidden storage limit shows as a heap of texts: at the greatest length
   of one measure, or at any length that far more texts have than its neighbours
   (a limit that was raised later, or that some texts escaped).
2. Endings are inspected: how often the corpus ends a sentence behind the last
   words of a text, and how often it goes on, is counted over all texts, exactly:
   the counts of 1- to 5-word n-grams are a table by their 64-bit digests, joined to
   the last words that the texts ask for.  Words that the corpus hardly knows, numbers,
   codes and links enter by their shape, so that the middle of a word, number or link
   is told from its end.
3. A text is cut if its ending seldom ends a sentence; at a limit less is asked.

The texts are read twice, in narrow stages, and never shuffled: once for lengths and
words, once for the counts and the questions together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlane.session import written

#: n-grams, and words, that a task holds before it hands their counts on.
HELD = 1_000_000
#: A heap at a limit: this share of a source's different texts, and this many at least, within LIMIT_SLACK units of the limit.
LIMIT_SHARE, LIMIT_LEAST, LIMIT_SLACK = 0.02, 5, 3
#: Below the greatest length a heap has this many texts at least, so many times those that the NEAR lengths on either side let expect, and so many deviations more.
SPIKE_LEAST, SPIKE, DEVIATIONS, NEAR = 20, 4.0, 8.0, 25
#: Bounds that may be broadcast; they are joined by source if there are more.
MAX_BOUNDS = 50_000
#: Below this probability of a sentence's end a text is cut; the second holds at a limit.
END_ELSEWHERE, END_AT_LIMIT = 0.1, 0.997
#: A word is known from this share of all words on, and from this many uses.
KNOWN_SHARE, KNOWN_LEAST = 2e-5, 5
_PRIOR = 1.0
#: What is left of the probability behind a lower-case word that the corpus does not know.
UNKNOWN_WORD = 0.15
#: Words that an ending is judged by, at most.
DEPTH = 5

_CONTROL = re.compile("[\x00-\x07\x0b\x0e-\x1f]")


def _escaped(t: str) -> int:
    """Characters that JSON adds to a text, letters beyond ASCII as they are."""
    more = t.count('"') + t.count("\\") + t.count("\n") + t.count("\r") + t.count("\t") + t.count("\b") + t.count("\f")
    return more + (0 if t.isprintable() else 5 * len(_CONTROL.findall(t)))


def _bytes(t: str) -> int:
    return len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))


def _utf16(t: str) -> int:
    return len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2


def _html(t: str) -> int:
    return len(t) + 4 * t.count("&") + 3 * (t.count("<") + t.count(">")) + 5 * (t.count('"') + t.count("'"))


def _json_ascii(t: str) -> int:
    if t.isascii():
        return len(t) + _escaped(t) + 5 * t.count("\x7f")
    # six characters for each UTF-16 unit beyond ASCII
    plain = len(t.encode("ascii", "ignore"))
    return plain + 6 * (_utf16(t) - plain) + _escaped(t) + 5 * t.count("\x7f")


MEASURES = {
    "chars": len,
    "bytes": _bytes,
    "utf16": _utf16,
    "html": _html,
    "json": lambda t: len(t) + _escaped(t),
    "json_ascii": _json_ascii,
    "crlf": lambda t: len(t) + t.count("\n"),
    "crlf_bytes": lambda t: _bytes(t) + t.count("\n"),
}

_MARK = re.compile(r"[\s�]*(?:\[?\s*(?:\.\.\.|…|\.\.)\s*\]?|[\[(<]\s*(?:more|read more|truncated|cut|continued)\W*)?[\s�]*$", re.I)
_PIECE = re.compile(r"[⺀-〿぀-ヿ㐀-鿿豈-﫿]|[^\s⺀-〿぀-ヿ㐀-鿿豈-﫿]+")
_EMOJI = re.compile("[←-⇿⌀-➿⬀-⯿\U0001f000-\U0001faff\U0001f3fb-\U0001f3ff️‍]+$")
_STRIP = "\"'“”‘’«»()[]{}<>*_`,;:!?.。，；：！？、…-–—•|/~@"
_CLOSE = "\"'”’»)]}*_`"
_URL = re.compile(r"^(?:https?://|www\.)|^[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/|$)", re.I)
_CAMEL = re.compile(r"^[^\W\d_]+?(?=[A-Z][a-z]+$)")


def spell(token: str) -> tuple[str, bool]:
    """The token as counted, and whether it is a plain word."""
    if _URL.match(token) and len(token) > 3:
        tail = token.rstrip("/").rsplit("/", 1)[-1] if "/" in token.split("://")[-1] else "." + token.rsplit(".", 1)[-1]
        deep = token.split("://")[-1].count("/")
        return "U" + str(min(deep, 1)) + (re.sub("[^\\W\\d_]+", "a", re.sub(r"\d", "9", tail)) if deep else tail), False
    bare = token.strip(_STRIP)
    if not bare:
        return token[:3], False
    if any(c.isdigit() for c in bare):
        if re.fullmatch(r"[A-Z0-9]*[A-Z][A-Z0-9]*", bare) and len(bare) >= 5 and not re.fullmatch(r"TX\d+|PHP\d+|P\d+", bare):
            return "#", False
        return re.sub(r"[^\W\d_]", lambda m: m[0] if m[0] in "PHTXapmAPM" else "a" if m[0].islower() else "A", re.sub(r"\d", "9", bare)), False
    if (m := _CAMEL.match(bare)) and m.end() > 1:
        bare = bare[m.end() :]
        return "~" + bare.lower(), True
    return bare.lower(), True


def tokens(text: str) -> list[str]:
    return _PIECE.findall(text)


def word_counts(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for t, n in Counter(t for x in texts for t in tokens(x)).items():
        word, plain = spell(t)
        if plain:
            out[word] += n
    return out


def ends_sentence(token: str) -> int:
    """1: a sentence ends behind the token; 0: it goes on; -1: cannot be told."""
    t = token.rstrip(_CLOSE)
    if t.endswith(("...", "…", "..")):
        return -1
    if t.endswith((".", "?", "!", "。", "？", "！")):
        return 1
    return 0


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Stands before the first word of a sentence in an n-gram.
_START = np.uint64(0xD1B54A32D192ED03)


def joined(gram: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The digest of an n-gram with one more word in front; both may be arrays."""
    with np.errstate(over="ignore"):
        h = (gram * _ODD) ^ before
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)


#: What is known of a token: the digest of its shape, as ``ends_sentence``, and flags.
ENDS_OTHERS, BARE, KNOWN, LOWER, UNKNOWN_PLAIN = 1, 2, 4, 8, 16


class Speech:
    """Tokens as numbers, given the words that the corpus knows; held up to a bound."""

    def __init__(self, known: frozenset[str], most: int = 500_000) -> None:
        self.known, self.most = known, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.shape: list[int] = []
        self.ends: list[int] = []
        self.flags: list[int] = []

    def learn(self, token: str) -> int:
        word, plain = spell(token)
        if plain and word not in self.known:
            bare = token.strip(_STRIP)
            word = "N~" if word[0] == "~" else "N" if bare[:1].isupper() else "w"
        flags = ENDS_OTHERS if token in "。？！" or _EMOJI.fullmatch(token) else 0
        flags |= BARE if token in "。？！" or not token.strip(_STRIP) else 0
        flags |= KNOWN if word not in ("w", "N", "N~") else 0
        flags |= LOWER if token[0].islower() else 0
        flags |= UNKNOWN_PLAIN if word == "w" else 0
        i = self.at[token] = len(self.shape)
        self.shape.append(xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")))
        self.ends.append(ends_sentence(token))
        self.flags.append(flags)
        return i

    def numbers(self, tokens: list[str]) -> list[int]:
        at, learn = self.at, self.learn
        return [i if (i := at.get(t)) is not None else learn(t) for t in tokens]


def ending_counts(texts: list[str], at_limit: list[bool], speech: Speech) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(digest, ends, goes)`` of the n-grams of some texts: how often a sentence ends behind each, and how often it goes on.

    No n-gram reaches over the beginning of its sentence.
    """
    if len(speech.at) > speech.most:
        speech.clear()
    ids: list[int] = []
    sizes: list[int] = []  # of each line
    closing: list[int] = []  # 0: not the last line of its text, 1: the last, 2: the last of a text at a limit
    for text, limited in zip(texts, at_limit):
        lines = [x for line in text.split("\n") if (x := tokens(line))]
        for line in lines:
            ids += speech.numbers(line)
            sizes.append(len(line))
        if lines:
            closing += [0] * (len(lines) - 1) + [2 if limited else 1]
    empty = np.zeros(0, np.int64)
    if not ids:
        return empty, empty, empty
    at = np.array(ids)
    shape = np.array(speech.shape, np.uint64)[at]
    ends, flags = np.array(speech.ends, np.int8)[at], np.array(speech.flags, np.uint8)[at]
    size = np.array(sizes)
    line_end = np.zeros(len(at), bool)
    lasts = np.cumsum(size) - 1
    line_end[lasts] = True
    kind = np.array(closing)
    bare = (flags & BARE) > 0
    # within a line
    behind = np.append(flags[1:], 0)
    e = np.where(~line_end & (ends == 0) & ((behind & ENDS_OTHERS) > 0), 1, ends)
    # at a line's end without a mark: told by a word that is known and by what comes behind
    open_end = np.where(kind == 0, (np.append(flags, 0)[lasts + 1] & LOWER) == 0, kind == 1)
    told = ((flags[lasts] & KNOWN) > 0) & open_end
    e[lasts] = np.where(ends[lasts] != 1, np.where(told, 1, -1), np.where(kind == 2, -1, 1))
    e[bare] = -1
    begins = np.ones(len(at), bool)
    begins[1:] = line_end[:-1] | (ends[:-1] != 0) | bare[:-1]
    here = np.arange(len(at))
    first = np.maximum.accumulate(np.where(begins, here, 0))
    counted = e >= 0
    here, first, gram, ended = here[counted], first[counted], shape[counted], e[counted] == 1
    grams, final = [gram], [ended]
    for k in range(1, DEPTH):
        deep = here - k >= first - 1
        here, first, gram, ended = here[deep], first[deep], gram[deep], ended[deep]
        if not len(here):
            break
        inside = here - k >= first
        gram = joined(gram, np.where(inside, shape[np.maximum(here - k, 0)], _START))
        grams.append(gram)
        final.append(ended)
    return summed(np.concatenate(grams).view(np.int64), f := np.concatenate(final).astype(np.int64), 1 - f)


def summed(keys: np.ndarray, ends: np.ndarray, goes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, ends, goes
    return keys[first], np.add.reduceat(ends[order], first), np.add.reduceat(goes[order], first)


def asked(text: str, limited: bool, speech: Speech) -> tuple[float | None, list[int] | None, bool, bool]:
    """``(probability, grams, unknown, point)``: how sure it is that ``text`` ends where a sentence ends.

    Where the form of the ending does not tell, the probability is None and ``grams``
    are the digests of the n-grams at the end, shortest first.
    """
    sure = lambda p: (p, None, False, False)
    if text.rstrip().endswith("\ufffd"):
        return sure(0.0)
    t = _MARK.sub("", text)
    marked = t != text.rstrip()
    if not t:
        return sure(1.0)
    if _EMOJI.search(t) or t.endswith((":)", ":(", ":D", ";)")):
        return sure(1.0)
    toks = tokens(t.rsplit("\n", 1)[-1])
    last = toks[-1] if toks else ""
    if last.startswith("#") and len(last) > 2 and not last[1:].isdigit():
        return sure(1.0)
    closed = t.rstrip(_CLOSE)
    if closed.endswith(("?", "!", "。", "？", "！")) or re.search(r"\(\s*\d+\s*/\s*\d+\s*\)$", t):
        return sure(1.0)
    if closed.endswith(".") and not marked:
        # at a limit the point may stand inside a number or a link
        inside = any(c.isdigit() for c in last) or ("." in last.rstrip(".") and _URL.match(last.rstrip(".")))
        if not (limited and inside):
            return sure(1.0)
    ids = speech.numbers(toks[-DEPTH:])
    grams = [gram := np.uint64(speech.shape[ids[-1]])]
    for k in range(1, DEPTH):
        before = ids[-1 - k] if k < len(ids) else None
        if before is None or speech.ends[before] or speech.flags[before] & BARE:
            grams.append(joined(gram, _START))
            break
        grams.append(gram := joined(gram, np.uint64(speech.shape[before])))
    return None, [int(g.view(np.int64)) for g in grams], bool(speech.flags[ids[-1]] & UNKNOWN_PLAIN), closed.endswith(".") and not marked


def _stripped(text: str) -> str:
    return text.rstrip("\ufffd")


def first_pass(docs: DataFrame) -> DataFrame:
    """``(source, digest, lengths, n)``: a row for each text with its digest and its length in each measure, and rows of
    word counts, with the word as ``source`` and no digest: one pass for both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def rows(source: list, digest: list, lengths: list, n: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(digest, pa.int64()), pa.array(lengths, pa.list_(pa.int64())), pa.array(n, pa.int64())], ["source", "digest", "lengths", "n"])

        def counted() -> pa.RecordBatch:
            out = rows(list(words), [None] * len(words), [None] * len(words), list(words.values()))
            words.clear()
            return out

        for batch in batches:
            texts = batch.column(2).to_pylist()
            bare = [_stripped(t) for t in texts]
            digests = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts]
            yield rows(batch.column(1).to_pylist(), digests, [[f(t) for f in MEASURES.values()] for t in bare], [1] * len(texts))
            words.update(word_counts(texts))
            if len(words) > HELD:
                yield counted()
        yield counted()

    return docs.mapInArrow(run, "source STRING, digest BIGINT, lengths ARRAY<BIGINT>, n BIGINT")


def known_words(first: DataFrame) -> frozenset[str]:
    """The words that the corpus knows: at most 1 / ``KNOWN_SHARE``, since each has that share of all uses or, in a small corpus, ``KNOWN_LEAST`` uses."""
    words = written(first.where("digest IS NULL").groupBy("source").agg(F.sum("n").alias("n")), "cut-words")
    least = max(KNOWN_LEAST, int(KNOWN_SHARE * (words.agg(F.sum("n")).first()[0] or 0)))
    return frozenset(words.where(F.col("n") >= least).select("source").toArrow()["source"].to_pylist())


def probabilities(questions: DataFrame, counts: DataFrame) -> DataFrame:
    """``(last, p)`` of every distinct ending asked for, by its longest n-gram: each longer n-gram outweighs the shorter by its count.

    ``counts(key, final, going)`` has each n-gram once; ``questions(last, grams)``.
    """
    each = questions.groupBy("last").agg(F.first("grams").alias("grams")).select("last", F.posexplode("grams").alias("k", "key"))
    told = each.join(counts, "key", "left").select("last", F.struct("k", F.coalesce("final", F.lit(0)).alias("f"), F.coalesce("going", F.lit(0)).alias("g")).alias("x"))
    p = F.aggregate("xs", F.lit(0.05), lambda p, x: (x["f"] + _PRIOR * p) / (x["f"] + x["g"] + _PRIOR))
    # DEPTH entries at most
    return told.groupBy("last").agg(F.sort_array(F.collect_list("x")).alias("xs")).select("last", p.alias("p"))


def limits(first: DataFrame) -> DataFrame:
    """``(source, measure, bound, at_limit, texts)``: the hidden limits found; a text counts once however often it is repeated."""
    once = first.where("digest IS NOT NULL").groupBy("source", "digest").agg(F.first("lengths").alias("lengths"))
    names = F.array(*[F.lit(m) for m in MEASURES])
    each = once.select("source", F.explode(F.arrays_zip(names.alias("measure"), F.col("lengths").alias("value"))).alias("x")).select("source", "x.measure", "x.value")
    lengths = each.groupBy("source", "measure", "value").agg(F.count("*").alias("n"))  # from here on counts by length, not texts
    by = Window.partitionBy("source", "measure")
    around = lambda a, b: F.coalesce(F.sum("n").over(by.orderBy("value").rangeBetween(a, b)), F.lit(0))
    near = LIMIT_SLACK + NEAR
    seen = lengths.select(
        "*", F.sum("n").over(by).alias("texts"), F.max("value").over(by).alias("most"), around(-LIMIT_SLACK, 0).alias("at_limit"),
        around(-near, -LIMIT_SLACK - 1).alias("below"), around(1, NEAR).alias("above"), around(1, LIMIT_SLACK).alias("beyond"),
    )
    expected = F.greatest("below", "above") * ((LIMIT_SLACK + 1) / NEAR)
    spike = (F.col("at_limit") >= F.greatest(F.lit(float(SPIKE_LEAST)), SPIKE * expected)) & (F.col("at_limit") >= expected + DEVIATIONS * F.sqrt(F.greatest(expected, F.lit(1.0)))) & (F.col("n") > F.col("beyond"))
    heap = (F.col("at_limit") >= LIMIT_LEAST) & (F.col("at_limit") >= LIMIT_SHARE * F.col("texts"))
    return seen.where(heap & ((F.col("value") == F.col("most")) | spike)).select("source", "measure", F.col("value").alias("bound"), "at_limit", "texts")


def _at_limit(text: str, bounds: list[tuple[str, int]] | None) -> bool:
    if not bounds:
        return False
    text = _stripped(text)
    return any(b - LIMIT_SLACK <= MEASURES[m](text) <= b for m, b in bounds)


_JUDGED = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("at_limit", pa.bool_()), ("sure", pa.float64()), ("grams", pa.list_(pa.int64())), ("unknown", pa.bool_()), ("point", pa.bool_())]
    + [("key", pa.int64()), ("final", pa.int64()), ("going", pa.int64())]
)


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, end_probability, at_limit, cut)`` of every document that has a text.

    Null, empty and blank texts are not cut; a null source counts as a source of its own,
    shown as ""; repeated documents are judged each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    src = docs.where(F.col(text).isNotNull() & F.col(text).rlike("\\S")).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    first = written(first_pass(src), "cut-first")
    bounds = written(limits(first).groupBy("source").agg(F.collect_list(F.struct("measure", "bound")).alias("bounds")), "cut-bounds")
    few = bounds.agg(F.coalesce(F.sum(F.size("bounds")), F.lit(0))).first()[0] <= MAX_BOUNDS
    dealt = src.join(F.broadcast(bounds) if few else bounds, "source", "left").select("doc_id", "source", "text", "bounds")
    known_b = spark.sparkContext.broadcast(known_words(first))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speech = Speech(known_b.value)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def counted() -> pa.RecordBatch:
            key, ends, goes = summed(*(np.concatenate(x) for x in zip(*held))) if held else ((), (), ())
            held.clear()
            none = pa.nulls(len(key))
            columns = [none, none, none, none, none, none, none, pa.array(key, pa.int64()), pa.array(ends, pa.int64()), pa.array(goes, pa.int64())]
            return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _JUDGED.types)], schema=_JUDGED)

        for batch in batches:
            texts = batch.column(2).to_pylist()
            bounds = [x and [(y["measure"], y["bound"]) for y in x] for x in batch.column(3).to_pylist()]
            limited = [_at_limit(t, b) for t, b in zip(texts, bounds)]
            for i in range(0, len(texts), 2000):
                held.append(ending_counts(texts[i : i + 2000], limited[i : i + 2000], speech))
                if sum(len(x) for x, _, _ in held) > HELD:
                    held[:] = [summed(*(np.concatenate(x) for x in zip(*held)))]
                    if len(held[0][0]) > HELD // 2:
                        yield counted()
            p, grams, unknown, point = zip(*(asked(t, x, speech) for t, x in zip(texts, limited))) if texts else ((), (), (), ())
            none = pa.nulls(len(texts), pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(limited, pa.bool_()), pa.array(p, pa.float64()), pa.array(grams, pa.list_(pa.int64())), pa.array(unknown, pa.bool_()), pa.array(point, pa.bool_()), none, none, none]
            yield pa.RecordBatch.from_arrays(columns, schema=_JUDGED)
        yield counted()

    both = written(dealt.mapInArrow(judge, "doc_id BIGINT, source STRING, at_limit BOOLEAN, sure DOUBLE, grams ARRAY<BIGINT>, unknown BOOLEAN, point BOOLEAN, key BIGINT, final BIGINT, going BIGINT"), "cut-judged")
    counts = both.where("key IS NOT NULL").groupBy("key").agg(F.sum("final").alias("final"), F.sum("going").alias("going"))
    questions = both.where("key IS NULL").drop("key", "final", "going").withColumn("last", F.element_at("grams", -1))
    open_ = questions.where("last IS NOT NULL").drop("grams").join(probabilities(questions.where("last IS NOT NULL"), counts), "last")
    # no word of the corpus: rather the beginning of one
    p = F.col("p") * F.when(F.col("unknown"), UNKNOWN_WORD).otherwise(1.0)
    told = open_.withColumn("p", F.when(F.col("point") & (p > 0.5), F.greatest(p, F.lit(0.998))).otherwise(p))
    all_ = questions.where("last IS NULL").withColumn("p", F.col("sure")).select("doc_id", "source", "at_limit", "p").unionByName(told.select("doc_id", "source", "at_limit", "p"))
    cut = F.col("p") < F.when(F.col("at_limit"), END_AT_LIMIT).otherwise(END_ELSEWHERE)
    return all_.select("doc_id", "source", F.col("p").alias("end_probability"), "at_limit", cut.alias("cut"))


def rates(judgements: DataFrame) -> DataFrame:
    """``(source, texts, cut, at_limit, rate)`` of each source."""
    n = lambda c: F.sum(F.col(c).cast("int"))
    return judgements.groupBy("source").agg(F.count("*").alias("texts"), n("cut").alias("cut"), n("at_limit").alias("at_limit")).withColumn("rate", F.col("cut") / F.col("texts"))
