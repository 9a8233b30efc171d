"""Language of documents and of their single-language stretches (problem 1).

Nearest-centroid classification: a text is cut at its sentence ends; every piece is
a normalised TF-IDF vector of character n-grams (within words) and whole words; it
is compared by cosine with several clustered centroids per language.  A piece too
far from every centroid, or about as near to two languages, is rejected and goes
with its neighbours: the path over the pieces of a text pays for each change of
language.  A text none of whose pieces comes near any centroid is in no language that
the samples know: it is ``und``.  A close relative of a known language goes with that one.

The centroids are trained on a bounded sample of labelled texts (``MAX_SAMPLES``
rows) on the driver and broadcast; their size does not depend on the corpus.  What
a word adds to the cosines is kept per word, so a text costs one lookup a word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm import charforms
from siftlane.llm import commonform as cf

#: The most labelled rows the centroids are trained on.
MAX_SAMPLES = 2_000
#: A first judgement below this confidence does not contradict a label.
UNSURE = 0.6
#: Groups that the unsure rows are clustered to.
OPEN_GROUPS = 12
CLUSTERS = 3
NGRAMS = (1, 2, 3, 4)
#: A piece below this cosine, or with a lead over the second language below this, is rejected.
MIN_COSINE, MIN_LEAD = 0.05, 0.02
#: A text whose best piece stays below this cosine is rejected whole, as UNKNOWN.
MIN_TEXT, UNKNOWN = 0.15, "und"
#: What a change of language costs, in units of summed word evidence.
CHANGE = 0.25
#: Sharpness of the confidence.
SHARP = 6.0
#: A piece without any sentence end is cut after so many words, to find a change inside it.
LONG_PIECE = 14
CACHED_WORDS = 200_000
#: Hashed features: two to this power; the model is as large whatever it is trained on.
SLOT_BITS = 17
#: How often the whole word counts as a feature, and what an unseen feature adds to the squared length.
WORD_WEIGHT, UNSEEN = 2, 0.05
#: The weight that a feature shared by all languages keeps.
SHARED = 0.05

_SPLIT = re.compile(r"(?<=[.!?…;])[\"'”’)\]]*\s+|(?<=[。！？；])|\n+|\s+/\s+|\s+\|\s+")
_SHORT = re.compile(r"\b((?:No|Brgy|Blk|St|Sta|Sto|Ave|Rd|Mr|Mrs|Ms|Dr|Dra|Sr|Sra|Gng|Bb|[A-Z])\b)\.", re.I)
_HAN = "㐀-鿿豈-﫿"
_HAN_RUN = re.compile(f"[{_HAN}]+|[^{_HAN}]+")
_EDGE = "\"'“”‘’«»()[]{}<>*_`,;:!?.。，；：！？、…-–—•|/~¡¿#@"
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(slots, first)``: the n-grams of each marked word, and the word itself, hashed to ``SLOTS``.

    The features of word ``i`` stand from ``first[i]`` on; all words at once.
    """
    marked = [f"^{w}$" for w in words]
    sizes = np.fromiter((len(w) for w in marked), np.int64, len(marked))
    cps = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    slots, owner = [], []
    h = np.zeros(len(cps), np.uint64)
    for n in NGRAMS:
        k = len(cps) - n + 1
        if k <= 0:
            break
        h = (h[:k] * np.uint64(1_000_003)) ^ (cps[n - 1 :] + np.uint64(n * 7919))
        whole = word[:k] == word[n - 1 :]
        if n == 1:
            whole &= (cps != 94) & (cps != 36)
        x = h[whole]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        slots.append((x >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
        owner.append(word[:k][whole])
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> (64 - SLOT_BITS) for w in words), np.int64, len(words))
    slots += [own] * WORD_WEIGHT
    owner += [np.arange(len(words))] * WORD_WEIGHT
    at = np.concatenate(owner)
    order = np.argsort(at, kind="stable")
    return np.concatenate(slots)[order], np.searchsorted(at[order], np.arange(len(words)))


def words_of(piece: str) -> list[str]:
    """Words that tell a language: no links, addresses, numbers or codes."""
    out = []
    for token in piece.split():
        t = token.strip(_EDGE)
        if not t:
            continue
        if t.isascii():
            if t.isalpha():
                out.append(t.lower())
            elif "-" in t or "'" in t:
                if not any(c.isdigit() for c in t) and "." not in t and "@" not in t:
                    out += _WORD.findall(t.lower())
            continue
        for run in _HAN_RUN.findall(t):
            if run[0] > "⿿" and "㐀" <= run[0] <= "鿿":
                out.append(run)
            elif not any(c.isdigit() for c in run) and "://" not in run and "@" not in run:
                out += _WORD.findall(run.lower())
    return out


def pieces_of(text: str) -> list[list[str]]:
    """The words of each sentence; long ones without an end are cut; a text of fields is one piece."""
    out = []
    if text.count(":") >= 4 and cf.fields(text) is not None:
        return [w] if (w := words_of(text.replace(":", " ").replace("|", " ").replace(";", " "))) else []
    text = _SHORT.sub(r"\1", text)
    for part in _SPLIT.split(text):
        if part and (w := words_of(part)):
            if len(w) > 2 * LONG_PIECE:
                n = math.ceil(len(w) / LONG_PIECE)
                out += [w[len(w) * i // n : len(w) * (i + 1) // n] for i in range(n)]
            else:
                out.append(w)
    return out


class Centroids:
    """Clustered centroids per language over TF-IDF n-grams."""

    def __init__(self, texts: list[str], langs: list[str], clusters: int = CLUSTERS, rounds: int = 12) -> None:
        pieces, owner = [], []
        for text, lang in zip(charforms.unify(texts)[0], langs):
            if words := [w for piece in pieces_of(text) for w in piece]:
                pieces.append(words)
                owner.append(lang)
        self.langs = sorted(set(langs))
        n = len(pieces)
        found = []
        for piece in pieces:
            found.append(np.unique(hashed(piece)[0], return_counts=True))
        seen = np.bincount(np.concatenate([x for x, _ in found]), minlength=1 << SLOT_BITS)
        idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
        # features of one sample only would make the matrix below wide and tell nothing
        used = np.flatnonzero(seen >= (2 if n >= 50 else 1))
        # a feature that all languages share tells little: weigh it by in how many languages, in effect, it is used
        rate = np.zeros((len(self.langs), 1 << SLOT_BITS), np.float32)
        for i, lang in enumerate(self.langs):
            own = [x for x, y in zip(found, owner) if y == lang]
            rate[i] = np.bincount(np.concatenate([x for x, _ in own]), minlength=1 << SLOT_BITS) / len(own)
        spread = rate.sum(0) ** 2 / np.maximum(1e-12, (rate**2).sum(0))
        idf *= np.where(seen > 0, np.log(len(self.langs) / np.clip(spread, 1, None)) / np.log(len(self.langs)) + SHARED, 1).astype(np.float32)
        groups = []
        kept = np.zeros(1 << SLOT_BITS, bool)
        kept[used] = True
        for lang in self.langs:
            own = [x for x, y in zip(found, owner) if y == lang]
            m = np.zeros((len(own), len(used)), np.float32)
            for k, (at, count) in enumerate(own):
                here = kept[at]
                v = count[here] * idf[at[here]]
                m[k, np.searchsorted(used, at[here])] = v / max(1e-9, np.linalg.norm(v))
            groups.append(self._cluster(m, clusters, rounds))
        lang_of = np.concatenate([np.full(len(g), i) for i, g in enumerate(groups)])
        self.starts = np.searchsorted(lang_of, np.arange(len(self.langs)))
        #: What a feature adds to the dot product with each centroid and, last, to the squared length.
        self.gain = np.zeros((1 << SLOT_BITS, len(lang_of) + 1), np.float32)
        self.gain[used, :-1] = np.concatenate(groups).T * idf[used, None]
        self.gain[:, -1] = np.where(seen > 0, 1, UNSEEN) * idf**2
        self.unit = float(np.log(1 + n) + 1)

    @staticmethod
    def _cluster(m: np.ndarray, k: int, rounds: int) -> np.ndarray:
        """Spherical k-means; the first seeds are the samples farthest apart."""
        k = min(k, len(m))
        seeds = [0]
        near = m @ m[0]
        while len(seeds) < k:
            seeds.append(int(np.argmin(near)))
            near = np.maximum(near, m @ m[seeds[-1]])
        c = m[seeds].copy()
        for _ in range(rounds):
            to = np.argmax(m @ c.T, axis=1)
            for j in range(k):
                if (to == j).any():
                    c[j] = m[to == j].sum(0)
            c /= np.maximum(1e-9, np.linalg.norm(c, axis=1, keepdims=True))
        return c


class Classifier:
    """Runs of one language of many texts at once."""

    def __init__(self, centroids: Centroids) -> None:
        self.c = centroids
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, centroids.gain.shape[1]), np.float32)

    def _learn(self, words: list[str]) -> None:
        rows = [self.table]
        for i in range(0, len(words), 20_000):
            slots, first = hashed(words[i : i + 20_000])
            rows.append(np.add.reduceat(self.c.gain[slots], first, axis=0))
        self.table = np.concatenate(rows)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text number, cosine by language, evidence by language)`` of every piece."""
        if len(self.at) > CACHED_WORDS:
            self.at.clear()
            self.table = self.table[:0]
        owner, first, ids, new = [], [], [], []
        at = self.at
        for k, text in enumerate(charforms.unify(texts)[0]):
            for piece in pieces_of(text) if text else ():
                owner.append(k)
                first.append(len(ids))
                for w in piece:
                    i = at.get(w)
                    if i is None:
                        i = at[w] = len(at)
                        new.append(w)
                    ids.append(i)
        if new:
            self._learn(new)
        n = len(self.c.langs)
        if not owner:
            return np.zeros(0, np.int64), np.zeros((0, n)), np.zeros((0, n))
        sums = np.add.reduceat(self.table[ids], first, axis=0)
        best = np.maximum.reduceat(sums[:, :-1], self.c.starts, axis=1)
        length = np.sqrt(np.maximum(sums[:, -1:], 1e-9))
        return np.array(owner), best / length, best / self.c.unit

    def runs(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """``[(language, confidence), ...]`` of the stretches of each text; none for a text that tells nothing, ``und`` where it is far from all."""
        owner, cosine, evidence = self.scores(texts)
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        if not len(owner):
            return out
        order = np.sort(cosine, axis=1)
        sure = (order[:, -1] >= MIN_COSINE) & (order[:, -1] - order[:, -2] >= MIN_LEAD)
        top = np.argmax(cosine, axis=1)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        # a rejected piece has no say of its own
        said = np.where(sure[:, None], evidence, 0.25 * evidence)
        for k in range(len(texts)):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if a == b:
                continue
            if (near := float(order[a:b, -1].max())) < MIN_TEXT:
                out[k].append((UNKNOWN, 1 - max(0.0, near) / MIN_TEXT))
                continue
            known = top[a:b][sure[a:b]]
            if len(known) and (known == known[0]).all():
                path = np.full(b - a, known[0])
            elif b - a == 1:
                path = top[a:b]
            else:
                path = self._path(said[a:b])
            start = a
            for i in range(a + 1, b + 1):
                if i == b or path[i - a] != path[start - a]:
                    lang = path[start - a]
                    e = evidence[start:i].sum(0)
                    p = np.exp(np.clip(SHARP * (e - e[lang]), -50, 50))
                    out[k].append((self.c.langs[lang], float(1 / p.sum())))
                    start = i
        return out

    @staticmethod
    def _path(said: np.ndarray) -> np.ndarray:
        best, back = said[0].copy(), []
        for row in said[1:]:
            jump = int(np.argmax(best))
            stay = best >= best[jump] - CHANGE
            back.append(np.where(stay, np.arange(len(best)), jump))
            best = np.where(stay, best, best[jump] - CHANGE) + row
        path = [int(np.argmax(best))]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1])


def fitted(texts: list[str], langs: list[str], more_texts: list[str], more_langs: list[str]) -> Centroids:
    """Centroids of the sure samples, then of these and the further rows that they bear out.

    A further row counts if its label is one of the languages and the first centroids
    agree with it, or can't tell (its words are none of theirs).
    """
    first = Centroids(texts, langs)
    if not more_texts:
        return first
    texts, langs = list(texts), list(langs)
    open_texts, open_langs = [], []
    for text, lang, runs in zip(more_texts, more_langs, Classifier(first).runs(more_texts)):
        if lang not in first.langs or len(runs) != 1:
            continue
        if runs[0][0] == UNKNOWN or runs[0][1] < UNSURE:
            open_texts.append(text)
            open_langs.append(lang)
        elif runs[0][0] == lang:
            texts.append(text)
            langs.append(lang)
    if len(open_texts) >= 2 * OPEN_GROUPS:
        # texts whose words the samples lack: alike ones take the label that most of them bear
        bags = [np.unique(hashed([w for p in pieces_of(x) for w in p] or ["?"])[0], return_counts=True) for x in charforms.unify(open_texts)[0]]
        seen = np.bincount(np.concatenate([b for b, _ in bags]), minlength=1 << SLOT_BITS)
        used = np.flatnonzero(seen >= max(2, len(bags) // 50))
        m = np.zeros((len(bags), len(used)), np.float32)
        for k, (at, count) in enumerate(bags):
            here = np.isin(at, used)
            m[k, np.searchsorted(used, at[here])] = count[here] * np.log((1 + len(bags)) / seen[at[here]])
        m /= np.maximum(1e-9, np.linalg.norm(m, axis=1, keepdims=True))
        to = np.argmax(m @ Centroids._cluster(m, OPEN_GROUPS, 12).T, axis=1)
        for g in range(OPEN_GROUPS):
            own = [k for k in range(len(bags)) if to[k] == g]
            if own:
                lang, votes = Counter(open_langs[k] for k in own).most_common(1)[0]
                if votes >= 0.6 * len(own):
                    texts += [open_texts[k] for k in own]
                    langs += [lang] * len(own)
    return Centroids(texts, langs)


def trained(samples: DataFrame, rows: DataFrame | None = None, text: str = "text", lang: str = "lang", most: int = MAX_SAMPLES) -> Centroids:
    """Centroids of ``most`` labelled samples and ``most`` labelled rows at most, chosen by the hash of their text."""

    def some(df: DataFrame) -> list:
        known = df.where((F.length(text) > 0) & (F.length(F.trim(lang)) > 0) & (F.col(lang) != "und")).select(text, lang)
        # a top-k alone would send its k rows from every task to the driver
        different = known.agg(F.approx_count_distinct(F.xxhash64(text))).first()[0]
        share = min(1.0, 4 * most / max(1, different))
        near = known.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else known
        # repeated rows are one sample
        return near.distinct().orderBy(F.xxhash64(text), text, lang).limit(most).collect()

    sure = some(samples)
    if not sure:
        raise ValueError("no labelled samples to learn languages from")
    more = some(rows) if rows is not None else []
    return fitted([r[0] for r in sure], [r[1] for r in sure], [r[0] for r in more], [r[1] for r in more])


def labelled(df: DataFrame, samples: DataFrame, id_col: str = "row_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(row_id, seg_no, lang, confidence, told)``: the stretches of every row, with the label it came with.

    Null, empty and wordless texts have no stretch and give no rows; repeated rows are
    judged each; the texts are read whole; one narrow stage, nothing is shuffled.
    """
    model = df.sparkSession.sparkContext.broadcast(trained(samples, df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))))
    src = df.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("row_id"), F.col(lang_col).cast("string").alias("told"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for key, told, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), classifier.runs(batch.column(2).to_pylist())):
                for no, (lang, sure) in enumerate(runs, 1):
                    for col, x in zip(cols, (key, no, len(runs), lang, sure, told)):
                        col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["row_id", "seg_no", "n_seg", "lang", "confidence", "told"])

    return src.mapInArrow(run, "row_id BIGINT, seg_no BIGINT, n_seg BIGINT, lang STRING, confidence DOUBLE, told STRING")


def mislabelled(stretches: DataFrame) -> DataFrame:
    """The stretches of rows whose label is missing or wrong, and of all rows in several languages."""
    told = F.lower(F.trim(F.coalesce("told", F.lit(""))))
    return stretches.where((F.col("n_seg") > 1) | (told != F.col("lang")))
