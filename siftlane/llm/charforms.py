"""One consistent form for text that only looks alike (problem 7).

The texts of an Arrow batch are exploded to one table of positioned code points
(row, position, code point as numpy columns).  Decompositions, compatibility
forms, combining classes and look-alikes are lookup tables indexed by code point,
so the "join" is an array gather in every task (a broadcast of fixed size, built
from the Unicode data of the interpreter by rule).  Combining marks are ordered by
class within their cluster and recomposed by a pair table, and the strings are
rebuilt.  No text is shuffled: the explosion stays inside its batch.
"""

from __future__ import annotations

import unicodedata as ud
from functools import lru_cache

import numpy as np

TOP = 0x20000  # code points from here on (rare ideographs, tags) are plain letters, but for those in Tables.high
#: Conjoining parts of Korean syllables: first code point and number of the leading, middle and closing ones; the first syllable.
LEAD, MIDDLE, CLOSE, SYLLABLE = (0x1100, 19), (0x1161, 21), (0x11A8, 27), 0xAC00

# Letters that look like a Latin letter, by script, as "foreign" -> "latin" in the same order.
CYRILLIC_LIKE = ("аеосрухіјѕһԁԛԝӏАВЕЅІЈКМНОРСТУХԌԚԜҮ", "aeocpyxijshdqwlABESIJKMHOPCTYXGQWY")
GREEK_LIKE = ("αονρυικχτγηωΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "aovpuikxtynwABEZHIKMNOPTYXCj")
OTHER_LIKE = ("ɡɑıɩӀոսօցհԼՕՏᎪᏴᏟᎬᎻᎫᏦᏞᎷᎢᏙᏃΡ", "gaiilnuoghLOSABCEHJKLMTVZP")
# Latin letters that stand for Russian letters inside Russian words.
LATIN_FOR_RUSSIAN = ("aeocpyxABEKMHOPCTYX", "аеосрухАВЕКМНОРСТУХ")

ALNUM, LETTER, LAT, LATAMB, CYR, CYRAMB, GRK, GRKAMB, OTHERAMB, MARK, ZERO, SPACE, COMPAT, EMOJI, BREAK, HAN = (1 << i for i in range(16))
_JOINER, _GRAPHEME_JOINER = 0x200D, 0x34F


class Tables:
    """What is known of each code point; built once in a worker."""

    def __init__(self) -> None:
        self.flags = np.zeros(TOP, np.int32)
        self.ccc = np.zeros(TOP, np.uint8)
        self.fold = np.arange(TOP, dtype=np.uint32)  # compatibility form of one code point
        self.many: dict[int, list[int]] = {}  # ... of several
        self.split: dict[int, list[int]] = {}  # full canonical decomposition
        pairs: dict[tuple[int, int], int] = {}
        for cp in range(0x80, TOP):
            if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xF900 or 0x12000 <= cp < 0x1B000:
                continue
            ch = chr(cp)
            cat = ud.category(ch)
            if cat == "Cn":
                continue
            f = 0
            if cat[0] in "LN":
                f |= ALNUM | (LETTER if cat[0] == "L" else 0)
            if k := ud.combining(ch):
                self.ccc[cp] = k
                f |= MARK
            dec = ud.decomposition(ch)
            if dec and dec[0] != "<" and cat[0] == "L":
                self.split[cp] = [*map(ord, ud.normalize("NFD", ch))]
                two = [int(x, 16) for x in dec.split()]
                if len(two) == 2 and ud.normalize("NFC", ch) == ch:
                    pairs[two[0], two[1]] = cp
            if dec and dec[0] != "<" and cat[0] == "L" and " " not in dec:
                # a canonical twin of another letter, such as the Kelvin sign
                self.fold[cp] = ord(ud.normalize("NFC", ch)[0])
                f |= COMPAT
                self.split.pop(cp, None)
            if dec and dec[0] == "<" and cat != "Zs" and cp not in (0xAA, 0xBA, 0xB2, 0xB3, 0xB9, 0x2026):
                to = [*map(ord, ud.normalize("NFKC", ch))]
                if to != [cp] and not any(ud.category(chr(x))[0] == "Z" for x in to):
                    inner = all(ud.category(chr(x))[0] in "LN" for x in to)
                    if inner and dec.split()[0] not in ("<initial>", "<medial>", "<final>", "<isolated>", "<fraction>"):
                        f |= COMPAT | ALNUM
                    if len(to) == 1:
                        self.fold[cp] = to[0]
                    elif inner:
                        self.many[cp] = to
            if cat == "Cf" or cp == _GRAPHEME_JOINER or cp == 0x180E:
                f = (f | ZERO) & ~MARK
                self.ccc[cp] = 0
            if cat == "Zs" or cp in (0x2028, 0x2029, 0x85):
                f |= SPACE
            if cp >= 0x1F000 or cat == "So" or 0xFE00 <= cp <= 0xFE0F or cp == 0x20E3:
                f |= EMOJI
            name = ud.name(ch, "")
            if f & LETTER:
                if name.startswith("LATIN") and cp < 0xFB00:
                    f |= LAT
                elif name.startswith("CYRILLIC"):
                    f |= CYR
                elif name.startswith("GREEK"):
                    f |= GRK
            self.flags[cp] = f
        self.flags[0x3400:0xA000] |= ALNUM | LETTER | HAN
        self.flags[0xAC00:0xD7A4] |= ALNUM | LETTER
        self.flags[0xFE00:0xFE10] = EMOJI
        for cp in range(0x80):
            ch = chr(cp)
            self.flags[cp] = (ALNUM if ch.isalnum() else 0) | (LETTER | LAT if ch.isalpha() else 0)
        for ch in "\x0b\x0c\x1c\x1d\x1e\x1f":
            self.flags[ord(ch)] |= SPACE
        for ch in ".!?。！？;；\n/…|":
            self.flags[ord(ch)] |= BREAK
        self.latin = np.arange(TOP, dtype=np.uint32)
        self.cyrillic = np.arange(TOP, dtype=np.uint32)
        for (foreign, latin), flag in ((CYRILLIC_LIKE, CYRAMB), (GREEK_LIKE, GRKAMB), (OTHER_LIKE, OTHERAMB)):
            for a, b in zip(foreign, latin):
                if not self.flags[ord(a)] & (CYRAMB | GRKAMB | OTHERAMB):
                    self.flags[ord(a)] = self.flags[ord(a)] & ~(CYR | GRK | LAT) | flag
                    self.latin[ord(a)] = ord(b)
        for a, b in zip(*LATIN_FOR_RUSSIAN):
            self.flags[ord(a)] = self.flags[ord(a)] & ~LAT | LATAMB
            self.cyrillic[ord(a)] = ord(b)
        keys = np.array([(a << 21) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_key = keys[order]
        self.pair_to = np.array([*pairs.values()], np.uint32)[order]
        odd = [cp for cp in range(0x80, TOP) if self.flags[cp] & (COMPAT | MARK | ZERO | SPACE | GRK | GRKAMB | OTHERAMB)]
        odd += [cp for cp in range(0x20) if self.flags[cp] & SPACE]
        odd += [cp for first, n in (MIDDLE, CLOSE) for cp in range(first, first + n)]
        #: Ideographs from TOP on that are canonical twins of others.
        self.high = {cp: ord(to) for cp in range(0x2F800, 0x2FA1E) if (to := ud.normalize("NFC", chr(cp))) != chr(cp)}
        odd += self.high
        #: A text without any of these, and without both Latin and Cyrillic letters, is in the one form already.
        self.odd = frozenset(map(chr, odd))
        self.cyr = frozenset(map(chr, range(0x400, 0x530)))
        self.lat = frozenset(map(chr, (*range(65, 91), *range(97, 123))))


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def suspect(text: str, t: Tables) -> bool:
    """False only where ``text`` needs no change; cheap, for most texts are plain."""
    if text.isascii() and text.isprintable():
        return False
    chars = set(text)
    return not t.odd.isdisjoint(chars) or not (t.cyr.isdisjoint(chars) or t.lat.isdisjoint(chars))


def _runs(starts: np.ndarray, n: int) -> np.ndarray:
    """Run number of each position, for runs that begin at ``starts`` (a mask)."""
    return np.cumsum(starts) - 1


def _or_by(run: np.ndarray, flags: np.ndarray, n_runs: int) -> np.ndarray:
    """Bitwise OR of ``flags`` within each run (runs are consecutive)."""
    first = np.searchsorted(run, np.arange(n_runs))
    return np.bitwise_or.reduceat(flags, first) if n_runs else flags[:0]


def _syllables(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Korean syllables composed by rule: ``(code points, those that stay, those that were made)``."""
    cps = cps.astype(np.int64)
    stays, made = np.ones(len(cps), bool), np.zeros(len(cps), bool)
    inside = lambda of: (cps >= of[0]) & (cps < of[0] + of[1])
    next_to = np.append(row[1:] == row[:-1], False)
    middle = np.append(inside(MIDDLE)[1:], False)
    at = np.flatnonzero(inside(LEAD) & middle & next_to)
    cps[at] = SYLLABLE + ((cps[at] - LEAD[0]) * MIDDLE[1] + cps[at + 1] - MIDDLE[0]) * (CLOSE[1] + 1)
    made[at], stays[at + 1] = True, False
    # a closing part behind a syllable without one, which may just have been made of two places
    open_ = (cps >= SYLLABLE) & (cps < SYLLABLE + LEAD[1] * MIDDLE[1] * (CLOSE[1] + 1)) & ((cps - SYLLABLE) % (CLOSE[1] + 1) == 0)
    for i in np.flatnonzero(inside(CLOSE)).tolist():
        k = i - 1 if i and stays[i - 1] else i - 2
        if k >= 0 and open_[k] and row[k] == row[i]:
            cps[k] += cps[i] - CLOSE[0] + 1
            made[k], stays[i], open_[k] = True, False, False
    return cps.astype(np.uint32), stays, made


def _unify(texts: list[str], t: Tables) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """The one form of each text, whether it held look-alikes, and where each of its characters stood; all texts are suspect."""
    n = len(texts)
    cps = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(n), np.array([len(x) + 1 for x in texts[:-1]] + [len(texts[-1])]))
    hit = np.zeros(n, bool)
    src = np.arange(len(cps))
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    high = np.flatnonzero(cps >= TOP)
    if len(high):
        cps = cps.copy()
        twins = [t.high.get(x, x) for x in cps[high].tolist()]
        hit[row[high[cps[high] != np.array(twins, np.uint32)]]] = True
        cps[high] = twins
    low = np.minimum(cps, TOP - 1).astype(np.int64)
    low[cps >= TOP] = 0x4E00  # a letter like any ideograph; its own code point is kept
    fl = t.flags[low]

    # 1. characters without width: drop them, unless they join emoji
    zero = (fl & ZERO) > 0
    if zero.any():
        keep = ~zero
        before = np.cumsum(keep) - 1  # index among the kept of the nearest kept at or before
        kept_fl = fl[keep]
        if len(kept_fl):
            at = np.flatnonzero(zero)
            left = kept_fl[np.maximum(before[at], 0)]
            right = kept_fl[np.minimum(before[at] + 1, len(kept_fl) - 1)]
            inside = (left & (ALNUM | MARK) > 0) & (right & (ALNUM | MARK) > 0) & (before[at] >= 0) & (before[at] + 1 < len(kept_fl))
            joins = (cps[at] == _JOINER) & (left & EMOJI > 0) & (right & EMOJI > 0)
            tagged = cps[at] >= 0xE0000
            hit[row[at[inside & ~joins & ~tagged]]] = True
            keep[at[joins | tagged]] = True
        cps, low, fl, row, src = cps[keep], low[keep], fl[keep], row[keep], src[keep]

    # 2. spaces
    space = (fl & SPACE) > 0
    if space.any():
        hit[row[space]] = True
        cps = np.where(space, np.uint32(32), cps)

    # 3. compatibility forms
    low = np.where(cps < TOP, cps, 0x4E00).astype(np.int64)
    compat = (fl & COMPAT) > 0
    hit[row[compat]] = True
    if compat.any():
        cps = np.where(compat, t.fold[low], cps)
        many = np.flatnonzero(compat)
        many = many[[c in t.many for c in cps[many].tolist()]]
        if len(many):
            size = np.ones(len(cps), np.int64)
            size[many] = [len(t.many[c]) for c in cps[many].tolist()]
            put = np.cumsum(size) - size
            wide = np.repeat(cps, size)
            for i in many.tolist():
                wide[put[i] : put[i] + size[i]] = t.many[int(cps[i])]
            row, src, cps = np.repeat(row, size), np.repeat(src, size), wide

    if ((cps >= MIDDLE[0]) & (cps < CLOSE[0] + CLOSE[1])).any():
        cps, stays, made = _syllables(cps, row)
        hit[row[made]] = True
        cps, row, src = cps[stays], row[stays], src[stays]

    # 4. combining marks: decompose, order by class within the cluster, recompose
    low = np.where(cps < TOP, cps, 0x4E00).astype(np.int64)
    mark = t.ccc[low] > 0
    if mark.any():
        letter_before = np.zeros(len(cps), bool)
        starter = np.maximum.accumulate(np.where(mark, -1, np.arange(len(cps))))
        letter_before[mark] = (starter[mark] >= 0) & ((t.flags[low[np.maximum(starter[mark], 0)]] & LETTER) > 0)
        hit[row[mark & letter_before]] = True
        cluster_marked = np.zeros(len(cps), bool)
        cluster_marked[starter[mark & letter_before]] = True
        apart = [i for i in np.flatnonzero(cluster_marked).tolist() if int(cps[i]) in t.split]
        if apart:
            size = np.ones(len(cps), np.int64)
            size[apart] = [len(t.split[int(cps[i])]) for i in apart]
            put = np.cumsum(size) - size
            wide = np.repeat(cps, size)
            for i in apart:
                wide[put[i] : put[i] + size[i]] = t.split[int(cps[i])]
            row, src, cps = np.repeat(row, size), np.repeat(src, size), wide
        low = np.where(cps < TOP, cps, 0x4E00).astype(np.int64)
        ccc = t.ccc[low]
        cluster = np.cumsum(ccc == 0)
        order = np.lexsort((np.arange(len(cps)), ccc, cluster))
        cps, row, ccc, cluster, src = cps[order], row[order], ccc[order], cluster[order], src[order]
        cps = cps.copy()
        alive = np.ones(len(cps), bool)
        first = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(cps)), -1))
        rank = np.arange(len(cps)) - first
        blocked = np.full(len(cps), -1)  # at a starter: the class of the last mark that stayed
        for k in range(1, int(rank.max()) + 1 if len(rank) else 0):
            at = np.flatnonzero((rank == k) & (ccc > 0) & (first >= 0))
            if not len(at):
                break
            base = first[at]
            key = (cps[base].astype(np.int64) << 21) | cps[at].astype(np.int64)
            where = np.minimum(np.searchsorted(t.pair_key, key), len(t.pair_key) - 1)
            joined = (t.pair_key[where] == key) & (blocked[base] < ccc[at])
            cps[base[joined]] = t.pair_to[where[joined]]
            alive[at[joined]] = False
            blocked[base[~joined]] = ccc[at[~joined]]
        cps, row, src = cps[alive], row[alive], src[alive]

    # 5. look-alike letters: by word, where the word leaves it open by sentence
    low = np.where(cps < TOP, cps, 0x4E00).astype(np.int64)
    fl = t.flags[low]
    if (fl & (CYR | CYRAMB | GRK | GRKAMB | OTHERAMB)).any():
        alnum = (fl & (ALNUM | MARK)) > 0
        starts = np.ones(len(cps), bool)
        starts[1:] = (alnum[1:] != alnum[:-1]) | ((fl[1:] & HAN) != (fl[:-1] & HAN)) | (row[1:] != row[:-1])
        word = _runs(starts, len(cps))
        in_word = _or_by(word, fl, int(word[-1]) + 1)[word]
        # a sentence ends at a break before a blank or the end of its text; breaks inside links and numbers do not count
        nxt_blank = np.ones(len(cps), bool)
        nxt_blank[:-1] = (cps[1:] == 32) | (cps[1:] == 10) | (cps[1:] == 13) | (row[1:] != row[:-1])
        ends = (fl & BREAK > 0) & (nxt_blank | (cps == 10) | (cps > 0x2FFF))
        sent_start = np.ones(len(cps), bool)
        sent_start[1:] = ends[:-1] | (row[1:] != row[:-1])
        sent = _runs(sent_start, len(cps))
        in_sent = _or_by(sent, fl, int(sent[-1]) + 1)[sent]
        in_text = np.zeros(n, np.int32)
        here = np.flatnonzero(np.diff(row, prepend=-1))
        in_text[row[here]] = np.bitwise_or.reduceat(fl, here)
        in_text = in_text[row]
        foreign = (fl & (CYRAMB | GRKAMB | OTHERAMB)) > 0
        w_lat, w_cyr, w_grk = (in_word & LAT) > 0, (in_word & CYR) > 0, (in_word & GRK) > 0
        w_latamb = (in_word & LATAMB) > 0
        s_lat, s_cyr, s_grk = (in_sent & (LAT | LATAMB)) > 0, (in_sent & CYR) > 0, (in_sent & GRK) > 0
        bare = ~s_lat & ~s_cyr
        s_cyr |= bare & (in_text & CYR > 0)
        s_lat |= bare & (in_text & (LAT | LATAMB) > 0)
        open_word = ~w_lat & ~w_cyr & ~w_grk
        mixed = open_word & w_latamb & ((in_word & CYRAMB) > 0)
        to_latin = foreign & ~w_cyr & ~w_grk & (w_lat | (open_word & s_lat & ~s_cyr & ~((fl & GRKAMB > 0) & s_grk)))
        to_latin |= (fl & (GRKAMB | OTHERAMB) > 0) & ~w_cyr & ~w_grk & ~s_grk & (s_lat | (in_text & (LAT | LATAMB) > 0))
        # lower-case Latin words of look-alikes only, between Russian words
        digit = (fl & (ALNUM | LETTER)) == ALNUM
        w_digit = _or_by(word, digit.astype(np.int32), int(word[-1]) + 1)[word] > 0
        upper = (cps >= 65) & (cps <= 90)
        w_upper = _or_by(word, upper.astype(np.int32), int(word[-1]) + 1)[word] > 0
        alone = open_word & ~w_digit & ~w_upper & ((in_word & CYRAMB) == 0) & s_cyr & _between_cyrillic(cps, fl, word, in_word, row)
        to_cyr = (fl & LATAMB > 0) & ((w_cyr & ~w_lat) | (mixed & s_cyr) | alone)
        change = (to_latin & ~to_cyr)
        hit[row[change | to_cyr]] = True
        cps = np.where(to_cyr, t.cyrillic[low], np.where(change, t.latin[low], cps))

    data = cps.astype(np.uint32)
    bounds = np.searchsorted(row, np.arange(n + 1))
    whole = data.tobytes().decode("utf-32-le", "surrogatepass")
    out, places = [], []
    for i in range(n):
        a, b = bounds[i], bounds[i + 1] - (i < n - 1)
        out.append(whole[a:b])
        places.append(src[a:b] - begin[i])
    return out, hit, places


def _between_cyrillic(cps, fl, word, in_word, row) -> np.ndarray:
    """Positions whose word has a Russian word next to it on one side at least, with only a blank between."""
    n_words = int(word[-1]) + 1
    first = np.searchsorted(word, np.arange(n_words))
    w = in_word[first]
    cyr = (w & CYR) > 0
    size = np.diff(np.append(first, len(cps)))
    blank = (size == 1) & (cps[first] == 32)
    same = row[first]
    left = np.zeros(n_words, bool)
    right = np.zeros(n_words, bool)
    if n_words > 2:
        left[2:] = blank[1:-1] & cyr[:-2] & (same[2:] == same[:-2])
        right[:-2] = blank[1:-1] & cyr[2:] & (same[:-2] == same[2:])
    return (left | right)[word]


def unify(texts: list[str | None]) -> tuple[list[str | None], list[bool]]:
    """``(one form, held look-alikes)`` of each text; null stays null, false."""
    out, hits, _ = located(texts)
    return out, hits


def located(texts: list[str | None]) -> tuple[list[str | None], list[bool], list[np.ndarray | None]]:
    """As ``unify``, and for each changed text where each character of its form stood in it."""
    t = tables()
    out = list(texts)
    hits = [False] * len(texts)
    places: list[np.ndarray | None] = [None] * len(texts)
    odd = [i for i, x in enumerate(texts) if x and suspect(x, t)]
    # a letter that was made another may compose with the mark behind it: again, until nothing changes
    while odd:
        before = [out[i] for i in odd]
        forms, hit, where = _unify(before, t)
        again = []
        for i, old, form, h, w in zip(odd, before, forms, hit.tolist(), where):
            hits[i] |= h
            if form != old:
                out[i] = form
                places[i] = w if places[i] is None else places[i][w]
                again.append(i)
        odd = [i for i in again if suspect(out[i], t)]
    return out, hits, places
