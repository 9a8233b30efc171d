"""Personal values in free text, found and replaced (problem 5).

Weak supervision in three steps:

1. Candidates of five kinds (e-mail, phone, identity number, street address, name)
   are cut from each text, and labelers vote on each: patterns, gazetteers (the name
   lexicon, and the name parts it is built from, since it lacks many names) and
   context words.
2. The votes of all candidates are counted by pattern of votes, a table of bounded
   size, and expectation-maximisation estimates how reliable each labeler is.
3. A logistic span classifier is trained on these soft labels and decides.

Matching runs on the one form of a text (problem 7); values are cut from the text
as it stands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm import charforms
from siftlane.session import written

KINDS = ("email", "phone", "identity", "address", "name")
#: Labelers, by bit: a strict pattern, a gazetteer, a word before, a word behind or the shape, and a sign against.
STRICT, GAZETTEER, BEFORE, SHAPE, AGAINST = 1, 2, 4, 8, 16
VOTES = 5
#: A name part is known where so many lexicon names of its kind share it.
PART_LEAST = 3
#: Letters of a name part at least.
PART_CHARS = 3
#: The most names the lexicon may have; it is broadcast.
MAX_LEXICON = 200_000
ACCEPT = 0.5

_EMAIL = re.compile(r"[\w.+-]+(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)[a-z0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[a-z0-9-]+)+", re.I)
_URL = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@.])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:[a-z]{2,})/\S*", re.I)
_PHONE = re.compile(r"(?<![\w.,/-])(?:\(?\+?63\)?[ .-]?\(?9\d{2}\)?[ .-]?\d{3}[ .-]?\d{4}|\(?09\d{2}\)?[ .-]?\d{3}[ .-]?\d{4}|(?:\+63[ .-]?2|\+63[ .-]?\(2\)|\(0\d{1,2}\)|0\d)[ .-]?\d{4}[ .-]?\d{4})(?![\w-]|[.,]\d)")
_IDENTITY = re.compile(r"(?<![\w/-])(?:\d{3}-\d{3}-\d{3}(?:-\d{3}(?:\d{2})?)?|\d{4}([- ])\d{4}\1\d{4}\1\d{4}|\d{2}-\d{7}-\d|[A-Z]\d{2}-\d{2}-\d{6}|CRN-?\s?\d{4}-\d{7}-\d|[A-Z]{1,2}\d{7}[A-Z]?)(?![\w-]|[.,]\d)", re.I)
_ID_BEFORE = re.compile(r"(?:\b(?:tin|sss|gsis|umid|crn|id|identidad|identity|passport|pasaporte|licen[cs]e|lisensya|licencia|tax|social|national|mine was|number)\b[^.!?]{0,18})$", re.I)
_PHONE_BEFORE = re.compile(r"(?:\b(?:call|text|mobile|phone|tel|cell|desk|tumawag|tawag\w*|numero|number|ll[aá]me\w*|reach|contact|al|sa|ko|ang|ito|or|o)\b\W{0,3})$", re.I)
_EMAIL_BEFORE = re.compile(r"(?:\b(?:e-?mail|write|reset|link|for|sumulat|sulati|escriba|reach|office|na|to|sa|lang|at|a)\b\W{0,3})$", re.I)
_AGAINST = re.compile(r"(?:\b(?:order|ticket|tiket|reference|ref|batch|code|c[oó]digo|entry|stub|slip|resibo|recibo|receipt|invoice|bill|card|kard|worksheet|bus|claim|parcel|padala|statement)\b\W{0,3})$", re.I)

# Words of Philippine and Spanish addresses.
_STREET = r"(?:street|st\.?|road|rd\.?|avenue|ave\.?|village|vill\.?|homes|subdivision|subd\.?|drive|lane|compound)"
_WORDS = r"[^\W\d_][\w'’-]*\.?"
_HOUSE = r"(?:(?:no\.?|num\.?)\s*\d+[\w-]*|\#\s*\d+[\w-]*|(?:unit|rm\.?|room)\s+[\w-]+\s*,\s*(?:\#\s*|no\.?\s*)?\d+(?:-?[a-z](?![a-z]))?|(?:blk\.?|block)\s*\d+\s*,?\s*lot\s*\d+|lot\s*\d+\s*,?\s*(?:phase|ph\.?|blk\.?|block)\s*\d+|\d{1,5}(?:-?[a-z](?![a-z]))?)"
_ADDRESS = re.compile(rf"(?<![\w/.,#-])(?:{_HOUSE}\s*,?\s+(?:(?:kalye|calle|daang)\s+{_WORDS}(?:\s+{_WORDS})?|{_WORDS}(?:\s+{_WORDS})?\s+{_STREET}(?![^\W\d_]))|purok\s+\d+(?=\s*,))", re.I)
_STREET_ONLY = re.compile(rf"\b{_STREET}", re.I)
_BARANGAY = re.compile(rf"\s*,\s*(?:brgy\.?|barangay)\s+({_WORDS}(?:\s+{_WORDS})?)(?=\s*,)", re.I)
_SEGMENT = re.compile(r"\s*,\s+((?:(?:lungsod|bayan|ciudad|city)\s+(?:ng|de|of)\s+)?[^\W\d_][\w'’-]*(?:\s+[^\W\d_][\w'’-]*){0,2})", re.I)
_POSTAL = re.compile(r"\s+\d{4}(?![\w.,-]*\d)(?![\w-])")
# Words behind which an address does not go on.
_STOP = frozenset("at ug and y last mula is kon para sa since para on by before until from ang na ngayon with to por desde hasta el la con in for si are was were po ni ay who tungkol sang or o kapag nang noong ito kay pa niadtong kung please text call are thank thanks salamat".split())
_ADDRESS_BEFORE = re.compile(r"(?:\b(?:to|at|address|moved|deliver|sa|en|nakatira|ipadala|ihatod|entreguen|caja|kahon|putos|box|tenant)\b\W{0,3})$", re.I)

_TOKEN = re.compile(r"(?<![\w@.+#-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w@+])")
_LINK = frozenset(("dela", "de", "del", "delos", "dos", "la", "las", "san", "santa"))
_TITLE = re.compile(r"(?:\b(?:mr|mrs|ms|miss|dr|dra|engr|atty|prof|sir|ma'?am|gng|bb|g|sr|sra|srta|si|kay|ni|kina|soy|hi|hello|hey|dear|ako si|kumusta|regards|this is|look for|por|person|waiting|thank you|salamat|hanapin|pangitaa|kang)\b[.,:]?\s*)$", re.I)
_BEHIND = re.compile(r"^(?:\s*(?:,|\.|po\b|from\b|of\b|sa\b|ng\b|de\b|sent\b|about\b|tungkol\b|na\b|bahin\b|your\b|is\b|$))", re.I)


class Names:
    """Given and family names by the lexicon, and by the parts its names are made of."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.known: dict[str, set[str]] = {"given": set(), "family": set()}
        for name, part in rows:
            if name and part in self.known:
                self.known[part].add(name.strip().lower())
        self.heads: dict[str, set[str]] = {}
        self.tails: dict[str, set[str]] = {}
        for part, names in self.known.items():
            heads = Counter(n[:i] for n in names for i in range(PART_CHARS, len(n) - PART_CHARS + 1))
            tails = Counter(n[i:] for n in names for i in range(PART_CHARS, len(n) - PART_CHARS + 1))
            self.heads[part] = {x for x, k in heads.items() if k >= PART_LEAST}
            self.tails[part] = {x for x, k in tails.items() if k >= PART_LEAST}
        self.seen: dict[str, int] = {}

    def look(self, word: str) -> int:
        """0: no name; 1 given, 2 family; 4 more: only by its parts."""
        w = word.lower()
        out = self.seen.get(w)
        if out is None:
            out = 0
            if w in self.known["given"]:
                out = 1
            elif w in self.known["family"]:
                out = 2
            elif 2 * PART_CHARS <= len(w) <= 20:
                for flag, part in ((1, "given"), (2, "family")):
                    heads, tails = self.heads[part], self.tails[part]
                    if any(w[:i] in heads and w[i:] in tails for i in range(PART_CHARS, len(w) - PART_CHARS + 1)):
                        out = flag | 4
                        break
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[w] = out
        return out

    def of(self, token: str) -> int:
        """A joined name counts by its parts: all must be names of a kind."""
        if "-" not in token:
            return self.look(token)
        parts = [self.look(x) for x in token.split("-")]
        if len(parts) == 2 and all(x & 2 for x in parts):
            return 2 | (4 if any(x & 4 for x in parts) else 0)
        return 1 if len(parts) == 2 and all(x & 1 for x in parts) else 0


def names_in(text: str, names: Names) -> Iterator[tuple[int, int, int]]:
    """``(start, end, votes)`` of the names of persons."""
    found = []
    of = names.of
    for m in _TOKEN.finditer(text):
        if k := of(m[0]):
            found.append((m.start(), m.end(), k))
    i = 0
    while i < len(found):
        start, end, kind = found[i]
        kinds = [kind]
        j = i + 1
        comma = False
        while j < len(found):
            a, b, k = found[j]
            gap = text[end:a]
            if k & 2 and not any(x & 2 for x in kinds) and re.fullmatch(r"\s+(?:[^\W\d_]\.?\s+)?(?:(?:dela|de la|del|delos|de los|de|san)\s+)?", gap, re.I):
                pass
            elif k & 1 and all(x & 1 for x in kinds) and re.fullmatch(r"\s+", gap):
                pass
            elif k & 1 and len(kinds) == 1 and kinds[0] & 2 and re.fullmatch(r"\s*,\s+", gap):
                comma = True
            elif comma and k & 1 and re.fullmatch(r"\s+", gap):
                pass
            else:
                break
            kinds.append(k)
            end = b
            j += 1
        votes = SHAPE if len(kinds) > 1 else 0
        if any(not k & 4 for k in kinds):
            votes |= STRICT
        votes |= GAZETTEER
        before = text[max(0, start - 24) : start]
        if _TITLE.search(before):
            votes |= BEFORE
        if len(kinds) == 1 and kinds[0] & 2 and not votes & BEFORE:
            votes |= 0 if _BEHIND.match(text[end:]) else AGAINST
        if re.match(r"\s*(?:bank|pay|wallet|cargo|express|mart|market|load|telecom|lending|credit|rewards|crossing|plaza|heights|bayan|norte|street|st\.|road|ave|village|homes)\b", text[end:], re.I):
            votes |= AGAINST
        yield start, end, votes
        i = j


def addresses_in(text: str) -> Iterator[tuple[int, int, int]]:
    """``(start, end, votes)`` of street addresses, from house number to town or postal code."""
    at = 0
    while m := _ADDRESS.search(text, at):
        start, end = m.span()
        votes = STRICT | GAZETTEER
        if b := _BARANGAY.match(text, end):
            end = b.end()
            votes |= SHAPE
        segments = 0
        while segments < 3 and (s := _SEGMENT.match(text, end)):
            words = s[1].split()
            cased = words[0][:1].isupper() and not text.isupper()
            kept = []
            for k, w in enumerate(words):
                low = w.lower()
                if low in _STOP and not (low in ("ng", "de") and k == 1):
                    break
                if cased and k and not w[:1].isupper() and low not in ("ng", "de", "del", "of"):
                    break
                kept.append(w)
            while kept and kept[-1].lower() in ("ng", "de", "del", "of"):
                kept.pop()
            if not kept:
                break
            # words may be parted by more than one blank in the text
            pos = s.start(1)
            for w in kept:
                pos = text.index(w, pos) + len(w)
            end = pos
            segments += 1
            if len(kept) < len(words):
                break
        if p := _POSTAL.match(text, end):
            end = p.end()
            votes |= SHAPE
        if segments:
            votes |= SHAPE
        else:
            votes |= AGAINST
        if _ADDRESS_BEFORE.search(text[max(0, start - 24) : start]):
            votes |= BEFORE
        if _AGAINST.search(text[max(0, start - 24) : start]):
            votes |= AGAINST
        yield start, end, votes
        at = end


def candidates(text: str, names: Names) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, votes)`` of all candidates; none overlaps an earlier kind."""
    out: list[tuple[str, int, int, int]] = []
    digits = any(c.isdigit() for c in text)

    def blank(spans: list[tuple[int, int]]) -> None:
        nonlocal text
        for a, b in spans:
            text = text[:a] + "\x00" * (b - a) + text[b:]

    def numbers(kind: str, pattern: re.Pattern, before: re.Pattern) -> None:
        spans = []
        for m in pattern.finditer(text):
            a, b = m.span()
            left = text[max(0, a - 40) : a]
            votes = STRICT
            if before.search(left):
                votes |= BEFORE
            if _AGAINST.search(left):
                votes |= AGAINST
            if re.search(r"[ .()+-]", m[0]) or len(m[0]) >= 11:
                votes |= SHAPE
            out.append((kind, a, b, votes))
            spans.append((a, b))
        blank(spans)

    if "@" in text or "at" in text.lower() and ("(" in text or "[" in text):
        spans = []
        for m in _EMAIL.finditer(text):
            a, b = m.span()
            while text[a] in ".-+_" and a < b:
                a += 1
            votes = STRICT | (SHAPE if "@" in m[0] else 0) | (BEFORE if _EMAIL_BEFORE.search(text[max(0, a - 24) : a]) else 0)
            out.append(("email", a, b, votes))
            spans.append((a, b))
        blank(spans)
    if "/" in text or "www" in text:
        blank([m.span() for m in _URL.finditer(text)])
    if digits:
        if re.search(r"\d{3}", text):
            numbers("phone", _PHONE, _PHONE_BEFORE)
            numbers("identity", _IDENTITY, _ID_BEFORE)
        if _STREET_ONLY.search(text) or re.search(r"\b(?:purok|kalye|calle)\b", text, re.I):
            spans = []
            for a, b, votes in addresses_in(text):
                out.append(("address", a, b, votes))
                spans.append((a, b))
            blank(spans)
    for a, b, votes in names_in(text, names):
        out.append(("name", a, b, votes))
    return out


def _raw(raw: str, places: np.ndarray | None, a: int, b: int) -> tuple[int, int]:
    """The span in the text as it stands."""
    if places is None:
        return a, b
    a, b = int(places[a]), int(places[b - 1]) + 1
    while b < len(raw) and charforms.ud.combining(raw[b]):
        b += 1
    return a, b


CANDIDATES = "src STRING, key_id BIGINT, kind STRING, value STRING, start INT, stop INT, votes INT"


def spans(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The candidates of ``texts(src, key_id, text)``, as ``CANDIDATES``; one narrow stage."""
    rows = lexicon.where(F.col("name").isNotNull()).select("name", "name_part").limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the name lexicon has more than {MAX_LEXICON} rows; raise MAX_LEXICON knowingly, it is broadcast")
    names_b = texts.sparkSession.sparkContext.broadcast(Names([(r[0], r[1]) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = names_b.value
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            raws = batch.column(2).to_pylist()
            forms, _, places = charforms.located(raws)
            for src, key, raw, form, where in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raws, forms, places):
                for kind, a, b, votes in candidates(form, names):
                    a, b = _raw(raw, where, a, b)
                    for col, x in zip(cols, (src, key, kind, raw[a:b], a, b, votes)):
                        col.append(x)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["src", "key_id", "kind", "value", "start", "stop", "votes"])

    return texts.select("src", F.col("key_id").cast("long").alias("key_id"), "text").where(F.length("text") > 0).mapInArrow(run, CANDIDATES)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Expectation-maximisation over vote patterns: the probability that a candidate of each is true.

    ``votes[i, j]`` is 1 where labeler ``j`` votes for (against: 1 - vote) in pattern ``i``.
    Rates carry a weak prior, so a labeler that is never wrong is not taken for useless.
    """
    prior, hit, false = 0.8, np.full(votes.shape[1], 0.75), np.full(votes.shape[1], 0.25)
    p = np.full(len(counts), 0.5)
    for _ in range(rounds):
        up = np.log(prior) + (votes * np.log(hit) + (1 - votes) * np.log(1 - hit)).sum(1)
        down = np.log(1 - prior) + (votes * np.log(false) + (1 - votes) * np.log(1 - false)).sum(1)
        p = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
        w, v = p * counts, (1 - p) * counts
        strong = max(4.0, 0.02 * counts.sum())
        hit = (votes.T @ w + 0.75 * strong) / (w.sum() + strong)
        false = (votes.T @ v + 0.25 * strong) / (v.sum() + strong)
        prior = (w.sum() + 0.8 * strong) / (counts.sum() + strong)
    return p


def trained(patterns: list[tuple[str, int, int]]) -> dict[tuple[str, int], float]:
    """The span classifier's probability for each ``(kind, votes)``, from ``(kind, votes, count)``.

    Logistic regression on the votes, fitted to the soft labels of ``estimate``.
    """
    out = {}
    for kind in KINDS:
        own = [(v, n) for k, v, n in patterns if k == kind]
        if not own:
            continue
        x = np.array([[(v >> j) & 1 if 1 << j != AGAINST else 1 - ((v >> j) & 1) for j in range(VOTES)] for v, _ in own], float)
        n = np.array([n for _, n in own], float)
        soft = estimate(x, n)
        z = np.hstack([x, np.ones((len(x), 1))])
        beta = np.zeros(z.shape[1])
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            grad = z.T @ (n * (soft - q)) - 0.1 * beta
            hess = (z * (n * q * (1 - q))[:, None]).T @ z + (0.1 + 1e-6) * np.eye(z.shape[1])
            beta += np.linalg.solve(hess, grad)
        q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        out |= {(kind, v): float(a) for (v, _), a in zip(own, q)}
    return out


def judged(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The candidates that the classifier accepts, with its ``probability``.

    Null and empty texts have none; repeated rows have theirs each; an empty table gives no rows.
    """
    spark = texts.sparkSession
    found = written(spans(texts, lexicon), "pii-spans")
    # at most kinds x 2^labelers rows
    counts = found.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    model = trained([(r["kind"], r["votes"], r["n"]) for r in counts])
    rows = [(k, v, p) for (k, v), p in model.items()]
    table = spark.createDataFrame(rows, "kind STRING, votes INT, probability DOUBLE")
    # a table of 160 rows at most
    return found.join(F.broadcast(table), ["kind", "votes"]).where(F.col("probability") >= ACCEPT)


def masked(texts: DataFrame, spans_found: DataFrame) -> DataFrame:
    """``(src, key_id, text)`` with each value replaced by a placeholder of its kind, such as ``[PHONE]``.

    A text without personal values comes out as it stands; a null text stays null.  The
    spans of one text are few by nature (they stand in it), so they are gathered by text.
    """
    by = spans_found.groupBy("src", "key_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("spans"))
    joined = texts.select("src", F.col("key_id").cast("long").alias("key_id"), "text").join(by, ["src", "key_id"], "left")
    piece = lambda acc, s: F.struct(
        F.concat(acc["done"], F.substring(joined["text"], acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("done"),
        s["stop"].alias("at"),
    )
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    filled = F.aggregate("spans", start, piece, lambda acc: F.concat(acc["done"], F.substring(joined["text"], acc["at"] + 1, F.length(joined["text"]))))
    return joined.select("src", "key_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(filled).alias("text"))
