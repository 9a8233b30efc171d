"""Text functions as columns: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlane import config as c

#: Word characters and blanks as Python's ``re`` has them; Java's own classes differ.
WORD = r"[\p{L}\p{N}_]"
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
NOT_BLANK = r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]"
#: A word boundary before a letter, digit or hyphen of a host name.
_START = rf"(?:(?<!{WORD})(?=[a-z0-9])|(?<={WORD})(?=-))"
URL = rf"(?i)(?:https?://|www\.){NOT_BLANK}+|{_START}(?:[a-z0-9-]+\.)+[a-z]{{2,}}(?:/{NOT_BLANK}*)?"
URL_LIKE = rf"(?i)(?<!{WORD})(?:https?://|www\.){NOT_BLANK}+|{_START}(?:[a-z0-9-]+\.)+[a-z]{{2,}}(?:/{NOT_BLANK}*)?"
OBFUSCATED = rf"(?<!{WORD})[a-z]+[0-9@$]+[a-z]+(?!{WORD})"


def normalize(text: Column) -> Column:
    """Lower case, digits and signs that stand for letters, and sounds written alike."""
    return F.translate(F.lower(text), c.NORMAL_FROM, c.NORMAL_TO)


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def split_key(text: Column) -> Column:
    """Lower case with single blanks: the key under which equal texts stay in one split."""
    return F.lower(strip(F.regexp_replace(text, rf"{BLANK}+", " ")))


def context(text: Column, at: Column, reach: int = 20) -> Column:
    """The text ``reach`` characters around position ``at`` (from 0), lower case, stripped."""
    first = F.greatest(F.lit(0), at - reach)
    return strip(F.lower(F.substring(text, first + 1, F.least(F.length(text), at + reach) - first)))


def head(text: Column, n: int = 120) -> Column:
    return strip(F.lower(F.substring(text, 1, n)))


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def word_bounded(text: Column, first: Column, last: Column) -> Column:
    """No word character before ``first`` nor behind ``last`` (from 0)."""
    left = (first == 0) | ~F.substring(text, F.greatest(first, F.lit(1)), F.lit(1)).rlike(WORD)
    right = (last >= F.length(text) - 1) | ~F.substring(text, last + 2, F.lit(1)).rlike(WORD)
    return left & right


def obfuscated(text: Column) -> Column:
    return F.lower(text).rlike(OBFUSCATED)


def url_like(text: Column) -> Column:
    return text.rlike(URL_LIKE)


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def digit_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{Nd}", "")) / F.greatest(F.length(text), F.lit(1))


def preview(text: Column, n: int = 50) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any term stands anywhere in the text."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def anomaly(text: Column) -> Column:
    """``struct(score, signals)`` of the dictionary-free heuristic; steps in order, each capped."""

    def steps(norm: Column) -> Column:
        # terms are compared as they are with the normalised text: those with v, f or j never match
        tests = [
            (has_any(norm, c.URGENCY_TERMS), 0.22, "urgency language"),
            (has_any(norm, c.ACTION_TERMS), 0.20, "action request"),
            (has_any(norm, c.SENSITIVE_TERMS), 0.28, "credential or payment language"),
            (has_any(norm, c.BENIGN_TERMS), -0.18, "benign context"),
            (url_like(norm), 0.18, "URL-like text"),
            (obfuscated(text), 0.12, "obfuscated spelling"),
            (digit_ratio(text) >= 0.08, 0.08, "digit-heavy content"),
        ]
        # worked out once, then folded: nested conditions would repeat them at every step
        return F.array(*[F.struct(test.alias("on"), F.lit(amount).alias("by"), F.lit(label).alias("label")) for test, amount, label in tests])

    def of(xs: Column) -> Column:
        score = F.aggregate(xs, F.lit(0.0), lambda acc, x: F.when(~x["on"], acc).when(x["by"] > 0, F.least(F.lit(1.0), acc + x["by"])).otherwise(F.greatest(F.lit(0.0), acc + x["by"])))
        signals = F.transform(F.filter(xs, lambda x: x["on"]), lambda x: x["label"])
        return F.struct(F.round(score, 3).alias("score"), F.slice(signals, 1, 4).alias("signals"))

    # the normalised text is bound once: forty terms look into it
    told = F.element_at(F.transform(F.array(normalize(text)), steps), 1)
    return F.element_at(F.transform(F.array(told), of), 1)
