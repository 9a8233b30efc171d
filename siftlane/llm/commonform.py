"""The common form of a text (problems 4 and 6) and its Merkle digest.

Look-alike characters are made the same, letter case, whitespace and punctuation
at word edges are dropped.  A text made only of ``key: value`` fields is an
unordered node of ordered fields; any other text is an ordered node of words.
"""

from __future__ import annotations

import re
import string
import unicodedata as ud
from functools import lru_cache

import xxhash

from siftlane.llm import charforms

#: Fields in a text that consists of fields: this many at least.
MIN_FIELDS = 4
FIELD, PAIR = "\x1e", "\x1f"

HAN = "⺀-⿟々-〇぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
PICTURE = "‼⁉™ℹ←-⇿⌀-➿⤀-⥿⬀-⯿〰〽㊗㊙\U0001f000-\U0001faff"
TAIL = "‍︎️⃣\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f"
_TOKEN = re.compile(f"[{HAN}]|[{PICTURE}][{TAIL}{PICTURE}]*|[^\\s{HAN}{PICTURE}]+")
_WIDE = re.compile(f"[{HAN}{PICTURE}]")
_FULL = re.compile("[\u3000-\u3002\uff01-\uff5e]")
_FULLWIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 32, 0x3002: 46, 0x3001: 44}
_PART = re.compile(r"[;|\n\r]+")
_KEY = re.compile(r"^\W*([^\W\d][^:\d]{0,30}?)\s*:\s*(.*\w.*)$", re.S)


_ASCII = string.punctuation


@lru_cache(1)
def edges() -> str:
    """All punctuation that stands at the edges of words, and the symbols used like it."""
    return _ASCII + "".join(chr(c) for a, b in ((0xA1, 0xC0), (0x2010, 0x205F), (0x3001, 0x3040), (0xFE10, 0xFE70), (0xFF01, 0xFF66)) for c in range(a, b) if ud.category(chr(c))[0] == "P") + "\u200d\ufe0f"


def narrow(text: str) -> str:
    """Full-width punctuation as plain punctuation."""
    return text.translate(_FULLWIDTH) if not text.isascii() and _FULL.search(text) else text


def words(text: str) -> list[str]:
    """Lower-case words without punctuation at their edges; ideographs and emoji are words each."""
    text = text.casefold()
    if text.isascii():
        return [w for x in text.split() if (w := x.strip(_ASCII))]
    cut = edges()
    text = narrow(text)
    found = _TOKEN.findall(text) if _WIDE.search(text) else text.split()
    return [w for x in found if (w := x.strip(_ASCII if x.isascii() else cut))]


def fields(text: str) -> list[tuple[str, str]] | None:
    """The ``(key, value)`` words of a text that has nothing but fields."""
    if text.count(":") + text.count("：") < MIN_FIELDS:
        return None
    text = narrow(text)
    parts = [p for p in _PART.split(text) if p.strip(" \t.,!()[]{}\"'")]
    if len(parts) < MIN_FIELDS:
        return None
    out = []
    for part in parts:
        m = _KEY.match(part)
        if not m or len(m[1].split()) > 4:
            return None
        out.append((" ".join(words(m[1])), " ".join(words(m[2]))))
    return out


def form_of_unified(text: str) -> str:
    if (pairs := fields(text)) is not None:
        return FIELD.join(k + PAIR + v for k, v in sorted(pairs))
    return " ".join(words(text))


def common_forms(texts: list[str | None]) -> list[str | None]:
    """The common form of each text; null for null, "" for a text without words.

    Fields are parted by ``FIELD`` in the order of their leaves, key and value by ``PAIR``.
    """
    unified, _ = charforms.unify(texts)
    return [None if x is None else form_of_unified(x) for x in unified]


def words_of_form(form: str) -> list[str]:
    return form.replace(FIELD, " ").replace(PAIR, " ").split(" ") if form else []


def digest(node: str) -> bytes:
    return xxhash.xxh3_128_digest(node.encode("utf-8", "surrogatepass"))


def root_digest(form: str) -> bytes:
    """Bottom-up: leaves by their words, fields of two leaves, then the root over its children.

    Field digests are sorted under the unordered root; words keep their order.
    """
    if FIELD in form:
        nodes = []
        for field in form.split(FIELD):
            key, _, value = field.partition(PAIR)
            nodes.append(xxhash.xxh3_128_digest(b"f" + digest(key) + digest(value)))
        return xxhash.xxh3_128_digest(b"u" + b"".join(sorted(nodes)))
    return xxhash.xxh3_128_digest(b"o" + digest(form))

