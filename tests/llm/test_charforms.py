import unicodedata as ud

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlane.llm import charforms as cf


@pytest.mark.parametrize(
    ("text", "form", "hit"),
    [
        ("рassword", "password", True),  # Cyrillic letter in a Latin word
        ("посылкa вернётся", "посылка вернётся", True),  # Latin letter in a Russian word
        ("РНР 71 fee", "PHP 71 fee", True),  # a word of look-alikes only, in a Latin sentence
        ("я c вами", "я с вами", True),
        ("ТХ12 Курьер приедет", "ТХ12 Курьер приедет", False),  # in a Russian sentence it may be Russian
        ("Курьер Pay и TX12 приедет", "Курьер Pay и TX12 приедет", False),
        ("Hello. Занятие со мной", "Hello. Занятие со мной", False),
        ("５5 ａb ﬁx", "55 ab fix", True),
        ("café", "café", True),
        ("ạ́", ud.normalize("NFC", "ạ́"), True),
        ("ạ́", ud.normalize("NFC", "ạ́"), True),
        ("café", "café", False),
        ("pa​ss", "pass", True),
        ("a b　c", "a b c", True),
        ("ok 👨‍👩‍👧 👍🏽", "ok 👨‍👩‍👧 👍🏽", False),
        ("请打开，谢谢。", "请打开，谢谢。", False),
        ("Kelvin", "Kelvin", True),
        ("nɡ", "ng", True),
        ("g3ld", "g3ld", False),
        ("1º y 2ª", "1º y 2ª", False),
        (ud.normalize("NFD", "한글 문서"), "한글 문서", True),
        ("한글 문서", "한글 문서", False),
        ("각 ᄀ ᅡᆨ", "각 ᄀ ᅡᆨ", True),
        ("丽", "丽", True),
        ("𠀁", "𠀁", False),
        ("", "", False),
        (None, None, False),
    ],
)
def test_cases(text, form, hit):
    assert cf.unify([text]) == ([form], [hit])
    # together with others: no text may see its neighbours
    many = ["plain", text, "посылкa", None, "x​y"]
    out, hits = cf.unify(many)
    assert (out[1], hits[1]) == (form, hit) and out[0] == "plain" and out[4] == "xy"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab ẹ́́​раоА1５ﬁ  中🙏‍.\n", max_size=30), max_size=6))
def test_once_is_enough_and_places_fit(texts):
    out, _, places = cf.located(texts)
    assert cf.unify(out)[0] == out
    for raw, form, where in zip(texts, out, places):
        if where is not None:
            assert len(where) == len(form) and all(0 <= int(p) < len(raw) for p in where)
        else:
            assert raw == form


def test_all_korean_syllables_compose():
    whole = "".join(chr(c) for c in range(0xAC00, 0xD7A4, 11))
    out, _, places = cf.located([ud.normalize("NFD", whole), "x́"])
    assert out[0] == whole and len(places[0]) == len(whole)


def test_marks_recompose_as_the_standard_does():
    for base in "aeiouncAE":
        for marks in ("́", "̣́", "̣́", "̂́", "̧̌", "́́"):
            assert cf.unify([base + marks])[0] == [ud.normalize("NFC", base + marks)]
