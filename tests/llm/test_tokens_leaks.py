import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlane.llm import leaks as lk
from siftlane.llm import tokenize as tk

FILE = f"{tk.TOKENIZERS}/byte_bpe_50k.json"
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files here")


@needs_file
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_merge_loop(text):
    global _reference
    try:
        reference = _reference
    except NameError:
        from tokenizers import Tokenizer

        reference = _reference = Tokenizer.from_file(FILE)
        reference.encode_special_tokens = True
    e = tk.encoder(FILE)
    ids = e.encode(text)
    assert ids == reference.encode(text, add_special_tokens=False).ids
    assert e.decode(ids) == text


@needs_file
def test_long_pieces_and_special_strings():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(FILE)
    reference.encode_special_tokens = True
    rnd = random.Random(2)
    e = tk.encoder(FILE)
    for t in ["<|endoftext|> x", "a" * 20_000, "".join(rnd.choice("aeinorst") for _ in range(20_000)), "\x00\x01", "é" * 500]:
        assert e.encode(t) == reference.encode(t, add_special_tokens=False).ids


@needs_file
def test_token_table(spark):
    df = spark.createDataFrame([(1, "hello", "x"), (2, "", "x"), (3, None, "x"), (None, "hello", "x"), (1, "hello", "x")], "doc_id BIGINT, text STRING, ids STRING")
    got = {(r.doc_id, tuple(r.ids)) for r in tk.token_ids(df).collect()}
    assert got == {(1, (31373,)), (2, ()), (3, ()), (None, (31373,))}
    assert tk.token_ids(df).count() == 5 and tk.token_ids(df.limit(0)).count() == 0
    assert sorted(r.text for r in tk.decoded(tk.token_ids(df)).collect()) == ["", "", "hello", "hello", "hello"]


def words(rnd, n, tag):
    return [f"{tag}{rnd.randrange(10**6)}" for _ in range(n)]


def test_leaks(spark):
    rnd = random.Random(11)
    items = [(i, words(rnd, 60, "i")) for i in range(12)]
    docs, want = [], set()
    for d in range(150):
        item, own = rnd.choice(items)
        n = rnd.choice([10, 19, 20, 24, 32, 60])
        a = rnd.randrange(61 - n)
        piece = list(own[a : a + n])
        changed = rnd.randint(0, n // 8)
        for k in rnd.sample(range(1, n - 1), changed):
            piece[k] = "other"
        text = " ".join(words(rnd, rnd.randint(0, 40), "d") + [x.upper() + rnd.choice(["", ",", '"', "\n>"]) for x in piece] + words(rnd, rnd.randint(0, 40), "d"))
        docs.append((d, text))
        if n >= 20:
            want.add((d, item))
    docs += [(500, None), (501, ""), (502, docs[0][1])]
    want |= {(502, i) for d, i in want if d == 0}
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, "too short"), (93, "...")], "item_id BIGINT, text STRING")
    assert {(r.doc_id, r.item_id) for r in lk.leaks(df, it).collect()} == want
    # the same in many blocks
    assert {(r.doc_id, r.item_id) for r in lk.leaks(df, it, block_chars=900).collect()} == want
    assert lk.leaks(df, it.limit(0)).count() == 0 and lk.leaks(df.limit(0), it).count() == 0


@pytest.mark.parametrize("n", range(1, 20))
def test_no_short_item_is_missed(n):
    """Whole items of 1 to 19 words, with as many words replaced as may be, none at the ends."""
    rnd = random.Random(n)
    for _ in range(300):
        item = words(rnd, n, "i")
        piece = list(item)
        for k in rnd.sample(range(1, n - 1), n // lk.ONE_IN) if n > 2 else ():
            piece[k] = "other"
        text = " ".join(words(rnd, rnd.randint(0, 30), "d") + piece + words(rnd, rnd.randint(0, 30), "d"))
        block, w = lk.Items([7, 8], [" ".join(item), " ".join(words(rnd, 40, "z"))]), lk.Words()
        assert block.leaked(w(text)) == [7]
        if n > 1:
            assert block.leaked(w(" ".join(item[:-1]))) == []


def test_a_shared_run_always_shares_a_fingerprint():
    rnd = random.Random(4)
    for _ in range(200):
        run = words(rnd, lk.K + lk.WINDOW - 1, "r")
        w = lk.Words()
        a = set(lk.winnow(w(" ".join(words(rnd, rnd.randint(0, 9), "a") + run + words(rnd, rnd.randint(0, 9), "a"))))[1].tolist())
        b = set(lk.winnow(w(" ".join(words(rnd, rnd.randint(0, 9), "b") + run + words(rnd, rnd.randint(0, 9), "b"))))[1].tolist())
        assert a & b
