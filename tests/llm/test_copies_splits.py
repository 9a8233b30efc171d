import hashlib
import random

import numpy as np
import pytest

from siftlane.llm import commonform as cf
from siftlane.llm import copies, splits


def form(x):
    return cf.common_forms([x])[0]


def test_common_form():
    assert form("  Hello,  WORLD !! ") == form("hello\tworld") == "hello world"
    assert form(">> It's 5,000.50 (now)") == "it's 5,000.50 now"
    assert form("a b") != form("b a") and form("a 1") != form("a 2")
    assert form("hi 👍") != form("hi") and form("hi👍") == form("hi 👍")
    assert form("请打开，谢谢") == form("请打开 谢谢。")
    one = "Ref: A1; Amount: 5 piso; Date: 1.2.2024; To: Ana Cruz"
    assert form(one) == form("(to : ana cruz | DATE:1.2.2024\n ref: A1;; amount: 5 piso.)")
    assert form(one) != form(one.replace("A1", "5 piso").replace("Amount: 5 piso", "Amount: A1"))
    assert cf.fields("Note: a; b: c; d: e") is None  # three fields only
    assert form("") == form(" .,! ") == "" and form(None) is None


SCHEMA = "row_id BIGINT, text STRING, split_name STRING, root STRING, form INT, salt INT, key STRING"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "r", 1, 2, "k") for i, t, s in rows], SCHEMA)


def test_copies(spark):
    rows = [(i, "Same  text!" if i % 3 == 0 else f"text {i}", "train") for i in range(60)] + [(60, None, "train"), (61, "", None), (62, "...", "train"), (63, "TEXT 1", None)]
    got = {(r.keep_id, r.copy_id) for r in copies.copies(table(spark, rows)).collect()}
    assert got == {(0, i) for i in range(3, 60, 3)} | {(1, 63)}
    assert {r.keep_id: r.copies for r in copies.records(table(spark, rows)).collect()}[0] == 20
    assert copies.copies(table(spark, [])).count() == 0


# two blocks of one MD5 digest (Wang and others, 2004)
ONE = "d131dd02c5e6eec4693d9a0698aff95c2fcab58712467eab4004583eb8fb7f8955ad340609f4b30283e488832571415a085125e8f7cdc99fd91dbdf280373c5bd8823e3156348f5bae6dacd436c919c6dd53e2b487da03fd02396306d248cda0e99f33420f577ee8ce54b67080a80d1ec69821bcb6a8839396f9652b6ff72a70"
TWO = "d131dd02c5e6eec4693d9a0698aff95c2fcab50712467eab4004583eb8fb7f8955ad340609f4b30283e4888325f1415a085125e8f7cdc99fd91dbd7280373c5bd8823e3156348f5bae6dacd436c919c6dd53e23487da03fd02396306d248cda0e99f33420f577ee8ce54b67080280d1ec69821bcb6a8839396f965ab6ff72a70"


@pytest.mark.parametrize("hot", [None, 3, 1])
def test_copies_are_compared_in_full(spark, monkeypatch, hot):
    """Rows of one digest whose structures differ are no copies, whatever digests they share and however many they are."""
    assert hashlib.md5(bytes.fromhex(ONE)).digest() == hashlib.md5(bytes.fromhex(TWO)).digest() and ONE != TWO
    rows = [(i, "00", TWO if i % 4 == 0 else ONE) for i in range(12)] + [(20, "00", "61"), (21, "01", ONE), (22, "02", "62"), (23, "02", "62")]
    forms = spark.createDataFrame(rows, "id BIGINT, root STRING, form STRING").selectExpr("id", "unhex(root) AS root", "cast(unhex(form) AS STRING) AS form")
    monkeypatch.setattr(copies, "with_forms", lambda *a, **k: forms)
    if hot:
        monkeypatch.setattr(copies, "HOT", hot)
    got = sorted(tuple(r) for r in copies.copies(forms).collect())
    assert got == sorted([(0, 4), (0, 8)] + [(1, i) for i in range(2, 12) if i % 4] + [(22, 23)])


def test_merkle_digest_is_the_structure():
    seen = {}
    for t in ["a b", "b a", "a: 1; b: 2; c: 3; d: 4", "b: 2; a: 1; d: 4; c: 3", "a: 2; b: 1; c: 3; d: 4", "ab", "a  B"]:
        f = form(t)
        assert seen.setdefault(cf.root_digest(f), f) == f


def plain_distance(a, b):
    p = list(range(len(b) + 1))
    for x in a:
        q = [p[0] + 1]
        for k, y in enumerate(b):
            q.append(min(p[k] + (x != y), p[k + 1] + 1, q[k] + 1))
        p = q
    return p[-1]


def test_distance():
    rnd = random.Random(5)
    for _ in range(800):
        a = [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]
        b = [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]
        assert splits.distance(a, b, 99) == plain_distance(a, b)


@pytest.mark.parametrize("vocabulary", [12, 4000])
def test_pairs_against_brute_force(spark, vocabulary):
    """Also where no word is rare."""
    rnd = random.Random(vocabulary)
    texts = [[f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(3, 40))] for _ in range(40)]
    rows = []
    for i in range(160):
        words = list(rnd.choice(texts))
        for _ in range(rnd.randint(0, 1 + len(words) // 5)):
            k = rnd.randrange(len(words))
            words[k : k + 1] = rnd.choice([[], ["new"], [words[k], "more"]])
        rows.append((i, " ".join(words).title(), rnd.choice(["train", "train", "test", "validation", None, "other"])))
    rows += [(900, None, "train"), (901, "", "test"), (902, "!", "train")]
    got = {(r.row_id_a, r.row_id_b) for r in splits.row_pairs(*splits.split_overlaps(table(spark, rows))).collect()}
    forms = {i: cf.words_of_form(form(t) or "") for i, t, _ in rows}
    want = set()
    for i, _, s in rows:
        for j, _, z in rows:
            if s == "train" and z in ("test", "validation") and forms[i] and forms[j]:
                n = max(len(forms[i]), len(forms[j]))
                if plain_distance(forms[i], forms[j]) <= 0.15 * n + 1e-9:
                    want.add((min(i, j), max(i, j)))
    assert got == want


def test_no_pairs_of_nothing(spark):
    assert splits.row_pairs(*splits.split_overlaps(table(spark, []))).count() == 0


def test_counts_conflicts_and_overlaps(spark):
    rows = [(1, "one two three four", "train", "sms", "1"), (2, "One two three four!", "train", None, "legit"), (3, "one two three four", "test", "sms", " Phishing"), (4, "one two three four", "validation", "chat", None)]
    rows += [(5, "a b c d e f g h i j", "train", "sms", "0"), (6, "a b c d e f g h i k", "test", "sms", "1 "), (7, "quite another text", "test", "sms", "1"), (8, "one two three four", "other", "sms", "0")]
    df = spark.createDataFrame(rows, "row_id BIGINT, text STRING, split_name STRING, source STRING, label STRING")
    links, members = splits.split_overlaps(df)
    assert {tuple(r) for r in splits.conflicts(links, members).collect()} == {(2, 3, "train", "test", None, "sms", "0", "1"), (5, 6, "train", "test", "sms", "sms", "0", "1")}
    assert {tuple(r) for r in splits.split_counts(links, members).collect()} == {
        ("train", "sms", 2, 2, 3, 1), ("train", None, 1, 1, 2, 1), ("test", "sms", 3, 2, 3, 2), ("validation", "chat", 1, 1, 2, 0),
    }
    assert {(r.record_a, r.record_b, r.difference) for r in splits.overlaps(links).collect()} == {(1, 1, 0.0), (5, 6, 0.1)}
    assert all(0 <= r.overlap <= 1 for r in splits.overlaps(links).collect())


def test_no_shared_chunk_is_missed():
    """Two like records share a joined chunk, whatever the corpus counts: common runs, rare ones, any mix."""
    rnd = random.Random(8)
    hashes = splits.Hashes()
    for _ in range(1500):
        vocabulary = [f"w{i}" for i in range(rnd.choice([2, 8, 300]))]
        a = [rnd.choice(vocabulary) for _ in range(rnd.randint(7, 60))]
        b = list(a)
        e = splits.allowed(len(a))
        for _ in range(rnd.randint(1, max(1, e))):
            k = rnd.randrange(len(b))
            b[k : k + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [b[k], "more"], ["more", b[k]]])
        if splits.distance(a, b, 99) > splits.allowed(max(len(a), len(b))) or a == b:
            continue
        counts = np.random.default_rng(rnd.randrange(10**6)).integers(0, rnd.choice([3, 20, 9000]), splits.SKETCH).astype(np.int32)
        row, key, *_ = splits.prefixes([" ".join(a), " ".join(b)], counts, 0.15, hashes)
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_a_hot_chunk_is_dealt_over_salts(spark, monkeypatch):
    """The pairs are the same when every chunk counts as hot."""
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(50)}" for _ in range(30)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(30)] = f"v{rnd.randrange(9)}"
        rows.append((i, " ".join(words), "train" if i % 3 else "test"))
    got = {(r.row_id_a, r.row_id_b) for r in splits.row_pairs(*splits.split_overlaps(table(spark, rows))).collect()}
    keys, shared = splits._keys, []
    monkeypatch.setattr(splits, "RARE", 1)
    monkeypatch.setattr(splits, "_keys", lambda classes, counts, most, every: shared.append(counts) or keys(classes, np.maximum(counts, 3 * splits.HOT), most, every))
    again = {(r.row_id_a, r.row_id_b) for r in splits.row_pairs(*splits.split_overlaps(table(spark, rows))).collect()}
    assert again == got and len(shared) == 2
