import html
import json
import random
from pathlib import Path

import pytest

from siftlane.llm import cuttext as ct
from siftlane.llm import language as lg
from siftlane.llm import pii

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data here")

EN = ["the branch stays open until noon because of repairs", "please bring the ticket to the bank before you argue", "never share the code even when someone calls"]
ES = ["la sucursal cerrará hasta el mediodía por una avería", "traiga el boleto al banco antes de quejarse", "no comparta a nadie el código aunque le llamen"]


def small():
    return lg.Classifier(lg.Centroids(EN + ES, ["en"] * 3 + ["es"] * 3))


def test_stretches():
    runs = small().runs([EN[0] + ". " + EN[1] + ".", EN[0] + ". " + ES[1] + ". " + ES[2], None, "", "12:30 AB12", ES[0].upper(), EN[2] + "\n" + ES[0] + "\n" + EN[1]])
    assert [[x for x, _ in r] for r in runs] == [["en"], ["en", "es"], [], [], [], ["es"], ["en", "es", "en"]]
    assert all(0 <= p <= 1 for r in runs for _, p in r)


def test_language_table(spark):
    samples = spark.createDataFrame([(t, "en") for t in EN] + [(t, "es") for t in ES] + [(None, "en"), ("x", None)], "text STRING, lang STRING")
    rows = [(1, EN[0], "es"), (2, EN[0], "en"), (3, ES[0], None), (4, ES[0], " "), (5, None, "en"), (6, "", None), (7, EN[0] + ". " + ES[1], "en"), (8, ES[1], "und")]
    df = spark.createDataFrame(rows, "row_id BIGINT, text STRING, lang STRING").selectExpr("*", "1 AS seg_no", "'x' AS told")
    got = sorted((r.row_id, r.seg_no, r.lang) for r in lg.mislabelled(lg.labelled(df, samples)).collect())
    assert got == [(1, 1, "en"), (3, 1, "es"), (4, 1, "es"), (7, 1, "en"), (7, 2, "es"), (8, 1, "es")]
    assert lg.labelled(df.limit(0), samples).count() == 0


@needs_data
def test_held_out_accuracy(spark):
    s = spark.read.parquet(f"{DATA}/lang_samples.parquet").collect()
    rnd = random.Random(1)
    rnd.shuffle(s)
    half = len(s) // 2
    c = lg.Classifier(lg.Centroids([r.text for r in s[:half]], [r.lang for r in s[:half]]))
    right = sum(len(x) == 1 and x[0][0] == r.lang for r, x in zip(s[half:], c.runs([r.text for r in s[half:]])))
    assert right / (len(s) - half) >= 0.95


@needs_data
def test_texts_in_no_known_language_are_rejected(spark):
    s = spark.read.parquet(f"{DATA}/lang_samples.parquet").collect()
    c = lg.Classifier(lg.Centroids([r.text for r in s], [r.lang for r in s]))
    other = [
        "Die Bank bleibt heute bis Mittag geschlossen, weil die Leitung repariert wird.", "Oddział pozostanie zamknięty do południa z powodu awarii.",
        "은행은 정오까지 문을 닫습니다", "Şube arıza nedeniyle öğlene kadar kapalı kalacak.", "qwrtz xkcdq", "سيبقى الفرع مغلقا حتى الظهر",
    ]
    assert [[x for x, _ in r] for r in c.runs(other)] == [["und"]] * len(other)
    assert all(0 <= p <= 1 for r in c.runs(other) for _, p in r)
    assert not any(x == "und" for r in c.runs([r.text for r in s]) for x, _ in r)


def test_repeated_rows_are_one_sample(spark):
    rows = [(EN[0], "en")] * 500 + [(x, "en") for x in EN] + [(x, "es") for x in ES]
    df = spark.createDataFrame(rows, "text STRING, lang STRING")
    assert {x for x, _ in lg.Classifier(lg.trained(df, most=6)).runs(ES)[0]} == {"es"}


LEXICON = [(f"{a}{b}", "given") for a in ("Anal", "Dal", "Kath") for b in ("mar", "vel", "wena")] + [(f"{a}{b}", "family") for a in ("Bala", "Quis", "Tan") for b in ("busan", "rimit", "suyon")]


def values(text):
    names = pii.Names([x for x in LEXICON if x[0] not in ("Kathwena", "Tansuyon")] + [("Kathrey", "given"), ("Lorwena", "given"), ("Tanlapaz", "family"), ("Ilasuyon", "family")])
    form, _, places = pii.charforms.located([text])
    return {(k, text[slice(*pii._raw(text, places[0], a, b))]) for k, a, b, v in pii.candidates(form[0], names) if not v & pii.AGAINST}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to dal.vel+x@mail.test or call +63 903 050 8668.", {("email", "dal.vel+x@mail.test"), ("phone", "+63 903 050 8668")}),
        ("a [at] mail [dot] invalid, (02) 5550 1744", {("email", "a [at] mail [dot] invalid"), ("phone", "(02) 5550 1744")}),
        ("My tax ID is 846-594-219, SSS 36-4430716-5, ID CRN-8768-1898831-3, P4610566C", {("identity", x) for x in ("846-594-219", "36-4430716-5", "CRN-8768-1898831-3", "P4610566C")}),
        ("order 5685026922596, TX5775502684, PHP45372, ref 9B9-72791, 2024-02-22", set()),
        ("Deliver it to No. 57 Kalye Lakambini, Dagumbay City and text me", {("address", "No. 57 Kalye Lakambini, Dagumbay City")}),
        ("nakatira sa lot 15 phase 5 harana homes, brgy luntian, san idro 6209 mula pa noong", {("address", "lot 15 phase 5 harana homes, brgy luntian, san idro 6209")}),
        ("We moved to Purok 8, Barangay Maligtas, San Idro last 8.8.2025.", {("address", "Purok 8, Barangay Maligtas, San Idro")}),
        ("Meet me at Raborang Heights by 9.", set()),
        ("Ms. Kathwena Tansuyon sent it; hi Dalmar, ok", {("name", "Kathwena Tansuyon"), ("name", "Dalmar")}),
        ("Pakisabi kay Balabusan, Analvel; si Dalvel dela Tanrimit-Quisbusan", {("name", "Balabusan, Analvel"), ("name", "Dalvel dela Tanrimit-Quisbusan")}),
        ("nick dalmar77 and Dalmar_x", set()),
        ("call ０９０３ ０50 8668 now", {("phone", "０９０３ ０50 8668")}),
        ("", set()),
    ],
)
def test_personal_values(text, want):
    assert values(text) == want


def test_estimates_follow_agreement():
    model = pii.trained([("name", 1 | 2 | 4 | 8, 900), ("name", 2 | 4, 200), ("name", 16, 300), ("name", 2 | 16, 50)])
    assert model["name", 15] > 0.9 and model["name", 6] > 0.5 and model["name", 16] < 0.2


def test_personal_values_table(spark):
    lex = spark.createDataFrame(LEXICON + [(None, "given"), ("x", None)], "name STRING, name_part STRING")
    rows = [("a", 1, "hi Dalmar, mail x@y.test and x@y.test"), ("a", 2, None), ("a", 3, ""), ("b", 1, "no values")] + [("b", i, f"Ms. Kathvel Tansuyon, call 0903050{i:04d}") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "src STRING, key_id BIGINT, text STRING")
    found = pii.judged(df, lex)
    assert {(r.kind, r.value) for r in found.where("src = 'a'").collect()} == {("name", "Dalmar"), ("email", "x@y.test")}
    out = {(r.src, r.key_id): r.text for r in pii.masked(df, found).collect()}
    assert out["a", 1] == "hi [NAME], mail [EMAIL] and [EMAIL]" and out["a", 2] is None and out["a", 3] == "" and out["b", 1] == "no values"
    assert out["b", 10] == "Ms. [NAME], call [PHONE]"
    assert pii.judged(df.limit(0), lex).count() == 0


def corpus():
    rnd = random.Random(9)
    subject = ["The courier", "My aunt", "The clerk", "A neighbour"]
    verb = ["brings the parcel to", "waits for the bus near", "asks for the number of"]
    place = ["the market.", "the station.", "the old bridge.", "the office."]
    say = lambda: f"{rnd.choice(subject)} {rnd.choice(verb)} {rnd.choice(place)}"
    docs = []
    for i in range(300):
        text = " ".join(say() for _ in range(rnd.randint(3, 30)))
        docs.append((i, text[:300] if i % 2 else text.rstrip(".") + rnd.choice([".", "", "…", " 🙏", " #ok"]), "limited" if i % 2 else "free"))
    return docs


def test_cut_texts(spark):
    docs = corpus() + [(900, "My aunt waits for the bus ne", "free"), (901, None, "free"), (902, "", None), (903, "The clerk asks for the num…", None), (904, "  ", "free")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING").selectExpr("*", "1 AS bounds")
    judged = {r.doc_id: r for r in ct.judged(df).collect()}
    cut = {k for k, r in judged.items() if r.cut}
    full = {i for i, t, s in docs if s == "limited" and len(t) == 300 and not t.endswith(".")}
    assert full <= cut and {900, 903} <= cut
    assert not {i for i, t, s in docs if s == "free" and i < 900} & cut
    assert not {901, 902, 904} & set(judged)
    rates = {r.source: r for r in ct.rates(ct.judged(df)).collect()}
    assert rates["limited"].at_limit >= len(full) and rates["free"].cut == 1
    assert ct.judged(df.limit(0)).count() == 0


def test_endings_are_counted_exactly(spark):
    """The digests of "bsjzc" and of "asks for the number of" are alike modulo 2^20: neither may take the other's counts."""
    docs = [(i, "She asks for the number of a bus.", "free") for i in range(10)] + [(i, "We saw bsjzc.", "free") for i in range(10, 210)] + [(900, "She asks for the number of", "free"), (901, "We saw bsjzc", "free")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING")
    assert {r.doc_id for r in ct.judged(df).collect() if r.cut} == {900}


def test_lengths_by_encoding():
    r = random.Random(1)
    plain = {
        "chars": len, "bytes": lambda t: len(t.encode("utf-8", "surrogatepass")), "utf16": lambda t: len(t) + sum(c > "\uffff" for c in t), "html": lambda t: len(html.escape(t)),
        "json": lambda t: len(json.dumps(t, ensure_ascii=False)) - 2, "json_ascii": lambda t: len(json.dumps(t)) - 2, "crlf": lambda t: len(t.replace("\n", "\r\n")),
    }
    for _ in range(2000):
        t = "".join(r.choice("ab\"'&<>\\\n\r\t\b\f\x00\x1f\x7f\x0b é中🙏\ud800") for _ in range(r.randint(0, 12)))
        assert {k: f(t) for k, f in plain.items()} == {k: ct.MEASURES[k](t) for k in plain}


def test_n_grams_are_those_of_a_plain_count():
    """Against a loop over the words, sentence by sentence."""
    speech = ct.Speech(frozenset("my aunt waits for the bus near market clerk asks ok".split()))
    texts = ["My aunt waits. The clerk asks for\nthe bus", "The bus 🙏 near\nOk", "- my aunt\n\nWaits … for", "", "aunt"]
    got = {k: (e, g) for k, e, g in zip(*(x.tolist() for x in ct.ending_counts(texts, [False, False, False, False, True], speech)))}
    want = {}

    def count(words, ends):
        ids = [ct.np.uint64(ct._START) if w == "^" else ct.np.uint64(speech.shape[speech.numbers([w])[0]]) for w in reversed(words)]
        gram = ids[0]
        for k, x in enumerate(ids):
            gram = ct.joined(gram, x) if k else gram
            e, g = want.get(int(gram.view(ct.np.int64)), (0, 0))
            want[int(gram.view(ct.np.int64))] = (e + ends, g + 1 - ends)

    for words, ends in [("^ My", 0), ("^ My aunt", 0), ("^ My aunt waits.", 1), ("^ The", 0), ("^ The clerk", 0), ("^ The clerk asks", 0), ("^ the", 0), ("^ the bus", 1), ("^ The", 0), ("^ The bus", 1), ("^ my", 0), ("^ my aunt", 1), ("^ Waits", 0), ("^ for", 1), ("^ The bus 🙏", 0), ("^ The bus 🙏 near", 1), ("^ Ok", 1)]:
        count(words.split(), ends)
    assert got == want


def limited(spark, docs):
    df = spark.createDataFrame(docs, "doc_id BIGINT, source STRING, text STRING")
    return {(r.source, r.bound) for r in ct.limits(ct.first_pass(df)).where("measure = 'chars'").collect()}


def test_limits_anywhere(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n - 1)) + "x"
    heap = [("a", text(120)) for _ in range(60)] + [("a", text(r.randint(20, 118))) for _ in range(200)]
    one = heap + [("a", text(400))]  # one text that is longer
    two = [("b", x) for _, x in heap] + [("b", text(300)) for _ in range(40)] + [("b", text(r.randint(130, 298))) for _ in range(150)]
    free = [("c", text(r.randint(20, 400))) for _ in range(400)] + [("c", "the same long text of a campaign, sent again and again")] * 90
    got = limited(spark, [(i, s, t) for i, (s, t) in enumerate(one + two + free)])
    assert got == {("a", 120), ("b", 120), ("b", 300)}
