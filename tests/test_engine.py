"""The engine on scenario messages, and its matcher against brute force."""

import random
from pathlib import Path

import pytest

from siftlane import config as c
from siftlane.operators import assess as aa
from siftlane.operators import evaluate as ev
from siftlane.operators import matching as mt
from siftlane.sources import dictionary as dc
from siftlane.sources import messages as ms


DATA = Path("/root/testdata/sf0.001")


def cfg(*patterns, **kw):
    return c.EngineConfig(dictionary=tuple(("general", p) for p in patterns), **kw)


SMALL = cfg("gcash", "blocked", "login")


def run(spark, texts, setting=None, resolutions=None):
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    return [r for r in aa.assess(df, setting, resolutions).orderBy("id").collect()]


def test_worked_example_and_defaults(spark):
    texts = [
        "Urgent: verify your account now.", "verify your account https://gcash-verify.xyz/login", "https://gcash.com/help", "https://mybank.com",
        None, "", "Team meeting moved to 3 PM tomorrow.", "Official customer support hotline and service hours.", "x" * 20_000 + " urgent",
    ]
    a = run(spark, texts)
    assert [(x.pattern, x.risk_score) for x in a[0].detections] == [("urgent", 1.667), ("verify", 1.488), ("account", 1.34)]
    assert (a[0].global_risk, a[0].severity, a[0].action_tier, a[0].evidence_groups) == (1.667, "high", 3, ["action_request", "credential_payment", "urgency_threat"])
    assert a[1].url_info.segment == "lookalike" and "url_risk" in a[1].evidence_groups
    assert a[2].url_info.is_whitelisted and a[2].url_info.segment == "sld" and a[2].is_clean
    assert a[3].url_info.segment != "lookalike"
    assert [(x.is_clean, x.action_tier, x.global_risk) for x in a[4:8]] == [(True, 0, 0.0)] * 4
    assert a[8].detections[0].pattern == "urgent"


def test_layers(spark):
    assert run(spark, ["please click this https link to verify urgent"], cfg("otp"))[0].is_clean
    assert run(spark, ["Pakibigay ang otq mo agad, urgent!"], cfg("otp"))[0].detections[0].match_type == "fuzzy"
    hits = run(spark, ["URGENT! I-verify mo agad ang gcashin mo, baka ma-suspend!"], SMALL)[0].detections
    assert ("gcash", "affix") in [(x.pattern, x.match_type) for x in hits]
    exact = run(spark, ["account account suspended", "click click here"], cfg("account suspended", "click here", "account", "click"))
    assert any(x.pattern == "account suspended" for x in exact[0].detections) and any(x.pattern == "click here" for x in exact[1].detections)


def test_links(spark):
    texts = [
        "https://viber.com/help", "See https://gcash.com/help then https://bit.ly/abc123", "See https://gcash.com/help then https://gcash.com.verify-now.xyz/login",
        "https://gcash.com:8443/help", "https://gcash.com.verify-now.xyz:8443/login", "https://gcash.com@evil-site.xyz/login", "https://gcash.com/help and https://www.bpi.com.ph/security",
    ]
    a = run(spark, texts, SMALL)
    assert [(x.url_info.segment, x.url_info.is_whitelisted) for x in a[:5]] == [("sld", True), ("shortener", False), ("subdomain", False), ("sld", True), ("subdomain", False)]
    assert not a[5].url_info.is_whitelisted
    assert a[6].url_info.is_whitelisted and a[6].url_info.multiplier == 1.0


def test_resolutions(spark):
    known = [("https://bit.ly/video", "https://www.youtube.com/watch?v=1"), ("https://bit.ly/abc", "https://bpi-security-update.com/x"), ("https://bit.ly/xK92p", "https://bit.ly/xk92p"), ("https://bit.ly/u", None)]
    known += [(f"https://bit.ly/t{i}", "https://www.bpi.com.ph/x") for i in range(4)]
    res = spark.createDataFrame(known, "url STRING, destination STRING")
    texts = ["check this out https://bit.ly/video", "https://bit.ly/abc", "https://bit.ly/xK92p", "https://bit.ly/u", " ".join(f"https://bit.ly/t{i}" for i in range(4)), None, "https://bit.ly/t0"]
    a = run(spark, texts, None, res)
    assert (a[0].url_info.segment, a[0].action_tier) == ("none", 0)
    assert [(x.pattern, x.risk_score) for x in a[1].detections if x.match_type == "url_shortener"] == [("SHORTENED_LINK_DESTINATION", 2.0)]
    assert a[2].url_info.segment == a[3].url_info.segment == "shortener"
    assert a[4].url_info.segment == "shortener"  # the fourth is not looked up
    assert a[6].url_info.is_whitelisted


def test_scores_are_those_of_the_columns(spark):
    """The Arrow stage against the column form, over all logged messages of the smallest set and odd links."""
    from pyspark.sql import functions as F

    texts = [
        "go https://redirect.viglink.com/?format=go&u=https%3A%2F%2Fphishing.example%2Flogin", "HTTPS://Bit.LY/abc. and bit.ly/u", "www.gcash.com:80/x?y=verify", "a.b", "x@y.zz/otp?pin", "https://", "né.com/é",
        "p@ssw0rd ９９ 99", "verify 'account' https://bit.ly/v", "https://bit.ly/v https://bit.ly/w https://bit.ly/abc https://bit.ly/w", "\x1curgent\x85", "otp" * 50,
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    if DATA.exists():
        rows += [(r.id + 100, r.message_text) for r in spark.read.parquet(f"{DATA}/detections.parquet").collect()]
    df = spark.createDataFrame(rows, "id BIGINT, text STRING")
    known = [("https://bit.ly/v", "https://viglink.com/?u=https%3A%2F%2Fgcash-verify.test%2Fx"), ("https://bit.ly/w", "https://www.bpi.com.ph/x"), ("HTTPS://Bit.LY/abc.", "https://tinyurl.com/a")]
    res = spark.createDataFrame(known, "url STRING, destination STRING")
    setting = c.EngineConfig()
    for r in (None, res):
        names = ["id", "url_info", "anomaly", "detections", "n_layer_hits", "global_risk", "evidence_groups"]
        one = {x.id: x for x in aa.with_detections(df, setting, r).select(*names).collect()}
        two = {x.id: x for x in aa.with_detections_by_columns(df, setting, r).select(*names).collect()}
        assert one == two


def test_a_large_dictionary_builds_fast():
    import time

    rnd = random.Random(1)
    patterns = {"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rnd.randint(4, 14))).strip() for _ in range(20_000)}
    began = time.perf_counter()
    mt.Matcher(cfg(*patterns))
    assert time.perf_counter() - began < 15


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "urgent: verify", "x", 2, 3)], "id INT, text STRING, hits STRING, detections INT, severity INT")
    assert aa.assess(df).collect()[0].severity == "high"
    assert aa.assess(df.limit(0)).count() == 0


def test_gate(spark):
    a = run(spark, ["Urgent: verify your account now."], c.EngineConfig(min_evidence=4))[0]
    assert (a.raw_action_tier, a.action_tier, a.severity, a.gate_passed) == (3, 1, "low", False)


def test_matcher_against_brute_force():
    rnd = random.Random(7)
    patterns = ["otp", "account", "click here", "i-verify", "verify", "pin", "na-block", "ka"]
    filler = ["the", "otq", "acc0unt", "verifi", "x", "-", "click", "here", "mag-verifyhin", "é", "p1n", "ok!"]
    for k in (0, 1, 2):
        m = mt.Matcher(cfg(*patterns, max_errors=k))
        for _ in range(150):
            text = rnd.choice(["", " ", ". "]).join(rnd.choice(patterns + filler) for _ in range(rnd.randint(1, 8)))
            clean = m.clean(text)
            edge = lambda i: i < 0 or i >= len(clean) or not (clean[i].isalnum() or clean[i] == "_")  # noqa: E731, B023
            want = set()
            for j, n in enumerate(m.norms):
                for i in range(len(clean) - len(n) + 1):
                    e = sum(a != b for a, b in zip(clean[i : i + len(n)], n))
                    if edge(i - 1) and edge(i + len(n)):
                        if e == 0:
                            want.add(("exact", j, i + len(n) - 1, 0))
                        elif e <= k and len(n) >= 3:
                            want.add(("fuzzy", j, i + len(n) - 1, e))
            got = {(h[0], h[1], h[4], h[2]) for h in m.hits(text) if h[0] != "affix"}
            assert got == want, text


def test_verified_links_are_blanked():
    m = mt.Matcher(SMALL)
    assert "gcash" not in m.clean("https://gcash.com/help, ok") and len(m.clean("a https://gcash.com/x b")) == len("a https://gcash.com/x b")
    assert "gcash" in m.clean("https://gcash.com.evil.xyz/x")


def test_exact_layer_without_python(spark):
    setting = cfg("otp", "account", "code")
    df = spark.createDataFrame([(1, "otp account0 code otp"), (2, None), (3, ""), (4, "coded otp.")], "id INT, text STRING")
    by_columns = sorted(tuple(r) for r in mt.exact_by_columns(df, setting).collect())
    m = mt.Matcher(setting)
    assert by_columns == sorted((i, h[1], h[3], h[4]) for i, t in ((1, "otp account0 code otp"), (4, "coded otp.")) for h in m.hits(t) if h[0] == "exact")


def test_dictionary_file(spark, tmp_path):
    p = tmp_path / "d.txt"
    p.write_text("# c\n[category: a]\nOne \none\n[b]\ntwo\n", encoding="utf-8")
    assert dc.engine_from_file(spark, str(p)).dictionary == (("a", "One"), ("b", "two"))
    assert dc.engine_from_file(spark, str(tmp_path / "none.txt")).dictionary == ()
    table = spark.createDataFrame([(0, "a", "One"), (1, "b", "two")], "idx INT, category STRING, pattern STRING")
    dc.save(table, str(p))
    assert dc.engine_from_file(spark, str(p)).dictionary == (("a", "One"), ("b", "two"))


def test_csv_and_pages(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('text,label\n"two\nlines, ""quoted""",1\n,0\n', encoding="utf-8")
    rows = ms.labelled(ms.read_csv(spark, str(p))).collect()
    assert [(r.text, r.is_positive) for r in rows] == [('two\nlines, "quoted"', True), ("", False)]
    assert ms.text_column(["id", "Message_Body"]) == "Message_Body" and ms.text_column(["id"]) is None
    text, links = ms.read_page('<div>Hi<br>there</div><p>see <a href="https://x.test">link</a></p><a href="u">open')
    assert text.split("\n")[0] == "Hi" and "link https://x.test" in text and links == [{"href": "https://x.test", "label": "link"}]
    assert ms.read_page(None) == (None, [])


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "p BOOLEAN, y BOOLEAN")
    from pyspark.sql import functions as F

    r = ev.confusion(df, F.col("p"), F.col("y")).collect()[0]
    assert (r.tp, r.f1, r.fpr, r.accuracy) == (0, 0.0, 0.0, 0.0)


def test_display_modes(spark):
    from pyspark.sql import functions as F

    rows = [(1, ["a"], "silent"), (2, ["a"], "silent"), (2, ["a", "b"], "collapsed"), (3, ["url_risk"], "collapsed"), (3, ["a", "b"], "banner"), (3, ["a"], "silent"), (3, None, "banner"), (3, [], "silent")]
    df = spark.createDataFrame(rows, "t INT, g ARRAY<STRING>, want STRING")
    for r in df.withColumn("got", aa.display_mode(F.col("t"), F.col("g"))).collect():
        assert r.got == r.want, r


@pytest.mark.parametrize("fraction", [0.2, 0.5])
def test_split_keeps_texts_together(spark, fraction):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 40}", i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id INT, text STRING, y BOOLEAN")
    out = ev.leak_free_split(df, F.col("text"), F.col("y"), fraction).join(df, "row_id")
    assert out.count() == 300
    assert out.groupBy("text").agg(F.countDistinct("is_validation").alias("n")).where("n > 1").count() == 0


def test_labelled_texts_are_whole_unless_cut_on_demand(spark, tmp_path):
    from siftlane.plans import engine
    from siftlane.sources import messages

    df = spark.createDataFrame([(1, "ab" * 300, " 1"), (2, None, None)], "row_id BIGINT, text STRING, label STRING")
    df.write.parquet(f"{tmp_path}/labelled_csv.parquet")
    got = {tuple(r) for r in engine.QUERIES["src_labelled"](spark, str(tmp_path)).collect()}
    assert got == {(1, "ab" * 300, True), (2, "", False)}
    assert {r.row_id: r.text for r in messages.labelled(df, most=5).collect()} == {1: "ababa", 2: ""}
