import json

import pytest

from siftlane.operators import nested as ne

DET = {"match_type": "exact", "risk_score": 1.5, "signals": ["a", "b"], "score_breakdown": {"pattern": "p", "url_info": {"url": "u", "segments": {"subdomains": ["x", "y"]}, "hops": [{"url": "h1", "status": 301}]}}}


def found(spark, *texts):
    df = spark.createDataFrame([(i, t, "extra", 7) for i, t in enumerate(texts)], "id BIGINT, detections_json STRING, child STRING, det_no INT")
    return sorted(tuple(r) for r in ne.found(df).collect())


def test_shapes(spark):
    rows = found(spark, json.dumps([DET, {"match_type": None}]))
    assert set(rows) == {
        (0, 1, "detection", 0, "exact"), (0, 1, "signal", 1, "a"), (0, 1, "signal", 2, "b"), (0, 1, "subdomain", 1, "x"), (0, 1, "subdomain", 2, "y"), (0, 1, "hop", 1, "h1"), (0, 2, "detection", 0, None),
    }
    lone = {**DET, "signals": "only", "score_breakdown": json.dumps({"url_info": {"segments": {"subdomains": "s"}, "hops": {"url": "h"}}})}
    assert [r[2:] for r in found(spark, json.dumps(lone))] == [("detection", 0, "exact"), ("hop", 1, "h"), ("signal", 1, "only"), ("subdomain", 1, "s")]
    assert found(spark, json.dumps(json.dumps([DET]))) == [(0, *r[1:]) for r in found(spark, json.dumps([DET]))]


def test_assessment(spark):
    rows = found(spark, json.dumps({"detections": [DET], "evidence_groups": ["money", "deed"], "global_risk": 1}))
    assert (0, 0, "evidence_group", 1, "money") in rows and (0, 0, "evidence_group", 2, "deed") in rows and (0, 1, "detection", 0, "exact") in rows


def test_nothing_in_broken_or_empty(spark):
    assert found(spark, None, "", "null", "[]", "{", '[{"match_type": "exact"', "12", "{}", '"text"', "[null]") == []


def test_deep_nesting_does_not_crash(spark):
    assert found(spark, "[" * 100_000) == []


def test_deep_records_are_kept(spark):
    deep = "[" * 5000 + '"x"' + "]" * 5000
    det = '{"match_type": "exact", "signals": ["a", ' + deep + '], "more": ' + '{"k": ' * 20_000 + "1" + "}" * 20_000 + "}"
    rows = found(spark, f"[{det}]")
    assert rows == [(0, 1, "detection", 0, "exact"), (0, 1, "signal", 1, "a"), (0, 1, "signal", 2, deep)]
    df = spark.createDataFrame([(5, f"[{det}]")], "id BIGINT, detections_json STRING")
    [row] = ne.flatten(df, payload=True).where("child = 'detection'").collect()
    assert '{"k": ' * 20_000 in ne.deep_loads(row.payload)["rest"]


@pytest.mark.parametrize("text", ["[1, -2.5e3, true, null, \"a\\u00e9\\n\"]", '{"a": {"b": []}, "c": {}, "d": [[], [{}]]}', " [ ] ", '"s"', "12"])
def test_the_explicit_stack_reads_and_writes_the_same(text):
    assert ne.deep_loads(text) == json.loads(text)
    assert ne.deep_dumps(json.loads(text)) == json.dumps(json.loads(text), ensure_ascii=False)


@pytest.mark.parametrize("text", ["", "[", "[1", "[1,]", '{"a"}', '{"a": }', '{"a": 1,}', "[1] 2", "]", "{1: 2}", '"open', "[1 2]"])
def test_the_explicit_stack_rejects_broken_text(text):
    with pytest.raises(ValueError):
        ne.deep_loads(text)


def test_child_tables_link_to_parents(spark):
    df = spark.createDataFrame([(5, json.dumps([DET]))], "id BIGINT, detections_json STRING")
    out = ne.flatten(df, payload=True)
    assert ne.child_table(out, "hop").collect()[0].asDict() == {"id": 5, "det_no": 1, "hop_no": 1, "url": "h1", "status": 301}
    d = ne.child_table(out, "detection").collect()[0]
    assert (d.id, d.det_no, d.risk_score, d.pattern, d.url) == (5, 1, 1.5, "p", "u")


def test_write_tables(spark, tmp_path):
    df = spark.createDataFrame([(5, json.dumps([DET]))], "id BIGINT, detections_json STRING")
    ne.write_tables(ne.flatten(df), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("child = 'signal'").count() == 2


def test_scalars_of_inner_objects_and_unknown_fields_are_kept(spark):
    info = {"url": "u", "segment": "sld", "segments": {"subdomains": ["x"], "sld": "s", "tld": "t", "path": "/p", "query": "q", "port": 8}, "hops": [{"url": "h", "status": 301, "ms": 7}]}
    det = {"match_type": "exact", "engine_rev": 3, "risk_score": "high", "extra": [1], "score_breakdown": {"root": "r", "url_info": info}}
    around = {"detections": [det], "evidence_groups": ["money"], "global_risk": 1.5, "severity": "low", "action_tier": 1, "is_clean": False, "evidence_count": 1, "more": {"a": 1}}
    df = spark.createDataFrame([(5, json.dumps(around)), (6, json.dumps([DET])), (7, "{}")], "id BIGINT, detections_json STRING")
    out = ne.flatten(df, payload=True)
    [a] = ne.child_table(out, "assessment").collect()
    assert (a.id, a.global_risk, a.severity, a.action_tier, a.is_clean, a.evidence_count, json.loads(a.rest)) == (5, 1.5, "low", 1, False, 1, {"more": {"a": 1}})
    d = {r.id: r for r in ne.child_table(out, "detection").collect()}
    assert [d[5][c] for c in ("engine_rev", "root", "url", "segment", "sld", "tld", "path", "query")] == [3, "r", "u", "sld", "s", "t", "/p", "q"]
    assert json.loads(d[5].rest) == {"risk_score": "high", "extra": [1], "score_breakdown": {"url_info": {"segments": {"port": 8}, "hops": {"1": {"ms": 7}}}}}
    assert d[6].rest is None and d[5].risk_score is None
    assert ne.found(df).where("child = 'assessment'").count() == 0
