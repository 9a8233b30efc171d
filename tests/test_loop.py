import datetime as dt

from pyspark.sql import functions as F

from siftlane import config as c
from siftlane.operators import assess as aa
from siftlane.sources import messages as ms
from siftlane.sources import sinks
from siftlane.streaming import loop as lp

SCHEMA = "event_id LONG, received_at TIMESTAMP_NTZ, event STRING, message STRUCT<type: STRING, text: STRING>, sender STRUCT<id: STRING, name: STRING>, chat_id STRING, chat_hostname STRING"


def event(i, text, kind="message", of="text", chat="a"):
    return (i, dt.datetime(2025, 1, 1, 0, i // 2, i), kind, (of, text), ("u", "U"), chat, None)


EVENTS = [
    event(1, "Team meeting moved to 3 PM tomorrow."), event(2, "Urgent: verify your account now."), event(2, "Urgent: verify your account now."), event(3, "ACK_BLOCK"), event(4, "/mode"),
    event(5, " /MODE Baseline "), event(6, "urgent"), event(7, "Urgent"), event(8, "/mode enhanced"), event(9, "Urgent: verify your account now.", chat="b"), event(10, "x", "subscribed"), event(11, "x", of="picture"),
    event(12, None), (13, dt.datetime(2025, 1, 1, 1), "message", None, None, None, None), event(14, "/mode other"),
]
WANT = {
    1: ("scan", "enhanced", 0, None), 2: ("scan", "enhanced", 3, "[ENHANCED] 🛑"), 3: ("ack", "enhanced", None, None), 4: ("mode", "enhanced", None, "Usage"), 5: ("mode", "baseline", None, "Engine switched to: BASELINE"),
    6: ("scan", "baseline", 2, "[BASELINE] ⚠️"), 7: ("scan", "baseline", 0, None), 8: ("mode", "enhanced", None, "Engine switched to: ENHANCED"), 9: ("scan", "enhanced", 3, "[ENHANCED] 🛑"), 12: ("scan", "enhanced", 0, None), 14: ("mode", "enhanced", None, "Usage"),
}


def told(rows):
    return {r.event_id: (r.kind, r.mode, r.session_tier, r.reply) for r in rows}


def test_event_loop(spark):
    got = told(lp.loop(spark.createDataFrame(EVENTS, SCHEMA), c.EngineConfig()).collect())
    assert got.keys() == WANT.keys()
    for k, (kind, mode, tier, reply) in WANT.items():
        assert got[k][:3] == (kind, mode, tier) and (got[k][3] is None if reply is None else got[k][3].startswith(reply)), (k, got[k])
    assert lp.loop(spark.createDataFrame([], SCHEMA), c.EngineConfig()).count() == 0


def test_event_loop_as_a_stream(spark, tmp_path):
    import os

    src = tmp_path / "in"
    src.mkdir()
    for k, rows in enumerate((EVENTS[:6], EVENTS[6:])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        [part] = (tmp_path / f"p{k}").glob("*.parquet")
        os.utime(part, (1_000_000 + k, 1_000_000 + k))
        part.rename(src / f"{k}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    for _ in range(2):  # run again, nothing is added
        lp.run_stream(stream, c.EngineConfig(), log, out, str(tmp_path / "c")).awaitTermination()
    logged = {r.event_id: r.session_tier for r in spark.read.parquet(log).collect()}
    assert logged == {k: t for k, (kind, _, t, _) in WANT.items() if kind == "scan"} and spark.read.parquet(log).count() == len(logged)
    sent = {r.event_id: r.text for r in spark.read.parquet(out).collect()}
    assert sent.keys() == {k for k, w in WANT.items() if w[3]} and sent[6].startswith("[BASELINE]")


def test_append_once(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "t")
    for batch in (0, 1, 1, 0):
        sinks.append_once(df, path, batch)
    assert spark.read.parquet(path).count() == 10


def test_tables_as_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'Urgent: "verify"\nyour account now. ' + "x" * 60), (2, "hello"), (3, None)], "id INT, text STRING")
    a = aa.assess(rows)
    table = sinks.batch_table(a)
    sinks.write_csv(table, str(tmp_path / "b"), marked=True)
    back = {r[0]: r for r in ms.read_csv(spark, str(tmp_path / "b")).collect()}
    assert {k: r.status for k, r in back.items()} == {"1": "THREAT", "2": "CLEAR", "3": "CLEAR"} and len(back["1"].message) == 53 and "\n" in back["1"].message
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in (tmp_path / "b").glob("*.csv"))
    assert sinks.scan_export(a).where("id = 1").count() == a.where("id = 1").select(F.size("detections")).first()[0]


def test_split_writer(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t, {i}", "x") for i in range(10)], "row_id INT, text STRING, label STRING")
    sinks.write_split(rows, rows.select("row_id", (F.col("row_id") < 3).alias("is_validation")), str(tmp_path / "s"))
    back = [ms.read_csv(spark, str(tmp_path / "s" / x)) for x in ("train", "validation")]
    assert [x.count() for x in back] == [7, 3] and back[0].columns == rows.columns
