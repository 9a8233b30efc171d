import datetime as dt
import os
import random

from pyspark.sql import functions as F

from siftlane.streaming import conversations as cv


def test_rolling_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot"] * 5 + ["b", None]), rnd.choice([21600.0 * rnd.randint(0, 2) + rnd.randint(-1000, 1000), None]), rnd.choice([0, 1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id INT, chat_id STRING, ts DOUBLE, action_tier INT")
    got = {r.id: (r.window_messages, r.window_max_tier, r.rolling_tier) for r in cv.rolling(df, escalate=True).collect()}
    assert len(got) == len(rows)
    for i, chat, ts, tier in rows:
        own = tier or 0
        if chat is None or ts is None:
            assert got[i] == (1, own, own)
            continue
        before = sorted((t, k, a or 0) for k, c, t, a in rows if c == chat and t is not None and (t, k) <= (ts, i))[-cv.KEEP :]
        seen = [a for t, _, a in before if t >= ts - cv.HORIZON]
        assert got[i] == (len(seen), max(seen), max(own, 3) if sum(a >= 2 for a in seen) >= 2 else own)


def test_late_events_and_null_tiers_come_out(spark, tmp_path):
    """One file a micro-batch; the fourth event is a day late, the fifth a little."""
    src = tmp_path / "in"
    at = lambda s: dt.datetime(2025, 1, 2) + dt.timedelta(seconds=s)
    schema = "chat STRING, event_id LONG, at TIMESTAMP, text STRING, action_tier INT"
    for k, row in enumerate([("a", 1, at(0), "x", 2), ("a", 2, at(600), "y", None), ("a", 3, at(1500), "z", 1), ("a", 4, at(-86_400), "late", 3), ("a", 5, at(700), None, 1)]):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        src.mkdir(exist_ok=True)
        [part] = (tmp_path / f"p{k}").glob("*.parquet")
        os.utime(part, (1_000_000 + k, 1_000_000 + k))
        part.rename(src / f"{k}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = cv.stateful(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: (r.action_tier, r.window_messages, r.window_max_tier) for r in spark.table("late").collect()}
    assert got == {1: (2, 1, 2), 2: (0, 2, 2), 3: (1, 2, 1), 4: (3, 1, 3), 5: (1, 3, 2)}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", 1, at(0), "x", 2), ("a", 2, at(100), "y", 1), ("a", 3, at(101), cv.ACK, 0), ("a", 4, at(2000), "z", 0), ("b", 5, at(50), "w", 3), ("a", 6, at(400_000), "end", 0)]
    schema = "chat STRING, event_id LONG, at TIMESTAMP, text STRING, action_tier INT"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = cv.stateful(stream).writeStream.format("memory").queryName("state").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: (r.window_messages, r.window_max_tier) for r in spark.table("state").collect()}
    assert got == {1: (1, 2), 2: (2, 2), 4: (1, 0), 5: (1, 3), 6: (1, 0)}
    own = stream.select(F.col("chat").alias("chat_id"), "at", F.col("action_tier").alias("tier"))
    q = cv.session_stream(own).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    done = sorted((r.chat_id, r.n_events, r.max_tier) for r in spark.table("sessions").collect())
    assert done == [("a", 1, 0), ("a", 3, 2), ("b", 1, 3)]  # the last is still open
