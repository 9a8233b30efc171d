import random

from siftlane.operators import sessions as ss

SCHEMA = "id BIGINT, ts DOUBLE, chat_id STRING, sender_name STRING, message_text STRING, action_tier INT, session_tier INT, detections_json STRING, bucket STRING, ms INT"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("chat_id", "start_ms", "end_ms", "n_events", "max_tier").collect())


def brute(rows, gap=900_000):
    chats = {}
    for r in {x[1:8] for x in rows if x[2] is not None and x[1] is not None}:
        chats.setdefault(r[1], []).append((round(r[0] * 1000), r[5] or 0))
    out = []
    for chat, events in chats.items():
        events.sort()
        cur = None
        for ms, tier in events:
            if cur and ms - cur[2] <= gap:
                cur[2], cur[3], cur[4] = ms, cur[3] + 1, max(cur[4], tier)
            else:
                if cur:
                    out.append(tuple(cur))
                cur = [chat, ms, ms, 1, tier]
        out.append(tuple(cur))
    return sorted(out)


def test_sessions_against_brute_force(spark):
    rnd = random.Random(1)
    base = 1735690000.0
    rows = []
    for i in range(800):
        t = base + rnd.choice([0, 900, 900.001, 21600 - 0.5, 21600, 43200]) * rnd.randint(0, 6) + rnd.randint(0, 2000) / 1000
        # one chat holds most rows; nulls in every column
        rows.append((i, rnd.choice([t] * 20 + [None]), rnd.choice(["hot"] * 6 + ["b", "c", None]), rnd.choice(["x", None, ""]), rnd.choice(["m", None, ""]), rnd.choice([1, None]), rnd.choice([0, 2, None]), rnd.choice(["[]", None]), "b", 1))
    rows += [(r[0] + 1000, *r[1:]) for r in rows[:200]]  # delivered again under a new id
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(ss.sessions(df)) == brute(rows)
    assert rows_of(ss.by_session_window(df)) == brute(rows)


def test_a_gap_of_exactly_the_limit_joins(spark):
    rows = [(1, 100.0, "a", "s", "t", 0, 1, "", "", 0), (2, 1000.0, "a", "s", "t", 0, None, "", "", 0), (3, 1900.001, "a", "s", "t", 0, 3, "", "", 0)]
    assert rows_of(ss.sessions(spark.createDataFrame(rows, SCHEMA))) == [("a", 100_000, 1_000_000, 2, 1), ("a", 1_900_001, 1_900_001, 1, 3)]


def test_empty_table(spark):
    assert rows_of(ss.sessions(spark.createDataFrame([], SCHEMA))) == []
