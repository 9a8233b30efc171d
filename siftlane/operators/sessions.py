"""Sessions of messages separated by inactivity (problem 3).

Merging interval state: every message opens the interval ``[ts, ts + gap]``;
intervals of one chat that touch become one session.  The batch plan merges in
two steps so that no chat, however hot, is ordered in one task:

1. messages are dealt by ``(chat, time bucket)`` and merged within the bucket;
2. only the first and last partial session of a bucket can continue in another
   bucket, so only these (two a bucket at most) are merged per chat; the others pass
   through the same step each by itself.

The messages are read and shuffled once, the partial sessions once more.

The streaming form, with a watermark for late messages, is in
``siftlane.streaming.conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 900_000
BUCKET_MS = 6 * 3_600_000


def messages(df: DataFrame, chat: str = "chat_id", ts: str = "ts", tier: str = "session_tier", same: tuple[str, ...] = ("sender_name", "message_text", "action_tier", "session_tier", "detections_json")) -> DataFrame:
    """``(chat_id, ms, tier, digest)``: rows alike in ``chat``, ``ts`` and ``same`` have one digest."""
    # a null and an empty field differ, and field ends are marked by their lengths
    told = [F.coalesce(F.concat(F.length(x := F.col(c).cast("string")).cast("string"), F.lit(":"), x), F.lit("-")) for c in same]
    return df.where(F.col(chat).isNotNull() & F.col(ts).isNotNull() & ~F.isnan(F.col(ts).cast("double"))).select(
        F.col(chat).cast("string").alias("chat_id"),
        F.round(F.col(ts).cast("double") * 1000).cast("long").alias("ms"),
        F.coalesce(F.col(tier).cast("long"), F.lit(0)).alias("tier"),
        F.unhex(F.md5(F.concat(*told))).alias("digest"),
    )


def _merge(rows: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """Merges the intervals ``[start_ms, end_ms + gap]`` that touch, per ``keys``."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("start_ms") > F.max("end_ms").over(before) + gap_ms
    return (
        rows.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int"))
        .withColumn("session", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "session")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_events").alias("n_events"), F.max("max_tier").alias("max_tier"))
    )


def sessions(df: DataFrame, gap_ms: int = GAP_MS, bucket_ms: int = BUCKET_MS, **columns) -> DataFrame:
    """``(chat_id, start_ms, end_ms, n_events, max_tier)``, one row for each session.

    Rows without chat or time belong to no session; a null tier counts as 0; rows
    alike in everything but their id are one message, messages at the same
    millisecond are several; a gap of exactly ``gap_ms`` still joins.  An empty
    table gives no rows.  Late rows need no care: all rows are merged by time.
    """
    events = messages(df, **columns).withColumn("bucket", F.floor(F.col("ms") / bucket_ms))
    dealt = events.repartition("chat_id", "bucket")  # the one shuffle of the messages; the keys of the first merge contain it
    once = dealt.groupBy("chat_id", "bucket", "ms", "digest").agg(F.max("tier").alias("tier"))
    at = once.groupBy("chat_id", "bucket", "ms").agg(F.count("*").alias("n_events"), F.max("tier").alias("max_tier"))
    partial = _merge(at.select("chat_id", "bucket", F.col("ms").alias("start_ms"), F.col("ms").alias("end_ms"), "n_events", "max_tier"), ["chat_id", "bucket"], gap_ms)
    w = Window.partitionBy("chat_id", "bucket")
    # alone in the second merge: a session whose gap ends within its own bucket on both sides
    inner = (F.col("session") > 1) & (F.col("session") < F.max("session").over(w))
    alone = partial.withColumn("alone", F.when(inner, F.struct("bucket", "session")))
    own = ["chat_id", "start_ms", "end_ms", "n_events", "max_tier"]
    return _merge(alone.select(*own, "alone"), ["chat_id", "alone"], gap_ms).select(*own)


def by_session_window(df: DataFrame, gap_ms: int = GAP_MS, **columns) -> DataFrame:
    """The same sessions by Spark's own ``session_window``, as the streaming form uses it.

    A hot chat is ordered in one task; kept as the plain counterpart in tests.
    ``session_window`` excludes the gap's end, hence one millisecond more.
    """
    once = messages(df, **columns).groupBy("chat_id", "ms", "digest").agg(F.max("tier").alias("tier"))
    return (
        once.withColumn("at", F.timestamp_millis("ms"))
        .groupBy("chat_id", F.session_window("at", f"{gap_ms + 1} milliseconds"))
        .agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count("*").alias("n_events"), F.max("tier").alias("max_tier"))
        .drop("session_window")
    )
