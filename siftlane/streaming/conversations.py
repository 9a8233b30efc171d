"""Conversations: rolling state per chat, as a stream and in batch; sessions as a stream.

State is by event time: a message sees what its chat sent in the ``HORIZON`` before it,
``KEEP`` messages at most.  In batch a hot chat is dealt by time buckets; a bucket also
gets, as context, the messages of the horizon before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HORIZON, KEEP = 900, 10
BUCKET = 6 * 3600
ACK = "ACK_BLOCK"
#: A message up to so many seconds late sees its whole window; a chat's state holds so many messages, and is dropped when idle so long.
LATE, REMEMBERED, IDLE_MS = 900, 200, 3_600_000


def rolling(df: DataFrame, chat: str = "chat_id", ts: str = "ts", tier: str = "action_tier", order: str = "id", escalate: bool = False) -> DataFrame:
    """``df`` with ``window_messages``, ``window_max_tier`` and ``rolling_tier``.

    The window holds the message and those of its chat within ``HORIZON`` seconds before it, the
    last ``KEEP`` of them.  ``rolling_tier`` is the message's own tier; with ``escalate`` it is 3
    where two messages of the window have tier 2 or more.  Rows without chat or time stand
    alone; a null tier counts as 0.
    """
    known = F.col(chat).isNotNull() & F.col(ts).isNotNull()
    t = F.col(ts).cast("double")
    rows = df.withColumn("_b", F.when(known, F.floor(t / BUCKET))).withColumn("_s", F.xxhash64(order))
    late = known & (t >= (F.col("_b") + 1) * BUCKET - HORIZON)
    # the end of a bucket is context of the next one
    spread = rows.withColumn("_e", F.explode(F.when(late, F.array(F.struct(F.lit(0).alias("d"), F.lit(False).alias("ctx")), F.struct(F.lit(1).alias("d"), F.lit(True).alias("ctx")))).otherwise(F.array(F.struct(F.lit(0).alias("d"), F.lit(False).alias("ctx"))))))
    spread = spread.withColumn("_b", F.when(known, F.col("_b") + F.col("_e.d")).otherwise(F.col("_s")))
    w = Window.partitionBy(chat, "_b").orderBy(ts, order).rowsBetween(-(KEEP - 1), 0)
    near = F.filter(F.collect_list(F.struct(t.alias("t"), F.coalesce(F.col(tier), F.lit(0)).alias("tier"))).over(w), lambda x: x["t"] >= t - HORIZON)  # KEEP entries at most
    seen = spread.withColumn("_w", F.when(known, near).otherwise(F.array(F.struct(t.alias("t"), F.coalesce(F.col(tier), F.lit(0)).alias("tier"))))).where(~F.col("_e.ctx"))
    tiers = F.transform("_w", lambda x: x["tier"])
    own = F.coalesce(F.col(tier), F.lit(0))
    raised = F.when(F.size(F.filter(tiers, lambda x: x >= 2)) >= 2, F.greatest(own, F.lit(3))).otherwise(own)
    out = seen.withColumn("window_messages", F.size("_w")).withColumn("window_max_tier", F.array_max(tiers)).withColumn("rolling_tier", raised if escalate else own)
    return out.drop("_b", "_s", "_e", "_w")


OUT = "chat STRING, event_id LONG, ts DOUBLE, action_tier INT, window_messages INT, window_max_tier INT, acknowledged BOOLEAN"
STATE = "times ARRAY<DOUBLE>, tiers ARRAY<INT>, acknowledged BOOLEAN"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    times, tiers, acknowledged = state.get if state.exists else ([], [], False)
    seen = list(zip(times, tiers))
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    out = []
    for r in rows.itertuples():
        if r.text == ACK:
            acknowledged = True
            continue
        tier = 0 if pd.isna(r.action_tier) else int(r.action_tier)
        window = [b for a, b in seen if r.ts - HORIZON <= a <= r.ts][-(KEEP - 1) :] + [tier]
        seen = sorted([*seen, (r.ts, tier)], key=lambda x: x[0])
        seen = [x for x in seen if x[0] >= seen[-1][0] - HORIZON - LATE][-REMEMBERED:]
        acknowledged = False  # any further message takes an acknowledgement back
        out.append((key[0], r.event_id, r.ts, tier, len(window), max(window), acknowledged))
    state.update(([a for a, _ in seen], [b for _, b in seen], acknowledged))
    state.setTimeoutTimestamp(max(int(rows["arrived"].max() * 1000), state.getCurrentWatermarkMs()) + IDLE_MS)
    yield pd.DataFrame(out, columns=["chat", "event_id", "ts", "action_tier", "window_messages", "window_max_tier", "acknowledged"])


def stateful(events: DataFrame) -> DataFrame:
    """The same rolling state over a stream of ``(chat, event_id, at TIMESTAMP, text, action_tier)``.

    Every message comes out, however late: the watermark, which only ends idle states, is on
    the time of arrival, so it never drops a message.  One up to ``LATE`` seconds late is judged by the messages before it; a later one by those
    that the state still holds.  A null tier counts as 0, a null text as any text.
    """
    now = F.current_timestamp()
    src = events.withColumn("ts", F.col("at").cast("double")).withColumn("seen_at", now).withColumn("arrived", now.cast("double")).withWatermark("seen_at", "0 seconds")
    return src.groupBy("chat").applyInPandasWithState(_fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def session_stream(events: DataFrame, gap_ms: int = 900_000, watermark: str = "1 day") -> DataFrame:
    """Sessions of a stream of ``(chat_id, at TIMESTAMP, tier)``, closed when the watermark has passed them.

    Every message opens an interval of the gap; intervals of a chat that overlap merge, also
    with those of messages that come late but within the watermark.
    """
    own = F.session_window("at", f"{gap_ms + 1} milliseconds")
    return (
        events.withWatermark("at", watermark)
        .groupBy("chat_id", own)
        .agg(F.min("at").alias("start_at"), F.max("at").alias("end_at"), F.count("*").alias("n_events"), F.max(F.coalesce("tier", F.lit(0))).alias("max_tier"))
        .drop("session_window")
    )
