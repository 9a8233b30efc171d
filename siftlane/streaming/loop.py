"""The event loop: filter, acknowledgement or mode command, scan, log, reply; in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftlane import config as c
from siftlane.functions.text import strip
from siftlane.operators import assess as aa
from siftlane.operators import matching as mt
from siftlane.sources import messages as ms
from siftlane.sources import sinks
from siftlane.streaming.conversations import ACK

MODES = ("baseline", "enhanced")
# The replies of tiers 2 and 3 and those to the mode command.
TIER_2 = "⚠️ Heads up — this message has some signs of a phishing attempt ({}). Be careful before clicking links or sharing any account details."
TIER_3 = "🛑 CRITICAL WARNING: This conversation shows strong signs of a phishing scam ({}). Do NOT click any links, share your OTP, password, or send money. If you're unsure, verify directly through the official app or hotline — never through a link sent in chat.\n\nTap below once you've read this."
SWITCHED = "Engine switched to: {} (conversation history cleared for a clean comparison)"
USAGE = "Usage: /mode baseline  OR  /mode enhanced (currently: {})"


def filled(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def mode_in_force(events: DataFrame, said: Column, order: tuple[str, ...], at: str = "received_at") -> DataFrame:
    """``events`` with ``mode``: what ``said`` was last, at each event; null before the first.

    Only the events of one minute are ordered together; over the minutes (one row each) goes
    what the last command of each said.
    """
    e = events.withColumn("_said", said).withColumn("_minute", F.date_trunc("minute", at))
    per = e.where("_said IS NOT NULL").groupBy("_minute").agg(F.max_by("_said", F.struct(*order)).alias("_closing"))
    minutes = e.select("_minute").distinct().join(per, "_minute", "left")
    before = Window.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)  # one row a minute
    minutes = minutes.withColumn("_opening", F.last("_closing", ignorenulls=True).over(before)).select("_minute", "_opening")
    inner = Window.partitionBy("_minute").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = e.withColumn("_within", F.last("_said", ignorenulls=True).over(inner)).join(minutes, "_minute")
    return out.withColumn("mode", F.coalesce("_within", "_opening")).drop("_said", "_minute", "_within", "_opening")


def replies(a: DataFrame, tier: str = "action_tier", tag: Column | None = None) -> DataFrame:
    """``a`` with ``reply``, null for tiers 0 and 1, and ``with_keyboard``, true for tier 3; ``tag`` stands before the text."""
    told = aa.pattern_summary(F.col("detections"))
    text = F.when(F.col(tier) == 2, filled(TIER_2, told)).when(F.col(tier) >= 3, filled(TIER_3, told))
    return a.withColumn("reply", F.concat(tag, text) if tag is not None else text).withColumn("with_keyboard", F.col(tier) >= 3)


def loop(events: DataFrame, cfg: c.EngineConfig, mode: str = "enhanced") -> DataFrame:
    """``(event_id, received_at, chat, sender_id, sender_name, kind, mode, action_tier, session_tier, reply, with_keyboard, text, detections)``.

    One row for each text message, deliveries repeated whole counting once.  ``kind`` is ``ack``
    (no scan, no reply), ``mode`` (a command: it sets the mode of all later events, or tells
    the usage) or ``scan``: by the baseline (tier 2 where any pattern stands in the text) or the
    enhanced engine, whichever is in force.  Other events give no rows; an empty table gives none.
    """
    texts = ms.text_events(ms.once(events))
    words = F.split(F.lower(strip(F.col("text"))), r"\s+")
    command = F.startswith(F.lower(strip(F.col("text"))), F.lit("/mode"))
    asked = F.when(F.size(words) == 2, F.try_element_at(words, F.lit(2)))
    valid = command & F.coalesce(asked.isin(*MODES), F.lit(False))
    own = mode_in_force(texts, F.when(valid, asked), ("received_at", "event_id", "chat")).withColumn("mode", F.coalesce("mode", F.lit(mode)))
    own = own.withColumn("kind", F.when(F.col("text") == ACK, "ack").when(command, "mode").otherwise("scan"))
    # matches and scores are worked out for all rows, so that both engines are one narrow stage each
    both = mt.baseline(aa.assess(own, cfg, key="event_id"), cfg)
    scan, base = F.col("kind") == "scan", F.col("mode") == "baseline"
    tier = F.when(scan, F.when(base, F.when(F.size("matches") > 0, 2).otherwise(0)).otherwise(F.col("action_tier")))
    out = replies(both.withColumn("action_tier", tier), tag=F.concat(F.lit("["), F.upper("mode"), F.lit("] ")))
    said = F.when(F.col("kind") == "mode", F.when(valid, filled(SWITCHED, F.upper("mode"))).otherwise(filled(USAGE, F.upper("mode"))))
    return out.select(
        "event_id", "received_at", "chat", "sender_id", "sender_name", "kind", "mode", "action_tier", F.col("action_tier").alias("session_tier"), F.coalesce(said, F.col("reply")).alias("reply"),
        F.coalesce("with_keyboard", F.lit(False)).alias("with_keyboard"), "text", "detections",
    )


def log_of(looped: DataFrame) -> DataFrame:
    """The log rows of the scanned messages, clean ones too."""
    return looped.where("kind = 'scan'").select(F.col("chat").alias("chat_id"), "sender_name", F.col("text").alias("message_text"), "action_tier", "session_tier", F.to_json("detections").alias("detections_json"), "event_id")


def outbox_of(looped: DataFrame) -> DataFrame:
    return looped.where("reply IS NOT NULL").select("event_id", "chat", "sender_id", F.col("session_tier").alias("tier"), F.col("reply").alias("text"), "with_keyboard")


def run_stream(events: DataFrame, cfg: c.EngineConfig, log: str, outbox: str, checkpoint: str) -> StreamingQuery:
    """The loop over a stream of events: each micro-batch goes to the log and the outbox, once even if it is run again.

    The mode in force is carried from batch to batch by the last command in the outbox.
    """
    spark = events.sparkSession
    state = {"mode": "enhanced"}

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            out = loop(kept, cfg, state["mode"])
            sinks.append_once(log_of(out), log, number)
            sinks.append_once(outbox_of(out), outbox, number)
            last = out.where("kind = 'mode'").agg(F.max_by("mode", F.struct("received_at", "event_id", "chat"))).first()[0]
            state["mode"] = last or state["mode"]
        finally:
            kept.unpersist()

    try:
        # after a restart: the last switch that was answered
        before = spark.read.option("basePath", outbox).parquet(f"{outbox.rstrip('/')}/batch=*").where(F.col("text").startswith(SWITCHED.split("{}")[0]))
        last = before.agg(F.max_by("text", F.struct("batch", "event_id"))).first()[0]
        state["mode"] = last.split(": ")[1].split(" ")[0].lower() if last else state["mode"]
    except Exception as e:  # no outbox yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
