"""Where results go: the detection log, replies, tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.functions.text import preview


def append_once(rows: DataFrame, path: str, batch: int) -> None:
    """Appends ``rows`` to the Parquet table at ``path`` as batch ``batch``; written again, a batch replaces itself.

    So a micro-batch that is run again after a failure leaves no row twice.  An empty batch leaves none.
    """
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={int(batch)}")


def batch_table(assessed: DataFrame, key: str = "id", text: str = "text", threat: float = 1.5) -> DataFrame:
    """``(row, message, signals_found, max_risk_score, status)``: one line a message, its text shortened for display.

    A message with any visible detection of a pattern or link is a THREAT, with a heuristic one only a REVIEW.
    """
    x = F.col("detections")
    visible = F.filter(x, lambda t: (t["match_type"] == "anomaly") | (t["risk_score"] >= threat))
    status = F.when(F.exists(visible, lambda t: t["match_type"] != "anomaly"), "THREAT").when(F.size(visible) > 0, "REVIEW").otherwise("CLEAR")
    most = F.coalesce(F.array_max(F.transform(visible, lambda t: t["risk_score"])), F.lit(0.0))
    return assessed.select(F.col(key).alias("row"), preview(F.col(text)).alias("message"), F.size(visible).alias("signals_found"), most.alias("max_risk_score"), status.alias("status"))


def scan_export(assessed: DataFrame, key: str = "id") -> DataFrame:
    """``(id, risk_score, alert, context)`` of every detection."""
    return assessed.select(key, F.explode("detections").alias("x")).select(key, "x.risk_score", "x.alert", "x.context")


def write_csv(df: DataFrame, path: str, marked: bool = False) -> None:
    """A folder of CSV files with headers; quotes are doubled, line breaks kept; ``marked`` puts a byte-order mark before the first name."""
    if marked:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_split(rows: DataFrame, split: DataFrame, path: str, key: str = "row_id") -> None:
    """The rows of a split (``key, is_validation``) as two CSV folders, ``train`` and ``validation``, with their own columns."""
    both = rows.join(split.select(key, "is_validation"), key)
    for name, wanted in (("train", False), ("validation", True)):
        write_csv(both.where(F.col("is_validation") == wanted).select(*rows.columns), f"{path.rstrip('/')}/{name}")
