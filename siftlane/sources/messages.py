"""Where messages come from and go to: CSV, webhook events, pages, logs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane import config as c
from siftlane.functions.text import strip
from siftlane.functions.urls import is_under

#: A webhook event as JSON.
EVENT = "event STRING, message STRUCT<type: STRING, text: STRING>, sender STRUCT<id: STRING, name: STRING>, chat_id STRING, chat_hostname STRING"

_TEXT_COLUMNS = ("message", "text", "body", "subject")


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV with a header, all columns strings; quoted line breaks and very long fields are kept."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, **options).csv(path)


def text_column(names: list[str]) -> str | None:
    """The first column whose name tells of a text."""
    return next((n for n in names if any(x in n.lower() for x in _TEXT_COLUMNS)), None)


def positive(label: Column, wanted: str = "1") -> Column:
    """Whether a label is the positive one, without regard to case and blanks; null is not."""
    return F.coalesce(F.lower(strip(label.cast("string"))) == wanted.strip().lower(), F.lit(False))


def labelled(df: DataFrame, text: str = "text", label: str = "label", wanted: str = "1", most: int | None = None) -> DataFrame:
    """``df`` with ``text`` (missing: empty, cut to ``most`` characters if given) and ``is_positive``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumn("is_positive", positive(F.col(label), wanted)).withColumn("text", F.substring(t, 1, most) if most is not None else t)


def profile(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n)``: how often each label value stands, null included."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def _or(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(x != "", x) for x in columns])


def text_events(events: DataFrame) -> DataFrame:
    """Text messages among webhook events, with the conversation they belong to.

    A missing sender is ``unknown``; a chat falls back to the sender.  Other events give
    no rows; repeated events are kept (see ``once``).
    """
    sender = F.coalesce(F.col("sender.id"), F.lit("unknown"))
    return events.where((F.col("event") == "message") & (F.col("message.type") == "text")).select(
        "event_id", "received_at", F.coalesce(_or(F.col("chat_hostname"), F.col("chat_id")), sender).alias("chat"), sender.alias("sender_id"),
        F.coalesce(F.col("sender.name"), F.lit("unknown")).alias("sender_name"), F.coalesce(F.col("message.text"), F.lit("")).alias("text"),
    )


def once(events: DataFrame) -> DataFrame:
    """Events delivered again as they were count once."""
    return events.dropDuplicates()


def bare_trusted(text: Column) -> Column:
    """Whether a text is nothing but a link to a trusted domain, which a page scan skips."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"^https?://", ""), r"/.*$", "")
    return is_under(bare, c.TRUSTED_PAGES)


def log_rows(assessed: DataFrame, chat: str = "chat_id", sender: str = "sender_name", text: str = "text") -> DataFrame:
    """The rows of a detection log, clean messages too: detections as JSON."""
    return assessed.select(chat, sender, F.col(text).alias("message_text"), "action_tier", F.col("action_tier").alias("session_tier"), F.to_json("detections").alias("detections_json"))


_BLOCKS = frozenset("address article blockquote div figcaption h1 h2 h3 h4 h5 h6 li p pre section".split())


class _Page(HTMLParser):
    """Text of a page: blocks and breaks on lines, links with their target; and its links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.href: str | None = None
        self.label: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.href, self.label = dict(attrs).get("href"), []
        if tag in _BLOCKS or tag in ("a", "br"):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        (self.label if self.href is not None else self.out).append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.href is not None:
            label, href = "".join(self.label).strip(), self.href.strip()
            self.links.append((self.href, label))
            self.out.append(label + (f" {href}" if href and href != label else ""))
            self.href = None
        if tag in _BLOCKS or tag == "a":
            self.out.append("\n")

    def text(self) -> str:
        return re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+\n", "\n", "".join(self.out))).strip()


def read_page(html: str | None) -> tuple[str | None, list[dict]]:
    if html is None:
        return None, []
    page = _Page()
    page.feed(html)
    page.close()
    return page.text(), [{"href": h, "label": x} for h, x in page.links]


def with_page(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with ``page_text`` and ``page_links``; an anchor without its end has no link."""
    links = pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_page(x) for x in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array([x for x, _ in read], pa.string()), pa.array([y for _, y in read], links)], [*batch.schema.names, "page_text", "page_links"])

    df = df.drop("page_text", "page_links")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "page_text STRING, page_links ARRAY<STRUCT<href: STRING, label: STRING>>"])
    return df.mapInArrow(run, schema)
