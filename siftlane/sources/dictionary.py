"""Pattern dictionaries: parse, clean, change, write; and as an engine's setting.

A dictionary is small by its nature (it is broadcast with the engine); ``MAX_PATTERNS``
is checked wherever one is taken from a table.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlane import config as c
from siftlane.functions.text import normalize, strip

MAX_PATTERNS = 100_000


def parse(lines: DataFrame, line: str = "line", number: str = "line_no") -> DataFrame:
    """``(line_no, category, pattern)`` of a categorised pattern text.

    ``# category: x``, ``[category: x]`` or ``[x]`` switch the category (empty: ``general``);
    other ``#`` lines and blank ones are skipped.  A window over all lines: a pattern text is small.
    """
    text = strip(F.col(line))
    hashed = F.lower(text).startswith("# category:")
    boxed = text.startswith("[") & text.endswith("]")
    inner = strip(F.expr("substring(_t, 2, length(_t) - 2)"))
    named = F.when(F.lower(inner).startswith("category:"), strip(F.regexp_replace(inner, r"^[^:]*:", ""))).otherwise(inner)
    header = F.when(hashed, strip(F.regexp_replace(text, r"^[^:]*:", ""))).when(boxed, named)
    rows = lines.withColumn("_t", text).withColumn("_h", F.when(hashed | boxed, F.when(header == "", "general").otherwise(header)))
    whole = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("category", F.coalesce(F.last("_h", ignorenulls=True).over(whole), F.lit("general")))
    return rows.where((F.col("_t") != "") & F.col("_h").isNull() & ~F.col("_t").startswith("#")).select(number, "category", F.col("_t").alias("pattern"))


def clean(patterns: DataFrame, order: str = "idx", category: str = "category", pattern: str = "pattern") -> DataFrame:
    """``(idx, category, pattern)``: stripped, without blanks and comments, each once in its category whatever its case."""
    p = strip(F.col(pattern))
    rows = patterns.where(p.isNotNull() & (p != "") & ~p.startswith("#")).select(F.col(order).alias("idx"), F.coalesce(F.col(category), F.lit("general")).alias("category"), p.alias("pattern"))
    first = Window.partitionBy("category", F.lower("pattern")).orderBy("idx")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def add(patterns: DataFrame, new: DataFrame, category: str) -> DataFrame:
    """``patterns`` with those of ``new(pattern)`` that none equals, whatever the case and category."""
    p = strip(F.col("pattern"))
    fresh = new.select(p.alias("pattern")).where((p != "") & ~p.startswith("#")).groupBy(F.lower("pattern").alias("_k")).agg(F.min("pattern").alias("pattern"))
    known = patterns.select(F.lower("pattern").alias("_k")).distinct()
    top = patterns.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("_m"))
    fresh = fresh.join(known, "_k", "left_anti").crossJoin(F.broadcast(top))  # one row
    place = F.row_number().over(Window.orderBy("pattern"))
    return patterns.select("idx", "category", "pattern").unionByName(fresh.select((F.col("_m") + place).cast("int").alias("idx"), F.lit(category).alias("category"), "pattern"))


def to_text(patterns: DataFrame) -> DataFrame:
    """``(first_idx, category, block)``: one block of text per category, in order."""
    by = patterns.groupBy("category").agg(F.min("idx").alias("first_idx"), F.array_sort(F.collect_list(F.struct("idx", "pattern"))).alias("own"))
    lines = F.array_join(F.transform("own", lambda x: x["pattern"]), "\n")
    return by.select("first_idx", "category", F.concat(F.lit("[category: "), F.col("category"), F.lit("]\n"), lines, F.lit("\n")).alias("block"))


def baseline_patterns(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that are no blank, comment or header; no categories, nothing is dropped twice."""
    t = strip(F.col(line))
    return lines.where((t != "") & ~t.startswith("#") & ~t.startswith("[")).select(t.alias("pattern"))


def listing(patterns: DataFrame) -> DataFrame:
    return patterns.select("category", "pattern", normalize(F.col("pattern")).alias("norm"))


def evidence_group(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in c.EVIDENCE_OF_CATEGORY.items() for x in kv]), category)


def engine(patterns: DataFrame, **settings) -> c.EngineConfig:
    """An engine's setting with the dictionary of a table, categories in order of their first pattern."""
    rows = clean(patterns).orderBy("idx").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns; a dictionary is broadcast")
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["category"], []).append(r["pattern"])
    return c.EngineConfig(dictionary=tuple((k, p) for k, ps in by.items() for p in ps), **settings)


def engine_from_file(spark: SparkSession, path: str, **settings) -> c.EngineConfig:
    """As ``engine``, from a pattern text; a missing file gives an empty dictionary."""
    if not Path(path).exists():
        return c.EngineConfig(dictionary=(), **settings)
    lines = [(i, x) for i, x in enumerate(Path(path).read_text(encoding="utf-8").splitlines())]
    return engine(parse(spark.createDataFrame(lines, "line_no INT, line STRING")).withColumnRenamed("line_no", "idx"), **settings)


def save(patterns: DataFrame, path: str) -> None:
    """Writes a pattern text; the dictionary is small, and more than ``MAX_PATTERNS`` are an error."""
    if patterns.count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns; a pattern text is written by the driver")
    blocks = [r["block"] for r in to_text(patterns).orderBy("first_idx").collect()]
    # The lines at the head of a pattern text.
    head = "# Categorized phishing ruleset\n# One pattern per line within each category\n\n"
    Path(path).write_text(head + "\n".join(blocks).rstrip() + "\n", encoding="utf-8")
