"""The training-data queries of this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.llm import charforms, copies, cuttext, language, leaks, pii, splits, tokenize
from siftlane.session import table


def texts(spark: SparkSession, d: str) -> DataFrame:
    """``(src, key_id, text)`` of the labelled rows and of the logged messages."""
    a = table(spark, d, "labelled_csv").select(F.lit("labelled_csv").alias("src"), F.col("row_id").alias("key_id"), "text")
    b = table(spark, d, "detections").select(F.lit("detections").alias("src"), F.col("id").alias("key_id"), F.col("message_text").alias("text"))
    return a.unionByName(b)


def unified(df: DataFrame) -> DataFrame:
    """``df`` with ``form`` and ``held``: the one form of ``text``, and whether it held look-alikes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, hits = charforms.unify(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "text"), pa.array(forms, pa.string()), pa.array(hits)], [*(n for n in batch.schema.names if n != "text"), "form", "held"])

    return df.mapInArrow(run, df.drop("text").schema.add("form", "string").add("held", "boolean"))


def p1_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every row, with its confidence and the label the row came with."""
    return language.labelled(table(spark, d, "labelled_csv"), table(spark, d, "lang_samples"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(p1_stretches(spark, d)).select("row_id", "seg_no", "lang")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    # plain ASCII needs no look: it stays in the JVM
    odd = texts(spark, d).where(F.col("text").rlike("[^ -~\\t\\n\\r]"))
    return unified(odd).where("held").select("src", "key_id")


def p7_unified(spark: SparkSession, d: str) -> DataFrame:
    return unified(texts(spark, d)).select("src", "key_id", "form")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "labelled_csv"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.records(table(spark, d, "labelled_csv"))


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every accepted value with its place in the text and its probability."""
    return pii.judged(texts(spark, d), table(spark, d, "name_lexicon")).select("src", "key_id", "kind", "value", "start", "stop", "probability")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_spans(spark, d).select("src", "key_id", "kind", "value").distinct()


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(texts(spark, d), p5_spans(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.row_pairs(*splits.split_overlaps(table(spark, d, "labelled_csv")))


def p6_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """The chunk overlap fraction and the share of differing words of every two linked records."""
    return splits.overlaps(splits.split_overlaps(table(spark, d, "labelled_csv"))[0])


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """The record of every row that takes part, by its smallest row id."""
    return splits.split_overlaps(table(spark, d, "labelled_csv"))[1].select(F.col("id").alias("row_id"), F.col("cid").alias("record"), F.col("split").alias("split_name"), "source", "label")


def p6_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return splits.conflicts(*splits.split_overlaps(table(spark, d, "labelled_csv")))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_counts(*splits.split_overlaps(table(spark, d, "labelled_csv")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts back from their ids: an exact round trip of the whole table."""
    return tokenize.decoded(p8_ids(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return cuttext.judged(table(spark, d, "documents")).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return cuttext.rates(cuttext.judged(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_stretches": p1_stretches,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p5_found": p5_found,
    "p5_spans": p5_spans,
    "p5_masked": p5_masked,
    "p6_found": p6_found,
    "p6_overlaps": p6_overlaps,
    "p6_members": p6_members,
    "p6_conflicts": p6_conflicts,
    "p6_counts": p6_counts,
    "p7_found": p7_found,
    "p7_unified": p7_unified,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

ORACLE_SQL: dict[str, str] = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
