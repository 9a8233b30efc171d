"""Records that are the same but for their formatting (problem 4).

Merkle hashing: each record's root digest is made bottom-up from its normalised
leaves (see ``commonform``).  Rows are grouped by root digest, and within a digest
the full structures are compared, so that no digest alone makes two rows copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlane.llm import commonform as cf
from siftlane.session import written

#: A record of more rows is broadcast to them; its rows are not shuffled.
HOT = 10_000


def with_forms(df: DataFrame, id_col: str, text_col: str, *keep: str, form: bool = True) -> DataFrame:
    """``(id, *keep, root, form)``; rows of null text and of text without words are left out.

    One narrow Arrow stage; nothing is shuffled.
    """
    cols = [F.col(id_col).cast("long").alias("id"), *[F.col(k) for k in keep], F.col(text_col).cast("string").alias("text")]
    src = df.select(*cols).where(F.col("text").isNotNull())
    out = src.drop("text").schema.add("root", "binary")
    if form:
        out = out.add("form", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = cf.common_forms(batch.column(batch.num_columns - 1).to_pylist())
            has = pa.array([bool(x) for x in forms])
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays.append(pa.array([cf.root_digest(x) if x else None for x in forms], pa.binary()))
            names = [*batch.schema.names[:-1], "root"]
            if form:
                arrays.append(pa.array([x or None for x in forms], pa.string()))
                names.append("form")
            yield pa.RecordBatch.from_arrays(arrays, names).filter(has)

    return src.mapInArrow(run, out)


def groups(forms: DataFrame) -> DataFrame:
    """``(root, form, keep_id, copies)``: one row per record, counted over all rows.

    Grouping by the digest and the full structure confirms each match: two
    structures with one digest would make two groups.  Partial aggregation keeps
    a hot record to one row a task before the shuffle.
    """
    return forms.groupBy("root", "form").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))


def copies(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """``(keep_id, copy_id)`` for each row that is not the first of its record.

    Null texts and texts without any word are no records and have no copies;
    exact copies count; an empty table gives no rows.
    """
    forms = written(with_forms(df, id_col, text_col), "copy-forms")
    # records of more than HOT rows, looked for where a digest has so many: as each has its rows, they are 1 / HOT of the rows and of the texts at most
    many = forms.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("root")
    hot = F.broadcast(written(groups(forms.join(F.broadcast(many), "root")).where(F.col("copies") > HOT).drop("copies"), "copy-hot"))
    of_hot = forms.join(hot, ["root", "form"])
    # all other rows go to those of their digest and structure, in one shuffle of the texts
    others = forms.join(hot, ["root", "form"], "left_anti").withColumn("keep_id", F.min("id").over(Window.partitionBy("root", "form")))
    return of_hot.unionByName(others).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def records(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """``(keep_id, copies, form)``: one row per distinct record with its number of rows."""
    return groups(with_forms(df, id_col, text_col)).select("keep_id", "copies", "form")
