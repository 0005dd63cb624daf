"""Applying decisions about rows to the documents, without shuffling their texts where the decisions are few.

A row is known by two hashes of all its columns, not by its doc_id: ids may be null, or stand for several texts. Rows equal in all columns share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import sided, written

#: Decisions are broadcast up to so many rows (some 100 bytes each on the driver, two hashes and two counts); of more, one hash each up to BROADCAST_ROWS.
DECISION_ROWS, BROADCAST_ROWS = 250_000, 500_000
ROW = ["_row_a", "_row_b"]


def with_row(docs: DataFrame) -> DataFrame:
    """docs with 128 bits that tell its rows apart."""
    held = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    return docs.withColumns({"_row_a": F.xxhash64(*held), "_row_b": F.xxhash64(F.lit(1), *held)})


def with_copies(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs with each row `copies` times; decisions has the row's hashes, copies (of the row in all) and n (how often it stands in docs).

    Only rows whose number changes take part in a join: by broadcast up to DECISION_ROWS of them; up to BROADCAST_ROWS one hash is broadcast, and the rows that have it move to the
    decisions; beyond, all rows do. Rows without a decision stay as they are.
    """
    changed = written(decisions.where(F.col("copies") != F.col("n")).select(*ROW, F.col("copies").alias("_copies"), F.col("n").alias("_n")))
    changes = changed.count()
    near = lambda df: sided(df, changes <= DECISION_ROWS)
    repeat = lambda df: df.withColumn("_copy", F.explode(F.expr("array_repeat(0, CAST(coalesce(_copies, 1) AS INT))"))).select(*docs.columns)
    named, once, often = with_row(docs), changed.where("_n = 1"), changed.where("_n > 1")
    untouched = None
    if DECISION_ROWS < changes <= BROADCAST_ROWS:
        held = F.broadcast(changed.select("_row_a"))
        named, untouched = named.join(held, "_row_a", "left_semi"), named.join(held, "_row_a", "left_anti").select(*docs.columns)
    if often.isEmpty():
        out = repeat(named.join(near(once), ROW, "left"))
    else:
        rest = repeat(named.join(near(often), ROW, "left_anti").join(near(once), ROW, "left"))
        # rows with the same hashes are equal, so it doesn't matter which one stays
        out = rest.unionByName(repeat(named.join(near(often), ROW).dropDuplicates(ROW)))
    return out if untouched is None else out.unionByName(untouched)
