"""Exact de-duplication by distributed most-significant-digit radix partitioning.

All documents begin as one group. A level reads the next digit, a run of successive bytes,
of every document still in a group of several, and splits each group by it. A group is done
when it is a single document, or when its texts have ended (the digit is shorter than the
level's width): then its texts are the same byte for byte, which no digest had to tell. Digits
widen from level to level, so that texts of a length meet as many levels as its logarithm.

A level counts its digits before rows move: (group, digit) is aggregated in parts, and each
row then joins the part it was counted in, so that a third of all rows may share a digit, or a
whole text, without meeting in one task. Only what a level leaves open is written, without the bytes
that it has read.

Defined results: a null text counts as empty, and empty texts are equal; of equal texts the
row with the largest id stays; rows that repeat the id of the row that stays are that document
and stay too; a null id is below every other, so a group of null ids alone keeps them (its
keep_id is null); an empty table gives an empty table; other columns are not read.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import with_group, written

FIRST_DIGIT = 64
WIDENING = 16
LARGEST_DIGIT = 1 << 20


def groups(docs: DataFrame, first: int = FIRST_DIGIT, widening: int = WIDENING, largest: int = LARGEST_DIGIT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; digits are ``first``
    bytes, then ``widening`` times as many on each level, ``largest`` at most."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.sha2(text, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"),
        F.lit(0).cast("long").alias("path"), text.cast("binary").alias("rest"),
    )
    width, done, spread = first, [], F.col("doc_id")
    while True:
        keyed = rows.withColumn("digit", F.expr(f"substring(rest, 1, {width})"))
        # a group is named by the smallest row that took its path
        split = with_group(
            keyed, ["path", "digit"], spread,
            group_size=(F.sum, F.lit(1).cast("long")), keep_id=(F.max, F.col("doc_id")), name=(F.min, F.col("row")),
        )
        ended = (F.col("group_size") == 1) | (F.octet_length("digit") < width)
        rest = F.when(~ended, F.expr(f"substring(rest, {width + 1})"))
        state = written(split.select("doc_id", "text_sha256", "row", "group_size", "keep_id", F.col("name").alias("path"), rest.alias("rest")), "radix")
        done.append(state.where("rest is null"))
        rows = state.where("rest is not null").select("doc_id", "text_sha256", "row", "path", "rest")
        if rows.isEmpty():
            break
        width, spread = min(width * widening, largest), F.col("row")
    found = reduce(DataFrame.unionByName, done)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
