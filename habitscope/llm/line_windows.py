"""Line deduplication by overlapping windows of three lines, in DataFrame functions only.

Every three consecutive lines of a text are one window. Of windows with equal lines the first, by doc_id and then by
place, stays; the lines that any later one covers are removed, overlapping windows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitscope.llm.common import text_keys, texts

SIZE = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """k1, k2 (the text's keys) and pos of every window that an earlier window equals.

    Windows are compared by 128 bits of hash. A window that a third of all texts hold is one row for each input
    partition in the search for the first, and a plain join, which adaptive execution splits, afterwards.
    """
    lines = F.col("lines")
    starts = F.sequence(F.lit(0), F.size(lines) - size)
    window = lambda i: F.slice(lines, i + 1, size)
    hashed = F.transform(
        starts,
        lambda i: F.struct(i.alias("pos"), F.xxhash64(window(i)).alias("h1"), F.xxhash64(F.lit(1), window(i)).alias("h2")),
    )
    each = (
        docs.select("k1", "k2", "doc_id", lines_of(F.col("text")).alias("lines"))
        .where(F.size("lines") >= size)
        .select("k1", "k2", "doc_id", F.inline(hashed))
    )
    # Rows without a doc_id come after all others.
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "k1", "k2", "pos")
    firsts = each.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("uses")).where("uses > 1")
    return each.join(firsts.select("h1", "h2", "first"), ["h1", "h2"]).where(place > F.col("first")).select("k1", "k2", "pos")


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text, n_lines, n_removed, removed (sorted line numbers from 0): one row for each row of ``docs``.

    A null text is empty; an empty text is one empty line. A text of fewer than ``size`` lines has no window and is
    left as it is. Of rows that repeat doc_id and text, with or without a doc_id, one is the first and loses only
    what earlier texts hold; the windows of the others are all later ones, so they lose every line. A text whose
    lines all go becomes empty. An empty table gives no rows; other columns are not read.

    Rows that repeat are counted on each side of the shuffle that moves the texts, so that they meet as one row.
    """
    rows = texts(docs).select("doc_id", "text", *text_keys())
    covered = (
        repeated_windows(rows, size)
        .groupBy("k1", "k2")
        .agg(F.collect_set("pos").alias("starts"))
        .select(
            "k1",
            "k2",
            F.array_sort(
                F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (size - 1)))))
            ).alias("later"),
        )
    )
    once = rows.groupBy("k1", "k2").agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies")
    )
    lines = lines_of(F.col("text"))
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    none = F.array().cast("array<int>")
    first = F.coalesce("later", none)
    repeat = F.when(F.size(lines) >= size, every).otherwise(none)
    shapes = F.array(
        F.struct(F.lit(1).cast("long").alias("times"), first.alias("removed")),
        F.struct((F.col("copies") - 1).alias("times"), repeat.alias("removed")),
    )
    numbers = F.array_except(every, F.col("removed"))
    kept = F.transform(numbers, lambda i: F.get(lines, i))
    return (
        once.join(covered, ["k1", "k2"], "left")
        .select("doc_id", "text", F.inline(F.filter(shapes, lambda x: x["times"] > 0)))
        .select(
            "doc_id",
            F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size("removed").cast("long").alias("n_removed"),
            "removed",
            "times",
        )
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(times - 1) div 65536"))))
        .withColumn("copy", F.explode(F.sequence(F.col("block") * 65536, F.least(F.col("times") - 1, F.col("block") * 65536 + 65535))))
        .drop("times", "block", "copy")
    )
