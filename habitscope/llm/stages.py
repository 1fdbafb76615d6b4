"""Operators as steps of a document pipeline: each takes documents and gives documents.

All work is on columns doc_id, text, lang, source and n_chars, whatever else a table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitscope.llm import chunk_bpe, language, mixing
from habitscope.llm.chunk_dedup import exact_groups
from habitscope.llm.common import WORD, hex_digest
from habitscope.llm.near_dups import near_groups

SPACE = r"[\x20\x09-\x0D]"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row_key(digest: Column) -> Column:
    """A row's name from its doc_id and the digest of its text; rows that repeat both have one name."""
    return F.when(F.col("doc_id").isNull(), F.concat(F.lit("#"), digest)).otherwise(
        F.concat(F.lit("="), F.col("doc_id").cast("string"), F.lit(":"), digest)
    )


def _text_digest() -> Column:
    return hex_digest(F.coalesce(F.col("text"), F.lit("")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known for certain enough; the model is fitted on the labelled ones among them.

    Every row is kept or dropped by its own text, whatever other rows have its doc_id.
    """
    docs = docs.select(COLUMNS)
    told = language.identify(docs, language.fit(docs.where(F.col("doc_id").isNotNull())), *COLUMNS[1:])
    return told.where(~F.col("rejected")).select(COLUMNS)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id.

    One row of those that repeat doc_id and text; other rows with that doc_id have a text of their own and stay.
    """
    docs, groups = docs.select(COLUMNS), exact_groups(docs)
    names = groups.where("kept").select(_row_key(F.col("text_sha256")).alias("_name")).distinct()
    rows = docs.withColumn("_name", _row_key(_text_digest()))
    return rows.join(names, "_name", "left_semi").dropDuplicates(["_name"]).select(COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles at 0.8 or more link, the one with the smallest doc_id.

    Rows without a doc_id are documents like all others and stay only where no linked row has one. Rows that repeat
    a doc_id with other texts are documents of their own; of rows that repeat doc_id and text one stays.
    """
    docs = docs.select(COLUMNS)
    rows = docs.withColumn("_name", _row_key(_text_digest()))
    linked = near_groups(rows.select(F.col("_name").alias("doc_id"), "text"), width=5, percent=80)
    # The id from the name, without the digest after it: ids are compared as what they are, not as strings.
    none = F.col("doc_id").startswith("#")
    own = F.when(~none, F.expr("substring(doc_id, 2, length(doc_id) - 66)")).cast(docs.schema["doc_id"].dataType)
    place = F.struct(none.alias("none"), own.alias("id"), F.col("doc_id").alias("_name"))
    names = linked.groupBy("component_id").agg(F.min(place).alias("first")).select("first._name")
    return rows.join(names, "_name", "left_semi").dropDuplicates(["_name"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them.

    One row with the whole text for each full reading, and, where a reading ends inside a document, one row with
    the words up to there; n_chars follows the text.
    """
    docs = docs.select(COLUMNS)
    taken = (
        mixing.mix(docs)
        .where("taken > 0")
        .select(F.col("row_hash").alias("_hash"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
        .dropDuplicates(["_hash"])
    )
    full, rest = F.floor(F.col("_taken") / F.col("_size")).cast("int"), (F.col("_taken") % F.col("_size")).cast("int")
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"{SPACE}*{WORD}"), F.lit(0)), 1, rest), "")
    copies = F.concat(
        F.array_repeat(F.col("text"), full), F.when(rest > 0, F.array(first_words)).otherwise(F.array().cast("array<string>"))
    )
    joined = docs.withColumn("_row", mixing.row_hash()).join(taken, F.col("_row") == F.col("_hash"))
    return joined.select("doc_id", F.explode(copies).alias("text"), "lang", "source").select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of what the ids decode to: one row for each row of the mix."""
    rows = chunk_bpe.decode(chunk_bpe.encode(docs))
    return rows.select("doc_id", "n_tokens", "ids", hex_digest(F.col("decoded")).alias("text_sha256"))
