"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Texts are cut where the characters at hand meet a fixed rule, so equal passages are cut alike. Every distinct chunk
gets an identifier that is verified against its text; a document is the ordered list of its identifiers, its recipe;
equal recipes are equal texts. Text moves once, chunk by chunk, and only for that verification; grouping and the
choice of the row that stays compare recipes, which are a small fraction of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitscope.llm.common import hex_digest, texts, written

# The rule: a chunk ends after a space or line end between two letters of certain classes (about one place in 400
# in European prose), or after ``most`` characters where no place meets it.
_RULE = r"(?<=[aeiou][ \n])(?=[bcglmpqvz])(?<=[dlnr][aeiou][ \n])"


def chunks(text: Column, most: int = 2048) -> Column:
    """The chunks of a text in order; joined they give the text. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{most}}}?(?:{_RULE}|\z)|.{{{most}}}"), F.lit(0))


def _hashed(chunk: Column, bits: int) -> Column:
    """The 64-bit hash of a chunk; fewer bits only make collisions likely, to test how they are told apart."""
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits) if bits < 64 else F.xxhash64(chunk)


def identifiers(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(hash, chunk, rank) of the chunks whose hash another chunk has too; rank tells them apart.

    All chunks are first reduced to distinct texts, so this holds for every identifier: a hash that is not listed
    belongs to one text.
    """
    each = docs.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    distinct = each.groupBy(_hashed(F.col("chunk"), bits).alias("hash"), "chunk").agg(F.lit(1).alias("one"))
    clashes = distinct.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    clashing = distinct.join(clashes, "hash").groupBy("hash").agg(F.sort_array(F.collect_list("chunk")).alias("all"))
    return clashing.select("hash", F.posexplode("all").alias("rank", "chunk"))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Every row's doc_id, text_sha256 and recipe: the ordered verified identifiers of its chunks."""
    rows = texts(docs)
    listed = F.transform(chunks(F.col("text")), lambda c: F.struct(_hashed(c, bits).alias("hash"), F.lit(0).alias("rank")))
    plain = rows.select("doc_id", hex_digest(F.col("text")).alias("text_sha256"), listed.alias("recipe"))
    clashing = written(identifiers(rows, bits), "clashing-chunks")
    if clashing.isEmpty():
        # Every hash stands for one text.
        return plain
    # Equal texts have equal lists, so the ranks may be found once for each text that holds a clashing chunk.
    held = rows.select(hex_digest(F.col("text")).alias("text_sha256"), "text").dropDuplicates(["text_sha256"])
    places = held.select("text_sha256", F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"))
    ranks = (
        places.withColumn("hash", _hashed(F.col("chunk"), bits))
        .join(clashing, ["hash", "chunk"])
        .groupBy("text_sha256")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    )
    ranked = F.transform(
        "recipe", lambda c, i: F.struct(c["hash"].alias("hash"), F.coalesce(F.col("ranks")[i], F.lit(0)).alias("rank"))
    )
    return plain.join(ranks, "text_sha256", "left").select(
        "doc_id", "text_sha256", F.when(F.col("ranks").isNull(), F.col("recipe")).otherwise(ranked).alias("recipe")
    )


def exact_groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    Null and empty texts are equal. The largest doc_id of equal texts stays; rows that repeat it all stay marked as
    kept, and rows without a doc_id stay only where no row of their group has one. An empty table gives no rows;
    other columns are not read. A text that a third of all rows share costs one row for each input partition in the
    grouping and a plain join, which adaptive execution splits, afterwards.
    """
    kind = docs.schema["doc_id"].dataType
    listed = written(recipes(docs, bits), "recipes")
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Written, so that both sides of the join are plain shuffles, which adaptive execution can split.
    several = written(groups.where("group_size > 1").withColumnRenamed("recipe", "shared_recipe"), "copy-groups")
    joined = listed.join(several, F.col("recipe") == F.col("shared_recipe"), "left")
    missing = F.col("group_size").isNull()
    keep = F.when(missing, F.col("doc_id")).otherwise(F.col("keep_id")).cast(kind)
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast(T.LongType())).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
