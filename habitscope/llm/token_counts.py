"""Token counts through a digest cache.

A cache is a folder of Parquet rows (content, version, n_tokens): the digest of the normalised content, the digest
of the tokenizer, and the stored count. Counts of known digests are joined, each distinct missing digest is encoded
once, and its count is appended. A file of an unfinished append is never seen, because Spark commits whole files
only, and a digest that two runs append at the same time is stored twice with the same count, which reading
tolerates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitscope.llm import tokenizer
from habitscope.llm.common import column_bytes, scratch, texts, written

CACHE_SCHEMA = "content string, version string, n_tokens long"


def normalised(text: Column) -> Column:
    """The content that is counted. Only null changes, to empty: any other folding would change the count."""
    return F.coalesce(text, F.lit(""))


def _stored(spark, cache: str) -> DataFrame:
    """The rows stored so far; a cache that does not exist yet has none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def _counter(paths: tuple[str, str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer.load(paths)
        for batch in batches:
            data, bounds = column_bytes(batch, "text")
            view = data.tobytes()
            stored = batch.column(batch.schema.get_field_index("n_tokens")).to_pylist()
            counts = [
                len(tokens.encode(view[a:b].decode())) if n is None else n
                for n, a, b in zip(stored, bounds[:-1], bounds[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("content")),
                    pa.array(counts, pa.int64()),
                    pa.array([n is None for n in stored], pa.bool_()),
                ],
                names=["content", "n_tokens", "fresh"],
            )

    return count


def token_counts(
    docs: DataFrame,
    cache: str | None = None,
    paths: tuple[str, str] | None = None,
    limit: int = 512,
) -> DataFrame:
    """doc_id, content digest, n_bytes, n_tokens, over_limit: one row for each row of ``docs``.

    ``cache`` names the folder of the cache (a new one in the shared folder where None); it is extended by this
    call, at once. Null and empty texts count zero tokens. Repeated rows and equal texts are encoded once and each
    get their row; a null doc_id stays null; an empty table gives no rows; other columns of ``docs`` are not read.

    A text travels once, to the digest that it is the representative of: equal texts are first reduced to one on
    each side of the shuffle, so a text that a third of all rows share moves once for each input partition. The
    counts of this call's digests are written before rows join them, so that adaptive execution can split the rows
    of one digest.
    """
    spark = docs.sparkSession
    paths = paths or tokenizer.default_paths()
    version = tokenizer.version(paths)
    cache = cache or scratch(spark, "token-cache")
    digests = docs.select(
        "doc_id",
        F.octet_length(normalised(F.col("text"))).cast("long").alias("n_bytes"),
        F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("content"),
    )
    known = _stored(spark, cache).where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    contents = (
        texts(docs)
        .select(F.sha2(F.col("text").cast("binary"), 256).alias("content"), "text")
        .groupBy("content")
        .agg(F.first("text").alias("text"))
    )
    found = contents.join(known, "content", "left")
    unknown = F.when(F.col("n_tokens").isNull(), F.col("text")).alias("text")
    counts = written(
        found.select("content", unknown, "n_tokens").mapInArrow(_counter(paths), "content string, n_tokens long, fresh boolean"),
        "token-counts",
    )
    fresh = counts.where("fresh")
    fresh.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = counts.select("content", "n_tokens")
    return digests.join(counts, "content", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content"
    )
