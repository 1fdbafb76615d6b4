"""What the training-data operators share: inputs, written tables, samples and Arrow buffers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitscope.session import checkpoint_folder

WORD = r"[^\x20\x09-\x0D]+"
# Bytes that separate words: space and the controls from tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Rows of an Arrow batch; the default of 10,000 may be 100 MB and more of whole texts.
BATCH_ROWS = "500"


def texts(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, text and the named columns only, so that no other column can clash; a null text is empty.

    Texts go to Python in small batches from here on.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *also)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return os.path.join(checkpoint_folder(spark), "llm", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and no executor holds it."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_keys() -> list[Column]:
    """k1 and k2: two hashes with different seeds that name rows by doc_id and text, a null doc_id too."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")]


def hex_digest(binary_or_text: Column) -> Column:
    return F.sha2(binary_or_text.cast("binary"), 256)


def column_bytes(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row bounds (one more than rows), without copies."""
    column = batch.column(batch.schema.get_field_index(name))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    kind = np.int64 if wide else np.int32
    limits = np.frombuffer(bounds, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[limits[0] : limits[-1]], limits - limits[0]


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = column_bytes(batch, name)
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[begin] + most, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def byte_table(members) -> np.ndarray:
    """A table of 256 booleans that is true for the given byte values."""
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


IS_SPACE = byte_table(SPACES)


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true positions; a run never crosses a row bound."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.zeros(len(mask) + 2, np.int8)
    padded[1:-1] = mask
    step = np.diff(padded)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = np.unique(bounds[1:-1])
    inner = inner[(inner > 0) & (inner < len(mask))]
    inner = inner[mask[inner - 1] & mask[inner]]
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse; grown to the longest batch met."""
    have = _POWERS.get("up")
    if have is None or len(have) < count:
        size = max(count, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes, from one running sum over the batch."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((mixed(np.arange(1, 257))[data]) * up[: len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
