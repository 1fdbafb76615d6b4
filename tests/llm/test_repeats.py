"""Thousands of repeated rows, with and without a doc_id."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from habitscope.llm import chunk_bpe, line_windows, queries, token_counts, tokenizer
from habitscope.llm.common import text_keys
from tools.check import rows_of

PATHS = tokenizer.default_paths()
TEXT = "\n".join(" ".join(f"w{(i * 31 + j) * 7919 % 10007}" for j in range(40)) for i in range(9))
OTHER = "\n".join([*(f"own {i}" for i in range(4)), *TEXT.split("\n")[2:7], "the end"])


def repeated(spark, copies, doc_id):
    rows = [(doc_id, TEXT)] * copies + [(7, OTHER), (8, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("doc_id", [None, 3])
def test_chunk_entries_do_not_grow_with_repeats(spark, doc_id):
    sizes = []
    for copies in (50, 5000):
        rows = repeated(spark, copies, doc_id).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        uses = chunk_bpe.shared_chunks(rows.select("text", *text_keys()), PATHS, 6)
        sizes.append((uses.count(), uses.where("owns").count()))
    assert sizes[0] == sizes[1] and sizes[0][1] > 5


@pytest.mark.parametrize("doc_id", [None, 3])
def test_repeats_are_encoded_and_counted(spark, doc_id):
    library = Tokenizer.from_file(PATHS[0])
    docs = repeated(spark, 5000, doc_id)
    want = {doc_id: library.encode(TEXT).ids, 7: library.encode(OTHER).ids, 8: []}
    got = chunk_bpe.encode(docs, bits=6).groupBy("doc_id", "ids").count().collect()
    assert {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r["count"]) for r in got} == {
        k: (v, 5000 if k == doc_id else 1) for k, v in want.items()
    }
    counts = token_counts.token_counts(docs).groupBy("doc_id", "n_tokens").count().collect()
    assert {r.doc_id: (r.n_tokens, r["count"]) for r in counts} == {
        k: (len(v), 5000 if k == doc_id else 1) for k, v in want.items()
    }


@pytest.mark.parametrize("doc_id", [None, 3])
def test_lines_of_repeats_go(spark, doc_id):
    docs = repeated(spark, 5000, doc_id)
    got = line_windows.without_repeats(docs).groupBy("doc_id", "text", "n_lines", "n_removed").count().collect()
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed): r["count"] for r in got}
    # Without an id the copies come after the other text, which then holds the five lines first.
    lines = TEXT.split("\n")
    first = (doc_id, "\n".join([*lines[:2], *lines[7:]]), 9, 5) if doc_id is None else (doc_id, TEXT, 9, 0)
    other = (7, OTHER, 10, 0) if doc_id is None else (7, "\n".join([*(f"own {i}" for i in range(4)), "the end"]), 10, 5)
    assert got == {first: 1, (doc_id, "", 9, 9): 4999, other: 1, (8, "", 1, 0): 1}


def test_sql_with_repeats(spark, tmp_path):
    repeated(spark, 40, None).union(repeated(spark, 30, 3)).write.parquet(str(tmp_path / "documents.parquet"))
    base = duckdb.connect()
    base.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = base.sql(queries.ORACLE["op9_line_windows"])
    frame = queries.QUERIES["op9_line_windows"](spark, str(tmp_path))
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert len(got[1]) == 74 and got == rows_of(want.columns, want.fetchall())
    assert frame.where(F.col("text_sha256") == hashlib.sha256(b"").hexdigest()).count() >= 69
