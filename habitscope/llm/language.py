"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its byte trigrams and four-grams, hashed to 2^15 rows; a softmax over a
linear map of that mean gives the language. Embeddings and map are trained together by stochastic gradient descent
in numpy, on a sample of labelled documents of a stated size. A fifth of the sample is not fitted: it sets the
temperature that makes scores probabilities, and the score below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitscope.llm.common import column_bytes, slices, texts

BUCKET_BITS = 15
UNKNOWN = "und"
# Letters in lower case; other ASCII counts as a space, bytes of longer characters stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[: 0x80] = 0x20
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For trigrams and four-grams: the bucket at each place, and whether a gram of that text begins there.

    A gram counts where its second byte is of a letter and it ends inside its text.
    """
    folded = _FOLD[data].astype(np.uint32)
    remaining = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
    for size in (3, 4):
        if len(data) < size:
            continue
        code = np.zeros(len(data) - size + 1, np.uint32)
        for i in range(size):
            code |= folded[i : len(data) - size + 1 + i] << np.uint32(8 * i)
        counts = (folded[1 : len(code) + 1] != 0x20) & (remaining[: len(code)] >= size)
        bucket = (code * np.uint32(0x9E3779B1) + np.uint32(size)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKET_BITS)
        yield bucket.astype(np.int32), counts


def has_letters(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times the linear map
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of each text: at most 2^15 pairs of 16-bit numbers, however long it is."""
    for batch in slices(batches, "text"):
        data, bounds = column_bytes(batch, "text")
        pairs = list(grams(data, bounds))
        buckets, counts = [], []
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            own = [b[begin:end][c[begin:end]] for b, c in pairs]
            found, times = np.unique(np.concatenate(own) if own else np.empty(0, np.int32), return_counts=True)
            buckets.append(found.astype(np.int16))
            counts.append(np.minimum(times, 32767).astype(np.int16))
        kept = batch.column(batch.schema.get_field_index("lang"))
        yield pa.RecordBatch.from_arrays(
            [kept, pa.array(buckets, pa.list_(pa.int16())), pa.array(counts, pa.list_(pa.int16()))],
            names=["lang", "buckets", "counts"],
        )


def training_rows(docs: DataFrame, per_language: int, seed: int) -> DataFrame:
    """About ``per_language`` documents of each language, by a seeded hash; all of a language that has fewer.

    The counts of the languages come to the driver, as the languages themselves do with the model: the sample is
    then a filter of the scan and no text is shuffled.
    """
    labelled = docs.where(F.col("lang").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return labelled.select("lang", "text").limit(0)
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_language / r["n"])])
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    return labelled.where((place < rates[F.col("lang")]) & has_letters(F.col("text"))).select("lang", "text")


def fit(
    docs: DataFrame,
    per_language: int = 1000,
    width: int = 16,
    epochs: int = 6,
    least_steps: int = 800,
    rate: float = 0.5,
    reject: float = 0.001,
    most: float = 0.5,
    seed: int = 3,
) -> Model | None:
    """A model of the languages in ``docs`` (doc_id, lang, text), or None where nothing is labelled.

    The sample has about ``per_language`` documents of each language; each comes to the driver as at most 2^15
    bucket counts. Small samples are gone through more often, for ``least_steps`` steps in all. The threshold is the score that a share ``reject`` of the unfitted sample stays under, but
    never more than ``most``, so that clear texts are not lost.
    """
    bags = training_rows(docs, per_language, seed).mapInArrow(_bags, "lang string, buckets array<short>, counts array<short>")
    # Two flat arrays instead of objects for each row keep the driver small.
    sample = bags.where(F.size("buckets") > 0).toArrow()
    if not sample.num_rows:
        return None
    names = sample.column("lang").to_pylist()
    languages = sorted(set(names))
    target = np.searchsorted(languages, names)
    flat = {}
    for name in ("buckets", "counts"):
        column = sample.column(name).combine_chunks()
        flat[name] = column.flatten().to_numpy()
        ends = np.cumsum(column.value_lengths().to_numpy())
    del sample, column
    begins = np.concatenate([[0], ends[:-1]])

    def bag(r: int) -> tuple[np.ndarray, np.ndarray]:
        return flat["buckets"][begins[r] : ends[r]], flat["counts"][begins[r] : ends[r]].astype(np.float32)

    random = np.random.default_rng(seed)
    # A fixed order whatever order the rows came in.
    weights = np.arange(1, (1 << BUCKET_BITS) + 1, dtype=np.float64)
    key = []
    for r in range(len(names)):
        buckets, counts = bag(r)
        key.append((len(buckets), float(weights[buckets] @ counts), int(target[r])))
    order = np.array(sorted(range(len(key)), key=key.__getitem__))
    order = order[random.permutation(len(order))]
    split = max(1, len(order) - len(order) // 5)
    fitted, unfitted = order[:split], order[split:]
    rows, labels = 1 << BUCKET_BITS, len(languages)
    embedding = random.normal(0, 0.1, (rows, width)).astype(np.float32)
    linear, bias = np.zeros((width, labels), np.float32), np.zeros(labels, np.float32)

    def dense(picked: np.ndarray, thin: bool) -> np.ndarray:
        out = np.zeros((len(picked), rows), np.float32)
        for i, r in enumerate(picked):
            buckets, counts = bag(r)
            if thin and random.random() < 0.5:
                # Half of the examples stand for short texts: some 30 of their grams.
                counts = random.binomial(counts.astype(np.int64), min(1.0, 30 / counts.sum())).astype(np.float32)
            out[i, buckets] = counts / max(counts.sum(), 1.0)
        return out

    size = 32
    each = -(-len(fitted) // size)
    epochs = max(epochs, -(-least_steps // each))
    steps = epochs * each
    done = 0
    for _ in range(epochs):
        shuffled = fitted[random.permutation(len(fitted))]
        for begin in range(0, len(shuffled), size):
            picked = shuffled[begin : begin + size]
            pace = np.float32(rate * (1 - done / steps))
            done += 1
            x = dense(picked, True)
            mean = x @ embedding
            logits = mean @ linear + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(picked)), target[picked]] -= 1
            p /= len(picked)
            slope = p @ linear.T
            linear -= pace * (mean.T @ p)
            bias -= pace * 0.1 * p.sum(axis=0)
            # Rows of the embedding see a gram in few examples, so they move faster.
            embedding -= pace * 100 * (x.T @ slope)
    model = Model(languages, embedding @ linear, bias)
    checked = unfitted if len(unfitted) else fitted
    logits = np.concatenate([dense(checked[i : i + size], False) @ model.table + bias for i in range(0, len(checked), size)])
    truth = target[checked]
    losses = []
    tried = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    for temperature in tried:
        model.temperature = float(temperature)
        losses.append(-np.log(np.maximum(model.probabilities(logits)[np.arange(len(truth)), truth], 1e-12)).mean())
    model.temperature = float(tried[int(np.argmin(losses))])
    model.threshold = float(min(most, np.quantile(model.probabilities(logits).max(axis=1), reject)))
    return model


def _predict(model: Model, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array(model.languages, object)
        for batch in slices(batches, "text"):
            data, bounds = column_bytes(batch, "text")
            total = np.zeros((batch.num_rows, len(labels)), np.float64)
            number = np.zeros(batch.num_rows, np.float64)
            filled = np.flatnonzero(np.diff(bounds))
            for bucket, counts in grams(data, bounds):
                # Texts at the end of the batch may be too short to begin a gram.
                own = filled[bounds[filled] < len(bucket)]
                if not len(own):
                    continue
                values = model.table[bucket]
                values[~counts] = 0
                for k in range(len(labels)):
                    total[own, k] += np.add.reduceat(values[:, k], bounds[own], dtype=np.float64)
                number[own] += np.add.reduceat(counts, bounds[own], dtype=np.int64)
            logits = total / np.maximum(number, 1)[:, None] + model.bias
            p = model.probabilities(logits)
            best = p.argmax(axis=1)
            score = p[np.arange(len(p)), best]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(labels[best], pa.string()), pa.array(score.clip(0, 1))],
                names=[*names, "lang_pred", "score"],
            )

    return rows


def identify(docs: DataFrame, model: Model | None, *also: str) -> DataFrame:
    """doc_id, the columns ``also``, lang_pred, score, rejected: one row for each row of ``docs``, from its text alone.

    A null text and one without letters is ``und`` with score 0 and rejected. Where there is no model, all others are
    undecided: ``und`` with score 0, but not rejected, since nothing speaks against them. With a model, others get a
    learned language; they are rejected where the score is under the model's threshold. Repeated rows get equal
    answers, ties go to the first language in order; an empty table gives no rows; other columns are not read. Whole texts are read, whatever their length, in one pass without a shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select(
            "doc_id",
            *also,
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            (~has_letters(F.col("text"))).alias("rejected"),
        )
    carried = [c for c in also if c != "text"]
    rows = texts(docs, *carried).withColumn("lettered", has_letters(F.col("text")))
    names = ["doc_id", *also, "lettered"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in also)
    told = rows.mapInArrow(
        _predict(model, names),
        f"doc_id {kind}, {kinds}{', ' if also else ''}lettered boolean, lang_pred string, score double",
    )
    return told.select(
        "doc_id",
        *also,
        F.when(F.col("lettered"), F.col("lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        (~F.col("lettered") | (F.col("score") < model.threshold)).alias("rejected"),
    )
