"""Quality of documents by hierarchical empirical Bayes over hosts and paths.

A logistic classifier on measures of the text gives each document evidence of its own. Hosts and paths gather the
evidence of their documents by grouped sums. A host's rate is shrunk toward the global one, a path's toward its
host's, by prior strengths that follow from the spread between sites (method of moments), so a site with few
documents says little. A document's posterior joins its own evidence with the rate of its path, its own share in
that rate left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitscope.llm.common import IS_SPACE, byte_table, column_bytes, runs, slices, span_hashes, texts, written

_IS_LOWER = byte_table(range(ord("a"), ord("z") + 1))
_IS_UPPER = byte_table(range(ord("A"), ord("Z") + 1))
_IS_DIGIT = byte_table(range(ord("0"), ord("9") + 1))
_IS_STOP = byte_table(b".,;:?'-")
_IS_SIGN = byte_table(set(range(0x21, 0x7F)) - set(np.flatnonzero(_IS_LOWER | _IS_UPPER | _IS_DIGIT | _IS_STOP).tolist()))
MEASURES = 10


def measures(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ten measures of every text of a batch; all zero for one without words."""
    size = np.diff(bounds)
    filled = np.flatnonzero(size)
    out = np.zeros((len(size), MEASURES))
    if not len(filled):
        return out

    def shares(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(size))
        total[filled] = np.add.reduceat(table[data], bounds[filled], dtype=np.int64)
        return total

    lower, upper, digit, stop, sign = map(shares, (_IS_LOWER, _IS_UPPER, _IS_DIGIT, _IS_STOP, _IS_SIGN))
    starts, ends = runs(~IS_SPACE[data], bounds)
    row = np.searchsorted(bounds, starts, side="right") - 1
    words = np.bincount(row, minlength=len(size))
    hashed = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, bounds)
    distinct, most = np.zeros(len(size)), np.zeros(len(size))
    for i in np.flatnonzero(words):
        _, times = np.unique(hashed[first[i] : first[i + 1]], return_counts=True)
        distinct[i], most[i] = len(times), times.max()
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    long_words = np.bincount(row, weights=ends - starts > 24, minlength=len(size))
    out = np.stack(
        [
            upper / np.maximum(upper + lower, 1),
            digit / n,
            stop / n,
            np.sqrt(sign / n),
            sign / w > 0.2,
            np.log1p(words),
            np.bincount(row, weights=ends - starts, minlength=len(size)) / w,
            distinct / np.sqrt(w),
            most / w,
            long_words / w,
        ],
        axis=1,
    ).astype(float)
    out[words == 0] = 0
    return out


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant
    rate: float  # share of good documents among those fitted

    def logits(self, values: np.ndarray) -> np.ndarray:
        # Standard scores are held to 6, so that no single measure outweighs all others.
        z = np.clip((values - self.mean) / self.scale, -6, 6)
        z = np.concatenate([z, z * z], axis=1)
        # Row by row, so that a document's evidence does not depend on the batch it came in.
        return ((z * self.weights[:-1]).sum(axis=1) + self.weights[-1]).clip(-12, 12)


def train(values: np.ndarray, good: np.ndarray, shrink: float = 1.0, rounds: int = 30) -> Classifier:
    """Penalised logistic regression on standard scores and their squares, by Newton steps."""
    mean, scale = values.mean(axis=0), np.maximum(values.std(axis=0), 1e-6)
    z = np.clip((values - mean) / scale, -6, 6)
    x = np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)
    penalty = np.full(x.shape[1], shrink)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (good - p) - penalty * w)
        # A long step may overshoot where classes are apart.
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w, float(good.mean().clip(0.01, 0.99)))


def _measured(names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = measures(*column_bytes(batch, "text"))
            offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * MEASURES)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=[*names, "measures"]
            )

    return rows


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20000, seed: int = 8) -> Classifier | None:
    """A classifier from about ``sample`` labelled documents (labels: doc_id, quality 0 or 1), by a seeded hash.

    A document that is labelled more than once counts with each label; None where either class is missing.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = known.count()
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    taken = texts(docs).join(known.where(place < sample / max(rows, 1)), "doc_id").select("doc_id", "quality", "text")
    got = taken.mapInArrow(_measured(["doc_id", "quality"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, measures array<double>")
    got = got.toPandas().sort_values(["doc_id", "quality"])
    if got.quality.nunique() < 2:
        return None
    return train(np.stack(got.measures), got.quality.to_numpy(float))


def _scored(model: Classifier):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            logits = model.logits(measures(*column_bytes(batch, "text")))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(logits)], names=["doc_id", "host", "path", "logit"])

    return rows


def _strength(sites: DataFrame, centre: Column, noise: float, rate: float) -> float:
    """How many documents the prior of a level is worth: its variance within over that between sites.

    The spread of site means about their centre, less what chance alone explains, is the spread between sites.
    """
    weight = F.col("n")
    gap = F.col("total") / F.col("n") - centre
    spread = F.sum(F.round(weight * gap * gap * 10**9).cast("decimal(38, 0)")) / 10**9
    count, spread, total = sites.agg(F.count("*"), spread.cast("double"), F.sum(weight)).first()
    if not count or not total:
        return 1.0
    between = max(spread / total - noise * count / total, 1e-6)
    return float(np.clip(rate * (1 - rate) / between, 1.0, 1e6))


def summed(value: Column) -> Column:
    """Sum of values rounded to nine places, as whole numbers of 38 digits: it doesn't depend on the order, and totals
    may pass what a long holds."""
    return F.sum(F.round(value * 10**9).cast("decimal(38, 0)")).cast("double") / 10**9


def posteriors(
    docs: DataFrame, model: Classifier | None, host: Column, path: Column, least: float = 0.3, floor: float = 0.05
) -> DataFrame:
    """doc_id, host, path, p_doc, host_rate, path_rate, quality, kept: one row for each row of ``docs``.

    ``quality`` is the posterior that a document is good; it is kept from ``least`` on. A path's rate counts between
    ``floor`` and 1 - ``floor``, so a site alone never decides over clear text. A null host or path is a site of its own; a null
    or empty text has all measures zero and is judged by them. Without a model every document has the prior one
    half. Repeated rows get equal answers; an empty table gives no rows; other columns are not read. Rates are sums
    over all documents; a host that holds a third of them is one row for each input partition in the sums, and a
    plain join, which adaptive execution splits, afterwards.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sites = docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    rows = texts(sites, "host", "path")
    if model is None:
        model = Classifier(np.zeros(MEASURES), np.ones(MEASURES), np.zeros(2 * MEASURES + 1), 0.5)
    scored = rows.mapInArrow(_scored(model), f"doc_id {kind}, host string, path string, logit double")
    scored = written(scored.withColumn("p_doc", F.round(1 / (1 + F.exp(-F.col("logit"))), 9)), "scored")
    paths = scored.groupBy("host", "path").agg(
        F.count("*").alias("n"),
        summed(F.col("p_doc")).alias("total"),
        summed(F.col("p_doc") * F.col("p_doc")).alias("squares"),
    )
    paths = written(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), summed(F.col("total")).alias("total"))
    spread = F.col("squares") - F.col("total") * F.col("total") / F.col("n")
    n, total, within = paths.agg(F.sum("n"), summed(F.col("total")), summed(spread)).first()
    rate = float(np.clip(total / n, 1e-3, 1 - 1e-3)) if n else 0.5
    noise = max(within / n, 1e-6) if n else 1e-6  # variance of the evidence inside a path
    host_worth = _strength(hosts, F.lit(rate), noise, rate)
    shrunk = (F.col("total") + host_worth * rate) / (F.col("n") + host_worth)
    host_rates = hosts.select(
        F.col("host").alias("of_host"), F.col("n").alias("host_n"), F.col("total").alias("host_total"), shrunk.alias("host_rate")
    )
    sites = written(paths.join(host_rates, F.col("host").eqNullSafe(F.col("of_host"))), "sites")
    path_worth = _strength(sites, F.col("host_rate"), noise, rate)
    sites = sites.select(
        F.col("host").alias("site_host"),
        F.col("path").alias("site_path"),
        F.col("n").alias("path_n"),
        F.col("total").alias("path_total"),
        "host_n",
        "host_total",
        "host_rate",
    )
    own = F.col("p_doc")
    host_without = (F.col("host_total") - own + host_worth * rate) / (F.col("host_n") - 1 + host_worth)
    path_without = (F.col("path_total") - own + path_worth * host_without) / (F.col("path_n") - 1 + path_worth)
    bounded = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), path_without))
    prior = float(np.log(model.rate / (1 - model.rate)))
    posterior = F.col("logit") - prior + F.log(bounded / (1 - bounded))
    same = F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    quality = 1 / (1 + F.exp(-posterior))
    return scored.join(sites, same).select(
        "doc_id", "host", "path", "p_doc", "host_rate", path_without.alias("path_rate"), quality.alias("quality"), (quality >= least).alias("kept")
    )


def url_sites(url: Column) -> tuple[Column, Column]:
    """Host and first step of the path of a URL; null where there is none."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    path = F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1), F.lit(""))
    return host, path
