"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A signature holds 32 values of 16 bits, each from the smallest hash of a document's shingle set under one function.
It is split into eight chunks of four values. Two signatures that differ in at most 15 values have, by the pigeonhole
principle, a chunk with at most one error; enumerating the place of that error gives four keys for each chunk, and
such signatures share a key for certain. A pair of documents at similarity s shares none with probability
(1 - s^4 - 4 s^3 (1 - s))^8: 2e-8 at 0.85 and 1e-6 at 0.8. All links are confirmed on the full sets.

Documents with equal sets are one class from the start. Within a key, each class is first compared with one centre
only, so a key that very many near copies share costs one comparison for each. Then the classes of keys that are
still in several components are searched again for near pairs across components, through their rarest shingles: of
such pairs, those that a bound on rare shingles leaves are compared. So every pair that shares a key is compared,
ruled out by an exact bound, or connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitscope.llm.common import IS_SPACE, column_bytes, mixed, runs, slices, span_hashes, texts, written
from habitscope.llm.components import components

VALUES, CHUNK = 32, 4
PARITY = 16  # longs
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _functions() -> tuple[np.ndarray, np.ndarray]:
    odd = mixed(np.arange(1, VALUES + 1) * 7919) | np.uint64(1)
    return odd, mixed(np.arange(1, VALUES + 1) * 104729)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of a batch."""
    low = _LOWER[data]
    starts, ends = runs(~IS_SPACE[low], bounds)
    hashed = span_hashes(low, starts, ends)
    first = np.searchsorted(starts, bounds)
    factors = mixed(np.arange(1, width + 1) * 31) | np.uint64(1)
    for begin, end in zip(first[:-1], first[1:], strict=True):
        own = hashed[begin:end]
        if not len(own):
            yield own
            continue
        span = min(width, len(own))
        total = np.full(len(own) - span + 1, 0 if span == width else span, np.uint64)
        for i in range(span):
            total += own[i : len(own) - span + 1 + i] * factors[i]
        yield np.unique(mixed(total))


def _signatures(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, plus = _functions()
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(*column_bytes(batch, "text"), width))
            sizes = np.array([len(s) for s in sets], np.int64)
            values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            full = np.flatnonzero(sizes)
            begins = (np.cumsum(sizes) - sizes)[full]
            signature = np.zeros((len(sets), VALUES), np.int32)
            names = np.zeros((len(sets), 2), np.int64)
            if len(full):
                for k in range(VALUES):
                    least = np.minimum.reduceat(values * odd[k] + plus[k], begins)
                    signature[full, k] = (mixed(least) & np.uint64(0xFFFF)).astype(np.int32)
                # The name of a set: two sums of spread values, each of 64 bits.
                for k, salt in enumerate((0x51ED27, 0xB5297A)):
                    names[full, k] = np.add.reduceat(mixed(values + np.uint64(salt)), begins).view(np.int64)
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * VALUES)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(sizes),
                    pa.array(names[:, 0].copy()),
                    pa.array(names[:, 1].copy()),
                    pa.ListArray.from_arrays(offsets, pa.array(signature.ravel())),
                ],
                names=["doc_id", "n_shingles", "s1", "s2", "signature"],
            )

    return rows


def _parity(shingles: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of the shingles falls on each of 64 * PARITY places.

    Of two sets, no more bits differ than there are shingles in one of them only.
    """
    counts = np.bincount(mixed(shingles.view(np.uint64)) >> np.uint64(54), minlength=64 * PARITY)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def _sets(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(*column_bytes(batch, "text"), width)]
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            parity = np.concatenate([_parity(s) for s in sets]) if sets else np.empty(0, np.int64)
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PARITY)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)),
                    pa.ListArray.from_arrays(offsets, pa.array(parity)),
                ],
                names=["rep", "shingles", "parity"],
            )

    return rows


def masked_keys(signature: Column) -> Column:
    """One key for each chunk and place of a possible error: the chunk's other values."""
    keys = []
    for chunk in range(VALUES // CHUNK):
        for error in range(CHUNK):
            rest = [F.get(signature, F.lit(chunk * CHUNK + i)) for i in range(CHUNK) if i != error]
            keys.append(F.xxhash64(F.lit(chunk * CHUNK + error), *rest))
    return F.array(*keys)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    na, nb = F.size("sa"), F.size("sb")
    near = (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = pairs.join(left, "a").join(right, "b").where(near & (100 * both >= percent * (na + nb - both)))
    return linked.select("a", "b").distinct()


def _rare_pairs(open_sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes (rep, component, shingles) of different components that may be near enough.

    With shingles in one order, the rarest first, two sets of n and m shingles that are near have at least
    o = percent * (n + m) / (100 + percent) in common, so one of their common shingles is among the first n - o + 1
    of the one and the first m - o + 1 of the other. Texts whose own parts are larger than that meet nobody,
    however many others share the rest with them. They also differ in n + m - 2 * o shingles at most, and so in as
    many bits of their parities, which keeps most pairs below the threshold from being formed at all.
    """
    most = F.size("shingles") - F.ceil(F.size("shingles") * percent / 100) + 1
    listed = written(open_sets.select("rep", "component", F.size("shingles").alias("n"), most.alias("most"), "shingles", "parity"), "open-sets")
    each = listed.select("rep", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    # A shingle that one class has comes first in it and meets nobody; only how many there are counts.
    ordered = each.join(common, "shingle").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("common"))
    own = F.col("n") - F.size("common")
    early = (
        listed.select("rep", "component", "n", "most", "parity")
        .join(ordered, "rep")
        .where(own < F.col("most"))
        .select("rep", "component", "n", "parity", own.alias("own"), F.posexplode(F.slice("common", 1, (F.col("most") - own).cast("int"))).alias("at", "item"))
        .select("rep", "component", "n", "parity", (F.col("own") + F.col("at")).alias("place"), F.col("item.shingle").alias("shingle"))
    )
    early = written(early, "rare-shingles")
    x, y = early.alias("x"), early.alias("y")
    shared = F.ceil((F.col("x.n") + F.col("y.n")) * F.lit(percent) / F.lit(100 + percent))
    bits = [F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i])) for i in range(PARITY)]
    near = (
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.rep") < F.col("y.rep"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.col("x.place") <= F.col("x.n") - shared)
        & (F.col("y.place") <= F.col("y.n") - shared)
        & (sum(bits[1:], bits[0]) <= F.col("x.n") + F.col("y.n") - 2 * shared)
    )
    return x.join(y, near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_groups(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Links join documents whose sets of ``width``-word shingles have a similarity of ``percent`` per cent or more; a
    text with fewer words is one shingle; one without words, or null, has the empty set and no links. component_id is
    the smallest doc_id that links reach. A row without a doc_id has no links and is kept, with a null component.
    Rows that repeat a doc_id are one document and link what any of their texts link. An empty table gives no
    rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts(docs)
    signed = written(
        rows.mapInArrow(_signatures(width), f"doc_id {kind}, n_shingles long, s1 long, s2 long, signature array<int>"),
        "signatures",
    )
    classes = written(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("s1", "s2")
        .agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")),
        "set-classes",
    )
    keys = classes.select("rep", F.explode(masked_keys(F.col("signature"))).alias("key"))
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(several, "key").select("key", "rep", "n"), "key-members")
    # The centre of a key is its class with the most company over all keys: of edits of one text, that text.
    company = members.groupBy("rep").agg(F.sum("n").alias("company"))
    centres = members.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", "rep")).alias("most"))
    stars = (
        members.join(centres, "key")
        .select(F.col("rep").alias("a"), F.col("most.rep").alias("b"))
        .where("a <> b")
        .distinct()
    )
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(
        rows.join(wanted, "doc_id").mapInArrow(_sets(width), f"rep {kind}, shingles array<long>, parity array<long>"), "shingle-sets"
    )
    links = written(_confirmed(stars, sets, percent), "star-links")
    near = written(components(links), "star-components")

    placed = members.join(near.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    open_reps = written(placed.join(split.select("key"), "key").select("rep", "component").distinct(), "open-classes")
    rest = _rare_pairs(open_reps.join(sets, "rep"), percent)
    more = written(_confirmed(rest, sets, percent), "other-links")
    if not more.isEmpty():
        near = written(components(links.union(more)), "components")

    named = classes.join(near.withColumnRenamed("node", "rep"), "rep", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("component_id")
    )
    linked = F.col("n_shingles") > 0
    done = signed.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(linked & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return done.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
