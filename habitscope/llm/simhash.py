"""SimHash near-duplicates: fingerprints in vantage-point trees, links at a few differing bits.

The distinct fingerprints are dealt into shards by a vantage-point tree, fitted to a sample that follows their number
and is 2^20 at most: a node takes one of its points as vantage point and, as radius, the distance nearest to the
median. Points inside the radius go to one child, the others to the other. A fingerprint whose ball of ``bits`` reaches
over the radius also visits the other child: of two linked fingerprints in different children, the outer one is always
such a visitor, by the triangle inequality, so only outer members visit. Visitors of a node visit every child that
their ball reaches.

Inside a shard a local tree of the same kind, in numpy, compares members and visitors with the members of the leaves
that the triangle bounds leave. Links become a spanning forest there, so a group of many near copies costs one row for
each of its fingerprints and shard, never one for each pair. Components join the forests of all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitscope.llm.common import column_bytes, mixed, slices, texts, written
from habitscope.llm.components import components

SEED, WIDTH, BITS = 42, 3, 3
SHARD, VISITORS, LEAF = 1 << 16, 1 << 18, 256
# Points sampled for each shard to come, and in all; members tried as a vantage point.
SAMPLED, SAMPLE, TRIED = 64, 1 << 20, 4
# Shingles hashed at once, and comparisons held at once, so that long texts and large shards need bounded memory.
_PIECE, _BLOCK = 1 << 16, 1 << 20


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Bits set in more than half of the shingle hashes, repeats included; 0 for a text without words."""
    words = text.lower().split()  # bytes: A to Z, and the six ASCII separators
    if not words:
        return 0
    span = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    count = len(words) - span + 1
    begins, ends = begins[:count].tolist(), ends[span - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, count, _PIECE):
        pieces = zip(begins[at : at + _PIECE], ends[at : at + _PIECE], strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pieces), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > count, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, bounds = column_bytes(batch, "text")
            found = [fingerprint(data[a:b].tobytes(), width) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(np.array(found, np.uint64).view(np.int64)),
                ],
                names=["doc_id", "fp"],
            )

    return rows


class Tree:
    """A vantage-point tree over distinct 64-bit values. Leaves hold at most ``leaf`` of them, or what no split parts."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf, self.leaves = points, leaf, 0
        self.root = self._node(np.argsort(mixed(points), kind="stable"))

    def _node(self, at: np.ndarray):
        split = self._split(at) if len(at) > self.leaf else None
        if split is None:
            self.leaves += 1
            return self.leaves - 1, at
        vantage, radius = split
        inside = np.bitwise_count(self.points[at] ^ np.uint64(vantage)) <= radius
        return vantage, radius, self._node(at[inside]), self._node(at[~inside])

    def _split(self, at: np.ndarray, bits: int = BITS) -> tuple[int, int] | None:
        """Of some members, the vantage point with the fewest others near its radius; each side gets a sixteenth."""
        found = []
        for vantage in self.points[at[:TRIED]]:
            counts = np.bincount(np.bitwise_count(self.points[at] ^ vantage), minlength=65 + bits)
            inner = np.cumsum(counts)[:64]
            radius = int(np.argmin(np.abs(2 * inner - len(at))))
            if 16 * min(inner[radius], len(at) - inner[radius]) >= len(at):
                found.append((int(counts[radius + 1 : radius + 1 + bits].sum()), int(vantage), radius))
        return min(found)[1:] if found else None

    def near(self, queries: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (places in ``queries``, places in the tree) at ``bits`` or fewer differing bits, in blocks."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, asked = stack.pop()
            if not len(asked):
                continue
            if len(node) == 4:
                vantage, radius, inside, outside = node
                d = np.bitwise_count(queries[asked] ^ np.uint64(vantage)).astype(np.int64)
                stack.append((inside, asked[d - bits <= radius]))
                stack.append((outside, asked[d + bits > radius]))
                continue
            held = node[1]
            step = max(1, _BLOCK // max(1, len(held)))
            for begin in range(0, len(asked), step):
                part = asked[begin : begin + step]
                x, y = np.nonzero(np.bitwise_count(queries[part, None] ^ self.points[None, held]) <= bits)
                yield part[x], held[y]

    def without_points(self) -> tuple:
        """The nodes alone, leaves as their numbers."""
        bare = lambda node: node[0] if len(node) == 2 else (*node[:2], bare(node[2]), bare(node[3]))
        return bare(self.root)


def _placed(root, bits: int):
    """Rows (fp, node, member): the leaf of each value, and the leaves that it visits."""

    def leaves(values: np.ndarray) -> Iterator[pa.RecordBatch]:
        stack = [(root, np.arange(len(values)), np.ones(len(values), bool))]
        out, size = [], 0

        def packed():
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fp", "node", "member"])

        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if isinstance(node, tuple):
                vantage, radius, inside, outside = node
                d = np.bitwise_count(values[at] ^ np.uint64(vantage)).astype(np.int64)
                here = d <= radius
                # Of two linked members in different children the outer one visits; visitors visit both.
                left = d - bits <= radius
                right = np.where(home, ~here, d + bits > radius)
                stack.append((inside, at[left], (home & here)[left]))
                stack.append((outside, at[right], (home & ~here)[right]))
                continue
            out.append((values[at].view(np.int64), np.full(len(at), node, np.int64), home))
            size += len(at)
            if size >= _BLOCK:
                yield packed()
                out, size = [], 0
        if out:
            yield packed()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += len(held[-1])
            if size >= _PIECE:
                yield from leaves(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from leaves(np.concatenate(held))

    return rows


def shards(points: DataFrame, bits: int = BITS, shard: int = SHARD, most: int = SAMPLE) -> DataFrame:
    """(fp, node, member) for distinct ``points`` (fp): each is a member of one node and visits others.

    Two points at ``bits`` or fewer differing bits share a node in which one of them, at least, is a member. Nodes have
    about ``shard`` members at most: the tree is fitted to SAMPLED points of each node to come, drawn by a hash, in all
    about ``most`` at most. Beyond ``most`` / SAMPLED * ``shard`` points nodes grow instead.
    """
    count = points.count()
    wanted = -(-count // shard)
    share = min(1.0, wanted * SAMPLED / max(1, count), most / max(1, count))
    drawn = F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = points.where(drawn).toPandas()["fp"].to_numpy(np.int64).view(np.uint64) if wanted > 1 else np.empty(0, np.uint64)
    tree = Tree(sample, max(1, int(shard * share))).without_points()
    return points.select("fp").mapInArrow(_placed(tree, bits), "fp long, node long, member boolean")


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a and b, each under the smallest place; parent is flat before and after."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent != (up := parent[parent])).any():
            parent[:] = up


def forest(members: np.ndarray, queries: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``queries`` and distinct ``members``: (value, root of its tree)."""
    points = np.unique(np.concatenate([members, queries]))
    mine, asked = np.searchsorted(points, members), np.searchsorted(points, queries)
    parent = np.arange(len(points))
    for x, y in Tree(members).near(queries, bits):
        _merge(parent, asked[x], mine[y])
    below = np.flatnonzero(parent != np.arange(len(points)))
    return points[below], points[parent[below]]


def links(points: DataFrame, bits: int = BITS, shard: int = SHARD, visitors: int = VISITORS) -> DataFrame:
    """(a, b): enough links between distinct ``points`` (fp) to connect what all links connect.

    A shard with more than ``visitors`` visitors is searched in several tasks, each with its members.
    """
    rows = written(shards(points, bits, shard), "shards")
    crowd = F.ceil(F.count_if(~F.col("member")) / visitors)
    crowded = written(rows.groupBy("node").agg(F.greatest(crowd, F.lit(1)).cast("int").alias("parts")), "shard-parts")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    parts = F.when(F.col("member"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    dealt = rows.join(crowded, "node").select("fp", "node", "member", F.explode(parts).alias("part"))

    def search(key, frame: pd.DataFrame) -> pd.DataFrame:
        values = frame["fp"].to_numpy(np.int64).view(np.uint64)
        home = frame["member"].to_numpy(bool)
        # Members ask in the first part only; visitors ask in theirs.
        a, b = forest(values[home], values if key[1] == 0 else values[~home], bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("node", "part").applyInPandas(search, "a long, b long")


def simhash_groups(
    docs: DataFrame, width: int = WIDTH, bits: int = BITS, shard: int = SHARD, visitors: int = VISITORS
) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), component_id: one row for each row of ``docs``.

    Documents whose fingerprints differ in at most ``bits`` bits are linked; component_id is the smallest doc_id that
    links reach, the own one included. Null, empty and wordless texts have fingerprint 0 and are linked like others.
    Rows without a doc_id link too but name no component, so one that reaches no doc_id has a null component. Rows that
    repeat a doc_id are linked by their own texts only. An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = written(texts(docs).mapInArrow(_fingerprints(width), f"doc_id {kind}, fp long"), "fingerprints")
    classes = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    near = written(components(written(links(classes.select("fp"), bits, shard, visitors), "simhash-links")), "simhash-components")
    named = classes.join(near.select(F.col("node").alias("fp"), "component"), "fp", "left")
    named = named.withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # Written, so that the join of a fingerprint that very many documents share can be split.
    named = written(named.join(least, "component").select("fp", "component_id"), "fingerprint-names")
    return signed.join(named, "fp").select("doc_id", "fp", "component_id")
