"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected to a few dimensions by Gaussian (2-stable) directions. The squared projected distance over the
squared true distance then has a chi-square law, which tells when to stop: a query looks at projected neighbours
nearest first, verifies them on the original vectors, and ends when a vector as near as its current k-th neighbour
would have been met already with the wanted confidence.

Largest inner product becomes smallest distance by one more coordinate, which brings all vectors to the largest norm.
The upper part of the kd-tree is fitted on a bounded sample and gives at most ``most_cells`` cells; every vector is
in one of them, whatever their number, and a cell is worked on in blocks of bounded size. Queries visit the cell
they are in first, and then, with the distance found there, only cells that the stopping test leaves open.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from habitscope.llm.common import written

RESULT = "query_id long, vec_id long, score double"
LEAF = 256


def chi_square(value: float, dims: int) -> float:
    """Distribution function for an even number of dimensions."""
    half = value / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))


def chi_square_quantile(share: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < share else (low, middle)
    return high


@dataclass
class Projection:
    directions: np.ndarray  # dims x (length of vectors + 1)
    top: float  # largest squared norm

    def apply(self, vectors: np.ndarray, extra: bool = True) -> np.ndarray:
        out = vectors @ self.directions[:, :-1].T
        if extra:
            left = np.sqrt(np.maximum(self.top - (vectors * vectors).sum(axis=1), 0))
            out += left[:, None] * self.directions[:, -1]
        return out


@dataclass
class Tree:
    """Split dimension and value of each inner node, level by level; cells are numbered from the left."""

    dims: np.ndarray
    values: np.ndarray
    depth: int

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.dims[node]] > self.values[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def fit_tree(points: np.ndarray, depth: int) -> Tree:
    """Median splits of the widest dimension."""
    dims, values = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    parts = [points]
    for node in range(2**depth - 1):
        own = parts[node]
        if len(own):
            dims[node] = int(np.ptp(own, axis=0).argmax())
            values[node] = float(np.median(own[:, dims[node]]))
        side = own[:, dims[node]] > values[node]
        parts += [own[~side], own[side]]
    return Tree(dims, values, depth)


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Row numbers in the leaves of a kd-tree; equal points may fill more than one."""
    out, open_parts = [], [np.arange(len(points))]
    while open_parts:
        own = open_parts.pop()
        if len(own) <= size:
            if len(own):
                out.append(own)
            continue
        widest = int(np.ptp(points[own], axis=0).argmax())
        order = own[np.argsort(points[own, widest], kind="stable")]
        open_parts += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of query points to boxes, 0 inside."""
    out = np.zeros((len(queries), len(low)))
    for d in range(queries.shape[1]):
        q = queries[:, d, None]
        gap = np.maximum(np.maximum(low[:, d] - q, q - high[:, d]), 0)
        out += gap * gap
    return out


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products whose rounding depends on the two vectors only."""
    return (vectors * query).sum(axis=1)


def search_block(
    ids: np.ndarray,
    vectors: np.ndarray,
    points: np.ndarray,
    query_ids: np.ndarray,
    queries: np.ndarray,
    query_points: np.ndarray,
    bounds: np.ndarray,
    top: float,
    k: int,
    limit: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of up to k neighbours in this block for each query.

    ``bounds``: a k-th score known already, or minus infinity. ``limit``: the chi-square quantile. Of equal
    vectors only the k + 1 with the smallest ids can be among k neighbours, so more are not looked at.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors, points = ids[order], vectors[order], points[order]
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, same = np.unique(raw, return_index=True, return_inverse=True)
    by_group = np.argsort(same, kind="stable")
    begins = np.searchsorted(same[by_group], np.arange(len(first) + 1))
    vectors, points = vectors[first], points[first]
    parts = leaves(points)
    low = np.array([points[p].min(axis=0) for p in parts])
    high = np.array([points[p].max(axis=0) for p in parts])
    nearest = box_distances(query_points, low, high)
    sequence = np.argsort(nearest, axis=1, kind="stable")
    n, wanted = len(queries), k + 1  # one more, as the query itself may be here
    best = np.full((n, wanted), -np.inf)
    who = np.full((n, wanted), -1)
    lengths = (queries * queries).sum(axis=1)
    active = np.arange(n)
    for turn in range(len(parts)):
        at = sequence[active, turn]
        known = np.maximum(bounds[active], best[active].min(axis=1))
        reach = np.where(np.isfinite(known), np.maximum(lengths[active] + top - 2 * known, 0) * limit, np.inf)
        going = nearest[active, at] <= reach
        active, at = active[going], at[going]
        if not len(active):
            break
        order = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[order])) + 1
        for group in np.split(order, edges):
            rows, part = active[group], parts[at[group[0]]]
            found = queries[rows] @ vectors[part].T
            merged = np.concatenate([best[rows], found], axis=1)
            names = np.concatenate([who[rows], np.broadcast_to(part, (len(rows), len(part)))], axis=1)
            pick = np.argpartition(-merged, wanted - 1, axis=1)[:, :wanted]
            best[rows] = np.take_along_axis(merged, pick, axis=1)
            who[rows] = np.take_along_axis(names, pick, axis=1)
    out_query, out_id, out_score = [], [], []
    for i in range(n):
        groups = who[i][who[i] >= 0]
        if not len(groups):
            continue
        scores = exact_scores(vectors[groups], queries[i])
        members = [by_group[begins[g] : begins[g + 1]][: k + 1] for g in groups]
        own_ids = ids[np.concatenate(members)]
        own_scores = np.repeat(scores, [len(m) for m in members])
        other = own_ids != query_ids[i]
        own_ids, own_scores = own_ids[other], own_scores[other]
        chosen = np.lexsort((own_ids, -own_scores))[:k]
        out_query.append(np.full(len(chosen), query_ids[i]))
        out_id.append(own_ids[chosen])
        out_score.append(own_scores[chosen])
    if not out_query:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(out_query), np.concatenate(out_id), np.concatenate(out_score)


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64, copy=False).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """True for a vector that is not null or zero and has only finite components."""
    each = lambda test: F.forall(vector, test)
    finite = each(lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    dims: int = 8,
    confidence: float = 0.96,
    cell_rows: int = 4096,
    most_cells: int = 1024,
    sample: int = 20000,
    query_rows: int = 4096,
    seed: int = 6,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) that ``queries`` holds for.

    Null, zero and non-finite vectors and rows without vec_id take no part; shorter vectors count as filled up with
    zeros. Ties go to the smaller vec_id. Of rows that repeat a vec_id with equal vectors one is found once. An
    empty table gives no rows; other columns are not read. Recall is measured against brute force in the tests.

    The sample that the cells are fitted on has about ``sample`` rows; all rows are indexed.
    """
    spark = vectors.sparkSession
    double = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), double.alias("embedding"), queries.alias("asks")
    )
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    count, length, top = rows.agg(F.count("*"), F.max(F.size("embedding")), F.max(norm)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    random = np.random.default_rng(seed)
    projection = Projection(random.normal(size=(dims, length + 1)), float(top))
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("embedding")))
    rows = rows.select("vec_id", filled.alias("embedding"), "asks")

    place = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) / (1 << 30)
    taken = rows.where(place < sample / count).select("vec_id", "embedding").toArrow().sort_by("vec_id")
    cells = min(most_cells, max(1, count // cell_rows), max(1, taken.num_rows // 16))
    depth = int(math.log2(cells))
    tree = fit_tree(projection.apply(_matrix(taken, "embedding")) if taken.num_rows else np.empty((0, dims)), depth)

    def placed(batches):
        for batch in batches:
            data = _matrix(pa.Table.from_batches([batch]), "embedding")
            points = projection.apply(data)
            flat = pa.array(points.ravel())
            offsets = pa.array(np.arange(len(points) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, flat), pa.array(tree.cell(points))],
                names=[*batch.schema.names, "point", "cell"],
            )

    indexed = rows.mapInArrow(placed, "vec_id long, embedding array<double>, asks boolean, point array<double>, cell long")
    indexed = written(indexed, "projected")
    sides = [f(F.get("point", F.lit(d))).alias(f"{n}{d}") for n, f in (("low", F.min), ("high", F.max)) for d in range(dims)]
    # One row for each cell, at most ``most_cells``.
    known = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"), *sides).orderBy("cell").collect()
    numbers = np.array([r["cell"] for r in known])
    low = np.array([[r[f"low{d}"] for d in range(dims)] for r in known])
    high = np.array([[r[f"high{d}"] for d in range(dims)] for r in known])
    chunks = max(1, -(-sum(r["asked"] for r in known) // query_rows))
    blocks = F.element_at(
        F.create_map(*[F.lit(int(v)) for r in known for v in (r["cell"], -(-r["n"] // (2 * cell_rows)))]), F.col("cell")
    )
    limit = chi_square_quantile(confidence, dims)
    top = float(top)

    targets = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks)).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )
    asking = indexed.where("asks").select(F.col("vec_id").alias("query_id"), "embedding", "point", F.col("cell").alias("home"))

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        else:
            found = search_block(
                left.column("vec_id").to_numpy(),
                _matrix(left, "embedding"),
                _matrix(left, "point"),
                right.column("query_id").to_numpy(),
                _matrix(right, "embedding"),
                # A query's added coordinate is 0, so the one of its own row does not count.
                projection.apply(_matrix(right, "embedding"), extra=False),
                right.column("bound").to_numpy(),
                top,
                k,
                limit,
            )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def visit(asked: DataFrame) -> DataFrame:
        """The k best for each query over the cells it visits. ``asked``: query_id, embedding, bound, cell."""
        spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
        spread = spread.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
        key = ["cell", "block", "chunk"]
        kinds = {"block": F.col("block").cast("long"), "chunk": F.col("chunk").cast("long")}
        left = targets.withColumns(kinds).select(*key, "vec_id", "embedding", "point").groupBy(*key)
        right = spread.withColumns(kinds).select(*key, "query_id", "embedding", "bound").groupBy(*key)
        return left.cogroup(right).applyInArrow(searched, RESULT)

    def ranked(found: DataFrame) -> DataFrame:
        return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    minus = F.lit(float("-inf"))
    home = written(ranked(visit(asking.select("query_id", "embedding", minus.alias("bound"), F.col("home").alias("cell")))), "home-neighbours")
    kth = home.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))

    def open_cells(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            data = _matrix(table, "embedding")
            gaps = box_distances(projection.apply(data, extra=False), low, high)
            bound = table.column("bound").to_numpy()
            reach = np.where(np.isfinite(bound), np.maximum((data * data).sum(axis=1) + top - 2 * bound, 0) * limit, np.inf)
            home_cell = table.column("home").to_numpy()
            row, cell = np.nonzero((gaps <= reach[:, None]) & (numbers[None] != home_cell[:, None]))
            kept = table.select(["query_id", "embedding", "bound"]).take(pa.array(row)).combine_chunks()
            yield from kept.append_column("cell", pa.array(numbers[cell])).to_batches()

    asked = asking.join(kth, "query_id", "left").select(
        "query_id", "embedding", F.coalesce("bound", minus).alias("bound"), "home"
    )
    more = asked.mapInArrow(open_cells, "query_id long, embedding array<double>, bound double, cell long")
    return ranked(home.select("query_id", "vec_id", "score").union(visit(more))).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
