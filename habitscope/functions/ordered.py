"""Ordered scans per key that stay parallel when one key holds much of the table.

A plain window over a key puts all rows of the key in one task.  Here a key with
more than ``hot_rows`` rows is cut into chunks along the ordering columns, the
window runs inside each chunk, and a table of chunk summaries carries the state
from chunk to chunk by running windows of its own.

A table is examined once (:func:`chunked`): one pre-aggregated count per key.  Where no
key is hot the frame only gets a marker column and every later scan is the plain window
on one shuffle.  Hot keys are cut at quantiles of the first ordering column, and inside a
value that fills a quantile, at quantiles of the tie column, so neither long tails nor
equal values fill a chunk.  Hot keys and their bounds are broadcast by order: a hot key has
more than ``hot_rows`` rows, so there are few, and a join that shuffled by key would bring all
rows of a hot key to one task before they are cut.  The summaries of a scan by fine keys may
approach the rows in number and are joined as they come.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

HOT_ROWS = 2_000_000
CHUNK = "_chunk"
HOT = "_hot"
# Cuts of a hot key along each of the two columns.
CUTS = 128


def is_plain(df: DataFrame) -> bool:
    """True when the frame was examined and no key of it is hot."""
    return CHUNK in df.columns and HOT not in df.columns


def marks(df: DataFrame) -> list[str]:
    """The columns by which an examined frame tells where its keys are hot."""
    return [c for c in (HOT, CHUNK) if c in df.columns]


def rank_number(column: Column, kind: T.DataType) -> Column:
    """A number that never falls where the column rises.

    Of text and bytes, the first six bytes; of a struct, that of its first field.
    """
    if isinstance(kind, T.StructType):
        return rank_number(column[kind.names[0]], kind[0].dataType)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(column), 12, "0"), 16, 10).cast("double")
    return column.cast("double")


def chunked(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    hot_rows: int | None = None,
    plain: bool = False,
    tie: str | None = None,
) -> DataFrame:
    """Examine a frame and add chunk numbers where a key is hot.

    ``order`` is numeric and not null; ``tie`` is the next ordering column, for keys with many
    equal values.  Pass ``plain`` for a frame derived from one that has no hot key, since it then has none either.
    """
    if CHUNK in df.columns:
        return df
    if plain:
        return df.withColumn(CHUNK, F.lit(0).cast("bigint"))
    limit = hot_rows or HOT_ROWS
    position = F.col(order).cast("double")
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)
    if hot.isEmpty():
        return df.withColumn(CHUNK, F.lit(0).cast("bigint"))
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    bounds = (
        df.join(F.broadcast(hot), list(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(position, shares, CUTS * 100).alias("_bounds"))
    )

    def below(cuts: str, value: Column) -> Column:
        return F.size(F.filter(cuts, lambda b: b < value))

    # A value that is a bound has a chunk number of its own, between those of its neighbours.
    values = F.array_distinct("_bounds")
    placed = (
        df.join(F.broadcast(bounds.withColumn("_bounds", values)), list(keys), "left")
        .withColumn(HOT, F.col("_bounds").isNotNull())
        .withColumn(
            CHUNK,
            F.when(
                F.col(HOT),
                2 * below("_bounds", position) + F.array_contains("_bounds", position).cast("int"),
            ).otherwise(0).cast("bigint"),
        )
        .drop("_bounds")
    )
    if tie is None:
        return placed.select(*df.columns, HOT, CHUNK)
    second = rank_number(F.col(tie), df.schema[tie].dataType)
    heavy = (
        placed.where(F.col(HOT))
        .groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(second, shares, CUTS * 100).alias("_ties"))
        .where((F.col("_n") > limit) & (F.col(CHUNK) % 2 == 1))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct(CHUNK, F.array_distinct("_ties")))).alias("_heavy"))
    )
    # A hot key has few heavy values, so they come with its bounds.
    ties = F.try_element_at(F.col("_heavy"), F.col(CHUNK))
    inner = F.when(ties.isNull(), 0).otherwise(F.size(F.filter(ties, lambda b: b < second)))
    return (
        placed.join(F.broadcast(heavy), list(keys), "left")
        .withColumn(CHUNK, F.col(CHUNK) * CUTS + inner)
        .select(*df.columns, HOT, CHUNK)
    )


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Add ordered results to a frame that went through :func:`chunked`.

    Kinds: ``sum`` / ``max`` / ``min`` / ``last`` run from the first row to the current
    one (``last`` skips nulls), ``next`` is the first non-null from the current row on,
    ``lag`` and ``lead`` read the neighbour, ``total`` / ``total_max`` / ``total_min``
    cover the whole key.
    """
    hot = HOT in df.columns
    cell = [*keys, CHUNK] if hot else list(keys)
    ordered = Window.partitionBy(*cell).orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # From the last row back to the current one: a frame that ends at the last row is read anew for every row.
    backwards = Window.partitionBy(*cell).orderBy(*[F.desc(name) for name in order])
    backwards = backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Same ordering as the running frames, so that all of them share one sort.
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.struct(*[F.col(name) for name in order])

    local: dict[str, Column] = {}
    summary: list[Column] = []
    carry: list[Column] = []
    merged: dict[str, Column] = {}
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    everything = Window.partitionBy(*keys)

    for name, (kind, value) in specs.items():
        here, chunk_value, carried = f"_l_{name}", f"_s_{name}", f"_c_{name}"
        boxed = F.struct(value.alias("v"))
        if kind == "sum":
            local[here] = F.sum(value).over(running)
            summary.append(F.sum(value).alias(chunk_value))
            carry.append(F.sum(chunk_value).over(before).alias(carried))
            merged[name] = F.when(F.col(carried).isNull(), F.col(here)).otherwise(
                F.coalesce(F.col(here), F.lit(0)) + F.col(carried)
            )
        elif kind in ("max", "min"):
            pick = F.max if kind == "max" else F.min
            join = F.greatest if kind == "max" else F.least
            local[here] = pick(value).over(running)
            summary.append(pick(value).alias(chunk_value))
            carry.append(pick(chunk_value).over(before).alias(carried))
            merged[name] = join(F.col(here), F.col(carried))
        elif kind == "last":
            local[here] = F.last(value, ignorenulls=True).over(running)
            summary.append(F.max_by(value, F.when(value.isNotNull(), rank)).alias(chunk_value))
            carry.append(F.last(chunk_value, ignorenulls=True).over(before).alias(carried))
            merged[name] = F.coalesce(F.col(here), F.col(carried))
        elif kind == "next":
            local[here] = F.last(value, ignorenulls=True).over(backwards)
            summary.append(F.min_by(value, F.when(value.isNotNull(), rank)).alias(chunk_value))
            carry.append(F.first(chunk_value, ignorenulls=True).over(after).alias(carried))
            merged[name] = F.coalesce(F.col(here), F.col(carried))
        elif kind in ("lag", "lead"):
            step = F.lag if kind == "lag" else F.lead
            edge = F.max_by if kind == "lag" else F.min_by
            local[here] = step(boxed).over(ordered)
            summary.append(edge(boxed, rank).alias(chunk_value))
            carry.append(step(chunk_value).over(across).alias(carried))
            merged[name] = F.coalesce(F.col(here), F.col(carried))["v"]
        elif kind in ("total", "total_max", "total_min"):
            pick = {"total": F.sum, "total_max": F.max, "total_min": F.min}[kind]
            local[here] = pick(value).over(whole)
            summary.append(pick(value).alias(chunk_value))
            carry.append(pick(chunk_value).over(everything).alias(carried))
            merged[name] = F.coalesce(F.col(carried), F.col(here))
        else:
            raise ValueError(f"unknown scan kind: {kind}")

    if not hot:
        boxed_kinds = ("lag", "lead")
        return df.withColumns(
            {n: local[f"_l_{n}"]["v"] if kind in boxed_kinds else local[f"_l_{n}"] for n, (kind, _) in specs.items()}
        )
    carried_state = df.where(F.col(HOT)).groupBy(*cell).agg(*summary).select(*cell, *carry)
    out = df.withColumns(local).join(carried_state, cell, "left")
    return out.withColumns(merged).select(*[c for c in df.columns if c not in specs], *specs)


def beside(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of a frame that went through :func:`chunked` with one row per key.

    The few hot keys meet their row by broadcast, so their rows stay where they are.
    """
    if HOT not in df.columns:
        return df.join(per_key, list(keys))
    hot = df.where(F.col(HOT)).select(*keys).distinct()
    few = F.broadcast(per_key.join(F.broadcast(hot), list(keys), "left_semi"))
    cold = df.where(~F.col(HOT)).join(per_key, list(keys))
    return cold.unionByName(df.where(F.col(HOT)).join(few, list(keys)))


def unchunked(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK, HOT)
