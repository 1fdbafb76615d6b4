"""Order statistics: weighted medians, leave-one-out centres, spreads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitscope.functions.ordered import HOT_ROWS, beside, chunked, is_plain, scan, unchunked
from habitscope.session import cut

TOLERANCE = 1e-9


def middles(
    histogram: DataFrame, keys: Sequence[str], value: str, count: str, hot_rows: int | None = None, plain: bool = False
) -> DataFrame:
    """Interpolated median of each key from ``count`` of each distinct ``value``: ``middle`` and ``sample``.

    Ranks are running sums of the counts.  A hot key's values are cut into ranges that are summed apart, so no task
    holds all values of a key.  A histogram that is not ``plain`` is examined and should be a written table.
    """
    c = F.col(count)
    ranked = scan(
        chunked(histogram, keys, value, hot_rows, plain), keys, [value], {"_cum": ("sum", c), "_total": ("total", c)}
    )
    at = lambda rank: F.min(F.when(F.col("_cum") >= rank, F.col(value)))
    both = at(F.floor((F.col("_total") + 1) / 2)) + at(F.ceil((F.col("_total") + 1) / 2))
    return unchunked(ranked).groupBy(*keys).agg((both / 2).alias("middle"), F.max("_total").alias("sample"))


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys in which a null is a value of its own."""
    renamed = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_on_{k}" for k in keys])


def long_histogram(df: DataFrame, keys: Sequence[str], values: Mapping[str | int, Column]) -> DataFrame:
    """(keys, metric, x, _c): how often each value that is not null comes, for all named columns in one shuffle."""
    entries = [F.struct(F.lit(name).alias("metric"), column.cast("double").alias("x")) for name, column in values.items()]
    long = df.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.metric", "_e.x")
    return long.where(F.col("x").isNotNull()).groupBy(*keys, "metric", "x").agg(F.count(F.lit(1)).alias("_c"))


def medians(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    *extra: Column,
    hot_rows: int | None = None,
    plain: bool = False,
) -> DataFrame:
    """Interpolated medians per key, by rank in the histograms of all columns, beside ``extra`` aggregates."""
    plain = plain or is_plain(df)
    histogram = long_histogram(df, keys, values)
    found = middles(histogram if plain else cut(histogram), [*keys, "metric"], "x", "_c", hot_rows, plain)
    wide = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == name, F.col("middle"))).alias(name) for name in values]
    )
    if not extra:
        return wide
    return matched(df.groupBy(*keys).agg(*extra), wide, keys)


def spread(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    centre: str = "centre",
    mad: str = "mad",
    hot_rows: int | None = None,
    plain: bool = False,
) -> DataFrame:
    """Median and median absolute deviation per key, by rank in the histograms of values and of distances."""
    plain = plain or is_plain(df)
    keep = (lambda frame: frame) if plain else cut
    histogram = keep(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    )
    histogram = chunked(histogram, keys, value, hot_rows, plain)
    centres = middles(histogram, keys, value, "_c", hot_rows, plain).select(*keys, F.col("middle").alias(centre))
    distances = keep(
        beside(histogram, centres, keys)
        .groupBy(*keys, F.abs(F.col(value) - F.col(centre)).alias("_d"))
        .agg(F.first(centre).alias(centre), F.sum("_c").alias("_c"))
    )
    found = middles(distances.drop(centre), keys, "_d", "_c", hot_rows, plain)
    return found.join(centres, list(keys)).select(*keys, centre, F.col("middle").alias(mad), "sample")


def lower_weighted_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    name: str = "weighted_median",
    hot_rows: int | None = None,
    plain: bool = False,
) -> DataFrame:
    """First value whose cumulative weight reaches half the total; weights above zero only."""
    histogram = (
        df.where((F.col(weight) > 0) & F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum(weight).alias("_w"))
    )
    cumulated = scan(
        chunked(histogram, keys, value, hot_rows, plain or is_plain(df)),
        keys,
        [value],
        {"_cum": ("sum", F.col("_w")), "_all": ("total", F.col("_w"))},
    )
    reached = F.col("_cum") >= F.col("_all") / 2 - F.lit(TOLERANCE) * F.col("_all")
    return unchunked(cumulated).where(reached).groupBy(*keys).agg(F.min(value).alias(name))


def _order_statistics(
    histogram: DataFrame, keys: Sequence[str], value: str, prefix: str, hot_rows: int | None, plain: bool
) -> DataFrame:
    """The order statistics next to the middle that a leave-one-out median can need.

    Removing one of n values leaves n - 1; its median averages the remaining positions
    floor(n/2) and ceil(n/2).  Each is the same position of the full list, or the next one
    when the removed value lies at or before it, so four statistics are enough.
    """
    cumulated = scan(
        chunked(histogram, keys, value, hot_rows, plain),
        keys,
        [value],
        {"_cum": ("sum", F.col("_c")), "_n": ("total", F.col("_c"))},
    )
    low, high = F.floor(F.col("_n") / 2), F.ceil(F.col("_n") / 2)

    def at(position: Column, name: str) -> Column:
        return F.min(F.when(F.col("_cum") >= position, F.col(value))).alias(f"{prefix}_{name}")

    return cumulated.groupBy(*keys).agg(
        F.max("_n").alias(f"{prefix}_n"), at(low, "p0"), at(low + 1, "p1"), at(high, "q0"), at(high + 1, "q1")
    )


def _without_own(own: Column, at: str) -> Column:
    """Median of the values without ``own``, from the four order statistics named ``at``."""
    low = F.when(own <= F.col(f"{at}_p0"), F.col(f"{at}_p1")).otherwise(F.col(f"{at}_p0"))
    high = F.when(own <= F.col(f"{at}_q0"), F.col(f"{at}_q1")).otherwise(F.col(f"{at}_q0"))
    return F.when(F.col(f"{at}_n") > 1, (low + high) / 2)


def _ranked_statistics(df: DataFrame, keys: Sequence[str], values: Sequence[str], hot_rows: int | None) -> DataFrame:
    """Order statistics of each key for :func:`leave_one_out` by running counts, so that no task holds all values."""
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values])
        ).alias("_e"),
    ).select(*keys, "_e.metric", "_e.x")
    group = [*keys, "metric"]
    histogram = long.where(F.col("x").isNotNull()).groupBy(*group, "x").agg(F.count(F.lit(1)).alias("_c"))
    first = _order_statistics(histogram, group, "x", "x", hot_rows, is_plain(df))

    deviations = (
        histogram.join(
            first.where(F.col("x_n") > 1).select(
                *group,
                F.explode(
                    F.array_distinct(
                        F.array(
                            (F.col("x_p1") + F.col("x_q1")) / 2,
                            (F.col("x_p0") + F.col("x_q1")) / 2,
                            (F.col("x_p0") + F.col("x_q0")) / 2,
                        )
                    )
                ).alias("centre"),
            ),
            group,
        )
        .groupBy(*group, "centre", F.abs(F.col("x") - F.col("centre")).alias("d"))
        .agg(F.sum("_c").alias("_c"))
    )
    second = _order_statistics(deviations, [*group, "centre"], "d", "d", hot_rows, is_plain(df))
    packed = second.groupBy(*group).agg(
        F.map_from_entries(
            F.collect_list(  # at most three entries per key and metric
                F.struct("centre", F.struct("d_n", "d_p0", "d_p1", "d_q0", "d_q1"))
            )
        ).alias("classes")
    )
    summary = first.join(packed, group, "left")
    return summary.groupBy(*keys).agg(
        *[
            F.max_by(
                F.struct("x_n", "x_p0", "x_p1", "x_q0", "x_q1", "classes"),
                F.when(F.col("metric") == v, F.lit(1)),
            ).alias(f"_loo_{v}")
            for v in values
        ]
    )


def _listed_statistics(df: DataFrame, keys: Sequence[str], values: Sequence[str], hot_rows: int | None) -> DataFrame:
    """The same where no key is hot: the values of a key, ``HOT_ROWS`` at most, are one sorted array."""

    def statistics(ordered: Column, prefix: str) -> list[Column]:
        n = F.size(ordered)
        low, high = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
        places = {"p0": F.greatest(low, F.lit(1)), "p1": low + 1, "q0": high, "q1": high + 1}
        return [
            n.cast("bigint").alias(f"{prefix}_n"),
            *[F.get(ordered, place - 1).alias(f"{prefix}_{name}") for name, place in places.items()],
        ]

    def classes(v: str) -> Column:
        at = {k: F.col(f"_box_{v}.x_{k}") for k in ("p0", "p1", "q0", "q1")}
        centres = F.array_distinct(
            F.array((at["p1"] + at["q1"]) / 2, (at["p0"] + at["q1"]) / 2, (at["p0"] + at["q0"]) / 2)
        )
        distances = F.transform(
            centres,
            lambda c: F.struct(
                c.alias("centre"), F.sort_array(F.transform(f"_all_{v}", lambda x: F.abs(x - c))).alias("d")
            ),
        )
        entries = F.transform(distances, lambda e: F.struct(e["centre"], F.struct(*statistics(e["d"], "d"))))
        return F.when(F.col(f"_box_{v}.x_n") > 1, F.map_from_entries(entries))

    # Adding zero turns -0.0 into 0.0.
    listed = df.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(F.col(v).cast("double") + F.lit(0.0))).alias(f"_all_{v}") for v in values]
    )
    placed = listed.withColumns({f"_box_{v}": F.struct(*statistics(F.col(f"_all_{v}"), "x")) for v in values})
    return placed.select(
        *keys,
        *[
            F.struct(*[f"_box_{v}.x_{k}" for k in ("n", "p0", "p1", "q0", "q1")], classes(v).alias("classes")).alias(f"_loo_{v}")
            for v in values
        ],
    )


def leave_one_out(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], hot_rows: int | None = None
) -> DataFrame:
    """Per row the median and MAD of all OTHER values of the key, for each named column.

    A key has at most three different leave-one-out centres.  Their order statistics are
    found on the distinct values and come back as one small row per key; every fact row
    then derives its own centre and scale from that row with plain expressions.  Adds
    ``<value>_centre`` (0 when alone) and ``<value>_scale`` (1 when zero or alone).
    """
    wide = (_listed_statistics if is_plain(df) else _ranked_statistics)(df, keys, values, hot_rows)
    out = df.join(wide, list(keys), "left")
    for v in values:
        box, own = f"_loo_{v}", F.col(v).cast("double")
        out = out.withColumns({f"_x_{k}": F.col(f"{box}.x_{k}") for k in ("n", "p0", "p1", "q0", "q1")})
        out = out.withColumn("_centre", _without_own(own, "_x"))
        out = out.withColumn("_class", F.try_element_at(F.col(f"{box}.classes"), F.col("_centre")))
        out = out.withColumns({f"_d_{k}": F.col(f"_class.d_{k}") for k in ("n", "p0", "p1", "q0", "q1")})
        scale = _without_own(F.abs(own - F.col("_centre")), "_d")
        out = out.withColumns(
            {
                f"{v}_centre": F.when(own.isNotNull(), F.coalesce(F.col("_centre"), F.lit(0.0))),
                f"{v}_scale": F.when(
                    own.isNotNull(), F.when((scale == 0) | scale.isNull(), F.lit(1.0)).otherwise(scale)
                ),
            }
        ).drop(
            box, "_centre", "_class", *[f"_{a}_{k}" for a in "xd" for k in ("n", "p0", "p1", "q0", "q1")]
        )
    return out


def select_without_group(
    rows: DataFrame,
    cell: Sequence[str],
    group: str,
    value: str,
    weight: str,
    tie: str,
    at,
    minimum: int = 1,
    hot_rows: int | None = None,
    plain: bool = False,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Order statistics of a cell without one of its groups, for every (cell, group), or those of ``asked`` only.

    ``at(rest_weight, rest_rows)`` gives named cumulative weights; for each the first value of
    the rest whose running weight reaches it is returned.  The cell is ordered once with
    running weights; the group's own weights before the wanted point are taken off by shifting
    the point, and the shifted points are looked up in the running weights of the cell.  Linear
    in the rows, whatever the size of the cell.
    """
    cell = tuple(cell)
    order = (value, tie)
    one, w = F.lit(1).cast("bigint"), F.col(weight)
    cells = scan(
        chunked(unchunked(rows), cell, value, hot_rows, plain, tie),
        cell,
        order,
        {"_w": ("sum", w), "_all": ("total", w), "_all2": ("total", w * w), "_n": ("total", one)},
    )
    own = scan(
        cells if asked is None else cells.join(asked, [*cell, group], "left_semi"),
        (*cell, group),
        order,
        {"_s": ("sum", w), "_own": ("total", w), "_own2": ("total", w * w), "_k": ("total", one)},
    )
    slack = F.lit(TOLERANCE) * F.col("_all")
    points = at(F.col("_all") - F.col("_own"), F.col("_n") - F.col("_k"))
    # One row per cell and group, read twice below.
    wanted = cut(
        own.groupBy(*cell, group)
        .agg(
            F.first(F.col("_n") - F.col("_k")).alias("reference_rows"),
            F.first(
                F.try_divide(
                    (F.col("_all") - F.col("_own")) * (F.col("_all") - F.col("_own")), F.col("_all2") - F.col("_own2")
                )
            ).alias("effective_rows"),
            F.first(slack).alias("_slack"),
            *[F.first(point).alias(f"_point_{name}") for name, point in points.items()],
            # Own weight that lies before the wanted point of the others.
            *[
                F.max(F.when(F.col("_w") - F.col("_s") < point - slack, F.col("_s"))).alias(f"_passed_{name}")
                for name, point in points.items()
            ],
        )
        .where(F.col("reference_rows") >= minimum)
    )
    steps = unchunked(cells).select(
        *cell,
        F.col("_w").cast("double").alias("_at"),
        F.lit(1).alias("_step"),
        F.col(value).alias("_value"),
        F.lit(None).cast(rows.schema[group].dataType).alias(group),
        F.lit(None).cast("string").alias("_name"),
    )
    questions = wanted.select(
        *cell,
        group,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("_name"),
                        (
                            F.col(f"_point_{name}") + F.coalesce(f"_passed_{name}", F.lit(0.0)) - F.col("_slack")
                        ).alias("_at"),
                    )
                    for name in points
                ]
            )
        ).alias("_q"),
    ).select(*cell, "_q._at", F.lit(0).alias("_step"), F.lit(None).cast("double").alias("_value"), group, "_q._name")
    answered = scan(
        chunked(steps.unionByName(questions), cell, "_at", hot_rows, plain, "_step"),
        cell,
        ("_at", "_step"),
        {"_found": ("next", F.col("_value"))},
    )
    found = (
        unchunked(answered)
        .where(F.col("_step") == 0)
        .groupBy(*cell, group)
        .agg(*[F.max(F.when(F.col("_name") == name, F.col("_found"))).alias(name) for name in points])
    )
    return found.join(wanted.select(*cell, group, "reference_rows", "effective_rows"), [*cell, group])


def select_without_own(
    rows: DataFrame, cell: Sequence[str], group: str, value: str, weight: str, tie: str, asks: str, at, name: str
) -> DataFrame:
    """What :func:`select_without_group` finds, for the rows marked by ``asks``, where no cell is hot.

    Every pass is a window by cell or by cell and group, so the rows are shuffled once at most.
    Gives the cell, group and tie of each asking row beside its order statistic ``name``.
    """
    cell = tuple(cell)
    order = (value, tie)
    one, w = F.lit(1).cast("bigint"), F.col(weight)
    cells = scan(
        unchunked(rows),
        cell,
        order,
        {"_w": ("sum", w), "_all": ("total", w), "_all2": ("total", w * w), "_n": ("total", one)},
    )
    own = scan(
        cells,
        (*cell, group),
        order,
        {"_s": ("sum", w), "_own": ("total", w), "_own2": ("total", w * w), "_k": ("total", one)},
    )
    rest = F.col("_all") - F.col("_own")
    point, slack = at(rest, F.col("_n") - F.col("_k")), F.lit(TOLERANCE) * F.col("_all")
    # Own weight that lies before the wanted point of the others.
    passed = F.when(F.col("_w") - F.col("_s") < point - slack, F.col("_s"))
    shifted = scan(own, (*cell, group), order, {"_passed": ("total_max", passed)})
    step = F.struct(F.col("_w").cast("double").alias("_at"), F.lit(1).alias("_step"), F.col(value).alias("_value"))
    question = F.struct(
        (point + F.coalesce("_passed", F.lit(0.0)) - slack).alias("_at"),
        F.lit(0).alias("_step"),
        F.lit(None).cast(rows.schema[value].dataType).alias("_value"),
    )
    looked = shifted.select(
        *cell,
        group,
        tie,
        (F.col("_n") - F.col("_k")).alias("reference_rows"),
        F.try_divide(rest * rest, F.col("_all2") - F.col("_own2")).alias("effective_rows"),
        F.explode(F.array_compact(F.array(step, F.when(F.col(asks), question)))).alias("_q"),
    ).select("*", "_q._at", "_q._step", "_q._value")
    answered = scan(looked.drop("_q"), cell, ("_at", "_step"), {name: ("next", F.col("_value"))})
    return answered.where(F.col("_step") == 0).select(*cell, group, tie, name, "reference_rows", "effective_rows")


def middles_without_group(
    rows: DataFrame,
    cell: Sequence[str],
    group: str,
    asked: DataFrame,
    values: Mapping[str, Column],
    hot_rows: int | None = None,
) -> DataFrame:
    """Interpolated medians of the cells of ``asked`` (cell, group; each group in one cell) without the group's rows.

    Each cell becomes one histogram with running counts.  The rest's rank r of a value is at r plus the group's own
    rows up to there; those are found by looking the group's own values up in the histogram, and the shifted ranks are
    looked up in the running counts.  Nothing is ordered by row, and no row of a cell meets a group but its own.
    """
    cell = tuple(cell)
    keys = (*cell, "metric")
    c = F.col("_c")
    # The columns go by their places, which are shorter than their names.
    names, values = list(values), dict(enumerate(values.values()))
    counts = chunked(cut(long_histogram(rows, cell, values)), keys, "x", hot_rows)
    ranked = scan(counts, keys, ["x"], {"_cum": ("sum", c), "_all": ("total", c)})
    plain = is_plain(counts)
    own = long_histogram(rows.join(asked, [*cell, group], "left_semi"), (*cell, group), values)
    own = own.withColumnRenamed("_c", "_k").join(unchunked(ranked), [*keys, "x"])
    # A group has no more values than its cell.
    placed = scan(
        chunked(own if plain else cut(own), (*keys, group), "x", hot_rows, plain),
        (*keys, group),
        ["x"],
        {"_own": ("sum", F.col("_k")), "_mine": ("total", F.col("_k"))},
    )
    # Own values with fewer than r of the rest strictly below them lie at or before the rest's rank r.
    below = F.col("_cum") - F.col("_c") - F.col("_own") + F.col("_k")
    rest = F.col("_all") - F.col("_mine")
    ranks = {"low": F.floor((rest + 1) / 2), "high": F.ceil((rest + 1) / 2)}
    shifts = unchunked(placed).groupBy(*keys, group).agg(
        F.first("_mine").alias("_mine"),
        *[F.max(F.when(below < rank, F.col("_own"))).alias(f"_before_{name}") for name, rank in ranks.items()],
    )
    sizes = unchunked(counts).groupBy(*keys).agg(F.sum("_c").alias("_all"))
    asked_ranks = (
        asked.join(sizes, list(cell))
        .join(shifts, [*keys, group], "left")
        .withColumn("_mine", F.coalesce("_mine", F.lit(0)))
        .where(rest > 0)
        .select(
            *keys,
            group,
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(name).alias("_name"), (rank + F.coalesce(f"_before_{name}", F.lit(0))).alias("_cum"))
                        for name, rank in ranks.items()
                    ]
                )
            ).alias("_q"),
        )
    )
    steps = unchunked(ranked).select(
        *keys, "_cum", F.lit(1).alias("_step"), "x", F.lit(None).cast(asked.schema[group].dataType).alias(group),
        F.lit(None).cast("string").alias("_name"),
    )
    questions = asked_ranks.select(
        *keys, "_q._cum", F.lit(0).alias("_step"), F.lit(None).cast("double").alias("x"), group, "_q._name"
    )
    # A cell has two questions for each group that asks.
    crowded = asked.groupBy(*cell).agg(F.count(F.lit(1)).alias("_g")).where(2 * F.col("_g") > (hot_rows or HOT_ROWS))
    looked = steps.unionByName(questions)
    plain = plain and crowded.isEmpty()
    answered = scan(
        chunked(looked if plain else cut(looked), keys, "_cum", hot_rows, plain, "_step"),
        keys,
        ("_cum", "_step"),
        {"_found": ("next", F.col("x"))},
    )
    middle = F.max(F.when(F.col("_name") == "low", F.col("_found"))) + F.max(F.when(F.col("_name") == "high", F.col("_found")))
    return (
        unchunked(answered).where(F.col("_step") == 0).groupBy(*keys, group).agg((middle / 2).alias("middle"))
        .groupBy(*cell, group)
        .agg(*[F.max(F.when(F.col("metric") == place, F.col("middle"))).alias(name) for place, name in enumerate(names)])
    )
