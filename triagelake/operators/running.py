"""Point-in-time totals and medians that split hot keys over many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from triagelake.config import SCALE
from triagelake.functions.timewin import epoch_micros
from triagelake.session import cut_lineage


def totals_before(
    queries: DataFrame,
    events: DataFrame,
    keys: list[str],
    measures: list[str],
    at: str = "at_us",
    slice_seconds: float = SCALE.slice_seconds,
    slice_rows: int = SCALE.slice_rows,
    crowded: bool | None = None,
) -> DataFrame:
    """Sum each measure over the events of the same key strictly before the query.

    ``queries`` and ``events`` carry ``keys`` and ``at`` (microseconds). Time is cut into
    slices. Per (key, slice) sums are combined map-side and accumulated per key, one small
    row per slice; inside a slice a window sees only that slice. No task holds a whole
    key, so a key with a third of all rows is spread over its slices. A slice of a key with
    more than ``slice_rows`` rows is cut into slices a sixtieth as long, and so on down to
    one instant, whose rows see none of each other. ``crowded`` says whether there is such
    a slice; by default that is counted first.
    """
    slice_us = max(1, round(slice_seconds * 1000000))
    carried = [c for c in queries.columns if c not in keys + [at]]
    q = queries.select(
        *keys, at, F.struct(*[F.col(c) for c in carried]).alias("_row"),
        *[F.lit(0).cast("long").alias(m) for m in measures],
    )
    e = events.select(
        *keys, at, F.lit(None).cast(q.schema["_row"].dataType).alias("_row"),
        *[F.col(m).cast("long").alias(m) for m in measures],
    )
    name = f"_slice{slice_us}"
    both = q.unionByName(e).withColumn(name, F.expr(f"`{at}` - pmod(`{at}`, {slice_us})"))
    if crowded is None:
        crowded = has_crowded_slices(both, [*keys, name], slice_rows)
    if crowded:
        return _by_measured_slices(both, keys, measures, at, name, slice_us, slice_rows)
    return _by_slices(both, keys, measures, at, name)


def has_crowded_slices(rows: DataFrame, keys: list[str], slice_rows: int = SCALE.slice_rows) -> bool:
    return not rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > slice_rows).isEmpty()


def may_be_crowded(rows: DataFrame, key: str, at: str = "at_us", slice_rows: int = SCALE.slice_rows) -> bool:
    """Whether any slice of ``key``, and so of any finer key, can be crowded."""
    slice_us = SCALE.slice_seconds * 1000000
    return has_crowded_slices(rows.select(key, F.expr(f"`{at}` - pmod(`{at}`, {slice_us})").alias("_slice")), [key, "_slice"], slice_rows)


def _carry(both: DataFrame, keys: list[str], measures: list[str], name: str) -> DataFrame:
    """Totals of each key before each of its slices."""
    over_slices = Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    return (both.groupBy(*keys, name).agg(*[F.sum(m).alias(m) for m in measures])
            .select(*keys, name, *[F.coalesce(F.sum(m).over(over_slices), F.lit(0)).alias(f"_c_{m}") for m in measures]))


def _by_measured_slices(both: DataFrame, keys: list[str], measures: list[str], at: str, name: str, slice_us: int, slice_rows: int) -> DataFrame:
    """Crowded slices go on as keys of their own, in shorter slices; the others as usual."""
    both = cut_lineage(both)
    carry = cut_lineage(_carry(both, keys, measures, name))
    crowded = cut_lineage(both.groupBy(*keys, name).agg(F.count("*").alias("_n")).filter(F.col("_n") > slice_rows).select(*keys, name, F.lit(True).alias("_crowded")))
    marked = both.join(crowded, [*keys, name], "left")
    rest = marked.filter("_crowded IS NULL").drop("_crowded")
    dense = marked.filter("_crowded").drop("_crowded")
    done = _by_slices(rest, keys, measures, at, name, carry)
    finer = [*keys, name]
    if slice_us == 1:
        inside = dense.filter("_row IS NOT NULL").select(*finer, at, "_row.*", *[F.lit(0).cast("long").alias(m) for m in measures])
    else:
        inside = totals_before(dense.filter("_row IS NOT NULL").select(*finer, at, "_row.*"), dense.filter("_row IS NULL").select(*finer, at, *measures),
                               finer, measures, at, slice_us / 60_000_000, slice_rows)
    carried = [c for c in inside.columns if c not in (*finer, at, *measures)]
    return done.unionByName(inside.join(carry, finer).select(
        *keys, at, *carried, *[(F.col(m) + F.col(f"_c_{m}")).alias(m) for m in measures]))


def _by_slices(both: DataFrame, keys: list[str], measures: list[str], at: str, name: str, carry: DataFrame | None = None) -> DataFrame:
    carry = _carry(both, keys, measures, name) if carry is None else carry
    inside = Window.partitionBy(*keys, name).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    within = both.select(
        *keys, name, at, "_row", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(m) for m in measures]
    ).filter("_row IS NOT NULL")
    return within.join(carry, [*keys, name]).select(
        *keys, at, "_row.*", *[(F.col(m) + F.col(f"_c_{m}")).alias(m) for m in measures]
    )


def median_before(
    queries: DataFrame,
    events: DataFrame,
    keys: list[str],
    value: str,
    at: str = "at_us",
    window_rows: int = SCALE.median_window_rows,
    counted: str | None = None,
) -> DataFrame:
    """``queries`` with the exact median of ``value`` over the key's events strictly before each.

    Keys with few rows use an ordered window. A key with more rows goes through a descent
    over value ranges, where every step is a running total and no group is ever collected.
    ``counted`` names a column that has the number of those events with a value already.
    """
    events = events.filter(F.col(value).isNotNull()).select(*keys, at, F.col(value).cast("double").alias(value))
    if counted is None:
        queries = totals_before(queries, events.withColumn("_n", F.lit(1)), keys, ["_n"], at)
    else:
        queries = queries.withColumn("_n", F.col(counted).cast("long"))
    hot = events.groupBy(*keys).agg(F.count("*").alias("_size")).filter(F.col("_size") > window_rows)
    if hot.isEmpty():
        return _median_by_window(queries, events, keys, value, at)
    hot = hot.select(*keys, F.lit(True).alias("_hot"))
    e = events.join(hot, keys, "left")
    q = queries.join(hot, keys, "left")
    cold = _median_by_window(
        q.filter("_hot IS NULL").drop("_hot"), e.filter("_hot IS NULL").drop("_hot"), keys, value, at
    )
    return cold.unionByName(
        _median_by_descent(q.filter("_hot").drop("_hot"), e.filter("_hot").drop("_hot"), keys, value, at, window_rows)
    )


def _median_by_window(counted, events, keys, value, at) -> DataFrame:
    """Medians of each key's first 1, 2, ... events; a query takes the one of its number of earlier events.

    Only events are sorted per key, so a key with few events and very many queries is no group of its own.
    """
    in_order = Window.partitionBy(*keys).orderBy(at)
    prefix = events.select(
        *keys, F.row_number().over(in_order).cast("long").alias("_n"),
        F.percentile(F.col(value), F.lit(0.5)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("median"))
    return counted.join(prefix, [*keys, "_n"], "left").drop("_n")


def _median_by_descent(counted, events, keys, value, at, window_rows, fanout: int = 16) -> DataFrame:
    """Order statistics by narrowing a value range; each range is split at its quantiles."""
    carried = [c for c in counted.columns if c not in keys + [at, "_n"]]
    # Both middle ranks are searched separately; the median is their mean.
    seeking = counted.withColumn(
        "_rank", F.explode(F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1))
    ).withColumn("_side", F.monotonically_increasing_id())
    none_yet = seeking.filter("_n = 0").select(*keys, at, *carried, F.lit(None).cast("double").alias("_found")).distinct()
    seeking = cut_lineage(seeking.filter("_n > 0").withColumn("_node", F.lit("")))
    nodes = keys + ["_node"]
    ranged = events.withColumn("_node", F.lit(""))
    done = []
    while True:
        shape = cut_lineage(
            ranged.groupBy(*nodes).agg(
                F.count("*").alias("_size"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                F.percentile_approx(value, [i / fanout for i in range(1, fanout)], 10000).alias("_cuts"),
            )
        )
        # A range of one value is an answer; a short one is finished by an ordered window.
        asked = seeking.join(shape, nodes)
        done.append(asked.filter("_lo = _hi").select("_side", *keys, at, *carried, F.col("_lo").alias("_found")))
        short = (F.col("_size") <= window_rows) & (F.col("_lo") < F.col("_hi"))
        leaf_nodes = shape.filter(short).select(*nodes)
        leaf_queries = asked.filter(short).select("_side", "_rank", *nodes, at, *carried)
        done.append(_pick_in_window(leaf_queries, ranged.join(leaf_nodes, nodes), nodes, keys, carried, value, at))
        wide = shape.filter((F.col("_size") > window_rows) & (F.col("_lo") < F.col("_hi"))).select(*nodes, "_cuts", "_hi")
        if wide.isEmpty():
            break
        # The last cut below the maximum keeps every split proper even under heavy ties.
        cuts = F.array_distinct(F.transform("_cuts", lambda c: F.when(c < F.col("_hi"), c).otherwise(F.col("_prev"))))
        wide = wide.join(
            ranged.join(wide.select(*nodes, F.col("_hi").alias("_top")), nodes)
            .filter(F.col(value) < F.col("_top")).groupBy(*nodes).agg(F.max(value).alias("_prev")), nodes
        ).select(*nodes, cuts.alias("_cuts"))
        split = ranged.join(wide, nodes).withColumn(
            "_digit", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
        )
        steps = [f"_d{i}" for i in range(fanout)]
        counted = totals_before(
            seeking.join(wide.select(*nodes), nodes),
            split.select(*nodes, at, *[(F.col("_digit") <= i).cast("long").alias(s) for i, s in enumerate(steps)]),
            nodes, steps, at,
        )
        digit = reduce(lambda acc, i: F.when(F.col(steps[i]) >= F.col("_rank"), i).otherwise(acc),
                       reversed(range(fanout)), F.lit(fanout))
        below = reduce(lambda acc, i: F.when(F.col("_digit") == i, F.col(steps[i - 1])).otherwise(acc),
                       range(1, fanout), F.lit(0))
        child = F.concat_ws(".", F.col("_node"), F.col("_digit").cast("string"))
        seeking = cut_lineage(
            counted.withColumn("_digit", digit).withColumn("_rank", F.col("_rank") - below)
            .withColumn("_node", child).select("_side", "_rank", "_n", *nodes, at, *carried)
        )
        ranged = cut_lineage(split.withColumn("_node", child).select(*nodes, at, value))
    found = reduce(DataFrame.unionByName, done).drop("_side").unionByName(none_yet)
    return found.groupBy(*keys, at, *carried).agg(F.avg("_found").alias("median"))


def _pick_in_window(queries, events, nodes, keys, carried, value, at) -> DataFrame:
    extra = ["_side", "_rank"] + carried
    q = queries.select(*nodes, at, F.struct(*extra).alias("_row"), F.lit(None).cast("double").alias(value))
    e = events.select(*nodes, at, F.lit(None).cast(q.schema["_row"].dataType).alias("_row"), value)
    before = Window.partitionBy(*nodes).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return (
        q.unionByName(e)
        .withColumn("_seen", F.when(F.col("_row").isNotNull(), F.array_sort(F.collect_list(value).over(before))))
        .filter("_row IS NOT NULL")
        .select("_row._side", *keys, at, *[f"_row.{c}" for c in carried],
                F.element_at("_seen", F.col("_row._rank").cast("int")).alias("_found"))
    )


def with_micros(df: DataFrame, ts: str = "created_at") -> DataFrame:
    return df.withColumn("at_us", epoch_micros(F.col(ts)))
