"""Running values along a key, without one task per key.

A key's rows are cut into slices of their order; what the slices before amount to comes in as one row in
front of each slice. So a device with all of history is spread over many tasks, and only a row per
slice of it meets in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01'"


def _number(rows: DataFrame, name: str) -> Column:
    kind = rows.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col(name))
    return F.unix_micros(name) if kind == "timestamp" else F.col(name).cast("double")


def cuts_below(cuts: list, x: Column, step: int = 100) -> Column:
    """How many of the ascending cuts lie below x, 0 for null: every hundredth cut first, then a hundred of them."""
    if not cuts:
        return F.lit(0)
    below = lambda points: F.size(F.filter(points, lambda c: c < x))
    every = F.array(*[c if isinstance(c, Column) else F.lit(c) for c in cuts])
    if len(cuts) <= step:
        return F.coalesce(below(every), F.lit(0))
    coarse = below(F.array(*[c if isinstance(c, Column) else F.lit(c) for c in cuts[step - 1 :: step]])) * step
    return F.coalesce(coarse + below(F.slice(every, coarse + 1, step)), F.lit(0))


def slice_of(rows: DataFrame, name: str, slices: int | None = None) -> Column:
    """The slice of each row: a number or time column cut at quantiles into about equal row counts; null is slice 0."""
    n = slices or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = _number(rows, name)
    at = [i / n for i in range(1, n)]
    cuts = sorted(set(rows.agg(F.percentile_approx(x, F.array(*map(F.lit, at)), F.lit(max(10_000, 20 * n))).alias("q")).first()["q"] or [])) if at else []
    return cuts_below(cuts, x)


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column, bool]], slices: int | None = None) -> DataFrame:
    """rows with a column for each of `values`: name: (kind, column, before).

    kind: `sum`, `max` or `last` (the last one that isn't null); before: without the row's own. Nothing so far
    is null. order must settle the order of a key's rows; its first column is a number or a time. A
    wrapped value (`F.struct(..)`) makes `last` take nulls as values. Null keys are keys."""
    place = slice_of(rows, order[0], slices)
    names = rows.columns
    dealt = rows.withColumns({"__slice": place, "__own": F.lit(1), **{f"__v_{k}": v for k, (_, v, _) in values.items()}})
    when = F.struct(*order)
    whole = {"sum": lambda v: F.sum(v), "max": lambda v: F.max(v), "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), when))}
    sums = dealt.groupBy(*keys, "__slice").agg(*[whole[kind](f"__v_{k}").alias(f"__v_{k}") for k, (kind, _, _) in values.items()])
    along = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    came = sums.select(*keys, "__slice", F.lit(0).alias("__own"), *[along[kind](f"__v_{k}").over(earlier).alias(f"__v_{k}") for k, (kind, _, _) in values.items()])
    line = Window.partitionBy(*keys, "__slice").orderBy("__own", *order)
    got = dealt.unionByName(came, allowMissingColumns=True).withColumns(
        {k: along[kind](f"__v_{k}").over(line.rowsBetween(Window.unboundedPreceding, -1 if before else 0)) for k, (kind, _, before) in values.items()})
    return got.filter("__own = 1").select(*[c for c in names if c not in values], *values)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, slices: int | None = None) -> DataFrame:
    """rows with their number in their key's order, from 1: row_number() without one task per key.

    A few keys with many slices each (256 at least) deal evenly over any number of tasks."""
    n = slices or max(256, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return running(rows, keys, order, {name: ("sum", F.lit(1).cast("long"), False)}, n)
