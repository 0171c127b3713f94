"""Ordered series without a global window: each range of the order is one bucket, and what it needs of the others is small.

The order column holds integers; a bucket covers RANGE of them. What crosses buckets is a row a
bucket, so that the only unpartitioned window runs over 1 in RANGE of a dense series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column in a bucket.
RANGE = 4096


def _bucketed(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(order) / RANGE))


def _group(by: tuple[str, ...]) -> Column:
    """One string per group, null values told apart."""
    return F.concat_ws("\x1f", F.lit(""), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by])


def running_total(df: DataFrame, order: str, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `out`: the sum of value over all rows of its group up to and with this one, by a unique order."""
    d = _bucketed(df, order).withColumn("_group", _group(by))
    totals = d.groupBy("_group", "_bucket").agg(F.sum(value).alias("_t"))
    span = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = totals.select("_group", "_bucket", (F.sum("_t").over(span) - F.col("_t")).alias("_before"))
    local = F.sum(value).over(Window.partitionBy("_group", "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_local", local).join(before, ["_group", "_bucket"]).withColumn(out, F.col("_local") + F.col("_before")).drop("_group", "_bucket", "_local", "_before")


def with_previous(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with `previous`: value of the row before, by a unique order; null in the first."""
    d = _bucketed(df, order)
    ends = d.groupBy("_bucket").agg(F.max_by(value, order).alias("_last"))
    carried = ends.select("_bucket", F.lag("_last").over(Window.orderBy("_bucket")).alias("_carried"))
    w = Window.partitionBy("_bucket").orderBy(order)
    d = d.withColumn("_rn", F.row_number().over(w)).withColumn("_lag", F.lag(value).over(w)).join(carried, "_bucket")
    return d.withColumn("previous", F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_lag"))).drop("_bucket", "_rn", "_lag", "_carried")


def with_trailing(df: DataFrame, order: str, value: str, rows: int) -> DataFrame:
    """df with `trail`: the values of up to `rows` rows before this one, the window of each bucket filled up from those before it."""
    d = _bucketed(df, order)
    last = d.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy(F.desc(order)))).filter(F.col("_rn") <= rows)
    last = last.groupBy("_bucket").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_tail"))
    w = Window.orderBy("_bucket").rowsBetween(-rows, -1)  # sparse buckets may hold a row each
    tails = last.select("_bucket", F.transform(F.flatten(F.collect_list("_tail").over(w)), lambda x: x["v"]).alias("_before"))
    own = F.collect_list(value).over(Window.partitionBy("_bucket").orderBy(order).rowsBetween(-rows, -1))
    joined = d.withColumn("_own", own).join(tails, "_bucket", "left")
    both = F.concat(F.coalesce("_before", F.expr("array()").cast(joined.schema["_own"].dataType)), F.col("_own"))
    trail = F.slice(both, F.greatest(F.size(both) - rows, F.lit(0)) + 1, F.lit(rows))
    return joined.withColumn("trail", trail).drop("_bucket", "_own", "_before")


def median(values: Column) -> Column:
    """Median of an array as a double, the mean of the middle two where their number is even."""
    s = F.array_sort(values)
    n = F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low.cast("double") + high.cast("double")) / 2


def as_of(left: DataFrame, right: DataFrame, at: str, on: str, value: str, forward: bool = False) -> DataFrame:
    """left with (found, value): the greatest right.on not above left.at, or with `forward` the least not below it; rows without one go.

    Both sides meet in buckets of the order; a bucket without an answer of its own takes its
    neighbour's, which is carried over as one row a bucket.
    """
    pick = F.min if forward else F.max
    asked, given = _bucketed(left, at), _bucketed(right.select(F.col(on).alias("_on"), F.col(value).alias("_v")), "_on")
    edge = given.groupBy("_bucket").agg(pick(F.struct("_on", "_v")).alias("_edge"))
    all_buckets = asked.select("_bucket").distinct().unionByName(edge.select("_bucket")).distinct().join(edge, "_bucket", "left")
    w = Window.orderBy("_bucket").rowsBetween(*((1, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -1)))
    carried = all_buckets.select("_bucket", pick("_edge").over(w).alias("_carried"))
    # In a bucket, asked places and given values stand in one order; a given value counts for its equals.
    names = [F.col(c) for c in left.columns]
    rows = asked.select("_bucket", F.col(at).alias("_at"), F.struct(*names).alias("_row"), F.lit(None).cast("struct<_on:bigint,_v:bigint>").alias("_given"))
    rows = rows.unionByName(given.select("_bucket", F.col("_on").alias("_at"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.struct(F.col("_on").cast("long").alias("_on"), F.col("_v").cast("long").alias("_v")).alias("_given")))
    first = F.col("_given").isNull().cast("int")  # given rows stand before asked ones of the same place
    span = Window.partitionBy("_bucket").orderBy(*((F.desc("_at"), first) if forward else (F.col("_at"), first))).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_near", F.last("_given", ignorenulls=True).over(span)).filter("_row is not null").join(carried, "_bucket", "left")
    best = F.coalesce(F.col("_near"), F.col("_carried").cast("struct<_on:bigint,_v:bigint>"))
    return near.withColumn("_best", best).filter("_best is not null").select("_row.*", F.col("_best._on").alias("found"), F.col("_best._v").alias("value"))
