"""Ranks and running extremes over a whole table without sending it through one task.

A global window would order all rows in one partition. Here rows fall into value buckets; ranks
and running extremes are taken within a bucket and completed with the totals of the buckets
before or after it, a table of at most BUCKETS rows for each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def _bucket(p: Column) -> Column:
    """Bucket of a p-value: even over (0, 1), finer where small values crowd."""
    fine = F.when(p <= 0, 0).when(p < 1 / 64, F.greatest(F.lit(0), 256 + F.floor(F.log2(p) * 4)))
    return F.coalesce(fine, 256 + F.least(F.floor(p * (BUCKETS - 256)), F.lit(BUCKETS - 257))).cast("int")


def with_rank(df: DataFrame, p: str, ties: list[str], groups: list[str] | None = None) -> DataFrame:
    """``df`` with i (rank of p within its group, ties broken by ``ties``), m (group size) and bucket."""
    groups = groups or []
    rows = df.withColumn("bucket", _bucket(F.col(p)))
    totals = rows.groupBy(*groups, "bucket").agg(F.count("*").alias("here"))
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0))).withColumn("m", F.sum("here").over(whole)).drop("here")
    local = F.row_number().over(Window.partitionBy(*groups, "bucket").orderBy(p, *ties))
    return rows.withColumn("at", local).join(totals, [*groups, "bucket"]).withColumn("i", F.col("at") + F.col("before")).drop("at", "before")


def running(df: DataFrame, value: str, out: str, ties: list[str], groups: list[str] | None = None, down: bool = False) -> DataFrame:
    """Running maximum of ``value`` by rank, or with ``down`` running minimum from the last rank; needs `with_rank`."""
    groups = groups or []
    extreme = F.min if down else F.max
    order = [F.col("i").desc() if down else F.col("i")]
    local = extreme(value).over(Window.partitionBy(*groups, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = df.groupBy(*groups, "bucket").agg(extreme(value).alias("end"))
    earlier = Window.partitionBy(*groups).orderBy(F.col("bucket").desc() if down else F.col("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", extreme("end").over(earlier)).drop("end")
    rows = df.withColumn("__local", local).join(ends, [*groups, "bucket"])
    both = (F.least if down else F.greatest)("__local", "carried")
    return rows.withColumn(out, both).drop("__local", "carried")


def spread(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with a column in (0, 1) that rises strictly with ``value``, spread by the value's approximate quantiles; null where it is null.

    Ranks by `with_rank` on it are ranks of the value, and its buckets hold about as many rows each.
    """
    edges = sorted(set(df.approxQuantile(value, [k / 64 for k in range(65)], 0.005)))
    if len(edges) < 2:
        return df.withColumn(out, F.when(F.col(value).isNotNull(), 0.5))
    v = F.col(value)
    step = 1 / (len(edges) + 1)
    placed = F.when(v < edges[0], step * F.exp(F.greatest(v - edges[0], F.lit(-700.0))))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        placed = placed.when(v < b, step * (k + 1 + (v - a) / (b - a)))
    return df.withColumn(out, F.when(v.isNotNull(), placed.otherwise(1 - step * F.exp(F.greatest(edges[-1] - v, F.lit(-700.0))) * 0.999)))


def whole_average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the rank of ``value`` over the whole table, ties averaged, and no window over it."""
    counts = spread(df.groupBy(value).agg(F.count("*").alias("__here")), value, "__u").withColumn("__bucket", F.floor(F.col("__u") * BUCKETS))
    totals = counts.groupBy("__bucket").agg(F.sum("__here").alias("__all"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # over BUCKETS rows at most
    totals = totals.withColumn("__before", F.coalesce(F.sum("__all").over(earlier), F.lit(0)))
    local = F.coalesce(F.sum("__here").over(Window.partitionBy("__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("__local", local).join(totals, "__bucket")
    ranks = ranks.select(F.col(value).alias("__value"), (F.col("__before") + F.col("__local") + (F.col("__here") + 1) / 2).alias(out))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("__value"))).drop("__value")


def running_sums(df: DataFrame, order: str, ties: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums over the whole table in rising order (a row's own value included): {column: name of its sum}; no window over the table."""
    rows = spread(df, order, "__u").withColumn("__bucket", F.floor(F.col("__u") * BUCKETS))
    totals = rows.groupBy("__bucket").agg(*(F.sum(c).alias(f"__all_{k}") for k, c in enumerate(sums)))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # over BUCKETS rows at most
    totals = totals.select("__bucket", *(F.coalesce(F.sum(f"__all_{k}").over(earlier), F.lit(0)).alias(f"__before_{k}") for k in range(len(sums))))
    local = Window.partitionBy("__bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(c).over(local).alias(f"__local_{k}") for k, c in enumerate(sums))).join(totals, "__bucket")
    own = [F.col(c) for c in df.columns]
    return rows.select(*own, *((F.col(f"__local_{k}") + F.col(f"__before_{k}")).alias(name) for k, name in enumerate(sums.values())))
