"""Places and running totals over a global order: ranges first, then the ranges' own totals.

A window over few groups would sort each group in one task. Here rows are dealt into ranges of the
order, each is summed by itself, and what stands before a range comes from one row for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import Scratch

RANGE = "_range"


def ranged(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """df, written in ranges of (by, order), with the number of each row's range.

    Written once, so that every later reading finds the same ranges. Rows that agree in by and order
    stand in one range.
    """
    dealt = df.repartitionByRange(*(F.col(b) for b in by), *order).withColumn(RANGE, F.spark_partition_id())
    return Scratch(df.sparkSession, "ranges").save(dealt, "ranged")


def running(df: DataFrame, by: list[str], order: list[Column | str], f: Callable, own: dict[str, Column | str], inclusive: bool = True, reverse: bool = False) -> DataFrame:
    """ranged() rows with f (sum, max or min) of each own column over all rows of `by` up to the row.

    reverse: from the row on instead. Without inclusive the row itself does not count; the value is
    null where there is nothing to count. order must be that of ranged(), and tell rows apart.
    """
    marked = df.withColumns({f"_of_{n}": F.col(c) if isinstance(c, str) else c for n, c in own.items()})
    totals = marked.groupBy(*by, RANGE).agg(*(f(f"_of_{n}").alias(f"_all_{n}") for n in own))
    over = W.partitionBy(*by).orderBy(F.col(RANGE).desc() if reverse else F.col(RANGE)).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*by, RANGE, *(f(f"_all_{n}").over(over).alias(f"_before_{n}") for n in own))  # one row a range
    keys = [k.alias(f"_k{i}") for i, k in enumerate([*(F.col(b) for b in by), F.col(RANGE)])]
    before = before.select(*keys, *(f"_before_{n}" for n in own))
    fit = F.lit(True)
    for i, k in enumerate([*by, RANGE]):
        fit = fit & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = W.partitionBy(*by, RANGE).orderBy(*order)
    inside = inside.rowsBetween(0 if inclusive else 1, W.unboundedFollowing) if reverse else inside.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    joined = marked.join(F.broadcast(before) if not by else before, fit)  # without by: one row for each range

    def both(n: str) -> Column:
        here, earlier = f(f"_of_{n}").over(inside), F.col(f"_before_{n}")
        one = {"max": F.greatest, "min": F.least}.get(f.__name__)
        whole = one(here, earlier) if one else here + earlier
        return F.coalesce(whole, here, earlier)

    return joined.select(*df.columns, *(both(n).alias(n) for n in own))


def places(df: DataFrame, by: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """df with each row's place, from 1 on, in the order within `by`; order must tell rows apart."""
    return running(ranged(df, by, order), by, order, F.sum, {name: F.lit(1)}).drop(RANGE)


def higher_in_order(asks: DataFrame, scored: DataFrame, by: list[str], own: str, score: str, key: str, weight: Column | None = None) -> DataFrame:
    """(key, _n): how many rows of scored(by, score), each counted `weight` times, of the asking row's group score higher than its own.

    Both stand in one order, asking rows before the rows of an equal score; NaN is lowest.
    """
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(float("-inf"))).alias("_v")
    asked = asks.where(F.col(own).isNotNull()).select(*by, clean(own), F.lit(0).cast("long").alias("_t"), F.col(key).cast("long").alias("_k"))
    there = scored.where(F.col(score).isNotNull()).select(*by, clean(score), (F.lit(1) if weight is None else weight).cast("long").alias("_t"), F.monotonically_increasing_id().alias("_k"))
    both, order = asked.unionAll(there), [F.desc("_v"), "_t", "_k"]
    return running(ranged(both, by, order), by, order, F.sum, {"_n": F.col("_t")}).where("_t = 0").select(F.col("_k").alias(key), F.col("_n").cast("long").alias("_n"))
