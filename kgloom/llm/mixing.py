"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .names import free
from .scratch import Scratch

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A source's documents fall into so many buckets of the seeded order.
BUCKETS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: tuple[int, int], epochs: int) -> DataFrame:
    """sizes(source, source_size) with each source's weight and target.

    Sources in code point order, null last, take the weights in turn. budget is a fraction
    (numerator, denominator) of all sizes. Where a share would pass epochs times the source's
    size, the source is clamped there and the rest shared anew among the others by weight, until
    none passes. Sources clamp in the order of cap / weight, so running sums over that order give
    the result of those rounds at once. One row a source, so the two running sums are small.
    """
    up, down = budget
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    t = (
        ranked.withColumns({"weight": w.cast("long"), "cap": F.col("source_size") * epochs})
        .withColumns(
            {
                "clamped": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
                "open": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
                "total": F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
            }
        )
        # what is left for the sources from here on, times down
        .withColumn("rest", F.col("total") * up - F.col("clamped") * down)
        .withColumn("fits", big("cap") * big("open") * down >= big("rest") * big("weight"))
    )
    level = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, 0)
    first = F.min(F.when(F.col("fits"), F.struct("rank_by", "rest", "open"))).over(level)
    t = t.withColumn("rank_by", F.row_number().over(order)).withColumn("first", first)
    return t.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("first").isNull(), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * F.col("first.rest")).cast("double") / (F.col("first.open") * down).cast("double"))
        .alias("target"),
    )


def _at(key: str, seed: int) -> Column:
    """The place of a row in its source's seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _bucket(at: Column) -> Column:
    return (F.conv(F.substring(at, 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def plan_mix(
    rows: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: tuple[int, ...] = (5, 2, 1),
    budget: tuple[int, int] = (3, 2),
    epochs: int = 2,
    seed: int = 42,
) -> DataFrame:
    """One row a source: (source, source_size, target, whole, cut, need).

    Every row of the source is taken `whole` times, those in buckets before `cut` once more, and
    those of bucket `cut` until `need` more words are taken. A null source is a source, a null key an
    empty one; rows may repeat; null sizes count nothing; columns but key, source and size, whatever
    their names, are ignored; an empty table gives no rows.
    """
    buckets = rows.groupBy(F.col(source).alias("source"), _bucket(_at(key, seed)).alias("bucket")).agg(F.sum(size).alias("bucket_size"))
    sources = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, budget, epochs)
    words = F.round("target").cast("long")
    sources = sources.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("missing", words - F.col("whole") * F.col("source_size"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    left = F.col("missing") - F.col("before")
    return (
        placed.alias("b")
        .join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        .groupBy(F.col("s.source").alias("source"), "source_size", "target", "whole")
        .agg(F.max(F.when(left > 0, F.struct("bucket", left.alias("need")))).alias("last"))
        .select("source", "source_size", "target", "whole", F.coalesce("last.bucket", F.lit(-1)).alias("cut"), F.coalesce("last.need", F.lit(0)).alias("need"))
    )


def apply_mix(df: DataFrame, plan: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", seed: int = 42) -> DataFrame:
    """df with source_size, target, whole and extra; rows stay where they are, but for the cut buckets'.

    plan is plan_mix()'s. Columns of df with those four names are replaced, all others stay whatever
    their names. Null sources, null and repeated keys are taken as in mix(); rows of a source that
    the plan lacks are left out; an empty table gives no rows.
    """
    at, bucket, of, cut, need, *made = free(df, "at", "bucket", "of", "cut", "need", "source_size", "target", "whole", "extra")
    p = plan.select(F.col("source").alias(of), F.col("source_size").alias(made[0]), F.col("target").alias(made[1]), F.col("whole").alias(made[2]), F.col("cut").alias(cut), F.col("need").alias(need))
    dealt = df.withColumn(at, _at(key, seed)).withColumn(bucket, _bucket(F.col(at))).join(p, F.col(source).eqNullSafe(F.col(of)))
    clear = dealt.where(F.col(bucket) != F.col(cut)).withColumn(made[3], F.when(F.col(bucket) < F.col(cut), F.col(size)).otherwise(0).cast("long"))
    inside = W.partitionBy(of).orderBy(at, key, size).rowsBetween(W.unboundedPreceding, -1)
    left = F.col(need) - F.coalesce(F.sum(size).over(inside), F.lit(0))
    edge = dealt.where(F.col(bucket) == F.col(cut)).withColumn(made[3], F.greatest(F.lit(0), F.least(F.col(size), left)).cast("long"))
    names = ("source_size", "target", "whole", "extra")
    own = [F.col(c) for c in df.columns if c.lower() not in names]
    return clear.unionByName(edge).select(*own, *(F.col(c).alias(n) for c, n in zip(made, names)))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """How often the mix takes each row: (key, source, size, source_size, target, whole, extra, taken).

    Each row of a source is taken `whole` times in full. What the target then lacks is filled from
    the source's rows in a seeded order, one further repetition each; the row on the edge gives
    only the words still missing (extra), so each source's taken words are its target, rounded.
    The order is by digest of seed and key: the same rows give the same mix on any cluster.
    how: weights, budget, epochs and seed, as in plan_mix().

    Null texts have size 0; a null source is a source; null keys sort as empty ones; rows with the
    same key are ordered by size. Other columns, whatever their names, are ignored, and so are the
    names of key and source. An empty table gives no rows. Sizes are summed by bucket of the
    seeded order, and only one bucket of each source is ever ordered row by row, so a source with
    most rows fills no task.
    """
    scratch = Scratch(df.sparkSession, "mix")
    rows = scratch.save(df.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "sizes")
    plan = scratch.save(plan_mix(rows, "key", "source", "size", **how), "plan")
    mixed = apply_mix(rows, plan, "key", "source", "size", how.get("seed", 42))
    made = ("size", "source_size", "target", "whole", "extra")
    return mixed.select(F.col("key").alias(key), F.col("source").alias(source), *made, (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mix_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """df with each row as often as the mix takes it; the row on the edge counts as whole from half on.

    Nulls, long texts, ties and repeated rows as in mix(); rows without words are never taken more
    often than their source is whole. All columns of df stay, whatever their names, and none is
    added. An empty table gives an empty table. Beyond the plan, rows move only within cut buckets.
    """
    scratch = Scratch(df.sparkSession, "mix")
    sized = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row"), F.col(key).alias("_key"), F.col(source).alias("_of"), n_words(F.col(text)).alias("_size"))
    plan = scratch.save(plan_mix(sized, "_key", "_of", "_size", **how), "plan")
    mixed = apply_mix(sized, plan, "_key", "_of", "_size", how.get("seed", 42))
    more = (F.col("extra") > 0) & (F.col("extra") * 2 >= F.col("_size"))
    times = F.array_repeat(F.lit(1), (F.col("whole") + more.cast("long")).cast("int"))
    return mixed.select("row", F.explode(times).alias("_copy")).select("row.*")
