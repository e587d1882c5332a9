"""Deduplication and merging by key, always with an explicit order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*(F.col(c) for c in rest))
    place = F.struct(*(F.col(o).alias(f"o{k}") if isinstance(o, str) else o.alias(f"o{k}") for k, o in enumerate(order)))
    kept = df.groupBy(*keys).agg(F.min_by(row, place).alias("_row"))
    return kept.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(df.columns)


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (U9, U11, and id-keyed lists whose last entry wins)."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(df.columns)


def label_conflicts(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """(key, label, n_conflicts): the last label, and how often a label differs from the one before."""
    before = F.lag(label).over(W.partitionBy(key).orderBy(order))
    return (
        df.withColumn("_changed", (F.col(label) != before).cast("int"))
        .groupBy(key)
        .agg(F.max_by(label, order).alias(label), F.coalesce(F.sum("_changed"), F.lit(0)).alias("n_conflicts"))
    )


def fold_values(df: DataFrame, keys: list[str], name: str, value: str, order: str) -> DataFrame:
    """(keys, name, values): each field's distinct values in the order of their first arrival.

    Only first arrivals are gathered, so copies don't grow what one key gathers.
    """
    once = df.where(F.col(value).isNotNull()).groupBy(*keys, name, value).agg(F.min(order).alias("_at"))
    entry = F.struct(F.col("_at"), F.col(value).alias("_v"))
    return (
        once.groupBy(*keys, name)
        .agg(F.sort_array(F.collect_list(entry)).alias("_all"))
        .select(*keys, name, F.transform("_all", lambda x: x["_v"]).alias("values"))
    )


def scalar_or_list(values: Column) -> Column:
    """JSON text of a folded field: the value itself where there is one, else a list."""
    texts = F.to_json(F.transform(values, lambda v: v.cast("string")))
    return F.when(F.size(values) == 1, texts.substr(F.lit(2), F.length(texts) - 2)).otherwise(texts)


def merge_nodes(df: DataFrame, order: str = "ord") -> DataFrame:
    """One row a node: type and label of its first arrival, first sequence that is not blank,
    arrivals beyond the first, and whether types disagree (U1)."""
    real = F.when(F.length(F.coalesce("sequence", F.lit(""))) > 0, F.col("sequence"))
    return df.groupBy("node_id").agg(
        F.min_by("node_type", order).alias("node_type"),
        F.min_by("label", order).alias("label"),
        F.min_by(real, F.when(real.isNotNull(), F.col(order))).alias("sequence"),
        (F.count("*") - 1).alias("n_duplicates"),
        (F.min("node_type") != F.max("node_type")).alias("type_conflict"),
    )


def merge_edges(df: DataFrame) -> DataFrame:
    """One row an edge (source, target, relation) and its arrivals beyond the first."""
    return df.groupBy("source_id", "target_id", "relation").agg((F.count("*") - 1).alias("n_duplicates"))


def undirected(df: DataFrame, a: list[str], b: list[str], order: list[str]) -> DataFrame:
    """The first of each unordered pair of (a…), (b…)."""
    left, right = F.struct(*(F.col(c).alias(f"k{n}") for n, c in enumerate(a))), F.struct(*(F.col(c).alias(f"k{n}") for n, c in enumerate(b)))
    keyed = df.withColumns({"_lo": F.least(left, right), "_hi": F.greatest(left, right)})
    return first_by(keyed, ["_lo", "_hi"], order).drop("_lo", "_hi")


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and the rows beyond the first."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("n_extra")).where("n_extra > 0")
