"""Aggregates: profiles, pivots, fractions, expression scores and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch


def relation_entropy(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(entropy): natural-log entropy of the counts by keys."""
    counts = edges.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(p * F.log(p)), F.lit(0.0)).alias("entropy"))  # one row


def expression_profile(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, fraction, n): mean, share above zero and count; groups of only zeros left out."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("fraction"), F.count("*").alias("n"))
    return out.where("fraction > 0")


def pivot_max(df: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    """One row a key, one column for each of the given values, the largest value or 0."""
    return df.groupBy(row).pivot(column, values).agg(F.max(value)).fillna(0)


def dominant(df: DataFrame, key: str, kind: str, allowed: list[str] | None = None) -> DataFrame:
    """(key, kind): the most frequent kind of each key, the lowest of equal ones; unknown if not allowed."""
    counts = df.groupBy(key, kind).agg(F.count("*").alias("_n"))
    best = counts.groupBy(key).agg(F.min_by(kind, F.struct(-F.col("_n"), F.col(kind))).alias(kind))
    return best.withColumn(kind, F.when(F.col(kind).isin(allowed), F.col(kind)).otherwise("unknown")) if allowed else best


def class_fraction(df: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, kind, n, fraction): share of each class within its key."""
    counts = df.groupBy(key, kind).agg(F.count("*").alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("_t"))
    return counts.join(total, key).withColumn("fraction", F.col("n") / F.col("_t")).drop("_t")


def single_class(df: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, kind) of keys with exactly one class."""
    return df.groupBy(key).agg(F.min(kind).alias("_a"), F.max(kind).alias("_b")).where("_a = _b").select(key, F.col("_a").alias(kind))


def idf(df: DataFrame, key: str, feature: str) -> DataFrame:
    """(feature, idf): log of all keys over those with the feature."""
    pairs = df.select(key, feature).distinct()
    n = pairs.agg(F.countDistinct(key).alias("_n"))
    return pairs.groupBy(feature).agg(F.count("*").alias("_c")).crossJoin(F.broadcast(n)).select(feature, F.log(F.col("_n") / F.col("_c")).alias("idf"))  # one row


def tf_idf(df: DataFrame, key: str, feature: str) -> DataFrame:
    """(key, feature, weight): counts times idf, of length one for each key."""
    w = df.groupBy(key, feature).agg(F.count("*").alias("_tf")).join(idf(df, key, feature), feature).withColumn("_w", F.col("_tf") * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") ** 2)).alias("_l"))
    return w.join(norm, key).select(key, feature, F.when(F.col("_l") > 0, F.col("_w") / F.col("_l")).otherwise(0.0).alias("weight"))


def profile_scores(queries: DataFrame, profiles: DataFrame, feature: str) -> DataFrame:
    """(query, item, score): inner products of sparse profiles query(query, feature, weight) and item.

    Where most pairs share several features, blocks of profiles meet, and a pair is no row before its sum;
    else rows are joined by feature. Weights that are integers on both sides are always joined.
    """
    from .blocks import profile_pairs

    q = queries.select("query", feature, F.col("weight").alias("_a"))
    kinds = {profiles.schema["weight"].dataType.typeName(), queries.schema["weight"].dataType.typeName()}
    if "double" in kinds and kinds <= {"double", "float", "byte", "short", "integer", "long"}:
        side = lambda df, key: df.where(F.col(key).isNotNull() & F.col(feature).isNotNull()).select(F.col(key).alias("key"), F.col(feature).alias("feature"), F.col("weight").cast("double").alias("value")).groupBy("key", "feature").agg(F.sum("value").alias("value"))
        scratch = Scratch(queries.sparkSession, "profiles")
        lone = queries.where(F.col("query").isNull()).select(F.lit(1)).unionAll(profiles.where(F.col("item").isNull()).select(F.lit(1)))
        left, right = scratch.save(side(queries, "query"), "queries"), scratch.save(side(profiles, "item"), "items")
        pairs = profile_pairs(left, right) if lone.isEmpty() else None  # keys may be null in a join by feature
        if pairs is not None:
            return pairs.select(F.col("p").alias("query"), F.col("q").alias("item"), "score")
    return q.join(profiles.select("item", feature, "weight"), feature).groupBy("query", "item").agg(F.sum(F.col("_a") * F.col("weight")).alias("score"))


def additive_scores(expression: DataFrame, items: DataFrame) -> DataFrame:
    """(cell_type, item, score): sum of log1p expression over the genes of an item.

    expression(cell_type, gene, value), items(gene, item).
    """
    return expression.join(items, "gene").groupBy("cell_type", "item").agg(F.sum(F.log1p("value")).alias("score"))


def tissue_weighted(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(query, item, score): scores of cell types by the query's tissue weights, the plain mean without weights.

    scores(cell_type, item, score), weights(query, cell_type, weight).
    """
    joined = weights.join(scores, "cell_type").groupBy("query", "item").agg(F.sum(F.col("weight") * F.col("score")).alias("_s"), F.sum("weight").alias("_w"), F.avg("score").alias("_m"))
    return joined.select("query", "item", F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(F.col("_m")).alias("score"))


def normalized_expression(df: DataFrame, by: str, value: str) -> DataFrame:
    """df with the value over the largest of its group."""
    top = df.groupBy(by).agg(F.max(value).alias("_top"))
    return df.join(top, by).withColumn(value, F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(0.0)).drop("_top")


def sets_by(df: DataFrame, key: str, item: str, name: str = "items") -> DataFrame:
    """(key, items): the distinct items of each key, sorted."""
    return df.select(key, item).distinct().groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(name))


def multi_hot(sets: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """sets with `multi_hot`: 1 for each class in the set, in the given order."""
    return sets.withColumn("multi_hot", F.array(*(F.array_contains(column, c).cast("int") for c in classes)))


def readiness(df: DataFrame, by: list[str], label: str, ready: int) -> DataFrame:
    """(by, n, status): READY from `ready` labelled rows on, PARTIAL with some, BLOCKED with none."""
    out = df.groupBy(*by).agg(F.count(label).alias("n"))
    return out.withColumn("status", F.when(F.col("n") >= ready, "READY").when(F.col("n") > 0, "PARTIAL").otherwise("BLOCKED"))


def coverage(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """(n, covered, percent): distinct keys, and those that occur among known ones."""
    ids = df.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    hit = known.select(F.col(known_key).alias("_k"), F.lit(1).alias("_hit")).distinct()
    return ids.join(hit, "_k", "left").agg(F.count("*").alias("n"), F.count("_hit").alias("covered")).withColumn("percent", F.round(F.when(F.col("n") > 0, F.col("covered") * 100 / F.col("n")).otherwise(0.0), 2))


def over_seeds(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: mean and sample deviation of each metric over runs, deviation 0 for one run."""
    return df.agg(*(f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))))


def grade(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """df(metric, value) with `grade` good, normal or low by thresholds(metric, good, low, lower_better)."""
    t = df.join(thresholds, "metric", "left")
    v = F.when(F.col("lower_better"), -F.col("value")).otherwise(F.col("value"))
    g, lo = (F.when(F.col("lower_better"), -F.col(c)).otherwise(F.col(c)) for c in ("good", "low"))
    return t.withColumn("grade", F.when(v >= g, "good").when(v >= lo, "normal").when(F.col("good").isNotNull(), "low")).drop("good", "low", "lower_better")


def comparison(df: DataFrame, experiments: list[str]) -> DataFrame:
    """One row a metric, one column an experiment."""
    return df.groupBy("metric").pivot("experiment", experiments).agg(F.first("value"))


def scatter_softmax(df: DataFrame, group: str, score: str) -> DataFrame:
    """df with `softmax` of the score within its group (A27), by two aggregates and joins: groups may be large."""
    top = df.groupBy(group).agg(F.max(score).alias("_m"))
    e = df.join(top, group).withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    total = e.groupBy(group).agg(F.sum("_e").alias("_t"))
    return e.join(total, group).withColumn("softmax", F.col("_e") / F.col("_t")).drop("_m", "_e", "_t")


def neighbour_features(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(target_id, sum, mean, max, std) of source values over incoming edges."""
    joined = edges.join(values.withColumnRenamed("node_id", "source_id"), "source_id")
    return joined.groupBy("target_id").agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"))


def site_statistics(df: DataFrame, protein: str, position: str, item: str, kind: str, known: DataFrame) -> DataFrame:
    """(measure, name, n, percent): distinct proteins, sites, items and triples, items that known(item) has, rows by kind."""
    triples = df.select(protein, position, item).distinct()
    sites = triples.groupBy(protein, position).agg(F.count("*").alias("n"))
    n = triples.agg(F.count("*").alias("triples")).crossJoin(F.broadcast(sites.agg(F.count("*").alias("sites"), F.countDistinct(protein).alias("proteins"))))  # one row by one row
    whole = n.crossJoin(F.broadcast(coverage(df, item, known, item)))
    rows = F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(None).cast("string").alias("name"), F.col(c).alias("n"), (F.col("percent") if m == "known items" else F.lit(None).cast("double")).alias("percent"))
                     for m, c in (("proteins", "proteins"), ("sites", "sites"), ("items", "n"), ("triples", "triples"), ("known items", "covered"))))
    kinds = df.groupBy(F.when(F.coalesce(kind, F.lit("")) == "", "unknown").otherwise(F.col(kind)).alias("name")).agg(F.count("*").alias("n"))
    return whole.select(F.explode(rows).alias("r")).select("r.*").unionByName(kinds.select(F.lit("kind").alias("measure"), "name", "n", F.lit(None).cast("double").alias("percent")))


def sets_either_way(edges: DataFrame, relation: str, of: str, members: str) -> DataFrame:
    """(key, items): for each node of type `of` the nodes of type `members` that a relation joins it with, in either direction.

    edges have source_type and target_type. Where a relation has edges of both directions, the one
    from members to `of` counts.
    """
    own = edges.where(F.col("relation") == relation)
    forward = own.where((F.col("source_type") == members) & (F.col("target_type") == of)).select(F.col("target_id").alias("key"), F.col("source_id").alias("item"), F.lit(0).alias("turn"))
    back = own.where((F.col("source_type") == of) & (F.col("target_type") == members)).select(F.col("source_id"), F.col("target_id"), F.lit(1))
    both = forward.unionAll(back)
    turn = both.agg(F.min("turn").alias("_turn"))  # one row
    return sets_by(both.crossJoin(F.broadcast(turn)).where(F.col("turn") == F.col("_turn")), "key", "item")
