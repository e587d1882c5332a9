"""Ward clustering of sets by rounds of reciprocal nearest neighbours over a sparse table of likenesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import Scratch
from .graph import connected_components
from .lookups import jaccard
from .ranges import places


#: Clusters of a class that are paired in one part, about.
TURN = 64


def _squared(n_a: Column, s_a: Column, n_b: Column, s_b: Column, shared: Column | float = 0.0) -> Column:
    """Ward's squared distance of two clusters from their sizes and sums.

    s: the sum of squared distances within a cluster. shared: the sum of 1 - d * d over the pairs
    between the two; pairs that share nothing have d = 1 and add none, so they need no rows.
    """
    apart = 1 - shared / (n_a * n_b) - (s_a / (n_a * n_a) + s_b / (n_b * n_b))
    return 2 * n_a * n_b / (n_a + n_b) * apart


def _like(likes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b, d2, kind): clusters a < b that share something, with their distance."""
    one = clusters.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    two = clusters.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    met = likes.join(one, "a").join(two, "b")
    return met.select("a", "b", _squared(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"), F.col("g")).alias("d2"), F.lit(0).alias("kind"))


def _unlike(clusters: DataFrame) -> DataFrame:
    """(a, b, d2, kind): for each cluster the nearest of those that it may share nothing with.

    Such distances depend on size and inner sum alone. Clusters that agree in both are a class and
    equally far from each other; they are paired in turn. Of other classes only the tightest two of
    each size can be nearest, and of those the first cluster. The distance is never below the true
    one of a pair that does share something, which _like() has as well.
    """
    kind = clusters.groupBy("n", "s").agg(F.count("*").alias("m"), F.min("id").alias("first"))
    tight = W.partitionBy("n").orderBy(F.desc("s"))  # the limit below cuts each partition first
    sizes = kind.withColumn("k", F.row_number().over(tight)).where("k <= 2")
    profile = sizes.agg(F.collect_list(F.struct("n", "s", "first")).alias("ps"))  # two rows a size, and sizes are few
    own = kind.crossJoin(F.broadcast(profile))
    other = F.filter("ps", lambda p: (p["n"] != F.col("n")) | (p["s"] != F.col("s")))
    far = lambda p: F.struct(_squared(F.col("n"), F.col("s"), p["n"], p["s"]).alias("d2"), p["first"].alias("to"))
    best = own.select("n", "s", "m", "first", F.array_min(F.transform(other, far)).alias("best"))
    # every member knows its class's nearest other; only the first member may be asked by others
    members = clusters.join(best.where("best is not null"), ["n", "s"])
    a, b = F.least("id", "best.to"), F.greatest("id", "best.to")
    other = members.select(a.alias("a"), b.alias("b"), F.col("best.d2").alias("d2"), F.lit(2).alias("kind"), F.col("id").alias("asks"))
    some = F.pmod(F.xxhash64("id"), F.greatest(F.floor(F.col("m") / TURN), F.lit(1).cast("long"))).alias("some")  # a large class in parts
    turn = clusters.join(kind.where("m > 1").select("n", "s", "m"), ["n", "s"]).select("n", "s", "id", some)
    turn = turn.withColumn("place", F.row_number().over(W.partitionBy("n", "s", "some").orderBy("id")))
    pair = turn.groupBy("n", "s", "some", F.floor((F.col("place") - 1) / 2).alias("k")).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    same = pair.select("a", "b", _squared(F.col("n"), F.col("s"), F.col("n"), F.col("s")).alias("d2"), F.lit(1).alias("kind"))
    both = same.select("a", "b", "d2", "kind", F.explode(F.array("a", "b")).alias("asks"))
    return other.unionByName(both)


def ward_merges(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b, height): the merges of Ward's clustering of ids(id), a < b naming the clusters by their least members.

    pairs(a, b, distance), a < b: those nearer than 1; all others are 1 apart. Heights come from the
    merged distances by sizes, as in repeated updates of a full table. Each round merges all pairs of
    clusters that are each other's nearest, which gives the same tree as merging the nearest pair of
    all one by one: a merged cluster is never nearer to others than its parts were. Of equal
    distances, pairs that share something go first, then the lower ids.

    Rounds read and write tables with a row a cluster and a row a pair that shares something.
    """
    scratch = Scratch(ids.sparkSession, "ward")
    clusters = scratch.save(ids.select("id").distinct().select("id", F.lit(1.0).alias("n"), F.lit(0.0).alias("s")), "clusters")
    likes = scratch.save(pairs.where("a < b and distance < 1").select("a", "b", (1 - F.col("distance") ** 2).alias("g")), "likes")
    merges, left = None, clusters.count()
    while left > 1:
        like = _like(likes, clusters).select("a", "b", "d2", "kind", F.explode(F.array("a", "b")).alias("asks"))
        wishes = like.unionByName(_unlike(clusters))
        nearest = wishes.groupBy("asks").agg(F.min(F.struct("d2", "kind", "a", "b")).alias("w")).select("asks", "w.*")
        agreed = nearest.groupBy("a", "b").agg(F.count("*").alias("asked"), F.min("d2").alias("d2")).where("asked = 2")
        agreed = scratch.save(agreed.select("a", "b", F.sqrt(F.greatest("d2", F.lit(0.0))).alias("height")), "merges")
        merges = agreed if merges is None else merges.unionByName(agreed)
        renamed = agreed.select(F.col("b").alias("old"), F.col("a").alias("new"))
        shared = agreed.join(likes, ["a", "b"], "left").select(F.col("a").alias("id"), F.coalesce("g", F.lit(0.0)).alias("g"))
        moved = clusters.join(renamed, F.col("id") == F.col("old"), "left").select(F.coalesce("new", "id").alias("id"), "n", "s")
        summed = moved.groupBy("id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), (F.min("n") * F.max("n")).alias("between"), F.count("*").alias("k"))
        grown = summed.join(shared, "id", "left")
        grown = grown.select("id", "n", F.when(F.col("k") == 2, F.col("s") + F.col("between") - F.col("g")).otherwise(F.col("s")).alias("s"))
        ends = likes
        for c in ("a", "b"):
            ends = ends.join(renamed.select(F.col("old").alias(c), F.col("new").alias("_n")), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
        ends = ends.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("g").alias("g"))
        after, likes_after = scratch.save(grown, "clusters"), scratch.save(ends, "likes")
        scratch.drop(clusters)
        scratch.drop(likes)
        clusters, likes, left = after, likes_after, left - agreed.count()
    kind = dict(ids.dtypes)["id"]
    return merges if merges is not None else ids.sparkSession.createDataFrame([], f"a {kind}, b {kind}, height double")


def cut(merges: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(id, cluster): at most `most` clusters, named by their least member, by undoing the highest of ward_merges().

    Merges of equal height are undone together, as a cut at a height does.
    """
    keep = max(ids.select("id").distinct().count() - most, 0)
    ranked = places(merges, [], ["height", "a", "b"], "place")
    level = ranked.where(F.col("place") == keep).select(F.col("height").alias("_h"))  # one row or none
    low = merges.join(F.broadcast(level), F.col("height") <= F.col("_h")).select("a", "b")
    of = connected_components(low)
    return ids.select("id").distinct().join(of.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def set_clusters(sets: DataFrame, key: str, item: str, ids: DataFrame, most: int) -> DataFrame:
    """(key, cluster, alone): Ward clusters of keys by the Jaccard distance of their item sets.

    Keys of ids without any item are clusters of their own beside the `most` others. Null items do
    not count.
    """
    held = sets.where(F.col(item).isNotNull())
    keys = held.join(ids.select(key), key, "left_semi")
    near = jaccard(keys, key, item).select("a", "b", (1 - F.col("jaccard")).alias("distance"))
    named = keys.select(F.col(key).alias("id")).distinct()
    of = cut(ward_merges(near, named), named, most)
    every = ids.select(F.col(key).alias("id")).where("id is not null").distinct().join(of, "id", "left")
    return every.select(F.col("id").alias(key), F.coalesce("cluster", "id").alias("cluster"), F.col("cluster").isNull().alias("alone"))
