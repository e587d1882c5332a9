"""Splits, leakage and negative sampling by hash order: the same rows give the same split anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranges import places


def seeded(*columns: str, seed: int = 42) -> Column:
    """A reproducible order by md5 of the seed and the given columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def link_split(edges: DataFrame, keys: list[str], by: list[str], val: float = 0.1, test: float = 0.1, stratified: bool = False, order: Column | None = None) -> DataFrame:
    """edges with `split`: per type floor(n * ratio) rows test, then val, the rest train.

    stratified: from three rows on at least one row in each split and at most n // 3 in test and in
    val; types with fewer rows are train only (R2). Raises if ratios don't leave a train part.
    """
    if not 0 < val + test < 1:
        raise ValueError("val + test must be between 0 and 1")
    placed = places(edges.withColumn("_o", seeded(*keys) if order is None else order), by, ["_o", *keys], "_p")
    sizes = edges.groupBy(*by).agg(F.count("*").alias("_n"))
    n = F.col("_n")

    def size(ratio):
        k = F.floor(n * F.lit(ratio))
        return F.when(n < 3, 0).otherwise(F.least(F.greatest(k, F.lit(1)), F.floor(n / 3))) if stratified else k

    placed = placed.join(sizes, by).withColumns({"_t": size(test), "_v": size(val)})
    part = F.when(F.col("_p") <= F.col("_t"), "test").when(F.col("_p") <= F.col("_t") + F.col("_v"), "val").otherwise("train")
    return placed.withColumn("split", part).drop("_p", "_t", "_v", "_n", "_o")


def leaks(train: DataFrame, held: DataFrame, inverse: DataFrame) -> DataFrame:
    """Rows of held(h, r, t) whose inverse (t, inverse r, h) is in train (J14, R4). inverse(r, inv)."""
    turned = train.join(inverse.select(F.col("inv").alias("r"), F.col("r").alias("_inv")), "r").select(
        F.col("t").alias("h"), F.col("_inv").alias("r"), F.col("h").alias("t")
    )
    return held.join(turned, ["h", "r", "t"], "left_semi")


def without_leaks(split: DataFrame, inverse: DataFrame) -> DataFrame:
    """split(h, r, t, split) with train rows moved to the split that holds their inverse.

    Test wins over val. A moved row's own inverse is the row that it followed, so one pass is enough.
    """
    held = split.where("split <> 'train'")
    turned = held.join(inverse, "r").select(F.col("t").alias("h"), F.col("inv").alias("r"), F.col("h").alias("t"), F.col("split").alias("_to"))
    to = turned.groupBy("h", "r", "t").agg(F.min("_to").alias("_to"))
    moved = F.when((F.col("split") == "train") & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("split"))
    return split.join(to, ["h", "r", "t"], "left").withColumn("split", moved).drop("_to")


def hold_out_entities(nodes: DataFrame, edges: DataFrame, ratio: float = 0.1, least_degree: int = 1) -> DataFrame:
    """(node_id, node_type): per type max(1, floor(n * ratio)) of the eligible nodes, at most half."""
    ends = edges.select(F.col("source_id").alias("node_id")).unionAll(edges.select("target_id"))
    degree = ends.groupBy("node_id").agg(F.count("*").alias("_d")).where(F.col("_d") >= least_degree)
    fit = nodes.join(degree, "node_id").select("node_id", "node_type")
    sizes = fit.groupBy("node_type").agg(F.count("*").alias("_n"))
    k = F.least(F.greatest(F.floor(F.col("_n") * F.lit(ratio)), F.lit(1)), F.floor(F.col("_n") / 2))
    placed = places(fit.withColumn("_seed", seeded("node_id")), ["node_type"], ["_seed", "node_id"], "_p")
    return placed.join(sizes.select("node_type", k.alias("_k")), "node_type").where("_p <= _k").select("node_id", "node_type")


def inductive_split(edges: DataFrame, held: DataFrame) -> DataFrame:
    """edges with `inductive`: whether an end is held out; such edges leave the train part."""
    ids = held.select("node_id", F.lit(True).alias("_h"))
    a = ids.select(F.col("node_id").alias("source_id"), F.col("_h").alias("_a"))
    b = ids.select(F.col("node_id").alias("target_id"), F.col("_h").alias("_b"))
    both = edges.join(a, "source_id", "left").join(b, "target_id", "left")
    return both.withColumn("inductive", F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))).drop("_a", "_b")


def corrupt(triples: DataFrame, pool: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k corruptions of every triple(h, r, t): an end, by hash, is replaced from its side's pool.

    pool(r, side, at, item, n): the allowed items of each relation and side, numbered from 0, and
    their number. A replacement may equal the original.
    """
    grown = triples.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    draw = lambda tag: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{tag}"), "h", "r", "t", "k")), 1, 8), 16, 10).cast("long")
    sized = pool.select("r", "side", "n").distinct()
    chosen = grown.withColumn("side", F.when(draw("s") % 2 == 0, "head").otherwise("tail")).join(sized, ["r", "side"])
    chosen = chosen.withColumn("at", draw("i") % F.col("n")).drop("n")
    return chosen.join(pool.drop("n"), ["r", "side", "at"]).select(
        F.when(F.col("side") == "head", F.col("item")).otherwise(F.col("h")).alias("h"), "r",
        F.when(F.col("side") == "tail", F.col("item")).otherwise(F.col("t")).alias("t"), F.col("h").alias("of_h"), F.col("t").alias("of_t"), "k",
    )


def negatives(candidates: DataFrame, positives: DataFrame, keys: list[str], n: int, order: Column | None = None) -> DataFrame:
    """n distinct candidate pairs that are no positives, in a seeded order."""
    rest = candidates.select(keys).distinct().join(positives.select(keys), keys, "left_anti")
    return rest.orderBy(seeded(*keys) if order is None else order, *keys).limit(n)


def time_split(df: DataFrame, at: str, share: float = 0.8) -> DataFrame:
    """df with `split`: train up to the exact percentile of a time column, test after it."""
    kind = dict(df.dtypes)[at]
    when = F.col(at).cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col(at).cast("double")
    cut = df.agg(F.percentile(when, F.lit(share)).alias("_cut"))  # one row
    both = df.crossJoin(F.broadcast(cut))
    return both.withColumn("split", F.when(when <= F.col("_cut"), "train").otherwise("test")).drop("_cut")


def group_split(df: DataFrame, group: str) -> DataFrame:
    """df with `split`: whole groups, 80/10/10 by hash."""
    u = F.pmod(F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(10))
    return df.withColumn("split", F.when(u < 8, "train").when(u == 8, "val").otherwise("test"))


def folds(df: DataFrame, k: int, key: str, by: list[str] | None = None) -> DataFrame:
    """df with `fold` from 0 to k - 1, dealt in turn within each class."""
    placed = places(df.withColumn("_o", seeded(key)), by or [], ["_o", key], "_p")
    return placed.withColumn("fold", ((F.col("_p") - 1) % k).cast("int")).drop("_p", "_o")


def novel(held: DataFrame, train: DataFrame, target: str) -> DataFrame:
    """held with `novel`: whether its target never occurs in train."""
    seen = train.select(target, F.lit(True).alias("_seen")).distinct()
    return held.join(seen, target, "left").withColumn("novel", F.col("_seen").isNull()).drop("_seen")
