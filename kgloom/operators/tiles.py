"""How many items score above a given score, without scoring them all: a tree of tiles with bounds.

Items that are alike stand side by side in tiles of about LEAF, tiles in tiles of FAN, up to one for
each group. A tile whose bounds lie wholly above a score is counted by its size, one wholly at or
below it is left, and only tiles that straddle it are opened; of those at the bottom every item is
scored. So counts are exact, whatever the bounds, and good bounds open few tiles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import Scratch
from .blocks import count_higher_products
from .ranges import places

LEAF, FAN = 64, 64
#: Groups whose topmost tiles are small enough to be sent to every task.
FEW = 1000


@dataclass(frozen=True)
class Scoring:
    """A score of an item x and the asking row's columns, and what bounds it over a tile.

    order: columns of items by which neighbours are alike. of_items and of_tiles sum up an array of
    items, or of tiles, as named columns. bounds(tile) is a struct (lo, hi) that no item's score in
    the tile lies outside of, or null; score(x) is the score itself, null where lowest. Both may use
    the asking row's columns, and those that `prepared` adds to it. Inner products over all items are
    counted in blocks, which takes less than bounds of tiles that most rows straddle.
    """

    order: tuple[str, ...]
    of_items: Callable[[Column], dict[str, Column]]
    of_tiles: Callable[[Column], dict[str, Column]]
    bounds: Callable[[Column], Column]
    score: Callable[[Column], Column]
    prepared: Callable[[DataFrame], DataFrame] = lambda asks: asks
    #: The asking row's and the items' vectors where the score is their inner product.
    product: tuple[str, str] | None = None


LOWEST = float("-inf")


def between(lo: Column, hi: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def least_and_most(xs: Column, value: Callable[[Column], Column], names: tuple[str, str] = ("lo", "hi")) -> dict[str, Column]:
    """The bounds of one value over an array."""
    return {names[0]: F.array_min(F.transform(xs, value)), names[1]: F.array_max(F.transform(xs, value))}


def by_value(value: str = "score") -> Scoring:
    """Items that bring their score along; NaN and null are lowest."""
    clean = lambda x: F.coalesce(F.nanvl(x[value].cast("double"), F.lit(LOWEST)), F.lit(LOWEST))
    return Scoring(
        (value,),
        lambda xs: least_and_most(xs, clean),
        lambda ts: {"lo": F.array_min(F.transform(ts, lambda t: t["lo"])), "hi": F.array_max(F.transform(ts, lambda t: t["hi"]))},
        lambda t: between(t["lo"], t["hi"]),
        clean,
    )


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def _length(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def _less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def _mean(vectors: Column) -> Column:
    """The mean of an array of vectors of one length."""
    start = F.transform(vectors[0], lambda x: F.lit(0.0))
    total = F.aggregate(vectors, start, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vectors))


#: Of the numbers that rounding may add up to in a bound, as a share of the lengths that meet.
SLACK = 1e-9


def _ball_of(xs: Column, vector: str) -> dict[str, Column]:
    """The ball around an array of items; its center is made once."""
    far = lambda c: F.array_max(F.transform(xs, lambda x: _length(_less(x[vector], c))))
    return {"ball": _once(_mean(F.transform(xs, lambda x: x[vector])), lambda c: F.struct(c.alias("center"), far(c).alias("radius")))}


def _ball_of_balls(ts: Column) -> dict[str, Column]:
    reach = lambda t, c: _length(_less(t["ball"]["center"], c)) + t["ball"]["radius"]
    far = lambda c: F.array_max(F.transform(ts, lambda t: reach(t, c)))
    return {"ball": _once(_mean(F.transform(ts, lambda t: t["ball"]["center"])), lambda c: F.struct(c.alias("center"), far(c).alias("radius")))}


def _once(make: Column, use: Callable[[Column], Column]) -> Column:
    """use(make), with make evaluated once."""
    return F.transform(F.array(make), use)[0]


def by_inner_product(ask: str, vector: str, order: tuple[str, ...]) -> Scoring:
    """Items' vectors by their inner product with the asking row's, in balls around means."""

    def bounds(t: Column) -> Column:
        reach = F.col("_length") * (t["ball"]["radius"] + SLACK * (1 + t["ball"]["radius"] + _length(t["ball"]["center"])))
        both = F.struct(_dot(F.col(ask), t["ball"]["center"]).alias("m"), reach.alias("r"))
        return _once(both, lambda b: between(F.nanvl(b["m"] - b["r"], F.lit(LOWEST)), F.nanvl(b["m"] + b["r"], F.lit(-LOWEST))))

    score = lambda x: F.nanvl(_dot(F.col(ask), x[vector]), F.lit(LOWEST))
    return Scoring(order, lambda xs: _ball_of(xs, vector), _ball_of_balls, bounds, score, lambda asks: asks.withColumn("_length", _length(F.col(ask))), (ask, vector))


def by_distance(ask: str, vector: str, order: tuple[str, ...]) -> Scoring:
    """Items' vectors by their Euclidean distance from the asking row's, nearest highest, in balls around means."""

    def bounds(t: Column) -> Column:
        both = F.struct(_length(_less(F.col(ask), t["ball"]["center"])).alias("m"), t["ball"]["radius"].alias("r"))
        slack = lambda b: b["r"] + SLACK * (1 + b["m"] + b["r"])
        return _once(both, lambda b: between(F.nanvl(-(b["m"] + slack(b)), F.lit(LOWEST)), F.nanvl(slack(b) - b["m"], F.lit(-LOWEST))))

    return Scoring(order, lambda xs: _ball_of(xs, vector), _ball_of_balls, bounds, lambda x: F.nanvl(-_length(_less(F.col(ask), x[vector])), F.lit(LOWEST)))


#: Vectors by which others are told apart, at most, and how many of all are looked at for them.
PIVOTS, LOOKED_AT = 64, 4096


def with_direction(items: DataFrame, vector: str, key: str, names: tuple[str, str] = ("pivot", "along")) -> DataFrame:
    """items with the nearest of up to PIVOTS of their own directions and the inner product with it.

    An order by the two puts vectors of like directions side by side. Pivots are picked one by one
    from LOOKED_AT items at most, each the farthest from those before; only tiles depend on them, no
    result does.
    """
    unit = F.transform(vector, lambda x: x.cast("double") / F.greatest(_length(F.col(vector)), F.lit(1e-300)))
    some = items.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), unit.alias("u")).orderBy("h").limit(LOOKED_AT).collect()
    import numpy as np

    dims = max((len(r.u) for r in some), default=0)
    found = np.array([r.u for r in some if len(r.u) == dims], float).reshape(-1, dims)
    found = found[np.isfinite(found).all(1)]
    pivots, near = [], np.full(len(found), np.inf)
    for k in range(min(PIVOTS, len(found))):
        at = 0 if not k else int(near.argmax())
        pivots.append(found[at].tolist())
        near = np.minimum(near, 2 - 2 * found @ found[at])
    if not pivots:
        return items.withColumns({names[0]: F.lit(0), names[1]: F.lit(0.0)})
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, p)).alias("p")) for k, p in enumerate(pivots)))
    best = F.array_max(F.transform(table, lambda p: F.struct(_dot(F.col(vector), p["p"]).alias("along"), p["k"].alias("k"))))
    return items.withColumn(names[0], best).withColumns({names[1]: F.col(f"{names[0]}.along"), names[0]: F.col(f"{names[0]}.k")})


def tree(items: DataFrame, by: list[str], item: str, scoring: Scoring, scratch: Scratch) -> list[DataFrame]:
    """Levels (by, tile, xs) from the topmost down; xs are the items, or the tiles below with size n.

    Each is an array of at most LEAF or FAN. Items whose `by` is null are in no tile.
    """
    known = items
    for b in by:
        known = known.where(F.col(b).isNotNull())
    placed = places(known, by, [*scoring.order, item], "_place")
    row = F.struct(*(F.col(c) for c in items.columns if c not in by))
    tile = F.floor((F.col("_place") - 1) / LEAF).alias("tile")
    levels = [scratch.save(placed.groupBy(*by, tile).agg(F.collect_list(row).alias("xs")), "items")]
    most, own, size = levels[0].agg(F.coalesce(F.max("tile"), F.lit(0))).first()[0], scoring.of_items, F.size("xs")
    while True:
        tiles = levels[-1].select(*by, "tile", size.cast("long").alias("n"), F.struct(*(c.alias(k) for k, c in own(F.col("xs")).items())).alias("sum"))
        kid = F.struct("tile", "n", "sum.*")
        up = tiles.groupBy(*by, F.floor(F.col("tile") / FAN).alias("tile")).agg(F.collect_list(kid).alias("xs"))
        levels.append(scratch.save(up, "tiles"))
        most //= FAN
        if most == 0:
            return levels[::-1]
        own, size = scoring.of_tiles, F.aggregate("xs", F.lit(0).cast("long"), lambda s, t: s + t["n"])


def _descend(front: DataFrame, levels: list[DataFrame], by: list[str], scoring: Scoring, own: str, scratch: Scratch) -> DataFrame:
    """(_ask, _n): counts, in parts, of the items of front's groups that score above own."""
    top, cols, counts = levels[0].drop("tile"), front.columns, []
    few = top.count() <= FEW  # one row without groups
    above = F.col(own)
    for depth, level in enumerate(levels):
        if depth:
            met = front.join(level, [*by, "tile"])
        elif by:
            met = front.join(F.broadcast(top) if few else top, by)
        else:
            met = front.crossJoin(F.broadcast(top))
        if depth == len(levels) - 1:
            n = F.size(F.filter("xs", lambda x: scoring.score(x) > above)).cast("long")
            counts.append(met.select("_ask", n.alias("_n")))
            return reduce(DataFrame.unionAll, counts)
        judged = F.transform("xs", lambda t: F.struct(t["tile"].alias("tile"), t["n"].alias("n"), scoring.bounds(t).alias("b")))
        over = lambda t: F.coalesce(t["b"]["lo"] > above, F.lit(False))
        under = lambda t: F.coalesce(t["b"]["hi"] <= above, F.lit(False))
        met = met.withColumn("_js", judged)
        n = F.aggregate(F.filter("_js", over), F.lit(0).cast("long"), lambda s, t: s + t["n"])
        straddling = F.transform(F.filter("_js", lambda t: ~over(t) & ~under(t)), lambda t: t["tile"])
        met = scratch.save(met.select(*cols, n.alias("_n"), straddling.alias("_open")), "front")
        counts.append(met.where("_n > 0").select("_ask", "_n"))
        front = met.select(*cols, F.explode("_open").alias("tile"))


def count_higher(asks: DataFrame, sets: dict[str, tuple[DataFrame, list[str]]], item: str, scoring: Scoring, own: str = "own") -> DataFrame:
    """asks with a column for each set (items, by): how many items of the row's group score above `own`.

    asks may hold any columns that scoring asks for; rows may repeat. A row whose group has no items,
    whose group is null or whose own score is null has 0. A group's tiles meet a row one level at a
    time, by tile, so that the rows exchanged grow with the tiles that straddle their scores.
    """
    scratch = Scratch(asks.sparkSession, "tiles")
    asked = scratch.save(scoring.prepared(asks).withColumn("_ask", F.monotonically_increasing_id()), "asks")
    front = asked.where(F.col(own).isNotNull())
    parts = []
    for k, (items, by) in enumerate(sets.values()):
        if scoring.product and not by:
            n = count_higher_products(front, items, scoring.product[0], own, scoring.product[1], "_ask", scratch)
        else:
            n = _descend(front, tree(items, by, item, scoring, scratch), by, scoring, own, scratch)
        parts.append(n.select("_ask", F.lit(k).alias("_set"), "_n"))
    sums = [F.sum(F.when(F.col("_set") == k, F.col("_n")).otherwise(0)).alias(f"_sum{k}") for k in range(len(sets))]
    answered = asked.join(reduce(DataFrame.unionAll, parts).groupBy("_ask").agg(*sums), "_ask", "left")
    return answered.select(*asks.columns, *(F.coalesce(f"_sum{k}", F.lit(0).cast("long")).alias(name) for k, name in enumerate(sets)))
