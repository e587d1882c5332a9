"""Exact counts and ranks in tiles against counting by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import ranking as rk, tiles


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "LEAF", 4)
    monkeypatch.setattr(tiles, "FAN", 3)


def vectors(rng, n, dims=5):
    heads = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [[x + rng.gauss(0, 0.2) for x in rng.choice(heads)] for _ in range(n)]


@pytest.mark.parametrize("kind", ["inner", "distance"])
@pytest.mark.parametrize("few", [0, 1000])
def test_vectors_are_counted_exactly(spark, monkeypatch, kind, few):
    """Five levels of tiles, groups of very different size, repeated vectors, null and broken ones."""
    monkeypatch.setattr(tiles, "FEW", few)
    rng = random.Random(2)
    data = [(k, "ab"[k > 200], v) for k, v in enumerate(vectors(rng, 220))]
    data += [(1000 + k, "a", data[k][2]) for k in range(30)] + [(2000, "b", None), (2001, "a", [1.0, None, 0.0, 0.0, 0.0]), (2002, "a", [math.nan] * 5), (2003, None, [1.0] * 5)]
    items = tiles.with_direction(spark.createDataFrame(data, "item int, g string, v array<double>"), "v", "item")
    asks = [(k, g, x, own) for k, (x, g, own) in enumerate(zip(vectors(rng, 40), "aabbc" * 8, [-3.0, -1.0, 0.0, 0.5, 2.0, 9.0, None, -0.25] * 5))]
    scoring = (tiles.by_inner_product if kind == "inner" else tiles.by_distance)("x", "v", ("pivot", "along"))
    got = tiles.count_higher(spark.createDataFrame(asks, "id int, g string, x array<double>, own double"), {"n": (items, ["g"]), "all": (items.drop("g"), [])}, "item", scoring).collect()
    score = (lambda x, v: sum(a * b for a, b in zip(x, v))) if kind == "inner" else (lambda x, v: -math.dist(x, v))
    whole = lambda v: v is not None and all(y is not None and y == y for y in v)
    for r in got:
        high = [g for _, g, v in data if whole(v) and r.own is not None and score(r.x, v) > r.own]
        assert (r.n, r.all) == (high.count(r.g), len(high))
    assert len(got) == len(asks)


def test_values_are_counted_exactly(spark):
    rng = random.Random(4)
    data = [(k, k % 3, rng.choice([0.0, 1.5, 2.0, math.nan, None, -math.inf, rng.random()])) for k in range(400)]
    items = spark.createDataFrame(data, "item int, q int, score double")
    clean = lambda s: -math.inf if s is None or s != s else s
    ranks = rk.target_ranks(items, items.where("item < 60").select("q", "item").unionAll(spark.createDataFrame([(1, 999), (7, 5)], "q int, item int")), ["q"]).collect()
    want = {(q, k): 1 + sum(clean(s) > clean(own) for _, p, s in data if p == q) for k, q, own in data[:60] if own is not None}
    want |= {(q, k): 1 + sum(p == q for _, p, _ in data) for k, q, own in data[:60] if own is None} | {(1, 999): 1 + sum(p == 1 for _, p, _ in data), (7, 5): 1}
    assert {(r.q, r.item): r["rank"] for r in ranks} == want and len(ranks) == len(want)


def test_restricted_ranks_always_hold_the_target(spark):
    scores = spark.createDataFrame([(1, k, float(k)) for k in range(10)] + [(2, k, float(-k)) for k in range(10)], "q int, item int, score double")
    allowed = spark.createDataFrame([(1, 2), (1, 7), (1, 8), (1, 99)], "q int, item int")
    targets = spark.createDataFrame([(1, 5), (1, 8), (1, 0), (2, 3), (2, 77)], "q int, item int")
    got = {(r.q, r.item): r["rank"] for r in rk.restricted_ranks(scores, allowed, targets, ["q"]).collect()}
    assert got == {(1, 5): 3, (1, 8): 1, (1, 0): 4, (2, 3): 4}  # query 2 has no allowed items: all of them


def test_filtered_ranks_of_hubs(spark):
    """One anchor knows most items; known items off the pool count for nothing, ties for nothing."""
    pool = [("r", d, k) for d in ("tail", "head") for k in range(120)] + [("s", "tail", k) for k in range(0, 120, 7)] + [("s", "head", 0)]
    known = [(0, "r", k) for k in range(90)] + [(k, "r", 0) for k in range(40, 60)] + [(0, "s", 7), (0, "s", 14), (0, "s", 3)]
    triples = [(0, "r", 5), (45, "r", 0), (3, "r", 117), (0, "s", 7)]
    df = spark.createDataFrame(pool, "relation string, direction string, item int").withColumn("score", F.col("item") * 31 % 50)
    got = rk.link_ranks(spark.createDataFrame(triples, "h int, r string, t int"), df, spark.createDataFrame(known + triples, "h int, r string, t int"), lambda q: q, tiles.by_value()).collect()
    value = lambda k: k * 31 % 50
    every = {("tail", r, h, t) for h, r, t in known + triples} | {("head", r, t, h) for h, r, t in known + triples}
    assert len(got) == 8
    for r in got:
        higher = [k for s, d, k in pool if (s, d) == (r.relation, r.direction) and value(k) > value(r.item) and (d, s, r.anchor, k) not in every]
        assert r["rank"] == 1 + len(higher)


def test_alignment_of_equal_pairs(spark):
    rng = random.Random(8)
    q, p = vectors(rng, 60), vectors(rng, 60)
    out = rk.alignment(spark.createDataFrame(list(enumerate(q)), "id int, x array<double>"), spark.createDataFrame(list(enumerate(p)), "id int, y array<double>")).first()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    ranks = [1 + sum(dot(x, y) > dot(x, p[k]) for y in p) for k, x in enumerate(q)]
    assert out.n == 60 and abs(out.mrr - sum(1 / r for r in ranks) / 60) < 1e-9


def test_empty_sets(spark):
    items = spark.createDataFrame([], "item int, q int, score double")
    asks = spark.createDataFrame([(1, 0.5)], "q int, own double")
    assert tiles.count_higher(asks, {"n": (items, ["q"]), "m": (items.drop("q"), [])}, "item", tiles.by_value()).collect() == [(1, 0.5, 0, 0)]
