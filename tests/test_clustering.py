"""Ward clustering in rounds against merging the nearest pair of a full table one by one."""

import itertools
import math
import random

from kgloom.operators import clustering as cl


def jaccard(a, b):
    return 1 - len(a & b) / len(a | b)


def one_by_one(sets):
    """Merges by repeated updates of the full distance table."""
    size = {k: 1 for k in sets}
    d = {frozenset(p): jaccard(sets[p[0]], sets[p[1]]) for p in itertools.combinations(sets, 2)}
    out = []
    while len(size) > 1:
        pair = min(d, key=lambda p: (d[p], sorted(p)))
        a, b = sorted(pair)
        h = d.pop(pair)
        out.append((a, b, h))
        for v in size:
            if v in (a, b):
                continue
            x, y, total = d.pop(frozenset((v, a))), d.pop(frozenset((v, b))), size[a] + size[b] + size[v]
            d[frozenset((v, a))] = math.sqrt(((size[v] + size[a]) * x * x + (size[v] + size[b]) * y * y - size[v] * h * h) / total)
        size[a] += size.pop(b)
    return out


def rows(spark, sets):
    return spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "k int, x int")


def test_merges_as_one_by_one(spark):
    rng = random.Random(1)
    sets = {k: set(rng.sample(range(14), rng.randint(2, 9))) for k in range(11)}
    sets |= {20: {100, 101}, 21: {100, 101}, 22: {100, 102, 103}}  # nothing in common with the others
    want = one_by_one(sets)
    df = rows(spark, sets)
    from kgloom.operators.lookups import jaccard as likes
    from pyspark.sql import functions as F

    near = likes(df, "k", "x").select("a", "b", (1 - F.col("jaccard")).alias("distance"))
    got = sorted(map(tuple, cl.ward_merges(near, df.selectExpr("k as id").distinct()).collect()), key=lambda m: m[2])
    assert [round(h, 9) for _, _, h in got] == [round(h, 9) for *_, h in sorted(want, key=lambda m: m[2])]
    for most in (4,):
        level = sorted(h for *_, h in want)[len(sets) - most - 1] + 1e-9
        names = {k: k for k in sets}
        for a, b, h in want:
            if h <= level:
                names = {k: min(names[a], names[b]) if n in (names[a], names[b]) else n for k, n in names.items()}
        out = cl.set_clusters(df, "k", "x", df.select("k"), most).collect()
        assert {r.k: r.cluster for r in out} == names and not any(r.alone for r in out)


def test_keys_without_items_and_ties(spark):
    """Many keys that share nothing merge in few rounds; those without items stay alone."""
    sets = {k: {k} for k in range(13)}
    df = rows(spark, sets).unionByName(spark.createDataFrame([(50, None), (51, None)], "k int, x int"))
    ids = spark.createDataFrame([(k,) for k in [*range(13), 50, 51, 52, None]], "k int")
    out = {r.k: (r.cluster, r.alone) for r in cl.set_clusters(df, "k", "x", ids, 13).collect()}
    assert out == {k: (k, k >= 50) for k in [*range(13), 50, 51, 52]}
    merges = cl.ward_merges(spark.createDataFrame([], "a int, b int, distance double"), ids.where("k < 13").selectExpr("k as id")).collect()
    heights = sorted(round(m.height, 9) for m in merges)
    assert len(merges) == 12 and heights[:6] == [1.0] * 6
    assert cl.set_clusters(df.where("false"), "k", "x", ids.where("false"), 3).count() == 0
