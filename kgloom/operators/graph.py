"""Graph algorithms over edge tables: components, hierarchy, cycles, clustering, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable (G1).

    Alternates two contractions until every node points straight at its root. In the first each
    node hands its larger neighbours to its smallest neighbour, in the second each node hands its
    smaller neighbours to the smallest of them; both keep components. Minima are combined before
    the exchange, and the joins are plain equi-joins whose large partitions AQE can split, so a
    node with very many neighbours does not fill one task. Each round is a written table.

    Null ends and self loops are ignored; repeated edges count once; no edges give no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            e.select(F.col("v"), F.lit(0), F.lit(1))
        )
        open_nodes = (
            ends.groupBy("n")
            .agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .where("up > 1 or (up > 0 and down > 0)")
        )
        if open_nodes.isEmpty():
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        low = _min_neighbour(large)
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = scratch.save(small, "small")
        scratch.drop(e)
        scratch.drop(large)
        e = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size) of every node(node_id); edges to unknown nodes are ignored, nodes alone count (G1)."""
    known = nodes.select("node_id")
    inside = edges.join(known, edges.source_id == known.node_id, "left_semi").join(known, F.col("target_id") == known.node_id, "left_semi")
    of = connected_components(inside.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    placed = known.join(of, F.col("node_id") == F.col("node"), "left")
    return placed.groupBy(F.coalesce("component", "node_id").alias("component")).agg(F.count("*").alias("size"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: the distinct undirected pairs."""
    return edges.where("source_id <> target_id").select(
        F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")
    ).distinct()


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, coefficient) on the simple undirected graph; 0 below degree 2.

    Each pair is directed from its end of lower degree, so a hub's neighbours are not all paired.
    """
    pairs = simple_edges(edges)
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    da = degree.select(F.col("node").alias("a"), F.col("degree").alias("da"))
    db = degree.select(F.col("node").alias("b"), F.col("degree").alias("db"))
    ranked = pairs.join(da, "a").join(db, "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    two = out.alias("p").join(out.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(F.col("p.x").alias("c"), F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    closed = two.join(pairs, ["a", "b"])
    corners = closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    full = degree.join(corners, "node", "left").fillna(0, ["triangles"])
    d = F.col("degree")
    return full.withColumn("coefficient", F.when(d >= 2, 2 * F.col("triangles") / (d * (d - 1))).otherwise(F.lit(0.0)))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node): nodes left when those without an in or an out edge are trimmed until none is.

    Empty exactly if the relation has no cycle; what is left lies on cycles or between them.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    e = scratch.save(edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).distinct(), "edges")
    n = e.count()
    while n:
        after = scratch.save(
            e.join(e.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(
                e.select(F.col("s").alias("t")).distinct(), "t", "left_semi"
            ).select("s", "t"),
            "edges",
        )
        m = after.count()
        scratch.drop(e)
        e, done = after, m == n
        n = m
        if done:
            break
    return e.select(F.col("s").alias("node")).unionAll(e.select("t")).distinct()


def hierarchy(edges: DataFrame, roots: DataFrame, most: int = 3) -> DataFrame:
    """(node, depth, parent): breadth-first levels below roots(node), to a depth; least parent of the level.

    edges(parent, child). A node already reached is not entered again, so cycles end.
    """
    scratch = Scratch(edges.sparkSession, "hierarchy")
    seen = scratch.save(roots.select("node", F.lit(0).alias("depth"), F.lit(None).cast(dict(edges.dtypes)["parent"]).alias("parent")).distinct(), "level")
    front = seen
    for d in range(1, most + 1):
        step = front.select(F.col("node").alias("parent")).join(edges.select("parent", "child"), "parent")
        new = step.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent"))
        front = scratch.save(new.join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth"), "parent"), "level")
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def path_scores(edges: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, score): the best running mean of edge weights on the way from a root, level by level.

    edges(parent, child, weight). A node keeps the score of the level that reaches it first; equal
    levels keep the highest. Goes on until no level has new nodes, or for some rounds where that is asked.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    seen = scratch.save(roots.select("node", F.lit(0.0).alias("score"), F.lit(0).alias("depth")).distinct(), "level")
    front = seen
    d = 0
    while rounds is None or d < rounds:
        d += 1
        step = front.select(F.col("node").alias("parent"), "score").join(edges, "parent")
        mean = (F.col("score") * (d - 1) + F.col("weight")) / d
        new = step.groupBy(F.col("child").alias("node")).agg(F.max(mean).alias("score"))
        front = scratch.save(new.join(seen, "node", "left_anti").select("node", "score", F.lit(d).alias("depth")), "level")
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen.select("node", "score")


def with_inverse(edges: DataFrame, n_relations: int) -> DataFrame:
    """edges(src, rel, dst) and their inverses, whose relation ids are shifted by n_relations."""
    return edges.select("src", "rel", "dst").unionAll(edges.select(F.col("dst"), F.col("rel") + n_relations, F.col("src")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, n_in, n_out) of every node with an edge."""
    out = edges.select(F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    both = out.unionAll(edges.select("target_id", F.lit(1), F.lit(0)))
    return both.groupBy("node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def induced(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the given types and the edges with both ends among them."""
    kept = nodes.where(F.col("node_type").isin(types))
    ids = kept.select("node_id")
    inside = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    return kept, inside.join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def by_relation(nodes: DataFrame, edges: DataFrame, relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges of the given relations and the nodes that they touch."""
    kept = edges.where(F.col("relation").isin(relations))
    ends = kept.select(F.col("source_id").alias("node_id")).unionAll(kept.select("target_id"))
    return nodes.join(ends, "node_id", "left_semi"), kept


def incident(edges: DataFrame, matches: DataFrame, most: int | None = None) -> DataFrame:
    """Edges with an end among matches(node_id), the first `most` by key."""
    ids = matches.select("node_id")
    a = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").select(edges.columns)
    b = edges.join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi").select(edges.columns)
    both = a.unionAll(b).distinct()
    return both.orderBy("source_id", "target_id", "relation").limit(most) if most else both


def sampled(nodes: DataFrame, edges: DataFrame, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """n nodes in a seeded order and the edges among them."""
    some = nodes.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "node_id")), "node_id").limit(n)
    ids = some.select("node_id")
    inside = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    return some, inside.join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
