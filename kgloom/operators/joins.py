"""Join operators that are more than one equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import base_accession


def resolve_ids(df: DataFrame, column: str, known: DataFrame, order: tuple[str, ...] = ("exact", "base", "canonical")) -> DataFrame:
    """df with `resolved`: the first candidate of an id that known(node_id) has, null without one.

    Candidates are the id itself, its base, and its base with -1, tried in the given order. The
    three candidates of a distinct id meet known in one equi-join; ids resolve once each.
    """
    base = base_accession(F.col("_id"))
    of = {"exact": F.col("_id"), "base": base, "canonical": F.concat(base, F.lit("-1"))}
    ids = df.select(F.col(column).alias("_id")).where("_id is not null").distinct()
    tried = ids.select("_id", F.posexplode(F.array(*(of[o] for o in order))).alias("_rank", "node_id"))
    best = tried.join(known.select("node_id"), "node_id", "left_semi").groupBy("_id").agg(F.min_by("node_id", "_rank").alias("resolved"))
    return df.join(best, F.col(column) == F.col("_id"), "left").drop("_id")


def compatible_terms(site_type: Column, terms: Column, type_map: dict[str, str], generic: str = "glycosylation") -> Column:
    """Whether an item's terms fit a site's type: no terms or the generic type fit all, unknown types none."""
    term = F.coalesce(*(F.when(site_type == k, F.lit(v)) for k, v in type_map.items()))
    untyped = F.coalesce(F.size(terms), F.lit(0)) <= 0
    return F.coalesce((site_type == generic) | (term.isNotNull() & (untyped | F.array_contains(terms, term))), F.lit(False))


def site_items(sites: DataFrame, items: DataFrame, terms: DataFrame, type_map: dict[str, str]) -> DataFrame:
    """(site_id, item): sites(site_id, protein_id, site_type) with their protein's items whose terms fit."""
    sets = terms.groupBy("item").agg(F.collect_set("term").alias("terms"))  # an item has few terms
    return (
        sites.join(items, "protein_id")
        .join(sets, "item", "left")
        .where(compatible_terms(F.col("site_type"), F.col("terms"), type_map))
        .select("site_id", "item")
        .distinct()
    )


def map_labels(df: DataFrame, by_id: DataFrame, by_text: DataFrame, key: str, text: str) -> DataFrame:
    """df with `mapped`: by id, else by normalised text; a key that maps to several gives several rows."""
    a = by_id.select(F.col("source_id").alias("_a"), F.col("target").alias("_by_id"))
    b = by_text.select(F.col("source_text").alias("_b"), F.col("target").alias("_by_text"))
    joined = df.join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(text) == F.col("_b"), "left")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return joined.withColumn("mapped", F.coalesce(blank("_by_id"), blank("_by_text"))).drop("_a", "_b", "_by_id", "_by_text")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge at either end."""
    ends = edges.select(F.col("source_id").alias("node_id")).unionAll(edges.select("target_id"))
    return nodes.join(ends, "node_id", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """Distinct ids at one end of edges that are no node."""
    return edges.select(F.col(end).alias("node_id")).distinct().join(nodes.select("node_id"), "node_id", "left_anti")


def endpoint_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with source_type and target_type, null where an end is no node."""
    kinds = nodes.select("node_id", "node_type")
    a = kinds.select(F.col("node_id").alias("source_id"), F.col("node_type").alias("source_type"))
    b = kinds.select(F.col("node_id").alias("target_id"), F.col("node_type").alias("target_type"))
    return edges.join(a, "source_id", "left").join(b, "target_id", "left")


def typed_edges(nodes: DataFrame, edges: DataFrame, schema: DataFrame) -> DataFrame:
    """Edges with both ends' actual types and whether schema(relation, source_type, target_type) has the triplet."""
    known = schema.select("relation", "source_type", "target_type", F.lit(True).alias("_known"))
    typed = endpoint_types(nodes, edges).join(known, ["relation", "source_type", "target_type"], "left")
    return typed.withColumn("schema_mismatch", F.col("_known").isNull()).drop("_known")


def missing_nodes(nodes: DataFrame, referenced: DataFrame, node_type: str) -> DataFrame:
    """nodes(node_id, node_type, label) and a row for every referenced(node_id) that they lack."""
    lack = referenced.select("node_id").where("node_id is not null").distinct().join(nodes, "node_id", "left_anti")
    return nodes.unionByName(lack.select("node_id", F.lit(node_type).alias("node_type"), F.col("node_id").alias("label")))


def inherit(items: DataFrame, direct: DataFrame, parents: DataFrame) -> DataFrame:
    """(item, value): own values; items without any take their parents', else their children's (J21, one hop only).

    direct(item, value); parents(item, parent).
    """
    own = direct.join(items.select("item"), "item", "left_semi").select("item", "value").distinct()
    lack = items.select("item").distinct().join(own, "item", "left_anti")
    values = direct.select(F.col("item").alias("_of"), "value")
    up = lack.join(parents, "item").join(values, F.col("parent") == F.col("_of")).select("item", "value").distinct()
    lack = lack.join(up, "item", "left_anti")
    down = lack.join(parents.select(F.col("parent").alias("item"), F.col("item").alias("_child")), "item")
    down = down.join(values, F.col("_child") == F.col("_of")).select("item", "value").distinct()
    return own.unionAll(up).unionAll(down)


#: Characters of a gram of the containment join; shorter texts are one gram.
GRAM = 3


def contained_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small, large): distinct texts of small(t) and the texts of large(t) that contain them.

    large is indexed by its texts' grams. A small text waits at that of its own grams which fewest
    large texts have, and only texts that have it are searched for the small one. A text with a gram
    that no large text has is nowhere. The empty text, which has no gram, must not be among small.
    """
    size = F.least(F.length("t"), F.lit(GRAM))
    windows = lambda n: F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda k: F.substring(F.col("t"), k, n))
    tiny = [F.when(F.length("t") >= n, windows(F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)]
    index = large.select("t", F.explode(F.array_distinct(F.concat(*tiny))).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    needed = small.where("t <> ''").select("t", F.explode(F.array_distinct(windows(size))).alias("gram"))
    rarest = needed.join(often, "gram", "left").groupBy("t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    waits = rarest.where("least.n > 0").select(F.col("t").alias("small"), "least.gram")
    return waits.join(index.select("gram", F.col("t").alias("large")), "gram").where(F.col("large").contains(F.col("small"))).select("small", "large")


def contains_match(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right): for each name the least name that contains it or is contained in it, letter case ignored.

    An empty name is contained in all. Nulls match nothing.
    """
    x = a.select(F.col(left).alias("x"), F.lower(left).alias("t")).where("x is not null").distinct()
    y = b.select(F.col(right).alias("y"), F.lower(right).alias("t")).where("y is not null").distinct()
    low = y.groupBy("t").agg(F.min("y").alias("y"))  # names alike but for letter case
    inner = contained_pairs(low.select("t"), x.select("t").distinct()).select(F.col("large").alias("t"), F.col("small").alias("other"))
    outer = contained_pairs(x.select("t").distinct(), low.select("t")).select(F.col("small").alias("t"), F.col("large").alias("other"))
    named = inner.unionAll(outer).join(low.select(F.col("t").alias("other"), "y"), "other").groupBy("t").agg(F.min("y").alias("y"))
    least = low.agg(F.min("y").alias("least"), F.min(F.when(F.col("t") == "", F.col("y"))).alias("blank"))  # one row
    found = x.join(named, "t", "left").crossJoin(F.broadcast(least))
    every = F.when(F.col("t") == "", F.col("least")).otherwise(F.least("y", "blank"))
    return found.select(F.col("x").alias(left), every.alias(right)).where(F.col(right).isNotNull())


def two_routes(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of either route, once."""
    return first.select(columns).unionByName(second.select(columns)).distinct()
