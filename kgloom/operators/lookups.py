"""Filters, lookups and small joins by which datasets are cut out of the graph's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import Scratch


def whitelisted(df: DataFrame, key: str, whitelist: DataFrame | None, column: str = "id") -> DataFrame:
    """df with the keys of a whitelist only; None is no filter, a whitelist without its column an error."""
    if whitelist is None:
        return df
    if column not in whitelist.columns:
        raise ValueError(f"the whitelist has no column {column}")
    return df.join(whitelist.select(F.col(column).alias(key)), key, "left_semi")


#: Accessions of a gene that stand in one row, about; parts that a gene's rows of expression are dealt into; tasks.
PACK, TURNS, TASKS = 1024, 32, 128


def mapped_expression(expression: DataFrame, mapping: DataFrame, nodes: DataFrame) -> DataFrame:
    """expression(gene, ...) with each accession of mapping(gene, node_id) that nodes(node_id) has.

    Accessions are filtered before the join and packed, so that no row of the result is moved or
    sorted: it may have many times the rows of both tables.
    """
    known = mapping.select("gene", "node_id").where("gene is not null").join(nodes.select("node_id"), "node_id", "left_semi")
    sizes = known.groupBy("gene").agg(F.ceil(F.count("*") / PACK).alias("_packs"))
    pack = F.pmod(F.xxhash64("node_id"), F.col("_packs")).alias("_pack")
    packs = known.join(sizes, "gene").groupBy("gene", pack).agg(F.collect_list("node_id").alias("_ids"))
    each = packs.select("gene", "_ids", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("_turn"))
    dealt = expression.where("gene is not null").withColumn("_turn", F.pmod(F.xxhash64(*(c for c in expression.columns)), F.lit(TURNS)).cast("int"))
    tasks = max(TASKS, int(expression.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # asked for, they stay: input is little, output much
    met = dealt.repartition(tasks, "gene", "_turn").join(each.repartition(tasks, "gene", "_turn"), ["gene", "_turn"])
    return met.select(F.explode("_ids").alias("node_id"), *expression.columns)


def annotated(ids: DataFrame, key: str, *annotations: tuple[DataFrame, str]) -> DataFrame:
    """ids whose key occurs in any of the annotation tables, each given with its key column."""
    seen = reduce(DataFrame.unionAll, (a.select(F.col(c).alias(key)) for a, c in annotations))
    return ids.join(seen, key, "left_semi")


def neighbour_types(matches: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_type): the distinct types of the nodes next to matches(node_id)."""
    ends = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other")).unionAll(edges.select("target_id", "source_id"))
    near = ends.join(matches.select("node_id"), "node_id", "left_semi").select(F.col("other").alias("node_id"))
    return nodes.join(near, "node_id", "left_semi").select("node_type").distinct()


def with_type(df: DataFrame, key: str, types: DataFrame, name: str = "node_type", missing: str | None = None) -> DataFrame:
    """df with the type of its key from types(node_id, node_type), or `missing`."""
    of = types.select(F.col("node_id").alias(key), F.col("node_type").alias(name))
    out = df.join(of, key, "left")
    return out.withColumn(name, F.coalesce(name, F.lit(missing))) if missing else out


def edge_kinds(edges: DataFrame, kinds: DataFrame, keep: bool = True) -> DataFrame:
    """Edges whose (source_type, relation, target_type) is among kinds, or is not."""
    return edges.join(kinds.select("source_type", "relation", "target_type"), ["source_type", "relation", "target_type"], "left_semi" if keep else "left_anti")


def lookup(df: DataFrame, key: str, value, order: list[Column | str], k: int | None = None, **equal) -> DataFrame:
    """The rows of one key, further columns equal to given values, in order, the first k."""
    out = reduce(lambda d, c: d.where(F.col(c) == F.lit(equal[c])), equal, df.where(F.col(key) == F.lit(value))).orderBy(*order)
    return out.limit(k) if k else out


def evidence(edges: DataFrame, node_id: str, relations: list[str]) -> DataFrame:
    """Edges of some relations that touch an id."""
    return edges.where(((F.col("source_id") == node_id) | (F.col("target_id") == node_id)) & F.col("relation").isin(relations))


def first_part(column: Column, separator: str = ";") -> Column:
    """The first item of a joined list (P20)."""
    return F.trim(F.get(F.split(column, separator), F.lit(0)))


def type_contains(column: Column, part: str) -> Column:
    """Whether a type names a part; false without a type."""
    return F.coalesce(column.contains(part), F.lit(False))


def least_terms(df: DataFrame, key: str, term: str) -> DataFrame:
    """(key, term, n): a key's terms fold into the lexicographically first."""
    return df.groupBy(key).agg(F.min(term).alias(term), F.countDistinct(term).alias("n"))


def stacked(tables: list[DataFrame], rename: list[dict[str, str]], columns: list[str]) -> DataFrame:
    """Mapping tables under one set of columns, trimmed, blank keys left out, each row once."""

    def one(df: DataFrame, names: dict[str, str]) -> DataFrame:
        out = df.select(*(F.trim(F.col(names.get(c, c)).cast("string")).alias(c) for c in columns))
        return out.where(F.col(columns[0]) != "")

    return reduce(DataFrame.unionByName, map(one, tables, rename)).distinct()


def participants(edges: DataFrame, relation: str) -> DataFrame:
    """(node_id): every node at either end of a relation."""
    own = edges.where(F.col("relation") == relation)
    return own.select(F.col("source_id").alias("node_id")).unionAll(own.select("target_id")).distinct()


def class_index(df: DataFrame, terms: DataFrame, key: str, term: str, positive: str) -> DataFrame:
    """df with the rows of its terms(key, term, ...), `label`, 1 for the positive term and 0 for others, and `term_index`,
    its place among sorted terms (F32)."""
    from pyspark.sql import Window as W

    named = terms.select(term).distinct().where(F.col(term).isNotNull())
    index = named.withColumn("term_index", (F.row_number().over(W.orderBy(term)) - 1).cast("int"))  # one row a term
    of = terms.join(index, term)
    return df.join(of, key, "left").withColumn("label", F.when(F.col(term).isNotNull(), (F.col(term) == positive).cast("int")))


def with_inverses(schema: DataFrame) -> DataFrame:
    """(relation, inverse) in both directions of schema(relation, inverse); rows without one are left out."""
    known = schema.where(F.col("inverse").isNotNull()).select("relation", "inverse")
    return known.unionAll(known.select(F.col("inverse").alias("relation"), F.col("relation").alias("inverse"))).distinct()


def position_code(position: Column, width: int) -> Column:
    """The sinusoidal code of a position: sine and cosine in turn, of wave lengths 10000 ** (2k / width)."""
    step = lambda k: position.cast("double") * (10000.0 ** (-2 * k / width))
    return F.array(*(f(step(k)) for k in range(width // 2) for f in (F.sin, F.cos)))


def structure_of(column: Column, metadata: Column, keys: list[str]) -> Column:
    """A structure from its own column, else from the first key that JSON metadata has."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(filled(column), *(filled(F.get_json_object(metadata, f"$.{k}")) for k in keys))


def site_positions(sites: DataFrame, proteins: DataFrame) -> DataFrame:
    """(node_id, positions): 0-based places of sites(protein_id, position) on each protein, by id, else by its base."""
    from .joins import resolve_ids

    of = resolve_ids(sites, "protein_id", proteins, ("exact", "base")).where("resolved is not null")
    places = of.select(F.col("resolved").alias("node_id"), (F.col("position") - 1).alias("at")).distinct()
    return places.groupBy("node_id").agg(F.sort_array(F.collect_list("at")).alias("positions"))  # a protein has few sites


def pair_features(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with `features`: the two ends' vectors in one; pairs without both are left out."""
    one = vectors.select(F.col("node_id").alias(a), F.col("vector").alias("_a"))
    two = vectors.select(F.col("node_id").alias(b), F.col("vector").alias("_b"))
    return pairs.join(one, a).join(two, b).withColumn("features", F.concat("_a", "_b")).drop("_a", "_b")


def in_graph(df: DataFrame, mapping: DataFrame, nodes: DataFrame) -> DataFrame:
    """df(gene, ...) with its node_id by mapping, null without one, and whether the graph has it."""
    known = nodes.select("node_id", F.lit(True).alias("in_graph"))
    return df.join(mapping.select("gene", "node_id"), "gene", "left").join(known, "node_id", "left").withColumn("in_graph", F.coalesce("in_graph", F.lit(False)))


def mean_over(scores: DataFrame, key: str, n: int, value: str = "score") -> DataFrame:
    """(key, score): the sum over contexts divided by the number of all, absent ones counting 0."""
    return scores.groupBy(key).agg((F.sum(value) / n).alias(value))


def string_features(text: Column, most: int = 116) -> Column:
    """128 values of a structure string: length, brackets, dashes and scaled codes of its first characters."""
    s = F.coalesce(text, F.lit(""))
    count = lambda c: F.length(s) - F.length(F.replace(s, F.lit(c)))
    heads = [F.length(s), *(count(c) for c in "[]()/-_*=,|")]
    codes = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.ascii(F.substring(s, k, F.lit(1))) / 128.0)
    return F.concat(F.array(*(h.cast("double") for h in heads)), codes)


def linkage_class(kind: Column) -> Column:
    """N-linked, O-linked or null by what a type names."""
    low = F.lower(kind)
    return F.when(low.contains("n-linked"), "N-linked").when(low.contains("o-linked"), "O-linked")


def metrics_by(ranks: DataFrame, by: str, least: int = 10) -> DataFrame:
    """(by, n, mrr, hits_10) of groups of at least `least` ranks."""
    out = ranks.groupBy(by).agg(F.count("*").alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") <= 10).cast("double")).alias("hits_10"))
    return out.where(F.col("n") >= least)


def tissue_cells(expression: DataFrame, tissue: str) -> DataFrame:
    """(cell_type, value) means of the rows of a tissue, letter case ignored."""
    return expression.where(F.lower("tissue") == tissue.lower()).groupBy("cell_type").agg(F.avg("value").alias("value"))


def benchmark_table(results: DataFrame, record: str, fields: dict[str, tuple[str, ...]], default: float = 0.0) -> DataFrame:
    """One row a result of nested JSON: each field from the first of its paths that is there, else a default."""
    found = {n: F.coalesce(*(F.get_json_object(record, f"$.{p}").cast("double") for p in paths), F.lit(default)) for n, paths in fields.items()}
    return results.withColumns(found).drop(record)


def sequence_of(df: DataFrame, key: str, sequences: DataFrame) -> DataFrame:
    """df with the sequence of its id, its base or the base's first isoform, in this order."""
    from .joins import resolve_ids

    of = sequences.select(F.col("node_id").alias("resolved"), "sequence")
    return resolve_ids(df, key, sequences).join(of, "resolved", "left")


def jaccard(sets: DataFrame, key: str, item: str, least: float = 0.0) -> DataFrame:
    """(a, b, jaccard) of keys a < b that share an item (X14); pairs that share none have 0 and no row.

    Where items are so common that a join by item has more rows than there are pairs to look at, blocks
    of sets meet instead; both ways count all shared items of all pairs.
    """
    from .blocks import set_pairs

    known = sets.select(F.col(key).alias("key"), F.col(item).alias("feature")).where("key is not null and feature is not null").distinct()
    known = Scratch(sets.sparkSession, "jaccard").save(known, "sets")
    lone = sets.where(F.col(item).isNull()).select(F.col(key).alias("key"))
    pairs = set_pairs(known, least) if lone.isEmpty() else None  # a null is shared with none but counts in a set's size
    if pairs is not None:
        return pairs
    one = known.select(F.col("key").alias("a"), F.col("feature").alias(item)).unionByName(lone.distinct().select(F.col("key").alias("a"), F.lit(None).cast(known.schema["feature"].dataType).alias(item)))
    sizes = one.groupBy("a").agg(F.count("*").alias("_n"))
    both = one.join(one.select(F.col("a").alias("b"), item), item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("_s"))
    out = both.join(sizes, "a").join(sizes.select(F.col("a").alias("b"), F.col("_n").alias("_m")), "b")
    out = out.select("a", "b", (F.col("_s") / (F.col("_n") + F.col("_m") - F.col("_s"))).alias("jaccard"))
    return out.where(F.col("jaccard") >= least)


def composition_scores(items: DataFrame, references: DataFrame, weights: DataFrame, popularity: DataFrame, alpha: float) -> DataFrame:
    """(item, score): the best cosine times weight over reference compositions, blended with popularity (X11).

    items and references: (item or ref, kind, n), counts by kind; weights(ref, weight); popularity(item, popularity).
    """
    length = lambda df, k: df.groupBy(k).agg(F.sqrt(F.sum(F.col("n") ** 2)).alias(f"_l{k}"))
    dot = items.join(references.select("ref", "kind", F.col("n").alias("_m")), "kind").groupBy("item", "ref").agg(F.sum(F.col("n") * F.col("_m")).alias("_d"))
    cosine = dot.join(length(items, "item"), "item").join(length(references, "ref"), "ref").join(weights, "ref")
    best = cosine.groupBy("item").agg(F.max(F.col("_d") / (F.col("_litem") * F.col("_lref")) * F.col("weight")).alias("_best"))
    out = popularity.join(best, "item", "left")
    return out.select("item", (alpha * F.coalesce("_best", F.lit(0.0)) + (1 - alpha) * F.col("popularity")).alias("score"))


def k_means(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """df with `cluster` by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fit = df.withColumn("_v", array_to_vector(F.col(vector)))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(fit).transform(fit).drop("_v")


def principal_axes(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """df with `projection` on its k principal axes (X16; other projections are only for display)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    fit = df.withColumn("_v", array_to_vector(F.col(vector)))
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(fit).transform(fit)
    return out.withColumn("projection", vector_to_array("_p")).drop("_v", "_p")
