"""Nodes and edges from source tables, driven by configuration rows; unnesting of raw records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import site_id
from .dedup import fold_values, scalar_or_list
from .ranges import places

# Relation names of hierarchy records.
SUBSUMPTION = (("ancestor", "child_of"), ("descendant", "parent_of"), ("subsumes", "subsumes"), ("subsumedby", "subsumed_by"))
NODE_COLUMNS = ("node_id", "node_type", "label", "sequence")


@dataclass(frozen=True)
class Entity:
    """How a table becomes nodes: its id column, type, label and sequence."""

    table: str
    node_type: str
    key: str
    label: str | None = None
    sequence: str | None = None
    prefix: str = ""


@dataclass(frozen=True)
class Relation:
    """How a table becomes edges: its end columns and relation."""

    table: str
    relation: str
    source: str
    target: str
    source_prefix: str = ""
    target_prefix: str = ""


def build_nodes(tables: dict[str, DataFrame], entities: list[Entity]) -> DataFrame:
    """(node_id, node_type, label, sequence, ord) of every row of every entity; ord keeps the order of entities.

    A null label becomes the id, null sequences stay null.
    """

    def rows(k: int, e: Entity) -> DataFrame:
        key = F.concat(F.lit(e.prefix), F.col(e.key).cast("string"))
        label = F.coalesce(F.col(e.label).cast("string"), key) if e.label else key
        sequence = F.col(e.sequence).cast("string") if e.sequence else F.lit(None).cast("string")
        out = tables[e.table].where(F.col(e.key).isNotNull())
        return out.select(key.alias("node_id"), F.lit(e.node_type).alias("node_type"), label.alias("label"), sequence.alias("sequence"), F.lit(k).alias("ord"))

    return reduce(DataFrame.unionByName, (rows(k, e) for k, e in enumerate(entities)))


def build_edges(tables: dict[str, DataFrame], relations: list[Relation]) -> DataFrame:
    """(source_id, target_id, relation) of every row of every relation; rows with a null end are left out."""

    def rows(r: Relation) -> DataFrame:
        out = tables[r.table].where(F.col(r.source).isNotNull() & F.col(r.target).isNotNull())
        return out.select(
            F.concat(F.lit(r.source_prefix), F.col(r.source).cast("string")).alias("source_id"),
            F.concat(F.lit(r.target_prefix), F.col(r.target).cast("string")).alias("target_id"),
            F.lit(r.relation).alias("relation"),
        )

    return reduce(DataFrame.unionByName, map(rows, relations))


def union_ids(*sources: tuple[DataFrame, str]) -> DataFrame:
    """(id): the distinct ids of several columns."""
    return reduce(DataFrame.unionAll, (df.select(F.col(c).cast("string").alias("id")) for df, c in sources)).where("id is not null").distinct()


def unnest_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, id, name) of `id|name;id|name` texts; items without | are skipped, only the first | parts."""
    items = df.select(F.col(key), F.explode(F.split(F.col(column), ";")).alias("_item")).where(F.col("_item").contains("|"))
    at = F.locate("|", F.col("_item"))
    return items.select(
        key, F.trim(F.col("_item").substr(F.lit(1), at - 1)).alias("id"), F.trim(F.col("_item").substr(at + 1, F.length("_item"))).alias("name")
    ).where("id <> ''")


def unnest_list(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, item) of `a;b` texts, blank items left out."""
    items = df.select(F.col(key), F.explode(F.split(F.col(column), ";")).alias("item"))
    return items.withColumn("item", F.trim("item")).where("item <> ''")


def unnest_records(df: DataFrame, key: str, column: str, *fields: Column | str) -> DataFrame:
    """key and fields of each struct of an array column, named `r` within fields."""
    return df.select(F.col(key), F.explode(F.col(column)).alias("r")).select(key, *fields)


def enzyme_relation(gene: Column, protein_name: Column) -> Column:
    """consumed_by where the name says hydrolase or the gene symbol holds `ase`, else produced_by."""
    eats = F.lower(protein_name).contains("hydrolase") | F.lower(gene).contains("ase")
    return F.when(F.coalesce(eats, F.lit(False)), "consumed_by").otherwise("produced_by")


def subsumption_relation(kind: Column) -> Column:
    """Relation of a hierarchy record, null for kinds that are dropped."""
    return F.coalesce(*(F.when(F.lower(kind) == a, F.lit(b)) for a, b in SUBSUMPTION))


def reaction_edges(df: DataFrame, item: str, records: str) -> DataFrame:
    """(reaction_id, target_id, relation) of residue records {id, name, attachedby} whose attachedby is `rxn.…`."""
    r = unnest_records(df, item, records, F.col("r.attachedby").alias("reaction_id")).where(F.col("reaction_id").startswith("rxn."))
    catalyst = r.select("reaction_id", F.expr("substring(reaction_id, 5)").alias("target_id"), F.lit("catalyzed_by").alias("relation"))
    product = r.select("reaction_id", F.col(item).alias("target_id"), F.lit("has_product").alias("relation"))
    return catalyst.unionAll(product).distinct()


def renamed_distinct(df: DataFrame, **columns: str) -> DataFrame:
    """The distinct rows of some columns under new names (B1, B4): new=old."""
    return df.select(*(F.col(old).alias(new) for new, old in columns.items())).distinct()


def compounds_and_edges(activities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compounds (compound_id, name) once each, and every enzyme-compound row."""
    compounds = renamed_distinct(activities, compound_id="compound_chembl_id", name="compound_name")
    names = {"enzyme_id": "enzyme_uniprot_id", "compound_id": "compound_chembl_id", "type": "type", "value": "value", "units": "units"}
    return compounds, activities.select(*(F.col(old).alias(new) for new, old in names.items()))


def folded(df: DataFrame, keys: list[str], metadata: str, order: str) -> DataFrame:
    """(keys, metadata): maps folded field by field into one JSON object a key, fields by name.

    A field with one distinct value has it, one with several a list in the order of first arrival.
    """
    fields = df.select(*keys, F.col(order), F.explode(F.col(metadata)).alias("_name", "_value"))
    each = fold_values(fields, keys, "_name", "_value", order)
    text = F.concat(F.lit('"'), F.col("_name"), F.lit('": '), scalar_or_list(F.col("values")))
    joined = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_name", text.alias("text")))).alias("_all"))  # a key has few fields
    return joined.select(*keys, F.concat(F.lit("{"), F.array_join(F.transform("_all", lambda x: x["text"]), ", "), F.lit("}")).alias("metadata"))


def _site_rows(sources: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(uniprot_id, site_position, site_residue, site, entries, at) of every usable row; entries: the named fields that are there."""

    def rows(k: int, name: str, df: DataFrame, fields: list[str]) -> DataFrame:
        good = (F.coalesce("uniprot_id", F.lit("")) != "") & F.col("site_position").isNotNull() & (F.coalesce("site_residue", F.lit("")) != "")
        entry = lambda n, c: F.struct(F.lit(n).alias("key"), c.cast("string").alias("value"))
        entries = F.array(entry("source", F.lit(name)), *(entry(f, F.col(f)) for f in fields))
        site = site_id(F.col("uniprot_id"), F.col("site_position").cast("int"), F.col("site_residue"))
        at = F.struct(F.lit(k).alias("source"), F.col("ord").cast("long").alias("ord"))
        out = df.where(good).select("uniprot_id", F.col("site_position").cast("int").alias("site_position"), "site_residue", site.alias("site"), F.filter(entries, lambda e: e["value"].isNotNull()).alias("entries"), at.alias("at"))
        return out.where("site is not null")

    return reduce(DataFrame.unionByName, (rows(k, *s) for k, s in enumerate(sources)))


def site_nodes(sources: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(node_id, node_type, label, metadata) of sites that several sources name.

    sources: (name, rows, metadata fields); rows have uniprot_id, site_position, site_residue and
    ord. Rows without one of the three are left out. The first to name a site, by source and ord,
    gives its label; metadata of all, with the source, position and residue, is folded.
    """
    rows = _site_rows(sources)
    own = lambda n, c: F.struct(F.lit(n).alias("key"), F.col(c).cast("string").alias("value"))
    entries = F.concat("entries", F.array(own("position", "site_position"), own("residue", "site_residue")))
    label = F.concat("uniprot_id", F.lit(":"), "site_residue", F.col("site_position").cast("string"))
    labels = rows.groupBy(F.col("site").alias("node_id")).agg(F.min_by(label, "at").alias("label"))
    meta = folded(rows.select(F.col("site").alias("node_id"), F.map_from_entries(entries).alias("m"), "at"), ["node_id"], "m", "at")
    return labels.join(meta, "node_id").select("node_id", F.lit("site").alias("node_type"), "label", "metadata")


def site_edges(sources: list[tuple[str, DataFrame, list[str]]], proteins: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, metadata): has_site from each site's protein.

    The protein is the id itself, its base or base-1, whichever proteins(node_id) has first; rows
    without one are left out. Metadata of repeated edges is folded.
    """
    from .joins import resolve_ids

    rows = resolve_ids(_site_rows(sources), "uniprot_id", proteins).where("resolved is not null")
    edges = rows.select(F.col("resolved").alias("source_id"), F.col("site").alias("target_id"), F.lit("has_site").alias("relation"), F.map_from_entries("entries").alias("m"), "at")
    return folded(edges, ["source_id", "target_id", "relation"], "m", "at")


def crosstalk_edges(df: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, score) between sites; a null score is 0."""
    return df.select(F.col("site1").alias("source_id"), F.col("site2").alias("target_id"), F.lit("ptm_crosstalk").alias("relation"), F.coalesce("score", F.lit(0.0)).alias("score"))


def dense_index(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """nodes with `idx`, from 0 within each type, and `global_id`, which goes on over the sorted types.

    Places are counted in ranges of (type, order), so a type with most nodes is not numbered by one
    task; ids in `order` must be unique within a type.
    """
    from pyspark.sql import Window as W

    types = nodes.groupBy("node_type").agg(F.count("*").alias("_t"))
    offsets = types.select("node_type", F.coalesce(F.sum("_t").over(W.orderBy("node_type").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))  # one row a type
    out = places(nodes, ["node_type"], [order], "_place").join(offsets, "node_type")
    out = out.withColumn("idx", F.col("_place") - 1)
    return out.withColumn("global_id", F.col("_off") + F.col("idx")).drop("_place", "_off")


def global_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(h, r, t): global node ids and the place of each (source type, relation, target type) in sorted order."""
    ids = dense_index(nodes).select("node_id", "node_type", "global_id")
    a = ids.select(F.col("node_id").alias("source_id"), F.col("node_type").alias("st"), F.col("global_id").alias("h"))
    b = ids.select(F.col("node_id").alias("target_id"), F.col("node_type").alias("tt"), F.col("global_id").alias("t"))
    joined = edges.join(a, "source_id").join(b, "target_id")
    from pyspark.sql import Window as W

    kinds = joined.select("st", "relation", "tt").distinct()
    numbered = kinds.withColumn("r", F.row_number().over(W.orderBy("st", "relation", "tt")) - 1)  # one row a triplet
    return joined.join(F.broadcast(numbered), ["st", "relation", "tt"]).select("h", "r", "t")
