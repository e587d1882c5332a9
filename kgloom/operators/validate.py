"""Integrity checks of a typed graph, as rows; and repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from ..functions.text import ID_PATTERNS, base_accession, first_of, has_id_format, is_canonical, parse_site_id
from ..scratch import Scratch
from .dedup import first_by
from .graph import component_sizes, cycle_nodes, degrees

SAMPLE = 10
# Relations that must have no cycle, the types that relations must join, those whose
# ids are checked, and the residues.
ACYCLIC = ("inhibits", "has_variant")
ENDPOINTS = (
    ("localized_in", ("protein", "enzyme"), ("cellular_location", "location")),
    ("has_site", ("protein", "enzyme"), ("site",)),
    ("ptm_crosstalk", ("site",), ("site",)),
)
ID_CHECKED = ("glycan", "enzyme", "protein", "compound", "cellular_location")
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def _ends(triples: DataFrame) -> DataFrame:
    """(node_id, n_in, n_out, e0, e1, ...): degrees, and how often an id is at each end that ENDPOINTS names."""
    end = lambda c, i, o: F.struct(F.col(c).alias("node_id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    each = triples.select("relation", "c", F.explode(F.array(end("source_id", 0, 1), end("target_id", 1, 0))).alias("e")).select("relation", "c", "e.*")
    sides = [F.sum(F.when((F.col("relation") == r) & (F.col(side) == 1), F.col("c")).otherwise(0)) for r, _, _ in ENDPOINTS for side in ("o", "i")]
    return each.groupBy("node_id").agg(F.sum(F.col("i") * F.col("c")).alias("n_in"), F.sum(F.col("o") * F.col("c")).alias("n_out"), *(x.alias(f"e{k}") for k, x in enumerate(sides)))


def _kinds(nodes: DataFrame) -> DataFrame:
    """One row a node id: its rows, whether it has the types that ENDPOINTS asks for, and what is wrong with it."""
    kind, id_ = F.col("node_type"), F.col("node_id")
    site = parse_site_id(id_)
    formed = (kind == "site") & id_.rlike(ID_PATTERNS["site"]) & site.isNotNull()
    metadata = F.trim("metadata") if "metadata" in nodes.columns else F.lit(None).cast("string")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    types = [F.max(F.coalesce(kind.isin(*t), F.lit(False))) for _, *both in ENDPOINTS for t in both]
    return nodes.groupBy("node_id").agg(
        F.count("*").alias("rows"),
        count(~F.coalesce(metadata, F.lit("")).isin("", "{}")).alias("described"),
        count(kind == "site").alias("sites"),
        F.max(F.coalesce(kind.isin("protein", "enzyme"), F.lit(False))).alias("protein"),
        *(count((kind == t) & ~has_id_format(id_, kind)).alias(f"bad_ids_{t}") for t in ID_CHECKED),
        count((kind == "site") & ~F.coalesce(formed, F.lit(False))).alias("site_format"),
        count(formed & ~is_canonical(site.accession)).alias("site_isoform"),
        count(formed & ~F.lit(RESIDUES).contains(site.residue)).alias("site_residue"),
        *(x.alias(f"t{k}") for k, x in enumerate(types)),
    )


def _unmapped(ids: DataFrame) -> DataFrame:
    """(check, id, n): sites whose accession, base or base-1 is no protein of the graph."""
    accession = parse_site_id(F.col("node_id")).accession
    base = base_accession(accession)
    sites = ids.where("sites > 0").withColumn("refs", F.array(accession, base, F.concat(base, F.lit("-1")))).where(accession.isNotNull())
    proteins = ids.where("protein").select(F.col("node_id").alias("ref"))
    found = sites.select("node_id", F.explode("refs").alias("ref")).join(proteins, "ref", "left_semi").select("node_id")
    return sites.join(found, "node_id", "left_anti").select(F.lit("unmapped_sites").alias("check"), F.col("node_id").alias("id"), F.col("sites").alias("n"))


def _findings(ids: DataFrame, triples: DataFrame) -> DataFrame:
    """(check, id, n): everything that is wrong, with the rows that each finding stands for."""
    there = lambda c: F.coalesce(c, F.lit(0))
    known = F.col("rows").isNotNull()
    no_ends = (there("n_in") + there("n_out")) == 0
    cases = {"orphans": F.when(known & no_ends, 1), "dangling_sources": F.when(~known & (there("n_out") > 0), 1), "dangling_targets": F.when(~known & (there("n_in") > 0), 1)}
    cases |= {f"bad_ids_{t}": F.col(f"bad_ids_{t}") for t in ID_CHECKED} | {c: F.col(c) for c in ("site_format", "site_isoform", "site_residue")}
    names = [f"{r}_{side}" for r, _, _ in ENDPOINTS for side in ("sources", "targets")]
    cases |= {n: F.when(~F.coalesce(f"t{k}", F.lit(False)), F.col(f"e{k}")) for k, n in enumerate(names)}
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for n, c in cases.items()))
    of_ids = ids.select(F.col("node_id").alias("id"), F.explode(F.filter(rows, lambda f: f["n"] > 0)).alias("f")).select("f.check", "id", "f.n")
    triple = F.concat_ws("|", "source_id", "relation", "target_id").alias("id")
    loops = triples.where("source_id = target_id").select(F.lit("self_loops").alias("check"), triple, F.col("c").alias("n"))
    copies = triples.where("c > 1").select(F.lit("duplicate_edges").alias("check"), triple, (F.col("c") - 1).alias("n"))
    cycles = [cycle_nodes(triples.where(F.col("relation") == r)).select(F.lit(f"cycle_{r}").alias("check"), F.col("node").alias("id"), F.lit(1).cast("long").alias("n")) for r in ACYCLIC]
    return reduce(DataFrame.unionByName, [loops, copies, _unmapped(ids), *cycles], of_ids)


def check_graph(nodes: DataFrame, edges: DataFrame, components: bool = True) -> DataFrame:
    """(place, check, severity, n, value, sample): every check's row, in order.

    Dangling ends and cycles are errors, what is only counted is info, all else a warning. n counts
    ids, or edges where edges are wrong, or node rows where those are; sample has the lowest ten ids.
    Degrees: n is the highest, value the mean of the ids that have one. metadata: n nodes have some,
    value percent, a warning below 50. components: n is their number, value the size of the largest.

    Edges and nodes are read once each. Edges become one row a triple, ends and nodes one row an id,
    both written once with the totals observed on the way; findings are read from those, and their
    samples are cut in every partition before they meet.
    """
    spark, scratch = nodes.sparkSession, Scratch(nodes.sparkSession, "report")
    of_edges, of_ids = Observation("edges"), Observation("ids")
    triples = edges.groupBy("source_id", "target_id", "relation").agg(F.count("*").alias("c"))
    triples = scratch.save(triples.observe(of_edges, F.coalesce(F.sum("c"), F.lit(0)).alias("n")), "triples")
    ids = _kinds(nodes).join(_ends(triples), "node_id", "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    known, degree = F.col("rows").isNotNull(), lambda c: F.when(F.col(c) > 0, F.col(c))
    sums = {"nodes": total("rows"), "described": total("described")}
    for c in ("in", "out"):
        d = degree(f"n_{c}")
        sums |= {f"{c}_least": F.min(d), f"{c}_most": F.max(d), f"{c}_mean": F.avg(d), f"{c}_none": F.count_if(known & (F.coalesce(f"n_{c}", F.lit(0)) == 0))}
    ids = scratch.save(ids.observe(of_ids, *(v.alias(k) for k, v in sums.items())), "ids")
    findings = scratch.save(_findings(ids, triples), "findings")
    t, n_edges = of_ids.get, of_edges.get["n"]
    n, pairs = t["nodes"], t["nodes"] * (t["nodes"] - 1)
    counted = {r.check: r.n for r in findings.groupBy("check").agg(F.sum("n").alias("n")).collect()}  # a row a check
    rows: list[tuple] = [("nodes", "info", n, None), ("edges", "info", n_edges, None), ("density", "info", None, n_edges / pairs if pairs else 0.0)]
    rows += [(f"nodes_{r[0]}", "info", r[1], None) for r in nodes.groupBy("node_type").count().orderBy("node_type").collect()]  # a row a type
    rows += [(f"edges_{r[0]}", "info", r[1], None) for r in triples.groupBy("relation").agg(F.sum("c")).orderBy("relation").collect()]
    found = lambda name, severity="warning": (name, severity, counted.get(name, 0), None)
    rows += [found("orphans"), found("duplicate_edges"), found("dangling_sources", "error"), found("dangling_targets", "error"), found("self_loops")]
    rows += [found(f"cycle_{r}", "error") for r in ACYCLIC]
    for c in ("in", "out"):
        rows += [(f"{c}_degree", "info", t[f"{c}_most"] or 0, t[f"{c}_mean"] or 0.0), (f"{c}_degree_least", "info", t[f"{c}_least"] or 0, None), (f"{c}_degree_zero", "info", t[f"{c}_none"], None)]
    if components:
        c = component_sizes(ids.where("rows is not null").select("node_id"), triples).agg(F.count("*"), F.max("size")).first()
        rows.append(("components", "warning" if c[0] > 1 else "info", c[0], float(c[1] or 0)))
    share = 100 * t["described"] / n if n else 0.0
    rows.append(("metadata", "warning" if n and share < 50 else "info", t["described"], round(share, 2)))
    rows += [found(f"bad_ids_{k}") for k in ID_CHECKED]
    rows += [found(f"localized_in_{side}") for side in ("sources", "targets")]
    rows += [found(c) for c in ("site_format", "site_isoform", "site_residue", "unmapped_sites")]
    rows += [found(f"{r}_{side}") for r in ("has_site", "ptm_crosstalk") for side in ("sources", "targets")]
    few = findings.withColumn("k", F.row_number().over(W.partitionBy("check").orderBy("id"))).where(F.col("k") <= SAMPLE)
    samples = few.groupBy("check").agg(F.array_sort(F.collect_list("id")).alias("sample"))  # ten a check
    report = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place int, check string, severity string, n long, value double")
    out = report.join(F.broadcast(samples), "check", "left")
    return out.select("place", "check", "severity", "n", "value", F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, directed and undirected density, degrees of nodes with edges."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("node_type").alias("n_types"))
    e = edges.agg(F.count("*").alias("n_edges"), F.countDistinct("relation").alias("n_relations"))
    d = degrees(edges).agg(
        F.min("n_in").alias("min_in"), F.max("n_in").alias("max_in"), F.min("n_out").alias("min_out"), F.max("n_out").alias("max_out"),
        F.avg(F.when(F.col("n_out") > 0, F.col("n_out"))).alias("avg_out"),
    )
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    density = F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(0.0)
    joined = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(d))  # one row each
    return joined.withColumns({"density": F.round(density, 6), "density_undirected": F.round(2 * density, 6), "avg_degree": 2 * F.col("n_edges") / F.col("n_nodes")})


def metadata_completeness(nodes: DataFrame) -> DataFrame:
    """(node_type, n, complete): percent of nodes whose metadata is neither blank nor {} (A5)."""
    real = ~F.coalesce(F.trim("metadata"), F.lit("")).isin("", "{}")
    return nodes.groupBy("node_type").agg(F.count("*").alias("n"), F.round(F.avg(real.cast("double")) * 100, 2).alias("complete"))


def quality_profile(df: DataFrame, required: list[str], key: str, good_id: Column | None = None) -> DataFrame:
    """(check, severity, n): missing columns are errors; nulls, repeated keys and bad ids warnings."""
    spark = df.sparkSession
    missing = [(f"missing_{c}", "error", 1) for c in required if c not in df.columns]
    there = [c for c in required if c in df.columns]
    aggs = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in there]
    if key in df.columns:
        aggs.append((F.count(key) - F.countDistinct(key)).alias("duplicates"))
        if good_id is not None:
            aggs.append(F.count_if(~F.coalesce(good_id, F.lit(False))).alias("bad_ids"))
    out = spark.createDataFrame(missing, "check string, severity string, n bigint")
    if aggs:
        wide = df.agg(*aggs)
        names = wide.columns
        pairs = F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in names))
        rows = wide.select(F.explode(pairs).alias("x")).select("x.check", F.lit("warning").alias("severity"), "x.n").where("n > 0")
        out = out.unionByName(rows)
    return out


def repair(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without repeated edges, self loops, dangling ends and orphans, in this order (V5)."""
    keys = ["source_id", "target_id", "relation"]
    e = first_by(edges, keys, [c for c in edges.columns if c not in keys] or keys).where("source_id <> target_id")
    ids = nodes.select("node_id")
    e = e.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    e = e.join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi").select(edges.columns)
    ends = e.select(F.col("source_id").alias("node_id")).unionAll(e.select("target_id"))
    return nodes.join(ends, "node_id", "left_semi"), e


def reject_reason(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with `reject_reason`: the first rule in order that a row fails, null if it passes all."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    return df.withColumn("reject_reason", F.coalesce(*failed))


def site_rules(evidence: str, accession: str, residue: str, position: str, allowed: list[str]) -> list[tuple[str, Column]]:
    """The site filter chain: evidence (blank passes), canonical isoform, residue, position."""
    blank = F.coalesce(F.col(evidence), F.lit("")) == ""
    return [
        ("evidence", blank | F.col(evidence).isin(allowed)),
        ("isoform", is_canonical(F.col(accession))),
        ("residue", (F.length(residue) == 1) & F.lit(RESIDUES).contains(F.upper(residue))),
        ("position", F.col(position).cast("string").try_cast("int") >= 1),
    ]


def association_score(a: str, b: str, threshold: float) -> Column:
    """The lower of two scores out of 100 reaches the threshold."""
    return F.least(F.col(a), F.col(b)) / 100 >= threshold


def human(tax_id: Column) -> Column:
    """Taxon 9606 or none (P10)."""
    return F.coalesce(first_of(tax_id), F.lit(9606)).cast("int") == 9606
