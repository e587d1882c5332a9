"""Filter chains: the first rule in order that a row fails rejects it, and every rejection is counted in the same pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.text import best_evidence, canonical_accession, glyco_type, is_canonical, is_uncertain, position_of_range, residue_fits
from ..scratch import Scratch
from .dedup import first_by

# The residues, and the evidence codes that a feature may have.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


@dataclass(frozen=True)
class Rule:
    """A row that `passes` is not true for is rejected for `reason`."""

    reason: str
    passes: Column


@dataclass(frozen=True)
class Among:
    """A row is rejected for `reason` unless each of its `keys` is in allowed(column); no or an empty table allows all."""

    reason: str
    keys: tuple[str, ...]
    allowed: DataFrame | None
    column: str


@dataclass(frozen=True)
class Once:
    """Of the rows that pass all rules, the first of each key in an order stays; the others are rejected for `reason`."""

    reason: str
    keys: tuple[str, ...]
    order: tuple[str, ...]


@dataclass(frozen=True)
class Filtered:
    """What a chain leaves, as a written table, and how many rows each reason rejected, in order."""

    kept: DataFrame
    counts: dict[str, int]

    def report(self) -> DataFrame:
        """(place, reason, n), with the rows read first and those kept last."""
        rows = [(k, *x) for k, x in enumerate(self.counts.items())]
        return self.kept.sparkSession.createDataFrame(rows, "place int, reason string, n long")


def filter_chain(df: DataFrame, rules: list[Rule | Among | Once], name: str = "chain") -> Filtered:
    """df through the rules in order, written once; counters are observed as the rows pass.

    Rules of one reason count together. Allowed tables meet the rows by semi joins on their distinct
    keys, so rules after one that rejected a row never see it in the counts, as in a loop over rows.
    A Once, if there is one, must come last.
    """
    scratch = Scratch(df.sparkSession, name)
    once = rules[-1] if rules and isinstance(rules[-1], Once) else None
    cases, flagged = [], df
    for k, rule in enumerate(r for r in rules if r is not once):
        if isinstance(rule, Rule):
            cases.append(F.when(~F.coalesce(rule.passes, F.lit(False)), F.lit(rule.reason)))
            continue
        if rule.allowed is None or rule.allowed.select(rule.column).isEmpty():
            continue
        ok = []
        for i, key in enumerate(rule.keys):
            there = f"_among{k}_{i}"
            known = rule.allowed.select(F.col(rule.column).alias(f"_key{k}_{i}")).distinct().withColumn(there, F.lit(True))
            flagged = flagged.join(known, F.col(key) == F.col(f"_key{k}_{i}"), "left")
            ok.append(F.coalesce(there, F.lit(False)))
        cases.append(F.when(~reduce(Column.__and__, ok), F.lit(rule.reason)))
    seen, left = Observation(f"{name}-seen"), Observation(f"{name}-left")
    reason = F.coalesce(*cases, F.lit(None).cast("string")) if cases else F.lit(None).cast("string")
    reasons = list(dict.fromkeys(r.reason for r in rules if r is not once))
    sums = [F.count("*").alias("n"), *(F.count_if(F.col("_reason") == r).alias(f"r{k}") for k, r in enumerate(reasons))]
    passed = flagged.withColumn("_reason", reason).observe(seen, *sums).where("_reason is null").select(df.columns)
    if once:
        passed = first_by(passed, list(once.keys), list(once.order))
    kept = scratch.save(passed.observe(left, F.count("*").alias("n")), "kept")
    counted, n_kept = seen.get, left.get["n"]
    counts = {"read": counted["n"], **{r: counted[f"r{k}"] for k, r in enumerate(reasons)}}
    if once:
        counts[once.reason] = counted["n"] - sum(counts[r] for r in reasons) - n_kept
    return Filtered(kept, {**counts, "kept": n_kept})


def ptm_sites(raw: DataFrame, proteins: DataFrame | None, least: float) -> Filtered:
    """Modification sites (P5): score, id, isoform, protein, residue and position, then each site once.

    raw(uniprot_id, site_position, site_residue, ptm_type, score, ord); proteins(protein_id) or None.
    A row without a score passes and has 1. The id becomes canonical; first come by ord.
    """
    whole = raw.select(
        canonical_accession(F.col("uniprot_id")).alias("uniprot_id"),
        F.col("site_position").cast("int").alias("site_position"),
        "site_residue",
        F.coalesce("ptm_type", F.lit("")).alias("ptm_type"),
        F.nanvl(F.col("score").cast("double"), F.lit(None)).alias("score"),
        F.lit("PTMCode").alias("source"),
        "ord",
    )
    residue = (F.length("site_residue") == 1) & F.lit(RESIDUES).contains(F.col("site_residue"))
    done = filter_chain(
        whole,
        [
            Rule("score", F.coalesce(F.col("score") >= least, F.lit(True))),
            Rule("no id", F.length("uniprot_id") > 0),
            Rule("isoform", is_canonical(F.col("uniprot_id"))),
            Among("protein", ("uniprot_id",), proteins, "protein_id"),
            Rule("residue or position", residue),
            Rule("residue or position", F.col("site_position") >= 1),
            Once("duplicate", ("uniprot_id", "site_position", "site_residue"), ("ord",)),
        ],
        "ptm-sites",
    )
    return Filtered(done.kept.withColumn("score", F.coalesce("score", F.lit(1.0))).drop("ord"), done.counts)


def ptm_edges(raw: DataFrame, proteins: DataFrame | None, least: float) -> Filtered:
    """Pairs of modification sites (P6): score, both ids, both proteins, both positions, each unordered pair once.

    raw has uniprot_id, site_position, residue and ptm_type with _a and _b, score, edge_type, ord.
    """
    side = lambda s, n: [
        canonical_accession(F.col(f"uniprot_id_{s}")).alias(f"site{n}_uniprot"),
        F.col(f"site_position_{s}").cast("int").alias(f"site{n}_position"),
        F.coalesce(f"residue_{s}", F.lit("")).alias(f"site{n}_residue"),
        F.coalesce(f"ptm_type_{s}", F.lit("")).alias(f"site{n}_ptm_type"),
    ]
    score = F.nanvl(F.col("score").cast("double"), F.lit(None)).alias("score")
    whole = raw.select(*side("a", 1), *side("b", 2), score, F.coalesce("edge_type", F.lit("unknown")).alias("edge_type"), F.lit("PTMCode").alias("source"), "ord")
    one, two = (F.struct(*(F.col(f"site{n}_{c}").alias(c) for c in ("uniprot", "position", "residue"))) for n in (1, 2))
    whole = whole.withColumns({"_lo": F.least(one, two), "_hi": F.greatest(one, two)})
    done = filter_chain(
        whole,
        [
            Rule("score", F.coalesce(F.col("score") >= least, F.lit(True))),
            Rule("site", (F.length("site1_uniprot") > 0) & (F.length("site2_uniprot") > 0)),
            Among("protein", ("site1_uniprot", "site2_uniprot"), proteins, "protein_id"),
            Rule("site", F.col("site1_position").isNotNull() & F.col("site2_position").isNotNull()),
            Once("duplicate", ("_lo", "_hi"), ("ord",)),
        ],
        "ptm-edges",
    )
    return Filtered(done.kept.withColumn("score", F.coalesce("score", F.lit(1.0))).drop("ord", "_lo", "_hi"), done.counts)


def known_site_edges(edges: DataFrame, sites: DataFrame | None, least: float) -> Filtered:
    """Edges (source_id, target_id, score) of a loader (P7): the score, then both ends among sites(site_id), if any are known."""
    ends = Among("site", ("source_id", "target_id"), sites, "site_id")
    return filter_chain(edges, [Rule("score", F.col("score") >= least), ends], "site-edges")


def sequence_features(features: DataFrame, allowed: list[str]) -> Filtered:
    """Glycosylation sites of sequence features (P9): type, description, evidence, position, residue.

    features(uniprot_id, type, description, codes, start, end, start_kind, end_kind, sequence). The
    residue is the sequence's at the position; a position beyond it has none and passes.
    """
    position = position_of_range(F.col("start"), F.col("end"), F.col("start_kind"), F.col("end_kind"))
    residue = F.when(F.col("position") <= F.length("sequence"), F.substring("sequence", F.col("position"), F.lit(1))).otherwise(F.lit(""))
    whole = features.withColumns({"position": position, "evidence": best_evidence(F.col("codes"), F.array(*map(F.lit, allowed))), "kind": glyco_type(F.col("description"))})
    whole = whole.withColumn("residue", F.coalesce(residue, F.lit("")))
    done = filter_chain(
        whole,
        [
            Rule("type", F.col("type") == "Glycosylation"),
            Rule("description", ~is_uncertain(F.col("description"))),
            Rule("evidence", F.col("evidence").isNotNull()),
            Rule("position", F.col("position").isNotNull()),
            Rule("residue", (F.col("residue") == "") | residue_fits(F.col("residue"), F.col("kind"))),
        ],
        "features",
    )
    return Filtered(done.kept.select("uniprot_id", "position", "residue", "kind", "evidence"), done.counts)
