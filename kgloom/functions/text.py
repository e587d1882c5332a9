"""Identifiers, locations, labels and other text rules as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Compartments in the order in which they are tried.
LOCATION_RULES = (
    ("ER-Golgi intermediate", "LOC::er_golgi_intermediate"),
    ("trans-Golgi network", "LOC::trans_golgi_network"),
    ("trans-Golgi", "LOC::trans_golgi"),
    ("cis-Golgi", "LOC::cis_golgi"),
    ("medial-Golgi|medial Golgi", "LOC::medial_golgi"),
    ("Golgi", "LOC::golgi_apparatus"),
    ("endoplasmic reticulum", "LOC::endoplasmic_reticulum"),
    ("cell surface", "LOC::cell_surface"),
    ("cell membrane|plasma membrane", "LOC::cell_membrane"),
    ("extracellular|secreted", "LOC::extracellular"),
    ("lysosome", "LOC::lysosome"),
    ("endosome", "LOC::endosome"),
    ("cytoplasm|cytosol", "LOC::cytoplasm"),
    ("nucleus|nuclear", "LOC::nucleus"),
    ("mitochondri", "LOC::mitochondria"),
    ("peroxisome", "LOC::peroxisome"),
)

# Identifier grammars. The accession grammar is an alternation anchored at its start only.
ID_PATTERNS = {
    "glycan": r"^G\d{5}[A-Z]{2}$",
    "protein": r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}(-\d+)?$)",
    "enzyme": r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}(-\d+)?$)",
    "compound": r"^CHEMBL\d+$",
    "site": r"^SITE::[A-Z0-9]+-?\d*::\d+::[A-Z]$",
    "location": r"^LOC::[a-z_]+$",
    "cellular_location": r"^LOC::[a-z_]+$",
    "reaction": r"^rxn\..+",
    "motif": r"^GGM\.\d+$",
}

# Words that mark a description as uncertain, and glycosylation types by description.
UNCERTAIN = ("by similarity", "potential", "probable", "predicted")
GLYCO_TYPES = (
    ("N-linked|N-glyc", "N-linked"),
    ("O-linked|O-glyc|O-GlcNAc|O-GalNAc", "O-linked"),
    ("C-mannosyl|C-linked", "C-mannosylation"),
    ("GPI-anchor|GPI anchor|glycosylphosphatidylinositol", "GPI-anchor"),
)
RESIDUES_BY_TYPE = (("n-linked", "N"), ("o-linked", "STY"), ("c-mannosylation", "W"), ("gpi-anchor", "SNDGAC"))

# Modification types and their aliases, in the order in which they are tried.
PTM_TYPES = ("phosphorylation", "methylation", "acetylation", "ubiquitination", "sumoylation", "glycosylation")
PTM_ALIASES = (
    ("phos", "phosphorylation"),
    ("phospho", "phosphorylation"),
    ("meth", "methylation"),
    ("methyl", "methylation"),
    ("acet", "acetylation"),
    ("acetyl", "acetylation"),
    ("ubiq", "ubiquitination"),
    ("ubiquitin", "ubiquitination"),
    ("sumo", "sumoylation"),
    ("glyc", "glycosylation"),
    ("glyco", "glycosylation"),
)

# Words for the two labels.
POSITIVE = ("1", "true", "yes", "positive", "pos", "immunogenic")
NEGATIVE = ("0", "false", "no", "negative", "neg", "non-immunogenic", "non_immunogenic")


def first_match(value: Column, rules: tuple[tuple[str, str], ...], otherwise: Column | None = None) -> Column:
    """The name of the first rule whose pattern, letter case ignored, occurs in value."""
    cases = [F.when(value.rlike(f"(?i){p}"), F.lit(name)) for p, name in rules]
    return F.coalesce(*cases, *([] if otherwise is None else [otherwise]))


def normalize_location(text: Column) -> Column:
    """Compartment id of free text; null where none fits (F1)."""
    return first_match(text, LOCATION_RULES)


def normalize_locations(texts: Column) -> Column:
    """Distinct compartments of an array of texts, in order, without nulls (F1)."""
    return F.array_distinct(F.array_compact(F.transform(texts, normalize_location)))


def base_accession(accession: Column) -> Column:
    """The part before an isoform suffix."""
    return F.regexp_extract(accession, r"^([^-]*)", 1)


def isoform(accession: Column) -> Column:
    """The isoform's number, null without one (F2)."""
    return F.regexp_extract(accession, r"-(\d+)$", 1).try_cast("int")


def canonical_accession(accession: Column) -> Column:
    """The base id where no isoform or isoform 1 is named, else base-1; positions stay as they are."""
    n = isoform(accession)
    base = base_accession(accession)
    return F.when(n.isNull() | (n == 1), base).otherwise(F.concat(base, F.lit("-1")))


def is_canonical(accession: Column) -> Column:
    n = isoform(accession)
    return n.isNull() | (n == 1)


def site_id(accession: Column, position: Column, residue: Column) -> Column:
    """SITE::base-n::position::residue, with a suffix always; null for a bad position or residue."""
    n = F.coalesce(isoform(accession), F.lit(1))
    full = F.concat(base_accession(accession), F.lit("-"), n.cast("string"))
    good = (position >= 1) & (F.length(residue) == 1)
    return F.when(good, F.concat_ws("::", F.lit("SITE"), full, position.cast("string"), F.upper(residue)))


def parse_site_id(site: Column) -> Column:
    """struct(accession, position, residue) of a site id; null where it is none."""
    parts = F.split(site, "::")
    found = F.struct(
        parts[1].alias("accession"), F.get(parts, F.lit(2)).try_cast("int").alias("position"), F.get(parts, F.lit(3)).alias("residue")
    )
    return F.when((F.size(parts) == 4) & (parts[0] == "SITE") & found.position.isNotNull(), found)


def is_single_position(text: Column) -> Column:
    """True for one known position, false for ranges and unknown ones."""
    return F.coalesce(text.rlike(r"^\d+$") & (text.try_cast("long") > 0), F.lit(False))


def position_of_range(start: Column, end: Column, start_kind: Column, end_kind: Column) -> Column:
    """A feature's position where both ends are exact and equal, from 1 on."""
    exact = (F.coalesce(start_kind, F.lit("EXACT")) == "EXACT") & (F.coalesce(end_kind, F.lit("EXACT")) == "EXACT")
    return F.when(exact & (start == end) & (start >= 1), start)


def residue_fits(residue: Column, linkage: Column) -> Column:
    """Whether a residue can carry a linkage type; unknown types take any."""
    kind, r = F.lower(linkage), F.upper(residue)
    fits = F.coalesce(
        *(F.when(kind.contains(name), F.lit(allowed).contains(r)) for name, allowed in RESIDUES_BY_TYPE),
        F.lit(True),
    )
    return (F.coalesce(F.length(residue), F.lit(0)) > 0) & (F.coalesce(F.length(linkage), F.lit(0)) > 0) & fits


def glyco_type(description: Column) -> Column:
    """Glycosylation type by description, else the generic one."""
    return first_match(description, GLYCO_TYPES, F.lit("glycosylation"))


def is_uncertain(description: Column) -> Column:
    """True for descriptions by similarity, potential, probable or predicted."""
    words = "|".join(UNCERTAIN)
    return F.coalesce(description.rlike(rf"(?i)\b(?:{words})\b"), F.lit(False))


def best_evidence(codes: Column, allowed: Column) -> Column:
    """The lowest allowed code among codes, null without one."""
    return F.array_min(F.array_intersect(codes, allowed))


def normalize_ptm(text: Column) -> Column:
    """Modification type: itself, else by the first alias it holds, else in lower case."""
    low = F.lower(F.trim(text))
    known = F.when(low.isin(*PTM_TYPES), low)
    by_alias = [F.when(low.contains(a), F.lit(name)) for a, name in PTM_ALIASES]
    blank = F.coalesce(text, F.lit("")) == ""
    return F.when(blank, F.lit("unknown")).otherwise(F.coalesce(known, *by_alias, low))


def residue_token(token: Column) -> Column:
    """struct(residue, position) of tokens like T6; null where it is none."""
    found = F.struct(
        F.regexp_extract(token, r"^([A-Z])(\d+)$", 1).alias("residue"),
        F.regexp_extract(token, r"^([A-Z])(\d+)$", 2).try_cast("int").alias("position"),
    )
    return F.when(token.rlike(r"^[A-Z]\d+$"), found)


def binary_label(text: Column) -> Column:
    """1, 0 or null of a label's words or number."""
    low = F.lower(F.trim(text.cast("string")))
    number = low.try_cast("double")
    return (
        F.when(low.isin(*POSITIVE), 1)
        .when(low.isin(*NEGATIVE), 0)
        .when(number == 1, 1)
        .when(number == 0, 0)
        .cast("int")
    )


def squeezed(text: Column) -> Column:
    """Lower case without any white space: the form in which labels are matched (F16)."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def first_column(df, candidates: list[str]) -> str | None:
    """The first candidate that df has, letter case ignored."""
    by_low = {c.lower(): c for c in reversed(df.columns)}
    return next((by_low[c.lower()] for c in candidates if c.lower() in by_low), None)


def hash_bucket(text: Column, n: int) -> Column:
    """A bucket from 0 to n - 1 by md5 of the text, the same on every engine."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def shortened(text: Column, n: int) -> Column:
    """At most n characters, the last three of them dots if text is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def last_segment(uri: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(uri, "/", -1)


def trailing_digits(text: Column) -> Column:
    """The number at the end of tokens like Asn110."""
    return F.regexp_extract(text, r"(\d+)$", 1).try_cast("int")


def first_of(*values: Column) -> Column:
    """The first value that is neither null, blank nor zero: aliases fall through on those."""
    return F.coalesce(*(F.when(~v.cast("string").isin("", "0"), v) for v in values))


def has_id_format(node_id: Column, node_type: Column) -> Column:
    """Whether an id follows its type's grammar; types without one take any."""
    cases = reduce(lambda c, kv: c.when(node_type == kv[0], node_id.rlike(kv[1])), list(ID_PATTERNS.items())[1:],
                   F.when(node_type == "glycan", node_id.rlike(ID_PATTERNS["glycan"])))
    return F.coalesce(cases.otherwise(F.lit(True)), F.lit(False))
