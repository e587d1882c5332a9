"""Linear structure strings (version/counts/[residue]…/topology/linkage) as columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Residue names by pattern, in the order in which they are tried.
RESIDUE_RULES = (
    (r"a2122h-1b_1-5_2\*N(?!CC)", "NeuAc"),
    (r"a2122h-1b_1-5_2\*NO", "NeuGc"),
    (r"(?i)Neu5Ac", "NeuAc"),
    (r"(?i)Neu5Gc", "NeuGc"),
    (r"a2122h-1[ab]_1-5_9\*O", "Kdn"),
    (r"a2122h-1[ab]_1-5_2\*NCC/3=O", "GlcNAc"),
    (r"a2112h-1[ab]_1-5_2\*NCC/3=O", "GalNAc"),
    (r"a2122h-1[ab]_1-5_2\*NCC", "GlcNAc"),
    (r"a2112h-1[ab]_1-5_2\*NCC", "GalNAc"),
    (r"a1221m-1[ab]_1-5", "Fuc"),
    (r"a2211m-1[ab]_1-5", "Rha"),
    (r"a212h-1[ab]_1-5", "Xyl"),
    (r"a122h-1[ab]_1-4", "Ara"),
    (r"a2122A-1[ab]_1-5", "GlcA"),
    (r"a2112A-1[ab]_1-5", "IdoA"),
    (r"a2122h-1[ab]_1-5", "Glc"),
    (r"a1122h-1[ab]_1-5", "Man"),
    (r"a2112h-1[ab]_1-5", "Gal"),
)

# Modifications by pattern.
MODIFICATIONS = (
    ("sulfation", r"(?i)\*OSO"),
    ("phosphorylation", r"(?i)\*OPO"),
    ("acetylation", r"(?i)\*OCC"),
    ("methylation", r"(?i)\*OC(?!C)"),
    ("deoxy", r"\d[dm]"),
    ("amino", r"\*N(?!CC|O)"),
    ("n_acetyl", r"\*NCC"),
    ("n_glycolyl", r"\*NO"),
)

# Class numbers of the count features, in the order in which patterns are tried; an
# earlier pattern of class 3 also takes what later ones name.
CLASSES = ("Hex", "HexNAc", "dHex", "NeuAc", "NeuGc", "Pent", "HexA", "Kdn")
CLASS_RULES = (
    (r"a2122h-1b_1-5_2\*N(?!CC)", 3),
    (r"a2122h-1b_1-5_2\*NO", 4),
    (r"a2112h-1b_1-5", 3),
    (r"a2122h-1[ab]_1-5_2\*NCC", 1),
    (r"a2112h-1[ab]_1-5_2\*NCC", 1),
    (r"a1221m-1[ab]_1-5", 2),
    (r"a2211m-1[ab]_1-5", 2),
    (r"a212h-1[ab]_1-5", 5),
    (r"a122h-1[ab]_1-4", 5),
    (r"a2122A-1[ab]_1-5", 6),
    (r"a2122h-1[ab]_1-5_9\*O", 7),
    (r"a2122h-1[ab]_1-5", 0),
    (r"a2112h-1[ab]_1-5", 0),
)

# Residue names of compositions, in the order in which they are tried.
COMPOSITION_RULES = (
    ("GlcNAc", r"a2122h.*2\*NCC"),
    ("GalNAc", r"a2112h.*2\*NCC"),
    ("Man", r"a1122h-1[ab]_1-5(?!.*\*)"),
    ("Gal", r"a2112h-1[ab]_1-5(?!.*\*)"),
    ("Fuc", r"a1221m-1[ab]_1-5"),
    ("NeuAc", r"a2112h-1[abx]_1-5.*5\*NCCO"),
    ("NeuGc", r"a2112h.*5\*NCCO/7=O"),
    ("Xyl", r"a1122h-1[abx]_1-4"),
    ("GlcA", r"a1122h.*6\*OC"),
)


def residues(structure: Column) -> Column:
    """The bracketed unique residues."""
    return F.regexp_extract_all(structure, F.lit(r"\[([^\]]+)\]"), 1)


def topology(structure: Column) -> Column:
    """1-based numbers of the residues in chain order."""
    text = F.regexp_extract(structure, r"\]/(\d[\d-]*)(?:/|$)", 1)
    return F.transform(F.filter(F.split(text, "-"), lambda x: x != ""), lambda x: x.cast("int"))


def linkages(structure: Column) -> Column:
    """The linkage tokens, empty without any."""
    text = F.regexp_extract(structure, r"\]/\d[\d-]*/(.*)$", 1)
    return F.filter(F.split(text, "_"), lambda x: x != "")


def residue_name(code: Column) -> Column:
    """Name by the first fitting rule, else Unknown."""
    return F.coalesce(*(F.when(code.rlike(p), F.lit(n)) for p, n in RESIDUE_RULES), F.lit("Unknown"))


def anomer(code: Column) -> Column:
    return F.when(code.rlike("-1a(?:_|$)"), "alpha").when(code.rlike("-1b(?:_|$)"), "beta").otherwise("unknown")


def ring_form(code: Column) -> Column:
    return F.when(code.contains("_1-5"), "pyranose").when(code.contains("_1-4"), "furanose").otherwise("unknown")


def modifications(code: Column) -> Column:
    """Names of the modifications that a residue code shows."""
    return F.array_compact(F.array(*(F.when(code.rlike(p), F.lit(n)) for n, p in MODIFICATIONS)))


def linkage_carbons(token: Column) -> Column:
    """struct(parent, parent_carbon, child, child_carbon) of tokens like a4-b1; ? is carbon 0."""
    rule = r"^([a-zA-Z])([\d?]+)-([a-zA-Z])([\d?]+)"
    part = lambda k: F.regexp_extract(token, rule, k)
    carbon = lambda k: F.when(part(k) == "?", 0).otherwise(part(k).try_cast("int"))
    return F.when(
        token.rlike(rule),
        F.struct(part(1).alias("parent"), carbon(2).alias("parent_carbon"), part(3).alias("child"), carbon(4).alias("child_carbon")),
    )


def _class_of(code: Column) -> Column:
    return F.coalesce(*(F.when(code.rlike(p), F.lit(c)) for p, c in CLASS_RULES), F.lit(0))


def class_counts(structure: Column) -> Column:
    """How many residues fall in each of CLASSES, 8 values."""
    codes = F.transform(residues(structure), _class_of)
    chain = F.transform(topology(structure), lambda k: F.coalesce(F.get(codes, k - 1), F.lit(0)))
    return F.array(*(F.size(F.filter(chain, lambda c: c == k)) for k in range(len(CLASSES))))


def branch_points(structure: Column) -> Column:
    """Letters that begin more than one linkage."""
    starts = F.transform(linkages(structure), lambda t: F.regexp_extract(t, r"^([a-z]+)", 1))
    named = F.filter(starts, lambda x: x != "")
    often = F.filter(F.array_distinct(named), lambda x: F.size(F.filter(named, lambda y: y == x)) > 1)
    return F.size(often)


def structure_features(structure: Column) -> Column:
    """24 values: class counts, branching, size, 3 modification flags, 4 core scores, 3 ratios, 4 zeros.

    Zeros for a malformed structure.
    """
    n = class_counts(structure)
    size = F.size(topology(structure))
    joined = F.array_join(residues(structure), " ")
    hex_, hexnac, dhex, sia, hexa = (F.get(n, F.lit(k)) for k in (0, 1, 2, 3, 6))
    as_n = (hexnac >= 2) & (hex_ >= 3)
    as_o = ~as_n & (hexnac >= 1) & (size <= 6)
    as_gag = ~as_n & ~as_o & (hexa >= 2) & (hexnac >= 2)
    core = F.array(*(F.when(c, 1.0).otherwise(0.0) for c in (as_n, as_o, as_gag, ~(as_n | as_o | as_gag))))
    total = F.greatest(size, F.lit(1))
    flags = F.array(*(F.when(joined.rlike(p), 1.0).otherwise(0.0) for name, p in MODIFICATIONS[:3]))
    ratios = F.array((F.get(n, F.lit(3)) + F.get(n, F.lit(4))) / total, dhex / total, branch_points(structure) / total)
    doubles = F.transform(n, lambda x: x.cast("double"))
    both = F.concat(doubles, F.array(branch_points(structure).cast("double"), size.cast("double")), flags, core, ratios, F.array_repeat(F.lit(0.0), 4))
    good = F.coalesce(structure.rlike(r"^[^/]*/\d+,\d+,\d+/\[") & (size > 0), F.lit(False))
    return F.when(good, both).otherwise(F.array_repeat(F.lit(0.0), 24))


def composition(structure: Column) -> Column:
    """Map of residue name to count."""
    name = lambda code: F.coalesce(*(F.when(code.rlike(p), F.lit(n)) for n, p in COMPOSITION_RULES), F.lit("Other"))
    names = F.transform(residues(structure), name)
    chain = F.array_compact(F.transform(topology(structure), lambda k: F.get(names, k - 1)))
    return F.map_from_entries(
        F.transform(F.array_distinct(chain), lambda n: F.struct(n, F.size(F.filter(chain, lambda x: x == n))))
    )


def antennae(structure: Column) -> Column:
    """Branches by the linkage section's separators: up to 2, 4, 6 and more give 1 to 4; 1 without that section, 0 for null."""
    parts = F.split(structure, "/")
    last = F.element_at(parts, -1)
    marks = F.length(last) - F.length(F.replace(last, F.lit("_")))
    return F.when(structure.isNull(), 0).when((F.size(parts) < 5) | (marks <= 2), 1).when(marks <= 4, 2).when(marks <= 6, 3).otherwise(4)


# The names of composition vectors and core classes, in order.
MONO_NAMES = ("GlcNAc", "Man", "Gal", "Fuc", "NeuAc", "GalNAc", "NeuGc", "Xyl", "GlcA", "Other")
CORE_TYPES = ("high_mannose", "complex", "hybrid", "pauci_mannose", "minimal", "other")


def composition_features(structure: Column) -> Column:
    """struct(composition, composition_log, core_type, antennae, total): what a composition model reads."""
    comp = composition(structure)
    counts = F.transform(F.array(*map(F.lit, MONO_NAMES)), lambda n: F.coalesce(F.try_element_at(comp, n), F.lit(0)).cast("double"))
    core = F.array_position(F.array(*map(F.lit, CORE_TYPES)), core_class(comp)).cast("int") - 1
    total = F.aggregate(F.map_values(comp), F.lit(0), lambda a, x: a + x)
    return F.struct(counts.alias("composition"), F.transform(counts, F.log1p).alias("composition_log"), core.alias("core_type"), F.least(antennae(structure), F.lit(4)).alias("antennae"), total.alias("total"))


# The thresholds of the two classes below, in the order in which they are tried.
def core_class(comp: Column) -> Column:
    """Core class of a composition."""
    of = lambda n: F.coalesce(F.try_element_at(comp, F.lit(n)), F.lit(0))
    total = F.aggregate(F.map_values(comp), F.lit(0), lambda a, x: a + x)
    man, gal, sia, hexnac = of("Man"), of("Gal"), of("NeuAc"), of("GlcNAc")
    return (
        F.when(total < 3, "minimal")
        .when((man >= 5) & (gal == 0) & (sia == 0), "high_mannose")
        .when(((gal > 0) | (sia > 0)) & (man >= 3), "hybrid")
        .when((gal > 0) | (sia > 0), "complex")
        .when(man.between(2, 4) & (hexnac <= 3), "pauci_mannose")
        .otherwise("other")
    )


def nlinked_class(structure: Column) -> Column:
    """Structural class of an N-linked structure by residue totals and marks."""
    total = F.regexp_extract(structure, r"^WURCS=2\.0/\d+,(\d+),\d+/", 1).try_cast("int")
    fuc = structure.contains("1221m")
    sia = structure.contains("AUx") | structure.contains("Aun") | structure.contains("a2112h-1x")
    hexnac = F.regexp_count(structure, F.lit("NCC/3=O"))
    plain = ~fuc & ~sia
    return F.when(total.isNull(), "unknown").otherwise(
        F.when((total <= 11) & (hexnac <= 2) & plain, "high_mannose")
        .when((hexnac == 3) & plain, "hybrid")
        .when((hexnac > 2) & plain, "complex_agalacto")
        .when(fuc & sia, "complex_fucosialylated")
        .when(fuc, "complex_fucosylated")
        .when(sia, "complex_sialylated")
        .otherwise("other")
    )
