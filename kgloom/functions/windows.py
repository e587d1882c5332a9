"""Features of the surroundings of a motif in a sequence, as columns; positions are 1-based motif starts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .sequence import RESIDUES, sequon_count

# Hydropathy by residue, the groups of residues whose shares are features, and the places
# around a motif that are looked at one by one.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
CHARGED, POLAR, AROMATIC, HYDROPHOBIC = "DEKRH", "STCYNQ", "FWY", "AILMFWV"
KEY_OFFSETS = (-3, -2, -1, 0, 1, 2, 3, 4, 5)


def between_places(sequence: Column, first: Column, last: Column) -> Column:
    """The residues from one place to another, both included, as far as the sequence has them."""
    low, high = F.greatest(first, F.lit(1)), F.least(last, F.length(sequence))
    return F.substring(sequence, low, F.greatest(high - low + 1, F.lit(0)))


def share(part: Column, letters: str) -> Column:
    """The share of some residues in a part; 0 of none."""
    return F.regexp_count(part, F.lit(f"[{letters}]")) / F.greatest(F.length(part), F.lit(1))


def hydropathies(part: Column) -> Column:
    """The hydropathy of each residue, 0 of unknown ones."""
    table = F.create_map(*(F.lit(x) for kv in HYDROPATHY.items() for x in kv))
    return F.transform(F.filter(F.split(part, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0.0)))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(0.0)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def one_hot(residue: Column) -> Column:
    """20 values, all 0 for an unknown residue."""
    return F.array(*(_flag(residue == r) for r in RESIDUES))


def motif_features(sequence: Column, position: Column, half: int = 15) -> Column:
    """62 values (F20): composition 20, hydropathy 4, motif type 1, middle residue 20, place 5, context 12."""
    s, p, n = sequence, position, F.greatest(F.length(sequence), F.lit(1))
    local = between_places(s, p - half, p + 2 + half)
    water = hydropathies(local)
    mean = _mean(water)
    spread = F.sqrt(_mean(F.transform(F.transform(water, lambda x: x - mean), lambda d: d * d)))
    before, after = between_places(s, p - half, p - 1), between_places(s, p + 3, p + 2 + half)
    up, down = between_places(s, p - 5, p - 1), between_places(s, p + 3, p + 7)
    near = lambda first, last, most: sequon_count(between_places(s, first, last)) / F.greatest(F.lit(1), F.least(most, F.lit(20)))
    place = [(p - 1) / n, (p - 1) / n, (F.length(s) - p + 1) / n, F.log1p(F.length(s)), sequon_count(s) / n * 100]
    context = [
        *(share(part, letters) for part in (up, down) for letters in (CHARGED, POLAR, AROMATIC)),
        _flag(between_places(s, p - 2, p - 1).contains("P")),
        _flag(between_places(s, p + 3, p + 4).contains("P")),
        near(p - 20, p - 1, p - 1),
        near(p + 3, p + 22, F.length(s) - p - 2),
        _flag(p <= 30),
        _flag(mean > 1.5),
    ]
    return F.concat(
        F.array(*(share(local, r) for r in RESIDUES)),
        F.array(mean, spread, _mean(hydropathies(before)), _mean(hydropathies(after)), _flag(F.substring(s, p + 2, F.lit(1)) == "S")),
        one_hot(F.substring(s, p + 1, F.lit(1))),
        F.array(*(x.cast("double") for x in place)),
        F.array(*(x.cast("double") for x in context)),
    )


def key_residues(sequence: Column, position: Column) -> Column:
    """The number of the residue at each of KEY_OFFSETS, 20 where it is unknown or beyond the ends."""
    at = lambda k: F.when((position + k).between(1, F.length(sequence)), F.substring(sequence, position + k, F.lit(1)))
    return F.array(*(_number(at(k)) for k in KEY_OFFSETS))


def _number(residue: Column) -> Column:
    place = F.position(residue, F.lit(RESIDUES))
    return F.when(residue.isNotNull() & (place > 0), place - 1).otherwise(20).cast("int")


def motif_context(sequence: Column, position: Column, n_motifs: Column) -> Column:
    """13 values of a motif's type, place and surroundings, before they are standardised."""
    s, p, n = sequence, position, F.greatest(F.length(sequence), F.lit(1))
    third, window = F.substring(s, p + 2, F.lit(1)), between_places(s, p - 15, p + 17)
    values = [
        _flag(third == "S"), _flag(third == "T"), (p - 1) / n, (F.length(s) - p + 1) / n, n_motifs, F.log1p(F.length(s)), _flag(p <= 30),
        *(share(window, letters) for letters in (CHARGED, POLAR, HYDROPHOBIC, "P", "C")), sequon_count(between_places(s, p - 30, p + 32)) / 63,
    ]
    return F.array(*(v.cast("double") for v in values))
