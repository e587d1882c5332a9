"""Protein sequences: motifs, composition, windows and isoform positions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The residues in the order of their numbers.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: The letters that have one Latin capital each, two of them beyond ASCII.
SMALL, CAPITAL = "abcdefghijklmnopqrstuvwxyz\u0131\u017f", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS"


def capitals(sequence: Column) -> Column:
    """Residue letters as capitals, one for one, so that places stay: upper() makes two letters of some."""
    return F.translate(sequence, SMALL, CAPITAL)


def count_letters(sequence: Column, letters: str) -> Column:
    return (F.length(sequence) - F.length(F.regexp_replace(sequence, f"[{letters}]", ""))).cast("long")


def sequon_count(sequence: Column, last: str = "ST") -> Column:
    """Matches of N, not P, then one of `last`, without overlaps."""
    return F.regexp_count(sequence, F.lit(f"N[^P][{last}]"))


def sequon_positions(sequence: Column) -> Column:
    """1-based starts of the same matches: the text is cut after each match, so ends are sums of lengths."""
    pieces = F.regexp_extract_all(sequence, F.lit("(?s).*?N[^P][ST]"), F.lit(0))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))

    def add(s: Column, piece: Column) -> Column:
        end = s["end"] + F.length(piece)
        return F.struct(end.alias("end"), F.concat(s["starts"], F.array(end - 2)).alias("starts"))

    return F.aggregate(pieces, start, add, lambda s: s["starts"])


def sequence_features(sequence: Column) -> Column:
    """Motif densities, residue shares and log length of a sequence, 12 values."""
    s = F.upper(F.coalesce(sequence, F.lit("")))
    n = F.greatest(F.length(s), F.lit(1)).cast("double")
    share = lambda letters: count_letters(s, letters) / n
    return F.array(
        sequon_count(s) / n,
        sequon_count(s, "S") / n,
        sequon_count(s, "T") / n,
        share("N"),
        share("S"),
        share("T"),
        share("ST"),
        share("W"),
        F.log1p(n),
        share("AILMFWV"),
        share("DEKRH"),
        share("P"),
    )


def window_composition(sequence: Column, position: Column, half: int = 16) -> Column:
    """Share of each residue within `half` of a 1-based position."""
    part = F.substring(sequence, F.greatest(position - half, F.lit(1)), F.least(F.lit(2 * half + 1), position + half))
    n = F.greatest(F.length(part), F.lit(1))
    return F.array(*(count_letters(part, r) / n for r in RESIDUES))


def weighted_window_mean(vectors: Column, position: Column, half: int = 16, decay: float = 0.15) -> Column:
    """Mean of residue vectors around a 1-based position, weighted by exp(-decay * distance)."""
    at = F.sequence(F.greatest(position - half, F.lit(1)), F.least(position + half, F.size(vectors)))
    weight = lambda k: F.exp(-decay * F.abs(k - position))
    total = F.aggregate(at, F.lit(0.0), lambda a, k: a + weight(k))
    zero = F.transform(vectors[0], lambda _: F.lit(0.0))
    added = F.aggregate(
        at, zero, lambda a, k: F.zip_with(a, F.get(vectors, k - 1), lambda x, y: x + y.cast("double") * weight(k))
    )
    return F.transform(added, lambda x: x / total)


# How far a canonical position may lie from an isoform's, how far around both are compared, and the least share alike.
REACH, AROUND, ALIKE = 50, 10, 0.5


def canonical_position(isoform: Column | str, canonical: Column | str, position: Column | str) -> Column:
    """The canonical position of an isoform's 1-based position (F8).

    Equal sequences keep it; equally long ones do if the residue there is the same. Else every equal
    residue of the canonical sequence within REACH positions is a candidate. The stretches of AROUND
    residues to both sides are laid over each other from their starts on, and the first candidate of
    the largest share of equal residues is taken if that is ALIKE at least. Null without one.
    """
    iso, can, p = (F.col(c) if isinstance(c, str) else c for c in (isoform, canonical, position))
    letter = lambda s, k: F.substring(s, k, F.lit(1))
    begin = lambda k: F.greatest(k - AROUND, F.lit(1))
    stretch = lambda s, k: F.substring(s, begin(k), k + AROUND + 1 - begin(k))
    here = stretch(iso, p)

    def judged(q: Column) -> Column:
        there = stretch(can, q)
        n = F.least(F.length(here), F.length(there))
        same = F.size(F.filter(F.sequence(F.lit(1), n), lambda j: letter(here, j) == letter(there, j)))
        return F.struct((same / n).alias("share"), (-q).alias("back"))

    low, high = F.greatest(F.lit(1), p - REACH), F.least(F.length(can), p + REACH)
    candidates = F.when(low <= high, F.filter(F.sequence(low, high), lambda q: letter(can, q) == letter(iso, p)))
    best = F.array_max(F.transform(candidates, judged))
    found = F.when(best["share"] >= ALIKE, (-best["back"]).cast("int"))
    kept = F.when(letter(can, p) == letter(iso, p), p)
    whole = F.when(iso == can, p).when(F.length(iso) == F.length(can), kept).otherwise(found)
    return F.when((p >= 1) & (p <= F.length(iso)) & can.isNotNull(), whole).cast("int")
