import math

import pytest
from pyspark.sql import functions as F

from kgloom.functions import sequence as sq, structure as st, trees, text as tx, vectors as vx


@pytest.fixture
def one(spark):
    def value(**columns):
        df = spark.range(1).select(*(c.alias(n) for n, c in columns.items()))
        return df.first()

    return value


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Golgi apparatus, trans-Golgi network membrane", "LOC::trans_golgi_network"),
        ("GOLGI APPARATUS", "LOC::golgi_apparatus"),
        ("Endoplasmic reticulum-Golgi intermediate compartment; ER-Golgi intermediate", "LOC::er_golgi_intermediate"),
        ("Cytosol", "LOC::cytoplasm"),
        ("elsewhere", None),
        ("", None),
        (None, None),
    ],
)
def test_location(one, raw, want):
    assert one(x=tx.normalize_location(F.lit(raw).cast("string"))).x == want


@pytest.mark.parametrize("acc, base, canonical, is_c", [("P12345", "P12345", "P12345", True), ("P12345-1", "P12345", "P12345", True), ("P12345-3", "P12345", "P12345-1", False)])
def test_accessions(one, acc, base, canonical, is_c):
    a = F.lit(acc)
    r = one(b=tx.base_accession(a), c=tx.canonical_accession(a), k=tx.is_canonical(a))
    assert (r.b, r.c, r.k) == (base, canonical, is_c)


def test_site_id_round_trip(one):
    r = one(s=tx.site_id(F.lit("P1"), F.lit(7), F.lit("n")), bad=tx.site_id(F.lit("P1"), F.lit(0), F.lit("N")))
    assert r.s == "SITE::P1-1::7::N" and r.bad is None
    p = one(p=tx.parse_site_id(F.lit(r.s)), q=tx.parse_site_id(F.lit("SITE::P1::x::N")), z=tx.parse_site_id(F.lit("no")))
    assert tuple(p.p) == ("P1-1", 7, "N") and p.q is None and p.z is None


@pytest.mark.parametrize("kind, node_id, ok", [("glycan", "G00001AB", True), ("glycan", "xG00001AB", False), ("protein", "P12345", True), ("protein", "P12345garbage", True),
                                              ("protein", "xxA0A024R1R8", False), ("other", "anything", True), ("site", None, False)])
def test_id_formats(one, kind, node_id, ok):
    assert one(x=tx.has_id_format(F.lit(node_id).cast("string"), F.lit(kind))).x is ok


@pytest.mark.parametrize("r, kind, ok", [("n", "N-linked", True), ("S", "N-linked", False), ("Y", "O-linked (GlcNAc)", True), ("K", "other", True), ("", "N-linked", False), (None, "x", False)])
def test_residue_fits(one, r, kind, ok):
    assert one(x=tx.residue_fits(F.lit(r).cast("string"), F.lit(kind))).x is ok


@pytest.mark.parametrize("v, want", [("Yes", 1), ("0", 0), ("1.0", 1), ("0.5", None), ("non-immunogenic", 0), (None, None), ("maybe", None)])
def test_binary_label(one, v, want):
    assert one(x=tx.binary_label(F.lit(v).cast("string"))).x == want


@pytest.mark.parametrize("v, want", [("Phosphorylation", "phosphorylation"), ("phosphoserine", "phosphorylation"), ("O-GlycNAc", "glycosylation"), ("Nitro", "nitro"), (None, "unknown"), ("", "unknown")])
def test_ptm(one, v, want):
    assert one(x=tx.normalize_ptm(F.lit(v).cast("string"))).x == want


def test_small_text_rules(one):
    r = one(
        t=tx.residue_token(F.lit("T6")), u=tx.residue_token(F.lit("6T")), d=tx.trailing_digits(F.lit("Asn110")), s=tx.last_segment(F.lit("http://x/y/z")),
        q=tx.squeezed(F.lit(" A b\tC ")), g=tx.glyco_type(F.lit("n-linked (x)")), h=tx.glyco_type(F.lit("?")), u2=tx.is_uncertain(F.lit("Probable site")), u3=tx.is_uncertain(F.lit("improbable")),
        e=tx.best_evidence(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("b"), F.lit("a"), F.lit("c"))), f=tx.first_of(F.lit(0), F.lit(5)), p=tx.is_single_position(F.lit("1..3")),
    )
    assert tuple(r.t) == ("T", 6) and r.u is None and r.d == 110 and r.s == "z" and r.q == "abc"
    assert (r.g, r.h, r.u2, r.u3, r.e, r.f, r.p) == ("N-linked", "glycosylation", True, False, "a", 5, False)


def test_sequons(spark):
    df = spark.createDataFrame([("NNSS",), ("ANASNPTNGT",), (None,)], "s string")
    got = [tuple(r) for r in df.select(sq.sequon_count(F.col("s")), sq.sequon_positions("s")).collect()]
    assert got == [(1, [1]), (2, [2, 8]), (None, None)]


def test_sequence_features(one):
    x = one(x=sq.sequence_features(F.lit("NASNPTW"))).x
    assert x[0] == pytest.approx(1 / 7) and x[3] == pytest.approx(2 / 7) and x[8] == pytest.approx(math.log(8)) and len(x) == 12


def test_canonical_position(spark):
    can = "ACDEFGHIKLMNPQRSTVWY" * 3
    iso = can[5:]
    df = spark.createDataFrame([(iso, can, 20), (can, can, 9), (iso, can, 999), (None, can, 1)], "i string, c string, p int")
    assert [r[0] for r in df.select(sq.canonical_position("i", "c", "p")).collect()] == [25, 9, None, None]


S = "WURCS=2.0/3,5,4/[a2122h-1b_1-5_2*NCC/3=O][a1122h-1b_1-5][a1122h-1a_1-5]/1-1-2-3-3/a4-b1_b4-c1_c3-d1_c6-e1"


def test_structure(spark, one):
    r = one(n=F.size(st.residues(F.lit(S))), t=st.topology(F.lit(S)), b=st.branch_points(F.lit(S)), k=st.linkage_carbons(F.lit("a4-b1")), f=st.structure_features(F.lit(S)), z=st.structure_features(F.lit("bad")),
            name=st.residue_name(F.lit("a1122h-1b_1-5")), an=st.anomer(F.lit("a1122h-1b_1-5")), ring=st.ring_form(F.lit("a1122h-1b_1-5")), m=st.modifications(F.lit("x_6*OSO/3=O")))
    assert r.n == 3 and r.t == [1, 1, 2, 3, 3] and r.b == 1 and tuple(r.k) == ("a", 4, "b", 1)
    assert r.f[9] == 5 and len(r.f) == 24 and r.z == [0.0] * 24
    assert (r.name, r.an, r.ring, r.m) == ("Man", "beta", "pyranose", ["sulfation"])
    df = spark.createDataFrame([("G1", S)], "g string, s string")
    rows = {x.node: x for x in trees.trees(df, "g", "s").collect()}
    assert {(x.parent, x.node) for x in rows.values() if x.node} == {(0, 1), (1, 2), (2, 3), (2, 4)}
    assert [rows[k].depth for k in range(5)] == [0, 1, 2, 3, 3] and [rows[k].bottom_up for k in range(5)] == [5, 4, 3, 1, 2]
    assert [rows[k].branching for k in range(5)] == [False, False, True, False, False] and rows[3].n_siblings == 1 and rows[0].n_siblings == 0
    comp = one(c=st.composition(F.lit(S))).c
    assert comp["GlcNAc"] == 2 and comp["Man"] == 3
    assert one(c=st.core_class(st.composition(F.lit(S)))).c == "pauci_mannose" and one(c=st.nlinked_class(F.lit(S))).c == "high_mannose"


def test_odd_trees(spark):
    """Branches out of order, circles, nodes on their own, two bonds to one node, unknown letters, long chains, none at all."""
    head = "WURCS=2.0/1,1,1/[a1122h-1b_1-5]/"
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    chain = "_".join(f"{a}4-{b}1" for a, b in zip(letters, letters[1:]))
    data = [
        ("order", head + "1-1-1-1/a3-d1_a4-b1_b4-c1"), ("circle", head + "1-1-1-1/a4-b1_c4-d1_d4-c1"), ("alone", head + "1-1-1/a4-c1"), ("two", head + "1-1-1/a4-b1_a4-c1_b4-c1"),
        ("unknown", head + "1-1/a?-b1_Z4-b1_b4-a1"), ("long", head + "-".join("1" * 52) + "/" + chain), ("one", head + "1/"), ("none", "WURCS"), ("null", None), ("number", head + "2-1/a4-b1"),
    ]
    got = {}
    for r in trees.trees(spark.createDataFrame(data, "g string, s string"), "g", "s").collect():
        got.setdefault(r.g, {})[r.node] = r
    show = lambda g, c: [got[g][k][c] for k in sorted(got[g])]
    assert show("order", "bottom_up") == [4, 3, 2, 1] and show("order", "depth") == [0, 1, 2, 1]
    assert show("circle", "depth") == [0, 1, None, None] and show("circle", "bottom_up") == [2, 1, None, None] and show("circle", "parent") == [None, 0, 3, 2]
    assert show("alone", "depth") == [0, None, 1] and show("two", "parent") == [None, 0, 0] and show("two", "n_children") == [2, 0, 0]
    assert show("unknown", "parent") == [None, 0] and show("unknown", "parent_carbon") == [None, 0]
    assert show("long", "depth") == list(range(52)) and show("long", "bottom_up") == list(range(52, 0, -1))
    assert show("one", "depth") == [0] and "none" not in got and "null" not in got and show("number", "name") == ["Unknown", "Man"]
    texts = [None, "a/b", "W/1,1,1/[x_1]/1-1/a_b_c", "W/1/[x]/1-1/____", "W/1/[x_1/_5]/1/" + "_" * 6, "W/1/[x]/1/" + "_" * 7]
    assert [r.a for r in spark.createDataFrame([(x,) for x in texts], "s string").select(st.antennae(F.col("s")).alias("a")).collect()] == [0, 1, 1, 2, 3, 4]


def test_vectors(one):
    a, b, z = (F.array(*map(F.lit, v)) for v in ([1.0, 2.0], [2.0, 1.0], [0.0, 0.0]))
    r = one(c=vx.cosine(a, b), z=vx.cosine(a, z), t=vx.translational(a, b, z), l=vx.translational(a, b, z, 1), d=vx.bilinear(a, b, a), rot=vx.rotation(a, F.array(F.lit(0.0)), a),
            cc=vx.circular_correlation(a, b), j=vx.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), p=vx.poincare_distance(F.array(F.lit(0.1), F.lit(0.0)), F.array(F.lit(0.1), F.lit(0.0))),
            e=vx.log0(vx.exp0(F.array(F.lit(0.3), F.lit(0.4)))), m=vx.mixed_score([F.lit(1.0), F.lit(3.0)], [0.0, 0.0]))
    assert r.c == pytest.approx(0.8) and r.z == 0 and r.t == pytest.approx(-math.sqrt(18)) and r.l == pytest.approx(-6) and r.d == pytest.approx(6)
    assert r.rot == pytest.approx(0) and r.cc == pytest.approx([4, 5]) and r.j == pytest.approx(1 / 3) and r.p == pytest.approx(0, abs=1e-6)
    assert r.e == pytest.approx([0.3, 0.4]) and r.m == pytest.approx(2)


def test_motif_features(spark):
    """All 62 values of every motif against the rule written out by hand."""
    import re

    from kgloom.functions import windows as w

    def by_hand(s, pos):
        n, share = len(s), lambda part, of: sum(c in of for c in part) / max(len(part), 1)
        count = lambda part: len(re.findall("N[^P][ST]", part))
        start = max(0, pos - 15)
        local = s[start : min(n, pos + 18)]
        water = lambda part: [w.HYDROPATHY.get(c, 0) for c in part]
        mean = lambda v: sum(v) / len(v) if v else 0.0
        h, mid = water(local), pos - start
        out = [share(local, r) for r in w.RESIDUES]
        out += [mean(h), math.sqrt(mean([(x - mean(h)) ** 2 for x in h])), mean(water(local[:mid])), mean(water(local[mid + 3 :])), float(s[pos + 2] == "S")]
        out += [float(s[pos + 1] == r) for r in w.RESIDUES]
        out += [pos / n, pos / n, (n - pos) / n, math.log1p(n), count(s) / n * 100]
        up, down = s[max(0, pos - 5) : pos], s[pos + 3 : pos + 8]
        out += [share(p, of) for p in (up, down) for of in ("DEKRH", "STCYNQ", "FWY")]
        out += [float("P" in s[max(0, pos - 2) : pos]), float("P" in s[pos + 3 : pos + 5])]
        out += [count(s[max(0, pos - 20) : pos]) / max(1, min(pos, 20)), count(s[pos + 3 : pos + 23]) / max(1, min(n - pos - 3, 20)), float(pos < 30), float(mean(h) > 1.5)]
        return out

    text = "NASXNPTPNVSILVAFNISPPNNTKRDWYNGTAAILVMFNLTILVAAVILLNCS"
    rows = [(text, m.start() + 1) for m in re.finditer("N[^P][ST]", text)] + [("NAS", 1)]
    df = spark.createDataFrame(rows, "s string, p int")
    for r, (s, p) in zip(df.select(w.motif_features(F.col("s"), F.col("p")).alias("f"), w.key_residues(F.col("s"), F.col("p")).alias("k")).collect(), rows):
        assert r.f == pytest.approx(by_hand(s, p - 1)) and len(r.f) == 62
        assert r.k == [w.RESIDUES.find(s[p - 1 + o]) if 0 <= p - 1 + o < len(s) and s[p - 1 + o] in w.RESIDUES else 20 for o in range(-3, 6)]
