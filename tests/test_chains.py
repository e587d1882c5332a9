"""Filter chains by hand, the containment join against all pairs, tables replaced as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import chains, joins
from kgloom.sources import writers


def test_ptm_sites(spark):
    raw = [
        ("P1", 5, "S", "phos", 0.9, 0), ("P1-1", 5, "S", "x", 0.95, 1),  # the second is the first again
        ("P1", 5, "T", None, None, 2), ("P2-3", 7, "N", "g", float("nan"), 3), ("P3", 1, "S", "g", 0.1, 4), ("", 1, "S", "g", 0.9, 5), (None, 1, "S", "g", 0.9, 6),
        ("P9", 1, "S", "g", 0.9, 7), ("P1", 0, "S", "g", 0.9, 8), ("P1", None, "S", "g", 0.9, 9), ("P1", 3, "X", "g", 0.9, 10), ("P1", 3, "", "g", 0.9, 11), ("P1", 3, None, "g", 0.9, 12), ("P9", 3, "X", "g", 0.2, 13),
    ]
    df = spark.createDataFrame(raw, "uniprot_id string, site_position int, site_residue string, ptm_type string, score double, ord int")
    proteins = spark.createDataFrame([("P1",), ("P2-1",), ("P1",)], "protein_id string")
    done = chains.ptm_sites(df, proteins, 0.5)
    assert {tuple(r) for r in done.kept.collect()} == {("P1", 5, "S", "phos", 0.9, "PTMCode"), ("P1", 5, "T", "", 1.0, "PTMCode"), ("P2-1", 7, "N", "g", 1.0, "PTMCode")}
    assert done.counts == {"read": 14, "score": 2, "no id": 2, "isoform": 0, "protein": 1, "residue or position": 5, "duplicate": 1, "kept": 3}
    for none in (None, proteins.where("false")):  # an empty list allows all
        assert chains.ptm_sites(df, none, 0.5).counts["protein"] == 0
    assert [r.n for r in done.report().orderBy("place").collect()] == list(done.counts.values())
    assert chains.ptm_sites(df.where("false"), proteins, 0.5).counts["read"] == 0


def test_ptm_edges(spark):
    raw = [
        ("P1", 5, "S", "p", "P2", 6, "T", "q", 0.9, "co", 0), ("P2", 6, "T", "q", "P1-1", 5, "S", "p", 0.8, "co", 1), ("P1", 5, "S", "p", "P2", 7, "T", "q", None, None, 2),
        ("P1", 5, "S", "p", "P7", 7, "T", "q", 0.9, "co", 3), ("P1", None, "S", "p", "P2", 7, "T", "q", 0.9, "co", 4), ("", 5, "S", "p", "P2", 7, "T", "q", 0.9, "co", 5), ("P1", 5, "S", "p", "P2", 7, "T", "q", 0.1, "co", 6),
        ("P1", 5, None, None, "P2", 7, "T", "q", 0.9, "co", 7),
    ]
    side = "uniprot_id_{0} string, site_position_{0} int, residue_{0} string, ptm_type_{0} string"
    df = spark.createDataFrame(raw, f"{side.format('a')}, {side.format('b')}, score double, edge_type string, ord int")
    done = chains.ptm_edges(df, spark.createDataFrame([("P1",), ("P2",)], "protein_id string"), 0.5)
    assert done.counts == {"read": 8, "score": 1, "site": 2, "protein": 1, "duplicate": 1, "kept": 3}
    got = {(r.site1_uniprot, r.site1_residue, r.site2_position, r.score, r.edge_type) for r in done.kept.collect()}
    assert got == {("P1", "S", 6, 0.9, "co"), ("P1", "S", 7, 1.0, "unknown"), ("P1", "", 7, 0.9, "co")}


def test_known_site_edges(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "z", 0.9), ("z", "b", 0.2), ("b", "a", None)], "source_id string, target_id string, score double")
    sites = spark.createDataFrame([("a",), ("b",)], "site_id string")
    assert chains.known_site_edges(edges, sites, 0.5).counts == {"read": 4, "score": 2, "site": 1, "kept": 1}
    assert chains.known_site_edges(edges, None, 0.5).counts == {"read": 4, "score": 2, "site": 0, "kept": 2}


def test_sequence_features(spark):
    row = lambda *x: ("P1", *x, "MNGSA")
    data = [
        row("Glycosylation", "N-linked (GlcNAc...) asparagine", ["ECO:1"], 2, 2, "EXACT", "EXACT"),
        row("Signal", "N-linked", ["ECO:1"], 2, 2, None, None),
        row("Glycosylation", "N-linked, by similarity", ["ECO:1"], 2, 2, None, None),
        row("Glycosylation", "N-linked", ["ECO:9"], 2, 2, None, None),
        row("Glycosylation", "N-linked", None, 2, 2, None, None),
        row("Glycosylation", "N-linked", ["ECO:2", "ECO:1"], 2, 3, None, None),
        row("Glycosylation", "N-linked", ["ECO:1"], 2, 2, "UNKNOWN", None),
        row("Glycosylation", "N-linked", ["ECO:1"], 3, 3, None, None),  # G carries none
        row("Glycosylation", "N-linked", ["ECO:2", "ECO:1"], 77, 77, None, None),
        row("Glycosylation", None, ["ECO:1"], 4, 4, None, None),
    ]
    df = spark.createDataFrame(data, "uniprot_id string, type string, description string, codes array<string>, start int, end int, start_kind string, end_kind string, sequence string")
    done = chains.sequence_features(df, ["ECO:1", "ECO:2"])
    assert done.counts == {"read": 10, "type": 1, "description": 1, "evidence": 2, "position": 2, "residue": 1, "kept": 3}
    assert {(r.position, r.residue, r.evidence) for r in done.kept.collect()} == {(2, "N", "ECO:1"), (77, "", "ECO:1"), (4, "S", "ECO:1")}


def test_containment_against_all_pairs(spark):
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("abAé ") for _ in range(rng.randint(1, 7)))
    xs, ys = {name() for _ in range(60)} | {"q", "zz"}, {name() for _ in range(60)} | {"Q ", "b"}
    for extra in (set(), {""}):
        want = {x: min((y for y in ys | extra if x.lower() in y.lower() or y.lower() in x.lower()), default=None) for x in xs | extra}
        a = spark.createDataFrame([(x,) for x in [*xs, *extra, None]], "x string")
        b = spark.createDataFrame([(y,) for y in [*ys, *extra, None]], "y string")
        out = joins.contains_match(a, b, "x", "y")
        assert {r.x: r.y for r in out.collect()} == {x: y for x, y in want.items() if y is not None}
    assert "BroadcastNestedLoopJoin Inner, BuildRight, contains" not in out._jdf.queryExecution().toString()


def test_table_is_replaced_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        writers.read_table(spark, path)
    assert writers.replace_table(spark.range(5), path) == 1
    broken = spark.range(1000).repartition(8).select(F.when(F.col("id") == 999, F.raise_error(F.lit("half-way")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="half-way"):
        writers.replace_table(broken, path)
    assert writers.read_table(spark, path).count() == 5 and writers.versions(spark, path) == [1]
    assert writers.replace_table(writers.read_table(spark, path).unionAll(spark.range(3)), path) == 2  # reads what it replaces
    assert writers.replace_table(spark.range(2).withColumn("p", F.col("id")), path, ("p",)) == 3
    assert writers.versions(spark, path) == [2, 3] and writers.read_table(spark, path).count() == 2 and writers.read_table(spark, path, 2).count() == 8
    with pytest.raises(FileNotFoundError):
        writers.read_table(spark, path, 1)
