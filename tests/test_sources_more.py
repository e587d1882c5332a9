"""Zipped tables, saved pages, and the small readers and writers."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from kgloom.functions import sequence as sq, text as tx
from kgloom.operators import validate
from kgloom.sources import readers, writers, zipped


@pytest.fixture
def archive(tmp_path):
    path = f"{tmp_path}/atlas.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("proteinatlas.tsv", "Gene\tENSEMBL\tother\tUniprot\n" + "".join(f"g{k}\tE{k}\tx{k}\t{'' if k % 3 == 0 else f' P{k} '}\n" for k in range(3000)))
        z.writestr("rna/consensus.tsv", "gene\tTissue\tnTPM\nE1\tliver\t1.5\nE2\tbrain\t\n")
        z.writestr("readme.md", "no table")
    return path


def test_zipped_members(spark, archive):
    df = zipped.read_zipped(spark, [archive], "Ensembl string, _member string", "proteinatlas")
    assert df.count() == 3000 and df.rdd.getNumPartitions() == 1 and df.first()["_member"] == "proteinatlas.tsv"
    both = zipped.read_zipped(spark, [archive, archive], "gene string, _member string")
    assert both.rdd.getNumPartitions() == 4 and both.count() == 6004  # a partition for each member, the text left out
    rows = zipped.read_zipped(spark, [f"file://{archive}"], "Tissue string, NTPM double", "consensus").collect()
    assert [tuple(r) for r in rows] == [("liver", 1.5), ("brain", None)]
    mapping = zipped.atlas_mapping(spark, archive)
    assert mapping.count() == 2000 and {tuple(r) for r in mapping.where("Ensembl = 'E1'").collect()} == {("E1", "P1")}
    with pytest.raises(Exception, match="has no column Nothing"):
        zipped.read_zipped(spark, [archive], "Nothing string", "consensus").collect()
    assert zipped.read_zipped(spark, [archive], "gene string", "no such member").count() == 0


def test_activity_pages(spark, tmp_path):
    for k in range(3):
        folder = tmp_path / "pages" / "P1" / f"CHEMBL{k % 2}"
        folder.mkdir(parents=True, exist_ok=True)
        acts = [{"molecule_chembl_id": f"C{k}{i}", "molecule_pref_name": None, "standard_type": t, "standard_value": v, "standard_units": "nM", "more": {"x": 1}} for i, (t, v) in enumerate((("IC50", "1.5"), ("EC50", "2"), ("Ki", "n/a")))]
        (folder / f"{k}.json").write_text(json.dumps({"activities": acts, "page_meta": {"next": None}}))
    got = zipped.activity_pages(spark, f"file://{tmp_path}/pages")
    assert sorted((r.target_chembl_id, r.compound_chembl_id, r.type, r.value) for r in got.collect()) == sorted((f"CHEMBL{k % 2}", f"C{k}{i}", t, v) for k in range(3) for i, t, v in ((0, "IC50", 1.5), (2, "Ki", None)))
    assert {r.enzyme_uniprot_id for r in got.collect()} == {"P1"}


def test_small_readers(spark, tmp_path):
    df = spark.createDataFrame([("a", [("1", "x"), ("2", None)], None), ("b", None, [1]), ("c", [(None, "y")], [])], "k string, r array<struct<id: string, name: string>>, q array<int>")
    got = {r.k: r.s for r in df.select("k", readers.annotation_strings(df, "r", "id", "name").alias("s")).collect()}
    assert got["a"] == "1|x;2" and got["c"] == ""
    assert {r.k: r.f for r in df.select("k", readers.first_list(F.col("q"), F.array(F.lit(9))).alias("f")).collect()} == {"a": [9], "b": [1], "c": []}
    assert [r.k for r in readers.pending_ids(df.unionAll(df), df.where("k <> 'b'"), "k").collect()] == ["b"]
    good, bad = readers.screen(df, [("no records", F.col("r").isNull()), ("named b", F.col("k") == "b")])
    assert {r.k for r in good.collect()} == {"a", "c"} and {(r.k, r.reason) for r in bad.collect()} == {("b", "no records")}
    assert tx.first_column(spark.createDataFrame([(1, 2)], "Uniprot int, uniprot_id int"), ["acc", "UNIPROT"]) == "Uniprot" and tx.first_column(df, ["none"]) is None
    human = spark.createDataFrame([("9606",), (None,), (""," ")[:1], ("10090",)], "t string").select(validate.human(F.col("t")).alias("h")).collect()
    assert [r.h for r in human] == [True, True, True, False]
    mean = spark.range(1).select(sq.weighted_window_mean(F.array(*(F.array(F.lit(float(k))) for k in range(5))), F.lit(1), 1).alias("m")).first().m
    import math

    assert mean[0] == pytest.approx(math.exp(-0.15) / (1 + math.exp(-0.15)))


def test_small_writers(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "enzyme", "A"), ("n2", "odd", None)], "node_id string, node_type string, label string")
    rows = [json.loads(r.json) for r in writers.node_json(nodes).collect()]
    assert rows[0] == {"id": "n1", "type": "enzyme", "label": "A", "color": "#e41a1c"} and rows[1]["color"] == "#999999"
    edges = spark.createDataFrame([("n1", "n2", "r")], "source_id string, target_id string, relation string")
    assert json.loads(writers.edge_json(edges).first().json) == {"source": "n1", "target": "n2", "relation": "r"}
    tip = nodes.select(writers.tooltip(F.col("label"), F.col("node_type"), F.create_map(F.lit("k"), F.lit("v"))).alias("t")).first().t
    assert tip == "A\nenzyme\nk: v"
    assert [r.line for r in writers.report_lines(nodes).collect()] == ["| n1 | enzyme | A |", "| n2 | odd |  |"]
    for _ in range(2):
        writers.write_rejects(nodes, f"{tmp_path}/rejects")
    assert spark.read.json(f"{tmp_path}/rejects").count() == 4
    mapped = spark.createDataFrame([("a", "x"), ("b", None), ("b", None)], "k string, mapped string")
    counts, lost = writers.mapping_diagnostics(mapped, "k")
    assert {r.status: r.n for r in counts.collect()} == {"mapped": 1, "unresolved": 2} and [r.k for r in lost.collect()] == ["b"]
