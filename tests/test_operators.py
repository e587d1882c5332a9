import json

import pytest
from pyspark.sql import functions as F

from kgloom.operators import aggregates as ag, build, dedup, graph, joins, metrics as me, ranking as rk, splits, validate
from kgloom.plans.stages import Config, run_stages
from kgloom.sources import readers, writers


@pytest.fixture(scope="module")
def tiny(spark):
    """Four nodes, of which one is no end of an edge."""
    nodes = spark.createDataFrame([("N1", "enzyme", "a", "{}"), ("N2", "compound", "b", ""), ("N3", "glycan", "c", '{"k": "v"}'), ("N4", "disease", "d", None)], "node_id string, node_type string, label string, metadata string")
    edges = spark.createDataFrame([("N2", "N1", "inhibits"), ("N1", "N3", "has_glycan")], "source_id string, target_id string, relation string")
    return nodes, edges


def edge_table(spark, pairs, relation="r"):
    return spark.createDataFrame([(a, b, relation) for a, b in pairs], "source_id string, target_id string, relation string")


def test_orphans_and_report(tiny):
    nodes, edges = tiny
    assert [r.node_id for r in joins.orphans(nodes, edges).collect()] == ["N4"]
    report = {r.check: r for r in validate.check_graph(nodes, edges).collect()}
    assert report["orphans"].n == 1 and report["orphans"].sample == ["N4"] and report["orphans"].severity == "warning"
    assert report["dangling_targets"].severity == "error" and report["dangling_targets"].n == 0
    assert report["components"].n == 2


def test_repair_order(spark, tiny):
    nodes, edges = tiny
    bad = edges.unionAll(edges).unionAll(edge_table(spark, [("N3", "N3"), ("N3", "N9")]))
    n, e = validate.repair(nodes, bad)
    assert {(r.source_id, r.target_id) for r in e.collect()} == {("N2", "N1"), ("N1", "N3")}
    assert {r.node_id for r in n.collect()} == {"N1", "N2", "N3"}


def test_hundred_arrivals_are_99_duplicates(spark):
    e = edge_table(spark, [("a", "b")] * 100)
    assert dedup.merge_edges(e).first().n_duplicates == 99
    assert dedup.duplicate_report(e, ["source_id", "target_id"]).first().n_extra == 99


@pytest.mark.parametrize("turn", [False, True])
def test_folds_do_not_depend_on_row_order(spark, turn):
    data = [("n", "src", "a", 1), ("n", "src", "b", 2), ("n", "src", "a", 3), ("n", "one", "x", 4), ("m", "src", None, 5)]
    df = spark.createDataFrame(data[::-1] if turn else data, "k string, field string, v string, ord long")
    got = {r["field"]: r["values"] for r in dedup.fold_values(df, ["k"], "field", "v", "ord").collect()}
    assert got == {"src": ["a", "b"], "one": ["x"]}
    shown = dedup.fold_values(df, ["k"], "field", "v", "ord").select("field", dedup.scalar_or_list(F.col("values")).alias("j")).collect()
    assert {r["field"]: json.loads(r.j) for r in shown} == {"src": ["a", "b"], "one": "x"}


def test_first_node_type_and_first_real_sequence_win(spark):
    df = spark.createDataFrame([("P1", "protein", "p", "", 2), ("P1", "enzyme", "e", None, 1), ("P1", "protein", "q", "MA", 3)], "node_id string, node_type string, label string, sequence string, ord long")
    r = dedup.merge_nodes(df).first()
    assert (r.node_type, r.label, r.sequence, r.n_duplicates, r.type_conflict) == ("enzyme", "e", "MA", 2, True)


def test_resolve_orders(spark):
    known = spark.createDataFrame([("P1-1",), ("P2",), ("P2-1",)], "node_id string")
    df = spark.createDataFrame([("P1",), ("P2-3",), ("P9",), (None,)], "ref string")
    got = {r.ref: r.resolved for r in joins.resolve_ids(df, "ref", known).collect()}
    assert got == {"P1": "P1-1", "P2-3": "P2", "P9": None, None: None}
    other = {r.ref: r.resolved for r in joins.resolve_ids(df, "ref", known, ("exact", "canonical", "base")).collect()}
    assert other["P2-3"] == "P2-1"


def test_type_compatible_items(spark):
    sites = spark.createDataFrame([("s1", "P", "N-linked"), ("s2", "P", "glycosylation"), ("s3", "P", "odd")], "site_id string, protein_id string, site_type string")
    items = spark.createDataFrame([("P", "g1"), ("P", "g2"), ("P", "g3")], "protein_id string, item string")
    terms = spark.createDataFrame([("g1", "N-linked"), ("g2", "O-linked")], "item string, term string")
    got = {(r.site_id, r.item) for r in joins.site_items(sites, items, terms, {"N-linked": "N-linked"}).collect()}
    assert got == {("s1", "g1"), ("s1", "g3"), ("s2", "g1"), ("s2", "g2"), ("s2", "g3")}


def test_inheritance_is_one_hop(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    parents = spark.createDataFrame([("b", "a"), ("c", "b")], "item string, parent string")
    direct = spark.createDataFrame([("a", "E")], "item string, value string")
    assert {(r.item, r.value) for r in joins.inherit(items, direct, parents).collect()} == {("a", "E"), ("b", "E")}


def test_components(spark):
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in (100, 101, 102)} == {100} and len(got) == 44
    assert graph.connected_components(df.where("false")).count() == 0


def test_complete_graph_clusters_fully(spark):
    k4 = edge_table(spark, [(a, b) for a in "abcd" for b in "abcd" if a < b])
    assert {(r.degree, r.triangles, r.coefficient) for r in graph.clustering(k4).collect()} == {(3, 3, 1.0)}
    path = graph.clustering(edge_table(spark, [("a", "b"), ("b", "c")])).collect()
    assert {r.coefficient for r in path} == {0.0}


def test_cycles(spark):
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "y")]
    assert {r.node for r in graph.cycle_nodes(edge_table(spark, ring)).collect()} == {"a", "b", "c"}
    assert graph.cycle_nodes(edge_table(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_hierarchy_ends_on_cycles(spark):
    e = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("r", "b")], "parent string, child string")
    roots = spark.createDataFrame([("r",)], "node string")
    got = {r.node: (r.depth, r.parent) for r in graph.hierarchy(e, roots, 5).collect()}
    assert got == {"r": (0, None), "a": (1, "r"), "b": (1, "r")}


def test_ranks_and_metrics(spark):
    s = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.5), ("q", "c", 0.3), ("q", "d", 0.1), ("q", "e", float("nan"))], "q string, item string, score double")
    ranks = {r.item: r["rank"] for r in rk.optimistic_rank(s, ["q"]).collect()}
    assert ranks == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}
    target = spark.createDataFrame([("q", "b")], "q string, item string")
    known = spark.createDataFrame([("q", "a"), ("q", "b")], "q string, item string")
    assert rk.target_ranks(rk.filtered(s, known, target, ["q"]), target, ["q"]).first()["rank"] == 1
    assert rk.target_ranks(s, target, ["q"]).first()["rank"] == 2
    tied = spark.createDataFrame([("q", x, 1.0) for x in "abcd"], "q string, item string, score double")
    assert {r["rank"] for r in rk.optimistic_rank(tied, ["q"]).collect()} == {1}
    m = rk.rank_metrics(spark.createDataFrame([(x,) for x in (1, 2, 3, 5, 10)], "rank long"), n_items=9).first()
    assert m.mrr == pytest.approx((1 + 1 / 2 + 1 / 3 + 1 / 5 + 1 / 10) / 5) and m.mr == pytest.approx(4.2) and m.hits_3 == pytest.approx(0.6) and m.amr == pytest.approx(4.2 / 5)
    empty = rk.rank_metrics(spark.createDataFrame([], "rank long")).first()
    assert (empty.mrr, empty.hits_10) == (0, 0)


def test_fusion(spark):
    s = spark.createDataFrame([("q", "a", 1.0, 5.0), ("q", "b", 1.0, None), ("q", "c", 1.0, 1.0)], "q string, item string, a double, b double")
    got = {r.item: r.blend for r in rk.blend(s, ["q"], "a", "b", 0.5).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": 0.0}
    assert rk.oracle_rank(spark.createDataFrame([("q", "t1", "x", 0.0)], "q string, ctx string, item string, score double"), spark.createDataFrame([("q", "x")], "q string, item string"), ["q"], "ctx", 77).first()["rank"] == 77


def test_cluster_hits_and_softmax(spark):
    s = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 1.0)], "q string, item string, score double")
    clusters = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "item string, cluster int")
    t = spark.createDataFrame([("q", "c"), ("q", "b")], "q string, item string")
    assert {r.item: r.hit for r in rk.cluster_hits(s, t, clusters, ["q"], 1).collect()} == {"c": True, "b": False}
    assert {r.cluster: r.score for r in rk.cluster_scores(s, clusters, ["q"]).collect()} == {1: 3.0, 2: 2.0}
    assert sum(r.softmax for r in ag.scatter_softmax(s, "q", "score").collect()) == pytest.approx(1)


def test_auc_and_delong(spark):
    data = [(k, k % 2, float(k % 5), float(k % 3)) for k in range(30)]
    df = spark.createDataFrame(data, "id long, label int, a double, b double")
    pos, neg = [d for d in data if d[1]], [d for d in data if not d[1]]
    want = [sum((p[c] > n[c]) + 0.5 * (p[c] == n[c]) for p in pos for n in neg) / len(pos) / len(neg) for c in (2, 3)]
    assert me.roc_auc(df.withColumn("score", F.col("a")), []).first().auc == pytest.approx(want[0])
    d = me.delong(df, "a", "b", "label", "id").first()
    assert (d.auc_a, d.auc_b) == pytest.approx(tuple(want)) and abs(d.z) < 3


def test_adjusted_p_values(spark):
    p = spark.createDataFrame([(k, "g", v) for k, v in enumerate((0.01, 0.04, 0.03, 0.005))], "k long, g string, p double")
    out = me.benjamini_hochberg(me.holm(p, ["g"], "p", "k"), ["g"], "p", "k").orderBy("k").collect()
    assert [r.holm for r in out] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert [r.bh for r in out] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_paired_tests(spark):
    df = spark.createDataFrame([(float(k + k % 3), float(k)) for k in range(12)], "a double, b double")
    r = me.paired_test(df, "a", "b").first()
    assert r.n == 12 and r.t == pytest.approx(4.06201920231798, rel=1e-6) and r.p == pytest.approx(0.001877, rel=0.01)
    same = me.paired_test(df.withColumn("b", F.col("a")), "a", "b").first()
    assert same.p == 1.0
    w = me.signed_rank(df, "a", "b").first()
    assert w.n == 8 and w.w == 36.0 and w.z > 2


def test_splits_keep_their_sizes(spark):
    e = spark.createDataFrame([(k, "r", k % 7) for k in range(60)] + [(k, "tiny", 0) for k in range(2)], "h long, r string, t long")
    a = splits.link_split(e, ["h", "t"], ["r"], 0.1, 0.2)
    counts = {(r.r, r.split): r["count"] for r in a.groupBy("r", "split").count().collect()}
    assert counts[("r", "test")] == 12 and counts[("r", "val")] == 6 and counts[("tiny", "train")] == 2
    assert sorted(map(str, a.collect())) == sorted(map(str, splits.link_split(e.repartition(5), ["h", "t"], ["r"], 0.1, 0.2).collect()))
    strat = splits.link_split(e.where("r = 'r'").limit(3), ["h", "t"], ["r"], 0.1, 0.1, stratified=True)
    assert {r.split for r in strat.collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError):
        splits.link_split(e, ["h"], ["r"], 0.5, 0.5)


def test_leaks_move(spark):
    inv = spark.createDataFrame([("has", "of"), ("of", "has"), ("with", "with")], "r string, inv string")
    df = spark.createDataFrame([(1, "has", 2, "train"), (2, "of", 1, "test"), (3, "with", 4, "val"), (4, "with", 3, "train"), (5, "has", 6, "train")], "h long, r string, t long, split string")
    assert splits.leaks(df.where("split = 'train'"), df.where("split <> 'train'"), inv).count() == 2
    moved = splits.without_leaks(df, inv)
    assert splits.leaks(moved.where("split = 'train'"), moved.where("split <> 'train'"), inv).count() == 0
    assert {(r.h, r.split) for r in moved.collect()} == {(1, "test"), (2, "test"), (3, "val"), (4, "val"), (5, "train")}


def test_entity_hold_out(spark):
    nodes = spark.createDataFrame([(f"a{k}", "a") for k in range(20)] + [("b0", "b")], "node_id string, node_type string")
    edges = edge_table(spark, [(f"a{k}", f"a{(k + 1) % 20}") for k in range(20)] + [("b0", "a0")])
    held = splits.hold_out_entities(nodes, edges, 0.1)
    assert held.count() == 2 and {r.node_type for r in held.collect()} == {"a"}
    assert splits.inductive_split(edges, held).where("inductive").count() >= 2


def test_negatives_avoid_positives(spark):
    pool = spark.createDataFrame([("r", side, k, f"{side}{k}", 5) for side in ("head", "tail") for k in range(5)], "r string, side string, at long, item string, n long")
    t = spark.createDataFrame([(f"head{k}", "r", f"tail{k}") for k in range(5)], "h string, r string, t string")
    got = splits.corrupt(t, pool, 4).collect()
    assert len(got) == 20 and all((g.h == g.of_h) or (g.t == g.of_t) for g in got) and {g.h[:4] for g in got} == {"head"}
    cand = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a long, b long")
    neg = splits.negatives(cand, cand.where("a = b"), ["a", "b"], 6).collect()
    assert len(neg) == 6 and all(r.a != r.b for r in neg)


def test_dense_index_and_triples(spark, tiny):
    nodes, edges = tiny
    idx = {r.node_id: (r.idx, r.global_id) for r in build.dense_index(nodes).collect()}
    assert idx == {"N2": (0, 0), "N4": (0, 1), "N1": (0, 2), "N3": (0, 3)}
    assert {tuple(r) for r in build.global_triples(nodes, edges).collect()} == {(0, 0, 2), (2, 1, 3)}
    many = spark.createDataFrame([(f"{k:04d}", "t") for k in range(1500)], "node_id string, node_type string")
    assert sorted(r.idx for r in build.dense_index(many).collect()) == list(range(1500))


def test_unnesting(spark):
    df = spark.createDataFrame([("P", "d1|Flu|x; d2|Cold;bad", "a; b;;")], "p string, d string, l string")
    assert {(r.id, r.name) for r in build.unnest_pairs(df, "p", "d").collect()} == {("d1", "Flu|x"), ("d2", "Cold")}
    assert [r.item for r in build.unnest_list(df, "p", "l").collect()] == ["a", "b"]
    one = spark.range(1).select(build.enzyme_relation(F.lit("FUT8ase"), F.lit("x")), build.enzyme_relation(F.lit("G"), F.lit("A Hydrolase")), build.enzyme_relation(F.lit("FUT8"), F.lit(None).cast("string")), build.subsumption_relation(F.lit("Ancestor")), build.subsumption_relation(F.lit("?")))
    assert tuple(one.first()) == ("consumed_by", "consumed_by", "produced_by", "child_of", None)


def test_site_rules(spark):
    df = spark.createDataFrame([("", "P1", "N", "5"), ("E9", "P1", "N", "5"), ("E1", "P1-2", "N", "5"), ("E1", "P1", "B", "5"), ("E1", "P1", "N", "x")], "ev string, acc string, res string, pos string")
    got = [r.reject_reason for r in validate.reject_reason(df, validate.site_rules("ev", "acc", "res", "pos", ["E1"])).collect()]
    assert got == [None, "evidence", "isoform", "residue", "position"]


def test_expression_fixture(spark):
    x = spark.createDataFrame([("T cell", "FUT8", 2.5), ("T cell", "ST6GAL1", 1.2), ("B cell", "FUT8", 3.0), ("B cell", "ST6GAL1", 0.5), ("Macrophage", "FUT8", 1.0)], "cell_type string, gene string, value double")
    wide = ag.pivot_max(x, "cell_type", "gene", "value", ["FUT8", "ST6GAL1", "MGAT5"]).orderBy("cell_type").collect()
    assert [tuple(r)[1:] for r in wide] == [(3.0, 0.5, 0.0), (1.0, 0.0, 0.0), (2.5, 1.2, 0.0)]
    assert {r.value for r in ag.normalized_expression(x, "cell_type", "value").where("gene = 'FUT8'").collect()} == {1.0}


def test_files_round_trip(spark, tiny, tmp_path):
    nodes, edges = tiny
    writers.write_graph(nodes, edges, f"file://{tmp_path}/g")
    n, e = readers.read_graph(spark, f"file://{tmp_path}/g")
    assert n.count() == 4 and e.count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.tsv").write_text("id\tx\n1\ta\n2\tb\n")
    (tmp_path / "t" / "skip.md").write_text("no")
    got = readers.read_folder(spark, f"file://{tmp_path}/t")
    assert list(got) == ["one"] and got["one"].count() == 2
    (tmp_path / "r.json").write_text('[{"id": "a", "v": 1}, {"id": "b", "v": 2}, {"id": "a", "v": 3}]')
    assert {r.id: r.v for r in readers.read_records(spark, f"file://{tmp_path}/r.json", "id", "id string, v long").collect()} == {"a": 3, "b": 2}
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xlsx")
    with pytest.raises(FileNotFoundError):
        readers.read_graph(spark, f"file://{tmp_path}/nowhere")
    sums = writers.manifest(spark, f"file://{tmp_path}/t").collect()
    assert len(sums) == 2 and all(len(r.sha256) == 64 for r in sums)
    (tmp_path / "runs" / "a").mkdir(parents=True)
    (tmp_path / "runs" / "a" / "results.json").write_text('{"mrr": 0.5}')
    assert [tuple(r) for r in readers.experiments(spark, f"file://{tmp_path}/runs", "mrr double").collect()] == [("a", 0.5)]


def test_lines_metadata_and_deep_search(spark):
    lines = spark.createDataFrame([("# c",), ("P1\t5\t0.9",), ("P2\tx",), ("",)], "value string")
    got = [tuple(r) for r in readers.parse_lines(lines, [("id", "string"), ("pos", "int"), ("score", "double")], 3).collect()]
    assert got == [("P1", 5, 0.9, False), ("P2", None, None, True)]
    df = spark.createDataFrame([('{"a": {"b": [{"wurcs": "W"}]}}',), ("not json",), (None,), ("{}",)], "t string")
    assert [r[0] for r in df.select(readers.find_deep(F.col("t"), ["wurcs"])).collect()] == ["W", None, None, None]
    assert [r[0] for r in df.select(F.size(readers.parse_metadata(F.col("t")))).collect()] == [1, 0, 0, 0]


def test_runner_and_config():
    did = []
    stages = [("a", lambda: did.append("a")), ("b", lambda: 1 / 0), ("c", lambda: did.append("c"))]
    run = run_stages(stages)
    assert did == ["a"] and not run.ok and [r[1] for r in run.rows] == ["done", "failed"]
    assert [r[1] for r in run_stages(stages, go_on=True).rows] == ["done", "failed", "done"]
    assert [r[1] for r in run_stages(stages, only=["c"], dry=True).rows] == ["planned"]
    with pytest.raises(ValueError):
        run_stages(stages, only=["z"])
    c = Config().layered({"seed": 1}, {"seed": "2", "strict": "no"}, environ={"KGLOOM_MIN_SCORE": "0.5"})
    assert (c.seed, c.strict, c.min_score) == (2, False, 0.5)
    with pytest.raises(ValueError):
        Config().layered({"nope": 1})


def test_stream_equals_batch(spark, tmp_path):
    from kgloom.session import table
    from kgloom.streaming import events as ev
    from tests.conftest import SF

    batch = table(spark, SF, "events")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    q = ev.windowed_counts(ev.read_stream(spark, f"{tmp_path}/in", batch.schema)).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r.start), r.event_type, r.n, round(r.total, 4))
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, ev.windowed_counts(batch).collect()))
    assert ev.sessions(batch).count() > 0


# places over ranges, paired tests


def test_places_and_running_values_equal_windows(spark):
    from pyspark.sql import Window as W

    from kgloom.operators import ranges

    data = [(None if k % 50 == 0 else k % 3, (k * 7919) % 101 / 7.0, k) for k in range(600)]
    df = spark.createDataFrame(data, "g int, v double, id int").repartition(3)
    got = {r.id: (r.place, r.g) for r in ranges.places(df, ["g"], [F.desc("v"), "id"]).collect()}
    w = W.partitionBy("g").orderBy(F.desc("v"), "id")
    assert got == {r.id: (r.p, r.g) for r in df.withColumn("p", F.row_number().over(w)).collect()}
    held = ranges.ranged(df, [], ["v", "id"])
    for reverse, f in ((False, F.max), (True, F.min), (False, F.sum)):
        out = {r.id: r.x for r in ranges.running(held, [], ["v", "id"], f, {"x": "v"}, inclusive=False, reverse=reverse).collect()}
        order = sorted(((v, i) for _, v, i in data), reverse=reverse)
        one = {F.max: max, F.min: min, F.sum: sum}[f]
        for n, (_, i) in enumerate(order):
            before = [v for v, _ in order[:n]]
            assert out[i] is None if not before else abs(out[i] - one(before)) < 1e-9
    assert ranges.places(df.where("false"), ["g"], ["v", "id"]).count() == 0


def test_step_down_and_false_discovery(spark):
    df = spark.createDataFrame([(k, 1, p) for k, p in enumerate((0.01, 0.04, 0.03, 0.005, None, 0.04))], "id int, g int, p double")
    h = {r.id: r.holm for r in me.holm(df, ["g"], "p", "id").collect()}
    b = {r.id: r.bh for r in me.benjamini_hochberg(df, ["g"], "p", "id").collect()}
    assert [h[k] and round(h[k], 9) for k in range(6)] == [0.04, 0.09, 0.09, 0.025, None, 0.09]
    assert [b[k] and round(b[k], 9) for k in range(6)] == [0.025, 0.04, 0.04, 0.025, None, 0.04]


def test_chosen_test(spark):
    n, w, p = me.shapiro_wilk(spark.createDataFrame([(float(x),) for x in (236, 148, 154, 158, 160, 161, 162, 166, 170, 182, 195)] + [(None,)], "x double"), "x")
    assert abs(w - 0.7888) < 2e-3 and abs(p - 0.0067) < 5e-4
    of = lambda d: me.chosen_test(spark.createDataFrame([(float(x), 0.0) for x in d], "a double, b double"), "a", "b").first()
    assert of([0.3, 0.1, 0.2, 0.4, 0.25]).test == "paired t"
    skewed = of([0.01, 0.02, 0.03, 0.015, 0.025, 0.012, 9.0])
    assert (skewed.test, skewed.statistic) == ("signed ranks", 0.0) and abs(skewed.p - 2 / 128) < 1e-12
    assert (of([0, 0, 0]).p, of([1.0, 2.0]).test) == (1.0, "signed ranks")


def test_lookups(spark):
    from kgloom.operators import lookups as lk

    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert lk.whitelisted(df, "id", None).count() == 2 and lk.whitelisted(df, "id", df.where("n = 1")).count() == 1
    with pytest.raises(ValueError):
        lk.whitelisted(df, "id", df, "other")
    kinds = spark.createDataFrame([("N-linked (GlcNAc)",), ("o-linked",), (None,)], "t string")
    assert [r[0] for r in kinds.select(lk.linkage_class(F.col("t"))).collect()] == ["N-linked", "O-linked", None]
    assert [r[0] for r in kinds.select(lk.type_contains(F.col("t"), "GlcNAc")).collect()] == [True, False, False]
    seqs = spark.createDataFrame([("P1", "AAA"), ("P2-1", "CCC")], "node_id string, sequence string")
    ids = spark.createDataFrame([("P1-2",), ("P2",), ("P3",)], "id string")
    assert {r.id: r.sequence for r in lk.sequence_of(ids, "id", seqs).collect()} == {"P1-2": "AAA", "P2": "CCC", "P3": None}


def test_position_of_an_isoform(spark):
    from kgloom.functions import sequence as sq

    rows = [("ACDNA", "ACDNA", 4), ("ACDNA", "ACDQA", 4), ("ACDNA", "ACDNG", 4), ("MNKTA", "MNKTANKT", 2)]
    got = spark.createDataFrame(rows, "i string, c string, p int").select(sq.canonical_position("i", "c", "p")).collect()
    assert [r[0] for r in got] == [4, None, 4, 2]


def test_report_of_a_small_graph(spark):
    """Every kind of finding once, repeated ids and edges, null metadata; the order of the checks."""
    site = "SITE::P12345-1::5::N"
    nodes = [("P12345", "protein", "{}"), ("P12345", "protein", '{"a": 1}'), (site, "site", None), ("SITE::P12345-2::5::N", "site", " "), ("SITE::P99999::7::B", "site", "x"), ("SITE::x", "site", "x"), ("G1", "glycan", "x"), ("lonely", "disease", "x")]
    edges = [("P12345", site, "has_site")] * 3 + [(site, "SITE::P99999::7::B", "ptm_crosstalk"), (site, "G1", "ptm_crosstalk"), ("G1", "G1", "inhibits"), ("ghost", "SITE::x", "has_site"), ("P12345", "LOC::nowhere", "localized_in"), ("SITE::P12345-2::5::N", "SITE::x", "has_variant")]
    n = spark.createDataFrame(nodes, "node_id string, node_type string, metadata string")
    e = spark.createDataFrame(edges, "source_id string, target_id string, relation string")
    rows = validate.check_graph(n, e).orderBy("place").collect()
    names = [r.check for r in rows]
    got = {r.check: (r.severity, r.n, r.sample) for r in rows if r.n and r.sample}
    assert got == {
        "orphans": ("warning", 1, ["lonely"]), "duplicate_edges": ("warning", 2, [f"P12345|has_site|{site}"]), "dangling_sources": ("error", 1, ["ghost"]), "dangling_targets": ("error", 1, ["LOC::nowhere"]),
        "self_loops": ("warning", 1, ["G1|inhibits|G1"]), "cycle_inhibits": ("error", 1, ["G1"]), "bad_ids_glycan": ("warning", 1, ["G1"]), "localized_in_targets": ("warning", 1, ["LOC::nowhere"]), "site_format": ("warning", 1, ["SITE::x"]),
        "site_isoform": ("warning", 1, ["SITE::P12345-2::5::N"]), "site_residue": ("warning", 1, ["SITE::P99999::7::B"]), "unmapped_sites": ("warning", 1, ["SITE::P99999::7::B"]), "has_site_sources": ("warning", 1, ["ghost"]), "ptm_crosstalk_targets": ("warning", 1, ["G1"]),
    }
    values = {r.check: (r.n, r.value) for r in rows}
    assert values["nodes"] == (8, None) and values["metadata"] == (5, 62.5) and values["in_degree"] == (3, 1.8) and values["components"][0] == 3 and values["out_degree_zero"] == (3, None)
    order = ["density", "orphans", "duplicate_edges", "dangling_sources", "self_loops", "cycle_inhibits", "in_degree", "components", "metadata", "bad_ids_glycan", "localized_in_sources", "site_format", "unmapped_sites", "has_site_sources", "ptm_crosstalk_sources"]
    assert [x for x in names if x in order] == order
    empty = {r.check: r.n for r in validate.check_graph(n.where("false"), e.where("false")).collect()}
    assert not any(empty.values())


def test_normality_of_many_and_few(spark):
    """No bound on the number of values; small numbers by their own rules."""
    from statistics import NormalDist

    even = [NormalDist(5, 2).inv_cdf((k + 0.5) / 6000) for k in range(6000)]
    of = lambda xs: me.shapiro_wilk(spark.createDataFrame([(float(x),) for x in xs], "x double"), "x")
    n, w, p = of(even)
    assert n == 6000 and w > 0.999 and p > 0.5
    assert of([2.0**k for k in range(12)])[2] < 0.001 and of([1, 1, 1, 1])[1:] == (1.0, 1.0) and of([1, 2])[2] == 0.0
    assert of([1, 2, 4])[1] == pytest.approx(0.964286, abs=1e-5) and of([1, 2, 3, 7])[1] == pytest.approx((0.6872 * 6 + 0.1677) ** 2 / 20.75, abs=2e-3)  # by the published coefficients


def test_bootstrap_is_the_weighted_mean_of_each_resample(spark):
    import numpy as np

    df = spark.range(500).select(F.col("id"), (F.col("id") * 37 % 101).cast("double").alias("v")).unionAll(spark.createDataFrame([(900, None)], "id long, v double"))
    got = me.bootstrap_ci(df.repartition(5), "v", "id", 300).first()
    rows = df.where("v is not null").select(F.xxhash64(F.lit(42), "id").alias("h"), "v").collect()
    w = me.poisson_weights(np.array([r.h for r in rows]), 300)
    means = (np.array([r.v for r in rows]) @ w) / w.sum(0)
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5]))) and got.mean == pytest.approx(np.mean([r.v for r in rows]))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and got.low < got.mean < got.high


def test_folded_site_nodes_and_edges(spark):
    kind = "uniprot_id string, site_position int, site_residue string, site_type string, evidence_code string, ord int"
    one = spark.createDataFrame([("P1", 5, "N", "N-linked", "E1", 0), ("P1-1", 5, "N", "O-linked", None, 1), ("P1", 5, "N", "N-linked", 'say "E2"', 2), ("", 5, "N", "x", None, 3), ("P2-3", 7, "S", None, None, 4), ("P1", None, "S", None, None, 5), ("P3", 0, "S", None, None, 6)], kind)
    two = spark.createDataFrame([("P1", 5, "N", "glyco", 0), ("P9", 1, "T", "phos", 1)], "uniprot_id string, site_position int, site_residue string, ptm_type string, ord int")
    sources = [("UniProt", one, ["site_type", "evidence_code"]), ("PTMCode", two, ["ptm_type"])]
    nodes = {r.node_id: (r.label, r.metadata) for r in build.site_nodes(sources).collect()}
    assert nodes["SITE::P1-1::5::N"] == ("P1:N5", '{"evidence_code": ["E1","say \\"E2\\""], "position": "5", "ptm_type": "glyco", "residue": "N", "site_type": ["N-linked","O-linked"], "source": ["UniProt","PTMCode"]}')
    assert set(nodes) == {"SITE::P1-1::5::N", "SITE::P2-3::7::S", "SITE::P9-1::1::T"} and nodes["SITE::P2-3::7::S"][0] == "P2-3:S7"
    proteins = spark.createDataFrame([("P1",), ("P2-1",)], "node_id string")
    edges = {(r.source_id, r.target_id): r.metadata for r in build.site_edges(sources, proteins).collect()}
    assert set(edges) == {("P1", "SITE::P1-1::5::N"), ("P2-1", "SITE::P2-3::7::S")} and edges["P2-1", "SITE::P2-3::7::S"] == '{"source": "UniProt"}'


def test_sets_and_statistics_of_sites(spark):
    edges = spark.createDataFrame([("p1", "d", "r", "protein", "disease"), ("d", "p2", "r", "disease", "protein"), ("p3", "e", "r", "protein", "disease"), ("d", "p2", "s", "disease", "protein")], "source_id string, target_id string, relation string, source_type string, target_type string")
    sets = lambda r: {x.key: x["items"] for x in ag.sets_either_way(edges, r, "disease", "protein").collect()}
    assert sets("r") == {"d": ["p1"], "e": ["p3"]} and sets("s") == {"d": ["p2"]} and sets("none") == {}
    df = spark.createDataFrame([("P1", 3, "G1", "N"), ("P1", 3, "G1", ""), ("P1", 4, "G2", None), ("P2", 4, "G9", "N")], "p string, at int, g string, kind string")
    got = {(r.measure, r.name): (r.n, r.percent) for r in ag.site_statistics(df, "p", "at", "g", "kind", spark.createDataFrame([("G1",), ("G2",), ("G2",)], "g string")).collect()}
    assert got == {("proteins", None): (2, None), ("sites", None): (3, None), ("items", None): (3, None), ("triples", None): (3, None), ("known items", None): (2, 66.67), ("kind", "N"): (2, None), ("kind", "unknown"): (2, None)}


def test_best_rank_of_a_group(spark):
    scores = spark.createDataFrame([(a, k, float(k * a % 7)) for a in (1, 3) for k in range(7)], "alpha int, item int, score double")
    groups = spark.createDataFrame([("g", 2), ("g", 5), ("h", 0), ("none", 99)], "group string, item int")
    got = {(r.alpha, r.group): r["rank"] for r in rk.group_best_ranks(groups, scores, ["alpha"], 7).collect()}
    assert got == {(1, "g"): 2, (1, "h"): 7, (1, "none"): 7, (3, "g"): 1, (3, "h"): 7, (3, "none"): 7}
    assert [r.alpha for r in rk.broadest(scores.unionAll(scores.where("alpha = 3")), "alpha", 1).collect()] == [3]
