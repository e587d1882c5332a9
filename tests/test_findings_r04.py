"""Small tables on which the queries were wrong, or slow by their plans, before round 4's findings."""

import itertools
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kgloom import catalog, catalog_rank
from kgloom.functions import sequence, trees, vectors, windows
from kgloom.operators import aggregates, blocks, lookups, ranking, samples, tiles
from tests.conftest import rows


def same_on(spark, folder, name, **tables):
    """The query's rows over small tables of our own against its SQL's."""
    c = duckdb.connect()
    for t, data in tables.items():
        pq.write_table(data, f"{folder}/{t}.parquet")
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, str(folder))
    cur = c.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert got == want
    return got


def test_window_shares_of_letters_with_two_capitals(spark, tmp_path):
    """The window counts letters as written; one whose capital is two letters moves nothing and counts as none."""
    texts = ["aßaßaßaßaßaßaßaßaßaßaßaßaßaßaßaßaßaßaßaßaßaßa", "ﬁﬃﬅ" * 4 + "yay" * 12, "ẙẚ" * 30, "xxxıſay", "", None, "ay" * 40]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    assert len(same_on(spark, tmp_path, "window_shares", documents=docs)) == len(texts)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_jaccard_of_common_items_meets_in_blocks(spark):
    """Sets that share nearly all items: no row for each shared item of each pair, and the same shares."""
    rng = random.Random(1)
    sets = {f"k{n:03}": {rng.randrange(80) for _ in range(rng.randrange(1, 120))} for n in range(300)}
    data = [(k, x) for k, xs in sets.items() for x in xs] + [("k000", next(iter(sets["k000"]))), (None, 3), ("lone", 1000)]
    got = lookups.jaccard(spark.createDataFrame(data, "k string, x long"), "k", "x", 0.4)
    assert "MapInArrow" in plan_of(got)
    share = lambda a, b: len(a & b) / len(a | b)
    want = {(a, b): share(sets[a], sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == {p: v for p, v in want.items() if v >= 0.4}
    wide = [(str(n), x) for n in range(200) for x in range(n * 30, n * 30 + 5000)]  # more members than are laid out at once
    got = blocks.set_pairs(spark.createDataFrame(wide, "key string, feature int"), 0.5)
    sets = {str(n): set(range(n * 30, n * 30 + 5000)) for n in range(200)}
    want = {(a, b): share(sets[a], sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == {p: v for p, v in want.items() if v >= 0.5}


def test_jaccard_of_rare_items_is_joined(spark):
    data = [(n, x) for n in range(400) for x in (n // 2, 1000 + n // 3)]
    got = lookups.jaccard(spark.createDataFrame(data, "k int, x int"), "k", "x")
    assert "MapInArrow" not in plan_of(got)
    assert got.count() == sum(a // 2 == b // 2 or a // 3 == b // 3 for a, b in itertools.combinations(range(400), 2))


@pytest.mark.parametrize("odd", [False, True])
def test_profiles_meet_in_blocks(spark, odd):
    """Sums over shared features alone: nulls add nothing, infinite values count where both sides have them."""
    rng = random.Random(2)
    some = [0.0, -1.5, 2.0, None, float("inf")] if odd else [1.0, 2.0, 3.5]
    side = lambda n, p: [(k, f, rng.choice(some)) for k in range(n) for f in range(6) if rng.random() < p]
    q, i = side(130, 0.7 if odd else 1.1), side(150, 0.8 if odd else 1.1)
    got = aggregates.profile_scores(spark.createDataFrame(q, "query long, f int, weight double"), spark.createDataFrame(i, "item long, f int, weight double"), "f")
    assert "MapInArrow" in plan_of(got)
    want = {}
    for k, f, w in q:
        for j, g, v in i:
            if f == g:
                want.setdefault((k, j), []).append(None if w is None or v is None else w * v)
    summed = {p: sum(there) if (there := [x for x in xs if x is not None]) else None for p, xs in want.items()}
    found = {(r.query, r.item): r.score for r in got.collect()}
    assert found.keys() == summed.keys()
    assert all(str(found[p]) == str(summed[p]).replace("-0.0", "0.0") or found[p] == summed[p] for p in found)


def test_counts_of_higher_products_are_exact():
    """Ties by order of addition, copies, and values that single precision does not hold."""
    rng = np.random.default_rng(3)
    y = rng.normal(size=(900, 24))
    y[100:200] = y[:100]  # copies
    y[200:300] = y[:100] * (1 + 1e-15)  # nearly
    y[300], y[301], y[302], y[303] = 1e300, np.inf, -np.inf, 1e-300
    x = np.concatenate([y[:320], rng.normal(size=(300, 24)) * 1e-20])
    own = blocks.in_order(x, y[: len(x)])
    own[np.isnan(own)] = -np.inf
    with np.errstate(all="ignore"):
        score = np.array([blocks.in_order(np.broadcast_to(v, y.shape), y) for v in x])
        want = (score > own[:, None]).sum(1)
    assert blocks.higher(x, own, y).tolist() == want.tolist()


def test_alignment_and_links_count_products_in_blocks(spark, monkeypatch):
    """No tree of tiles over vectors; rows without a vector or of another length count for none."""
    rng = random.Random(4)
    v = [[round(rng.gauss(0, 1), 2) for _ in range(6)] for _ in range(150)]
    v[5], v[7], v[9], v[11] = None, [1.0, 2.0], [float("nan")] * 6, v[13]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "id long, v array<float>")
    monkeypatch.setattr(tiles, "tree", None)
    got = ranking.alignment(df.select("id", F.col("v").alias("x")), df.select((F.col("id") + 1).alias("id"), F.col("v").alias("y"))).first()

    def dot(a, b):
        if a is None or b is None or len(a) != len(b):
            return None
        s = sum(np.float64(np.float32(p)) * np.float64(np.float32(q)) for p, q in zip(a, b))
        return -math.inf if math.isnan(s) else s

    ranks = []
    for k in range(1, 150):
        own = dot(v[k], v[k - 1])
        ranks.append(1 + sum(own is not None and (s := dot(v[k], y)) is not None and s > own for y in v))
    assert got.n == 149 and got.mrr == pytest.approx(sum(1 / r for r in ranks) / 149)
    # links: the pool has no kinds; known items that score higher are taken off
    there = spark.createDataFrame([(k, x) for k, x in enumerate(v) if k not in (5, 7, 9)], "item long, v array<float>")
    triples = [(h, "r", (h * 7 + 1) % 150) for h in range(20, 60)]
    known = triples + [(h, "r", t) for h in range(20, 40) for t in range(100, 130)]
    anchors = there.select(F.col("item").alias("anchor"), F.col("v").alias("x"))
    kinds = "h long, r string, t long"
    found = ranking.link_ranks(spark.createDataFrame(triples, kinds), there, spark.createDataFrame(known, kinds), lambda q: q.join(anchors, "anchor"), tiles.by_inner_product("x", "v", ())).collect()
    for r in found:
        of = {t for h, _, t in known if h == r.anchor} if r.direction == "tail" else {h for h, _, t in known if t == r.anchor}
        own = dot(v[r.anchor], v[r.item])
        assert r["rank"] == 1 + sum(dot(v[r.anchor], x) > own for k, x in enumerate(v) if k not in of and k not in (5, 7, 9))
    assert len(found) == sum(1 for h, _, t in triples if {h, t}.isdisjoint({5, 7, 9})) * 2


def test_nearest_by_cosine_with_ties_and_odd_vectors(spark):
    """Copies, equal rounded cosines, zero and missing vectors: as the pairs one by one, in the same order."""
    rng = random.Random(5)
    v = [[rng.choice([-1.0, 0.0, 1.0, 0.5]) for _ in range(3)] for _ in range(260)] + [[1.0, 1e-4 * k, 0.0] for k in range(40)]
    v[3], v[4], v[8], v[9] = None, [1.0, None, 2.0], [1e-200, 0.0, 0.0], [1.0, 2.0]
    df = spark.createDataFrame([(n, x, "ab"[n % 2] if n % 50 else None) for n, x in enumerate(v)] + [(10, v[10], "a")], "id long, vector array<double>, g string")
    got = ranking.nearest(df, ["g"], 5, 6)
    assert "MapInArrow" in plan_of(got)
    side = lambda a, b: df.select("g", F.col("id").alias(a), F.col("vector").alias(b))
    pairs = side("q", "x").join(side("item", "y"), "g").where("q <> item").select("q", "item", vectors.cosine(F.col("x"), F.col("y")).alias("score"))
    best = lambda d: sorted(map(tuple, ranking.top(d.withColumn("score", F.round("score", 6)), ["q"], 5).select("q", "position", "item", "score").collect()), key=str)
    assert best(got) == best(pairs)


def test_mapped_expression_moves_no_row_of_the_result(spark):
    """Accessions are filtered before they meet the expression; rows and columns stay, also repeated ones."""
    e = spark.createDataFrame([("g1", 1.0), ("g1", 1.0), ("g2", 2.0), (None, 3.0), ("g4", 4.0)], "gene string, value double")
    m = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g1", "b"), ("g2", "c"), ("g4", "x"), (None, "a")], "gene string, node_id string")
    n = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "node_id string")
    got = lookups.mapped_expression(e, m, n)
    assert sorted((r.gene, r.node_id, r.value) for r in got.collect()) == [("g1", "a", 1.0)] * 2 + [("g1", "b", 1.0)] * 4 + [("g2", "c", 2.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert min(k for k, x in enumerate(plan) if "Generate explode(_ids" in x) < min(k for k, x in enumerate(plan) if "Join" in x)


def test_class_totals_without_pairs(spark):
    queries = spark.createDataFrame([(k,) for k in (1, 2, 2, 3, 4, 5)], "query long")
    items = spark.createDataFrame([(10, "x"), (11, "x"), (11, "y"), (12, None), (13, "z")], "item long, class string")
    classes = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, None), (5, "none")], "query long, class string")
    pairs = ranking.class_candidates(queries, items, classes).groupBy("query").agg(F.count("*").alias("n"), F.sum("item").alias("total"))
    got = ranking.class_candidate_totals(queries, items, classes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) == [(1, 2, 21), (2, 3, 32), (3, 3, 34), (4, 3, 34)]
    assert "CartesianProduct" not in plan_of(got) and got.where("n > 0").count() == 4


def test_trees_of_a_batch_by_hand(spark):
    """Many trees in one task: repeated bonds, circles, nodes beyond the chain, carbons that are no numbers."""
    rng, letters, data = random.Random(6), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", []
    for k in range(300):
        n = rng.choice([1, 2, 5, 30, 52])
        tokens = [f"{letters[rng.randrange(min(52, n + 2))]}{rng.choice('34?')}-{letters[rng.randrange(min(52, n + 1))]}1" for _ in range(rng.randrange(2 * n))]
        data.append((f"t{k}", f"WURCS=2.0/2,{n},1/[a1122h-1b_1-5][a2112h-1a_1-5]/" + "-".join(rng.choice("123") for _ in range(n)) + "/" + "_".join([*tokens, "x", "b3?-c1"])))
    data += [("none", None), ("empty", "WURCS=2.0//")]
    got = trees.trees(spark.createDataFrame(data, "g string, s string").coalesce(1), "g", "s")
    assert "MapInArrow" in plan_of(got)
    found = {(r.g, r.node): r for r in got.collect()}
    assert len(found) == got.count() and not {"none", "empty"} & {g for g, _ in found}
    for g, text in data[:300]:
        chain, bonds = text.split("]/")[1].split("/")[0].split("-"), text.rsplit("/", 1)[1].split("_")
        up = {}
        for place, token in enumerate(bonds):
            if token != "x":
                parent, child, carbon = letters.index(token[0]), letters.index(token.split("-")[1][0]), token.split("-")[0][1:]
                if max(parent, child) < len(chain) and child and child not in up:
                    up[child] = parent, place, 0 if carbon == "?" else int(carbon) if carbon.isdigit() else None
        order, depth = [], {}

        def walk(v, d, up=up, order=order, depth=depth):
            depth[v] = d
            for c in sorted((c for c in up if up[c][0] == v), key=lambda c: up[c][1]):
                walk(c, d + 1)
            order.append(v)

        walk(0, 0)
        for v in range(len(chain)):
            r, kids = found[g, v], [c for c in up if up[c][0] == v]
            assert (r.parent, r.parent_carbon) == ((up[v][0], up[v][2]) if v in up else (None, None))
            assert (r.depth, r.bottom_up) == ((depth[v], order.index(v) + 1) if v in depth else (None, None))
            assert (r.n_children, r.branching, r.n_siblings) == (len(kids), len(kids) > 1, sum(up[c][0] == up[v][0] for c in up) - 1 if v in up else 0)
            assert (r.residue, r.name, r.anomer) == {"1": ("a1122h-1b_1-5", "Man", "beta"), "2": ("a2112h-1a_1-5", "Gal", "alpha"), "3": ("", "Unknown", "unknown")}[chain[v]]


def test_motifs_of_many_texts_at_once(spark, monkeypatch):
    """As the column functions give them one by one, also for letters beyond ASCII, overlaps, ends and short texts."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("NNNSTPACDé😀Ø\\nW") for _ in range(rng.choice([0, 1, 2, 3, 40, 300]))) for _ in range(900)] + [None, "NNSS", "NAS", "NPS"]
    df = spark.createDataFrame(list(enumerate(texts)), "protein int, sequence string").coalesce(1)
    monkeypatch.setattr(samples, "LETTERS", 1000)
    got = {(r.protein, r.position): (r["keys"], r.context) for r in samples.motifs(df).collect()}
    s, p = F.col("sequence"), F.col("position")
    each = df.withColumn("starts", sequence.sequon_positions(s)).withColumn("n", F.size("starts")).withColumn("position", F.explode("starts"))
    want = each.select("protein", "position", windows.key_residues(s, p).alias("keys"), windows.motif_context(s, p, F.col("n")).alias("context")).collect()
    assert len(got) == len(want) > 500
    for r in want:
        assert got[r.protein, r.position] == (r["keys"], pytest.approx(r.context, abs=1e-12))


@pytest.mark.parametrize("few", [True, False])
def test_filtered_ranks_by_values_or_tiles(spark, monkeypatch, few):
    """Scores depend on few values: each pair of them is scored once; ties and known items as by hand."""
    monkeypatch.setattr(ranking, "SCORES", 200 if few else 0)
    monkeypatch.setattr(ranking, "count_higher", None if few else tiles.count_higher)
    items = [(k, k % 5, k * 17 % 997) for k in range(80)]
    known = sorted({(q, (q * 13 + 7 * j) % 80) for q in range(30) for j in range(9)})
    score = lambda q, k: 1000 * (k % 5) + (q * 31 % 997 + k * 17 % 997) % 997
    asks = spark.createDataFrame([(q, k, q * 31 % 997, score(q, k)) for q, k in known[::3]], "q long, item long, a long, own long")
    wrapped = catalog_rank.wrapped_scoring(lambda x: x["freq"])
    got = ranking.filtered_ranks(asks, spark.createDataFrame(items, "item long, freq long, b long"), spark.createDataFrame(known, "q long, item long"), [], ["q"], "item", wrapped, lambda q: q.withColumn("a", F.col("q") * 31 % 997), ["a"]).collect()
    assert len(got) == len(known[::3])
    for r in got:
        assert r["rank"] == 1 + sum(score(r.q, k) > r.own and (r.q, k) not in set(known) for k, _, _ in items)


def test_top_k_broadcasts_no_blocks(spark, monkeypatch):
    """Blocks of queries are repeated for every shard of a wave, which a file's size does not tell: none is broadcast."""
    topk = pytest.importorskip("kgloom.llm.topk")
    plans, save = [], topk.Scratch.save
    monkeypatch.setattr(topk.Scratch, "save", lambda self, df, name: (plans.append((name, plan_of(df))), save(self, df, name))[1])
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    rng = random.Random(9)
    v = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(300)]
    got = topk.top_k(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>"), 3, 25).collect()
    waves = [p for name, p in plans if name == "best"]
    assert len(waves) >= 3 and not any("BroadcastExchange" in p for p in waves)
    x = np.floor(256 * np.array(v)).astype(np.int64)
    for q in range(0, 300, 25):
        want = sorted((-int(s), k) for k, s in enumerate(x @ x[q]) if k != q)[:3]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(n + 1, k, -s) for n, (s, k) in enumerate(want)]
