"""Queries on ranking, metrics, statistics, splits, vectors and graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import EDGES, edges_of, nodes_of, query
from .functions import vectors as vx
from .operators import graph, metrics as me, ranking as rk, splits
from .operators.tiles import Scoring, between, least_and_most
from .session import table

# ranking: suppliers are queries, parts items, even orders the training part

PAIRS = """t AS (SELECT DISTINCT l_suppkey AS q, l_partkey AS item FROM lineitem WHERE l_orderkey % 10 < 8),
    h AS (SELECT DISTINCT l_suppkey AS q, l_partkey AS item FROM lineitem WHERE l_orderkey % 10 >= 8 EXCEPT SELECT * FROM t),
    p AS (SELECT l_partkey AS item, count(*) AS freq FROM lineitem WHERE l_orderkey % 10 < 8 GROUP BY ALL)"""


def _pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("item"))
    early = F.col("l_orderkey") % 10 < 8
    train = lines.where(early).select("q", "item").distinct()
    held = lines.where(~early).select("q", "item").distinct().join(train, ["q", "item"], "left_anti")
    return lines.where(early).select("item"), train, held


@query(f"WITH {PAIRS} SELECT item, freq, rank() OVER (ORDER BY freq DESC) AS rank, row_number() OVER (ORDER BY freq DESC, item) AS position, round((ln(1 + freq) - avg(ln(1 + freq)) OVER ()) / stddev_samp(ln(1 + freq)) OVER (), 6) AS zscore FROM p")
def popularity_rank(spark, sf_dir):
    out = rk.popularity(_pairs(spark, sf_dir)[0])
    return out.withColumns({"rank": F.col("rank").cast("long"), "position": F.col("position").cast("long"), "zscore": F.round("zscore", 6)})


@query(
    f"""
    WITH {PAIRS}, r AS (SELECT item, rank() OVER (ORDER BY freq DESC) AS rank FROM p)
    SELECT count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(avg(rank), 6) AS mr, round(avg((rank <= 10)::INT), 6) AS hits_10
    FROM h JOIN r ON r.item = h.item
    """
)
def popularity_mrr(spark, sf_dir):
    count, _, held = _pairs(spark, sf_dir)
    ranks = held.join(rk.popularity(count).select("item", "rank"), "item")
    out = rk.rank_metrics(ranks)
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mrr", "mr", "hits_10")))


def wrapped_scoring(tier=None) -> Scoring:
    """1000 * tier + (a + b) % 997, of the asking row's a and the item's tier and b."""
    whole = (lambda x: tier(x)) if tier else (lambda x: F.lit(0))  # noqa: PLW0108

    def of_items(xs):
        return least_and_most(xs, whole, ("low_tier", "high_tier")) | least_and_most(xs, lambda x: x["b"])

    def of_tiles(ts):
        part = lambda n: F.transform(ts, lambda t: t[n])
        return {"low_tier": F.array_min(part("low_tier")), "lo": F.array_min(part("lo")), "high_tier": F.array_max(part("high_tier")), "hi": F.array_max(part("hi"))}

    def bounds(t):
        at = lambda c: (F.col("a") + c) % 997
        whole_run = (t["low_tier"] == t["high_tier"]) & (F.floor((F.col("a") + t["lo"]) / 997) == F.floor((F.col("a") + t["hi"]) / 997))
        lo, hi = F.when(whole_run, at(t["lo"])).otherwise(0), F.when(whole_run, at(t["hi"])).otherwise(996)
        return between(1000 * t["low_tier"] + lo, 1000 * t["high_tier"] + hi)

    return Scoring(("freq", "b") if tier else ("b",), of_items, of_tiles, bounds, lambda x: 1000 * whole(x) + (F.col("a") + x["b"]) % 997)


@query(
    f"""
    WITH {PAIRS}, s AS (SELECT s_suppkey AS q, item, freq * 1000 + (s_suppkey * 31 + item * 17) % 997 AS score FROM supplier, p),
    own AS (SELECT h.q, h.item, s.score FROM h JOIN s ON s.q = h.q AND s.item = h.item),
    c AS (SELECT s.* FROM s ANTI JOIN t ON t.q = s.q AND t.item = s.item),
    f AS (SELECT own.q, own.item, 1 + count(*) FILTER (WHERE c.score > own.score AND NOT EXISTS (SELECT 1 FROM h x WHERE x.q = c.q AND x.item = c.item)) AS rank
          FROM own JOIN c ON c.q = own.q GROUP BY ALL)
    SELECT q, count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(avg((rank <= 50)::INT), 6) AS hits_50 FROM f GROUP BY q
    """
)
def filtered_rank_mrr(spark, sf_dir):
    """Each held item is ranked among all items that its query does not know otherwise."""
    count, train, held = _pairs(spark, sf_dir)
    items = count.groupBy("item").agg(F.count("*").alias("freq"))
    items = items.withColumn("b", F.col("item") * 17 % 997)
    wrapped = wrapped_scoring(lambda x: x["freq"])
    asks = held.join(items, "item").withColumn("a", F.col("q") * 31 % 997)
    asks = asks.select("q", "item", "a", wrapped.score({"freq": F.col("freq"), "b": F.col("b")}).alias("own"))
    ranks = rk.filtered_ranks(asks, items, train.unionAll(held), [], ["q"], "item", wrapped, lambda q: q.withColumn("a", F.col("q") * 31 % 997), ["a"])
    out = rk.rank_metrics(ranks, ["q"])
    return out.select("q", "n", F.round("mrr", 6).alias("mrr"), F.round("hits_50", 6).alias("hits_50"))


SCORED = """s AS (SELECT c_nationkey AS q, c_custkey AS item, c_acctbal AS a, coalesce(v, 0) AS b FROM customer
    LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY ALL) ON o_custkey = c_custkey)"""


def _scored(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    c = table(spark, sf_dir, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("a"), F.coalesce("v", F.lit(0.0)).alias("b"))


MINMAX = "(CASE WHEN max({0}) OVER w > min({0}) OVER w THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) ELSE 0 END)"


@query(f"WITH {SCORED} SELECT q, item, round(0.3 * {MINMAX.format('a')} + 0.7 * {MINMAX.format('b')}, 6) AS blend FROM s WINDOW w AS (PARTITION BY q)")
def minmax_blend(spark, sf_dir):
    return rk.blend(_scored(spark, sf_dir), ["q"], "a", "b", 0.3).select("q", "item", F.round("blend", 6).alias("blend"))


@query(f"WITH {SCORED} SELECT q, item, round(1.0 / (60 + row_number() OVER (PARTITION BY q ORDER BY a DESC, item)) + 1.0 / (60 + row_number() OVER (PARTITION BY q ORDER BY b DESC, item)), 9) AS rrf FROM s")
def reciprocal_fusion(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("b", F.round("b", 4))
    return rk.reciprocal_fusion(s, ["q"], "a", "b").select("q", "item", F.round("rrf", 9).alias("rrf"))


SQL_Z = "(({0} - avg({0}) OVER w) / stddev_samp({0}) OVER w)"


@query(f"WITH {SCORED} SELECT q, item, round(0.5 * {SQL_Z.format('a')} + 0.5 * {SQL_Z.format('b')}, 5) AS zblend FROM s WINDOW w AS (PARTITION BY q)")
def zscore_blend(spark, sf_dir):
    return rk.z_blend(_scored(spark, sf_dir), ["q"], "a", "b", 0.5).select("q", "item", F.round("zblend", 5).alias("zblend"))


@query(
    f"""
    WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY a DESC, item) AS position FROM s),
    x AS (SELECT q, item, {MINMAX.format('a')} + 0.1 * (item % 7) AS v FROM k WHERE position <= 20 WINDOW w AS (PARTITION BY q))
    SELECT q, item, CAST(row_number() OVER (PARTITION BY q ORDER BY v DESC, item) AS INTEGER) AS rank FROM x
    """
)
def top_rerank(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("o", F.col("item") % 7)
    return rk.rerank(s, ["q"], "a", "o", 20, 0.1).select("q", "item", "rank")


@query(
    f"""
    WITH {SCORED}, g AS (SELECT q, item, unnest([0.0, 0.5, 1.0]) AS alpha, {MINMAX.format('a')} AS x, {MINMAX.format('b')} AS y FROM s WINDOW w AS (PARTITION BY q)),
    r AS (SELECT *, rank() OVER (PARTITION BY q, alpha ORDER BY round(alpha * x + (1 - alpha) * y, 9) DESC) AS rank FROM g),
    m AS (SELECT alpha, round(avg(1.0 / rank), 6) AS mrr FROM r WHERE item % 10 = 0 GROUP BY alpha)
    SELECT CAST(alpha AS DOUBLE) AS alpha, mrr, row_number() OVER (ORDER BY mrr DESC, alpha) = 1 AS best FROM m
    """
)
def alpha_search(spark, sf_dir):
    s = _scored(spark, sf_dir)
    out = rk.search_alpha(s, s.where("item % 10 = 0"), ["q"], "a", "b", [0.0, 0.5, 1.0])
    return out.withColumn("mrr", F.round("mrr", 6))


@query("SELECT q, item, CAST(position AS INTEGER) AS position FROM (SELECT o_custkey AS q, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) WHERE position <= 3")
def top_per_query(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"))
    return rk.top(o, ["q"], 3).select("q", "item", "position")


# metrics on labelled documents: longer documents should be better

LABELLED = "d AS (SELECT l.doc_id, lang, quality AS label, n_chars AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", "lang", F.col("quality").alias("label"), F.col("n_chars").alias("score"))


@query(
    f"""
    WITH {LABELLED}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM d)
    SELECT lang, round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS auc
    FROM r GROUP BY lang HAVING sum(label) > 0 AND sum(1 - label) > 0
    """
)
def auc_by_group(spark, sf_dir):
    return me.roc_auc(_labelled(spark, sf_dir), ["lang"]).withColumn("auc", F.round("auc", 6))


@query(
    f"""
    WITH {LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS pos FROM d),
    g AS (SELECT lang, sum(CASE WHEN pos <= 10 THEN label / log2(pos + 1) ELSE 0 END) AS dcg, sum(label) AS n, sum(CASE WHEN pos <= 10 THEN label ELSE 0 END) AS f FROM r GROUP BY lang)
    SELECT lang, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(n, 10) AS BIGINT) + 1) x(i)), 6) AS ndcg, round(f / n, 6) AS recall FROM g WHERE n > 0
    """
)
def ndcg_recall(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    ndcg, recall = me.ndcg_at(d, ["lang"], 10, "doc_id"), me.recall_at(d, ["lang"], 10, "doc_id")
    return ndcg.join(recall, "lang").select("lang", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


@query(f"WITH {LABELLED}, t AS (SELECT * FROM d ORDER BY score DESC, doc_id LIMIT (SELECT CAST(greatest(1, floor(count(*) * 0.05)) AS BIGINT) FROM d)) SELECT round((SELECT avg(label) FROM t) / (SELECT avg(label) FROM d), 6) AS ef")
def enrichment_factor(spark, sf_dir):
    return me.enrichment(_labelled(spark, sf_dir), 0.05, "doc_id").select(F.round("ef", 6).alias("ef"))


@query(
    f"""
    WITH {LABELLED}, v AS (SELECT score, sum(label) AS p, count(*) AS n FROM d GROUP BY score),
    c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen, sum(p) OVER () AS total FROM v)
    SELECT round(sum(tp / seen * p / total), 6) AS ap, round(max(CASE WHEN tp > 0 THEN 2 * (tp / seen) * (tp / total) / (tp / seen + tp / total) ELSE 0 END), 6) AS best_f1 FROM c
    """
)
def pr_auc_f1(spark, sf_dir):
    return me.pr_auc(_labelled(spark, sf_dir)).select(F.round("ap", 6).alias("ap"), F.round("best_f1", 6).alias("best_f1"))


@query(
    f"""
    WITH {LABELLED}, c AS (SELECT count(*) FILTER (WHERE score >= 1000 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 1000 AND label = 0) AS fp,
      count(*) FILTER (WHERE score < 1000 AND label = 1) AS fn, count(*) FILTER (WHERE score < 1000 AND label = 0) AS tn FROM d)
    SELECT round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c
    """
)
def binary_at_threshold(spark, sf_dir):
    out = me.binary_metrics(_labelled(spark, sf_dir), threshold=1000)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(
    f"""
    WITH p AS (SELECT l.quality AS t, CASE WHEN l.toxic = 1 THEN 0 ELSE 1 END AS g FROM labels l),
    k AS (SELECT c, (SELECT count(*) FROM p WHERE t = c) AS r, (SELECT count(*) FROM p WHERE g = c) AS q, (SELECT count(*) FROM p WHERE t = c AND g = c) AS h FROM (VALUES (0), (1)) v(c))
    SELECT round(sum(h) / sum(r), 6) AS accuracy, round(avg(2 * h / (r + q)), 6) AS macro_f1,
      round((sum(h) * sum(r) - sum(r * q)) / sqrt((sum(r) * sum(r) - sum(r * r))::DOUBLE * (sum(r) * sum(r) - sum(q * q))), 6) AS mcc FROM k
    """
)
def confusion_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "labels").select(F.col("quality").alias("t"), (1 - F.col("toxic")).alias("g"))
    out = me.confusion_metrics(p, "t", "g")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(
    f"""
    WITH {LABELLED}, r AS (SELECT row_number() OVER (ORDER BY score, doc_id) - row_number() OVER (ORDER BY (doc_id * 37) % 101, doc_id) AS x FROM d)
    SELECT round(1 - 6 * sum(x * x) / (count(*)::DOUBLE * (count(*) * count(*) - 1)), 6) AS rho FROM r
    """
)
def rank_correlation(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumn("other", (F.col("doc_id") * 37) % 101)
    return me.rank_correlation(d, "score", "other", "doc_id").select(F.round("rho", 6).alias("rho"))


# statistics


@query(
    """
    WITH p AS (SELECT event_type, event_id, (event_id * 7919) % 10007 / 10007.0 AS p FROM events),
    o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n FROM p WINDOW w AS (PARTITION BY event_type ORDER BY p, event_id))
    SELECT event_id, round(least(1, max(p * (n - i + 1)) OVER (PARTITION BY event_type ORDER BY p, event_id ROWS UNBOUNDED PRECEDING)), 9) AS holm,
      round(least(1, min(p * n / i) OVER (PARTITION BY event_type ORDER BY p, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS bh FROM o
    """
)
def holm_bh(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_type", "event_id", ((F.col("event_id") * 7919) % 10007 / F.lit(10007.0)).alias("p"))
    out = me.adjusted(p, ["event_type"], "p")
    return out.select("event_id", F.round("holm", 9).alias("holm"), F.round("bh", 9).alias("bh"))


@query(
    """
    WITH d AS (SELECT lang, toxic, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
    s AS (SELECT lang, count(n_chars) FILTER (WHERE toxic = 1) AS a, count(n_chars) FILTER (WHERE toxic = 0) AS b, avg(n_chars) FILTER (WHERE toxic = 1) AS ma,
      avg(n_chars) FILTER (WHERE toxic = 0) AS mb, var_samp(n_chars) FILTER (WHERE toxic = 1) AS va, var_samp(n_chars) FILTER (WHERE toxic = 0) AS vb FROM d GROUP BY lang)
    SELECT lang, CASE WHEN a >= 2 AND b >= 2 THEN round((ma - mb) / sqrt(((a - 1) * va + (b - 1) * vb) / (a + b - 2)), 6) END AS d FROM s
    """
)
def cohens_d(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return me.cohens_d(d, ["lang"], "toxic", "n_chars").withColumn("d", F.round("d", 6))


@query()
def bootstrap_interval(spark, sf_dir):
    return me.bootstrap_ci(table(spark, sf_dir, "events"), "value", "event_id", 200)


@query(
    """
    WITH p AS (SELECT l_discount * 100 - l_tax * 100 AS d FROM lineitem), t AS (SELECT count(*) AS n, avg(d) / sqrt(var_samp(d) / count(*)) AS t FROM p),
    k AS (SELECT round(d) AS d, rank() OVER (ORDER BY abs(round(d))) + (count(*) OVER (PARTITION BY abs(round(d))) - 1) / 2.0 AS r FROM p WHERE round(d) <> 0),
    w AS (SELECT sum(r) FILTER (WHERE d > 0) AS w FROM k) SELECT n, round(t, 6) AS t, CAST(w AS DOUBLE) AS w FROM t, w
    """
)
def paired_tests(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"))
    whole = o.select(F.round(F.col("a") - F.col("b")).alias("a"), F.lit(0.0).alias("b"))
    return me.paired_test(o, "a", "b").select("n", F.round("t", 6).alias("t")).crossJoin(me.signed_rank(whole, "a", "b").select("w"))  # one row by one row


@query()
def chosen_test(spark, sf_dir):
    """Mean balances of customers and suppliers, paired by nation."""
    mean = lambda t, k, v, n: table(spark, sf_dir, t).groupBy(F.col(k).alias("nation")).agg(F.avg(v).alias(n))
    return me.chosen_test(mean("customer", "c_nationkey", "c_acctbal", "a").join(mean("supplier", "s_nationkey", "s_acctbal", "b"), "nation"), "a", "b")


@query(
    f"""
    WITH {LABELLED}, e AS (SELECT *, doc_id % 13 AS other FROM d),
    x AS (SELECT p.doc_id AS i, q.doc_id AS j, CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5 ELSE 0 END AS a,
      CASE WHEN p.other > q.other THEN 1 WHEN p.other = q.other THEN 0.5 ELSE 0 END AS b FROM e p JOIN e q ON p.label = 1 AND q.label = 0),
    v AS (SELECT i, avg(a) AS a, avg(b) AS b FROM x GROUP BY i), u AS (SELECT j, avg(a) AS a, avg(b) AS b FROM x GROUP BY j),
    s AS (SELECT (SELECT (var_samp(a) + var_samp(b) - 2 * covar_samp(a, b)) / count(*) FROM v) + (SELECT (var_samp(a) + var_samp(b) - 2 * covar_samp(a, b)) / count(*) FROM u) AS var)
    SELECT round(avg(a), 6) AS auc_a, round(avg(b), 6) AS auc_b, round((avg(a) - avg(b)) / sqrt(max(var)), 6) AS z FROM v, s
    """
)
def delong_test(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumn("other", F.col("doc_id") % 13)
    out = me.delong(d, "score", "other", "label", "doc_id")
    return out.select(*(F.round(c, 6).alias(c) for c in ("auc_a", "auc_b", "z")))


# splits


@query(
    """
    WITH e AS (SELECT DISTINCT o_orderpriority AS rel, o_custkey AS h, o_orderkey AS t FROM orders),
    p AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY (t * 7919) % 10007, h, t, rel) AS i, count(*) OVER (PARTITION BY rel) AS n FROM e)
    SELECT rel, h, t, CASE WHEN i <= floor(n * 0.1) THEN 'test' WHEN i <= floor(n * 0.1) + floor(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM p
    """
)
def link_split(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rel"), F.col("o_custkey").alias("h"), F.col("o_orderkey").alias("t")).distinct()
    return splits.link_split(e, ["h", "t", "rel"], ["rel"], 0.2, 0.1, order=(F.col("t") * 7919) % 10007)


@query(
    """
    WITH e AS (SELECT c_nationkey AS rel, c_custkey AS t FROM customer),
    p AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY (t * 7919) % 10007, t) AS i, count(*) OVER (PARTITION BY rel) AS n FROM e),
    k AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE least(greatest(floor(n * 0.01), 1), floor(n / 3)) END AS kt FROM p)
    SELECT rel, t, CASE WHEN i <= kt THEN 'test' WHEN i <= 2 * kt THEN 'val' ELSE 'train' END AS split FROM k
    """
)
def stratified_split(spark, sf_dir):
    e = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("rel"), F.col("c_custkey").alias("t"))
    return splits.link_split(e, ["t"], ["rel"], 0.01, 0.01, stratified=True, order=(F.col("t") * 7919) % 10007)


@query(
    """
    WITH a AS (SELECT DISTINCT l_suppkey AS h, 'sells' AS r, l_partkey AS t FROM lineitem WHERE l_orderkey % 2 = 0),
    b AS (SELECT DISTINCT l_partkey AS h, 'sold_by' AS r, l_suppkey AS t FROM lineitem WHERE l_orderkey % 2 = 1)
    SELECT b.h, b.r, b.t FROM b JOIN a ON a.h = b.t AND a.t = b.h
    """
)
def leak_check(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    train = lines.where("l_orderkey % 2 = 0").select(F.col("l_suppkey").alias("h"), F.lit("sells").alias("r"), F.col("l_partkey").alias("t")).distinct()
    held = lines.where("l_orderkey % 2 = 1").select(F.col("l_partkey").alias("h"), F.lit("sold_by").alias("r"), F.col("l_suppkey").alias("t")).distinct()
    inverse = spark.createDataFrame([("sells", "sold_by"), ("sold_by", "sells")], "r string, inv string")
    return splits.leaks(train, held, inverse)


@query(
    """
    SELECT p AS l_partkey, s AS l_suppkey FROM (SELECT DISTINCT p_partkey AS p, (p_partkey * 31 + k * 17) % (SELECT count(*) FROM supplier) + 1 AS s FROM part, range(4) r(k)) c
    WHERE s IN (SELECT s_suppkey FROM supplier) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p AND l_suppkey = s) ORDER BY (p * 7919 + s * 31) % 10007, p, s LIMIT 100
    """
)
def typed_negatives(spark, sf_dir):
    """Negative pairs out of four candidates for each part, none of them positive."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))  # one row
    pairs = p.crossJoin(F.broadcast(n)).select("l_partkey", ((F.col("l_partkey") * 31 + F.col("k") * 17) % F.col("n") + 1).alias("l_suppkey"))
    real = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    pairs = pairs.join(real, "l_suppkey", "left_semi")
    order = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31) % 10007
    return splits.negatives(pairs, table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], 100, order)


@query("SELECT o_orderkey, CASE WHEN epoch(o_orderdate) <= (SELECT quantile_cont(epoch(o_orderdate), 0.8) FROM orders) THEN 'train' ELSE 'test' END AS split FROM orders")
def time_split(spark, sf_dir):
    return splits.time_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "split")


@query("SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) - 1) % 5 AS INTEGER) AS fold FROM customer")
def stratified_folds(spark, sf_dir):
    return splits.folds(table(spark, sf_dir, "customer"), 5, "c_custkey", ["c_mktsegment"]).select("c_custkey", "fold")


@query("SELECT h.o_orderkey, NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderkey % 5 <> 0 AND t.o_custkey = h.o_custkey) AS novel FROM orders h WHERE h.o_orderkey % 5 = 0")
def novel_targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return splits.novel(o.where("o_orderkey % 5 = 0"), o.where("o_orderkey % 5 <> 0"), "o_custkey").select("o_orderkey", "novel")


# vectors

VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(
    f"""
    WITH {VECTORS}, s AS (SELECT a.vec_id AS q, b.vec_id AS item, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT q, item, score, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS position FROM s) WHERE position <= 5
    """
)
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    scores = rk.nearest(v, ["label"], 5, 6).select("q", "item", F.round("score", 6).alias("score"))
    return rk.top(scores, ["q"], 5).select("q", "item", "score", "position")


@query(
    f"""
    WITH {VECTORS} SELECT a.vec_id AS h, round(-sqrt(list_sum(list_transform(list_zip(a.e, b.e, c.e), lambda z: (z[1] + z[2] - z[3]) * (z[1] + z[2] - z[3])))), 5) AS translational,
      round(list_sum(list_transform(list_zip(a.e, b.e, c.e), lambda z: z[1] * z[2] * z[3])), 5) AS bilinear
    FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2
    """
)
def closed_form_scores(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    a, b, c = (v.select((F.col("vec_id") - k).alias("h"), F.col("e").alias(n)) for k, n in ((0, "x"), (1, "y"), (2, "z")))
    t = a.join(b, "h").join(c, "h")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return t.select("h", F.round(vx.translational(x, y, z), 5).alias("translational"), F.round(vx.bilinear(x, y, z), 5).alias("bilinear"))


# graph algorithms


@query(
    """
    WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
      UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
    t AS (SELECT 'r' || r_regionkey AS node, 0 AS depth, NULL::VARCHAR AS parent FROM region UNION ALL
      SELECT e.child, t.depth + 1, t.node FROM t JOIN e ON e.parent = t.node WHERE t.depth < 3)
    SELECT node, depth, parent FROM t
    """
)
def hierarchy_levels(spark, sf_dir):
    edges = edges_of(spark, sf_dir, "in_region", "in_nation", "placed_by")
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.hierarchy(edges.select(F.col("target_id").alias("parent"), F.col("source_id").alias("child")), roots, 3)



@query(
    """
    WITH m AS (SELECT n_regionkey, min('n' || n_nationkey) AS c, count(DISTINCT n_nationkey) AS k FROM nation GROUP BY ALL),
    c AS (SELECT n_regionkey, min('c' || c_custkey) AS c, count(*) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
    o AS (SELECT n_regionkey, count(*) AS k FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
    SELECT least(m.c, c.c) AS component, m.k + c.k + o.k + 1 AS size FROM m JOIN c USING (n_regionkey) JOIN o USING (n_regionkey)
    """
)
def connected_components(spark, sf_dir):
    """Regions are the components of customers, orders and nations."""
    edges = edges_of(spark, sf_dir, "in_region", "in_nation", "placed_by").where(~F.col("source_id").startswith("s"))
    nodes = nodes_of(spark, sf_dir).where("node_type in ('region', 'nation', 'customer', 'order')")
    return graph.component_sizes(nodes, edges)


TRI = "(SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem) WHERE a <> b)"


@query(
    f"""
    WITH e AS (SELECT * FROM {TRI}), d AS (SELECT n, count(*) AS degree FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n),
    t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = x.a AND z.b = y.b),
    c AS (SELECT n, count(*) AS triangles FROM (SELECT p AS n FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY n)
    SELECT d.n::BIGINT AS node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree >= 2 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS coefficient
    FROM d LEFT JOIN c ON c.n = d.n
    """
)
def clustering_triangles(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    out = graph.clustering(e)
    return out.select("node", "degree", "triangles", F.round("coefficient", 6).alias("coefficient"))


#: Rounds of trimming in the SQL; the operator goes on until nothing changes.
TRIMS = 12
TRIMMED = "e0 AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS t FROM lineitem), " + ", ".join(
    f"e{k} AS MATERIALIZED (SELECT * FROM e{k - 1} WHERE s IN (SELECT t FROM e{k - 1}) AND t IN (SELECT s FROM e{k - 1}))" for k in range(1, TRIMS + 1)
)


@query(f"WITH {TRIMMED} SELECT s AS node FROM e{TRIMS} UNION SELECT t FROM e{TRIMS}")
def cycle_members(spark, sf_dir):
    """Keys on or between cycles where parts and suppliers share one range of keys."""
    return graph.cycle_nodes(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id")))


@query(f"WITH e AS (SELECT DISTINCT * FROM {EDGES}) SELECT source_id, target_id, relation FROM e WHERE regexp_matches(source_id, '^S1$', 'i') OR regexp_matches(target_id, '^S1$', 'i')")
def search_incident(spark, sf_dir):
    found = nodes_of(spark, sf_dir).where(F.col("node_id").rlike("(?i)^S1$"))
    return graph.incident(edges_of(spark, sf_dir), found)


@query(f"SELECT node_id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT source_id AS node_id, 0 AS i, 1 AS o FROM {EDGES} UNION ALL SELECT target_id, 1, 0 FROM {EDGES}) GROUP BY node_id")
def node_degrees(spark, sf_dir):
    return graph.degrees(edges_of(spark, sf_dir))


@query(
    """
    SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
    """
)
def windowed_counts(spark, sf_dir):
    from .streaming.events import windowed_counts as counts

    return counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    """
    SELECT lang, round(avg(n_chars), 4) AS n_chars_mean, coalesce(round(stddev_samp(n_chars), 4), 0) AS n_chars_std FROM documents GROUP BY lang
    """
)
def seed_statistics(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.round(F.avg("n_chars"), 4).alias("n_chars_mean"), F.coalesce(F.round(F.stddev_samp("n_chars"), 4), F.lit(0.0)).alias("n_chars_std"))
