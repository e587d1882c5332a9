"""Every query of the library by name, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as tx
from .operators import aggregates as ag, build, dedup, joins, validate
from .session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, and the SQL it is checked against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The typed graph over the star tables: configuration rows, and the same in SQL.

ENTITIES = [
    build.Entity("region", "region", "r_regionkey", "r_name", prefix="r"),
    build.Entity("nation", "nation", "n_nationkey", "n_name", prefix="n"),
    build.Entity("customer", "customer", "c_custkey", "c_name", prefix="c"),
    build.Entity("supplier", "supplier", "s_suppkey", "s_name", prefix="s"),
    build.Entity("part", "part", "p_partkey", "p_name", prefix="p"),
    build.Entity("orders", "order", "o_orderkey", "o_orderpriority", prefix="o"),
]
RELATIONS = [
    build.Relation("nation", "in_region", "n_nationkey", "n_regionkey", "n", "r"),
    build.Relation("customer", "in_nation", "c_custkey", "c_nationkey", "c", "n"),
    build.Relation("supplier", "in_nation", "s_suppkey", "s_nationkey", "s", "n"),
    build.Relation("orders", "placed_by", "o_orderkey", "o_custkey", "o", "c"),
    build.Relation("lineitem", "contains", "l_orderkey", "l_partkey", "o", "p"),
    build.Relation("lineitem", "supplied_by", "l_partkey", "l_suppkey", "p", "s"),
]
NODES = "(" + " UNION ALL ".join(
    f"SELECT '{e.prefix}' || {e.key} AS node_id, '{e.node_type}' AS node_type, {e.label} AS label FROM {e.table}" for e in ENTITIES
) + ")"
EDGES = "(" + " UNION ALL ".join(
    f"SELECT '{r.source_prefix}' || {r.source} AS source_id, '{r.target_prefix}' || {r.target} AS target_id, '{r.relation}' AS relation FROM {r.table}"
    for r in RELATIONS
) + ")"


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.build_nodes({e.table: table(spark, sf_dir, e.table) for e in ENTITIES}, ENTITIES)


def edges_of(spark: SparkSession, sf_dir: str, *relations: str) -> DataFrame:
    some = [r for r in RELATIONS if not relations or r.relation in relations]
    return build.build_edges({r.table: table(spark, sf_dir, r.table) for r in some}, some)


# counts and degrees


@query(f"SELECT node_type, count(*) AS n FROM {NODES} GROUP BY node_type")
def node_type_counts(spark, sf_dir):
    return nodes_of(spark, sf_dir).groupBy("node_type").agg(F.count("*").alias("n"))


@query(f"SELECT relation, count(*) AS n FROM {EDGES} GROUP BY relation")
def relation_counts(spark, sf_dir):
    return edges_of(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n"))


@query(
    """
    WITH e AS (SELECT DISTINCT o_custkey AS s, l_partkey AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    d AS (SELECT s, count(*) AS degree FROM e GROUP BY s)
    SELECT degree, count(*) AS n_nodes FROM d GROUP BY degree
    """
)
def degree_distribution(spark, sf_dir):
    """How many customers are linked to how many parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    edges = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select("o_custkey", "l_partkey").distinct()
    degree = edges.groupBy("o_custkey").agg(F.count("*").alias("degree"))
    return degree.groupBy("degree").agg(F.count("*").alias("n_nodes"))


@query(
    f"""
    WITH e AS (SELECT * FROM {EDGES}), n AS (SELECT count(*) AS n_nodes FROM {NODES}),
    m AS (SELECT count(*) AS n_edges FROM e)
    SELECT n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1.0)), 6) AS density,
           round(2 * n_edges / CAST(n_nodes AS DOUBLE), 6) AS avg_degree FROM n, m
    """
)
def graph_density(spark, sf_dir):
    s = validate.graph_statistics(nodes_of(spark, sf_dir), edges_of(spark, sf_dir))
    return s.select("n_nodes", "n_edges", "density", F.round("avg_degree", 6).alias("avg_degree"))


@query(
    f"""
    WITH d AS (SELECT node_id, sum(i) AS n_in, sum(o) AS n_out FROM (
      SELECT source_id AS node_id, 0 AS i, 1 AS o FROM {EDGES} UNION ALL SELECT target_id, 1, 0 FROM {EDGES}) GROUP BY node_id)
    SELECT CAST(min(n_in) AS BIGINT) AS min_in, CAST(max(n_in) AS BIGINT) AS max_in, CAST(max(n_out) AS BIGINT) AS max_out,
           round(avg(CASE WHEN n_out > 0 THEN n_out END), 6) AS avg_out FROM d
    """
)
def degree_stats(spark, sf_dir):
    s = validate.graph_statistics(nodes_of(spark, sf_dir), edges_of(spark, sf_dir))
    return s.select("min_in", "max_in", "max_out", F.round("avg_out", 6).alias("avg_out"))


@query(
    f"""
    WITH c AS (SELECT relation, count(*) AS n FROM {EDGES} GROUP BY relation), t AS (SELECT sum(n) AS t FROM c)
    SELECT round(-sum(n / CAST(t AS DOUBLE) * ln(n / CAST(t AS DOUBLE))), 6) AS entropy FROM c, t
    """
)
def relation_entropy(spark, sf_dir):
    return ag.relation_entropy(edges_of(spark, sf_dir), ["relation"]).select(F.round("entropy", 6).alias("entropy"))


# merging


@query(f"SELECT source_id, target_id, relation, count(*) - 1 AS n_duplicates FROM {EDGES} GROUP BY ALL")
def edge_merge(spark, sf_dir):
    return dedup.merge_edges(edges_of(spark, sf_dir))


@query(f"SELECT source_id, target_id, relation, count(*) - 1 AS n_extra FROM {EDGES} GROUP BY ALL HAVING count(*) > 1")
def duplicate_edges(spark, sf_dir):
    return dedup.duplicate_report(edges_of(spark, sf_dir), ["source_id", "target_id", "relation"])


@query(
    """SELECT user_id, event_id, event_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1"""
)
def first_wins_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return dedup.first_by(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    """SELECT user_id, event_id, event_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def last_wins_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return dedup.last_by(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    """
    WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    SELECT user_id, arg_max(event_type, event_id) AS event_type, CAST(count(*) FILTER (WHERE event_type <> b) AS BIGINT) AS n_conflicts
    FROM l GROUP BY user_id
    """
)
def label_conflicts(spark, sf_dir):
    return dedup.label_conflicts(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query(
    """
    WITH o AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL)
    SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS folded FROM o GROUP BY user_id
    """
)
def fold_in_order(spark, sf_dir):
    """Distinct values of a field in the order of their first arrival."""
    e = table(spark, sf_dir, "events").withColumn("field", F.lit("event_type"))
    f = dedup.fold_values(e, ["user_id"], "field", "event_type", "event_id")
    return f.select("user_id", F.array_join("values", ",").alias("folded"))


NODE_UNION = """
    SELECT 'k' || c_custkey AS node_id, 'customer' AS node_type, c_name AS label, 0 AS ord FROM customer UNION ALL
    SELECT 'k' || s_suppkey, 'supplier', s_name, 1 FROM supplier UNION ALL SELECT 'k' || p_partkey, 'part', p_name, 2 FROM part"""


@query(
    f"""
    WITH u AS ({NODE_UNION})
    SELECT node_id, arg_min(node_type, ord) AS node_type, arg_min(label, ord) AS label, count(*) - 1 AS n_duplicates,
           min(node_type) <> max(node_type) AS type_conflict FROM u GROUP BY node_id
    """
)
def node_union_first_type(spark, sf_dir):
    e = [build.Entity("customer", "customer", "c_custkey", "c_name", prefix="k"), build.Entity("supplier", "supplier", "s_suppkey", "s_name", prefix="k"),
         build.Entity("part", "part", "p_partkey", "p_name", prefix="k")]
    nodes = build.build_nodes({x.table: table(spark, sf_dir, x.table) for x in e}, e)
    return dedup.merge_nodes(nodes).drop("sequence")


@query(
    """SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, min(l_orderkey) AS first_order
       FROM lineitem GROUP BY 1, 2"""
)
def undirected_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    kept = dedup.undirected(lines, ["l_partkey"], ["l_suppkey"], ["l_orderkey", "l_linenumber"])
    return kept.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), F.col("l_orderkey").alias("first_order"))


# integrity


@query(
    f"""
    WITH e AS (SELECT * FROM {EDGES} WHERE relation IN ('contains', 'supplied_by'))
    SELECT node_id, node_type FROM {NODES} WHERE node_id NOT IN (SELECT source_id FROM e) AND node_id NOT IN (SELECT target_id FROM e)
    """
)
def orphan_nodes(spark, sf_dir):
    """Nodes that no line of an order touches."""
    return joins.orphans(nodes_of(spark, sf_dir), edges_of(spark, sf_dir, "contains", "supplied_by")).select("node_id", "node_type")


@query(f"SELECT DISTINCT target_id AS node_id FROM {EDGES} WHERE target_id NOT IN (SELECT 'n' || n_nationkey FROM nation) AND relation <> 'in_region'")
def dangling_refs(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir).where("node_type = 'nation'")
    return joins.dangling(nodes, edges_of(spark, sf_dir).where("relation <> 'in_region'"), "target_id")


@query(
    f"""
    WITH n AS (SELECT * FROM {NODES})
    SELECT relation, a.node_type AS source_type, b.node_type AS target_type, count(*) AS n
    FROM {EDGES} e LEFT JOIN n a ON a.node_id = source_id LEFT JOIN n b ON b.node_id = target_id GROUP BY ALL
    """
)
def endpoint_types(spark, sf_dir):
    typed = joins.endpoint_types(nodes_of(spark, sf_dir), edges_of(spark, sf_dir))
    return typed.groupBy("relation", "source_type", "target_type").agg(F.count("*").alias("n"))


@query(
    f"""
    WITH s AS (SELECT 'in_nation' AS relation, 'customer' AS source_type, 'nation' AS target_type UNION ALL SELECT 'placed_by', 'order', 'customer'),
    n AS (SELECT * FROM {NODES})
    SELECT e.relation, s.relation IS NULL AS schema_mismatch, count(*) AS n
    FROM {EDGES} e JOIN n a ON a.node_id = source_id JOIN n b ON b.node_id = target_id
    LEFT JOIN s ON s.relation = e.relation AND s.source_type = a.node_type AND s.target_type = b.node_type GROUP BY ALL
    """
)
def schema_mismatches(spark, sf_dir):
    schema = spark.createDataFrame([("in_nation", "customer", "nation"), ("placed_by", "order", "customer")], "relation string, source_type string, target_type string")
    typed = joins.typed_edges(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), schema)
    return typed.groupBy("relation", "schema_mismatch").agg(F.count("*").alias("n"))


PROJECTED = "(SELECT 'k' || l_partkey AS source_id, 'k' || l_suppkey AS target_id, 'supplied_by' AS relation FROM lineitem)"


@query(
    f"""
    WITH n AS (SELECT 'k' || c_custkey AS node_id FROM customer),
    e AS (SELECT DISTINCT * FROM {PROJECTED} WHERE source_id <> target_id AND source_id IN (SELECT node_id FROM n) AND target_id IN (SELECT node_id FROM n))
    SELECT source_id, target_id, relation FROM e
    """
)
def autofix_edges(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("node_id"))  # parts beyond them dangle
    edges = build.build_edges({"lineitem": table(spark, sf_dir, "lineitem")}, [build.Relation("lineitem", "supplied_by", "l_partkey", "l_suppkey", "k", "k")])
    return validate.repair(nodes, edges)[1]


@query(f"SELECT source_id, target_id, count(*) AS n FROM {PROJECTED} WHERE source_id = target_id GROUP BY ALL")
def self_loops(spark, sf_dir):
    edges = build.build_edges({"lineitem": table(spark, sf_dir, "lineitem")}, [build.Relation("lineitem", "supplied_by", "l_partkey", "l_suppkey", "k", "k")])
    return edges.where("source_id = target_id").groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


@query(
    """
    SELECT check_name AS "check", 'warning' AS severity, CAST(n AS BIGINT) AS n FROM (
      SELECT 'null_text' AS check_name, count(*) FILTER (WHERE text IS NULL) AS n FROM documents UNION ALL
      SELECT 'null_lang', count(*) FILTER (WHERE lang IS NULL) FROM documents UNION ALL
      SELECT 'duplicates', count(lang) - count(DISTINCT lang) FROM documents UNION ALL
      SELECT 'bad_ids', count(*) FILTER (WHERE NOT regexp_matches(lang, '^[de].$')) FROM documents) WHERE n > 0
    UNION ALL SELECT 'missing_title', 'error', 1
    """
)
def quality_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return validate.quality_profile(docs, ["text", "lang", "title"], "lang", F.col("lang").rlike("^[de].$"))


# joins


@query(
    """
    WITH k AS (SELECT 'A' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '-1' ELSE '' END AS node_id FROM part WHERE p_partkey % 5 <> 0),
    q AS (SELECT l_orderkey, l_linenumber, 'A' || l_partkey || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '-1' ELSE '-2' END AS ref,
          'A' || l_partkey AS base FROM lineitem)
    SELECT l_orderkey, l_linenumber, coalesce(a.node_id, b.node_id, c.node_id) AS resolved FROM q
    LEFT JOIN k a ON a.node_id = ref LEFT JOIN k b ON b.node_id = base LEFT JOIN k c ON c.node_id = base || '-1'
    """
)
def isoform_lookup(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(
        F.concat(F.lit("A"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "-1").otherwise("")).alias("node_id")
    )
    refs = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("A"), "l_partkey", F.element_at(F.array(F.lit(""), F.lit("-1"), F.lit("-2")), F.col("l_linenumber") % 3 + 1)).alias("ref")
    )
    return joins.resolve_ids(refs, "ref", known).select("l_orderkey", "l_linenumber", "resolved")


@query(
    """
    WITH m AS (SELECT p_partkey, p_type FROM part), t AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN m ON p_partkey = l_partkey)
    SELECT l_orderkey, count(*) AS n_types, min(p_type) AS first_type FROM t GROUP BY l_orderkey
    """
)
def item_term_sets(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sets = ag.sets_by(pairs, "l_orderkey", "p_type")
    return sets.select("l_orderkey", F.size("items").cast("long").alias("n_types"), F.col("items")[0].alias("first_type"))


@query(
    """
    SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.lang = 'en' THEN 1 WHEN d.lang = 'de' THEN 0 ELSE -1 END) AS mapped
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """
)
def label_map_priority(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    by_id = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id"), F.col("quality").cast("string").alias("target"))
    by_text = spark.createDataFrame([("en", "1"), ("de", "0")], "source_text string, target string")
    return joins.map_labels(docs, by_id, by_text, "doc_id", "lang").select("doc_id", F.coalesce(F.col("mapped").cast("int"), F.lit(-1)).alias("mapped"))


@query(
    """
    WITH a AS (SELECT DISTINCT r_name || ' ' || (n_nationkey % 3) AS place FROM nation JOIN region ON r_regionkey = n_regionkey),
    b AS (SELECT DISTINCT lower(r_name) AS tissue FROM region UNION SELECT 'asia 1 and more')
    SELECT place, min(tissue) AS tissue FROM a JOIN b ON contains(lower(place), tissue) OR contains(tissue, lower(place)) GROUP BY place
    """
)
def fuzzy_name_match(spark, sf_dir):
    """Names of one list that contain, or are contained in, names of another."""
    region = table(spark, sf_dir, "region")
    places = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("r_name", F.lit(" "), F.col("n_nationkey") % 3).alias("place"))
    tissues = region.select(F.lower("r_name").alias("tissue")).unionAll(spark.sql("select 'asia 1 and more' as tissue"))
    return joins.contains_match(places, tissues, "place", "tissue")


@query(
    """
    WITH own AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS item, event_type AS value FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
    i AS (SELECT CAST(c_custkey AS BIGINT) AS item, CAST(c_custkey + 1 AS BIGINT) AS parent FROM customer),
    d AS (SELECT * FROM own), l1 AS (SELECT * FROM i WHERE item NOT IN (SELECT item FROM d)),
    up AS (SELECT DISTINCT l1.item, own.value FROM l1 JOIN own ON own.item = parent),
    l2 AS (SELECT item FROM l1 WHERE item NOT IN (SELECT item FROM up)),
    down AS (SELECT DISTINCT i.parent AS item, own.value FROM i JOIN l2 ON l2.item = i.parent JOIN own ON own.item = i.item)
    SELECT item, value FROM (SELECT * FROM d UNION ALL SELECT * FROM up UNION ALL SELECT * FROM down)
    """
)
def one_hop_inheritance(spark, sf_dir):
    """Customers and the kinds of their events; those without any take their neighbours' by number."""
    key = F.col("c_custkey").cast("long")
    items = table(spark, sf_dir, "customer").select(key.alias("item"), (key + 1).alias("parent"))
    own = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("item"), F.col("event_type").alias("value"))
    return joins.inherit(items, own.join(items, "item", "left_semi"), items)


@query(
    f"""
    WITH n AS (SELECT 'k' || c_custkey AS node_id, 'customer' AS node_type, c_name AS label FROM customer)
    SELECT * FROM n UNION ALL SELECT DISTINCT 'k' || l_partkey, 'part', 'k' || l_partkey FROM lineitem WHERE 'k' || l_partkey NOT IN (SELECT node_id FROM n)
    """
)
def missing_nodes_appended(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("node_id"), F.lit("customer").alias("node_type"), F.col("c_name").alias("label"))
    used = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("k"), "l_partkey").alias("node_id"))
    return joins.missing_nodes(nodes, used, "part")


# text


@query(
    """
    SELECT doc_id, CASE WHEN regexp_matches(text, 'ing,', 'i') THEN 'A' WHEN regexp_matches(text, 'tion|ment', 'i') THEN 'B'
      WHEN regexp_matches(text, 'der', 'i') THEN 'C' END AS place FROM documents
    """
)
def ordered_rules(spark, sf_dir):
    """First of ordered rules that fits, letter case ignored."""
    rules = (("ing,", "A"), ("tion|ment", "B"), ("der", "C"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_match(F.col("text"), rules).alias("place"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, 'n[^p][st]')) AS BIGINT) AS n FROM documents")
def sequon_counts(spark, sf_dir):
    """Motif counts, without overlaps, over raw text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("n[^p][st]")).cast("long").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_metadata(spark, sf_dir):
    from .sources.readers import parse_metadata

    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(parse_metadata(F.col("props")), F.lit("k")).alias("k"))


@query(
    """
    SELECT s_suppkey, i.u[1] AS id, i.u[2] AS name FROM (SELECT s_suppkey, unnest([[s_suppkey::VARCHAR, s_name], ['x' || s_nationkey, 'n|t']]) AS u FROM supplier) i
    """
)
def unnest_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    packed = s.withColumn("packed", F.concat(F.col("s_suppkey"), F.lit("|"), "s_name", F.lit("; x"), "s_nationkey", F.lit("|n|t;skipped")))
    return build.unnest_pairs(packed, "s_suppkey", "packed")


@query(
    """
    SELECT event_id, CASE WHEN v IN ('1', '1.0') THEN 1 WHEN v IN ('0', '0.0') THEN 0 WHEN v = 'yes' THEN 1 WHEN v = 'neg' THEN 0 ELSE -1 END AS label
    FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN '0.0' WHEN 2 THEN 'yes' WHEN 3 THEN 'neg' WHEN 4 THEN '1.0' ELSE 'maybe' END AS v FROM events)
    """
)
def binary_labels(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, ("1", "0.0", " Yes ", "NEG", "1.0", "maybe"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(tx.binary_label(words), F.lit(-1)).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) > 20 THEN text[1:17] || '...' ELSE text END AS label FROM documents")
def short_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.shortened(F.col("text"), 20).alias("label"))


@query(
    """
    SELECT lineitem.l_orderkey, l_linenumber, 'SITE::A' || l_partkey || '-' || (l_linenumber % 3 + 1) || '::' || (l_suppkey + 1) || '::N' AS site,
           l_linenumber % 3 = 0 AS canonical FROM lineitem
    """
)
def site_ids(spark, sf_dir):
    accession = F.concat(F.lit("A"), "l_partkey", F.lit("-"), F.col("l_linenumber") % 3 + 1)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", tx.site_id(accession, F.col("l_suppkey") + 1, F.lit("n")).alias("site"), tx.is_canonical(accession).alias("canonical")
    )


# aggregates


@query("SELECT event_type, hour(ts) AS h, round(avg(value), 6) AS mean, round(avg((value > 50)::INT), 6) AS fraction, count(*) AS n FROM events GROUP BY ALL HAVING avg((value > 50)::INT) > 0")
def expression_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.hour("ts").cast("long").alias("h"), "value")
    out = e.groupBy("event_type", "h").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("fraction"), F.count("*").alias("n"))
    return out.where("fraction > 0")


@query(
    """SELECT user_id, coalesce(max(value) FILTER (WHERE event_type = 'click'), 0) AS click, coalesce(max(value) FILTER (WHERE event_type = 'view'), 0) AS view,
       coalesce(max(value) FILTER (WHERE event_type = 'none'), 0) AS "none" FROM events GROUP BY user_id"""
)
def pivot_max(spark, sf_dir):
    return ag.pivot_max(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["click", "view", "none"])


@query(
    """SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM
       (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rn = 1"""
)
def dominant_type(spark, sf_dir):
    return ag.dominant(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS fraction FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def class_fraction(spark, sf_dir):
    return ag.class_fraction(table(spark, sf_dir, "events"), "user_id", "event_type").withColumn("fraction", F.round("fraction", 6))


TERMS = "(SELECT o_custkey AS k, p_type AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"


def _terms(spark, sf_dir):
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    return o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey).select(F.col("o_custkey").alias("k"), F.col("p_type").alias("f"))


@query(
    f"""
    WITH t AS (SELECT * FROM {TERMS}), n AS (SELECT count(DISTINCT k) AS n FROM t), i AS (SELECT f, ln(max(n.n) / count(DISTINCT k)::DOUBLE) AS idf FROM t, n GROUP BY f),
    w AS (SELECT k, t.f, count(*) * max(idf) AS w FROM t JOIN i ON i.f = t.f GROUP BY k, t.f)
    SELECT k, f, round(CASE WHEN sum(w * w) OVER (PARTITION BY k) > 0 THEN w / sqrt(sum(w * w) OVER (PARTITION BY k)) ELSE 0 END, 6) AS weight FROM w
    """
)
def tf_idf_profile(spark, sf_dir):
    return ag.tf_idf(_terms(spark, sf_dir), "k", "f").withColumn("weight", F.round("weight", 6))


@query("SELECT lang, count(quality) AS n, CASE WHEN count(quality) >= 100 THEN 'READY' WHEN count(quality) > 0 THEN 'PARTIAL' ELSE 'BLOCKED' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def readiness_audit(spark, sf_dir):
    return ag.readiness(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), ["lang"], "quality", 100)


@query("SELECT count(DISTINCT d.doc_id) AS n, count(DISTINCT l.doc_id) AS covered, round(count(DISTINCT l.doc_id) * 100 / count(DISTINCT d.doc_id), 2) AS percent FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def label_coverage(spark, sf_dir):
    return ag.coverage(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@query(
    """
    WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, l_partkey, round(exp((v - m) / 100) / sum(exp((v - m) / 100)) OVER (PARTITION BY l_suppkey), 6) AS softmax
    FROM (SELECT *, max(v) OVER (PARTITION BY l_suppkey) AS m FROM s)
    """
)
def scatter_softmax(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg((F.sum("l_quantity") / 100).alias("v"))
    return ag.scatter_softmax(s, "l_suppkey", "v").select("l_suppkey", "l_partkey", F.round("softmax", 6).alias("softmax"))


@query("SELECT l_suppkey AS target_id, round(sum(p_retailprice), 2) AS total, round(avg(p_retailprice), 3) AS mean, max(p_retailprice) AS max, round(stddev_pop(p_retailprice), 3) AS std FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey")
def neighbour_features(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id")).distinct()
    values = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_retailprice").alias("value"))
    out = ag.neighbour_features(edges, values)
    return out.select("target_id", F.round("sum", 2).alias("total"), F.round("mean", 3).alias("mean"), "max", F.round("std", 3).alias("std"))


@query(
    """
    WITH x AS (SELECT c_nationkey AS cell_type, c_mktsegment AS gene, avg(greatest(c_acctbal, 0)) AS value FROM customer GROUP BY ALL),
    i AS (SELECT DISTINCT c_mktsegment AS gene, o_orderpriority AS item FROM customer JOIN orders ON o_custkey = c_custkey)
    SELECT cell_type, item, round(sum(ln(1 + value)), 6) AS score FROM x JOIN i USING (gene) GROUP BY ALL
    """
)
def additive_scores(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    x = c.groupBy(F.col("c_nationkey").alias("cell_type"), F.col("c_mktsegment").alias("gene")).agg(F.avg(F.greatest("c_acctbal", F.lit(0.0))).alias("value"))
    i = c.join(o, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("gene"), F.col("o_orderpriority").alias("item")).distinct()
    return ag.additive_scores(x, i).withColumn("score", F.round("score", 6))


from . import catalog_more, catalog_rank, catalog_sites  # noqa: E402, F401  registers the rest
