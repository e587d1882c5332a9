"""Queries on a graph of proteins and sites derived from suppliers and lines: the check report and the filter chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .functions import sequence as sq, structure as st
from .operators import aggregates as ag, build, chains, ranking as rk, samples, validate
from .session import table

# the site graph: suppliers are proteins, quantities positions, return flags residues; some of each are broken

PROTEIN = "CASE WHEN {0} % 7 = 0 THEN 'X' || {0} ELSE 'P' || lpad(CAST({0} % 100000 AS STRING), 5, '0') END"
SITE = """CASE WHEN l_quantity = 50 THEN 'SITE::P' || lpad(CAST(l_suppkey % 100000 AS STRING), 5, '0') || '::50'
    ELSE 'SITE::P' || lpad(CAST(l_suppkey % 100000 AS STRING), 5, '0') || CASE WHEN l_suppkey % 9 = 0 THEN '-2' ELSE '' END || '::' || CAST(CAST(l_quantity AS INT) AS STRING)
      || '::' || CASE WHEN l_quantity = 49 THEN 'B' ELSE l_returnflag END END"""
SITE_NODES = f"""
    SELECT {PROTEIN.format('s_suppkey')} AS node_id, CASE WHEN s_suppkey % 4 = 0 THEN 'enzyme' ELSE 'protein' END AS node_type, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '{{"a": 1}}' END AS metadata FROM supplier
    UNION ALL SELECT DISTINCT {SITE}, 'site', CASE WHEN l_quantity >= 25 THEN '{{"q": 2}}' ELSE '{{}}' END FROM lineitem
    UNION ALL SELECT 'LOC::' || lower(r_name), 'cellular_location', NULL FROM region
    UNION ALL SELECT 'CHEMBL' || n_nationkey || CASE WHEN n_nationkey % 5 = 0 THEN 'x' ELSE '' END, 'compound', '{{}}' FROM nation"""
SITE_EDGES = f"""
    SELECT CASE WHEN l_suppkey % 13 = 0 THEN 'GHOST' || l_suppkey ELSE {PROTEIN.format('l_suppkey')} END AS source_id, {SITE} AS target_id, 'has_site' AS relation FROM lineitem
    UNION ALL SELECT a.site, CASE WHEN b.l_quantity = 1 THEN 'P00001' ELSE b.site END, 'ptm_crosstalk' FROM (SELECT *, {SITE} AS site FROM lineitem) a
      JOIN (SELECT *, {SITE} AS site FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    UNION ALL SELECT {PROTEIN.format('s_suppkey')}, CASE WHEN s_suppkey % 11 = 0 THEN 'LOC::nowhere' ELSE 'LOC::' || lower(r_name) END, 'localized_in'
      FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT {PROTEIN.format('s_suppkey')}, {PROTEIN.format('(CASE WHEN s_suppkey % 6 = 0 THEN s_suppkey - 5 ELSE s_suppkey + 1 END)')}, 'inhibits' FROM supplier WHERE s_suppkey % 12 < 7"""


def _site_graph(spark, sf_dir):
    views = {t: table(spark, sf_dir, t) for t in ("supplier", "lineitem", "region", "nation")}
    filled = lambda sql: sql.replace("{", "{{").replace("}", "}}")  # noqa: E731  braces are JSON's here

    def over(sql):
        for t in views:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return spark.sql(sql, **views)

    return over(filled(SITE_NODES)), over(filled(SITE_EDGES))


WRONG = """SELECT '{0}_{1}' AS c, count(*) AS n, list(DISTINCT {2}) AS ids FROM e WHERE relation = '{0}' AND {2} NOT IN (SELECT node_id FROM n WHERE node_type IN ({3}))"""
IDS = "SELECT '{0}' AS c, count(*) AS n, list(DISTINCT node_id) AS ids FROM n WHERE {1}"
FORMED = r"node_type = 'site' AND regexp_matches(node_id, '^SITE::[A-Z0-9]+-?\d*::\d+::[A-Z]$')"
BAD = {"glycan": r"^G\d{5}[A-Z]{2}$", "compound": r"^CHEMBL\d+$", "cellular_location": r"^LOC::[a-z_]+$"} | dict.fromkeys(("enzyme", "protein"), r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}(-\d+)?$)")
REPORT = " UNION ALL ".join(
    [
        IDS.format("orphans", "node_id NOT IN (SELECT source_id FROM e UNION SELECT target_id FROM e)").replace("count(*)", "count(DISTINCT node_id)"),
        "SELECT 'duplicate_edges', sum(k - 1), list(source_id || '|' || relation || '|' || target_id) FROM (SELECT source_id, target_id, relation, count(*) AS k FROM e GROUP BY ALL) WHERE k > 1",
        *(f"SELECT 'dangling_{s}s', count(DISTINCT {s}_id), list(DISTINCT {s}_id) FROM e WHERE {s}_id NOT IN (SELECT node_id FROM n)" for s in ("source", "target")),
        "SELECT 'self_loops', count(*), list(DISTINCT source_id || '|' || relation || '|' || target_id) FROM e WHERE source_id = target_id",
        "SELECT 'cycle_inhibits', count(*), list(a) FROM (SELECT DISTINCT a FROM reach WHERE a = b)",
        *(IDS.format(f"bad_ids_{t}", f"node_type = '{t}' AND NOT regexp_matches(node_id, '{p}')") for t, p in BAD.items()),
        *(WRONG.format("localized_in", f"{s}s", f"{s}_id", t) for s, t in (("source", "'protein', 'enzyme'"), ("target", "'cellular_location'"))),
        IDS.format("site_format", f"node_type = 'site' AND NOT ({FORMED})"),
        IDS.format("site_isoform", FORMED + r" AND regexp_matches(split_part(node_id, '::', 2), '-\d+$') AND NOT regexp_matches(split_part(node_id, '::', 2), '-1$')"),
        IDS.format("site_residue", FORMED + " AND NOT contains('ACDEFGHIKLMNPQRSTVWY', split_part(node_id, '::', 4))"),
        IDS.format("unmapped_sites", FORMED + " AND split_part(node_id, '::', 2) NOT IN (SELECT node_id FROM n WHERE node_type IN ('protein', 'enzyme')) AND split_part(split_part(node_id, '::', 2), '-', 1) NOT IN (SELECT node_id FROM n WHERE node_type IN ('protein', 'enzyme'))"),
        *(WRONG.format("has_site", f"{s}s", f"{s}_id", t) for s, t in (("source", "'protein', 'enzyme'"), ("target", "'site'"))),
        *(WRONG.format("ptm_crosstalk", f"{s}s", f"{s}_id", "'site'") for s in ("source", "target")),
        "SELECT 'cycle_has_variant', 0, []",
    ]
)


@query(
    f"""
    WITH RECURSIVE n AS ({SITE_NODES.replace('{{', '{').replace('}}', '}')}), e AS ({SITE_EDGES}),
    h AS (SELECT DISTINCT source_id AS a, target_id AS b FROM e WHERE relation = 'inhibits'),
    reach AS (SELECT a, b FROM h UNION SELECT reach.a, h.b FROM reach JOIN h ON h.a = reach.b),
    d AS (SELECT node_id, sum(i) AS i, sum(o) AS o FROM (SELECT target_id AS node_id, 1 AS i, 0 AS o FROM e UNION ALL SELECT source_id, 0, 1 FROM e) GROUP BY 1),
    f AS ({REPORT})
    SELECT c AS "check", CASE WHEN c LIKE 'dangling%' OR c LIKE 'cycle%' THEN 'error' ELSE 'warning' END AS severity, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS value,
           coalesce(array_to_string(list_sort(coalesce(ids, []))[1:10], ','), '') AS sample FROM f
    UNION ALL SELECT 'nodes', 'info', count(*), NULL, '' FROM n UNION ALL SELECT 'edges', 'info', count(*), NULL, '' FROM e
    UNION ALL SELECT 'density', 'info', NULL, round((SELECT count(*) FROM e) / (count(*) * (count(*) - 1)), 9), '' FROM n
    UNION ALL SELECT 'nodes_' || node_type, 'info', count(*), NULL, '' FROM n GROUP BY node_type
    UNION ALL SELECT 'edges_' || relation, 'info', count(*), NULL, '' FROM e GROUP BY relation
    UNION ALL SELECT 'in_degree', 'info', CAST(max(i) AS BIGINT), round(avg(i), 9), '' FROM d WHERE i > 0 UNION ALL SELECT 'out_degree', 'info', CAST(max(o) AS BIGINT), round(avg(o), 9), '' FROM d WHERE o > 0
    UNION ALL SELECT 'in_degree_least', 'info', CAST(min(i) AS BIGINT), NULL, '' FROM d WHERE i > 0 UNION ALL SELECT 'out_degree_least', 'info', CAST(min(o) AS BIGINT), NULL, '' FROM d WHERE o > 0
    UNION ALL SELECT 'in_degree_zero', 'info', count(DISTINCT node_id), NULL, '' FROM n WHERE node_id NOT IN (SELECT node_id FROM d WHERE i > 0)
    UNION ALL SELECT 'out_degree_zero', 'info', count(DISTINCT node_id), NULL, '' FROM n WHERE node_id NOT IN (SELECT node_id FROM d WHERE o > 0)
    UNION ALL SELECT 'metadata', CASE WHEN avg((coalesce(trim(metadata), '') NOT IN ('', '{{}}'))::INT) < 0.5 THEN 'warning' ELSE 'info' END, sum((coalesce(trim(metadata), '') NOT IN ('', '{{}}'))::INT)::BIGINT,
      round(100 * avg((coalesce(trim(metadata), '') NOT IN ('', '{{}}'))::INT), 2), '' FROM n
    """.replace("AS STRING", "AS VARCHAR")
)
def graph_report(spark, sf_dir):
    """All checks but the components of a graph of proteins, sites and compartments."""
    report = validate.check_graph(*_site_graph(spark, sf_dir), components=False)
    return report.select("check", "severity", "n", F.round("value", 9).alias("value"), F.array_join("sample", ",").alias("sample"))


# filter chains: lines are raw sites, neighbouring lines raw pairs of sites, parts features

ACCESSION = """CASE l_linenumber % 4 WHEN 0 THEN 'P' || l_suppkey || '-2' WHEN 1 THEN 'P' || l_suppkey || '-1' WHEN 2 THEN 'P' || l_suppkey
    ELSE CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'P' || l_suppkey END END"""
RAW = f"""SELECT {ACCESSION} AS uniprot_id, CAST(CASE WHEN l_tax > 0.075 THEN NULL ELSE l_quantity - 2 END AS INT) AS site_position,
    substr('ACDEFGHIKLMNPQRSTVWYBZ', CAST(l_partkey % 22 AS INT) + 1, 1) AS site_residue, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_linestatus END AS ptm_type,
    CASE WHEN l_discount < 0.005 THEN NULL ELSE CAST(round(l_discount * 100) AS INT) / 10.0 END AS score, l_orderkey * 8 + l_linenumber AS ord, l_orderkey, l_linenumber FROM lineitem"""
PROTEINS = "SELECT 'P' || s_suppkey AS protein_id FROM supplier WHERE s_suppkey % 5 > 0 UNION ALL SELECT 'P' || s_suppkey || '-1' FROM supplier WHERE s_suppkey % 5 > 1"
CANONICAL = "CASE WHEN {0} LIKE '%-2' THEN replace({0}, '-2', '-1') ELSE replace({0}, '-1', '') END"
SITES_SQL = f"""raw AS ({RAW}), ok AS ({PROTEINS}), c AS (SELECT *, {CANONICAL.format('uniprot_id')} AS id FROM raw),
    r AS (SELECT *, CASE WHEN score < 0.3 THEN 'score' WHEN id = '' THEN 'no id' WHEN id NOT IN (SELECT protein_id FROM ok) THEN 'protein'
      WHEN NOT contains('ACDEFGHIKLMNPQRSTVWY', site_residue) OR site_position IS NULL OR site_position < 1 THEN 'residue or position' END AS reason FROM c),
    s AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason, id, site_position, site_residue ORDER BY ord) END AS k FROM r)"""
PAIRS_SQL = f"""raw AS ({RAW}), ok AS ({PROTEINS}), c AS (SELECT a.uniprot_id AS ua, b.uniprot_id AS ub, {CANONICAL.format('a.uniprot_id')} AS a, {CANONICAL.format('b.uniprot_id')} AS b,
      a.site_position AS pa, b.site_position AS pb, a.site_residue AS ra, b.site_residue AS rb, a.ptm_type AS ta, b.ptm_type AS tb, b.score, a.ord FROM raw a JOIN raw b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
    r AS (SELECT *, CASE WHEN score < 0.3 THEN 'score' WHEN a = '' OR b = '' THEN 'site' WHEN a NOT IN (SELECT protein_id FROM ok) OR b NOT IN (SELECT protein_id FROM ok) THEN 'protein'
      WHEN pa IS NULL OR pb IS NULL THEN 'site' END AS reason, a || '|' || pa || '|' || ra AS x, b || '|' || pb || '|' || rb AS y FROM c),
    s AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason, least(x, y), greatest(x, y) ORDER BY ord) END AS k FROM r)"""
LOADED = "SELECT 'c' || o_custkey AS source_id, 'c' || (o_orderkey % 2000) AS target_id, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS score FROM orders"
LOADED_SQL = f"""ok AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 0),
    s AS (SELECT *, CASE WHEN score < 0.25 THEN 'score' WHEN source_id NOT IN (SELECT id FROM ok) OR target_id NOT IN (SELECT id FROM ok) THEN 'site' END AS reason FROM ({LOADED}))"""
FEATURES = """SELECT 'P' || p_partkey AS uniprot_id, CASE WHEN p_size % 3 = 0 THEN 'Signal' ELSE 'Glycosylation' END AS type,
    CASE p_partkey % 5 WHEN 0 THEN 'N-linked (GlcNAc...) asparagine' WHEN 1 THEN 'O-linked (GalNAc...)' WHEN 2 THEN 'N-linked; by similarity' WHEN 3 THEN NULL ELSE 'C-linked (Man)' END AS description,
    p_partkey % 4 AS one, p_size % 4 AS two, p_size AS first, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS last, CASE WHEN p_partkey % 13 = 0 THEN 'UNKNOWN' END AS kind FROM part"""
FEATURES_SQL = f"""f AS (SELECT *, CASE WHEN first > 30 THEN '' ELSE substr('MNSTWGMNSTWGMNSTWGMNSTWGMNSTWG', CAST(first AS INT), 1) END AS residue, CASE p_partkey % 5 WHEN 0 THEN 'N-linked' WHEN 1 THEN 'O-linked' WHEN 2 THEN 'N-linked' WHEN 3 THEN 'glycosylation' ELSE 'C-mannosylation' END AS glyco FROM ({FEATURES.replace('FROM part', ', p_partkey FROM part')})),
    s AS (SELECT *, CASE WHEN type <> 'Glycosylation' THEN 'type' WHEN description LIKE '%similarity%' THEN 'description' WHEN one NOT IN (1, 2) AND two NOT IN (1, 2) THEN 'evidence'
      WHEN first <> last OR kind = 'UNKNOWN' THEN 'position'
      WHEN residue <> '' AND NOT (CASE glyco WHEN 'N-linked' THEN residue = 'N' WHEN 'O-linked' THEN residue IN ('S', 'T', 'Y') WHEN 'C-mannosylation' THEN residue = 'W' ELSE true END) THEN 'residue' END AS reason FROM f)"""


def _chain(spark, sf_dir, sql, *tables):
    views = {t: table(spark, sf_dir, t) for t in tables}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **views)


def _raw(spark, sf_dir):
    return _chain(spark, sf_dir, RAW, "lineitem").withColumn("score", F.col("score").cast("double"))


def _sites(spark, sf_dir):
    return chains.ptm_sites(_raw(spark, sf_dir), _chain(spark, sf_dir, PROTEINS, "supplier"), 0.3)


def _pairs(spark, sf_dir):
    raw, own = _raw(spark, sf_dir), ("uniprot_id", "site_position", "site_residue", "ptm_type")
    side = lambda s: [F.col(c).alias(f"{c.removeprefix('site_') if c == 'site_residue' else c}_{s}") for c in own]
    one = raw.select(*side("a"), "ord", "l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"))
    edges = one.join(raw.select(*side("b"), "score", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]).withColumn("edge_type", F.lit(None).cast("string"))
    return chains.ptm_edges(edges, _chain(spark, sf_dir, PROTEINS, "supplier"), 0.3)


def _loaded(spark, sf_dir):
    ok = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("site_id"))
    return chains.known_site_edges(_chain(spark, sf_dir, LOADED, "orders"), ok, 0.25)


def _features(spark, sf_dir):
    f = _chain(spark, sf_dir, FEATURES, "part")
    codes = F.array(*(F.concat(F.lit("ECO:"), c) for c in ("one", "two")))
    f = f.select("uniprot_id", "type", "description", codes.alias("codes"), F.col("first").cast("int").alias("start"), F.col("last").cast("int").alias("end"), F.col("kind").alias("start_kind"), F.lit(None).cast("string").alias("end_kind"), F.lit("MNSTWG" * 5).alias("sequence"))
    return chains.sequence_features(f, ["ECO:1", "ECO:2"])


@query(f"WITH {SITES_SQL} SELECT id AS uniprot_id, site_position, site_residue, coalesce(ptm_type, '') AS ptm_type, CAST(coalesce(score, 1.0) AS DOUBLE) AS score FROM s WHERE k = 1")
def ptm_site_chain(spark, sf_dir):
    """Sites that pass score, id, isoform, protein, residue and position, each once."""
    return _sites(spark, sf_dir).kept.drop("source")


@query(f"WITH {PAIRS_SQL} SELECT a AS site1_uniprot, pa AS site1_position, ra AS site1_residue, b AS site2_uniprot, pb AS site2_position, rb AS site2_residue, CAST(coalesce(score, 1.0) AS DOUBLE) AS score FROM s WHERE k = 1")
def ptm_edge_chain(spark, sf_dir):
    """Pairs of sites of known proteins, each unordered pair once."""
    return _pairs(spark, sf_dir).kept.select(*(f"site{n}_{c}" for n in (1, 2) for c in ("uniprot", "position", "residue")), "score")


@query(f"WITH {LOADED_SQL} SELECT source_id, target_id, score FROM s WHERE reason IS NULL")
def loaded_edge_chain(spark, sf_dir):
    """Edges of a loader with both ends among known sites."""
    return _loaded(spark, sf_dir).kept


@query(f"WITH {FEATURES_SQL} SELECT uniprot_id, CAST(first AS INTEGER) AS position, residue, glyco AS kind, 'ECO:' || CASE WHEN one NOT IN (1, 2) THEN two WHEN two NOT IN (1, 2) THEN one ELSE least(one, two) END AS evidence FROM s WHERE reason IS NULL")
def feature_chain(spark, sf_dir):
    """Glycosylation sites among sequence features."""
    return _features(spark, sf_dir).kept


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS chain, reason, n FROM (WITH {sql} SELECT coalesce(reason, {last}) AS reason, count(*) AS n FROM s GROUP BY 1)"
        for name, sql, last in (("sites", SITES_SQL, "CASE WHEN k > 1 THEN 'duplicate' ELSE 'kept' END"), ("pairs", PAIRS_SQL, "CASE WHEN k > 1 THEN 'duplicate' ELSE 'kept' END"), ("loaded", LOADED_SQL, "'kept'"), ("features", FEATURES_SQL, "'kept'"))
    )
)
def chain_counters(spark, sf_dir):
    """What every chain rejected, by reason, and kept."""
    parts = [f(spark, sf_dir).report().select(F.lit(n).alias("chain"), "reason", "n") for n, f in (("sites", _sites), ("pairs", _pairs), ("loaded", _loaded), ("features", _features))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).where("reason <> 'read' and n > 0")


# builders with folded metadata: lines returned as A and R are two sources of sites

FIRST = "SELECT 'P' || l_suppkey AS uniprot_id, CAST(l_quantity AS INT) AS site_position, CASE WHEN l_linenumber % 2 = 1 THEN 'N' ELSE 'S' END AS site_residue, 't' || (l_linenumber % 3) AS site_type, CASE WHEN l_tax > 0.045 THEN 'ECO:1' END AS evidence_code, l_orderkey * 8 + l_linenumber AS ord FROM lineitem WHERE l_returnflag = 'A'"
SECOND = "SELECT 'P' || l_suppkey || CASE WHEN l_linenumber % 3 = 0 THEN '-1' ELSE '' END AS uniprot_id, CAST(l_quantity AS INT) AS site_position, CASE WHEN l_linenumber % 2 = 1 THEN 'N' ELSE 'S' END AS site_residue, 'p' || (l_linenumber % 2) AS ptm_type, l_orderkey * 8 + l_linenumber AS ord FROM lineitem WHERE l_returnflag = 'R'"
FOLDED = f"""a AS ({FIRST}), b AS ({SECOND}),
    x AS (SELECT *, 0 AS src, 'UniProt' AS source, NULL AS ptm_type FROM a UNION ALL BY NAME SELECT *, 1 AS src, 'PTMCode' AS source FROM b),
    s AS (SELECT *, split_part(uniprot_id, '-', 1) AS base, 'SITE::' || split_part(uniprot_id, '-', 1) || '-1::' || site_position || '::' || site_residue AS site FROM x),
    kv AS (SELECT site, base, src, ord, unnest(['source', 'site_type', 'evidence_code', 'ptm_type', 'position', 'residue']) AS k, unnest([source, site_type, evidence_code, ptm_type, CAST(site_position AS VARCHAR), site_residue]) AS v FROM s),
    d AS (SELECT {{0}}, k, v, min(src * 1000000000000 + ord) AS came FROM kv WHERE v IS NOT NULL {{1}} GROUP BY ALL),
    f AS (SELECT {{0}}, k, CASE WHEN count(*) = 1 THEN '"' || any_value(v) || '"' ELSE '[' || string_agg('"' || v || '"', ',' ORDER BY came) || ']' END AS j FROM d GROUP BY ALL),
    m AS (SELECT {{0}}, '{{{{' || string_agg('"' || k || '": ' || j, ', ' ORDER BY k) || '}}}}' AS metadata FROM f GROUP BY ALL)"""


def _site_sources(spark, sf_dir):
    return [("UniProt", _chain(spark, sf_dir, FIRST, "lineitem"), ["site_type", "evidence_code"]), ("PTMCode", _chain(spark, sf_dir, SECOND, "lineitem"), ["ptm_type"])]


@query(f"WITH {FOLDED.format('site', '').replace('{{', '{').replace('}}', '}')}, l AS (SELECT site, arg_min(uniprot_id || ':' || site_residue || site_position, src * 1000000000000 + ord) AS label FROM s GROUP BY site) SELECT site AS node_id, 'site' AS node_type, label, metadata FROM m JOIN l USING (site)")
def folded_site_nodes(spark, sf_dir):
    """Sites of two sources, their metadata folded where both name one."""
    return build.site_nodes(_site_sources(spark, sf_dir))


@query(f"""WITH {FOLDED.format('site, base', "AND k NOT IN ('position', 'residue')").replace('{{', '{').replace('}}', '}')}, p AS (SELECT 'P' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '-1' ELSE '' END AS id FROM supplier WHERE s_suppkey % 7 > 0)
    SELECT id AS source_id, site AS target_id, 'has_site' AS relation, metadata FROM m JOIN p ON split_part(id, '-', 1) = base""")
def folded_site_edges(spark, sf_dir):
    """Edges from proteins to those sites, by id, base or first isoform."""
    ids = F.concat(F.lit("P"), "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "-1").otherwise(""))
    return build.site_edges(_site_sources(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_suppkey % 7 > 0").select(ids.alias("node_id")))


@query("SELECT DISTINCT 'compound' AS kind, 'C' || l_partkey AS a, p_name AS b, CAST(NULL AS DOUBLE) AS value FROM lineitem JOIN part ON p_partkey = l_partkey UNION ALL SELECT 'edge', 'S' || l_suppkey, 'C' || l_partkey, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey UNION ALL SELECT DISTINCT 'enzyme', 'S' || s_suppkey, s_name, NULL FROM supplier")
def compounds_and_enzymes(spark, sf_dir):
    """Compounds and enzymes once each, and every pair that was measured."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = lines.select(F.concat(F.lit("S"), "l_suppkey").alias("enzyme_uniprot_id"), F.concat(F.lit("C"), "l_partkey").alias("compound_chembl_id"), F.col("p_name").alias("compound_name"), F.lit("IC50").alias("type"), F.col("l_quantity").alias("value"), F.lit("nM").alias("units"))
    compounds, edges = build.compounds_and_edges(rows)
    enzymes = build.renamed_distinct(table(spark, sf_dir, "supplier").withColumn("ac", F.concat(F.lit("S"), "s_suppkey")), enzyme_id="ac", gene_symbol="s_name")
    as_rows = lambda df, kind, a, b, v: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), v.cast("double").alias("value"))
    none = F.lit(None)
    return as_rows(compounds, "compound", "compound_id", "name", none).unionAll(as_rows(edges, "edge", "enzyme_id", "compound_id", F.col("value"))).unionAll(as_rows(enzymes, "enzyme", "enzyme_id", "gene_symbol", none))


@query(
    """
    WITH r AS (SELECT l_suppkey AS p, CAST(l_quantity AS INT) AS pos, l_partkey AS item, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS kind FROM lineitem), k AS (SELECT p_partkey AS item FROM part WHERE p_size > 10)
    SELECT 'proteins' AS measure, NULL AS name, count(DISTINCT p) AS n, CAST(NULL AS DOUBLE) AS percent FROM r UNION ALL SELECT 'sites', NULL, count(DISTINCT (p, pos)), NULL FROM r UNION ALL SELECT 'items', NULL, count(DISTINCT item), NULL FROM r
    UNION ALL SELECT 'triples', NULL, count(DISTINCT (p, pos, item)), NULL FROM r
    UNION ALL SELECT 'known items', NULL, count(DISTINCT r.item) FILTER (k.item IS NOT NULL), round(100 * count(DISTINCT r.item) FILTER (k.item IS NOT NULL) / count(DISTINCT r.item), 2) FROM r LEFT JOIN k USING (item)
    UNION ALL SELECT 'kind', CASE WHEN kind = '' THEN 'unknown' ELSE kind END, count(*), NULL FROM r GROUP BY kind
    """
)
def site_statistics(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("p"), F.col("l_quantity").cast("int").alias("at"), F.col("l_partkey").alias("item"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("kind"))
    return ag.site_statistics(r, "p", "at", "item", "kind", table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("item")))


@query("SELECT 'n' || s_nationkey AS key, string_agg('s' || s_suppkey, ',' ORDER BY 's' || s_suppkey) AS items FROM supplier GROUP BY s_nationkey UNION ALL SELECT 'p' || l_partkey, string_agg(DISTINCT 's' || l_suppkey, ',' ORDER BY 's' || l_suppkey) FROM lineitem GROUP BY l_partkey")
def sets_either_way(spark, sf_dir):
    """Suppliers of nations, whose edges lead to the set's owner, and of parts, whose edges come from it."""
    from .catalog import edges_of, nodes_of
    from .operators import joins

    typed = joins.endpoint_types(nodes_of(spark, sf_dir), edges_of(spark, sf_dir, "in_nation", "supplied_by"))
    both = ag.sets_either_way(typed, "in_nation", "nation", "supplier").unionAll(ag.sets_either_way(typed, "supplied_by", "part", "supplier"))
    return both.select("key", F.array_join("items", ",").alias("items"))


ALPHAS = (0.0, 0.3, 0.5, 0.7, 1.0)


@query(
    """
    WITH i AS (SELECT l_partkey AS item, count(*) AS pop, sum(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem GROUP BY 1), a AS (SELECT unnest([0, 3, 5, 7, 10]) AS alpha),
    r AS (SELECT alpha, item, row_number() OVER (PARTITION BY alpha ORDER BY alpha * qty + (10 - alpha) * pop DESC, item) AS place FROM i, a),
    g AS (SELECT DISTINCT l_suppkey AS grp, l_partkey AS item FROM lineitem),
    b AS (SELECT alpha, grp, min(place) AS rank FROM g JOIN r USING (item) GROUP BY ALL)
    SELECT CAST(alpha AS INTEGER) AS alpha, count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(avg((rank <= 10)::INT), 6) AS hits_10 FROM b GROUP BY alpha
    """
)
def group_best_ranks(spark, sf_dir):
    """Best place of any of a supplier's parts in five blends of quantity and popularity."""
    lines = table(spark, sf_dir, "lineitem")
    items = lines.groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("pop"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    alphas = F.explode(F.array(*(F.lit(round(10 * a)) for a in ALPHAS))).alias("alpha")
    blends = items.select("item", "pop", "qty", alphas).select("alpha", "item", (F.col("alpha") * F.col("qty") + (10 - F.col("alpha")) * F.col("pop")).alias("score"))
    groups = lines.select(F.col("l_suppkey").alias("group"), F.col("l_partkey").alias("item"))
    ranks = rk.group_best_ranks(groups, blends, ["alpha"], 0)
    return rk.rank_metrics(ranks, ["alpha"]).select("alpha", "n", F.round("mrr", 6).alias("mrr"), F.round("hits_10", 6).alias("hits_10"))


@query(
    """
    WITH s AS (SELECT doc_id, translate(text, 'eaio', 'NSTN') AS c FROM documents), i AS (SELECT doc_id, c, c[1:20] || c[26:] AS iso, doc_id % 60 + 1 AS p FROM s),
    q AS (SELECT doc_id, p, c, iso, unnest(range(greatest(1, p - 50), least(length(c), p + 50) + 1)) AS q FROM i WHERE p <= length(iso)),
    h AS (SELECT doc_id, q, iso[greatest(p - 10, 1) : p + 10] AS here, c[greatest(q - 10, 1) : q + 10] AS there FROM q WHERE c[q] = iso[p]),
    j AS (SELECT doc_id, q, len(list_filter(range(1, least(length(here), length(there)) + 1), lambda k: here[k] = there[k])) / least(length(here), length(there)) AS share FROM h),
    b AS (SELECT doc_id, max(share) AS share, arg_min(q, (-share, q)) AS q FROM j GROUP BY doc_id)
    SELECT i.doc_id, CAST(CASE WHEN p > length(iso) THEN NULL WHEN iso = c THEN p WHEN length(iso) = length(c) THEN CASE WHEN iso[p] = c[p] THEN p END WHEN share >= 0.5 THEN q END AS INTEGER) AS position,
      len(regexp_extract_all(c, 'N[^P][ST]')) AS sequons FROM i LEFT JOIN b USING (doc_id)
    """
)
def isoform_positions(spark, sf_dir):
    """Places of residues in the whole of a sequence of which five residues are left out; and its motifs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "eaio", "NSTN").alias("c"))
    d = d.withColumns({"iso": F.concat(F.substring("c", 1, 20), F.col("c").substr(F.lit(26), F.length("c"))), "p": (F.col("doc_id") % 60 + 1).cast("int")})
    return d.select("doc_id", sq.canonical_position("iso", "c", "p").alias("position"), F.size(sq.sequon_positions(F.col("c"))).cast("long").alias("sequons"))


@query(
    """
    WITH x AS (SELECT p_partkey, p_size % 7 + 1 AS n FROM part)
    SELECT p_partkey, CAST(n AS DOUBLE) AS man, round(ln(1 + n), 9) AS man_log, CASE WHEN n < 3 THEN 4 WHEN n >= 5 THEN 0 ELSE 3 END AS core_type, CASE WHEN n - 2 <= 2 THEN 1 WHEN n - 2 <= 4 THEN 2 ELSE 3 END AS antennae, CAST(n AS INTEGER) AS total FROM x
    """
)
def composition_features(spark, sf_dir):
    """Features of chains of one to seven mannoses."""
    n = F.col("p_size") % 7 + 1
    bonds = F.array_join(F.array_repeat(F.lit("a4-b1"), n - 1), "_")
    text = F.concat(F.lit("WURCS=2.0/1,1,1/[a1122h-1b_1-5]/"), F.array_join(F.array_repeat(F.lit("1"), n), "-"), F.lit("/"), bonds)
    f = table(spark, sf_dir, "part").select("p_partkey", st.composition_features(text).alias("f"))
    return f.select("p_partkey", F.get("f.composition", F.lit(1)).alias("man"), F.round(F.get("f.composition_log", F.lit(1)), 9).alias("man_log"), "f.core_type", "f.antennae", "f.total")


# sample builders

KINDS = ("AF", "NF", "NO", "RF")


@query(
    """
    WITH p AS (SELECT DISTINCT l_suppkey AS query, l_partkey AS item FROM lineitem), v AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_partkey) - 1 AS item_id FROM part WHERE p_size > 5),
    c AS (SELECT DISTINCT l_partkey AS item, l_returnflag || l_linestatus AS class FROM lineitem WHERE l_quantity > 20),
    k AS (SELECT item, list_transform(['AF', 'NF', 'NO', 'RF'], lambda n: CAST(list_contains(list(class), n) AS INTEGER)) AS cs FROM c GROUP BY item),
    f AS (SELECT item, count(*) AS frequency FROM p GROUP BY item),
    m AS (SELECT query, p.item, item_id, frequency, coalesce(cs, [0, 0, 0, 0]) AS cs FROM p JOIN v USING (item) JOIN f USING (item) LEFT JOIN k USING (item)),
    q AS (SELECT query, dense_rank() OVER (ORDER BY query) - 1 AS query_id, max(cs[1]) AS a, max(cs[2]) AS b, max(cs[3]) AS c, max(cs[4]) AS d FROM m GROUP BY query)
    SELECT query, item, query_id, item_id, frequency, array_to_string(cs, '') AS item_classes, a || '' || b || c || d AS query_classes FROM m JOIN q USING (query)
    """
)
def retrieval_samples(spark, sf_dir):
    """Suppliers ask for parts; a part's classes are its lines' states."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("item")).distinct()
    classes = lines.where("l_quantity > 20").select(F.col("l_partkey").alias("item"), F.concat("l_returnflag", "l_linestatus").alias("class")).distinct()
    items = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("item"))
    out = samples.retrieval_samples(pairs, items, classes, list(KINDS))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "") for c in ("item_classes", "query_classes")})


@query(
    """
    WITH t AS (SELECT conv_id AS protein, turn, CAST(length(coalesce(text, '')) AS DOUBLE) AS a, CAST(turn AS DOUBLE) AS b, role FROM conversations),
    r AS (SELECT protein, row_number() OVER (PARTITION BY protein ORDER BY turn, a) AS k, a, b, count(*) OVER (PARTITION BY protein) AS n FROM t),
    s AS (SELECT protein, turn * 3 - 2 AS position, role AS item FROM t),
    w AS (SELECT s.protein, s.position, s.item, a, b, exp(-0.15 * abs(k - greatest(least(position, n), 1))) AS w FROM s JOIN r ON r.protein = s.protein WHERE abs(k - greatest(least(position, n), 1)) <= 16),
    m AS (SELECT protein, avg(a) AS ma, avg(b) AS mb FROM r GROUP BY protein), c AS (SELECT protein, max((role = 'user')::INT) AS u, max((role = 'assistant')::INT) AS x FROM t GROUP BY protein),
    l AS (SELECT protein, position, item, sum(a * w) / sum(w) AS la, sum(b * w) / sum(w) AS lb FROM w GROUP BY ALL)
    SELECT protein, CAST(position AS BIGINT) AS position, item, round(la, 6) AS local_a, round(lb, 6) AS local_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, u || '' || x || u AS classes FROM l JOIN m USING (protein) JOIN c USING (protein)
    """
)
def site_samples(spark, sf_dir):
    """Conversations are proteins, turns residues with a length and a number; sites lie on and beyond them."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("protein"), "turn", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("a"), F.col("role").alias("item"))
    vectors = F.transform(F.array_sort(F.collect_list(F.struct("turn", "a"))), lambda r: F.array(r["a"], r["turn"].cast("double")))  # a conversation has few turns
    residues = t.groupBy("protein").agg(vectors.alias("vectors"))
    sites = t.select("protein", (F.col("turn") * 3 - 2).alias("position"), "item").distinct()
    roles = t.select("item").distinct()
    classes = roles.where("item = 'user'").select("item", F.explode(F.array(F.lit("u"), F.lit("v"))).alias("class")).unionAll(roles.where("item = 'assistant'").select("item", F.lit("x")))
    s = samples.site_samples(sites, residues, classes, ["u", "x", "v"])
    of = lambda c, k, n: F.round(F.get(c, F.lit(k)), 6).alias(n)
    return s.select("protein", F.col("position").cast("long").alias("position"), "item", of("local", 0, "local_a"), of("local", 1, "local_b"), of("mean", 0, "mean_a"), of("mean", 1, "mean_b"), F.array_join(F.col("classes").cast("array<string>"), "").alias("classes"))


STANDARD = ", ".join(f"round((c{k} - avg(c{k}) OVER ()) / greatest(stddev_samp(c{k}) OVER (), 1e-6), 6) AS c{k}" for k in range(13))


@query(
    f"""
    WITH d AS (SELECT doc_id, translate(text, 'eaio', 'NSTN') AS s FROM documents), m AS (SELECT doc_id, s, regexp_extract_all(s, '(?s).*?N[^P][ST]') AS parts FROM d),
    e AS (SELECT doc_id, s, len(parts) AS n, unnest(list_transform(range(1, len(parts) + 1), lambda k: CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) AS BIGINT) - 2)) AS p FROM m),
    w AS (SELECT *, length(s) AS l, s[greatest(1, p - 15) : least(length(s), p + 17)] AS w, s[greatest(1, p - 30) : least(length(s), p + 32)] AS v FROM e),
    c AS (SELECT doc_id, p, s, (s[p + 2] = 'S')::INT AS c0, (s[p + 2] = 'T')::INT AS c1, (p - 1) / l AS c2, (l - p + 1) / l AS c3, n AS c4, ln(1 + l) AS c5, (p <= 30)::INT AS c6,
      len(regexp_extract_all(w, '[DEKRH]')) / length(w) AS c7, len(regexp_extract_all(w, '[STCYNQ]')) / length(w) AS c8, len(regexp_extract_all(w, '[AILMFWV]')) / length(w) AS c9, len(regexp_extract_all(w, 'P')) / length(w) AS c10,
      len(regexp_extract_all(w, 'C')) / length(w) AS c11, len(regexp_extract_all(v, 'N[^P][ST]')) / 63 AS c12 FROM w),
    k AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS p FROM lineitem)
    SELECT c.doc_id AS protein, CAST(c.p AS INTEGER) AS position, (k.p IS NOT NULL)::INT AS label,
      array_to_string(list_transform(range(-3, 6), lambda o: CASE WHEN c.p + o < 1 OR c.p + o > length(s) OR instr('ACDEFGHIKLMNPQRSTVWY', s[c.p + o]) = 0 THEN 20 ELSE instr('ACDEFGHIKLMNPQRSTVWY', s[c.p + o]) - 1 END), ',') AS keys, {STANDARD}
    FROM c LEFT JOIN k ON k.doc_id = c.doc_id AND k.p = c.p
    """
)
def motif_samples(spark, sf_dir):
    """Motifs of texts read as sequences, labelled by a table of places."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("protein"), F.translate("text", "eaio", "NSTN").alias("sequence"))
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("protein"), F.col("l_partkey").cast("int").alias("position"))
    s = samples.motif_samples(d, known)
    return s.select("protein", "position", "label", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"), *(F.round(F.get("context", F.lit(k)), 6).alias(f"c{k}") for k in range(13)))
