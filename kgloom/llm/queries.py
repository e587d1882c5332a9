"""The queries that apply each operator to its whole table, and their SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup

    return embedding_dedup.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.line_components(_table(spark, sf_dir, "documents"))


def op4_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    back = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import filter_audit

    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination

    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.hit_words(F.col("spans")).cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spelling

    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op10_topk": op10_topk,
    "op11_filter_audit": op11_filter_audit,
    "op12_decontamination": op12_decontamination,
    "op13_spelling_variants": op13_spelling_variants,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_shard_by_bytes": op4_shard_by_bytes,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_mix_sources": op8_mix_sources,
    "op9_simhash": op9_simhash,
}

#: Queries without SQL here can't be said in it; tests hold them against brute force.
SQL: dict[str, str] = {
    "op7_warc": """
    WITH p AS (
      SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
    FROM g
    """,
    "op10_topk": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_mix_sources": r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS dg FROM documents),
    s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
    s2 AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s1),
    s3 AS (
      SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS rank_by,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
             sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             sum(source_size) OVER () AS total FROM s2),
    s4 AS (SELECT *, total * 3 - clamped * 2 AS rest FROM s3),
    f AS (SELECT rank_by, rest, open FROM s4 WHERE cap * open * 2 >= rest * weight ORDER BY rank_by LIMIT 1),
    s5 AS (
      SELECT s4.source, source_size,
             CASE WHEN f.rank_by IS NULL OR s4.rank_by < f.rank_by THEN CAST(cap AS DOUBLE)
                  ELSE CAST(weight * f.rest AS DOUBLE) / CAST(f.open * 2 AS DOUBLE) END AS target
      FROM s4 LEFT JOIN f ON true),
    s6 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM s5),
    c AS (
      SELECT *, CAST(('0x' || dg[1:8]) AS BIGINT) % 4096 AS bucket FROM d),
    r AS (
      SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, dg, doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(whole * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
    FROM r JOIN s6 ON r.source IS NOT DISTINCT FROM s6.source
    """,
    "op11_filter_audit": r"""
    WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    f AS (
      SELECT doc_id, part,
             concat(CASE WHEN len(ws) < 200 THEN 'A' END,
                    CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
                    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' END,
                    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails FROM d),
    c AS (
      SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (
      SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, CAST(step AS INTEGER) AS step FROM o, range(1, 6) r(step)),
    m AS (
      SELECT part, filter_order, step, n, good, toxic, filter_order[step] AS own, fails = filter_order[step] AS alone,
             contains(fails, filter_order[step]) AS now,
             len(list_filter(range(1, step), lambda k: contains(fails, filter_order[k]))) > 0 AS before FROM c, s),
    g AS (
      SELECT part, filter_order, step, any_value(own) AS own,
             coalesce(sum(n) FILTER (NOT now AND NOT before), 0) AS kept, coalesce(sum(n) FILTER (now AND NOT before), 0) AS removed,
             coalesce(sum(n) FILTER (now AND before), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
             coalesce(sum(good) FILTER (now AND NOT before), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (now AND NOT before), 0) AS toxic_lost
      FROM m GROUP BY part, filter_order, step)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
    """,
    "op12_decontamination": r"""
    WITH d AS (
      SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (
      SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
    w AS (
      SELECT DISTINCT item, least(len(ws), 10) AS w, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS said
      FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) r(k) WHERE len(ws) > 0),
    p AS (
      SELECT row, k, lens.w, array_to_string(ws[k : k + lens.w - 1], ' ') AS said
      FROM d, (SELECT DISTINCT w FROM w) lens, unnest(range(1, len(ws) - lens.w + 2)) r(k)),
    h AS (SELECT DISTINCT row, k, w, item FROM p JOIN w USING (w, said)),
    n AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(k, k + w)) AS place FROM h) GROUP BY row),
    i AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (row) LEFT JOIN i USING (row)
    """,
    "op13_spelling_variants": r"""
    WITH RECURSIVE crc AS (
      SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS tab
      FROM range(256) r(i)),
    r AS (
      SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
    o AS (
      SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
      FROM r GROUP BY ALL),
    h AS (
      SELECT run, n, xor(4294967295, list_reduce(
               list_concat([4294967295], list_transform(range(strlen(id || ':' || run)), lambda k: CAST('0x' || hex(encode(id || ':' || run))[2 * k + 1 : 2 * k + 2] AS BIGINT))),
               lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) AS h FROM o, crc),
    w AS (
      SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
      FROM h GROUP BY 1),
    v AS (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
    cut AS (SELECT word, n, k, word[1 : k - 1] || word[k + 1 :] AS less FROM v, unnest(range(1, length(word) + 1)) r(k)),
    near AS (
      SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
      UNION SELECT c.word, c.n, v.word, v.n FROM cut c JOIN v ON c.less = v.word
      UNION SELECT v.word, v.n, c.word, c.n FROM cut c JOIN v ON c.less = v.word),
    best AS (
      SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n, any_value(n) AS n FROM near GROUP BY word),
    f AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 2 * n),
    walk AS (
      SELECT word, form AS last FROM f
      UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.last = f.word),
    roots AS (SELECT word, last AS root FROM walk WHERE last NOT IN (SELECT word FROM f))
    SELECT v.word, f.form, coalesce(root, v.word) AS root, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n
    FROM v LEFT JOIN best USING (word) LEFT JOIN f USING (word) LEFT JOIN roots USING (word)
    """,
}
