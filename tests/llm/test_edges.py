"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import math

import pytest
from pyspark.sql import functions as F

from kgloom.llm import bpe, embedding_dedup, line_dedup, mixing, quality, sharding, simhash, topk, url_filter, warc

P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_50k.json")
LONG = "word " * 60000 + "\n" + "x" * 200000
TEXTS = [None, "", "  \n ", "Hello, wörld 🙂 don't\nline two here", "Hello, wörld 🙂 don't\nline two here", LONG, "a\x00b", "\n\n", "日本語のテキストです。" * 5]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, ids string, n int, h long, score double, component string, bands int"


@pytest.fixture(scope="module")
def docs(spark):
    """All kinds of text, a null id, a repeated row, a null source, and columns that operators use inside."""
    data = [(k, t, None, None if k == 2 else f"s{k % 3}", None, 1, 2, "x", 3, 4, 0.5, "c", 6) for k, t in enumerate(TEXTS)]
    data += [(None, "no id at all", "en", "s1", 1, 1, 2, "x", 3, 4, 0.5, "c", 6), data[3]]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def text_of(t):
    return t or ""


def shingles(line):
    return {line[k : k + 8] for k in range(max(1, len(line) - 7))}


def test_bpe_equals_tiktoken_and_decodes(docs, empty):
    import base64
    import hashlib

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode(docs, BPE, offsets=True).collect():
        assert r.ids == enc.encode_ordinary(text_of(r.text))
        t = text_of(r.text)
        assert all(0 <= a < b <= len(t) for a, b in zip(r.ids_start, r.ids_end))
        assert (r.ids_end or [0])[-1] == len(t) and r.lang in (None, "en")
    for r in bpe.decode(bpe.encode(docs, BPE), BPE).collect():
        assert bytes(r.decoded) == text_of(r.text).encode() and r.decoded_text == text_of(r.text)
    for r in bpe.digests(docs.select("doc_id", "text"), BPE).collect():
        assert len(r.ids_sha256) == 64 == len(r.decoded_sha256)
    assert hashlib.sha256(b"").hexdigest() in {r.ids_sha256 for r in bpe.digests(docs, BPE).collect()}
    assert bpe.encode(empty, BPE).count() == 0 and bpe.decode(bpe.encode(empty, BPE), BPE).count() == 0


def test_bpe_splits_every_code_point_as_tiktoken(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)} {chr(c)}b" for c in points[k : k + 2048]) for k in range(0, len(points), 2048)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_proven(df, BPE).collect():
        assert r.round_trip and r.ids == enc.encode_ordinary(texts[r.doc_id])


def test_bpe_special_strings_are_text(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    assert 50256 not in bpe.encode(df, BPE).first().ids


def test_split_characters_meet_again(spark):
    df = spark.createDataFrame([(1, "🙂é")], "doc_id long, text string")
    ids = bpe.encode(df, BPE).first().ids
    halves = spark.createDataFrame([(ids[:1],), (ids,)], "ids array<int>")
    one, two = bpe.decode(halves, BPE).collect()
    assert "\ufffd" in one.decoded_text and two.decoded_text == "🙂é" and bytes(two.decoded) == "🙂é".encode()


def test_lines(docs, empty):
    got = line_dedup.line_components(docs).collect()
    assert not [r for r in got if r.doc_id in (0, 1, 2, 7)]  # nothing but blank lines
    by = {(r.doc_id, r.line_no): r for r in got}
    assert (by[4, 0].component_doc, by[4, 0].kept) == (3, False) and by[3, 0].kept
    assert by[None, 0].kept
    left = line_dedup.drop_lines(docs)
    assert sorted(left.columns) == sorted(docs.columns)
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in left.collect())
    assert ids == [-1, 0, 1, 2, 3, 3, 5, 6, 7, 8]
    assert line_dedup.line_components(empty).count() == 0 and line_dedup.drop_lines(empty).count() == 0


def test_near_lines_and_hot_line(spark):
    base = " ".join(f"token{k} alpha" for k in range(40))
    near = [base.replace(f"token{k} ", f"other{k} ") for k in range(30)]
    data = [(k, t) for k, t in enumerate([base, *near])] + [(1000 + k, "the very same line for everyone") for k in range(300)]
    got = line_dedup.line_components(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sum(r.kept for r in got) == 2
    assert {r.component_doc for r in got} == {0, 1000}


def test_lines_that_share_a_band_are_all_compared(spark):
    import itertools
    import random

    from tests.llm.test_queries import components

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7)))
    texts = []
    for _ in range(60):  # chains: each line differs from the one before at one more word
        line = [word() for _ in range(24)]
        for k in rng.sample(range(24), 8):
            texts.append(" ".join(line))
            line[k] = word()
    for _ in range(3):  # templates of which any words vary
        line = [word() for _ in range(24)]
        for _ in range(100):
            own = list(line)
            for k in rng.sample(range(24), rng.randint(1, 6)):
                own[k] = word()
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bands = {}
    for r in line_dedup.bands(line_dedup.minima(df.select(F.col("doc_id").alias("h"), F.col("text").alias("line")))).collect():
        bands.setdefault(r.h, set()).add(r.b)
    sets = [shingles(t) for t in texts]
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if bands[a] & bands[b] and near(sets[a], sets[b])]
    got = {r.doc_id: r.component_doc for r in line_dedup.line_components(df).collect()}
    assert got == components(range(len(texts)), pairs) and len(pairs) > 400


def test_lines_without_letters_are_apart(spark):
    data = [(k, t) for k, t in enumerate(["\x01", "\x7f\x7f\x7f", "\u00a0", "\x01", "\u200b\u200b"])]
    got = {r.doc_id: r.component_doc for r in line_dedup.line_components(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4}


def test_candidates_beyond_the_sketch(docs, monkeypatch):
    want = sorted(map(str, line_dedup.line_components(docs).collect()))
    monkeypatch.setattr(line_dedup, "SKETCH_BITS", 4)
    assert sorted(map(str, line_dedup.line_components(docs).collect())) == want


def test_clashing_columns(spark):
    names = ["doc_id", "text", "source", "_key", "_hash", "_gone", "key", "hash", "gone", "left", "row", "target", "whole", "cut", "extra", "need", "_size", "_of", "_copy", "size", "stats", "predicted"]
    data = [(k, f"line one of {k} stands here\nand the same line for all", "s", *range(len(names) - 3)) for k in range(12)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names[3:]))
    labels = df.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    for out in (line_dedup.drop_lines(df), simhash.drop_near_duplicates(df), mixing.mix_rows(df), quality.drop_rejected(df, labels)):
        assert out.columns == names and all(tuple(r)[3:] == data[0][3:] for r in out.collect())


def test_recall_over_a_thousand_links(spark, capsys):
    """Lines of 4 to 200 words in families of copies with more and more edits, all pairs of a family compared by hand."""
    import itertools
    import random

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    data, families = [], []
    for _ in range(100):
        line, own = [word() for _ in range(rng.choice((4, 6, 9, 14, 25, 60, 200)))], []
        for _ in range(14):
            own.append(len(data))
            data.append((len(data), " ".join(line)))
            line = [*line]
            for _ in range(max(1, len(line) // 40)):  # a chain: each differs a little from the one before
                line[rng.randrange(len(line))] = word()
        families.append(own)
    got = {r.doc_id: r.component_doc for r in line_dedup.line_components(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in data]
    near = [(a, b) for f in families for a, b in itertools.combinations(f, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = sum(got[a] == got[b] for a, b in near)
    parent = {k: k for k in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    false = sum(root(k) != root(c) for k, c in got.items())
    with capsys.disabled():
        print(f"\nop3: {found} of {len(near)} links found, {false} lines joined wrongly")
    assert len(near) >= 1000 and found >= 0.99 * len(near) and false == 0


def test_sketches_lose_no_link_and_take_little_room(spark, monkeypatch):
    """No similar pair is refused by its sketches, nearly all others are, and the written tables stay near the texts' size."""
    import itertools
    import random

    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    base, data = [word() for _ in range(260)], []  # lines of over a thousand shingles, more than any sample of them
    for k in range(100):
        line = list(base)
        for _ in range(rng.choice((2, 12, 20, 60))):
            line[rng.randrange(260)] = word()
        data.append((k, " ".join(line)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    bits = line_dedup.sketches(df.select(F.col("doc_id").alias("h"), F.col("text").alias("line")))
    sets = [shingles(t) for _, t in data]
    assert {r.h: r.sketch.n for r in bits.collect()} == {k: len(s) for k, s in enumerate(sets)}
    p, q = (bits.select(F.col("h").alias(h), F.col("sketch").alias(s)) for h, s in (("a", "p"), ("b", "q")))
    got = {(r.a, r.b) for r in p.crossJoin(q).where("a < b").where(line_dedup._possible(F.col("p"), F.col("q"))).select("a", "b").collect()}
    near = {(a, b) for a, b in itertools.combinations(range(100), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    far = {(a, b) for a, b in itertools.combinations(range(100), 2) if len(sets[a] & sets[b]) < 0.6 * len(sets[a] | sets[b])}
    assert near <= got and not far & got and len(near) > 100 and len(far) > 500
    took, save = {}, line_dedup.Scratch.save

    def measured(self, frame, name):
        import pathlib

        out = save(self, frame, name)
        top = pathlib.Path(out.scratch_path.removeprefix("file:"))
        took[name] = took.get(name, 0) + sum(x.stat().st_size for x in top.glob("*.parquet"))
        seen.append(top)
        return out

    seen = []
    monkeypatch.setattr(line_dedup.Scratch, "save", measured)
    line_dedup.line_components(df).collect()
    size = sum(len(t) for _, t in data)
    assert took["texts"] + took.get("sketches", 0) <= 1.5 * size  # a sample of shingles beside each text took far more
    assert "blocks" in took and not any(x.exists() for x in seen if "-blocks" in x.name or "-texts" in x.name)


def test_shingles_do_not_depend_on_the_rest_of_a_line(spark):
    """A window is the same shingle in lines with and without wide characters."""
    lines = ["plain words stand here", "plain words stand hér\u00e9", "plain words \u2014 stand here", "\u201cplain words stand here\u201d", "\U0001f642 plain words stand here", "?! plain ?! words", "?\u2014 plain ?! words", "\u4e2d", "\u4e2d\u6587", "a", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "k long, line string").where("line <> ''")
    got = {r.k: set(r.s) for r in df.select("k", line_dedup._all_shingles(F.col("line")).alias("s")).collect()}
    for a in got:
        assert len(got[a]) == len(shingles(lines[a]))
        for b in got:
            assert len(got[a] & got[b]) == len(shingles(lines[a]) & shingles(lines[b])), (lines[a], lines[b])
    least = {r.h: {x for x in r[1:] if x is not None} for r in line_dedup.minima(df.select(F.col("k").alias("h"), "line")).collect()}
    assert all(least[k] and least[k] <= got[k] for k in got)


def test_lines_too_long_for_a_block(spark, monkeypatch):
    """Groups of near lines come out alike whether lines stand in the blocks or fetch their texts."""
    import random

    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(300)) for _ in range(3)]
    data = []
    for k in range(90):
        line = list(base[k % 3])
        for _ in range(rng.randrange(6)):
            line[rng.randrange(300)] = "#"
        data.append((k, "".join(line)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    seen = []
    for most in (1 << 14, 0, 250):
        monkeypatch.setattr(line_dedup, "CARRIED", most)
        monkeypatch.setattr(line_dedup, "BLOCK", 8)
        seen.append({r.doc_id: r.component_doc for r in line_dedup.line_components(df).collect()})
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0].values())) < 60
    sets = [shingles(t) for _, t in data]
    near = [(a, b) for a in range(90) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(seen[0][a] == seen[0][b] for a, b in near) >= 0.99 * len(near) > 200


def test_columns_named_as_the_operators_own(spark):
    """Whatever columns are called, they stay; key and source may have any name."""
    names = ["doc_id", "text", "k1", "k2", "part", "at", "bucket", "of", "cut", "need", "_k1", "_part", "_at", "_bucket", "url", "host", "ids", "Whole"]
    data = [(k, f"text {k % 5} of some", *range(len(names) - 2)) for k in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names[2:]))
    out = sharding.shard_by_bytes(df, 3)
    assert out.columns == [*names, "size", "shard", "slot"] and all(tuple(r)[2:-3] == data[0][2:] for r in out.collect())
    mixed = mixing.mix(df.withColumnsRenamed({"at": "source"}).select("*", F.col("doc_id").alias("target")), "target", source="bucket")
    assert mixed.columns == ["target", "bucket", "size", "source_size", "target", "whole", "extra", "taken"]
    mixed = mixing.mix(df.select(F.col("doc_id").alias("_at"), F.col("of").alias("_bucket"), "text"), "_at", source="_bucket")
    assert mixed.columns[:2] == ["_at", "_bucket"] and {r._at for r in mixed.collect()} == set(range(20))
    sizes = df.withColumn("n", F.lit(4).cast("long"))
    got = mixing.apply_mix(sizes, mixing.plan_mix(sizes, "doc_id", "of", "n"), "doc_id", "of", "n")
    assert got.columns == [*names[:-1], "n", "source_size", "target", "whole", "extra"] and got.count() == 20
    assert bpe.encode(df.drop("ids"), BPE).columns[: len(names) - 1] == [n for n in names if n != "ids"]
    judged = url_filter.judge_urls(df.withColumns({"url": F.lit("http://a.com/en/x"), "page_id": F.col("doc_id")}))
    assert judged.count() == 20 and all(r.host == "a.com" for r in judged.collect())


@pytest.mark.parametrize("n", [1, 2, 7, 50, 400])
def test_places_among_boundaries(spark, n):
    import bisect
    import random

    rng = random.Random(n)
    cuts = sorted({(rng.randrange(30), rng.randrange(9)) for _ in range(n)})
    rows = [(a, b) for a in range(-1, 32) for b in range(10)]
    part = sharding._part(cuts)
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", part(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r.p == bisect.bisect_right(cuts, (r.a, r.b)) for r in got)


def test_shards_are_written(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard_by_bytes(docs, 3), f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == docs.count() and set(back.columns) == {*docs.columns, "slot"}


def test_lines_with_one_edit_are_linked(spark):
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice((2, 3, 4, 4, 5, 5, 6, 7, 8))))
    data = []
    for k in range(200):
        line = [word() for _ in range(rng.randint(11, 16))]
        at = len(line) // 2
        edited = [*line[:at], line[at][:-1] + "#", *line[at + 1 :]]  # one letter
        data += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(edited))]
    got = {r.doc_id: r.component_doc for r in line_dedup.line_components(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    near = [a for (a, x), (_, y) in zip(data[::2], data[1::2]) if len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y))]
    assert len(near) >= 60 and sum(got[a + 1] == a for a in near) >= 0.98 * len(near)


def test_lines_of_rows_that_share_a_key(spark):
    one, two, three = ("some first words of a line", "quite other things stand here", "and nothing else is alike at all")
    data = [(1, one), (None, f"{one}\n{two}"), (None, f"{three}\nno line is like this one"), (None, f"last of the lines\n{two}")]
    data += [(5, f"{one}\nseven and eight"), (5, "zebras run far\nnine and ten")]
    left = line_dedup.drop_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    lines = [x for r in left for x in r.text.split("\n")]
    assert sorted(lines) == sorted({x for _, t in data for x in t.split("\n")})  # each once, none lost


def test_simhash(docs, empty):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert {c for (d, f), c in got.items() if f == 0} == {0}
    assert {c for (d, f), c in got.items() if d in (3, 4)} == {3}
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
    assert 4 not in kept and kept.count(3) == 2 and 1 not in kept  # a repeated row is the same document
    assert simhash.simhash_groups(empty).count() == 0


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert all(taken == round(target) and target <= 2 * size for taken, target, size in by.values())
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mix_rows(empty).count() == 0
    assert mixing.mix_rows(docs).columns == docs.columns


def test_water_filling_redistributes(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, (5, 2, 1), (3, 2), 2).collect()}
    assert got == {"a": 20.0, "b": 200.0, "c": 1445.0, None: 0.0}


def test_shards(docs, empty):
    got = sharding.shard_by_bytes(docs, 4).collect()
    assert len(got) == docs.count()
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r["size"] for r in got if r.text is None} == {1}
    assert sharding.shard_by_bytes(empty).count() == 0


def test_hot_text_is_spread(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one and the same text").alias("text"))
    sizes = sharding.shard_by_bytes(df, 8).groupBy("shard").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 2


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/", "http://x.net/fr", "http://x.net/fr/", "http://b.com?x=/en/", "http://ÄB.net/es/Ä", "http://example.com#a://b/c"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert all(got[k][:3] == ("", "", None) for k in (0, 1, 2, 3))
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5][2:] == ("example.com/en/", "block") and got[6][2] is None and got[7][2:] == ("net/fr/", "block")
    assert got[8][:3] == ("b.com", "", None) and got[9][:3] == ("Äb.net", "/es/Ä", "net/es/") and got[10][:2] == ("example.com", "")
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_quality_edges(docs, empty, spark):
    labels = spark.createDataFrame([(3, 1), (5, 0), (8, 1), (6, 0), (None, 1), (4, None), (4, 7)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    none = quality.score_quality(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0
    assert quality.drop_rejected(docs, labels).columns == docs.columns


VECS = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, float("nan")], 1), (6, [1.0, float("inf")], 1), (7, [1.0, None], 1),
        (8, [1.0, 0.01], 1), (9, [1.0, 0.0], None), (10, [1.0], 1), (11, [], 1), (50, [0.5, 0.5], 3), (50, [0.5, 0.5], 3), (None, [1.0, 0.0], 1)]


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.createDataFrame([(*v, 1, "x") for v in VECS], "vec_id long, embedding array<float>, label int, n int, kept string")


def test_vectors(vecs):
    got = {}
    for r in embedding_dedup.embedding_groups(vecs).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[0] == [(3, 0, True)] and got[1] == [(3, 0, False)] and got[8] == [(3, 0, False)] and got[None] == [(3, 0, False)]
    assert all(got[k] == [(0, k, True)] for k in (2, 3, 4, 5, 6, 7, 9, 10, 11))
    assert got[50] == [(1, 50, True)] * 2
    assert embedding_dedup.embedding_groups(vecs.where("false")).count() == 0


def test_quantisation_bounds_hold(spark):
    import numpy as np

    x = np.random.default_rng(3).standard_normal((300, 48))
    x[150:] = x[:150] + 0.3 * np.random.default_rng(4).standard_normal((150, 48))
    q = embedding_dedup.Quantised(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = unit @ unit.T >= embedding_dedup.THRESHOLD
    maybe = q.possible(q, slice(0, 300))
    assert not (exact & ~maybe).any() and maybe.mean() < 0.2
    assert (q.linked(q) == exact).all()


def test_topk_edges(vecs):
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vecs).orderBy("query_id", "rank").collect()]
    want = sorted(((256 * math.floor(256 * v[0]), -i) for i, v in ((1, [2.0]), (2, [1.0]), (3, [0.0]), (8, [1.0]), (9, [1.0]), (10, [1.0]), (11, [0.0]))), reverse=True)
    assert [g[0] for g in got[:5]] == [0] * 5 and [(256 * g[3] // 256, -g[2]) for g in got if g[0] == 0][:1] == [(want[0][0], want[0][1])]
    assert [g[2] for g in got if g[0] == 50][:3] == [1, 1, 8]  # both rows of id 1
    assert topk.top_k(vecs.where("false")).count() == 0


@pytest.mark.parametrize("sizes", [(4096, 512), (64, 4)])
def test_topk_of_repeated_ids(spark, monkeypatch, sizes):
    """Every row but the query's own is a candidate, also one that repeats its id."""
    import numpy as np

    monkeypatch.setattr(topk, "SHARD_ROWS", sizes[0])
    monkeypatch.setattr(topk, "BLOCK_ROWS", sizes[1])
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (500, 4)) / 256.0
    ids = [k % 200 for k in range(500)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    q = np.floor(256 * x).astype(int)
    want = []
    for i in (k for k in range(500) if ids[k] % 50 == 0):
        best = sorted((-(q[i] @ q[j]), ids[j]) for j in range(500) if j != i)[:5]
        want += [(ids[i], n + 1, j, int(-s)) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)


def test_vectors_in_many_tiles(spark, monkeypatch):
    """More than one tile a label, and components whose squares no double holds."""
    import numpy as np

    from tests.llm.test_queries import components

    monkeypatch.setattr(embedding_dedup, "TILE", 32)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base[rng.integers(0, 60, 300)] + 0.07 * rng.standard_normal((300, 16))]) * np.array([1e200, 1e-200, 1.0])[rng.integers(0, 3, 300), None]
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    comp = components(range(300), [(a, b) for a in range(300) for b in range(a) if near[a, b]])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_groups(df).collect()}
    assert got == {k: (int(near[k].sum()) - 1, comp[k]) for k in range(300)}


def test_topk_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (900, 5)) / 256.0  # many ties
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(256 * x).astype(int)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df).collect()}
    for i in range(0, 900, 50):
        order = sorted((-(q[i] @ q[j]), j) for j in range(900) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in order]


def test_warc_edges(spark):
    big = "<p>ä</p>" * 300
    data = [(1, "http://a/1", big), (2, None, big), (3, "http://a/\r\n3", "small"), (4, "http://a/4", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", big + "x")]
    df = spark.createDataFrame([(*d, 1) for d in data], "page_id long, url string, html string, digest int")
    got = {r.page_id: r for r in warc.round_trip(spark, df).collect()}
    assert len(got) == len(data)
    assert got[2].record_type == "response" and (got[1].record_type, got[1].refers_to) == ("revisit", 2) and got[None].refers_to == 2
    assert all(got[k].record_type == "response" and got[k].refers_to is None for k in (3, 4, 5, 6, 7))
    import hashlib

    for k, _, html in data:
        raw = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert warc.round_trip(spark, df.where("false")).count() == 0


def test_zip_directory(tmp_path):
    import zipfile

    from kgloom.llm.zip_archive import ZipReader, ZipWriter

    path = tmp_path / "own.zip"
    with path.open("wb") as f:
        w = ZipWriter(f)
        w.add("a/b.bin", [b"one", b"two"])
        w.add("empty", [])
        w.close()
    with zipfile.ZipFile(path) as z:
        assert z.read("a/b.bin") == b"onetwo" and z.testzip() is None
    with path.open("rb") as f:
        r = ZipReader(f, path.stat().st_size)
        assert r.read("a/b.bin") == b"onetwo" and r.read("empty") == b""
    other = tmp_path / "other.zip"
    with zipfile.ZipFile(other, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"data")
        z.writestr("y", b"data" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 in it"
    with other.open("rb") as f:
        r = ZipReader(f, other.stat().st_size)
        assert r.read("x") == b"data"
        with pytest.raises(ValueError):
            r.read("y")
