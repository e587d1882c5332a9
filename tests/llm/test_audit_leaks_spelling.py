"""Filter audit, decontamination and spelling variants against brute force, and on odd tables."""

import collections
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kgloom.llm import decontamination as dc, filter_audit as fa, spelling as sp
from kgloom.llm.scratch import Scratch

LONG = "word " * 60000 + "\n" + "x" * 200000
TEXTS = [None, "", "  \n ", "Hello, wörld don't", "Hello, wörld don't", LONG, "a\x00b", "SHOUT ALL $5", "same same same same", "日本語のテキスト です。" * 5, "SHOUT ALL $5"]
DOCS = "doc_id long, text string, source string, key int, part string, mask int, n int, good boolean, token long, word string, path string, spans int, window string"


@pytest.fixture(scope="module")
def docs(spark):
    """All kinds of text, null ids and sources, repeated rows, and columns named as the operators' own."""
    more = (1, "p", 2, 3, True, 4, "w", "x", 5, "y")
    data = [(k, t, None if k == 2 else f"s{k % 3}", *more) for k, t in enumerate(TEXTS)]
    data += [(None, "SHOUT ALL $5", "s1", *more), data[3], (None, None, None, *more), (0, "SHOUT ALL $5", "", *more)]
    return spark.createDataFrame(data, DOCS)


def audit_by_hand(rows, labels):
    """Document by document, order by order."""
    good, toxic = {k for k, q, t in labels if q == 1}, {k for k, q, t in labels if t == 1}
    big = float("inf")
    firsts = {}
    for key, text, _ in rows:
        firsts[text or ""] = min(firsts.get(text or "", big), big if key is None else key)
    out = collections.defaultdict(lambda: [0] * 6)
    for key, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        caps = sum("A" <= c <= "Z" for c in t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * caps > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": firsts[t] < (big if key is None else key)}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                cell = out[part or "", "".join(order), step]
                cell[0] += not gone and not fails[f]
                cell[1] += not gone and fails[f]
                cell[2] += gone and fails[f]
                cell[3] += fails[f] and sum(fails.values()) == 1
                cell[4] += not gone and fails[f] and key in good
                cell[5] += not gone and fails[f] and key in toxic
                gone = gone or fails[f]
    shapley = collections.Counter()
    for (part, order, step), cell in out.items():
        shapley[part, order[step - 1]] += cell[1]
    return {k: (*cell, shapley[k[0], k[1][k[2] - 1]]) for k, cell in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_of_odd_tables(spark, docs):
    labels = [(0, 1, 0), (3, 1, 1), (5, 0, 1), (7, 1, None), (7, 0, 1), (None, 1, 1), (10, None, None), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = audit_by_hand(rows, [x for x in labels if x[0] is not None])
    got = told(fa.audit_filters(docs, table))
    assert got == want and len(got) == 600 * 4
    assert fa.audit_filters(docs.where("false"), table).count() == 0
    assert all(x[4:6] == (0, 0) for x in told(fa.audit_filters(docs, table.where("false"))).values())


def test_audit_of_two_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 1, 1), ("p", 3, 2, 1, 0)], "part string, mask int, n long, good long, toxic long")
    assert told(fa.interactions(cells, "AB")) == {("p", "AB", 1): (5, 5, 0, 3, 2, 1, 8), ("p", "AB", 2): (5, 0, 2, 0, 0, 0, 2), ("p", "BA", 1): (8, 2, 0, 0, 1, 0, 2), ("p", "BA", 2): (5, 3, 2, 3, 1, 1, 8)}


def leaks_by_hand(rows, items, window):
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    of = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            of[tuple(w[k : k + n])].add(str(item))
    sizes = {len(w) for w in of}
    out = []
    for key, text in rows:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := of.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((key, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=str)


def leaks(df):
    return sorted(((r.doc_id, r.n_words, tuple(k for s in r.spans for k in range(s.start, s.end)), tuple(r["items"])) for r in df.collect()), key=str)


def test_leaks_against_brute_force(spark, monkeypatch):
    """Few words, so that windows overlap, repeat and share shingles; items of all lengths; runs of some bytes."""
    rng = random.Random(5)
    vocabulary = ["a", "Bé", "c3", "dd", "E", "日本"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "  "]) for _ in range(n))
    items = [(k, say(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 9, 30]))) for k in range(25)] + [(3, say(12)), (24, None)]
    passage = say(40)
    rows = [(k, say(rng.choice([0, 3, 8, 60, 300]))) for k in range(60)] + [(k, say(9) + " " + passage[:k] + " " + say(30)) for k in range(60, 130)] + [(7, say(50)), (None, passage), (None, say(40))]
    items += [(100 + k, passage[3 * k :]) for k in range(6)]
    monkeypatch.setattr(dc, "RUN", 700)
    monkeypatch.setattr(dc, "_POWERS", {})
    d, i = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (10, 4):
        assert leaks(dc.contamination(d, i, window=window)) == leaks_by_hand(rows, items, window)


def test_leaks_of_odd_tables(spark, docs):
    items = [(1, "x" * 200000), (2, "word " * 12), (None, "hello"), (4, ""), (5, None), (6, "HELLO wörld")]
    table = spark.createDataFrame([(*x, 1, "w") for x in items], "item_id int, text string, token int, window string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert leaks(dc.contamination(docs, table)) == leaks_by_hand(rows, [x for x in items if x[0] is not None], 10)
    assert all(not r.spans and not r["items"] for r in dc.contamination(docs, table.where("false")).collect())
    assert dc.contamination(docs.where("false"), table).count() == 0
    left = dc.drop_contaminated(docs, table)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {0, 1, 2, 6, 7, 8, 9, 10, None}


def test_words_end_at_any_byte():
    text = "Ab-9é\x7f\u0080 Z日本`{}[@:/q".encode()
    low, starts, ends, h = dc.words(text)
    assert [low[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["ab", "9é", "\u0080", "z日本", "q"]
    again = dc.words(b"xx " + text)
    assert again[3][1:].tolist() == h.tolist()  # a word's hash does not depend on its place


def near_by_hand(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_hand(counts):
    near = {w: [v for v in counts if near_by_hand(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def noted_by_hand(rows):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            at = h % len(low)
            counts[low[:at] + low[at + 1 :] if h % 97 == 0 else low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_against_brute_force(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = [(k if k % 17 else None, " ".join(rng.choice(["", "A", "x"]) + rng.choice(stems) + rng.choice(["", "", "s", "É"]) for _ in range(60)) + rng.choice(["", " Übergröße × ÷ naïveté"])) for k in range(150)]
    got = variants(sp.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == variants_by_hand(noted_by_hand(rows)) and sum(x[3] > 0 for x in got.values()) > 100 and any(x[0] for x in got.values())


@pytest.mark.parametrize("wide", [2, 64])
def test_near_words_of_dense_groups(spark, monkeypatch, wide):
    """Hundreds of words share each half, runs of one letter included: groups part again, nothing is lost or twice there."""
    monkeypatch.setattr(sp, "WIDE", wide)
    words = {"aaaa" + "".join(x) for n in (2, 3, 4, 5) for x in itertools.product("abc", repeat=n)} | {"a" * k for k in range(5, 40)} | {"b" * k + "aaaa" for k in range(1, 9)}
    table = spark.createDataFrame([(w, 3 + len(w) % 4) for w in sorted(words)], "word string, n long")
    found = sp.near_words(table, Scratch(spark, "test"))
    got = sorted((r.word, r.near) for r in found.collect())
    assert got == sorted((a, b) for a in words for b in words if near_by_hand(a, b))


def test_chain_of_forms(spark):
    counts = {"b" * k + "a" * (8 - k): 3 * 2**k for k in range(9)}
    rows = [(None, " ".join([w] * n)) for w, n in counts.items()]
    got = variants(sp.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=1 << 40))
    assert got == variants_by_hand(counts) and {x[1] for x in got.values()} == {"b" * 8}


def test_variants_of_odd_tables(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = variants_by_hand(noted_by_hand(rows))
    assert variants(sp.spelling_variants(docs)) == want and "shout" in want
    assert sp.spelling_variants(docs.where("false")).count() == 0
    long = spark.createDataFrame([(k, "q" * 50000 + " " + "q" * 50001 + " ok") for k in range(3)], "doc_id long, text string")
    assert variants(sp.spelling_variants(long, noise=1 << 40)) == {"q" * n: (None, "q" * n, 3, 1, None) for n in (50000, 50001)}
    assert sp.spelling_variants(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0
