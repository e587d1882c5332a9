"""Fuzzy line dedup: MinHash bands, exact Jaccard, components. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .names import free
from .scratch import Scratch

#: White space that is cut off a line's ends.
BLANK = " \t\r\x0b\x0c"
#: A line's shingles are all its windows of WIDTH characters, by 64-bit hash; a shorter line is one itself.
WIDTH = 8
#: A signature has the least shingle hash of each of BINS bins; a band is ROWS bins in turn.
BINS, ROWS = 24, 3
#: A long line's minima are sought among about so many of its least hashes for each bin.
KEEP = 3
SIMILARITY = 0.8
#: A sketch has WORDS words of 64 bits; each of a line's shingles turns one bit over.
WORDS = 16
#: Lines of a band that are still to be compared meet in pairs of blocks of about so many.
BLOCK = 64
#: Lines up to so many characters stand in the blocks as text; pairs with a longer one fetch both texts.
CARRIED = 1 << 14
#: The set of candidate lines that goes to every task has up to 2**SKETCH_BITS bits (2 MB), about
#: SPARE for each candidate; if there are more candidates, all lines are exchanged instead.
SKETCH_BITS, SPARE = 24, 8


def _starts(u: Column) -> Column:
    """Where the shingles of a line begin; u is the line in UTF-32, 4 bytes a character."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(u) - (4 * WIDTH - 1), F.lit(1)), F.lit(4))


def _window(u: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(u, at, F.lit(4 * WIDTH)))


def _all_shingles(line: Column) -> Column:
    """The shingles of a line, repeats included, by 64-bit hash."""
    return F.transform(F.array(F.encode(line, "UTF-32")), lambda u: F.transform(_starts(u), lambda at: _window(u, at)))[0]


def minima(lines: DataFrame) -> DataFrame:
    """(h, m0, m1, ...) of each distinct line of lines(h, line): the least shingle hash of each bin, or null.

    Of a line with very many shingles only hashes up to a bound are looked at, chosen by their
    number so that about KEEP are left for a bin; an empty bin is filled from the next by bands().
    """
    n = F.size("starts")
    most = F.when(n <= BINS * KEEP, F.lit((1 << 63) - 1)).otherwise((F.lit(float(BINS * KEEP)) / n * 2.0**64 - 2.0**63).cast("long"))
    u = lines.select("h", F.encode("line", "UTF-32").alias("u"))
    u = u.select("h", "u", _starts(F.col("u")).alias("starts")).select("h", "u", "starts", most.alias("most"))
    each = u.select("h", "u", "most", F.explode_outer("starts").alias("at"))  # never empty; a plain explode would make them twice to see that
    low = each.select("h", "most", _window(F.col("u"), F.col("at")).alias("x")).where("x <= most")
    low = low.select("h", "x", F.pmod("x", F.lit(BINS)).cast("int").alias("bin"))
    return low.groupBy("h").agg(*(F.min(F.when(F.col("bin") == j, F.col("x"))).alias(f"m{j}") for j in range(BINS)))


def filled(signatures: DataFrame) -> DataFrame:
    """signatures(h, m0, m1, ...) where an empty bin takes the value of the next that is not."""
    step = 1
    while step < BINS:  # after it each bin has looked at 2 * step bins, itself included
        signatures = signatures.select("h", *(F.coalesce(f"m{j}", f"m{(j + step) % BINS}").alias(f"m{j}") for j in range(BINS)))
        step *= 2
    return signatures


def bands(signatures: DataFrame) -> DataFrame:
    """(h, b): the distinct bands of signatures(h, m0, m1, ...)."""
    values = [F.xxhash64(*(f"m{k}" for k in range(j, j + ROWS))) for j in range(0, BINS, ROWS)]
    return filled(signatures).select("h", F.explode(F.array_distinct(F.array(*values))).alias("b"))


def sketches(texts: DataFrame) -> DataFrame:
    """(h, sketch) of texts(h, line); sketch: n, how many shingles the line has, and s0, s1, ..., the parities of 64 * WORDS classes of them."""
    all_of = texts.select("h", F.array_distinct(_all_shingles(F.col("line"))).alias("all"))
    each = all_of.select("h", F.explode_outer("all").alias("x"))
    each = each.select("h", F.shiftright("x", 6).bitwiseAND(F.lit(WORDS - 1)).alias("word"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit"))
    words = (F.bit_xor(F.when(F.col("word") == j, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"s{j}") for j in range(WORDS))
    counted = each.groupBy("h").agg(F.count("*").cast("int").alias("n"), *words)
    return counted.select("h", F.struct("n", *(f"s{j}" for j in range(WORDS))).alias("sketch"))


def _possible(p: Column, q: Column) -> Column:
    """Whether the sketches p, q of two lines allow that these are similar; no similar pair is refused.

    Each bit that differs takes a shingle that one line alone has, so the lines differ at as many
    shingles at least. Of a and b shingles similar lines differ at (a + b) * (1 - SIMILARITY) / (1 + SIMILARITY) at most.
    """
    differ = sum((F.bit_count(p[f"s{j}"].bitwiseXOR(q[f"s{j}"])) for j in range(1, WORDS)), F.bit_count(p["s0"].bitwiseXOR(q["s0"])))
    near_sizes = F.least(p["n"], q["n"]) >= SIMILARITY * F.greatest(p["n"], q["n"])
    return F.when(near_sizes, differ * (1 + SIMILARITY) <= (p["n"] + q["n"]) * (1 - SIMILARITY) + 0.5).otherwise(False)  # 0.5: for rounding


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_hash, line_no, line): the lines of every text that are not blank, without blank ends."""
    return (
        df.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.posexplode_outer(F.split(F.col(text), "\n")).alias("line_no", "line"))
        .withColumn("line", F.btrim("line", F.lit(BLANK)))
        .where("line <> ''")
    )


def _shared_bands(lines: DataFrame) -> DataFrame:
    """(h, b, lo, hi, n): lines that share a band with others, the band's lowest and highest line, and size."""
    banded = bands(minima(lines)).repartition("b")
    ends = banded.groupBy("b").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    return banded.join(ends.hint("shuffle_hash"), "b").select("h", "b", "lo", "hi", "n")


def _seen(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """lines(key, text_hash, line_no, h, line) of which only candidates, and few others, keep their text."""
    n = shared.count()
    bits = min(max(10, (n * SPARE).bit_length()), SKETCH_BITS)
    if n * SPARE > 1 << SKETCH_BITS:
        return lines
    word = lambda h: F.shiftright(F.pmod(h, F.lit(1 << bits)), 6)
    bit = lambda h: F.expr(f"shiftleft(1L, cast(pmod({h}, 64) as int))")
    sketch = shared.groupBy(word(F.col("h")).alias("word")).agg(F.bit_or(bit("h")).alias("mask"))
    likely = lines.withColumn("word", word(F.col("h"))).join(F.broadcast(sketch), "word", "left")  # 2**(bits - 6) rows at most
    return likely.withColumn("line", F.when(F.col("mask").bitwiseAND(bit("h")) != 0, F.col("line"))).select(lines.columns)


def _similar_pairs(pairs: DataFrame, texts: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs(a, b, ...) of lines whose exact Jaccard similarity is SIMILARITY at least; bits: their sketches."""

    def both(of: DataFrame, table: DataFrame, what: str) -> DataFrame:
        one, two = table.select(F.col("h").alias("a"), F.col(what).alias("_p")), table.select(F.col("h").alias("b"), F.col(what).alias("_q"))
        return of.join(one, "a").join(two, "b")

    p, q = F.col("_p"), F.col("_q")
    possible = both(pairs, bits, "sketch").where(_possible(p, q)).select(*pairs.columns, (p["n"] + q["n"]).alias("_n"))
    shared = F.size(F.array_intersect(_all_shingles(p), _all_shingles(q)))
    met = both(possible, texts, "line").select(*possible.columns, shared.alias("_shared"))
    similar = met.select(*pairs.columns, (F.col("_shared") >= SIMILARITY * (F.col("_n") - F.col("_shared"))).alias("_similar"))
    return similar.where("_similar").select(pairs.columns)


def _open_members(shared: DataFrame, of: DataFrame) -> DataFrame:
    """(b, h, c, rest) of bands whose lines are not all compared or connected; rest: not connected to the band's lowest."""
    wide = shared.where("n > 3").select("b", "h", "lo")
    low = of.select(F.col("h").alias("lo"), F.col("component").alias("main"))
    members = wide.join(of, "h", "left").join(low, "lo", "left")
    members = members.select("b", "h", F.coalesce("component", "h").alias("c"), F.coalesce("main", "lo").alias("main")).withColumn("rest", F.col("c") != F.col("main"))
    return members.join(members.where("rest").select("b").distinct(), "b", "left_semi").select("b", "h", "c", "rest")


def _merged(of: DataFrame, members: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """of(h, component) after joining the components more(a, b)."""
    joined = connected_components(more, scratch).select(F.col("node").alias("c"), F.col("component").alias("top"))
    lines = of.unionByName(members.select("h", F.col("c").alias("component"))).distinct().select("h", F.col("component").alias("c"))
    return scratch.save(lines.join(joined, "c", "left").select("h", F.coalesce("top", "c").alias("component")), "components")


def _blocks(members: DataFrame, texts: DataFrame, bits: DataFrame, scratch: Scratch) -> DataFrame:
    """(b, rest, kind, k, x): the lines members(b, h, c, rest) of each band in blocks x of about BLOCK.

    kind is a lower band that all of a block's lines share, or b itself where there is none or too
    few lines share it: lines of one kind below b meet there and need not meet here.
    """
    own = members.groupBy("h").agg(F.array_sort(F.collect_list("b")).alias("bands"))  # as many as a line has bands
    dealt = members.join(own, "h").withColumn("low", F.get("bands", F.lit(0)))
    counts = dealt.groupBy("b", "rest", "low").agg(F.count("*").alias("n"))
    kind = F.when((F.col("low") < F.col("b")) & (F.col("n") >= BLOCK), F.col("low")).otherwise(F.col("b"))
    kinds = counts.withColumn("kind", kind)
    sizes = kinds.groupBy("b", "rest", "kind").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("nb"))
    dealt = dealt.join(kinds.drop("n").join(sizes, ["b", "rest", "kind"]), ["b", "rest", "low"])
    text = F.when(F.length("line") <= CARRIED, F.col("line")).alias("line")
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("h", F.lit(1)), "nb").cast("int")).join(bits, "h").join(texts.select("h", text), "h")
    blocks = dealt.groupBy("b", "rest", "kind", "k").agg(F.collect_list(F.struct("h", "c", "bands", "sketch", "line")).alias("x"))  # about BLOCK lines
    return scratch.save(blocks, "blocks")


def _block_links(members: DataFrame, texts: DataFrame, bits: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): components to join, by exact similarity among the lines members(b, h, c, rest) of each band.

    Two blocks of a band are one row, within which lines are compared, by sketches and then exactly:
    rows grow with the number of blocks, not of pairs, and only links leave a row (and possible pairs
    with a line too long to stand in a block, which are compared outside). Blocks of the component of a band's
    lowest line do not meet each other, nor do blocks of one kind below the band. Lines of one
    component are not compared, nor is a pair in other bands than the lowest that it shares: there
    it is compared as well.
    """
    blocks = _blocks(members, texts, bits, scratch)
    at = ["rest", "kind", "k"]
    one = blocks.select("b", F.struct(*at).alias("p"))
    pairs = one.join(one.withColumnRenamed("p", "q"), "b").where("p <= q and (p.rest or q.rest) and (p.kind <> q.kind or p.kind = b)")
    both = pairs.join(blocks.select("b", F.struct(*at).alias("p"), "x"), ["b", "p"]).join(blocks.select("b", F.struct(*at).alias("q"), F.col("x").alias("y")), ["b", "q"])

    def near(p, q):
        other = (p["c"] < q["c"]) | ((p["c"] > q["c"]) & F.col("apart"))  # within one block each pair once
        lowest = F.array_min(F.array_intersect(p["bands"], q["bands"])) == F.col("b")
        return F.when(other, F.when(_possible(p["sketch"], q["sketch"]), lowest).otherwise(False)).otherwise(False)

    def similar(p, q):
        shared = F.size(F.array_intersect(F.col("mine"), _all_shingles(q["line"])))
        exact = F.transform(F.array(shared), lambda n: n >= SIMILARITY * (p["sketch"]["n"] + q["sketch"]["n"] - n))[0]
        return F.when(p["line"].isNull() | q["line"].isNull(), True).otherwise(exact)

    one = F.col("one")
    each = both.select("b", "y", (F.col("p") != F.col("q")).alias("apart"), F.explode("x").alias("one"))
    each = each.select("one", F.filter("y", lambda q: near(one, q)).alias("y"))
    each = each.select("one", "y", F.when(F.size("y") > 0, _all_shingles(F.col("one.line"))).alias("mine"))
    links = F.transform(F.filter("y", lambda q: similar(one, q)), lambda q: F.struct(q["h"].alias("h"), q["c"].alias("c"), (q["line"].isNull() | F.col("one.line").isNull()).alias("open")))
    found = each.select("one.h", "one.c", F.explode_outer(links).alias("q")).where("q is not null")  # a plain explode would compare twice
    pairs = scratch.save(found.select(F.col("h").alias("a"), F.col("q.h").alias("b"), F.col("c").alias("p"), F.col("q.c").alias("q"), "q.open"), "pairs")
    scratch.drop(blocks)
    linked, long = pairs.where("not open").drop("open"), pairs.where("open").drop("open")
    if not long.isEmpty():
        linked = linked.unionByName(_similar_pairs(long, texts, bits))
    return linked.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()


def _components(shared: DataFrame, texts: DataFrame, bits: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, component) of the lines that are linked to another."""
    rep = F.explode(F.array("lo", "hi")).alias("rep")
    pairs = shared.select("h", rep).where("h <> rep").select(F.least("h", "rep").alias("a"), F.greatest("h", "rep").alias("b")).distinct()
    links = scratch.save(_similar_pairs(pairs, texts, bits), "links")
    of = scratch.save(connected_components(links, scratch).select(F.col("node").alias("h"), "component"), "components")
    members = scratch.save(_open_members(shared, of), "members")
    if members.isEmpty():
        return of
    more = scratch.save(_block_links(members, texts, bits, scratch), "links")
    return of if more.isEmpty() else _merged(of, members, more, scratch)


def _placed(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of line_components() with text_hash, which tells rows that repeat a key apart."""
    scratch = Scratch(df.sparkSession, "lines")
    lines = split_lines(df, key, text).withColumn("h", F.xxhash64("line"))
    shared = scratch.save(_shared_bands(lines.select("h", "line")), "bands")
    seen = scratch.save(_seen(lines, shared), "seen")
    texts = seen.where("line is not null").groupBy("h").agg(F.min("line").alias("line"))
    texts = scratch.save(texts.join(shared.select("h").distinct(), "h", "left_semi"), "texts")
    bits = scratch.save(sketches(texts), "sketches")
    of = _components(shared, texts, bits, scratch)
    for table in (shared, texts, bits):
        scratch.drop(table)
    rows = seen.select("key", "text_hash", "line_no", "h").join(of, "h", "left")
    rows = rows.select("key", "text_hash", "line_no", F.coalesce("component", "h").alias("component"))
    own = F.struct("key", "line_no", "text_hash")
    named = rows.groupBy("component").agg(F.min(own).alias("first"))
    return rows.join(named, "component").select(
        F.col("key").alias(key),
        "text_hash",
        "line_no",
        F.col("first.key").alias("component_doc"),
        F.col("first.line_no").alias("component_line"),
        F.col("first").eqNullSafe(own).alias("kept"),
    )


def line_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, component_doc, component_line, kept): every line that is not blank.

    Lines are split at line feeds and compared without blank ends, letter case kept. A line's
    shingles are all its windows of 8 characters; a shorter line is its own only shingle. Two lines
    are linked if the Jaccard similarity of their shingle sets is at least 0.8; equal lines are one
    node. A component is named by its first line, by key and line number, which alone is kept.

    Lines are candidates where one of 8 bands of 3 minima agrees: at similarity 0.8 a pair is missed
    with probability (1 - 0.8**3)**8, about 0.003, and less above. Every line of a band is verified
    against the band's lowest and highest; then those of different components are compared, in blocks. So a group of many near-equal lines emits few pairs a line. Before its exact comparison
    a pair of lines is held against sketches of their shingles, 128 bytes each, which give a lower bound of
    the number of shingles at which they differ; no pair of 0.8 or more that shares a band is lost there. Lines of
    over some 2,000 shingles fill a sketch, and more of their pairs are compared exactly. Lines and shingles are known by 64-bit hashes.

    Null and blank texts have no lines; very long lines are compared whole. A null key comes first
    in order. Of rows that repeat a key, those of equal texts are decided alike, others each by
    their own lines. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    return _placed(df, key, text).drop("text_hash")


def drop_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its texts reduced to the lines that line_components() keeps, and blank lines.

    Rows that had lines and keep none are dropped: each of their lines stands elsewhere. Rows with
    null or blank texts stay as they are. Rows that repeat key and text are decided alike, so all of
    them stay or go; rows with a null key and rows that share a key but not a text each by their own
    lines. All other columns stay, whatever their names. An empty table stays empty.
    """
    k, h, gone, left = free(df, "key", "hash", "gone", "left")
    dropped = (
        _placed(df, key, text)
        .where("not kept")
        .groupBy(F.col(key).alias(k), F.col("text_hash").alias(h))
        .agg(F.collect_set("line_no").alias(gone))  # one document's own lines
    )
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, n: ~F.array_contains(F.col(gone), n)), "\n")
    joined = df.join(dropped, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h)), "left")
    cut = joined.withColumn(left, F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept))
    cut = cut.where(F.col(gone).isNull() | (F.btrim(F.col(left), F.lit(BLANK + "\n")) != ""))
    return cut.select(*(F.col(left).alias(c) if c == text else F.col(c) for c in df.columns))
