"""Spelling variants of words: a join of words one edit apart by equal halves, and the forms they lead to."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

LETTERS = "[A-Za-zÀ-ÿ]+"
#: Words that share a segment are compared with each other up to so many of the shorter length; larger groups part further.
WIDE = 64


def noted_words(df: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, noise: int = 97) -> DataFrame:
    """(word, n): the words of all texts with their number of occurrences.

    A word is a run of LETTERS with A-Z as a-z. Where `noise` divides the CRC-32 of `key:word`, the
    code point at that number modulo the length is left out, which plants misspellings.
    """
    run = F.explode(F.regexp_extract_all(text, F.lit(LETTERS), 0)).alias("run")
    runs = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), run)
    lower = runs.select("key", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("word"))
    marked = lower.withColumn("h", F.crc32(F.concat_ws(":", "key", "word").cast("binary")))
    at = F.expr("cast(h % length(word) as int)")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    words = marked.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halves(rest: Column, short: Column, path: Column) -> Column:
    """The two entries of a word under segments of half its rest: (path, rest) by its equal start, then by its equal end.

    short: the rest's length in words of the shorter of the two lengths that meet; a longer word's
    rest is one longer, so that its end stands one place further on.
    """
    first, n = F.floor(short / 2).cast("int"), F.length(rest)
    last = short - first
    start = F.struct(F.concat_ws("\0", path, F.lit("1"), F.substring(rest, F.lit(1), first)).alias("path"), F.substring(rest, first + 1, n).alias("rest"))
    end = F.struct(F.concat_ws("\0", path, F.lit("2"), F.substring(rest, n - last + 1, last)).alias("path"), F.substring(rest, F.lit(1), n - last).alias("rest"))
    return F.array(start, end)


def entries(words: DataFrame, least_length: int = 5) -> DataFrame:
    """(path, rest, longer, word, n): each word under two segments of its own length and two of one less."""
    roles = F.array(F.struct(F.lit(False).alias("longer"), F.length("word").alias("short")), F.struct(F.lit(True).alias("longer"), (F.length("word") - 1).alias("short")))
    each = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*").where(F.col("short") >= least_length)
    return _parted(each.withColumns({"path": F.col("short").cast("string"), "rest": F.col("word")}))


def _parted(each: DataFrame) -> DataFrame:
    short = F.length("rest") - F.col("longer").cast("int")
    halves = each.select("word", "n", "longer", F.explode(_halves(F.col("rest"), short, F.col("path"))).alias("e"))
    return halves.select("e.path", "e.rest", "longer", "word", "n")


def near_words(words: DataFrame, scratch: Scratch, least_length: int = 5) -> DataFrame:
    """(word, n, near, near_n): words(word, n) with each word that is exactly one edit away, both ways.

    Of two words one edit apart, one half of the shorter stands whole in the other, at its start or at
    its end. Groups of over WIDE words that share a half are parted again by halves of what is left,
    which must hold the same, until groups are small or only one character is left; those are bounded
    by the alphabet. So no group emits its square, and no pair is lost.
    """
    found, level = None, scratch.save(entries(words, least_length), "entries")
    while True:
        sizes = level.groupBy("path").agg(F.count_if(~F.col("longer")).alias("shorts"), F.count("*").alias("size")).where("shorts > 0 and size > 1")
        # `can` is alike in a group: what is left has the same length in all its words of one length
        sized = level.join(sizes, "path").withColumn("wide", (F.col("shorts") > WIDE) & (F.length("rest") - F.col("longer").cast("int") > 1))
        sized = scratch.save(sized.drop("shorts", "size"), "groups")
        small = sized.where("not wide").drop("wide")
        one = small.where("not longer").select("path", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"))
        two = small.select("path", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"), "longer")
        pairs = one.join(two, "path").where("longer or a < b").where(F.levenshtein("a_rest", "b_rest", 1) == 1)
        pairs = scratch.save(pairs.select("a", "a_n", "b", "b_n"), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        wide = sized.where("wide")
        if wide.isEmpty():
            break
        level = scratch.save(_parted(wide), "entries")
    both = F.array(*(F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")))
    links = found.select(F.explode(both).alias("l")).select("l.*")
    return links.repartition("word").distinct()  # a pair may share both halves


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of forms(word, form): what following forms ends at, in doubling steps.

    A form has at least twice its word's occurrences, so there are no cycles and chains are at most
    as long as the logarithm of the largest count.
    """
    roots = scratch.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.save(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(roots)
        roots = moved.select("word", "root")
        roots.scratch_path = moved.scratch_path
        if moved.where("moved").isEmpty():
            return roots


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, noise: int = 97) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of noted_words() with its more usual spelling.

    Two words are near if one inserted, deleted or replaced code point makes them equal. form: the
    near word with the most occurrences, ties to the first by code point, if it has at least twice
    the word's own; else null, as form_n. root: what following forms ends at, the word itself
    without one.

    Null and empty texts have no words; long texts and long words are read whole. A null key is an
    empty one. Rows that repeat count again. An empty table gives no rows. Other columns, whatever
    their names, are ignored.
    """
    scratch = Scratch(df.sparkSession, "spelling")
    words = scratch.save(noted_words(df, key, text, least_length, least_count, noise), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(words, scratch, least_length).groupBy("word").agg(F.count("*").alias("n_near"), best)
    usual = F.col("best.less") * -1 >= 2 * F.col("n")
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n"))
    told = scratch.save(told, "forms")
    roots = _roots(told.where("form is not null"), scratch)
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
