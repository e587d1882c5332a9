"""How filters interact: what each removes in every order of application, by windows over mask cells."""

from __future__ import annotations

import itertools
import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

#: The filters in the order of their bits.
LETTERS = "ABCDE"
#: What parts words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without BLANKS."""
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "")


def own_mask(text: Column, words: Column) -> Column:
    """Bits of the failures that a text shows by itself: A few words, B repetitive, C capitals, D symbols."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    failures = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(fails, 1 << bit).otherwise(0) for bit, fails in enumerate(failures)), F.lit(0))


def _document_cells(df: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(digest, part, mask, good, toxic, first, n_first, n): documents of equal text, part and labels."""
    whole = df.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    read = whole.select("key", "part", "text", words_of(F.col("text")).alias("words"))
    narrow = read.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_mask(F.col("text"), F.col("words")).alias("mask"))
    marks = labels.groupBy(F.col(key).alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    marked = narrow.join(marks, "key", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    kind = ["digest", "part", "mask", "good", "toxic"]
    ids = marked.groupBy("key", *kind).agg(F.count("*").alias("n"))  # rows that repeat a key are counted together
    first = F.struct(F.col("key").isNull().alias("last"), "key", "n")  # a null key counts as larger than any
    return ids.groupBy(*kind).agg(F.min(first).alias("first"), F.sum("n").alias("n")).select(*kind, "first.last", "first.key", F.col("first.n").alias("n_first"), "n")


def mask_cells(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of mask's bits.

    Texts are known by SHA-256. A document fails E if a smaller key has its text, in any part; copies
    are counted where they stand and only counts meet, so a group of copies moves a row for each of
    its parts and labels.
    """
    scratch = Scratch(df.sparkSession, "audit")
    rows = scratch.save(_document_cells(df, labels, key, text, part), "texts")
    least = rows.groupBy("digest").agg(F.min(F.struct("last", "key")).alias("least"))
    kept = F.when(F.struct("last", "key").eqNullSafe(F.col("least")), F.col("n_first")).otherwise(F.lit(0).cast("long"))
    bit = 1 << LETTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("kept")).alias("n"))))
    both = rows.join(least, "digest").withColumn("kept", kept).select("part", "good", "toxic", split.alias("cell")).select("part", "good", "toxic", "cell.*").where("n > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    cells(part, mask, n, good, toxic): at most 2 ** len(letters) rows a part. Each is unpivoted
    against the steps of all orders; a running bit-or over the earlier steps tells what an earlier
    filter has removed. Every part has a row for every order and step.
    """
    orders = F.array(*map(F.lit, map("".join, itertools.permutations(letters))))
    long = cells.select("*", F.explode(orders).alias("filter_order"))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter")).where("letter <> ''")
    bits = F.create_map(*(F.lit(x) for k, c in enumerate(letters) for x in (c, 1 << k)))
    long = long.withColumns({"step": (F.col("place") + 1).cast("int"), "bit": bits[F.col("letter")]})
    long = long.withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)) != 0)
    fails, earlier = F.col("failed") != 0, F.col("earlier")
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    steps = long.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit_filters(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """interactions() of the filters A to E over whole texts, one block of rows for each part.

    A: under 200 words. B: 100 times the distinct words are under 50 times the words. C: 100 times
    the letters A-Z exceed twice the code points. D: a symbol of #$%&*|. E: a smaller key has the
    same text, anywhere in the table. Words are runs of anything but U+0020 and U+0009 to U+000D,
    letter case kept. good and toxic come from labels(key, quality, toxic).

    Null texts are empty, and an empty text fails A, and E where another is empty too. A null part
    is the empty string. Rows that repeat a key are documents of their own, none a copy of the
    other by E unless a smaller key has the text; a null key counts as larger than any other and has
    no labels. Where labels repeat a key, any row that says so counts. Long texts are read whole. An
    empty table gives no rows, an empty labels table no losses. Other columns, whatever their names,
    are ignored.
    """
    return interactions(mask_cells(df, labels, key, text, part))
