"""Benchmark passages in documents: a set join by each window's rarest shingle, verified word by word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .names import free
from .scratch import Scratch

WINDOW, SHINGLE = 10, 5
#: A filter of hashes has up to 2 ** SKETCH_BITS bits (8 MB), whatever the number of items.
SKETCH_BITS, SPARE = 26, 32
#: Bytes of text that are hashed at once.
RUN = 1 << 20

#: Bytes of words as they count (A-Z become a-z), and 0 for bytes between words.
_BYTES = np.zeros(256, np.uint8)
for _b in [*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]:
    _BYTES[_b] = _b
_BYTES[65:91] = _BYTES[97:123]

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
#: Powers of P and its inverse modulo 2 ** 64, for RUN bytes; longer runs make their own.
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        if size > max(2 * RUN, 1 << 16):  # one very long word; its powers are not kept
            return np.multiply.accumulate(out)
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words_of_run(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of each word in low, which begins and ends between words."""
    edge = np.flatnonzero(np.diff((low != 0).astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low * _powers(_P, len(low)), out=sums[1:])
    return starts, ends, _mixed((sums[ends] - sums[starts]) * _powers(_P_INVERSE, len(low) + 1)[starts])


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, first byte, end, hash): the bytes as they count and the words of one text or of joined texts.

    Bytes are read in runs of about RUN that end between words, so that a long text needs memory for
    its words alone.
    """
    low, found, at = _BYTES[np.frombuffer(data, np.uint8)], [], 0
    while at < len(low):
        to = min(len(low), at + RUN)
        while to < len(low) and low[to]:  # on to the end of a word
            gap = np.flatnonzero(low[to : to + RUN] == 0)
            to += int(gap[0]) if len(gap) else min(RUN, len(low) - to)
        starts, ends, h = _words_of_run(low[at:to])
        found.append((starts + at, ends + at, h))
        at = to
    if not found:
        return low, *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64)
    return low, *(np.concatenate(x) for x in zip(*found))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * np.uint64(_P) + h[k : len(h) - size + 1 + k])
    return out


def _said(low: np.ndarray, start: int, end: int) -> str:
    """The words of these bytes, joined by one space."""
    return b" ".join(x for x in low[start:end].tobytes().split(b"\0") if x).decode()


def item_windows(items: DataFrame, key: str, text: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, window, w, tokens): each item's distinct windows, as text, with the hash of every shingle in place."""
    kind = "item string, window string, w int, tokens array<long>"

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, starts, ends, h = words(data or b"")
                w = min(window, len(h))
                tokens = shingles(h, min(shingle, w)).view(np.int64) if w else h
                seen = {}
                for at in range(len(h) - w + 1 if w else 0):
                    seen.setdefault(_said(low, starts[at], ends[at + w - 1]), at)
                out += [(item, said, w, tokens[at : at + w - min(shingle, w) + 1].tolist()) for said, at in seen.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "window", "w", "tokens"), x)) for x in out], pa.schema([("item", pa.string()), ("window", pa.string()), ("w", pa.int32()), ("tokens", pa.list_(pa.int64()))]))

    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, kind)


def sketch(tokens: DataFrame) -> np.ndarray:
    """A filter over tokens(token): words of bits, of which the driver gets at most 2 ** (SKETCH_BITS - 6)."""
    bits = min(max(12, (tokens.count() * SPARE).bit_length()), SKETCH_BITS)
    place = F.shiftrightunsigned("token", 64 - bits)
    set_ = tokens.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - bits}) & 63 as int))")).alias("mask"))
    found = set_.toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def _in_sketch(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - 6 - int(len(bits)).bit_length() + 1)
    return np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))


def _runs(batch: pa.RecordBatch):
    """(first row, texts) of runs of documents of about RUN bytes."""
    at, size, run = 0, 0, []
    for k, data in enumerate(batch.column("text")):
        run.append(data.as_py() or b"")
        size += len(run[-1])
        if size >= RUN:
            yield at, run
            at, size, run = k + 1, 0, []
    if run:
        yield at, run


def _read(texts: list[bytes], sizes: list[int], bits: np.ndarray):
    """low, starts, ends, word counts of the texts, the first word of each, and (word, hash) of shingles that the filter lets pass."""
    low, starts, ends, h = words(b" ".join(texts))
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, borders)
    last = np.repeat(first[1:], np.diff(first))  # of each word, the end of its text
    hits = []
    for size in sizes:
        tokens = shingles(h, size)
        at = _in_sketch(tokens, bits)
        at = at[at + size <= last[at]]
        hits.append((size, at, tokens[at]))
    return low, starts, ends, first, hits


def rarity(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """(token, n): how often docs(text) hold each shingle that the filter lets pass."""

    def run(batches):
        for batch in batches:
            for _, texts in _runs(batch):
                found = [t for _, _, t in _read(texts, sizes, bits)[-1]]
                token, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


_MATCH = pa.struct([("token", pa.int64()), ("at", pa.list_(pa.int32())), ("before", pa.int32()), ("said", pa.string())])
_MATCHES = "array<struct<token: long, at: array<int>, before: int, said: string>>"


def matches(docs: DataFrame, sizes: list[int], bits: np.ndarray, window: int) -> DataFrame:
    """docs(key, text_hash, text) as (key, text_hash, n_words, matches), a row for each.

    A match: a shingle that the filter lets pass, with the words around it that a window could
    cover, the number of words before it among those, and all places in the text where they stand.
    """

    def found(texts):
        low, starts, ends, first, hits = _read(texts, sizes, bits)
        per = [{} for _ in texts]
        of = np.repeat(np.arange(len(texts)), np.diff(first))
        for size, at, tokens in hits:
            reach = window - size if size == max(sizes) else 0  # a shorter shingle is a whole window
            for i, token in zip(at.tolist(), tokens.view(np.int64).tolist()):
                d = of[i]
                a, b = max(first[d], i - reach), min(first[d + 1], i + size + reach)
                said = _said(low, starts[a], ends[b - 1])
                per[d].setdefault((token, int(i - a), said), []).append(int(i - first[d]))
        return np.diff(first), [[{"token": t, "at": at, "before": b, "said": s} for (t, b, s), at in x.items()] for x in per]

    def run(batches):
        for batch in batches:
            for at, texts in _runs(batch):
                n, got = found(texts)
                own = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("text_hash"), pa.array(n, pa.int32()), pa.array(got, pa.list_(_MATCH))], names=["key", "text_hash", "n_words", "matches"])

    kind = T.StructType([docs.schema["key"], docs.schema["text_hash"], T.StructField("n_words", T.IntegerType()), T.StructField("matches", T.DataType.fromDDL(_MATCHES))])
    return docs.mapInArrow(run, kind)


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, w, token, offset): of each window that may occur, its rarest shingle and the words before it.

    All shingles of a window must occur, so the prefix that any match must share is one shingle; the
    rarest makes the fewest candidates. A window with a shingle that no document holds is left out.
    """
    each = windows.select("window", "w", F.posexplode("tokens").alias("offset", "token"))
    ranked = each.join(counts, "token", "left").groupBy("window", "w")
    least = ranked.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("least"))
    return least.where("least.n > 0").select("window", "w", "least.token", "least.offset")


def _verified(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text_hash, window, w, start): where windows occur, by their words."""
    each = found.select("key", "text_hash", F.explode("matches").alias("m")).select("key", "text_hash", "m.*")
    met = each.join(wanted, "token")
    begin = F.col("before") - F.col("offset")  # of the window, among the words around the shingle
    own = F.slice(F.split("said", " "), F.greatest(begin, F.lit(0)) + 1, F.col("w"))
    exact = met.where(begin >= 0).where(F.array_join(own, " ") == F.col("window"))  # too few words after it differ as well
    return exact.select("key", "text_hash", "window", "w", F.explode("at").alias("place"), "offset").select("key", "text_hash", "window", "w", (F.col("place") - F.col("offset")).alias("start"))


def _spans(places: DataFrame) -> DataFrame:
    """(key, text_hash, spans): the words that windows cover, as a document's own disjoint ranges."""
    ends = places.groupBy("key", "text_hash", "start").agg((F.col("start") + F.max("w")).alias("end"))
    row = Window.partitionBy("key", "text_hash").orderBy("start")
    before = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    opens = ends.withColumn("opens", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    runs = opens.withColumn("run", F.sum("opens").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("key", "text_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("key", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def contamination(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(key, text_hash, n_words, spans, items): for every row of df, where windows of items stand in it.

    Words are runs of 0-9, A-Z as a-z, a-z and all characters from U+0080 on. An item's windows are
    all its runs of `window` words, or the whole of a shorter item. spans: disjoint ranges of words
    (from, to) that occurrences of windows cover, in order. items: the ids of items with a window in
    the row, as sorted strings. text_hash (XXH64) tells rows that repeat a key apart.

    Windows and documents meet by the window's rarest shingle of words, at the one place that the
    shingle has in the window; there the words are compared. A filter of at most 8 MB keeps other
    shingles from being moved, so documents move only what may match.

    Null and empty texts have no words; an item without words is in no document. Rows with a null
    key are kept and rows that repeat a key are read each by itself. Items with a null id are left
    out; rows that repeat an id are one item with the windows of all. Long texts are read whole. An
    empty table gives no rows; without items no row has spans. Other columns, whatever their names,
    are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "decontamination")
    docs = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))
    of_items = scratch.save(item_windows(items, item_key, item_text, window, shingle), "windows")
    windows = of_items.dropDuplicates(["window"])
    tokens = windows.select(F.explode("tokens").alias("token")).distinct()
    sizes = sorted(r[0] for r in windows.select(F.least("w", F.lit(shingle)).alias("s")).distinct().collect())  # at most `shingle`
    counts = scratch.save(rarity(docs, sizes or [shingle], sketch(tokens)), "rarity")
    wanted = scratch.save(prefixes(windows, counts), "prefixes")
    found = scratch.save(matches(docs, sizes or [shingle], sketch(wanted.select("token").distinct()), window), "matches")
    places = scratch.save(_verified(found, wanted), "places")
    id_ = ["key", "text_hash"]
    spans = _spans(places)
    named = places.select(*id_, "window").distinct().join(of_items.select("window", "item"), "window").select(*id_, "item").distinct()
    named = named.groupBy(*id_).agg(F.array_sort(F.collect_list("item")).alias("items"))  # no more than there are items
    got = spans.join(named, (spans["key"].eqNullSafe(named["key"])) & (spans["text_hash"] == named["text_hash"])).select(spans["key"].alias("_k"), spans["text_hash"].alias("_h"), "spans", "items")
    out = found.join(got.distinct(), F.col("key").eqNullSafe(F.col("_k")) & (F.col("text_hash") == F.col("_h")), "left")
    none = lambda c: F.coalesce(c, F.array().cast(got.schema[c].dataType))
    return out.select(F.col("key").alias(key), "text_hash", "n_words", none("spans").alias("spans"), none("items").alias("items"))


def hit_words(spans: Column) -> Column:
    """How many words the spans of contamination() cover."""
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df without the rows that hold a window of an item; nulls, repeats and other columns as in contamination().

    All columns stay, whatever their names.
    """
    k, h = free(df, "key", "hash")
    hit = contamination(df, items, key, text, **how).where(F.size("spans") > 0).select(F.col(key).alias(k), F.col("text_hash").alias(h)).distinct()
    return df.join(hit, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h)), "left_anti")
