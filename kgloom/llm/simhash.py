"""SimHash near-duplicates: 64-bit fingerprints, pigeonring candidates, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .components import connected_components
from .names import free
from .scratch import Scratch

BITS, DISTANCE = 64, 4
#: DISTANCE + 1 segments of a ring, from the lowest bit on.
SEGMENTS = (13, 13, 13, 13, 12)
SEED = 42
#: Keys with more fingerprints are compared in pairs of blocks of about so many.
BLOCK = 2048
#: Hashes that are counted at once.
RUN = 1 << 16


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The unsigned fingerprint of one text.

    A-Z become a-z; words are runs of bytes other than 0x20 and 0x09-0x0D; every run of `words`
    words, repeats included, is joined by one space and hashed by XXH64. A bit is set if it is set
    in over half of the hashes. Fewer words are one shingle; no words (also None) give 0.
    """
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = ends - [len(w) for w in found]
    n = max(1, len(found) - words + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, RUN):
        to = min(n, at + RUN)
        lasts = ends[at + words - 1 : to + words - 1] if n > 1 or len(found) == words else ends[-1:]
        spans = zip(starts[at:to].tolist(), lasts.tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, text_hash, fp): the fingerprint of every row as a signed long. No exchange."""
    schema = T.StructType([df.schema[key], T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType(), False)])

    def run(batches):
        for batch in batches:
            raw = batch.column(2).cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in raw), dtype="<u8", count=len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view("<i8"))], names=schema.names)

    return df.select(F.col(key), F.xxhash64(text), F.col(text).cast("string")).mapInArrow(run, schema)


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp): for each segment, its bits with either half of the next segment's bits.

    Linked fingerprints have a segment that is equal and whose next one differs in one bit at
    most, so that one half of the next is equal too.
    """
    keys, at = [], [sum(SEGMENTS[:k]) for k in range(len(SEGMENTS))]
    for k, bits in enumerate(SEGMENTS):
        n = (k + 1) % len(SEGMENTS)
        low = SEGMENTS[n] // 2
        own = f"(shiftrightunsigned(fp, {at[k]}) & {(1 << bits) - 1}L)"
        for half, (off, width) in enumerate(((at[n], low), (at[n] + low, SEGMENTS[n] - low))):
            part = f"(shiftrightunsigned(fp, {off}) & {(1 << width) - 1}L)"
            keys.append(f"{(2 * k + half) << 40}L | shiftleft({own}, 16) | {part}")
    return fps.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))


def _chain_masks() -> np.ndarray:
    """For each segment, the bits of the chains of 2, 3, ... segments that begin there."""
    at = [sum(SEGMENTS[:k]) for k in range(len(SEGMENTS))]
    of = [((1 << b) - 1) << a for a, b in zip(at, SEGMENTS)]
    m = len(SEGMENTS)
    return np.array(
        [[sum(of[(k + x) % m] for x in range(n)) for n in range(2, m + 1)] for k in range(m)], dtype=np.uint64
    )


def _linked(a: np.ndarray, b: np.ndarray, segment: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Positions at which a and b are linked, by chains from the given segments.

    Each longer chain may hold its proportional share of the differences and no more; only pairs
    that stay within every share reach the count over all bits, which is the last chain.
    """
    at = np.arange(len(a))
    x, m = a ^ b, len(SEGMENTS)
    for n in range(masks.shape[1]):
        ok = np.bitwise_count(x & masks[segment, n]) <= (n + 2) * DISTANCE // m
        at, x, segment = at[ok], x[ok], segment[ok]
    return at


def _forest(fps: np.ndarray, segment: int, masks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among fps, fewer than there are fps."""
    left, out = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = _linked(np.broadcast_to(fps[k], len(left)), fps[left], np.full(len(left), segment), masks)
            if len(near):
                got = left[near]
                out.append((np.full(len(got), fps[k]), fps[got]))
                queue += got.tolist()
                left = np.delete(left, near)
    return out


def _links_of(key: np.ndarray, pair: np.ndarray, fp: np.ndarray, masks: np.ndarray):
    """Links within each run of equal (key, pair)."""
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
    size = np.diff(np.r_[new, len(key)])
    fps, segment = fp.view(np.uint64), (key >> 41).astype(np.int64)
    out = []
    small = np.repeat(size <= 32, size)
    run = np.repeat(np.arange(len(new)), size)
    for lag in range(1, 32):
        if len(key) <= lag:
            break
        i = np.flatnonzero((run[lag:] == run[:-lag]) & small[lag:])
        if not len(i):
            break
        i = i[_linked(fps[i], fps[i + lag], segment[i], masks)]
        out.append((fps[i], fps[i + lag]))
    for at, n in zip(new[size > 32], size[size > 32]):
        out += _forest(fps[at : at + n], int(segment[at]), masks)
    return out


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect what is connected among distinct fingerprints fps(fp).

    Fingerprints meet under a key of _keys(). Keys with over BLOCK fingerprints are dealt out as
    pairs of blocks, so no task holds a whole hot key, and no group emits all of its pairs.
    """
    keys = _keys(fps)
    hot = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    dealt = (
        keys.join(hot, "key", "left")
        .withColumn("nb", F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp", "key"), "nb").cast("int"))
        .select("key", "fp", "own", "nb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
        .select("key", "fp", (F.least("own", "other") * F.col("nb") + F.greatest("own", "other")).alias("pair"))
    )
    masks = _chain_masks()

    def run(batches):
        kept = [np.zeros(0, np.int64)] * 3

        def found(cols):
            pairs = _links_of(*cols, masks) if len(cols[0]) > 1 else []
            for a, b in pairs:
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)], names=["a", "b"]
                    )

        for batch in batches:
            cols = [np.concatenate([k, batch.column(n).to_numpy()]) for n, k in enumerate(kept)]
            # the last run may go on in the next batch
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) if len(cols[0]) else np.zeros(0, bool)
            cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            yield from found([c[:cut] for c in cols])
            kept = [c[cut:] for c in cols]
        yield from found(kept)

    return (
        dealt.select("key", F.col("pair").cast("long").alias("pair"), "fp")
        .repartition("key", "pair")
        .sortWithinPartitions("key", "pair")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, text_hash, fp, component_id): near-duplicate groups of whole texts.

    Two rows are linked if their fingerprints differ in at most 4 of 64 bits; component_id is the
    smallest key that links reach, the row's own included. Equal fingerprints are one node, so
    groups of copies cost nothing. Null and empty texts have fingerprint 0 and are linked like any
    other. Rows with a null key belong to groups but never name one (a group of only such rows has
    a null id). Repeated rows stay and share a group. Other columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    rows = scratch.save(fingerprints(df, key, text, words), "fingerprints")
    classes = scratch.save(rows.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    linked = connected_components(links(classes.select("fp")), scratch)
    of = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    ids = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of.join(ids, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(key, "text_hash", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """df with the row that names each of the groups of simhash_groups() alone.

    Rows that repeat that row's key and text are the same document and stay with it. A row with a
    null key stays only if all of its group have none. Null and empty texts are one group, long
    texts are read whole, all columns stay, whatever their names; an empty table stays empty.
    """
    k, h = free(df, "key", "hash")
    stay = simhash_groups(df, key, text, words).where(F.col(key).eqNullSafe(F.col("component_id")))
    stay = stay.select(F.col(key).alias(k), F.col("text_hash").alias(h)).distinct()
    return df.join(stay, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h)), "left_semi")
