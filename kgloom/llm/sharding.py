"""Shards of near-equal bytes by histogram sort."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .names import free
from .scratch import Scratch

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Candidate boundaries set in each open interval in each round.
PROBES = 32
#: A boundary is right within this share of a shard's bytes; a boundary that cuts no group of
#: equal texts is taken as soon as one is, any other only where none is.
TOLERANCE = 0.001
#: A shard's rows are dealt out in ranges of about so many bytes, between so many of them.
RANGE_BYTES, RANGES = 128 << 20, (8, 256)


def n_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _bytes_below(keys: DataFrame, probes: list[tuple[int, int]]) -> list[int]:
    """Exact bytes of the rows before each of the sorted probes.

    Each partition counts the bytes between neighbouring probes; at most one sum for each probe
    comes back, whatever the number of rows.
    """
    first = np.array([a for a, _ in probes], np.int64)
    second = np.array([b for _, b in probes], np.int64)

    def run(batches):
        sums = np.zeros(len(first) + 1, np.int64)
        for batch in batches:
            k1, k2, size = (batch.column(k).to_numpy() for k in range(3))
            gap, last = np.searchsorted(first, k1, "left"), np.searchsorted(first, k1, "right")
            for k in np.unique(gap[gap < last]):  # a probe's own first key: the second decides
                at = np.flatnonzero((gap == k) & (gap < last))
                end = last[at[0]]
                gap[at] = k + np.searchsorted(second[k:end], k2[at], "right")
            np.add.at(sums, gap, size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["gap", "bytes"])

    got = keys.select("k1", "k2", "size").mapInArrow(run, "gap long, bytes long").groupBy("gap").agg(F.sum("bytes"))
    sums = dict(map(tuple, got.collect()))
    out, total = [], 0
    for k in range(len(probes)):
        total += sums.get(k, 0)
        out.append(total)
    return out


def splitters(keys: DataFrame, n: int, every: int) -> tuple[list[tuple[int, int]], int]:
    """n - 1 boundaries (k1, k2) between n ranges of equal bytes, and the number of bytes.

    keys(k1, k2, size). Each open boundary has an interval that holds its target. A round sets
    probes in all open intervals, counts the exact bytes below them in one pass, and narrows every
    interval to the two probes around its target. `every` ranges make a shard, which the tolerance
    is a share of. Inside one value of k1 (equal texts) the search goes on over k2.
    """
    total, least, most = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.min("k2"), F.max("k2")).first()
    if not total:
        return [], 0
    near = TOLERANCE * total * every / n
    done: dict[int, tuple[int, int]] = {}
    open_ = {k: ((LOW, least), 0, (HIGH, most + 1 if most < HIGH else most), total) for k in range(1, n)}
    while open_:
        probes = set()
        for lo, _, hi, _ in open_.values():
            if hi[0] - lo[0] > 1:
                probes |= {(lo[0] + max(1, (hi[0] - lo[0]) * k // (PROBES + 1)), least) for k in range(1, PROBES + 1)}
            else:
                top = hi[1] if hi[0] == lo[0] else most + 1
                probes |= {(lo[0], lo[1] + max(1, (top - lo[1]) * k // (PROBES + 1))) for k in range(1, PROBES + 1)}
        order = sorted(p for p in probes if p[1] <= HIGH)
        below = _bytes_below(keys, order)
        for k, (lo, lo_bytes, hi, hi_bytes) in list(open_.items()):
            want = total * k / n
            a, z = bisect.bisect_right(order, lo), bisect.bisect_left(order, hi)
            inside = list(zip(below[a:z], order[a:z]))
            best = min(inside, key=lambda x: abs(x[0] - want), default=None)
            if best and abs(best[0] - want) <= near:
                done[k] = best[1]
                del open_[k]
                continue
            for b, p in inside:
                if b <= want:
                    lo, lo_bytes = p, b
                elif p < hi:
                    hi, hi_bytes = p, b
                    break
            if (lo[0] == hi[0] and hi[1] - lo[1] <= 1) or (hi[0] - lo[0] == 1 and hi[1] == least and lo[1] >= most):
                done[k] = lo if want - lo_bytes <= hi_bytes - want else hi
                del open_[k]
            else:
                open_[k] = (lo, lo_bytes, hi, hi_bytes)
    return [done[k] for k in sorted(done)], total


def _part(cuts: list[tuple[int, int]]):
    """The number of boundaries at or before (k1, k2), as a function of two columns.

    Every so many-th boundary is counted first, then those of one stretch: about twice the square
    root of all comparisons a row.
    """
    step = math.isqrt(len(cuts)) + 1
    edges = lambda some: F.array(*(F.struct(F.lit(a).alias("k1"), F.lit(b).alias("k2")) for a, b in some))

    def part(a: Column, b: Column) -> Column:
        if not cuts:
            return F.lit(0)
        count = lambda some: F.size(F.filter(some, lambda x: (x.k1 < a) | ((x.k1 == a) & (x.k2 <= b))))
        whole = count(edges(cuts[step - 1 :: step])) * step if len(cuts) >= step else F.lit(0)  # boundaries of full stretches below
        return whole + count(F.slice(edges(cuts), whole + 1, F.lit(step)))

    return part


def shard_by_bytes(df: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with size, shard and slot: shards of near-equal bytes, each in one total order.

    Rows are ordered by (XXH64 of the text, key): equal texts stand together, in one shard unless
    a boundary of equal bytes falls among them. size is the text's UTF-8 bytes plus 1; slots count
    from 0 without gaps within a shard. key must be an integer; null keys come first, null texts
    count as a text of their own of size 1. Rows with equal text and key are in any order.
    An empty table gives no rows. Columns of df named size, shard or slot are replaced.

    The search for boundaries reads only (hash, key, size) of each row, written once; the rows
    themselves are exchanged once, by range. A shard is dealt out in several ranges of equal
    bytes, so no task sorts a whole shard, and a text with very many copies spreads over ranges.
    """
    scratch = Scratch(df.sparkSession, "shards")
    k1 = F.xxhash64(F.col(text))
    k2 = F.coalesce(F.col(key).cast("long"), F.lit(LOW))
    keys = scratch.save(df.select(k1.alias("k1"), k2.alias("k2"), n_bytes(F.col(text)).alias("size")), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    every = min(max(-(-total // (n_shards * RANGE_BYTES)), RANGES[0]), RANGES[1])
    cuts, _ = splitters(keys, n_shards * every, every)
    part = _part(cuts)
    counts = dict(map(tuple, keys.groupBy(part(F.col("k1"), F.col("k2")).alias("part")).count().collect()))
    first, run = [], 0
    for p in range(n_shards * every):
        run = 0 if p % every == 0 else run
        first.append(run)
        run += counts.get(p, 0)
    one, two, place = free(df, "k1", "k2", "part")
    dealt = df.withColumns({one: k1, two: k2, "size": n_bytes(F.col(text))}).withColumn(place, part(F.col(one), F.col(two)))
    inside = F.row_number().over(W.partitionBy(place).orderBy(one, two))
    return dealt.withColumns(
        {
            "shard": F.floor(F.col(place) / every).cast("int"),
            "slot": F.get(F.array(*map(F.lit, first)), F.col(place)).cast("long") + inside - 1,
        }
    ).drop(one, two, place)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard, in path, which must not be there yet.

    All other columns are in the files, nulls included; the shard is in the folder's name. Rows that
    repeat are written as often; an empty table writes no folder but the root.
    """
    sharded.write.partitionBy("shard").parquet(path)
