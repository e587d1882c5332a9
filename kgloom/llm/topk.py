"""Exact top-k by inner product: a ball tree for each shard, branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .scratch import Scratch
from .vectors import runs, usable

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 4096, 512, 64
#: Doubles hold integers exactly up to this.
EXACT = 1 << 53


def quantised(lists: pa.Array, scale: float) -> list[np.ndarray]:
    """floor(scale * x) of every component, as doubles, which hold it exactly."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return [np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64)) for v in lists]


def padded(rows: list[np.ndarray], width: int = 0) -> np.ndarray:
    """Rows as a matrix; shorter ones end in zeros."""
    out = np.zeros((len(rows), max([width, *map(len, rows)], default=width)))
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


class BallTree:
    """Rows in the order of the leaves, and each node's rows, centre, radius and parent."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.spans: list[tuple[int, int]] = []
        self.parent: list[int] = []
        self.leaves: list[int] = []
        centres, radii, stack = [], [], [(0, len(x), -1)]
        while stack:
            a, b, up = stack.pop()
            rows = x[self.order[a:b]]
            centre = rows.mean(0)
            apart = np.sqrt(((rows - centre) ** 2).sum(1))
            node = len(self.spans)
            self.spans.append((a, b))
            self.parent.append(up)
            centres.append(centre)
            radii.append(apart.max(initial=0))
            if b - a <= LEAF_ROWS or not radii[-1] > 0:
                self.leaves.append(node)
                continue
            one = rows[apart.argmax()]  # two far rows; the others are halved along their line
            two = rows[((rows - one) ** 2).sum(1).argmax()]
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(rows @ (two - one), half)]
            stack += [(a + half, b, node), (a, a + half, node)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of each query's inner products in each leaf, with slack for rounding.

        A node's bound is that of its centre plus its radius times the query's length, and never
        above its parent's.
        """
        norm = np.sqrt((q**2).sum(1))[:, None]
        reach = norm * (self.radii + np.sqrt((self.centres**2).sum(1)))[None, :]
        bound = q @ self.centres.T + norm * self.radii[None, :] + 1e-9 * reach + 1e-6
        for k, up in enumerate(self.parent):
            if up >= 0:
                np.minimum(bound[:, k], bound[:, up], out=bound[:, k])
        return bound[:, self.leaves]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows x with q; in Python's integers where doubles can't."""
    if x.size and np.abs(x).max() * np.abs(q).max() * max(1, x.shape[1]) >= EXACT:
        own = [int(v) for v in q]
        sums = [sum(int(a) * b for a, b in zip(row, own)) for row in x]
        return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], dtype=np.int64)
    return (x @ q).astype(np.int64)


def search(tree: BallTree, x: np.ndarray, ids: np.ndarray, rows_: np.ndarray, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int):
    """Each query's k best rows of one shard that can be among its k best of all.

    rows_ and own number the rows and the queries' own rows. kth: for each query a score that k
    other rows reach already. Leaves are visited from the
    highest bound on, until it is below the k-th score so far; equal scores may still win by id.
    """
    bound = tree.bounds(q)
    for n in range(len(q)):
        best, best_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor_, at, step = kth[n], np.argsort(-bound[n], kind="stable"), 1
        while len(at):
            at = at[bound[n, at] >= floor_]
            now, at, step = at[:step], at[step:], step * 2
            if not len(now):
                break
            rows = np.concatenate([tree.order[slice(*tree.spans[tree.leaves[j]])] for j in now])
            rows = rows[rows_[rows] != own[n]]
            best, best_ids = np.r_[best, products(x[rows], q[n])], np.r_[best_ids, ids[rows]]
            keep = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[keep], best_ids[keep]
            if len(best) == k:
                floor_ = max(floor_, int(best[-1]))
        yield best[best >= kth[n]], best_ids[best >= kth[n]]


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: float = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose key is divisible by `every`.

    Components become floor(scale * x); the score is their integer inner product, ties go to the
    smaller key. A query's own row is no candidate, every other is, also one that repeats its key or
    vector; each of the rows that repeat a query's key is a query of its own. Vectors that are null
    or hold null or non-finite components, and rows with a null key, take no part; shorter vectors
    end in zeros; scores beyond a long are clamped to it. Queries with fewer candidates get all of
    them. Other columns are ignored. An empty table gives no rows.

    Rows are packed into shards and queries into blocks of fixed sizes; each block meets each
    shard once, as the packed rows of an equi-join. Shards are searched in waves, the first of one
    shard a block, each later one of as many as all before; after each wave the current k-th score
    of every query is shared with all searches of the next.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "topk")
    rows = scratch.save(
        df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(vector).alias("v")),
        "vectors",
    )
    wanted = F.col("id") % every == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(wanted)).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_ROWS))

    def pack(batches):
        import pickle

        for run in runs(batches, 1):
            x = padded(quantised(run.column(3), scale))
            row, ids = run.column(1).to_numpy(), run.column(2).to_numpy()
            blob = pickle.dumps((row, ids, x, vars(BallTree(x))), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([run.column(0)[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

    def packed(df: DataFrame, parts: int, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
        dealt = df.select(part.alias("part"), "row", "id", "v").repartition("part").sortWithinPartitions("part", "row")
        return scratch.save(dealt.mapInArrow(pack, "part int, blob binary"), name)

    shard = packed(rows, shards, "shards").select(F.col("part").alias("shard"), F.col("blob").alias("rows"))
    block = packed(rows.where(wanted), blocks, "blocks").select(F.col("part").alias("block"), F.col("blob").alias("queries"))

    def find(batches):
        import pickle

        for batch in batches:
            for k_block, rows_, queries, kth in zip(*(batch.column(c) for c in range(4))):
                row, ids, x, parts = pickle.loads(rows_.as_buffer())
                tree = object.__new__(BallTree)
                vars(tree).update(parts)
                own, own_ids, q, _ = pickle.loads(queries.as_buffer())
                width = max(x.shape[1], q.shape[1])
                if x.shape[1] < width:
                    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
                    tree.centres = np.pad(tree.centres, ((0, 0), (0, width - tree.centres.shape[1])))
                q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
                known = dict(kth.as_py() or ())
                first = np.array([known.get(int(i), -(1 << 63)) for i in own], np.int64)
                out = [(v, s) for s, v in search(tree, x, ids, row, q, own, first, k)]
                sizes = [len(s) for _, s in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(sum(sizes), k_block.as_py(), np.int32)),
                        pa.array(np.repeat(own, sizes).astype(np.int64)),
                        pa.array(np.repeat(own_ids, sizes).astype(np.int64)),
                        pa.array(np.concatenate([v for v, _ in out]) if out else [], pa.int64()),
                        pa.array(np.concatenate([s for _, s in out]) if out else [], pa.int64()),
                    ],
                    names=["block", "row", "query_id", "vec_id", "score"],
                )

    found = "block int, row long, query_id long, vec_id long, score long"
    order = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best, start, width = None, 0, 1
    while start < shards:
        step = F.explode(F.sequence(F.lit(start), F.lit(min(start + width, shards) - 1)))
        if best is None:
            asking = block.withColumn("kth", F.lit(None).cast("map<bigint,bigint>"))
        else:
            kth = best.groupBy("block", "row").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k)
            kth = kth.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("row", "kth"))).alias("kth"))  # one block's queries
            asking = block.join(kth.hint("merge"), "block", "left")
        # merged: Spark takes a block for as large as its file, however often it is repeated, and would send all copies to the driver
        meet = asking.withColumn("step", step).withColumn("shard", (F.col("block") + F.col("step")) % shards).join(shard.hint("merge"), "shard")
        got = meet.select("block", "rows", "queries", "kth").mapInArrow(find, found)
        both = got if best is None else best.unionAll(got)
        best = scratch.save(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
        start, width = start + width, start + width
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
