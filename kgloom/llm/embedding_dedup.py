"""Embedding near-duplicates: int8 tile products with rigorous error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .scratch import Scratch
from .vectors import matrix, runs, usable

#: Rows of a tile at most, about; and rows of a tile that are judged at once.
TILE, STRIP = 1024, 256
#: Possible pairs that are recomputed at once.
PAIRS = 1 << 14
THRESHOLD = 0.93
LEVELS = 127


class Quantised:
    """Unit vectors as int8 times a scale, and how far each is from that at most.

    error bounds the length of (unit vector - scale * int8), rounding of doubles included, so for
    unit vectors u, v with reconstructions a, b:
    |u.v - a.b| <= |a| error_v + |b| error_u + error_u error_v, and |a| <= 1 + error_u.
    """

    def __init__(self, x: np.ndarray):
        # a power of two a row, so that no square is too large or small, and no digit changes
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
        norm = np.sqrt((x**2).sum(1, keepdims=True))
        unit = x / norm
        self.scale = np.abs(unit).max(1) / LEVELS
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        off = unit - self.codes * self.scale[:, None]
        self.error = np.sqrt((off**2).sum(1)) + 1e-12
        # products of int8 are whole numbers, exact in single precision while their sums are
        exact = np.float32 if x.shape[1] * LEVELS**2 < 1 << 24 else np.float64
        self.carrier = self.codes.astype(exact)
        self.x, self.norm = x, norm[:, 0]

    def possible(self, other: Quantised, rows: slice) -> np.ndarray:
        """Pairs whose cosine can reach THRESHOLD."""
        whole = self.carrier[rows] @ other.carrier.T
        about = whole.astype(np.float64) * self.scale[rows, None] * other.scale[None, :]
        a, b = self.error[rows, None], other.error[None, :]
        return about + (1 + a) * b + (1 + b) * a + a * b >= THRESHOLD

    def linked(self, other: Quantised) -> np.ndarray:
        """Pairs whose cosine in double precision reaches THRESHOLD; only possible ones are computed."""
        out = np.zeros((len(self.x), len(other.x)), bool)
        for at in range(0, len(self.x), STRIP):
            rows = slice(at, at + STRIP)
            maybe = self.possible(other, rows)
            i, j = np.nonzero(maybe)
            for k in range(0, len(i), PAIRS):
                p, q = at + i[k : k + PAIRS], j[k : k + PAIRS]
                exact = np.einsum("ij,ij->i", self.x[p], other.x[q]) / (self.norm[p] * other.norm[q])
                out[p, q] = exact >= THRESHOLD
        return out


def _forest(near: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Fewer links than there are rows, which connect what `near` connects; columns follow the rows in number."""
    n, m = near.shape
    total = n if same else n + m
    left, out = np.ones(total, bool), []
    for k in range(total):
        if not left[k]:
            continue
        left[k], queue = False, [k]
        while queue:
            p = queue.pop()
            if same:
                new = np.flatnonzero(near[p] & left)
            elif p < n:
                new = n + np.flatnonzero(near[p] & left[n:])
            else:
                new = np.flatnonzero(near[:, p - n] & left[:n])
            left[new] = False
            out += [(p, int(q)) for q in new]
            queue += new.tolist()
    return out


def _judge(batches):
    """Counts of links by class, and links that connect, for each pair of tiles."""
    for run in runs(batches, 3):
        block, cid, m = (run.column(k).to_numpy() for k in (3, 4, 5))
        x = matrix(run.column(6))
        one, two = divmod(run.column(2)[0].as_py(), 1 << 31)
        low, same = block == one, one == two
        if not same and (low.all() or not low.any()):
            continue  # one of the tiles is empty
        with np.errstate(all="ignore"):
            a = Quantised(x[low])
            b = a if same else Quantised(x[~low])
            near = a.linked(b)
        ids, ms = cid[low], m[low]
        if same:
            np.fill_diagonal(near, False)
            counts = [(ids, near @ ms)]
            names = ids
        else:
            counts = [(ids, near @ m[~low]), (cid[~low], near.T @ ms)]
            names = np.r_[ids, cid[~low]]
        links = _forest(near, same)
        rows = [(int(c), None, int(v)) for own, got in counts for c, v in zip(own, got) if v]
        rows += [(int(names[p]), int(names[q]), 0) for p, q in links]
        if rows:
            c, o, v = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()), pa.array(o, pa.int64()), pa.array(v, pa.int64())], names=["cid", "other", "n"]
            )


def embedding_groups(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept): near-duplicate vectors among rows of the same label.

    Two vectors are linked if their labels are equal and not null, their lengths are equal and
    their cosine in double precision is at least 0.93. n_links counts the other rows linked
    directly, component_id is the smallest key that links reach, kept says that it is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label, link with nothing and keep their own key. A null key takes part but names no component;
    where there is no other key, component_id is null and kept false. Equal vectors of a label are one
    class, so groups of copies cost nothing and repeated rows count as rows. Other columns are
    ignored; an empty table gives no rows.

    A label's classes are dealt into tiles and every two tiles meet once, as the rows of one task's
    group; a task holds two tiles, whatever the label's size. It returns counts and a forest of
    links, never all pairs.
    """
    scratch = Scratch(df.sparkSession, "embeddings")
    fit = usable(F.col(vector)) & F.exists(vector, lambda x: x != 0) & F.col(label).isNotNull()
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"), F.coalesce(fit, F.lit(False)).alias("fit"))
    same = rows.where("fit").groupBy("label", "v").agg(F.count("*").alias("m"), F.min("key").alias("first"))
    classes = scratch.save(same.withColumn("cid", F.monotonically_increasing_id()), "classes")
    sized = classes.withColumn("dim", F.size("v"))
    tiles = sized.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("nb"))
    dealt = (
        sized.join(tiles, ["label", "dim"])
        .withColumn("block", F.pmod(F.xxhash64("cid"), "nb").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("pair", F.least("block", "other").cast("long") * (1 << 31) + F.greatest("block", "other"))
    )
    judged = scratch.save(
        dealt.select("label", "dim", "pair", "block", "cid", "m", "v")
        .repartition("label", "dim", "pair")
        .sortWithinPartitions("label", "dim", "pair", "cid")
        .mapInArrow(_judge, "cid long, other long, n long"),
        "judged",
    )
    counts = judged.where("other is null").groupBy("cid").agg(F.sum("n").alias("n"))
    linked = connected_components(judged.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")), scratch)
    of = (
        classes.select("cid", "label", "v", "m", "first")
        .join(counts, "cid", "left")
        .join(linked.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    ids = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of.join(ids, "component").select(
        "label", "v", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    found = rows.where("fit").join(named, ["label", "v"]).select("key", "n_links", "component_id")
    alone = rows.where("not fit").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    both = found.unionAll(alone)
    return both.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
