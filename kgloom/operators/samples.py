"""Sample tables for retrieval and site models: shapes only, no tensors."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.sequence import RESIDUES, weighted_window_mean
from ..functions.windows import CHARGED, HYDROPHOBIC, KEY_OFFSETS, POLAR
from ..scratch import Scratch
from .ranges import places

# Executors need not have this package installed: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def local_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the distinct keys numbered from 0 in their order, by ranges."""
    return places(df.select(key).where(F.col(key).isNotNull()).distinct(), [], [key], "_p").select(key, (F.col("_p") - 1).cast("long").alias(name))


def class_vectors(classes: DataFrame, key: str, term: str, names: list[str]) -> DataFrame:
    """(key, classes): 0 or 1 for each name; over several rows the larger of each."""
    marks = [F.max(F.coalesce((F.col(term) == n).cast("int"), F.lit(0))) for n in names]
    return classes.groupBy(key).agg(F.array(*marks).alias("classes"))


def retrieval_samples(pairs: DataFrame, items: DataFrame, classes: DataFrame, names: list[str]) -> DataFrame:
    """(query, item, query_id, item_id, frequency, item_classes, query_classes) of the pairs whose item is valid.

    pairs(query, item), items(item), classes(item, class). Ids are local: places among the sorted
    queries and valid items. frequency: how often an item stands in all pairs. A query's vector is
    the larger of its items' vectors in each class, so an item without classes adds nothing.
    """
    ids = local_ids(items, "item", "item_id")
    valid = pairs.join(ids, "item")
    frequency = pairs.groupBy("item").agg(F.count("*").alias("frequency"))
    own = class_vectors(classes, "item", "class", names).withColumnRenamed("classes", "item_classes")
    none = F.array(*(F.lit(0) for _ in names))
    marked = valid.join(frequency, "item").join(own, "item", "left").withColumn("item_classes", F.coalesce("item_classes", none))
    most = [F.max(F.get("item_classes", F.lit(k))) for k in range(len(names))]
    queries = marked.groupBy("query").agg(F.array(*most).alias("query_classes"))
    out = marked.join(queries, "query").join(local_ids(valid, "query", "query_id"), "query")
    return out.select("query", "item", "query_id", "item_id", "frequency", "item_classes", "query_classes")


def site_samples(sites: DataFrame, residues: DataFrame, classes: DataFrame, names: list[str], half: int = 16) -> DataFrame:
    """(protein, position, item, local, mean, classes): one sample a row of sites(protein, position, item).

    residues(protein, vectors): a vector for each residue. The position is clamped to them, and
    `local` is their weighted mean within `half`; a protein without residue vectors has no sample.
    classes: the larger in each class over the protein's items of classes(item, class).
    """
    own = class_vectors(classes, "item", "class", names)
    most = [F.max(F.coalesce(F.get("classes", F.lit(k)), F.lit(0))) for k in range(len(names))]
    proteins = sites.select("protein", "item").distinct().join(own, "item", "left").groupBy("protein").agg(F.array(*most).alias("classes"))
    met = sites.join(residues.where(F.size("vectors") > 0), "protein").join(proteins, "protein")
    at = F.greatest(F.least(F.col("position"), F.size("vectors")), F.lit(1))
    zero = F.transform(F.col("vectors")[0], lambda _: F.lit(0.0))
    mean = F.aggregate("vectors", zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")), lambda a: F.transform(a, lambda x: x / F.size("vectors")))
    return met.select("protein", "position", "item", weighted_window_mean(F.col("vectors"), at, half).alias("local"), mean.alias("mean"), "classes")


def standardised(df: DataFrame, vector: str, n: int, least: float = 1e-6, of: DataFrame | None = None) -> DataFrame:
    """df with each of a vector's n values less its mean, over its sample deviation or `least` if that is larger.

    of: a table with the same vectors that takes less to make than df.
    """
    basis = df if of is None else of
    value = lambda k: F.get(vector, F.lit(k))
    stats = [f(value(k)) for k in range(n) for f in (F.avg, F.stddev_samp)]
    one = basis.agg(F.array(*stats).alias("_stats"))  # one row
    scaled = lambda k: (value(k) - F.get("_stats", F.lit(2 * k))) / F.greatest(F.coalesce(F.get("_stats", F.lit(2 * k + 1)), F.lit(0.0)), F.lit(least))
    return df.crossJoin(F.broadcast(one)).withColumn(vector, F.array(*(scaled(k) for k in range(n)))).drop("_stats")


#: Letters of sequences that are looked at at once.
LETTERS = 1 << 18


def _motifs(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(text, position, keys, context) of every motif of some texts: key_residues() and motif_context() of all at once.

    Sums over windows are differences of running sums over all letters. Motifs overlap only by one letter, as the
    third of one can't begin another; of two the first counts, unless it begins before the window.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    a = np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)  # a letter beyond is one of no kind
    among = lambda letters: np.isin(np.arange(256), np.frombuffer(letters.encode(), np.uint8))
    c = np.zeros(len(a), bool)
    c[:-2] = (a[:-2] == ord("N")) & (a[1:-1] != ord("P")) & among("ST")[a[2:]]
    for k in (1, 2):  # not across the end of a text
        c[(first + sizes - k)[sizes >= k]] = False
    free = c.copy()
    free[1:] &= ~c[:-1]
    at = np.flatnonzero(free)
    text = np.searchsorted(first + sizes, at, side="right")
    begin, size = first[text], sizes[text]
    p = at - begin + 1

    # one running sum of all kinds, a byte for each: no window holds as many as 256
    kinds = (CHARGED, POLAR, HYDROPHOBIC, "P", "C")
    marks = sum(among(letters).astype(np.uint64) << np.uint64(8 * k) for k, letters in enumerate(kinds))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(marks[a], out=total[1:])
    low, high = begin + np.maximum(p - 15, 1) - 1, begin + np.minimum(p + 17, size)
    counts = total[high] - total[low]
    shares = [((counts >> np.uint64(8 * k)) & np.uint64(255)) / (high - low) for k in range(len(kinds))]
    far, end = begin + np.maximum(p - 30, 1) - 1, begin + np.minimum(p + 32, size)
    near = np.searchsorted(at, end - 2) - np.searchsorted(at, far) + (c[far] & ~free[far])
    n = np.bincount(text, minlength=len(texts))[text]
    third = a[at + 2]
    context = [third == ord("S"), third == ord("T"), (p - 1) / size, (size - p + 1) / size, n, np.log1p(sizes)[text], p <= 30, *shares, near / 63]

    number = np.full(256, 20, np.int32)
    number[np.frombuffer(RESIDUES.encode(), np.uint8)] = np.arange(20)
    beside = p[:, None] + np.array(KEY_OFFSETS)[None, :]
    there = (beside >= 1) & (beside <= size[:, None])
    keys = np.where(there, number[a[np.where(there, begin[:, None] + beside - 1, 0)]], 20)
    return text, p, keys.astype(np.int32), np.column_stack([np.asarray(x, np.float64) for x in context])


def motifs(sequences: DataFrame) -> DataFrame:
    """(protein, position, keys, context) of every motif of sequences(protein, sequence)."""
    found, letters = _motifs, LETTERS
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))

    def run(batches):
        for batch in batches:
            proteins, texts = batch.column(0), batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            cuts = [*np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, letters), side="right")), len(texts)]
            for low, high in zip(cuts, cuts[1:]):
                text, p, keys, context = found(texts[low:high])
                columns = [proteins.take(pa.array(low + text)), pa.array(p.astype(np.int32)), lists(keys), lists(context)]
                yield pa.RecordBatch.from_arrays(columns, names=["protein", "position", "keys", "context"])

    read = sequences.where(F.length("sequence") > 2).select("protein", "sequence")
    return read.mapInArrow(run, T.StructType([T.StructField("protein", read.schema["protein"].dataType), *T._parse_datatype_string("position int, keys array<int>, context array<double>")]))


#: Labelled motifs that are sent to every task at most.
FEW = 100_000


def motif_samples(sequences: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(protein, position, label, keys, context): every motif of sequences(protein, sequence).

    label is 1 where confirmed(protein, position) has the motif's start. context is standardised over
    all motifs; keys are numbers of the residues around. Motifs are written once, for the statistics
    and the result; only places go through a join.
    """
    scratch = Scratch(sequences.sparkSession, "motifs")
    found = scratch.save(motifs(sequences), "found")
    known = confirmed.select("protein", "position").distinct().join(found.select("protein", "position").distinct(), ["protein", "position"], "left_semi")
    known = scratch.save(known.withColumn("_yes", F.lit(1)), "known")
    some = F.broadcast(known) if known.count() <= FEW else known
    labelled = found.join(some, ["protein", "position"], "left").withColumn("label", F.coalesce("_yes", F.lit(0)))
    return standardised(labelled, "context", 13, of=found).select("protein", "position", "label", "keys", "context")
