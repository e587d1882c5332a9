"""Whole trees of linear structure strings, many at once within a task: no exchange, no limit on depth."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from .structure import anomer, linkages, residue_name, residues, topology

# Executors need not have this package installed: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A token like a4-b1.
BOND = r"^(?P<parent>[a-zA-Z])(?P<parent_carbon>[\d?]+)-(?P<child>[a-zA-Z])(?P<child_carbon>[\d?]+)"


def _carbons(texts: pa.Array) -> pa.Array:
    """Carbon numbers; ? is 0, what is no number null."""
    coded = texts.dictionary_encode()
    one = lambda t: 0 if t == "?" else int(t) if t.isdigit() and int(t) < 1 << 31 else None
    return pa.array([one(t) for t in coded.dictionary.to_pylist()], pa.int32()).take(coded.indices)


def _numbers(letters: pa.Array) -> np.ndarray:
    """0 to 25 for a to z, 26 to 51 for A to Z."""
    code = np.frombuffer("".join(letters.to_pylist()).encode(), np.uint8).astype(np.int64)
    return np.where(code >= ord("a"), code - ord("a"), code - (ord("A") - 26))


def _nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of (k, codes, links, tokens) with a row for each of links, a tree's nodes; all trees of a batch at once.

    up: for each node the place of the node above among all of the batch, or -1.
    """
    k, codes, links, tokens = (batch.column(c) for c in range(4))
    n = pc.list_value_length(links).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(n) - n
    tree = np.repeat(np.arange(len(n)), n)
    node = np.arange(len(tree)) - first[tree]

    # bonds between nodes that the chain has: of each child the first as written
    of = np.repeat(np.arange(len(n)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64))
    read = pc.extract_regex(tokens.flatten(), BOND)
    there = read.is_valid().to_numpy(zero_copy_only=False)
    part = {c: x.filter(pa.array(there)) for c, x in zip((f.name for f in read.type), read.flatten())}
    of, parent, child = of[there], _numbers(part["parent"]), _numbers(part["child"])
    fit = np.flatnonzero((parent < n[of]) & (child < n[of]) & (child > 0))
    below, at = np.unique(first[of[fit]] + child[fit], return_index=True)  # at: of equal ones the first
    bond = np.full(len(tree), -1)
    bond[below] = fit[at]
    hung = bond >= 0
    up = np.full(len(tree), -1)
    up[hung] = first[tree[hung]] + parent[bond[hung]]

    # down from the roots, level by level; what is never reached has no depth
    depth = np.full(len(tree), -1)
    depth[first[n > 0]] = 0
    levels, rest = [], np.flatnonzero(hung)
    while len(rest):
        near = depth[up[rest]] == len(levels)
        if not near.any():
            break
        levels.append(rest[near])
        depth[rest[near]] = len(levels)
        rest = rest[~near]
    children = np.bincount(up[hung], minlength=len(tree))

    # bottom up: a node comes after its branches, those after the branches of bonds written earlier
    size = np.ones(len(tree), np.int64)
    for level in reversed(levels):
        np.add.at(size, up[level], size[level])
    linked = np.flatnonzero(depth > 0)
    linked = linked[np.lexsort((bond[linked], up[linked]))]
    before = np.cumsum(size[linked]) - size[linked]
    start = np.zeros(len(tree), np.int64)
    start[linked] = before - before[np.searchsorted(up[linked], up[linked])]  # less what comes before the first sibling
    for level in levels:
        start[level] += start[up[level]]

    there = pa.array(bond, mask=~hung)
    unseen = depth < 0
    number = links.flatten().to_numpy(zero_copy_only=False)
    size_of = pc.list_value_length(codes).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    has = (number >= 1) & (number <= size_of[tree])
    code = np.where(has, (np.cumsum(size_of) - size_of)[tree] + np.nan_to_num(number) - 1, 0).astype(np.int64)
    columns = {
        "k": k.take(pa.array(tree)),
        "node": pa.array(node.astype(np.int32)),
        "residue": codes.flatten().take(pa.array(code, mask=~has)).fill_null(""),
        "parent": pa.array(np.where(hung, up - first[tree], 0).astype(np.int32), mask=~hung),
        "parent_carbon": _carbons(part["parent_carbon"]).take(there),
        "child_carbon": _carbons(part["child_carbon"]).take(there),
        "depth": pa.array(depth.astype(np.int32), mask=unseen),
        "n_children": pa.array(children.astype(np.int32)),
        "n_siblings": pa.array(np.where(hung, children[up] - 1, 0).astype(np.int32)),
        "branching": pa.array(children > 1),
        "bottom_up": pa.array((start + size).astype(np.int32), mask=unseen),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def trees(df: DataFrame, key: str, structure: str) -> DataFrame:
    """One row a node of every structure (F26): (key, node, residue, name, anomer, parent, parent_carbon, child_carbon,
    depth, n_children, n_siblings, branching, bottom_up).

    Nodes count from 0, the root, in chain order. A node hangs on the first bond that names it as
    child, the root on none. bottom_up: the node's place, from 1, in the order in which all of a
    node's branches, as written, come before it. Nodes that no way leads to from the root have no
    depth and no place, also where bonds run in a circle. Structures without a chain have no rows.
    """
    text = F.col(structure)
    read = df.select(F.col(key).alias("k"), residues(text).alias("codes"), topology(text).alias("links"), linkages(text).alias("tokens")).where(F.size("links") > 0)
    nodes = _nodes

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield nodes(batch)

    whole = {"node", "parent", "parent_carbon", "child_carbon", "depth", "n_children", "n_siblings", "bottom_up"}
    names = ("node", "residue", "parent", "parent_carbon", "child_carbon", "depth", "n_children", "n_siblings", "branching", "bottom_up")
    kind = lambda c: T.IntegerType() if c in whole else T.BooleanType() if c == "branching" else T.StringType()
    each = read.mapInArrow(run, T.StructType([T.StructField("k", read.schema["k"].dataType), *(T.StructField(c, kind(c)) for c in names)]))
    code = F.col("residue")
    return each.select(
        F.col("k").alias(key), "node", "residue", residue_name(code).alias("name"), anomer(code).alias("anomer"),
        "parent", "parent_carbon", "child_carbon", "depth", "n_children", "n_siblings", "branching", "bottom_up",
    )
