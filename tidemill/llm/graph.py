"""Links within groups of rows, and connected components of an edge list by contraction onto smallest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed, trim

EDGES_IN_A_FILE = 100_000
#: Parts that the edges of one hub are dealt in.
SALTS = 8


#: Rows of a group that are compared by pairs; larger groups are searched breadth first.
PAIRED = 32
#: Rows that whole groups are put together to.
AT_ONCE = 16_000


def _starts(table: pa.Table, key: list[str]) -> np.ndarray:
    change = np.ones(table.num_rows, bool)
    change[1:] = False
    for k in key:
        c = table[k].to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
            now = tuple(c[a] for c in columns)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], most: int = AT_ONCE) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``most`` rows, and where each group (a run of equal keys, never divided) begins in them."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, most
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table, key)
        if cut := int(starts[-1]):
            yield table.slice(0, cut), starts[:-1]
            held = table.slice(cut).to_batches()
            rows, enough = rows - cut, most
        else:
            enough = 2 * rows
    if held:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, key)
        del table
    held.clear()
    trim()


def forest(left: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among rows. A row reaches rows within ``linked``; ``left``: side of each row (0: both).

    Breadth first: each row is compared once with all rows not yet reached, so a dense group costs about one comparison a row.
    """
    todo = np.arange(len(left))
    edges = []
    while len(todo):
        front, todo = [int(todo[0])], todo[1:]
        while front and len(todo):
            at = front.pop()
            others = todo if left[at] == 0 else todo[left[todo] != left[at]]
            found = others[linked(at, others)] if len(others) else others
            if len(found):
                edges += [(at, int(o)) for o in found]
                front += found.tolist()
                todo = todo[~np.isin(todo, found, assume_unique=True)]
    return edges


def connected(n: int, us: np.ndarray, vs: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[us], label[vs])
        new = label.copy()
        np.minimum.at(new, label[us], low)
        np.minimum.at(new, label[vs], low)
        new = new[new[label]]
        if (new == label).all():
            return label
        label = new


def links_in_groups(starts: np.ndarray, n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) that connect, in each group of the ``n`` rows, what ``near`` (of pairs of rows) connects there.

    Rows of side 1 and 2 are compared with the other side alone. Small groups are compared by pairs, all groups together; large ones breadth first.
    """
    size = np.diff(np.append(starts, n))
    side = np.zeros(n, np.int8) if side is None else side
    left = np.repeat(starts + size, size) - np.arange(n)  # rows of the group from here on
    left[np.repeat(size, size) > PAIRED] = 0
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, PAIRED):
        at = np.flatnonzero(left > step)
        if not len(at):
            break
        at = at[(side[at] == 0) | (side[at] != side[at + step])]
        at = at[near(at, at + step)] if len(at) else at
        us.append(at)
        vs.append(at + step)
    large = size > PAIRED
    for a, m in zip(starts[large].tolist(), size[large].tolist(), strict=True):
        edges = np.array(forest(side[a : a + m], lambda at, others, a=a: near(np.full(len(others), a + at), a + others)), np.int64).reshape(-1, 2)
        us.append(a + edges[:, 0])
        vs.append(a + edges[:, 1])
    u, v = np.concatenate(us), np.concatenate(vs)
    if not len(u):
        return u, v
    rows, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = connected(len(rows), at[: len(u)], at[len(u) :])
    leaves = np.flatnonzero(label != np.arange(len(rows)))
    return rows[label[leaves]], rows[leaves]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``edges`` (u, v); loops and repeats are allowed.

    Large-star and small-star rounds in turn: every edge list is rewritten onto smallest neighbours until nothing changes, in
    about log2 of the longest path rounds. The state is checkpointed each round; only its size reaches the driver.
    Minima are combined before the shuffle, so a hub's many edges meet as partial minima; where they meet its minimum again they are salted.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    loops = edges.where("u = v").select("u")
    for _ in range(most_rounds):
        # A forest of stars is done: each leaf has one edge, and no root is a leaf.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        each = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
        size, undone = each.agg(F.sum("leaf"), F.max(((F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("root") > 0))).cast("int"))).first()
        if not undone:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        dealt = low.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = both.where("v > u").withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(dealt, ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Few edges need few files, however many partitions the shuffles have.
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct().coalesce(size // EDGES_IN_A_FILE + 1))
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component")))
    return leaves.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
