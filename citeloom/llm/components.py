"""Connected components of pairs: forests of the parts, then one task or alternating stars.

Each partition first reduces its edges to a forest, which connects the same nodes with fewer edges
than it has nodes, however dense the pairs are. Where all forests together are small, by count, one
task finishes, after fewer tasks have met them in between if need be. Else large-star and small-star alternate; each round is one aggregation by node and
is written to shared storage, so the lineage stays short and a lost executor costs at most one round.
Both ways give each node its component's least node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import forget, stored, trim

#: Edges that one task takes: some 100 MB with what it makes of them.
ONE_TASK = 2_000_000
_CHUNK = 500_000


def _places(nodes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number in sorted `nodes` of each end; sorted first, since that is several times faster than by chance."""
    order = np.argsort(ends)
    out = np.empty(len(ends), np.int64)
    out[order] = np.searchsorted(nodes, ends[order])
    return out


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component, and that one."""
    nodes = np.sort(np.concatenate([u, v]))
    nodes = nodes[np.concatenate([nodes[:1] == nodes[:1], nodes[1:] != nodes[:-1]])]
    a, b = _places(nodes, u), _places(nodes, v)
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        low = np.minimum(ra, rb)[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    us, vs, held, kept = [], [], 0, 0
    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held > _CHUNK + 2 * kept:
            us, vs = [np.concatenate(us)], [np.concatenate(vs)]
            u, v = _forest(us.pop(), vs.pop())
            us, vs, held, kept = [u], [v], len(u), len(u)
    if held:
        us, vs = [np.concatenate(us)], [np.concatenate(vs)]
        u, v = _forest(us.pop(), vs.pop())
        for k in range(0, len(u), _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + _CHUNK]), pa.array(v[k : k + _CHUNK])], names=["u", "v"])
    trim()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large-star links each node's greater neighbours to its least one; small-star its lesser ones."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select("v", "m", "u")
        out = out.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node of `pairs`, whose first two columns are the ends; the component is its least node.

    Null ends and loops are left out; repeated and reversed pairs don't matter.
    """
    a, b = (F.col(c).cast("long") for c in pairs.columns[:2])
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a.isNotNull() & b.isNotNull()).alias("whole")).where("whole and u > v")
    edges = stored(edges.select("u", "v").mapInArrow(_contract, "u long, v long"), "forests")
    count, last = edges.count(), None
    while count > ONE_TASK and (last is None or count < 0.9 * last):
        # forests of several parts together are a forest of fewer edges
        wide, edges = edges, stored(edges.repartition(-(-count // ONE_TASK) if ONE_TASK else 1).mapInArrow(_contract, "u long, v long"), "forests")
        forget(wide)
        last, count = count, edges.count()
    if count <= ONE_TASK:
        edges = stored(edges.repartition(1).mapInArrow(_contract, "u long, v long"), "stars")
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
    before = None
    while True:
        last, edges = edges, stored(_star(_star(edges, True), False), "stars")
        forget(last)
        # a round that changes nothing leaves the same edges: compare an order-free digest
        digest = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(digest) == before:
            break
        before = tuple(digest)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
