"""Connected components of a graph given by its edges, without collecting a component anywhere.

Stars are grown and shrunk in turn: in the large step every node links its larger neighbours to the smallest node
it knows, in the small step its smaller ones. Both steps need the minimum over a node's neighbours, which is combined before
the shuffle, and a join back on the node, which Spark can split where a node has very many neighbours. Before each step a task puts
together what hangs together among its own edges, a bounded number at a time, so a small graph is done without a step. The
result of each step is written to the shared folder, so lineage stays short and lost executors cost little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import tidy
from rowloom.session import discard, written

#: Edges that a task puts together at a time.
EDGES = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; the root is the smallest node of its component.

    Loops and null ends are ignored, repeated edges count once, and no edges give an empty result.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    # From here on ``v`` is the larger end.
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    stars = written(_within(pairs.select(low.alias("u"), high.alias("v")).distinct()), "edges")
    while not _settled(stars):
        before, stars = stars, written(_within(_small(_large(stars))), "stars")
        discard(before)
    roots = stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


def _settled(stars: DataFrame) -> bool:
    """Whether every larger end has one edge, and is the smaller end of none."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("above")), F.struct(F.col("v").alias("node"), F.lit(1).alias("above")))
    nodes = stars.select(F.inline(ends)).groupBy("node").agg(F.min("above").alias("least"), F.sum("above").alias("above"))
    return nodes.where((F.col("above") > 1) | ((F.col("above") == 1) & (F.col("least") == 0))).count() == 0


def put_together(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars around their smallest nodes."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        one, other = root[a], root[b]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while not (root[root] == root).all():
            root = root[root]
    out = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[out]], nodes[out]


def _within(pairs: DataFrame) -> DataFrame:
    """Fewer edges for the same components: each task puts its own together. Nodes of other types than long stay as they are."""
    if {kind for _, kind in pairs.dtypes} != {"bigint"}:
        return pairs

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> pa.RecordBatch:
            u, v = put_together(*(np.concatenate([np.asarray(batch.column(i)) for batch in held]) for i in range(2)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= EDGES:
                yield given()
                held, n = [], 0
        if n:
            yield given()

    return pairs.mapInArrow(tidy(together), "u long, v long")


def _large(pairs: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node among itself and all its neighbours."""
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least, "u").select(F.col("m").alias("u"), "v")
    return linked.where(F.col("u") != F.col("v")).distinct()


def _small(pairs: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m"))
    joined = pairs.join(least, "v")
    linked = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(joined.select(F.col("m").alias("u"), "v"))
    return linked.where(F.col("u") != F.col("v")).distinct()
