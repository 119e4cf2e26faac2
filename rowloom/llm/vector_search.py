"""Nearest neighbours by inner product: stable projections, a kd-tree over them, and a chi-square stopping test.

Vectors get one more component that makes all of them equally long, so the largest inner product is the smallest
distance. A Gaussian projection to ``PROJECTED`` dimensions is 2-stable: a projected squared distance over the true one
follows a chi-square distribution. A kd-tree over the projected vectors has its upper levels as cells (one task each) and its
lower ones as leaves inside a cell. A query takes leaves in the order of their projected distance, scores their
vectors exactly, and stops where the test says that a vector not yet seen would be nearer than the current
k-th with less than ``1 - CONFIDENCE`` probability. Queries search their own cell first; the k-th distance found there
decides by the same test which other cells they visit.

The split planes come from a bounded sample, every vector is indexed. Equal vectors are one entry of the index that knows its
``k + 1`` smallest ids, which is all that any answer can need of it.

Defined results: null and zero vectors, vectors with null or non-finite components, and rows without an id take no
part. Vectors of different lengths have no inner product, so those of each length are searched among themselves. The query itself is no candidate, its copies under other ids are. Ties go to the smaller
id. With fewer than k candidates all are returned; rows that repeat an id with the same vector count once. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import columns
from rowloom.session import written

PROJECTED, CONFIDENCE, SEED = 8, 0.97, 11
#: Entries per cell aimed at, cells at most (their boxes are broadcast: about 10 MB), entries per leaf.
CELL, MAX_CELLS, LEAF = 8192, 65_536, 256
#: Projected vectors that the upper split planes are taken from, at most.
SAMPLE = 20_000
#: Queries that one task searches a cell for.
QUERY_BLOCK = 2048


def chi_square_quantile(p: float, dimensions: int) -> float:
    """By bisection of the distribution function, for an even number of dimensions."""
    half = dimensions // 2

    def below(x: float) -> float:
        terms = np.cumprod([1.0, *[x / 2 / i for i in range(1, half)]])
        return 1 - float(np.exp(-x / 2) * terms.sum())

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def split_planes(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A balanced kd-tree in heap order: node i has the children 2i + 1 and 2i + 2; each splits its widest dimension."""
    planes: list[tuple[int, float]] = [(0, 0.0)] * (2**depth - 1)
    groups = {0: points}
    for node in range(len(planes)):
        mine = groups.pop(node)
        if len(mine):
            dimension = int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))
            planes[node] = (dimension, float(np.median(mine[:, dimension])))
        side = mine[:, planes[node][0]] >= planes[node][1]
        groups[2 * node + 1], groups[2 * node + 2] = mine[~side], mine[side]
    return planes


def cells_of(points: np.ndarray, planes: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), dtype=np.int64)
    if not planes:
        return node
    dimensions = np.array([d for d, _ in planes])
    values = np.array([v for _, v in planes])
    while len(node) and node[0] < len(planes):
        node = 2 * node + 1 + (points[np.arange(len(points)), dimensions[node]] >= values[node])
    return node - len(planes)


def leaves_of(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """The lower kd-tree of a cell as the row numbers of its leaves."""
    out, open_nodes = [], [np.arange(len(points))]
    while open_nodes:
        rows = open_nodes.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        mine = points[rows]
        order = np.argsort(mine[:, int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))], kind="stable")
        open_nodes += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of each query to each box."""
    out = np.zeros((len(queries), len(low)))
    for d in range(queries.shape[1]):
        beyond = np.maximum(low[None, :, d] - queries[:, None, d], 0) + np.maximum(queries[:, None, d] - high[None, :, d], 0)
        out += beyond**2
    return out


def search_cell(
    vectors: np.ndarray, projected: np.ndarray, names: np.ndarray, queries: np.ndarray, projections: np.ndarray,
    bounds: np.ndarray, longest: float, keep: int, quantile: float,
) -> tuple[np.ndarray, np.ndarray]:
    """The best ``keep`` entries of a cell for each query: scores (padded with -inf) and names.

    ``bounds`` are scores that are already known to be reached (or -inf).
    """
    leaves = leaves_of(projected)
    low = np.array([projected[rows].min(axis=0) for rows in leaves])
    high = np.array([projected[rows].max(axis=0) for rows in leaves])
    distances = box_distances(projections, low, high)
    order = np.argsort(distances, axis=1, kind="stable")
    scores = np.full((len(queries), keep), -np.inf)
    found = np.full((len(queries), keep), np.iinfo(np.int64).max)
    norms = (queries**2).sum(axis=1)
    active = np.arange(len(queries))
    for turn in range(len(leaves)):
        # The test on the next leaf: could a nearer vector be as far away as this in the projection?
        kth = np.maximum(scores[active, -1], bounds[active])
        reach = np.where(np.isfinite(kth), norms[active] + longest - 2 * kth, np.inf)
        near = distances[active, order[active, turn]] <= quantile * np.maximum(reach, 0) + 1e-9
        active = active[near]
        if not len(active):
            break
        leaf = order[active, turn]
        for one in np.unique(leaf):
            mine = active[leaf == one]
            rows = leaves[one]
            exact = queries[mine] @ vectors[rows].T
            all_scores = np.hstack([scores[mine], exact])
            all_names = np.hstack([found[mine], np.broadcast_to(names[rows], exact.shape)])
            best = np.lexsort((all_names, -all_scores), axis=1)[:, :keep]
            scores[mine] = np.take_along_axis(all_scores, best, axis=1)
            found[mine] = np.take_along_axis(all_names, best, axis=1)
    return scores, found


def nearest(
    table: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding",
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for every row whose id is divisible by ``every``."""
    spark = table.sparkSession
    rows = columns(table, id=key, x=vector).select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(fine & F.exists("x", lambda v: v != 0))
    lengths = sorted(r["n"] for r in rows.select(F.size("x").alias("n")).distinct().collect())
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in lengths:
        found = _nearest_of_length(rows.where(F.size("x") == length), length, k, every, confidence)
        out = found if length == lengths[0] else out.unionByName(found)
    return out


def _nearest_of_length(rows: DataFrame, length: int, k: int, every: int, confidence: float) -> DataFrame:
    # -0.0 and 0.0 are one number.
    rows = written(rows.select("id", F.transform("x", lambda v: v + F.lit(0.0)).alias("x")).distinct(), "vectors")

    # Ranks are cut within pieces of a group first, so a vector that a third of the rows share stays spread.
    named = rows.withColumn("h", F.xxhash64("x")).withColumn("piece", F.pmod("id", F.lit(64)))
    for group in (["h", "x", "piece"], ["h", "x"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("id"))
        named = named.withColumn("place", place).where(F.col("place") <= k + 1)
    entries = named.groupBy("h", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = entries.withColumn("name", F.col("ids")[0])
    norm = F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v)
    entries = written(entries.withColumn("norm", norm), "entries")
    facts = entries.agg(F.count("*").alias("n"), F.max("norm").alias("longest")).first()
    n, longest = facts["n"], facts["longest"]

    random = np.random.default_rng(SEED)
    matrix = random.normal(size=(length + 1, PROJECTED))
    depth = max(0, int(np.ceil(np.log2(min(MAX_CELLS, max(1, n / CELL))))))
    quantile = chi_square_quantile(confidence, PROJECTED)

    def project(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return x @ matrix[:-1] + np.sqrt(np.maximum(longest - norms, 0))[:, None] * matrix[-1]

    sample = entries.orderBy("h", "name").limit(SAMPLE).select("x", "norm").toPandas()
    planes = split_planes(project(np.stack(sample["x"]), sample["norm"].to_numpy()), depth)

    def indexed(batches):
        for batch in batches:
            x = np.array(batch.column("x").values.to_numpy(), dtype=np.float64).reshape(-1, length)
            if not len(x):
                continue
            y = project(x, batch.column("norm").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("name"), pa.array(cells_of(y, planes)), pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.array(list(y), pa.list_(pa.float64())),
                ],
                names=["name", "cell", "x", "y"],
            )

    index = written(
        entries.select("name", "x", "norm").mapInArrow(indexed, "name long, cell long, x binary, y array<double>"), "index"
    )
    # A query vector is searched once, whoever holds it. Its own projection has no part of the added component.
    asked_rows = rows.where(F.col("id") % every == 0).withColumn("h", F.xxhash64("x"))
    asked_rows = asked_rows.join(entries.select("h", F.col("x").alias("_x"), "name"), "h").where(F.col("x") == F.col("_x"))
    asked_rows = written(asked_rows.select(F.col("id").alias("query_id"), "name"), "query-rows")
    asked = asked_rows.select("name").distinct().join(index.select("name", "cell", "x"), "name")
    asked = written(asked.select(F.col("name").alias("query"), "cell", F.col("x").alias("q")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    part = "query long, cell long, bound double"
    answer = "query long, name long, score double"

    def search(own: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(those):
            return pd.DataFrame({"query": [], "name": [], "score": []}).astype({"query": "int64", "name": "int64", "score": "float64"})
        queries = np.stack([np.frombuffer(b) for b in those["q"]])
        vectors = np.stack([np.frombuffer(b) for b in own["x"]])
        scores, found = search_cell(
            vectors, np.stack(own["y"]), own["name"].to_numpy(), queries, queries @ matrix[:-1],
            those["bound"].to_numpy(dtype=np.float64), longest, k + 1, quantile,
        )
        hit = np.isfinite(scores)
        return pd.DataFrame({
            "query": np.repeat(those["query"].to_numpy(), hit.sum(axis=1)), "name": found[hit], "score": scores[hit],
        })

    def run(wanted: DataFrame) -> DataFrame:
        """Visits ``(query, cell, bound)`` meet the vectors of their cell, which is copied only to blocks of queries that visit it."""
        dealt = wanted.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("long"))
        visited = dealt.select(F.col("cell").alias("visited"), F.col("block").alias("by")).distinct()
        copies = index.join(visited, F.col("cell") == F.col("visited")).drop("visited").groupBy("cell", "by")
        those = dealt.join(asked.select("query", "q"), "query").groupBy("cell", "block")
        return copies.cogroup(those).applyInPandas(search, answer)

    def best(answers: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "name"))
        return answers.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")

    home = written(run(asked.select("query", "cell", F.lit(float("-inf")).alias("bound"))), "own-cells")
    answers = home
    if depth:
        low_high = [F.min(F.col("y")[d]).alias(f"low{d}") for d in range(PROJECTED)] + [F.max(F.col("y")[d]).alias(f"high{d}") for d in range(PROJECTED)]
        boxes = index.groupBy("cell").agg(*low_high).orderBy("cell").toPandas()  # at most MAX_CELLS rows
        numbers = boxes["cell"].to_numpy()
        low = boxes[[f"low{d}" for d in range(PROJECTED)]].to_numpy()
        high = boxes[[f"high{d}" for d in range(PROJECTED)]].to_numpy()
        reached = home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        bound = F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(float("-inf")))
        bounded = asked.join(reached, "query").select("query", "cell", "q", bound.alias("bound"))

        def visits(batches):
            for batch in batches:
                queries = np.array([np.frombuffer(b.as_py()) for b in batch.column("q")]).reshape(-1, length)
                kth = batch.column("bound").to_numpy()
                reach = np.where(np.isfinite(kth), (queries**2).sum(axis=1) + longest - 2 * kth, np.inf)
                near = box_distances(queries @ matrix[:-1], low, high) <= quantile * np.maximum(reach, 0)[:, None] + 1e-9
                near &= numbers[None, :] != batch.column("cell").to_numpy()[:, None]
                row, cell = np.nonzero(near)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("query"), pa.array(numbers[cell], pa.int64()), taken.column("bound")],
                    names=["query", "cell", "bound"],
                )

        answers = home.unionByName(run(written(bounded.mapInArrow(visits, part), "visits")))
    top = best(answers).join(entries.select("name", "ids"), "name")
    pairs = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))
    lists = top.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list(pairs))).alias("all"))
    out = asked_rows.join(lists, F.col("name") == F.col("query"))
    mine = F.slice(F.filter("all", lambda p: p["id"] != F.col("query_id")), 1, k)
    ranked = out.select("query_id", F.posexplode(mine).alias("at", "p"))
    return ranked.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("p.id").alias("vec_id"), (-F.col("p.s")).alias("score")
    )
