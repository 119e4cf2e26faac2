"""Exact Jaccard join of shingle sets, with set relations used to skip work.

Index level: the positions of the hash space are cut into blocks, as many as two linked sets of a size can differ in
and some more, so linked sets agree in a whole block. An index list holds the sets that agree in a block;
sets with no block in common are never compared. Sets that meet in a list for a passage they share are many, so every pair of a list is
first held against 128 bits of each set, one per MinHash: pairs whose bits agree less often than those of linked sets do by eight
standard deviations (a chance of about 1e-12 for a link) are skipped, and only what is left hangs together. Answer level: sets that
hang together are compared
inside a task over index lists ordered by size, of which only the part behind a set's own position is read; and
the answer of a set is derived from the computed answer of a highly similar one by reading the lists of the
shingles alone in which the two differ.

Equal sets are one class from the start. What is handed on is one edge per merger of groups, and the number of links of each
set; pairs are never listed. Classes are joined by ``components``.

Defined results: words are those between space and the control characters from tab to carriage return, A-Z lowered. A text with
fewer words than ``width`` is one shingle. Null and empty texts have no shingle and no link, and are components of their own. Rows are
documents of their own even where ids repeat; a null id is never the name of a component that has
another. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import columns, tidy
from rowloom.llm.components import components
from rowloom.llm.shingles import Hasher, digest, mixed, shingle_set, split_words
from rowloom.session import written

#: Shingles of all sets that one task compares among themselves; larger groups are cut.
GROUP_SHINGLES = 2_000_000
#: Members of groups up to this number are broadcast to find their texts (about 60 MB), more by a shuffle.
BROADCAST_ROWS = 600_000
#: Answers kept to derive others from.
PIVOTS = 8
#: Sets of one list that one task holds against each other; longer lists are cut into pairs of blocks.
LIST_SETS = 30_000
#: Texts whose keys are held at a time.
ROWS = 1_000
#: Bits of a set's sketch.
BITS = 128
_SEEDS = mixed(np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Threshold:
    """Jaccard of at least ``num / den`` and what follows from it for sizes."""

    def __init__(self, num: int, den: int):
        if not 0 < 2 * num or not num <= den:
            raise ValueError("a similarity lies between 0 and 1")
        self.num, self.den = num, den
        # Sizes are cut into stretches so that linked sets lie in the same or in neighbouring ones.
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(self.largest(bounds[-1]) + 1)
        self.bounds = np.array(bounds)

    def largest(self, size: int) -> int:
        """The size of the largest set that a set of ``size`` can be linked with."""
        return size * self.den // self.num

    def stretch(self, size: int) -> int:
        return int(np.searchsorted(self.bounds, size, side="right")) - 1

    def differing(self, stretch: int) -> int:
        """In how many shingles linked sets can differ, the smaller being of this stretch."""
        high = int(self.bounds[stretch + 1]) - 1
        return (high + self.largest(high)) * (self.den - self.num) // (self.den + self.num)

    def linked(self, common: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
        return common * (self.den + self.num) >= self.num * (size + sizes)


def block_keys(values: np.ndarray, at: Threshold) -> np.ndarray:
    """The index lists a set is in: one per block of positions, for its own stretch of sizes and the one below."""
    own = at.stretch(len(values))
    out = []
    for stretch in {own, max(own - 1, 0)}:
        differing = at.differing(stretch)
        if not differing:
            continue  # only equal sets are linked
        # Sets with many blocks seldom have empty ones; two to spare make empty blocks needless.
        spare = 2 if differing >= 20 else 0
        blocks = differing + 1 + spare
        spread = mixed(values ^ np.uint64(stretch * 2 + 1))
        block = (spread % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        counts = np.bincount(block, minlength=blocks)
        sums = np.zeros(blocks, dtype=np.uint64)
        filled = counts > 0
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sums[filled] = np.add.reduceat(mixed(spread[order] + np.uint64(0x9E37)), starts[filled])
        names = mixed(mixed(sums + counts.astype(np.uint64)) + np.arange(blocks, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(stretch))
        out.append(names if (~filled).sum() > spare else names[filled])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def sketch(values: np.ndarray) -> bytes:
    """One bit of the smallest shingle under each of ``BITS`` permutations."""
    least = np.full(BITS, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 4096):
        some = (values[at : at + 4096, None] ^ _SEEDS) * np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, some.min(axis=0), out=least)
    return np.packbits((least >> np.uint64(20)) & np.uint64(1) == 1).tobytes()


def least_agreeing(at: Threshold) -> int:
    """How many bits of linked sets agree at least, but for eight standard deviations."""
    share = (1 + at.num / at.den) / 2
    return int(BITS * share - 8 * np.sqrt(BITS * share * (1 - share)))


def list_clusters(tasks: np.ndarray, sides: np.ndarray, bits: np.ndarray, least: int) -> np.ndarray:
    """For each row the first one of its cluster, in rows sorted by task: what pairs of a task join whose bits agree often enough.

    ``bits`` has two numbers a row. Rows of one task on the same side (a number of at least 0) are not compared. Pairs that hang together
    already are not looked at again.
    """
    n = len(tasks)
    label = np.arange(n)
    starts = np.flatnonzero(np.r_[True, tasks[1:] != tasks[:-1]])
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))

    def top(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    active, step = np.arange(n), 0
    while len(active):
        step += 1
        active = active[active + step < ends[active]]
        apart = label[active] != label[active + step]
        apart &= (sides[active] < 0) | (sides[active] != sides[active + step])
        one = active[apart]
        other = one + step
        agreeing = BITS - np.bitwise_count(bits[one] ^ bits[other]).sum(axis=1, dtype=np.int64)
        near = agreeing >= least
        for i, j in zip(one[near].tolist(), other[near].tolist()):
            low, high = sorted((top(i), top(j)))
            label[high] = low
        if near.any():
            while not (label[label] == label).all():
                label = label[label]
    return label


def links(sets: list[np.ndarray], weights: np.ndarray, sides: np.ndarray, at: Threshold):
    """Links among sets: ``(edges, counts)``.

    Edges join groups that were not joined before; counts are the weighted numbers of links. Sets on the same side (a number
    of at least 0) are not compared.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    sides, weights = sides[order], weights[order]
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(sets)), sizes)
    token = np.unique(flat, return_inverse=True)[1]
    # Shingles of one set alone are in no list.
    often = np.bincount(token)[token] > 1
    token, owner = np.unique(token[often], return_inverse=True)[1], owner[often]
    by_token = np.argsort(token, kind="stable")  # within a list sets follow by size
    entries = owner[by_token]
    starts = np.searchsorted(token[by_token], np.arange(token.max() + 2 if len(token) else 1))
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    behind = starts[:-1].copy()  # where in each list the sets behind the current one begin
    mark = np.zeros(len(starts), dtype=bool)
    group, counts, edges = np.arange(len(sets)), np.zeros(len(sets), dtype=np.int64), []
    answers: list[tuple[int, np.ndarray]] = []

    def read(tokens: np.ndarray) -> np.ndarray:
        lengths = starts[tokens + 1] - behind[tokens]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(behind[tokens] - (ends - lengths), lengths)
        return np.bincount(entries[places], minlength=len(sets))

    def cost(tokens: np.ndarray) -> int:
        return int((starts[tokens + 1] - behind[tokens]).sum())

    for r in range(len(sets)):
        mine = token[first[r] : first[r + 1]]
        behind[mine] += 1  # lists are ordered, so this set is the next entry of all of its own
        similar = max(answers, key=lambda a: a[1][r], default=None)
        common = None
        if similar is not None and 2 * similar[1][r] > len(mine):
            theirs = token[first[similar[0]] : first[similar[0] + 1]]
            mark[theirs] = True
            added = mine[~mark[mine]]
            mark[theirs] = False
            mark[mine] = True
            missing = theirs[~mark[theirs]]
            mark[mine] = False
            if cost(added) + cost(missing) < cost(mine):
                common = similar[1] + read(added) - read(missing)
        if common is None:
            common = read(mine)
            answers = [*answers[-PIVOTS + 1 :], (r, common)]
        # Sets follow by size, so those that can be linked stand together.
        last = np.searchsorted(sizes, at.largest(int(sizes[r])), side="right")
        hit = at.linked(common[r + 1 : last], int(sizes[r]), sizes[r + 1 : last])
        if sides[r] >= 0:
            hit &= sides[r + 1 : last] != sides[r]
        found = np.flatnonzero(hit) + (r + 1)
        if len(found):
            counts[r] += weights[found].sum()
            counts[found] += weights[r]
            for other in np.unique(group[found]):
                if other != group[r]:
                    edges.append((order[r], order[found[group[found] == other][0]]))
                    group[group == other] = group[r]
    back = np.zeros(len(sets), dtype=np.int64)
    back[order] = counts
    return edges, back


def ngram_join(
    docs: DataFrame, num: int = 90, den: int = 100, width: int = 3, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` per row: the smallest id reachable by links, and the direct links."""
    at = Threshold(num, den)
    rows = columns(docs, _key=key, _text=text).withColumn("_t", F.xxhash64("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for batch in (whole.slice(at_row, ROWS) for whole in batches for at_row in range(0, whole.num_rows, ROWS)):
            n, names, marks, keys, bits = [], [], [], [], []
            for value in batch.column(1):
                values = shingle_set(hasher.words(split_words(value.as_py() or "")), width)
                name = digest(values) if len(values) else None
                # Of equal sets a task gives keys and bits once.
                fresh = name is not None and name not in seen
                if fresh:
                    seen.add(name)
                n.append(len(values))
                names.append(name)
                marks.append(int.from_bytes(name[:8], "big", signed=True) if name else None)
                keys.append(block_keys(values, at) if fresh else None)
                bits.append(sketch(values) if fresh else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(names, pa.binary()),
                    pa.array(marks, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
                ],
                names=["_key", "_t", "n", "name", "mark", "keys", "bits"],
            )

    schema = f"_key {kind}, _t long, n long, name binary, mark long, keys array<long>, bits binary"
    found = written(rows.mapInArrow(tidy(sets_of), schema), "sets")
    # Copies are combined before the shuffle; one row per different set is left.
    different = written(
        found.where(F.col("n") > 0).groupBy("name")
        .agg(
            F.min("_key").alias("first"), F.min_by("_t", F.struct("_key", "_t")).alias("first_t"), F.first("n").alias("n"),
            F.count("*").alias("copies"), F.first("mark").alias("mark"), F.first("bits", ignorenulls=True).alias("bits"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "different-sets",
    )
    groups = components(_near_sets(found, different, at), "head", "node")
    members = groups.join(different.drop("mark", "bits"), "node").select("root", "node", "name", "first", "first_t", "n", "copies")
    members = block_tasks(written(members, "members"), at)

    def member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for batch in batches:
            keep, values = [], []
            for row, (value, name, task) in enumerate(zip(batch.column("_text"), batch.column("name"), batch.column("task"))):
                # Rows that repeat id and text come from a task once.
                if (task.as_py(), name.as_py()) in seen:
                    continue
                found = shingle_set(hasher.words(split_words(value.as_py() or "")), width)
                if digest(found) == name.as_py():
                    seen.add((task.as_py(), name.as_py()))
                    keep.append(row)
                    values.append(found.tobytes())
            kept = batch.select(["task", "side", "node", "copies"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(values, pa.binary())], names=["task", "side", "node", "copies", "shingles"])

    small = members.count() <= BROADCAST_ROWS
    wanted = members.select("name", "first", "first_t", "node", "copies", "tasks")
    # By id and text, so that rows without an id, or with a repeated one, meet the sets they have.
    meets = F.col("_key").eqNullSafe(F.col("first")) & F.col("_t").eqNullSafe(F.col("first_t"))
    texts = rows.join(F.broadcast(wanted) if small else wanted, meets)
    # Each set is computed once; then it goes to every task that needs it.
    texts = texts.select("_text", "name", "node", "copies", F.explode("tasks").alias("_task")).select(
        "_text", "name", "node", "copies", F.col("_task.task").alias("task"), F.col("_task.side").alias("side")
    )
    sets = texts.mapInArrow(tidy(member_sets), "task string, side int, node long, copies long, shingles binary")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["node"])
        nodes = part["node"].to_numpy()
        values = [np.frombuffer(v, dtype=np.uint64) for v in part["shingles"]]
        edges, counts = links(values, part["copies"].to_numpy(), part["side"].to_numpy(), at)
        out = [(int(nodes[a]), int(nodes[b]), None) for a, b in edges]
        out += [(int(node), None, int(n)) for node, n in zip(nodes, counts) if n]
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype({"a": "Int64", "b": "Int64", "links": "Int64"})

    linked = written(sets.groupBy("task").applyInPandas(compare, "a long, b long, links long"), "links")
    joined = components(linked.where(F.col("b").isNotNull()))
    counts = linked.where(F.col("links").isNotNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    slim = different.select("node", "name", "first", "copies")
    placed = slim.join(joined, "node", "left").join(counts, "node", "left")
    placed = placed.select("name", "first", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    names = placed.groupBy("root").agg(F.min("first").alias("component"))
    classes = placed.join(names, "root").select("name", "component", (F.col("links") + F.col("copies") - 1).alias("links"))
    out = found.select("_key", "n", "name").join(classes, "name", "left")
    return out.select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component", "_key").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def _shared_lists(found: DataFrame) -> DataFrame:
    """``(list, mark)`` of the lists that hold more than one set, each set once.

    The keys, many for each set, go through one exchange, as two numbers each, and are written nowhere else; most lists hold one set.
    """
    listed = found.select("mark", F.explode("keys").alias("list"))
    whole = Window.partitionBy("list")
    several = F.min("mark").over(whole) != F.max("mark").over(whole)
    return listed.withColumn("several", several).where("several").select("list", "mark").distinct()


def _near_sets(found: DataFrame, different: DataFrame, at: Threshold) -> DataFrame:
    """Edges ``(head, node)`` that join the sets of each list whose bits agree often enough.

    A set goes by the first 64 bits of its name until its list is known to hold others; sets that share them come along, and are
    compared like all of a list.
    """
    pairs = written(_shared_lists(found), "shared-lists")
    counts = pairs.groupBy("list").agg(F.count("*").alias("sets"))
    entries = pairs.join(counts, "list").join(different.select("mark", "node", "bits"), "mark")
    entries = written(entries.select("list", "sets", "node", "bits"), "list-entries")
    short = entries.where(F.col("sets") <= LIST_SETS).select(F.col("list").alias("task"), "node", F.lit(-1).alias("side"), "bits")
    # Blocks of long lists; each set weighs so much that a block holds half of ``LIST_SETS``.
    long = entries.where(F.col("sets") > LIST_SETS)
    weight = F.lit(GROUP_SHINGLES // LIST_SETS).cast("long").alias("n")
    tasks = block_tasks(long.select(F.col("list").alias("root"), "node", "bits", weight), at)
    split = tasks.select("node", "bits", F.explode("tasks").alias("t")).select(
        F.xxhash64("t.task").alias("task"), "node", F.col("t.side").alias("side"), "bits"
    )
    least = least_agreeing(at)

    def clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        # Lists are short and dealt evenly, so a task holds a share of all entries: some 50 bytes each.
        whole = pa.Table.from_batches(held)
        task, node, side = (whole[c].to_numpy() for c in ("task", "node", "side"))
        bits = np.frombuffer(b"".join(whole["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        first = list_clusters(task, side, bits, least)
        joined = np.flatnonzero(first != np.arange(len(first)))
        yield pa.RecordBatch.from_arrays([pa.array(node[first[joined]]), pa.array(node[joined])], names=["head", "node"])

    rows = short.unionByName(split).repartition("task").sortWithinPartitions("task", "node")
    edges = rows.mapInArrow(tidy(clusters), "head long, node long").where(F.col("head") != F.col("node"))
    return edges.distinct()


def block_tasks(members: DataFrame, at: Threshold) -> DataFrame:
    """Adds the comparing tasks of each member: one for a group of bounded size, else one per pair of its blocks.

    Large groups are cut by stretches of sizes and by hash into blocks of bounded size; only blocks of the same and of
    neighbouring stretches meet.
    """
    bounds = F.array(*[F.lit(int(b)) for b in at.bounds if b < 1 << 40])
    rows = members.withColumn("stretch", F.size(F.filter(bounds, lambda b: b <= F.col("n"))) - 1)
    # How many blocks each stretch of a group has, as one map for the group.
    size = F.ceil(F.col("n") / (GROUP_SHINGLES // 2)).cast("int")
    totals = rows.groupBy("root", "stretch").agg(F.sum("n").alias("n")).groupBy("root").agg(
        F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("stretch", size))).alias("blocks")
    )
    rows = rows.join(totals, "root")
    one = F.array(F.struct(F.col("root").cast("string").alias("task"), F.lit(-1).alias("side")))
    blocks = lambda step: F.try_element_at("blocks", F.col("stretch") + step)
    none = F.array().cast("array<int>")
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    name = lambda s1, h1, s2, h2: F.concat_ws(":", "root", s1, h1, s2, h2)
    s, h = F.col("stretch"), F.pmod(F.xxhash64("node"), blocks(0)).cast("int")
    same = F.transform(
        upto(blocks(0)),
        lambda o: F.struct(
            name(s, F.least(h, o), s, F.greatest(h, o)).alias("task"),
            F.when(o == h, F.lit(-1)).when(h < o, F.lit(0)).otherwise(F.lit(1)).alias("side"),
        ),
    )
    up = F.transform(upto(blocks(1)), lambda o: F.struct(name(s, h, s + 1, o).alias("task"), F.lit(0).alias("side")))
    down = F.transform(upto(blocks(-1)), lambda o: F.struct(name(s - 1, o, s, h).alias("task"), F.lit(1).alias("side")))
    tasks = F.when(F.col("all") <= GROUP_SHINGLES, one).otherwise(F.concat(same, up, down))
    return rows.withColumn("tasks", tasks).select(*members.columns, "tasks")
