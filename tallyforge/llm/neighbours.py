"""Nearest vectors by cosine: a forest of random-projection trees, one queue a query, exact reranking.

The forest is grown on a bounded sample of the unit vectors: each inner node has a random direction, the difference of two
sampled vectors, and splits its part of the sample at the median. Every vector goes down every tree to one leaf,
so the index holds all rows. A query goes down all trees at once: one priority queue holds the best node not
visited yet of any tree, by the sum of squared distances to the splits on its way, until enough leaves are found.
How many are enough depends on the vectors: some of the sample are searched in the rest by brute force, and so many leaves
are visited as find ``RECALL`` of their true neighbours. (Vectors without any structure need about half of all leaves.)

Spark joins blocks of neighbouring leaves with the queries that ask for leaves in them; a matrix product gives cosines whose last bits depend on
the shape of the block, so the best of each block are kept with all that come within ``MARGIN`` of them. Of these few the vectors are
fetched by id and their cosines computed once more, component by component in order, which alone decides scores, ranks and ties. Of equal vectors in a block
only those with the smallest ids go on. A block with very many vectors is dealt to several tasks by salt.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import stage

#: Vectors that the forest is grown on, at most (those with the smallest hashes of id), and how.
SAMPLE = 60_000
TREES, LEAF, SEED = 4, 48, 11
#: Neighbours that the visited leaves shall hold, and vectors of the sample that tell how many leaves that takes.
RECALL, TRIALS = 0.96, 100
#: Leaves in a block; leaves that are close in a tree have close numbers.
BLOCK = 128
#: Vectors of a block that one task takes at a time.
PART = 16_000
#: More than the rounding of a cosine.
MARGIN = 1e-9


@dataclass
class Tree:
    """Nodes in arrays: direction and offset of the split, children (negative: leaf number, -1 - it)."""

    direction: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        node = np.zeros(len(vectors), np.int64)
        while True:
            inner = np.flatnonzero(node >= 0)
            if not len(inner):
                return -1 - node
            at = node[inner]
            side = np.einsum("ij,ij->i", vectors[inner], self.direction[at]) > self.offset[at]
            node[inner] = np.where(side, self.right[at], self.left[at])


def grow(sample: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree over a sample; a part that no direction splits stays a leaf of any size."""
    directions, offsets, left, right = [], [], [], []
    leaves = 0
    waiting = [(np.arange(len(sample)), None, False)]
    while waiting:
        rows, parent, side = waiting.pop()
        split = None
        for _ in range(4 if len(rows) > LEAF else 0):
            a, b = rng.choice(rows, 2, replace=False)
            direction = sample[b] - sample[a]
            size = np.linalg.norm(direction)
            if size < 1e-12:
                continue
            shown = sample[rows] @ (direction / size)
            offset = np.median(shown)
            high = shown > offset
            if 0 < high.sum() < len(rows):
                split = (direction / size, offset, high)
                break
        if split is None:
            number = -1 - leaves
            leaves += 1
        else:
            number = len(directions)
            directions.append(split[0])
            offsets.append(split[1])
            left.append(0)
            right.append(0)
            waiting += [(rows[~split[2]], number, False), (rows[split[2]], number, True)]
        if parent is not None:
            (right if side else left)[parent] = number
    if not directions:  # a single leaf: both sides of a split through the origin
        directions, offsets, left, right = [np.zeros(sample.shape[1])], [0.0], [-1], [-1]
    return Tree(np.array(directions), np.array(offsets), np.array(left), np.array(right))


def visit(forest: list[Tree], margins: list[np.ndarray], visits: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the best leaves for one query, given its distance to every split of every tree, best first."""
    queue = [(0.0, t, 0) for t in range(len(forest))]
    found: list[tuple[int, int]] = []
    while queue and len(found) < visits:
        far_off, t, node = heapq.heappop(queue)
        left, right, margin = forest[t].left, forest[t].right, margins[t]
        while node >= 0:
            m = margin[node]
            near, far = (right, left) if m > 0 else (left, right)
            if near is not far and left[node] != right[node]:
                heapq.heappush(queue, (far_off + m * m, t, int(far[node])))
            node = int(near[node])
        found.append((t, -1 - node))
    return found


def enough(forest: list[Tree], sample: np.ndarray, top: int) -> float:
    """Share of all leaves whose visit finds RECALL of the true neighbours of some vectors of the sample."""
    total = sum(int(max(-tree.left.min(), -tree.right.min())) for tree in forest)
    leaf = [tree.leaves(sample) for tree in forest]
    trials = np.arange(min(TRIALS, len(sample)))
    cosine = sample[trials] @ sample.T
    cosine[trials, trials] = -np.inf
    best = np.argsort(-cosine, axis=1)[:, :top]
    needs = []
    for i in trials:
        ranks = {key: r for r, key in enumerate(visit(forest, [t.direction @ sample[i] - t.offset for t in forest], total))}
        needs += [min(ranks[t, int(leaf[t][j])] for t in range(len(forest))) + 1 for j in best[i] if j != i]
    return float(np.quantile(needs, RECALL)) / total if needs else 1.0


def _vectors(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _placed(forest):
    """Block and leaf of every vector in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_vectors(batch.column(1)))
            for t, tree in enumerate(forest.value[0]):
                leaf = tree.leaves(unit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(leaf), t), pa.int32()), pa.array(leaf // BLOCK, pa.int32()), pa.array(leaf % BLOCK, pa.int32()), *batch.columns],
                    ["tree", "block", "leaf", "vec_id", "embedding"],
                )

    return run


def _asked(forest):
    """Blocks that each query visits, with a bit for each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, share = forest.value
        leaves = [int(max(-t.left.min(), -t.right.min())) for t in trees]
        width = -(-max(leaves) // BLOCK)
        visits = max(1, int(np.ceil(share * sum(leaves))))
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                some = batch.slice(begin, 100)
                unit = _unit(_vectors(some.column(1)))
                margins = [unit @ t.direction.T - t.offset for t in trees]
                bits = np.zeros((len(unit), len(trees), width * BLOCK), bool)
                for i in range(len(unit)):
                    found = np.array(visit(trees, [m[i] for m in margins], visits))
                    bits[i, found[:, 0], found[:, 1]] = True
                bits = bits.reshape(len(unit), len(trees), width, BLOCK)
                row, tree, block = np.nonzero(bits.any(3))
                packed = np.packbits(bits[row, tree, block], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tree, pa.int32()), pa.array(block, pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary()),
                        *(c.take(pa.array(row)) for c in some.columns),
                    ],
                    ["tree", "block", "leaves", "query_id", "embedding"],
                )

    return run


def _best(top: int):
    """The nearest vectors of the visited leaves of a block (or part of it) to each query, with all that are as near but for rounding."""

    def run(key, asked: pa.Table, placed: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(asked) and len(placed):
            queries, ids = asked.column("query_id").to_numpy(), placed.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, leaf, vectors = ids[order], placed.column("leaf").to_numpy()[order], _vectors(placed.column("embedding"))[order]
            few = _first_copies(vectors, top + 1)  # one may be the query itself
            ids, leaf, vectors = ids[few], leaf[few], vectors[few]
            size = np.linalg.norm(vectors, axis=1)
            points = _vectors(asked.column("embedding"))
            bits = np.unpackbits(np.frombuffer(b"".join(asked.column("leaves").to_pylist()), np.uint8).reshape(len(queries), -1), axis=1)
            for begin in range(0, len(queries), 128):
                mine = slice(begin, begin + 128)
                some = points[mine]
                cosine = (some @ vectors.T) / np.linalg.norm(some, axis=1)[:, None] / size
                cosine[(bits[mine][:, leaf] == 0) | (queries[mine, None] == ids)] = -np.inf
                least = -np.partition(-cosine, min(top, cosine.shape[1]) - 1, axis=1)[:, min(top, cosine.shape[1]) - 1]
                row, column = np.nonzero(np.isfinite(cosine) & (cosine >= least[:, None] - MARGIN))
                out["query_id"].append(queries[mine][row])
                out["vec_id"].append(ids[column])
                out["score"].append(cosine[row, column])
        return pa.table({k: pa.array(np.concatenate(v) if v else [], pa.float64() if k == "score" else pa.int64()) for k, v in out.items()})

    return run


def _first_copies(vectors: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` of each set of equal vectors, ascending."""
    bits = np.ascontiguousarray(vectors + 0.0)  # -0.0 is 0.0
    rows = bits.view(np.dtype((np.void, bits.dtype.itemsize * bits.shape[1]))).ravel()
    _, number = np.unique(rows, return_inverse=True)
    order = np.argsort(number, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(number[order])) + 1]
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return np.sort(order[place < count])


def _cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in the order of components, so equal vectors have equal cosines wherever they are."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda v, w: v.cast("double") * w.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest vectors to each query, but itself; ties go to the smaller id.

    Both frames have ``vec_id`` and ``embedding``. Rows without an id, and vectors that are null, empty, zero or hold null or
    non-finite components take no part; nor do those of another length than most have. Of rows with equal ids the best
    counts. If there are fewer candidates than ``top``, all that are found are returned. Extra columns are not looked at.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors)
    lengths = usable.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, total = lengths[0]
    usable = usable.where(F.size("embedding") == size)
    kind = usable.schema["embedding"].dataType.simpleString()
    share = min(1.0, SAMPLE / total)
    drawn = usable.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0)
    sample = _unit(_vectors(sample)) if len(sample) else np.zeros((1, size))
    rng = np.random.default_rng(SEED)
    trees = [grow(sample, rng) for _ in range(TREES)]
    forest = spark.sparkContext.broadcast((trees, enough(trees, sample, top)))

    placed = usable.mapInArrow(_placed(forest), f"tree int, block int, leaf int, vec_id long, embedding {kind}")
    placed = stage(placed, "vector-leaves")
    wanted = _usable(queries).where(F.size("embedding") == size)
    asked = wanted.mapInArrow(_asked(forest), f"tree int, block int, leaves binary, query_id long, embedding {kind}")
    salts = placed.groupBy("tree", "block").agg(F.ceil(F.count("*") / PART).alias("salts"))
    placed = placed.join(salts, ["tree", "block"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), "salts"))
    asked = asked.join(salts, ["tree", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    key = ["tree", "block", "salt"]
    asked, placed = asked.drop("salts"), placed.drop("salts")
    best = asked.groupBy(*key).cogroup(placed.groupBy(*key)).applyInArrow(_best(top), "query_id long, vec_id long, score double")
    merged = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    least = F.min(F.when(F.col("_place") <= top, F.col("score"))).over(Window.partitionBy("query_id"))
    few = merged.withColumn("_place", place).withColumn("_least", least).where(F.col("score") >= F.col("_least") - MARGIN).select("query_id", "vec_id")
    few = few.join(usable.withColumnRenamed("embedding", "_found"), "vec_id").join(wanted.toDF("query_id", "_asked"), "query_id")
    exact = few.groupBy("query_id", "vec_id").agg(F.max(_cosine(F.col("_asked"), F.col("_found"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _usable(rows: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components that is not zero."""
    kind = rows.schema["embedding"].dataType
    if kind.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite & F.exists("embedding", lambda x: x != 0))
    if rows.schema["embedding"].dataType.simpleString() == "array<float>":
        return rows
    # Squares of very large or small doubles are out of range; powers of two take them back without rounding.
    largest = F.array_max(F.transform("embedding", F.abs))
    half = F.floor(F.log2(largest) / 2)
    scaled = F.transform("embedding", lambda x: x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), -half))
    return rows.withColumn("embedding", F.when(largest.between(1e-100, 1e100), F.col("embedding")).otherwise(scaled))
