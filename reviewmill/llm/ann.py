"""Approximate nearest neighbours by a forest of random-projection trees.

A tree splits by the hyperplane between two random points, until a leaf has few points of the
sample that it is fitted on. Every vector of the table is then put into one leaf per tree. A query
goes through all trees with one shared priority queue: the branch that lies nearest, by the squared
distances to the hyperplanes between it and the query, is opened next, in whichever tree, until the
opened leaves hold enough distinct vectors: copies count once, so a vector that many rows hold does
not end the search. The vectors of these leaves are compared exactly.

Leaves are packed into groups of bounded size, a crowded leaf into several, and queries are sent to
the groups of their leaves; of many queries, each group is compared with one slice at a time. A group
returns the k best per query.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import common as c

TREES = 12
#: The trees are fitted on at most so many vectors, chosen by a hash of their id.
SAMPLE = 20_000
LEAF = 12
#: A query opens leaves until their distinct vectors are this share of the table per tree, and at
#: least so many per tree. This share gives a recall of 0.9 even where all vectors are almost equally
#: far from each other; a tenth of it is enough where neighbours are closer than the mass of vectors.
OPENED_SHARE, OPENED_LEAST = 0.065, 20
#: Queries that one group is compared with in one task.
SLICE_QUERIES = 20_000
#: Vectors of a group and of a part of a leaf.
GROUP_ROWS, PART_ROWS = 20_000, 10_000


class Tree:
    """Inner nodes: a hyperplane and two children; a child below 0 is leaf -1 - child."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        normals, offsets, children = [], [], []
        self.leaves = 0

        def build(rows: np.ndarray) -> int:
            normal = None
            for _ in range(8 if len(rows) > leaf else 0):
                a, b = points[rng.choice(rows, 2, replace=False)]
                if (a != b).any():
                    normal = (a - b) / np.linalg.norm(a - b)
                    offset = float(normal @ (a + b) / 2)
                    right = points[rows] @ normal > offset
                    if 0 < right.sum() < len(rows):
                        break
                    normal = None
            if normal is None:
                self.leaves += 1
                return -self.leaves
            node = len(normals)
            normals.append(normal)
            offsets.append(offset)
            children.append(None)
            children[node] = (build(rows[~right]), build(rows[right]))
            return node

        self.root = build(np.arange(len(points)))
        self.normals = np.array(normals, np.float32).reshape(len(normals), points.shape[1])
        self.offsets = np.array(offsets, np.float32)
        self.children = np.array(children, np.int64).reshape(len(children), 2)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.full(len(x), self.root)
        while (at := np.flatnonzero(node >= 0)).size:
            here = node[at]
            right = np.einsum("ij,ij->i", x[at], self.normals[here]) > self.offsets[here]
            node[at] = self.children[here, right.astype(np.int64)]
        return -1 - node


class Forest:
    def __init__(self, trees: list[Tree]):
        self.trees = trees

    def search(self, q: np.ndarray, sizes: list[np.ndarray], enough: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until they hold ``enough`` distinct vectors."""
        margins = [t.normals @ q - t.offsets for t in self.trees]
        queue = [(0.0, i, t.root) for i, t in enumerate(self.trees)]
        heapq.heapify(queue)
        out, held = [], 0
        while queue and held < enough:
            cost, i, node = heapq.heappop(queue)
            if node < 0:
                out.append((i, -1 - node))
                held += int(sizes[i][-1 - node])
                continue
            margin = float(margins[i][node])
            left, right = self.trees[i].children[node]
            near, far = (right, left) if margin > 0 else (left, right)
            heapq.heappush(queue, (cost, i, int(near)))
            heapq.heappush(queue, (cost + margin * margin, i, int(far)))
        return out


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit(vectors: DataFrame, dim: int, trees: int, sample: int, leaf: int) -> Forest:
    """Trees over a sample of bounded size."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    x = _matrix(pa.concat_arrays(rows["vector"].chunks), dim) if rows.num_rows else np.zeros((0, dim))
    x = np.unique(x.astype(np.float32), axis=0)
    return Forest([Tree(x, leaf, np.random.default_rng(i)) for i in range(trees)])


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k smallest scores per query, each id once; ties go to the smaller id."""
    order = np.lexsort((score, ids, query))
    q, i = query[order], ids[order]
    first = np.ones(len(order), bool)
    first[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    order = order[first]
    order = order[np.lexsort((ids[order], score[order], query[order]))]
    q = query[order]
    begin = np.searchsorted(q, q)
    return order[np.arange(len(order)) - begin < k]


def _copies_left(keys: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows by key and id, of equal vectors under a key only those with the k smallest ids."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    same = np.unique(raw, return_inverse=True)[1]
    order = np.lexsort((ids, same, keys))
    key, of, i = keys[order], same[order], ids[order]
    run = np.ones(len(order), bool)
    run[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    new = run.copy()
    new[1:] |= i[1:] != i[:-1]
    order, run = order[new], run[new]
    begin = np.flatnonzero(run)
    order = order[np.arange(len(order)) - np.repeat(begin, np.diff([*begin, len(order)])) < k]
    return order[np.lexsort((ids[order], keys[order]))]


def nearest(
    df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF,
    share: float = OPENED_SHARE, least: int = OPENED_LEAST,
) -> DataFrame:
    """The k nearest other vectors by Euclidean distance, for the rows where ``queries`` holds.

    Returns ``query_id``, ``rank`` (from 1), id and ``score`` (the distance in double precision),
    ties to the smaller id. Found among the vectors of the opened leaves, so approximate unless
    these are all. With fewer than k others
    all are returned. Rows without an id, with a null or zero vector, with null or non-finite
    components, or of another length than most take no part. Rows that repeat an id are one
    candidate, at the smallest distance. Other columns are not read.
    """
    spark = df.sparkSession
    narrow = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("is_query"),
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = narrow.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], result).withColumnRenamed("vec_id", id_col)
    dim = lengths["dim"]
    vectors = narrow.where(F.size("vector") == dim).withColumn("vector", F.col("vector").cast("array<double>"))
    forest = fit(vectors, dim, trees, sample, leaf)
    name = c.ship(spark, "forest", pickle.dumps(forest))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _load(name)
        for batch in batches:
            x = _matrix(batch.column(1), dim).astype(np.float32)
            leaves = np.stack([t.leaf_of(x) for t in forest.trees], axis=1).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel()), len(forest.trees))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists.cast(pa.list_(pa.int32()))], names=["id", "vector", "is_query", "leaves"])

    placed = c.stored(
        vectors.mapInArrow(place, "id bigint, vector array<double>, is_query boolean, leaves array<int>"), "leaves"
    )
    flat = placed.select("id", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    counts = flat.groupBy("tree", "leaf").count().collect()  # at most trees * sample rows
    apart = placed.select(F.xxhash64("vector").alias("hash"), "leaves").distinct()
    sizes = [np.zeros(t.leaves, np.int64) for t in forest.trees]
    for r in apart.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():
        sizes[r["tree"]][r["leaf"]] = r["count"]
    opened = max(least * trees, int(share * sum(r["count"] for r in counts)))
    groups = spark.createDataFrame(_pack(counts), "tree int, leaf int, parts int, `group` int")
    route = c.ship(spark, "sizes", pickle.dumps(sizes))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _load(name)
        held = _load(route)
        for batch in batches:
            x = _matrix(batch.column(1), dim).astype(np.float32)
            found = [forest.search(q, held, opened) for q in x]
            rows = np.repeat(np.arange(len(x)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                 pa.array([t for f in found for t, _ in f], pa.int32()), pa.array([x for f in found for _, x in f], pa.int32())],
                names=["id", "vector", "tree", "leaf"])

    asked = placed.where("is_query").select("id", "vector").mapInArrow(
        look, "id bigint, vector array<double>, tree int, leaf int"
    )
    at = F.broadcast(groups)  # one row per leaf of the sample's trees
    slices = -(-placed.where("is_query").count() // SLICE_QUERIES) or 1
    rows = flat.join(at, ["tree", "leaf"]).select(
        (F.col("group") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("group"), "tree", "leaf", "id", "vector",
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
    )
    wanted = asked.join(at, ["tree", "leaf"]).select(
        F.explode(F.sequence(F.col("group"), F.col("group") + F.col("parts") - 1)).alias("group"), "tree", "leaf", "id", "vector",
        F.pmod(F.xxhash64("id", "vector"), F.lit(slices)).cast("int").alias("slice"),
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (_matrix(pa.concat_arrays(t["vector"].chunks), dim) if t.num_rows else np.zeros((0, dim)) for t in (left, right))
        ids, asks = left["id"].to_numpy(), right["id"].to_numpy()
        keys, wants = (t["tree"].to_numpy().astype(np.int64) << 32 | t["leaf"].to_numpy() for t in (left, right))
        order = _copies_left(keys, ids, x, k + 1)  # one of them may be the query's own
        begin, end = np.searchsorted(keys[order], wants), np.searchsorted(keys[order], wants, "right")
        first = np.ones(len(order), bool)  # of the rows of an id in a leaf
        first[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        parts = []
        for j, (s, e) in enumerate(zip(begin, end)):
            near = order[s:e]
            score = np.sqrt(((x[near] - y[j]) ** 2).sum(axis=1))
            if not first[s:e].all():  # each id once, at its smallest distance, before any cut
                at = np.flatnonzero(first[s:e])
                near, score = near[at], np.minimum.reduceat(score, at)
            other = ids[near] != asks[j]
            near, score = near[other], score[other]
            if len(near) > 4 * k:
                cut = np.partition(score, k - 1)[k - 1]
                near, score = near[score <= cut], score[score <= cut]
                if len(near) > 4 * k:  # many at one distance: the smallest ids
                    best = np.lexsort((ids[near], score))[:k]
                    near, score = near[best], score[best]
            parts.append((np.full(len(near), asks[j]), ids[near], score))
        query, vec, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
        best = _best(query, vec, score, k)
        return pa.table({"query_id": query[best], "vec_id": vec[best], "score": score[best].astype(float)})

    met = rows.groupBy("group", "slice").cogroup(wanted.groupBy("group", "slice")).applyInArrow(
        compare, "query_id bigint, vec_id bigint, score double"
    )
    once = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


_LOADED: dict[str, object] = {}


def _load(name: str):
    if name not in _LOADED:
        if len(_LOADED) > 3:
            _LOADED.clear()
        with open(c.shipped(name), "rb") as f:
            _LOADED[name] = pickle.load(f)
    return _LOADED[name]


def _pack(counts) -> list[tuple[int, int, int, int]]:
    """(tree, leaf, parts, first group): small leaves share a group, a crowded one gets several."""
    out, group, held = [], 0, 0
    for r in sorted(counts, key=lambda r: (r["tree"], r["leaf"])):
        parts = -(-r["count"] // PART_ROWS)
        if parts > 1:
            group, held = group + 1, 0
            out.append((r["tree"], r["leaf"], parts, group))
            group += parts
            continue
        if held + r["count"] > GROUP_ROWS:
            group, held = group + 1, 0
        held += r["count"]
        out.append((r["tree"], r["leaf"], 1, group))
    return out
