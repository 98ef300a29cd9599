"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted in the driver on at most ``SAMPLE`` vectors (those with the smallest
hashes of their ids) and every vector is filed under the leaf it descends to. A query
walks the tree best bin first: down to the nearest child, the siblings into a priority
queue, then on from the nearest of these. How many leaves a query visits is calibrated:
for at most ``PROBES`` queries the true neighbours among all rows are found by a linear
scan, and visits widen until the leaves seen hold ``TARGET`` of them. Leaves with many
vectors are cut into blocks and the queries that visit a leaf into chunks: a group that a task
compares has about ``BLOCK`` vectors and ``CHUNK`` queries, however many the leaf has of either.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import hashed_sample, staged

SAMPLE, PROBES, TARGET, BLOCK, CHUNK = 20_000, 64, 0.97, 4_096, 4_096
FOUND = "query long, query_id long, vec_id long, score double"


class KMeansTree:
    """Centres by level; ``leaf[node]`` is the leaf's number or -1, ``kids[node]`` the nodes below."""

    def __init__(self, points: np.ndarray, branch: int = 8, leaf_size: int = 64, rounds: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.kids: list[np.ndarray] = []
        self.centers: list[np.ndarray | None] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(points, branch, leaf_size, rounds, rng)

    def _node(self) -> int:
        self.kids.append(np.empty(0, np.int64))
        self.centers.append(None)
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def _grow(self, points, branch, leaf_size, rounds, rng) -> None:
        todo = [(self._node(), np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            parts, centers = (None, None) if len(own) <= leaf_size else _kmeans(points[own], branch, rounds, rng)
            if parts is None:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            below = [self._node() for _ in centers]
            self.kids[node], self.centers[node] = np.array(below), centers
            todo += ((n, own[parts == k]) for k, n in enumerate(below))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of ``x`` descends to."""
        out, todo = np.empty(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if self.leaf[node] >= 0:
                out[own] = self.leaf[node]
            elif len(own):
                near = _squares(x[own], self.centers[node]).argmin(1)
                todo += ((int(n), own[near == k]) for k, n in enumerate(self.kids[node]))
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            while self.leaf[node] < 0:
                d = ((self.centers[node] - q) ** 2).sum(1)
                best = int(d.argmin())
                for k, n in enumerate(self.kids[node].tolist()):
                    if k != best:
                        heapq.heappush(queue, (float(d[k]), n))
                node = int(self.kids[node][best])
            yield self.leaf[node]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]


def _kmeans(x: np.ndarray, branch: int, rounds: int, rng) -> tuple:
    """(part of each point, centres), or (None, None) if the points can't be told apart."""
    centers = np.unique(x[rng.permutation(len(x))[: 4 * branch]], axis=0)
    centers = centers[rng.permutation(len(centers))[:branch]]
    part = None
    for _ in range(rounds):
        part = _squares(x, centers).argmin(1)
        used = np.unique(part)
        if len(used) < 2:
            return None, None
        centers = np.stack([x[part == k].mean(0) for k in used])
    part = _squares(x, centers).argmin(1)
    used, part = np.unique(part, return_inverse=True)
    return (part, centers[used]) if len(used) > 1 else (None, None)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> vec_id, v array<double>: what is not null, zero, non-finite or of another than the usual length."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.filter("vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)")
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _nearest(ids: np.ndarray, v: np.ndarray, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = v - q
    d = np.einsum("ij,ij->i", d, d)
    d[ids == query] = np.inf
    if len(d) > 4 * k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        near = np.arange(len(d))
    near = near[np.lexsort((ids[near], d[near]))][:k]
    return (near := near[np.isfinite(d[near])]), np.sqrt(d[near])


def build(rows: DataFrame, sample: int = SAMPLE) -> tuple[KMeansTree | None, DataFrame]:
    """The tree and the index: vec_id, v, leaf and a number ``row`` (unique in its task) for every usable row. No tree if there are none."""
    v = usable(rows)
    got = hashed_sample(v, "vec_id", sample, v.count()).toPandas()
    if got.empty:
        return None, v.withColumns({"leaf": F.lit(0), "row": F.lit(0).cast("long")})
    tree = KMeansTree(np.stack(got["v"]))
    held = v.sparkSession.sparkContext.broadcast(tree)

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for f in frames:
            f["leaf"] = held.value.assign(np.stack(f["v"])) if len(f) else np.empty(0, np.int64)
            f["row"], n = np.arange(n, n + len(f)), n + len(f)
            yield f

    return tree, staged(v.mapInPandas(file, "vec_id long, v array<double>, leaf int, row long"), "vectors")


def calibrate(tree: KMeansTree, index: DataFrame, queries: DataFrame, k: int, target: float = TARGET, probes: int = PROBES) -> int:
    """The least number of leaves that hold ``target`` of the true neighbours of ``probes`` queries; those are found by brute force."""
    some = hashed_sample(queries, "vec_id", probes, queries.count()).toPandas()
    if some.empty:
        return 1
    held = index.sparkSession.sparkContext.broadcast((some["query"].to_numpy(), some["vec_id"].to_numpy(), np.stack(some["v"])))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            ids, v, leaf = f["vec_id"].to_numpy(), np.stack(f["v"]), f["leaf"].to_numpy()
            for n, q, x in zip(*held.value, strict=True):
                near, score = _nearest(ids, v, q, x, k)
                yield pd.DataFrame({"query": n, "query_id": q, "vec_id": ids[near], "score": score, "leaf": leaf[near]})

    true = top(index.mapInPandas(scan, f"{FOUND}, leaf int"), k).select("query", "leaf").toPandas()
    ranks = []
    for q, x in zip(some["query"], some["v"], strict=True):
        at = {leaf: n for n, leaf in enumerate(tree.visits(np.asarray(x)))}
        ranks += [at[leaf] for leaf in true.loc[true["query"] == q, "leaf"]]
    visits = 1
    while ranks and np.mean(np.array(ranks) < visits) < target:
        visits += 1
    return visits


def top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, with rank; ties go to the smaller vec_id."""
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(rows: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score of the ``k`` nearest found for each row whose id is divisible by ``every``.

    Candidates are all usable rows with another id, each row for itself where rows repeat an
    id. Query rows that repeat id and vector are one query; those that repeat an id only are
    queries of their own, with a list each. Vectors that are null, zero, hold nulls or
    non-finite numbers, or have another length than most take no part, nor do null ids; an
    empty table gives an empty result. Other columns are not read. A query visits more leaves
    than calibrated if those hold fewer than ``k`` candidates.
    """
    tree, index = build(rows)
    if tree is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.filter(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    queries = staged(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    visits = calibrate(tree, index, queries, k)
    counts = _by_leaf(index, tree)
    blocks = np.maximum(1, -(-counts // BLOCK))
    held = index.sparkSession.sparkContext.broadcast((tree, counts))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, counts = held.value
        for f in frames:
            for n, q, x in zip(f["query"], f["vec_id"], f["v"], strict=True):
                own, seen = [], 0
                for i, leaf in enumerate(tree.visits(np.asarray(x))):
                    if i >= visits and seen > k:
                        break
                    seen += counts[leaf]
                    if counts[leaf]:
                        own.append(leaf)
                yield pd.DataFrame({"query": n, "query_id": q, "leaf": own})

    walks = staged(queries.mapInPandas(walk, "query long, query_id long, leaf int"), "walks")
    chunks = np.maximum(1, -(-_by_leaf(walks, tree) // CHUNK))
    # a number for each leaf of the bounded tree: in how many blocks and chunks it comes
    sizes = index.sparkSession.createDataFrame([(leaf, int(b), int(c)) for leaf, (b, c) in enumerate(zip(blocks, chunks, strict=True))], "leaf int, blocks int, chunks int")
    sizes = F.broadcast(sizes)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, v = right["vec_id"].to_numpy(), np.stack(right["v"])
        found = [(n, q, *_nearest(ids, v, q, np.asarray(x), k)) for n, q, x in zip(left["query"], left["query_id"], left["v"], strict=True)]
        near, n = np.concatenate([f[2] for f in found]), [len(f[2]) for f in found]
        return pd.DataFrame({"query": np.repeat([f[0] for f in found], n), "query_id": np.repeat([f[1] for f in found], n), "vec_id": ids[near], "score": np.concatenate([f[3] for f in found])})

    key = ["leaf", "block", "chunk"]
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = walks.join(sizes, "leaf").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int")).withColumn("block", every_one("blocks"))
    asked = asked.join(queries.select("query", "v"), "query").select(*key, "query", "query_id", "v")
    filed = index.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.col("blocks")).cast("int")).withColumn("chunk", every_one("chunks"))
    found = asked.groupBy(*key).cogroup(filed.select(*key, "vec_id", "v").groupBy(*key)).applyInPandas(compare, FOUND)
    return top(found, k).select("query_id", "rank", "vec_id", "score")


def _by_leaf(rows: DataFrame, tree: KMeansTree) -> np.ndarray:
    """How many rows each leaf of the (bounded) tree has."""
    counts = np.zeros(tree.leaves, np.int64)
    for r in rows.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    return counts


def op10_ann(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
