"""Approximate nearest neighbours: a forest of random-projection trees, searched through one shared priority queue.

Fit: on at most ``SAMPLE_ROWS`` vectors (a documented bound), each tree splits at the median of the projection on the
difference of two random sample vectors, as deep as it takes for leaves of about ``LEAF_ROWS`` rows, but not below
``LEAST_SAMPLE`` sample vectors a leaf. Index: every row goes down every tree. Search: a query keeps one queue over the
nodes of all trees, ordered by the squared margins violated on the way, and opens leaves until those opened hold
``visit_share`` times the number of indexed rows (a row counts once a tree) or all are open. Rerank: leaves and the
queries that opened them meet in blocks of bounded size; a row that a query meets in several trees is scored in the first
of them only. Each block gives a query its k best by exact cosine in double precision; the k best of all blocks are the
answer.

The share is found when the forest is fitted: the smallest of ``SHARES`` at which sample vectors find ``RECALL`` of their
k nearest in the sample. Vectors without structure, where near neighbours are hardly nearer than the rest, need most of
all rows; clustered vectors reach the same recall with far less. Equal vectors are indexed once, with their k + 1 smallest
ids, which is all that a query can need of them. Vectors of each length are searched apart; up to ``BLOCK_ROWS`` of a
length are one block, compared exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE_ROWS = 16_384
TREES = 12
LEAF_ROWS = 512
LEAST_SAMPLE = 8
SHARES = (0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0)
RECALL, PROBES = 0.97, 200
BLOCK_ROWS = 4_096


class Forest:
    """Complete binary trees: planes[tree, node] and offsets[tree, node], children of node i at 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        self.trees, self.depth, self.leaves = trees, depth, 2**depth
        dims = sample.shape[1]
        self.planes = np.zeros((trees, self.leaves - 1, dims))
        self.offsets = np.zeros((trees, self.leaves - 1))
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            held = [np.arange(len(sample))]
            for node in range(self.leaves - 1):
                rows = held[node]
                if len(rows) > 1:
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    plane = a - b
                    length = np.linalg.norm(plane)
                    plane = plane / length if length > 0 else rng.standard_normal(dims) / np.sqrt(dims)
                else:
                    plane = rng.standard_normal(dims) / np.sqrt(dims)
                along = sample[rows] @ plane
                middle = np.median(along) if len(rows) else 0.0
                self.planes[t, node], self.offsets[t, node] = plane, middle
                held += [rows[along <= middle], rows[along > middle]]

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.empty((len(vectors), self.trees), dtype=np.int32)
        every = np.arange(len(vectors))
        for t in range(self.trees):
            side = vectors @ self.planes[t].T > self.offsets[t]
            node = np.zeros(len(vectors), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + side[every, node]
            out[:, t] = node - (self.leaves - 1)
        return out

    def open_leaves(self, vector: np.ndarray, counts: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """Leaves in the order of one queue over all trees, until they hold enough rows; empty ones are passed over."""
        margins = self.planes @ vector - self.offsets
        queue = [(0.0, t, 0) for t in range(self.trees)]
        found, held = [], 0
        while queue and held < enough:
            cost, t, node = heapq.heappop(queue)
            while node < self.leaves - 1:
                margin = margins[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (cost + margin * margin, t, far))
                node = near
            leaf = node - (self.leaves - 1)
            if counts[t, leaf]:
                found.append((t, leaf))
                held += counts[t, leaf]
        return found


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, which is exact, so that no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = _scaled(vectors)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector of finite components that isn't zero."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists("v", lambda x: x != 0))


def needed_share(forest: Forest, sample: np.ndarray, k: int, seed: int) -> float:
    """The smallest of SHARES at which PROBES sample vectors find RECALL of their k nearest of the sample."""
    if len(sample) <= k + 1:
        return SHARES[-1]
    at = forest.leaf_of(sample)
    order = [np.argsort(at[:, t], kind="stable") for t in range(forest.trees)]
    counts = np.stack([np.bincount(at[:, t], minlength=forest.leaves) for t in range(forest.trees)])
    begins = np.cumsum(counts, axis=1) - counts
    probes = np.random.default_rng([seed, 1]).choice(len(sample), min(PROBES, len(sample)), replace=False)
    need = np.empty((len(probes), k))
    for row, i in enumerate(probes):
        near = sample @ sample[i]
        near[i] = -np.inf
        best = np.argpartition(near, -k)[-k:]
        # How many rows leaves hold until each of the k is met.
        upto, held = np.full(len(sample), np.inf), 0
        for t, leaf in forest.open_leaves(sample[i], counts, SHARES[-1] * len(sample)):
            mine = order[t][begins[t, leaf] : begins[t, leaf] + counts[t, leaf]]
            upto[mine] = np.minimum(upto[mine], held)
            held += counts[t, leaf]
        need[row] = upto[best] / len(sample)
    return next((s for s in SHARES if (need < s).mean() >= RECALL), SHARES[-1])


def _rerank(k: int):
    """A cogrouped function: the k best of a block's rows (ids, v, and if searched over trees at) for each of its queries
    (id, v, and if searched over trees t, opened)."""

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            members = _scaled(np.stack(left["v"].to_numpy()))
            lengths = np.sqrt(np.einsum("ij,ij->i", members, members))
            ids = left["ids"].to_numpy()
            places = np.stack(left["at"].to_numpy()) if "at" in left else None
            for q in right.itertuples(index=False):
                v = _scaled(np.asarray(q.v)[None, :])[0]
                mine = np.arange(len(members))
                if places is not None and q.t:
                    # Rows that an earlier tree's opened leaf holds have been scored there.
                    opened = np.unpackbits(np.frombuffer(q.opened, dtype=np.uint8), bitorder="little").reshape(places.shape[1], -1)
                    mine = np.flatnonzero(~opened[np.arange(q.t), places[:, : q.t]].astype(bool).any(axis=1))
                    if not len(mine):
                        continue
                cosine = (members[mine] @ v) / (lengths[mine] * np.sqrt(v @ v))
                # One more than k: the query's own vector may be among them. Ties at the cut stay.
                cut = np.partition(cosine, -(k + 1))[-(k + 1)] if len(cosine) > k + 1 else -np.inf
                near = [(-cosine[j], x) for j in np.flatnonzero(cosine >= cut - 1e-12) for x in ids[mine[j]] if x != q.id]
                out += [(q.id, x, -c) for c, x in sorted(near)[:k]]
        return pd.DataFrame(out, columns=["query_id", "near_id", "score"])

    return rerank


_FOUND = "query_id long, near_id long, score double"


def _searched(points: DataFrame, asked: DataFrame, total: int, dims: int, k: int, trees: int, sample_rows: int, visit_share: float | None, seed: int) -> DataFrame:
    """(query_id, near_id, score) of points (ids, v) and queries (id, v) of one length, through a forest."""
    spark = points.sparkSession
    picked = points.select("v", (F.xxhash64("v", F.lit(seed)) / 2.0**64 + 0.5).alias("u")).where(F.col("u") < 1.2 * sample_rows / max(total, 1)).orderBy("u").limit(sample_rows).select("v")
    sample = np.array([r[0] for r in picked.collect()], dtype=np.float64).reshape(-1, dims)
    sample = _unit(sample) if len(sample) else sample
    depth = max(0, min(int(np.ceil(np.log2(max(1, total / LEAF_ROWS)))), int(np.log2(max(1, len(sample) / LEAST_SAMPLE)))))
    grown = Forest(sample, trees, depth, seed)
    share = needed_share(grown, sample, k, seed) if visit_share is None else visit_share
    forest = spark.sparkContext.broadcast(grown)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at = forest.value.leaf_of(_unit(np.stack(b["v"].to_numpy())))
                yield pd.DataFrame({"at": [row.tolist() for row in at], "ids": b["ids"], "v": b["v"]})

    indexed = materialize(points.mapInPandas(place, "at array<int>, ids array<long>, v array<double>"), "ann-index")
    # Bounded by trees x leaves, whatever the number of rows.
    counts = np.zeros((trees, 2**depth), dtype=np.int64)
    for r in indexed.select(F.posexplode("at").alias("t", "leaf")).groupBy("t", "leaf").count().collect():
        counts[r["t"], r["leaf"]] = r["count"]
    blocks = np.maximum(1, -(-counts // BLOCK_ROWS))
    shared = spark.sparkContext.broadcast((counts, blocks))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, parts = shared.value
        for b in batches:
            for i, v in zip(b["id"], b["v"], strict=True):
                leaves = forest.value.open_leaves(_unit(v[None, :])[0], held, share * total)
                marks = np.zeros((trees, max(8, 2**depth)), dtype=np.uint8)
                marks[tuple(np.array(leaves).T)] = 1
                found = [(t, leaf, p) for t, leaf in leaves for p in range(parts[t, leaf])]
                yield pd.DataFrame({"t": [f[0] for f in found], "leaf": [f[1] for f in found], "part": [f[2] for f in found], "id": i, "v": [v] * len(found), "opened": [np.packbits(marks, bitorder="little").tobytes()] * len(found)})

    opened = asked.mapInPandas(search, "t int, leaf int, part int, id long, v array<double>, opened binary")
    size = F.broadcast(spark.createDataFrame([(t, leaf, int(blocks[t, leaf])) for t in range(trees) for leaf in range(2**depth)], "t int, leaf int, parts int"))
    leaf_rows = indexed.select(F.posexplode("at").alias("t", "leaf"), "ids", "v", "at")
    dealt = leaf_rows.join(size, ["t", "leaf"]).withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int"))
    return dealt.groupBy("t", "leaf", "part").cogroup(opened.groupBy("t", "leaf", "part")).applyInPandas(_rerank(k), _FOUND)


def nearest(rows: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, visit_share: float | None = None, seed: int = 42) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, <key>, score.

    queries needs key and vector columns too; a row with the query's own id is no candidate. Vectors that are null,
    empty or zero or that hold null or non-finite components take no part, nor do rows without an id. Vectors meet
    those of their own length. Repeated rows (one id, one vector) count once; ties go to the smaller id. With fewer than k
    candidates all found are given; an empty table gives no rows. visit_share: None finds it.
    """
    base, asked = usable(rows, key, vector).distinct(), usable(queries, key, vector).distinct()
    held = base.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    points = materialize(held.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-points").withColumn("dims", F.size("v"))
    asked = asked.withColumn("dims", F.size("v"))
    # Lengths of more vectors than a block holds are rows / BLOCK_ROWS at most, and few unless lengths are noise.
    many = {r["dims"]: r["count"] for r in points.groupBy("dims").count().where(F.col("count") > BLOCK_ROWS).collect()}
    rest = F.col("dims").isin(list(many)) if many else F.lit(False)
    found = points.where(~rest).groupBy("dims").cogroup(asked.where(~rest).groupBy("dims")).applyInPandas(_rerank(k), _FOUND)
    for dims, total in sorted(many.items()):
        found = found.unionByName(_searched(points.where(F.col("dims") == dims).drop("dims"), asked.where(F.col("dims") == dims).drop("dims"), total, dims, k, trees, sample_rows, visit_share, seed))
    best = found.groupBy("query_id", "near_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "near_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("near_id").alias(key), "score")
