"""Operator 1: approximate nearest neighbours by stable projections and kd-trees.

The largest inner product becomes the smallest distance by one more component: with M the largest norm, x is extended by
sqrt(M^2 - |x|^2) and the query, scaled to norm M, by 0. A few Gaussian (2-stable) projections of the extended vectors span the
space that is indexed: the squared projected distance of a point, divided by its squared distance, follows a chi-square
distribution with as many degrees of freedom as projections.

The upper levels of the kd-tree, fitted on a bounded sample, deal all vectors to cells, which are the groups that tasks work on;
each cell has its own kd-tree. A query searches its own cell first, then the others that the test leaves open. In a cell
it visits leaves in order of projected distance and verifies their vectors by the exact inner product. It stops when, for the
next leaf at projected distance p and the k-th best distance d so far, chi-square(p^2 / d^2) reaches ``stop``: a vector nearer than
the k-th would have been seen with that probability. Until then nothing is capped.

Cells of more than ``BLOCK`` vectors (repeated vectors can't be parted by planes) are cut by a hash of the id, and queries
of a cell into chunks, so a task holds a bounded number of both.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. A query
never finds rows of its own id; repeated rows of an id count once. With fewer than k candidates all are found. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from phenoline.llm.common import stored

PROJECTIONS = 8
LEAF = 256
BLOCK = 8192
CHUNK = 8192
CELLS = (16, 4096)
SAMPLE_PER_CELL = 64


def chi_square(x: np.ndarray) -> np.ndarray:
    """Distribution function with PROJECTIONS (an even number of) degrees of freedom."""
    half = np.minimum(x / 2, 700.0)
    term = np.ones_like(half)
    total = np.ones_like(half)
    for i in range(1, PROJECTIONS // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the vectors that take part, one row an id, and their length."""
    v = F.col(vector).cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & whole)
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 1
    return rows.filter(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v")), size


class Cells:
    """Planes of the upper kd-tree levels over projected vectors, as a full binary tree, and the boxes of its leaves."""

    def __init__(self, points: np.ndarray, cells: int):
        self.depth = int(math.log2(cells))
        self.axis, self.at = np.zeros(cells, np.int64), np.zeros(cells)
        boxes = [(np.full(PROJECTIONS, -np.inf), np.full(PROJECTIONS, np.inf))]
        groups = [points]
        for level in range(self.depth):
            next_boxes, next_groups = [], []
            for i, (box, group) in enumerate(zip(boxes, groups)):
                node = (1 << level) + i
                axis = int(np.argmax(group.max(0) - group.min(0))) if len(group) else level % PROJECTIONS
                at = float(np.median(group[:, axis])) if len(group) else 0.0
                self.axis[node], self.at[node] = axis, at
                low, high = (box[0].copy(), box[1].copy()), (box[0].copy(), box[1].copy())
                low[1][axis], high[0][axis] = min(low[1][axis], at), max(high[0][axis], at)
                next_boxes += [low, high]
                next_groups += [group[group[:, axis] < at], group[group[:, axis] >= at]]
            boxes, groups = next_boxes, next_groups
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            axis = self.axis[node]
            node = 2 * node + (points[np.arange(len(points)), axis] >= self.at[node])
        return node - (1 << self.depth)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        p = points[:, j : j + 1]
        gap = np.maximum(np.maximum(low[None, :, j] - p, p - high[None, :, j]), 0)
        out += gap * gap
    return out


class Projection:
    def __init__(self, size: int, largest: float, seed: int):
        self.largest = largest
        self.matrix = np.random.default_rng(seed).standard_normal((size + 1, PROJECTIONS))

    def points(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(1), 0))
        return x @ self.matrix[:-1] + more[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.largest / np.linalg.norm(q, axis=1))[:, None]) @ self.matrix[:-1]

    def squared_distance(self, score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Of a vector with that inner product with a query of that norm, after both are extended."""
        return np.maximum(2 * self.largest**2 - 2 * self.largest * score / norm, 1e-300)


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        order = np.argsort(part[:, axis], kind="stable")
        half = len(rows) // 2
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def search(projection: Projection, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, stop: float):
    """The k best of a block for each query, no worse than its ``bound`` (score of the k-th best known elsewhere, or -inf)."""
    points, asked = projection.points(x), projection.queries(q)
    norm = np.linalg.norm(q, axis=1)
    parts = leaves(points)
    low = np.array([points[r].min(0) for r in parts])
    high = np.array([points[r].max(0) for r in parts])
    best, best_id = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    gap = box_distance(asked, low, high)
    order = np.argsort(gap, axis=1, kind="stable")
    open_ = np.arange(len(q))
    for step in range(len(parts)):
        leaf = order[open_, step]
        worst = np.maximum(best[open_, -1], bound[open_])
        far = gap[open_, leaf] / projection.squared_distance(worst, norm[open_])
        go = ~(np.isfinite(worst) & (chi_square(far) >= stop))
        open_, leaf, worst = open_[go], leaf[go], worst[go]
        if not len(open_):
            break
        for number in np.unique(leaf).tolist():
            here = leaf == number
            who, rows = open_[here], parts[number]
            # Each product is summed by itself, in one order, so equal vectors have equal scores.
            score = np.einsum("qd,xd->qx", q[who], x[rows])
            score[q_ids[who][:, None] == ids[rows][None, :]] = -np.inf
            some = (score >= worst[here][:, None]).any(1)
            if not some.any():
                continue
            who, score = who[some], score[some]
            all_scores = np.concatenate([best[who], score], 1)
            all_ids = np.concatenate([best_id[who], np.broadcast_to(ids[rows], score.shape)], 1)
            top = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
            best[who] = np.take_along_axis(all_scores, top, 1)
            best_id[who] = np.take_along_axis(all_ids, top, 1)
    keep = np.isfinite(best) & (best >= bound[:, None])
    row, place = np.nonzero(keep)
    return pd.DataFrame({"query_id": q_ids[row], "vec_id": best_id[row, place], "score": best[row, place]})


def nearest(vectors: DataFrame, asks: Column, k: int = 20, stop: float = 0.98, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the rows for which ``asks`` (on vec_id) holds, against all rows."""
    rows, size = usable(vectors, key, vector)
    rows = stored(rows, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(square).alias("m")).first()
    projection = Projection(size, math.sqrt(facts["m"] or 1.0), seed)
    wanted = min(CELLS[1], max(CELLS[0], -(-facts["n"] // BLOCK)))
    cells = 1 << (wanted - 1).bit_length()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = projection.points(np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, size))
            yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.list_(pa.float64()))], names=["point"])

    # The driver gets the projections of about SAMPLE_PER_CELL vectors a cell, those with the lowest hashes.
    share = min(1.0, SAMPLE_PER_CELL * cells / max(facts["n"], 1))
    picked = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32)) <= int(share * (1 << 32))).select("v").mapInArrow(project, "point array<double>").collect()
    tree = Cells(np.array(sorted(r["point"] for r in picked), np.float64).reshape(-1, PROJECTIONS), cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, size)
            home = tree.of(projection.points(x))
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), batch.column(0), batch.column(1)], names=["cell", "vec_id", "v"])

    dealt = stored(rows.mapInArrow(deal, "cell int, vec_id long, v array<double>"), "cells")
    asked = dealt.filter(asks).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    # A row for each cell, of which there are at most CELLS[1].
    parts = F.broadcast(dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    index = dealt.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).drop("parts")

    def look(queries: DataFrame) -> DataFrame:
        """``queries``: cell, query_id, q, bound."""
        chunks = F.broadcast(queries.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
        blocks = index.join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        spread = queries.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).drop("chunks")
        spread = spread.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def run(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
            if not len(block) or not len(ask):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            x, q = np.stack(block["v"].to_numpy()), np.stack(ask["q"].to_numpy())
            return search(projection, block["vec_id"].to_numpy(), x, ask["query_id"].to_numpy(), q, ask["bound"].to_numpy(float), k, stop)

        asking = spread.select(*[F.col(c).alias(f"to_{c}") for c in ("cell", "part", "chunk")], "query_id", "q", "bound")
        pairs = blocks.groupBy("cell", "part", "chunk").cogroup(asking.groupBy("to_cell", "to_part", "to_chunk"))
        return pairs.applyInPandas(run, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    nothing = F.lit(float("-inf"))
    home = dealt.filter(asks).select("cell", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), nothing.alias("bound"))
    first = stored(best(look(home)).drop("rank"), "first")
    reached = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(nothing).alias("bound"))
    bounded = asked.join(reached, "query_id", "left").withColumn("bound", F.coalesce("bound", nothing))

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes on to every other cell that the test leaves open."""
        for batch in batches:
            q = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, size)
            bound = batch.column(2).to_numpy()
            points = projection.queries(q)
            gap = box_distance(points, tree.low, tree.high) / projection.squared_distance(bound, np.linalg.norm(q, axis=1))[:, None]
            go = ~(np.isfinite(bound)[:, None] & (chi_square(gap) >= stop))
            who, cell = np.nonzero(go)
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)],
                names=["cell", "query_id", "q", "bound"],
            )

    others = bounded.select("query_id", "q", "bound").mapInArrow(onward, "cell int, query_id long, q array<double>, bound double")
    where = dealt.filter(asks).select("cell", F.col("vec_id").alias("query_id"))
    second = look(stored(others.join(where, ["cell", "query_id"], "left_anti"), "onward"))
    return best(first.union(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
