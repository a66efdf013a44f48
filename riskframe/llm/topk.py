"""Exact inner-product top-k with ball trees.

Vectors are split into cells (nearest of at most ``MAX_PIVOTS`` pivots, drawn
by hash) and cells into shards of about ``SHARD_ROWS`` vectors, so a vector
that a third of all rows share is spread over many shards. Each task builds
the ball tree of one shard and answers a block of queries by branch and bound:
nodes in order of their upper bound q.c + |q| r, cut off by the query's
current kth score. The kth score is shared: a first round searches one shard
of each query's most promising cell, and its kth score bounds the second
round, in which a query visits only the cells whose own bound reaches it.

Queries (a stated set of rows) are sent to cells; vectors never meet each
other in pairs outside a shard. A shard is copied once for each ``QUERY_BLOCK``
queries that its cell was really asked (counted before), so the first round moves
each vector once and the second leaves out every cell that no bound reaches.

Defined results: vectors that are null or hold null, NaN or infinite
components take no part; a shorter vector counts as padded with zeros (an empty
one scores 0); rows with a null id take no part; of rows that share an id the
one with the smallest vector counts; scaled components and scores
are held to the range of a long. With fewer candidates than k, all are
returned. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import materialize

MAX_PIVOTS = 64
SHARD_ROWS = 4096
QUERY_BLOCK = 8192
LEAF = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component as longs; null where the vector takes no part."""
    v = F.col(vector)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                                  & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    scaled = lambda x: x.cast("double") * scale
    # both ends of the range of a long, as Spark's cast raises beyond them
    return F.when(ok, F.transform(v, lambda x: F.when(scaled(x) >= 2.0 ** 63, F.lit((1 << 63) - 1))
                                  .when(scaled(x) < -2.0 ** 63, F.lit(-1 << 63)).otherwise(F.floor(scaled(x)))))


def _spread(ids, parts: int) -> np.ndarray:
    """A part of 0 .. parts - 1 for each id, whatever the ids have in common."""
    mixed = np.asarray(ids, np.int64).view(np.uint64) * _ODD
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


class BallTree:
    """Nodes: centre, radius, and a range of the reordered rows."""

    def __init__(self, points: np.ndarray) -> None:
        self.rows = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, stop, left, right
        centres, radii = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            part = points[self.rows[start:stop]]
            centre = part.mean(axis=0)
            away = np.sqrt(((part - centre) ** 2).sum(axis=1))
            me = len(self.nodes)
            self.nodes.append((start, stop, -1, -1))
            centres.append(centre)
            radii.append(away.max())
            if parent >= 0:
                s, e, a, b = self.nodes[parent]
                self.nodes[parent] = (s, e, me, b) if side == 0 else (s, e, a, me)
            if stop - start > LEAF and away.max() > 0:
                one = part[away.argmax()]
                two = part[((part - one) ** 2).sum(axis=1).argmax()]
                along = part @ (two - one)
                order = np.argsort(along, kind="stable")
                self.rows[start:stop] = self.rows[start:stop][order]
                mid = (start + stop) // 2
                todo += [(start, mid, me, 0), (mid, stop, me, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, exact, query: np.ndarray, query_id: int, ids: np.ndarray, k: int,
               kth: float) -> list[tuple[int, int]]:
        """(score, id) of the k best whose score is at least ``kth``."""
        norm = float(np.sqrt((query ** 2).sum()))
        bounds = self.centres @ query + norm * self.radii
        bounds = bounds + 1e-9 * (np.abs(bounds) + norm * (self.radii + np.abs(self.centres).sum(axis=1))) + 1e-6
        open_nodes = [(-bounds[0], 0)]
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if -bound < kth:
                break
            start, stop, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= kth:
                        heapq.heappush(open_nodes, (-bounds[child], child))
                continue
            rows = self.rows[start:stop]
            scores = exact(rows, query)
            for j in np.flatnonzero(scores >= kth) if scores.dtype != object else range(len(scores)):
                score, vec = int(scores[j]), int(ids[rows[j]])
                if vec == query_id or score < kth:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -vec))
                elif (score, -vec) > best[0]:
                    heapq.heapreplace(best, (score, -vec))
                if len(best) == k:
                    kth = max(kth, best[0][0])
        return [(s, -v) for s, v in best]


def _exact(points: np.ndarray):
    """Exact integer inner products of rows with a query."""
    largest = float(np.abs(points).max(initial=0))

    def score(rows, query):
        if largest * float(np.abs(query).max(initial=0)) * points.shape[1] < 2.0 ** 53:
            return (points[rows] @ query).astype(np.int64)
        top = (1 << 63) - 1
        q = [int(x) for x in query]
        return np.array([max(-top - 1, min(top, sum(int(a) * b for a, b in zip(points[r], q)))) for r in rows], object)

    return score


def _search_shard(k: int, width: int):
    def run(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            points = _matrix(held["q"].tolist(), width)
            ids = held["vec_id"].to_numpy()
            tree, exact = BallTree(points), _exact(points)
            queries = _matrix(asked["q"].tolist(), width)
            for row, query_id, kth in zip(queries, asked["query_id"], asked["kth"]):
                out += [(int(query_id), v, s) for s, v in tree.search(
                    exact, row, int(query_id), ids, k, float("-inf") if pd.isna(kth) else float(kth))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id",
          vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score; ties go to the smaller id."""
    spark = vectors.sparkSession
    rows = materialize(
        vectors.select(F.col(key).cast("long").alias("vec_id"), quantised(vector, scale).alias("q"))
        .filter("vec_id IS NOT NULL AND q IS NOT NULL")
        .groupBy("vec_id").agg(F.min("q").alias("q")), "op2-rows")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    width = max(1, width)
    pivots = [r.q for r in rows.orderBy(F.xxhash64("q", "vec_id")).limit(MAX_PIVOTS if n > SHARD_ROWS else 1).collect()]
    centres = _matrix(pivots, width) if pivots else np.zeros((1, width))

    def assign(batches):
        for pdf in batches:
            points = _matrix(pdf["q"].tolist(), width)
            away = (points ** 2).sum(1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(1)[None, :]
            cell = away.argmin(axis=1)
            radius = np.sqrt(((points - centres[cell]) ** 2).sum(axis=1))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "q": pdf["q"], "cell": cell.astype("int32"), "radius": radius})

    celled = materialize(rows.mapInPandas(assign, "vec_id long, q array<long>, cell int, radius double"), "op2-cells")
    sizes = {r.cell: (r.n, r.r) for r in celled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("radius").alias("r")).collect()}  # one row for each pivot
    shards = {c: max(1, -(-s // SHARD_ROWS)) for c, (s, _) in sizes.items()}
    cells = spark.createDataFrame([(c, s) for c, s in shards.items()] or [(0, 1)], "cell int, shards int")
    held = celled.join(F.broadcast(cells), "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard"), "vec_id", "q")
    queries = celled.filter(is_query).select(F.col("vec_id").alias("query_id"), "q")
    order = sorted(sizes)
    centre_of = centres[order] if order else centres[:0]
    radius_of = np.array([sizes[c][1] for c in order])
    shards_of = [shards[c] for c in order]

    def goes(pdf: pd.DataFrame, first: bool) -> np.ndarray:
        """Which query goes to which cell."""
        points = _matrix(pdf["q"].tolist(), width)
        norm = np.sqrt((points ** 2).sum(1))[:, None]
        bound = points @ centre_of.T + norm * radius_of[None, :]
        bound += 1e-9 * (np.abs(bound) + norm * (radius_of + np.abs(centre_of).sum(axis=1))[None, :]) + 1e-6
        if first:
            return bound.argmax(axis=1)[:, None] == np.arange(len(order))[None, :]
        return bound >= pdf["kth"].astype("float64").fillna(float("-inf")).to_numpy()[:, None]

    def count(first: bool):
        def run(batches):
            asked = sum((goes(pdf, first).sum(axis=0) for pdf in batches), np.zeros(len(order), np.int64))
            yield pd.DataFrame({"cell": np.array(order, "int32"), "n": asked.astype("int64")})
        return run

    def send(first: bool, blocks: list[int]):
        def run(batches):
            for pdf in batches:
                out = []
                ids, go = pdf["query_id"].to_numpy(), goes(pdf, first)
                for j, c in enumerate(order):
                    at = np.flatnonzero(go[:, j])
                    block = _spread(ids[at], max(1, blocks[j]))
                    shard = _spread(ids[at] ^ 0x5555, shards_of[j]) if first else None
                    for m, i in enumerate(at):
                        kth = None if first or pd.isna(pdf["kth"].iloc[i]) else int(pdf["kth"].iloc[i])
                        for s in [int(shard[m])] if first else range(shards_of[j]):
                            out.append((int(ids[i]), pdf["q"].iloc[i], kth, c, s, int(block[m])))
                yield pd.DataFrame(out, columns=["query_id", "q", "kth", "cell", "shard", "block"]).astype({"kth": "Int64"})
        return run

    found = "query_id long, vec_id long, score long"

    def search(queries: DataFrame, first: bool) -> DataFrame:
        where = ["cell", "shard", "block"]
        counted = dict(queries.mapInPandas(count(first), "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())
        # in the first round a query asks one shard of its cell
        blocks = [-(-(counted.get(c) or 0) // (QUERY_BLOCK * (shards_of[j] if first else 1))) for j, c in enumerate(order)]
        asked = queries.mapInPandas(send(first, blocks), "query_id long, q array<long>, kth long, cell int, shard int, block int")
        copies = spark.createDataFrame([(c, n) for c, n in zip(order, blocks) if n] or [(-1, 1)], "cell int, blocks int")
        wide = (held.join(F.broadcast(copies), "cell")  # at most MAX_PIVOTS rows
                .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))
        return asked.groupBy(*where).cogroup(wide.groupBy(*where)).applyInPandas(_search_shard(k, width), found)

    if not order:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = search(queries, True)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = (first.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k)
           .select("query_id", F.col("score").alias("kth")))
    bounded = materialize(queries.join(kth, "query_id", "left"), "op2-kth")
    second = search(bounded, False)
    return (second.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
