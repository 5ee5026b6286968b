"""Exact top-k search by inner product: a Voronoi kNN join.

  1. A few rows with the smallest hashes of their ids are pivots; every vector belongs to its nearest pivot's cell.
  2. Summaries: per cell of the data its radius and a few members; per cell of the queries its radius and theta,
     the smallest of its queries' k-th best scores over all members. No query needs a row that scores below theta.
  3. Bounds, from q.x <= p.x + |q - p| |x| for a query q in the cell of pivot p: first per pair of cells (with
     the data cell's radius), then per row. A row is replicated only to groups of query cells that it may serve.
  4. Query cells are packed into groups of about `group_queries`; a larger cell is cut into several groups. A
     group's rows are dealt over as many tasks as its counted replicas need, its queries copied to each, and
     every task solves its part exactly in numpy. The k best of a query's parts are its result.

Only pivots, members and summaries (bounded by `n_pivots`) reach the driver. A hot vector that makes up a
third of all rows is just a heavy cell: its queries and rows are dealt over many tasks.

Scores are exact 64-bit integers of integer vectors as long as they fit; float arithmetic is used only where it is exact.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no part.
Shorter vectors count as padded with zeros. A query never meets rows with its own id. Repeated data rows each count as a
candidate; a repeated query is answered once. Ties go to the smaller id. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cilake.session import written

N_PIVOTS = 128
MEMBERS = 32
GROUP_QUERIES = 512
TASK_ROWS = 32_768
STRIP = 64


def scaled(values: np.ndarray, factor: float) -> np.ndarray:
    return np.floor(values * factor)


def vectors(rows: DataFrame, vec_id: str, embedding: str, factor: float) -> DataFrame:
    """vec_id, v: the components floor(factor * x) as packed doubles, of rows that take part."""
    flat = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    width = flat.agg(F.max(F.size("embedding"))).first()[0] or 0

    def pack(batches):
        for b in batches:
            ids, packed = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = scaled(v.values.to_numpy(zero_copy_only=False).astype(float), factor)
                if np.isfinite(x).all():
                    ids.append(i)
                    packed.append(np.pad(x, (0, width - len(x))).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    return flat.mapInArrow(pack, "vec_id bigint, v binary")


def matrix(column: pa.Array) -> np.ndarray:
    """Packed doubles of a batch as one matrix."""
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed)).reshape(len(packed), -1) if packed else np.zeros((0, 0))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as integers."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance to its pivot) of each row."""
    square = (pivots**2).sum(axis=1) - 2 * (x @ pivots.T)
    cell = square.argmin(axis=1)
    return cell, np.sqrt(np.maximum(((x - pivots[cell]) ** 2).sum(axis=1), 0))


def top(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(score) > k:
        some = np.nonzero(score >= np.partition(score, -k)[-k])[0]
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:k]


def with_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    def assign(batches):
        for b in batches:
            if b.num_rows:
                cell, away = nearest(matrix(b.column(1)), pivots)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(away)],
                                                 names=["vec_id", "v", "cell", "away"])

    return rows.mapInArrow(assign, "vec_id bigint, v binary, cell int, away double")


def with_theta(queries: DataFrame, member_ids: np.ndarray, members: np.ndarray, k: int) -> DataFrame:
    """Add the k-th best score over the members (minus infinity where they are fewer)."""

    def bound(batches):
        for b in batches:
            if not b.num_rows:
                continue
            theta = np.full(b.num_rows, -np.inf)
            own = b.column(0).to_numpy()
            q = matrix(b.column(1))
            for a in range(0, len(q), STRIP):
                got = scores(q[a : a + STRIP], members).astype(float)
                got[own[a : a + STRIP][:, None] == member_ids[None, :]] = -np.inf
                if got.shape[1] >= k:
                    theta[a : a + STRIP] = np.partition(got, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(theta)], names=[*b.schema.names, "theta"])

    return queries.mapInArrow(bound, "vec_id bigint, v binary, cell int, away double, theta double")


class Plan:
    """What the driver knows: pivots, bounds per cell of queries, and which groups a cell's queries form."""

    def __init__(self, pivots: np.ndarray, query_cells: list, data_cells: list, group_queries: int):
        self.pivots = pivots
        self.radius = np.zeros(len(pivots))
        self.theta = np.full(len(pivots), np.inf)
        counts = np.zeros(len(pivots), np.int64)
        for r in query_cells:
            counts[r["cell"]], self.radius[r["cell"]], self.theta[r["cell"]] = r["n"], r["radius"], r["theta"]
        # groups lo..hi of each cell, packed along a walk from pivot to nearest unvisited pivot
        self.low, self.high = np.full(len(pivots), -1), np.full(len(pivots), -1)
        group, held = 0, 0
        for c in self._walk(np.nonzero(counts)[0]):
            if held and held + counts[c] > group_queries:
                group, held = group + 1, 0
            parts = -(-int(counts[c]) // group_queries)
            self.low[c], self.high[c] = group, group + parts - 1
            group, held = (group, held + counts[c]) if parts == 1 else (group + parts, 0)
        self.parts = self.high - self.low + 1
        # bound per pair of (data cell, query cell)
        norm = np.sqrt((pivots**2).sum(axis=1))
        reach = np.full(len(pivots), -np.inf)
        for r in data_cells:
            reach[r["cell"]] = r["radius"]
        spread = norm[None, :] * reach[:, None] + self.radius[None, :] * (norm + reach)[:, None]
        self.may = self._passes(pivots @ pivots.T + spread)

    def _walk(self, cells: np.ndarray) -> list[int]:
        left, out = list(cells), []
        while left:
            here = self.pivots[out[-1]] if out else self.pivots[left[0]]
            out.append(left.pop(int(((self.pivots[left] - here) ** 2).sum(axis=1).argmin())))
        return out

    def _passes(self, bound: np.ndarray) -> np.ndarray:
        """True where a score of `bound` could matter; rounding errors are given room."""
        return (self.low >= 0) & (bound + 1e-9 * np.abs(bound) + 1e-6 >= self.theta)

    def needed(self, cell: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query cell) pairs: the first cell of each run of groups that the row may serve."""
        length = np.sqrt((x**2).sum(axis=1))
        ok = self.may[cell] & self._passes(x @ self.pivots.T + self.radius[None, :] * length[:, None])
        row, to = np.nonzero(ok)
        _, first = np.unique(np.stack([row, self.low[to]]), axis=1, return_index=True)
        return row[first], to[first]


def replicas(data: DataFrame, plan: Plan) -> DataFrame:
    """vec_id, v, low, high: each row once for every run of groups it may serve."""

    def send(batches):
        for b in batches:
            row, to = plan.needed(b.column(2).to_numpy(), matrix(b.column(1))) if b.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), b.column(1).take(pa.array(row, pa.int64())),
                 pa.array(plan.low[to], pa.int32()), pa.array(plan.high[to], pa.int32())], names=["vec_id", "v", "low", "high"])

    return data.mapInArrow(send, "vec_id bigint, v binary, low int, high int")


def knn_join(queries: DataFrame, data: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding",
             factor: float = 1.0, n_pivots: int = N_PIVOTS, members: int = MEMBERS, group_queries: int = GROUP_QUERIES,
             task_rows: int = TASK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of `data` with the largest inner products for each query."""
    spark = data.sparkSession
    base = written(vectors(data, vec_id, embedding, factor), "vectors")
    first = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).select("v").toArrow()["v"].to_pylist()
    asked = vectors(queries, vec_id, embedding, factor).dropDuplicates(["vec_id"])
    if not first:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = np.unique(np.stack([np.frombuffer(x) for x in first]), axis=0)
    data_cells = written(with_cells(base, pivots), "cells")
    order = Window.partitionBy("cell").orderBy(F.xxhash64("vec_id"), "vec_id")
    some = data_cells.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= members).select("vec_id", "v").toArrow()
    member_ids, member_vectors = some["vec_id"].to_numpy(), matrix(some["v"])
    query_cells = written(with_theta(with_cells(asked, pivots), member_ids, member_vectors, k), "queries")
    plan = Plan(pivots,
                query_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.min("theta").alias("theta")).collect(),
                data_cells.groupBy("cell").agg(F.max("away").alias("radius")).collect(), group_queries)
    sent = replicas(data_cells, plan)
    tasks = np.zeros(plan.high.max(initial=0) + 1, np.int32)  # by the first group of a run
    for r in sent.groupBy("low").count().collect():
        tasks[r["low"]] = -(-r["count"] // task_rows)

    @F.arrow_udf("int")
    def tasks_of(low: pa.Array) -> pa.Array:
        return pa.array(tasks[low.to_numpy(zero_copy_only=False)])

    @F.arrow_udf("struct<low:int,parts:int>")
    def groups_of(cell: pa.Array) -> pa.Array:
        at = cell.to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(plan.low[at], pa.int32()), pa.array(plan.parts[at], pa.int32())], ["low", "parts"])

    dealt = sent.withColumn("n", tasks_of("low")).select(
        F.explode(F.sequence("low", "high")).alias("group"), F.pmod(F.xxhash64("vec_id", F.lit("task")), F.col("n")).cast("int").alias("task"),
        F.lit(False).alias("asks"), "vec_id", "v")
    asks = query_cells.withColumn("g", groups_of("cell")).select("vec_id", "v", "g.low", "g.parts").withColumn("n", tasks_of("low"))
    asks = asks.filter("n > 0").select(
        (F.col("low") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).alias("group"),
        F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("task"), F.lit(True).alias("asks"), "vec_id", "v")

    def solve(part: pa.Table) -> pa.Table:
        asking = part["asks"].to_numpy()
        ids, v = part["vec_id"].to_numpy(), matrix(part["v"].combine_chunks())
        own, q, cand, x = ids[asking], v[asking], ids[~asking], v[~asking]
        out: list[tuple] = []
        for a in range(0, len(q) if len(x) else 0, STRIP):
            for i, row in zip(own[a : a + STRIP].tolist(), scores(q[a : a + STRIP], x), strict=True):
                other = np.nonzero(cand != i)[0]
                best = other[top(cand[other], row[other], k)]
                out += zip([i] * len(best), cand[best].tolist(), row[best].tolist(), strict=True)
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    parts = dealt.unionByName(asks).groupBy("group", "task").applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
