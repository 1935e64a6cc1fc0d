"""Exact top-k search by inner product as a Voronoi join.

Data and queries are grouped by their nearest pivot. Neighbouring cells form slices of a bounded number of rows, and a cell that holds
more is cut into several. Each query is first solved in its own slice, which gives it a score that its k-th neighbour has at
least. A cell's summary (its radius and its longest member) then bounds the scores that the query can reach there, and the query is
sent only to the slices with a cell that can still reach its bound. Data stay where they are; a slice that many queries ask is repeated
for bounded groups of them. The k best of all slices remain.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import Scratch

#: Rows of a slice at most, about: queries and data of a task.
QUERY_SLICE, DATA_SLICE = 2048, 4096
#: Pivots at most, 2 MB of 64 dimensions; below that their number is the square root of the rows, and at least this many.
MOST_CELLS, LEAST_CELLS = 4096, 16
#: Queries whose scores a task holds at a time.
CHUNK = 128


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column, scale: int = 64) -> Column:
    """Whether a vector is neither null nor holds a null, a NaN, an infinity, or a component so large that a score may not be a long:
    2 ** 31 over the root of the vector's length, once scaled."""
    most = F.lit(2.0**31 / scale) / F.sqrt(F.size(vector))
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))
    return F.coalesce(vector.isNotNull() & plain, F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column; missing components of shorter vectors are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), flat.dtype)
    for i, row in enumerate(column.to_pylist()):
        out[i, : len(row)] = row
    return out


def _assigner(pivots: np.ndarray):
    half = (pivots**2).sum(1) / 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), pivots.shape[1]).astype(np.float64)
            cell = (half - x @ pivots.T).argmin(1) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            columns = [*(batch.column(c) for c in ("uid", "vec_id", "is_query")), pa.array(cell.astype(np.int32)), pa.array(away), batch.column("v")]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "vec_id", "is_query", "cell", "away", "v"])

    return assign


def slices_of(pivots: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """First slice and number of slices of each cell, and the cells of each slice. Small neighbouring cells share a slice."""
    middle = pivots - pivots.mean(0)
    axes = np.linalg.svd(middle, full_matrices=False)[2][:1] if len(pivots) > 1 else np.zeros((1, pivots.shape[1]))
    first, parts, held, room = np.zeros(len(pivots), int), np.ones(len(pivots), int), [], 0
    for cell in np.argsort(middle @ axes[0], kind="stable"):
        if count[cell] > most:
            parts[cell] = -(-count[cell] // most)
            first[cell] = len(held)
            held += [[int(cell)] for _ in range(parts[cell])]
            room = 0
        else:
            if count[cell] > room or not held:
                held.append([])
                room = most
            held[-1].append(int(cell))
            first[cell] = len(held) - 1
            room -= count[cell]
    return first, parts, held


def best_scores(queries: np.ndarray, pivots: np.ndarray, radius: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """(query, cell): no member of the cell scores more; minus infinity for empty cells.

    q x = q p + q (x - p), and neither part exceeds the product of the lengths.
    """
    size = np.sqrt((queries**2).sum(1))[:, None]
    by_radius = queries @ pivots.T + size * np.maximum(radius, 0)
    bound = np.minimum(by_radius, size * longest)
    return np.where(radius >= 0, bound + 1e-9 * (1 + np.abs(bound)) + 1e-6, -np.inf)


def _asker(pivots: np.ndarray, radius: np.ndarray, longest: np.ndarray, slices: list[list[int]]):
    """Sends each query to the slices, other than its own, that may hold one of its k best."""
    order = np.array([c for own in slices for c in own], int)
    starts = np.cumsum([0, *map(len, slices)])[:-1]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                x = _matrix(part.column("v"), pivots.shape[1]).astype(np.float64)
                best = np.maximum.reduceat(best_scores(x, pivots, radius, longest)[:, order], starts, axis=1)
                open_ = best >= part.column("least").to_numpy(zero_copy_only=False)[:, None]
                open_[np.arange(len(x)), part.column("slice").to_numpy()] = False
                row, to = np.nonzero(open_)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("uid", "vec_id", "v")), pa.array(to.astype(np.int32))], ["uid", "vec_id", "v", "slice"])

    return ask


def best_of_block(queries: np.ndarray, query_uid: np.ndarray, data: np.ndarray, data_uid: np.ndarray, vec_id: np.ndarray, k: int):
    """(query row, data row, score) of each query's k best rows but its own; ties go to the smaller vec_id, then to the smaller uid."""
    order = np.lexsort((data_uid, vec_id))
    data, data_uid = data[order], data_uid[order]
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(data).max(initial=0)) * queries.shape[1]
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
    q, x = queries.astype(kind), data.astype(kind).T.copy()
    m, by_uid = len(order), np.argsort(data_uid)
    own = by_uid[np.minimum(np.searchsorted(data_uid[by_uid], query_uid), m - 1)]
    is_own = data_uid[own] == query_uid
    for at in range(0, len(q), CHUNK):
        scores = q[at : at + CHUNK] @ x
        rows = np.arange(len(scores))
        if most * 2 * m < 1 << 62:  # a score and a place as one number
            keyed = scores.astype(np.int64) * m + (m - 1 - np.arange(m))
            keyed[rows[is_own[at : at + CHUNK]], own[at : at + CHUNK][is_own[at : at + CHUNK]]] = np.iinfo(np.int64).min
            top = np.argpartition(keyed, m - k, axis=1)[:, m - k :] if m > k else np.broadcast_to(np.arange(m), (len(rows), m))
        else:
            top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
        i, j = np.repeat(rows, top.shape[1]), top.ravel()
        other = ~is_own[at + i] | (own[at + i] != j)
        yield at + i[other], order[j[other]], scores[i[other], j[other]].astype(np.int64)


def _solver(dims: int, k: int):
    names = ["q_uid", "query_id", "uid", "vec_id", "score"]

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        q_uid, query_id = (left.column(c).to_numpy() for c in ("uid", "vec_id"))
        uid, vec_id = (right.column(c).to_numpy() for c in ("uid", "vec_id"))
        parts = [np.zeros((5, 0), np.int64)]
        if len(q_uid) and len(uid):
            for i, j, score in best_of_block(_matrix(left.column("v"), dims), q_uid, _matrix(right.column("v"), dims), uid, vec_id, k):
                parts.append(np.stack([q_uid[i], query_id[i], uid[j], vec_id[j], score]))
        return pa.table(dict(zip(names, np.concatenate(parts, axis=1))))

    return solve


def top_k(vectors: DataFrame, query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `query` holds, the k rows of highest integer inner product but itself.

    Ties go to the smaller key. Unusable vectors, those whose scores may not be a long among them, and rows without a key take no part. Of vectors of unequal length the shorter
    counts as filled with zeros. Rows that share a key are rows of their own, each a candidate of the others. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "knn")
    ready = vectors.where(usable(F.col(vector), scale) & F.col(key).isNotNull()).select(
        F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("is_query"), quantised(F.col(vector), scale).alias("v")
    )
    ready = scratch.keep(ready, "ready")
    size = ready.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).head()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, dims = size["n"], max(1, size["dims"])
    if (size["most"] or 0) < 1 << 15:
        ready = ready.withColumn("v", F.col("v").cast("array<smallint>"))
    cells = min(MOST_CELLS, n, max(LEAST_CELLS, round(sqrt(n))))
    # pivots are a sample of bounded size: by hash, about twice as many as needed
    share = min(1.0, 2 * cells / n + 10 / n)
    mark = F.pmod(F.xxhash64("uid"), F.lit(1 << 30))
    picked = ready.where(mark < int(share * (1 << 30)) + 1).select(mark.alias("mark"), "v").orderBy("mark").limit(cells).collect()
    if not picked:
        picked = ready.select("v").limit(1).collect()
    pivots = np.zeros((len(picked), dims))
    for i, row in enumerate(picked):
        pivots[i, : len(row["v"])] = row["v"]
    pivots = np.unique(pivots, axis=0)
    kind = "smallint" if (size["most"] or 0) < 1 << 15 else "bigint"
    placed = ready.mapInArrow(_assigner(pivots), f"uid long, vec_id long, is_query boolean, cell int, away double, v array<{kind}>")
    placed = scratch.keep(placed, "placed")

    count, radius, longest = np.zeros(len(pivots), int), np.full(len(pivots), -1.0), np.zeros(len(pivots))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far"), F.max(length).alias("longest")).collect():
        count[r["cell"]], radius[r["cell"]], longest[r["cell"]] = r["n"], r["far"], r["longest"]
    first, parts, slices = slices_of(pivots, count, DATA_SLICE)
    where = F.broadcast(spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(len(pivots))], "cell int, first int, parts int"))  # a row for each pivot
    data = placed.join(where, "cell").select("uid", "vec_id", "is_query", "v", (F.col("first") + F.pmod(F.xxhash64("uid", F.lit(7)), F.col("parts"))).cast("int").alias("slice"))
    data = scratch.keep(data, "data")
    queries, found = data.where("is_query"), "q_uid long, query_id long, uid long, vec_id long, score long"
    plain = data.select("slice", "uid", "vec_id", "v")
    home = queries.select("slice", "uid", "vec_id", "v").groupBy("slice").cogroup(plain.groupBy("slice")).applyInArrow(_solver(dims, k), found)
    home = scratch.keep(home, "home")
    least = home.groupBy("q_uid").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("least"))
    known = queries.join(least, F.col("uid") == F.col("q_uid"), "left").select("uid", "vec_id", "v", "slice", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    asked = known.mapInArrow(_asker(pivots, radius, longest, slices), f"uid long, vec_id long, v array<{kind}>, slice int")
    asked = scratch.keep(asked, "asked")

    groups = asked.groupBy("slice").agg(F.ceil(F.count("*") / QUERY_SLICE).cast("int").alias("groups"))
    asking = asked.join(groups, "slice").withColumn("part", F.pmod(F.xxhash64("uid", F.lit(11)), F.col("groups")).cast("int"))
    given = plain.join(groups, "slice").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    asking, given = (x.select("slice", "part", "uid", "vec_id", "v").groupBy("slice", "part") for x in (asking, given))
    solved = home.unionByName(asking.cogroup(given).applyInArrow(_solver(dims, k), found))
    best = Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
