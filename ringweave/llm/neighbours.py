"""Nearest neighbours by a block matrix join over int8 product tiles.

Vectors are scaled to length one and quantised to int8 with a scale each. A tile is the product of a
block of queries and a block of candidates, computed on the int8 values (whole numbers, so exact in
float32 up to 1040 components, in float64 beyond). With e the quantised vector's error, a pair's cosine
lies within |eq| + |ec| + |eq||ec| of the tile's figure, so a candidate whose upper bound is under the
k-th best lower bound of its query can be dropped without loss. Survivors are recomputed in double
from the original vectors and kept in a heap per query. A task hands on k rows per query at most, and a
ranking per query, which drops rows in each task before they are shuffled, merges them. The result is exact.

Queries of at most `block_bytes` are broadcast and read by all candidates in one pass, without a shuffle.
More are dealt to a grid: blocks of queries of that size against blocks of candidates of `row_bytes`, a task
for each pair of blocks, so no task and no broadcast grows with the table. Rows are dealt by their place, so
repeated ids are dealt like others.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
rows with a null id; only vectors of equal length are compared; ties go to the smaller vec_id; a query is
never its own candidate (rows with the query's id are left out); rows repeated under other ids are
candidates, and repeated rows are found as often as they occur; without queries or candidates there are no
rows; only the id and the vector are read of a table's columns.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FOUND = "query_id long, vec_id long, score double"


class Block:
    """Vectors of one length with their quantised form."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.size = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        unit = vectors / self.size[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        exact = np.float32 if vectors.shape[1] <= 1040 else np.float64
        self.q = np.rint(unit / scale[:, None]).astype(np.int8)
        self.scale = scale
        error = unit - self.q * scale[:, None]
        self.error = np.sqrt(np.einsum("ij,ij->i", error, error)) + 1e-9
        self.wide = self.q.astype(exact)


def usable(vectors: list) -> np.ndarray:
    """Which vectors take part."""
    out = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            a = np.asarray(v, float)
            with np.errstate(over="ignore"):
                size = float(np.dot(a, a))
            out[i] = np.isfinite(size) and size > 0
    return out


def blocks(ids: list, vectors: list) -> dict[int, Block]:
    """Usable vectors by their length."""
    by: dict[int, tuple[list, list]] = {}
    for i, v, ok in zip(ids, vectors, usable(vectors), strict=True):
        if ok and i is not None:
            at = by.setdefault(len(v), ([], []))
            at[0].append(i)
            at[1].append(v)
    return {n: Block(np.array(a, np.int64), np.array(b, float)) for n, (a, b) in by.items()}


def tile(queries: Block, rows: Block, k: int, heaps: list[list]) -> None:
    """Offers rows to the heaps of the queries, by way of the int8 product and its bounds."""
    near = (queries.wide @ rows.wide.T).astype(float) * queries.scale[:, None] * rows.scale[None, :]
    slack = queries.error[:, None] + rows.error[None, :] + queries.error[:, None] * rows.error[None, :] + 1e-9
    low = near - slack
    low[queries.ids[:, None] == rows.ids[None, :]] = -np.inf
    floor = np.array([h[0][0] if len(h) >= k else -np.inf for h in heaps])
    if low.shape[1] > k:
        kth = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        floor = np.maximum(floor, kth)
    at, of = np.nonzero(near + slack >= floor[:, None])
    if not len(at):
        return
    for lo in range(0, len(at), 65536):
        a, c = at[lo : lo + 65536], of[lo : lo + 65536]
        score = np.einsum("ij,ij->i", queries.vectors[a], rows.vectors[c]) / (queries.size[a] * rows.size[c])
        for i, s, r, q in zip(a.tolist(), score.tolist(), rows.ids[c].tolist(), queries.ids[a].tolist(), strict=True):
            if r != q:
                (heapq.heappush if len(heaps[i]) < k else heapq.heappushpop)(heaps[i], (s, -r))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = 16_000_000, row_bytes: int = 64_000_000, tile_rows: int = 1024) -> DataFrame:
    """The k nearest rows of `vectors` by cosine for each row of `queries`, ranked from 1."""
    own = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows, asked = own(vectors), own(queries)
    size = lambda df: df.agg(F.sum(F.size("v") * 10 + 16)).first()[0] or 0
    bytes_asked = size(asked)
    if bytes_asked <= block_bytes:
        got = asked.toArrow()
        built = blocks(got.column(0).to_pylist(), [v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in got.column(1)])
        found = rows.mapInArrow(_searcher(rows.sparkSession.sparkContext.broadcast(built), k, tile_rows), _FOUND)
    else:
        parts, deals = -(-bytes_asked // block_bytes), max(1, -(-size(rows) // row_bytes))
        dealt = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        of_queries = dealt(asked, "q", parts, "c", deals).groupBy("q", "c")
        found = of_queries.cogroup(dealt(rows, "c", deals, "q", parts).groupBy("q", "c")).applyInArrow(lambda a, b: _paired(a, b, k, tile_rows), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched(asked: dict[int, Block], parts: Iterator[pa.Table | pa.RecordBatch], k: int, tile_rows: int) -> list[pa.Array]:
    """The k best of the parts' rows for each query: query_id, vec_id and score."""
    heaps = {n: [[] for _ in b.ids] for n, b in asked.items()}
    for whole in parts:
        for lo in range(0, whole.num_rows, tile_rows):
            part = whole.slice(lo, tile_rows)
            for n, block in blocks(part.column("id").to_pylist(), [v.values.to_numpy(zero_copy_only=False) for v in part.column("v")]).items():
                if n in asked:
                    for q in range(0, len(asked[n].ids), tile_rows):
                        tile(_part(asked[n], q, q + tile_rows), block, k, heaps[n][q : q + tile_rows])
    out = [(int(q), -r, s) for n, b in asked.items() for q, h in zip(b.ids, heaps[n], strict=True) for s, r in h]
    return [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]


def _searcher(shared, k: int, tile_rows: int):
    return lambda batches: iter([pa.RecordBatch.from_arrays(_searched(shared.value, batches, k, tile_rows), ["query_id", "vec_id", "score"])])


def _paired(queries: pa.Table, rows: pa.Table, k: int, tile_rows: int) -> pa.Table:
    asked = blocks(queries.column("id").to_pylist(), [v.values.to_numpy(zero_copy_only=False) for v in queries.column("v")])
    return pa.Table.from_arrays(_searched(asked, iter([rows]), k, tile_rows), ["query_id", "vec_id", "score"])


def _part(block: Block, a: int, b: int) -> Block:
    out = object.__new__(Block)
    for name, value in vars(block).items():
        setattr(out, name, value[a:b])
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS s FROM e WHERE list_dot_product(v, v) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (q.s * c.s) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
