"""Exact top-k search by tiled integer matrix products.

Queries and candidates are packed into blocks of vectors (one binary row per
block).  A tile is a query block times a candidate block; each tile is one
matrix product, of which only the k best candidates per query leave the task.
The lists are merged as a tree: inside tasks (the rank limit below the
exchange), then over groups of candidate blocks, then per query.

Tiles lie on a grid.  Query blocks are dealt to its rows, candidate blocks to its
columns, ``EDGE`` blocks to each or fewer where that gives the cores too few cells;
a query block is copied to every column and a candidate block to every row, and
both meet by an equality join on the cell.  So a block is copied once per ``EDGE``
blocks of the other side, nothing is broadcast, and a tile's memory is bounded by
two blocks.  Cells are held in the narrowest integers that are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sellerdesk.llm.common import bounded_batches
from sellerdesk.session import stage

EDGE = 32  # blocks of a row or column of the grid
BLOCK = "block long, n int, dim int, width int, ids binary, cells binary"


def narrowest(cells: np.ndarray) -> np.ndarray:
    """The cells in 2, 4 or 8 bytes each, whichever holds them all first."""
    top = int(np.abs(cells).max(initial=0))
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
    return np.ascontiguousarray(cells, kind)


def _packer(rows: int):
    """Pack (vec_id, embedding) into blocks of at most ``rows`` vectors of one dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        seq = 0

        def block(ids: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
            nonlocal seq
            order = np.argsort(ids, kind="stable")
            narrow = narrowest(cells[order])
            seq += 1
            return pa.RecordBatch.from_pydict(
                {
                    "block": [(part << 32) + seq - 1],
                    "n": pa.array([len(ids)], pa.int32()),
                    "dim": pa.array([cells.shape[1]], pa.int32()),
                    "width": pa.array([narrow.itemsize], pa.int32()),
                    "ids": [ids[order].tobytes()],
                    "cells": [narrow.tobytes()],
                }
            )

        held: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(lengths)
            cells = np.clip(np.floor(256.0 * flat), -(2.0**62), 2.0**62).astype(np.int64)
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                at = (ends[own] - dim)[:, None] + np.arange(dim)[None, :]
                held.setdefault(int(dim), []).append((ids[own].astype(np.int64), cells[at]))
                while sum(len(i) for i, _ in held[int(dim)]) >= rows:
                    i = np.concatenate([x for x, _ in held[int(dim)]])
                    m = np.concatenate([x for _, x in held[int(dim)]])
                    yield block(i[:rows], m[:rows])
                    held[int(dim)] = [(i[rows:], m[rows:])]
        for parts in held.values():
            i = np.concatenate([x for x, _ in parts])
            if len(i):
                yield block(i, np.concatenate([x for _, x in parts]))

    return pack


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact int64 products: by float64 where every sum stays under 2^53."""
    if q.shape[1] == 0:
        return np.zeros((len(q), len(c)), np.int64)
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if top < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if top < 2.0**62:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def tile_top(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best allowed columns; ties to the smaller column."""
    lowest = np.iinfo(np.int64).min
    s = np.where(allowed, scores, lowest)
    n = s.shape[1]
    if k < n:
        # everything at least as good as the k-th best is a superset; ties are
        # settled by the stable sort of the few that are left
        kth = np.partition(s, n - k, axis=1)[:, n - k]
        row, col = np.nonzero((s >= kth[:, None]) & allowed)
    else:
        row, col = np.nonzero(allowed)
    order = np.lexsort((col, ~scores[row, col], row))  # ~ reverses the order without overflow
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], col[keep]


def _tiles(k: int):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                q_ids = np.frombuffer(t["q_ids"], np.int64)
                c_ids = np.frombuffer(t["c_ids"], np.int64)
                q, c = (
                    np.frombuffer(t[f"{x}_cells"], f"i{t[f'{x}_width']}").astype(np.int64).reshape(len(i), t["dim"])
                    for x, i in (("q", q_ids), ("c", c_ids))
                )
                for lo in range(0, len(q_ids), 256):  # bounds the scores held at once
                    part = slice(lo, lo + 256)
                    scores = inner_products(q[part], c)
                    row, col = tile_top(scores, q_ids[part][:, None] != c_ids[None, :], k)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "qb": pa.array(np.full(len(row), t["qb"]), pa.int64()),
                            "q_row": pa.array(row + lo, pa.int64()),
                            "query_id": pa.array(q_ids[part][row], pa.int64()),
                            "vec_id": pa.array(c_ids[col], pa.int64()),
                            "score": pa.array(scores[row, col], pa.int64()),
                            "cb": pa.array(np.full(len(row), t["cb"]), pa.int64()),
                        }
                    )

    return products


def exact_top_k(
    vectors: DataFrame,
    is_query=None,
    k: int = 5,
    query_rows: int = 1024,
    candidate_rows: int = 4096,
    edge: int = EDGE,
) -> DataFrame:
    """Each query's k candidates with the highest integer inner products.

    ``vectors(vec_id, embedding)``: a component x counts as floor(256 x).  Rows
    whose id or vector is null, or whose vector holds null or non-finite
    components, take no part.  Only vectors of the same length are compared.
    Candidates are all rows with another id than the query's; a repeated
    candidate row counts each time, a repeated query row is answered each time.
    Ties go to the smaller vec_id.  Products beyond 64 bits are clamped.  An
    empty table or no query gives no rows.  Other columns are not read.
    Returns query_id, rank (int, from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    if is_query is None:
        is_query = F.col("vec_id") % 50 == 0
    x = F.col("embedding")
    finite = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    )
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & x.isNotNull() & finite
    )
    queries = clean.where(is_query).mapInArrow(_packer(query_rows), BLOCK)
    queries = stage(queries, "topk-queries")
    cores = spark.sparkContext.defaultParallelism
    n_queries = max(1, queries.count())  # blocks
    n_rows = -(-n_queries // edge)
    n_candidates = max(1, -(-vectors.count() // candidate_rows))
    n_columns = max(-(-n_candidates // edge), min(n_candidates, -(-cores // n_rows)))

    def place(n: int, seed: int):
        return F.pmod(F.xxhash64("block", F.lit(seed)), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def side(blocks: DataFrame, x: str) -> DataFrame:
        names = {"block": f"{x}b", "dim": f"{x}_dim", "width": f"{x}_width", "ids": f"{x}_ids", "cells": f"{x}_cells"}
        return blocks.select(*(F.col(a).alias(b) for a, b in names.items()), "row", "column")

    asked = side(queries.withColumn("row", place(n_rows, 1)).withColumn("column", every(n_columns)), "q")
    blocks = clean.mapInArrow(_packer(candidate_rows), BLOCK)
    held = side(blocks.withColumn("column", place(n_columns, 2)).withColumn("row", every(n_rows)), "c")
    tiles = held.join(asked, ["row", "column"]).where("q_dim = c_dim").withColumnRenamed("q_dim", "dim")
    tiles = tiles.select("qb", "cb", "dim", "q_width", "q_ids", "q_cells", "c_width", "c_ids", "c_cells")
    lists = tiles.mapInArrow(
        _tiles(k), "qb long, q_row long, query_id long, vec_id long, score long, cb long"
    )
    best = [F.desc("score"), F.asc("vec_id")]
    query = ["qb", "q_row", "query_id"]
    lists = lists.withColumn("_group", F.pmod(F.xxhash64("cb"), F.lit(64)))
    place = F.row_number().over(Window.partitionBy(*query, "_group").orderBy(*best))
    lists = lists.withColumn("_place", place).where(F.col("_place") <= k)
    rank = F.row_number().over(Window.partitionBy(*query).orderBy(*best))
    return (
        lists.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
