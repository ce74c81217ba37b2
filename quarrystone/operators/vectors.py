"""Exact cosine search of a stated set of queries over a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that go to the executors at once: a matrix of bounded size. More queries take more passes.
BLOCK = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def top_k(base: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scope: str | None = None, mode: str = "all") -> DataFrame:
    """``(query_id, vec_id, scope, sim, rank)``: the k most similar vectors of every query, itself left out.

    Similarity is rounded to five digits and ties go to the lower id. ``mode`` says what ``scope`` does: all, same (only vectors
    of the query's scope), other (only those of other scopes), each (the k best of every scope). Each Arrow batch is compared with a block
    of queries by one matrix product, and each task keeps its k best, so that at most k rows per query and task are shuffled. Queries of
    null vectors and null vectors are left out; an empty side gives no rows. The queries are a stated set that the driver can hold; the base is
    scanned once for every ``BLOCK`` of them.
    """
    name = scope or "scope"
    cols = [F.col(id_col).alias("vec_id"), (F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("scope"), F.col(vec_col).alias("v")]
    source = base.select(*cols).filter("v is not null")
    asked = queries.select(*cols).filter("v is not null")
    blocks: list[list] = [[]]
    for row in asked.toLocalIterator():
        if len(blocks[-1]) == BLOCK:
            blocks.append([])
        blocks[-1].append(row)
    out = None
    for block in blocks:
        if not block:
            continue
        part = source.mapInArrow(_scorer([r.vec_id for r in block], [r.scope for r in block], np.array([r.v for r in block], np.float64), k, mode), "query_id bigint, vec_id bigint, scope string, sim double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return base.sparkSession.createDataFrame([], f"query_id bigint, vec_id bigint, {name} string, sim double, rank int")
    keys = ["query_id", "scope"] if mode == "each" else ["query_id"]
    order = Window.partitionBy(*keys).orderBy(F.col("sim").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnRenamed("scope", name)


def _scorer(ids: list, scopes: list, matrix: np.ndarray, k: int, mode: str):
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    ids_a, scopes_a = np.array(ids, np.int64), np.array(scopes, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The best so far, by scope if each counts for itself: what a task sends on is k rows a query, however many batches it had.
        best: dict[object, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            scope = np.array(batch.column(1).to_pylist(), object)
            v = _matrix(batch.column(2))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            sims = np.round(unit @ v.T, 5) + 0.0
            sims[ids_a[:, None] == own[None, :]] = -np.inf
            same = scopes_a[:, None] == scope[None, :]
            if mode == "same":
                sims[~same] = -np.inf
            if mode == "other":
                sims[same] = -np.inf
            for name, g in [(s, np.flatnonzero(scope == s)) for s in dict.fromkeys(scope)] if mode == "each" else [(None, np.arange(len(own)))]:
                new, at = sims[:, g], np.broadcast_to(g, (len(ids), len(g)))
                rows = np.broadcast_to(own[g], new.shape)
                names = scope[at]
                if name in best or (mode != "each" and best):
                    new, rows, names = (np.concatenate(x, axis=1) for x in zip(best[name], (new, rows, names), strict=True))
                order = np.lexsort((rows, -new), axis=1)[:, :k]
                best[name] = tuple(np.take_along_axis(x, order, axis=1) for x in (new, rows, names))
        for new, rows, names in best.values():
            fine = np.isfinite(new)
            asked = np.broadcast_to(ids_a[:, None], new.shape)
            yield pa.RecordBatch.from_arrays([pa.array(asked[fine]), pa.array(rows[fine]), pa.array(names[fine].tolist(), pa.string()), pa.array(new[fine])], ["query_id", "vec_id", "scope", "sim"])

    return run


def interleave(ranked: DataFrame, group: str, groups: DataFrame | None = None) -> DataFrame:
    """Round robin over groups: first ones of every group, then second ones; ``position`` counts from 1 within a query."""
    order = Window.partitionBy("query_id").orderBy("rank", group)
    return ranked.withColumn("position", F.row_number().over(order))


#: Gates of the similarity of the best match.
NONE_BELOW, LOW_BELOW = 0.32, 0.56


def confidence(best: Column) -> Column:
    return F.when(best.isNull() | (best < NONE_BELOW), "none").when(best < LOW_BELOW, "low").otherwise("high")
