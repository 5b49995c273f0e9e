"""Exact nearest neighbours of a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.session import written

QUERY_BLOCK = 2_000


def nearest(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float = -1.0, same: str | None = None) -> DataFrame:
    """``query, neighbour, similarity, rank``: the k rows of highest cosine similarity to each query, itself left out.

    Queries go out in blocks of ``QUERY_BLOCK``, each held against every row in
    one pass; a partition passes on at most k rows per query, so the last step
    sees few. Similarities are rounded to 9 digits, ties go to the smaller key.
    With ``same`` only rows count that have the query's value of that column, a
    null like a null. Vectors are compared with those of their own length. Null vectors, and those
    with null parts or without length, have no neighbours.
    """
    spark = corpus.sparkSession
    arrow = pa.schema([("query", pa.int64()), ("neighbour", pa.int64()), ("similarity", pa.float64())])
    group = F.col(same).cast("string") if same else F.lit(None).cast("string")
    as_rows = lambda d: d.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), group.alias("g")).where("k is not null and v is not null")
    source = as_rows(corpus)
    out = spark.createDataFrame([], "query long, neighbour long, similarity double")

    def blocks() -> Iterator[list[tuple[int, list[float], str | None]]]:
        block = []
        for r in as_rows(queries).toLocalIterator():
            block.append((r["k"], r["v"], r["g"]))
            if len(block) == QUERY_BLOCK:
                yield block
                block = []
        if block:
            yield block

    for block in blocks():
        by_size: dict[int, list[tuple[int, list[float], str | None]]] = {}
        for i, v, g in block:
            if v and None not in v:
                by_size.setdefault(len(v), []).append((i, v, g))
        sides = {}
        for dims, own in by_size.items():
            q = np.array([v for _, v, _ in own], float)
            sides[dims] = (np.array([i for i, _, _ in own], np.int64), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), np.array([g for _, _, g in own], object))
        shared = spark.sparkContext.broadcast(sides)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                every, lists = b.column(0).to_numpy(), b.column(1)
                offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                sizes = np.diff(offsets)
                groups = np.array(b.column(2).to_pylist(), object)
                for dims, (ids, q, wanted) in shared.value.items():
                    at = np.flatnonzero(sizes == dims)
                    x = flat[offsets[at][:, None] + np.arange(dims)]
                    norm = np.linalg.norm(x, axis=1)  # NaN where a part is null or NaN
                    good = norm > 0
                    keys, x = every[at[good]], x[good] / norm[good, None]
                    if not len(keys):
                        continue
                    order = np.argsort(keys, kind="stable")  # so that the first of equal similarities has the smaller key
                    keys, x, own = keys[order], x[order], groups[at[good]][order]
                    s = np.round(q @ x.T, 9)
                    s[(ids[:, None] == keys[None, :]) | (wanted[:, None] != own[None, :])] = -np.inf
                    if s.shape[1] > k:
                        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                        query, place = np.nonzero(s >= floor[:, None])
                    else:
                        query, place = np.nonzero(s > -np.inf)
                    sim = s[query, place]
                    good = np.isfinite(sim) & (sim >= least)
                    query, place, sim = query[good], place[good], sim[good]
                    # Of each query's candidates, ties at the limit among them, the first k.
                    rank = np.lexsort((place, -sim, query))
                    query, place, sim = query[rank], place[rank], sim[rank]
                    nth = np.arange(len(query)) - np.searchsorted(query, query)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[query[nth < k]]), pa.array(keys[place[nth < k]]), pa.array(sim[nth < k])], schema=arrow)

        out = out.unionByName(written(source.mapInArrow(run, "query long, neighbour long, similarity double"), "nearest"))
        shared.destroy()
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return out.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
