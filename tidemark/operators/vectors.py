"""Exact cosine search over vectors, alone, filtered and for many queries at once.

Vectors of another length than the query's, null or zero vectors have no distance and
are left out.  Ties are broken by id.  A stated query set is compared with all rows
block by block as a matrix product: what is sent to the tasks is one block of at most
``BLOCK`` queries, whatever the number of queries, and each task returns k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import cosine_distance

#: Most queries in one block.
BLOCK = 4096


def topk(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest: id and ``distance``, nearest first."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = F.when(F.size(vec_col) == len(query), cosine_distance(F.col(vec_col), q))
    return vectors.select("*", F.round(d, 9).alias("distance")).where("distance is not null").orderBy("distance", id_col).limit(k)


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, id, ``distance``: the k nearest other rows of each query row."""
    id_type = dict(vectors.dtypes)[id_col]
    asked = queries.select(F.col(id_col).alias("q"), F.col(vec_col).alias("v")).where("q is not null and v is not null")
    n_blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for block in range(n_blocks):
        some = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block)
        rows = some.collect()  # one block
        part = _block(vectors, rows, k, id_col, vec_col, id_type)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(vectors: DataFrame, rows: list, k: int, id_col: str, vec_col: str, id_type: str) -> DataFrame:
    ids = [r.q for r in rows]
    by_length: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_length.setdefault(len(r.v), []).append(i)
    matrices = {}
    for n, at in by_length.items():
        m = np.array([rows[i].v for i in at], float).reshape(len(at), n)
        size = np.linalg.norm(m, axis=1) if n else np.zeros(len(at))
        good = size > 0
        matrices[n] = (np.array(at)[good], m[good] / size[good, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, object]]] = {}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            own, vecs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for n, (at, matrix) in matrices.items():
                same = [i for i, v in enumerate(vecs) if v is not None and len(v) == n and own[i] is not None]
                if not same or not n:
                    continue
                m = np.array([vecs[i] for i in same], float)
                size = np.linalg.norm(m, axis=1)
                d = np.round(1 - matrix @ (m / np.where(size > 0, size, 1)[:, None]).T, 9)
                d[:, size == 0] = np.inf
                for row, q in enumerate(at.tolist()):
                    near = np.argpartition(d[row], min(k, len(same) - 1))[: k + 1] if len(same) > k + 1 else np.arange(len(same))
                    edge = d[row][near].max()
                    near = np.flatnonzero(d[row] <= edge)  # ties at the edge are settled by id
                    found = [(d[row][j], own[same[j]]) for j in near.tolist() if np.isfinite(d[row][j]) and own[same[j]] != ids[q]]
                    best[q] = sorted(best.get(q, []) + found)[:k]
        flat = [(ids[q], i, d) for q, near in best.items() for d, i in near]
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], kind), pa.array([f[1] for f in flat], kind), pa.array([float(f[2]) for f in flat], pa.float64())], names=["query_id", id_col, "distance"])

    return vectors.select(id_col, vec_col).mapInArrow(run, f"query_id {id_type}, `{id_col}` {id_type}, distance double")


def coherence(vectors: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """The mean (1 + cos) / 2 over all pairs of a group; 1 for fewer than two vectors.

    The sum of all pairs' cosines is (|sum of unit vectors|^2 - n) / 2, so one pass with
    partial sums does it, without pairs.  A zero vector is unlike every other (0).
    """
    size = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.select(group_col, size.alias("_n"), F.posexplode(vec_col).alias("_at", "_x"))
    sums = unit.where("_n > 0").groupBy(group_col, "_at").agg(F.sum(F.col("_x").cast("double") / F.col("_n")).alias("_s"))
    square = sums.groupBy(group_col).agg(F.sum(F.col("_s") * F.col("_s")).alias("square"))
    count = vectors.groupBy(group_col).agg(F.count("*").alias("n"), F.count_if(size > 0).alias("m"))
    joined = count.join(square, group_col, "left")
    m, n = F.col("m").cast("double"), F.col("n").cast("double")
    cosines = (F.coalesce("square", F.lit(0.0)) - m) / 2
    value = F.when(n < 2, 1.0).otherwise((m * (m - 1) / 2 + cosines) / 2 / F.nullif(n * (n - 1) / 2, F.lit(0.0)))
    return joined.select(group_col, F.col("n"), value.alias("coherence"))


def mean_similarity(vectors: DataFrame, group_col: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each vector's mean (1 + cos) / 2 to the vectors of its group, itself included; to a zero vector it is 0.

    As the mean cosine is the product with the sum of unit vectors, partial sums do it, without pairs.
    """
    size = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.select(group_col, id_col, size.alias("_size"), F.posexplode(vec_col).alias("_at", "_x")).where("_size > 0").select(group_col, id_col, "_at", (F.col("_x").cast("double") / F.col("_size")).alias("_u"))
    total = unit.groupBy(group_col, "_at").agg(F.sum("_u").alias("_s"))
    cosines = unit.join(total, [group_col, "_at"]).groupBy(group_col, id_col).agg(F.sum(F.col("_u") * F.col("_s")).alias("_c"))
    count = vectors.groupBy(group_col).agg(F.count("*").alias("_n"), F.count_if(size > 0).alias("_m"))
    joined = vectors.select(group_col, id_col).join(count, group_col).join(cosines, [group_col, id_col], "left")
    return joined.select(id_col, group_col, F.coalesce((F.col("_m") + F.col("_c")) / 2 / F.col("_n"), F.lit(0.0)).alias("similarity"))
