"""Exact similarity search: one query vector, or a set of them in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.vectors import cosine, is_valid
from codeweft.storage import materialize

#: query vectors that are broadcast at a time
QUERY_BLOCK = 4096


def top_k(df: DataFrame, query: list[float], k: int = 10, project: str | None = None, key: str = "vec_id", dim: int = 64) -> DataFrame:
    """The k rows most similar to ``query``, with their score.

    ``project`` None searches all projects; "" is a project like any other.
    Vectors that are not ``dim`` finite numbers, or all zero, take no part.
    Equal scores are ordered by key; repeated rows of a key count once.

    Only keys and scores are shuffled, combined before it; the other columns are
    fetched for the k keys found.
    """
    if project is not None:
        df = df.where(F.col("project") == project)
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = df.where(is_valid(F.col("embedding"), dim)).withColumn("score", cosine(F.col("embedding"), vector))
    best = scored.groupBy(key).agg(F.max("score").alias("best")).orderBy(F.col("best").desc(), key).limit(k)
    best = best.withColumnRenamed(key, "best_key")
    rows = scored.join(F.broadcast(best), (F.col(key) == F.col("best_key")) & (F.col("score") == F.col("best")))
    return rows.drop("best_key", "best").dropDuplicates([key]).orderBy(F.col("score").desc(), key)


def top_k_each(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", dim: int = 64) -> DataFrame:
    """(query, key, score): the k rows most similar to each query vector.

    The queries run over all rows in blocks of ``QUERY_BLOCK``: a block is
    broadcast, each task keeps the best k of each query over all of its rows, and
    one aggregation merges them.
    """
    spark = df.sparkSession
    rows = df.where(is_valid(F.col("embedding"), dim)).dropDuplicates([key]).select(F.col(key).alias("key"), "embedding")
    valid = queries.where(is_valid(F.col("embedding"), dim)).dropDuplicates([key]).select(F.col(key).alias("key"), "embedding")
    n = valid.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    if blocks > 1:  # every block of queries reads them
        rows = materialize(rows)
    out = None
    for b in range(blocks):
        part = valid.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()
        ids = [r.key for r in part]
        q = np.array([r.embedding for r in part], dtype=np.float64).reshape(-1, dim)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, q))

        def scan(batches, shared=shared):
            ids, q = shared.value
            top = np.empty((len(ids), 0))
            keys = np.empty((len(ids), 0), dtype=np.int64)
            for batch in batches:
                if not len(batch) or not ids:
                    continue
                x = np.array(batch["embedding"].tolist(), dtype=np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                top = np.concatenate([top, q @ x.T], axis=1)
                keys = np.concatenate([keys, np.broadcast_to(batch["key"].to_numpy(), (len(ids), len(x)))], axis=1)
                if top.shape[1] > k:
                    order = np.lexsort((keys, -top))[:, :k]  # equal scores by key
                    top, keys = np.take_along_axis(top, order, axis=1), np.take_along_axis(keys, order, axis=1)
            if top.size:
                yield pd.DataFrame({"query": np.repeat(ids, top.shape[1]), "key": keys.ravel(), "score": top.ravel()})

        found = rows.mapInPandas(scan, "query bigint, key bigint, score double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def enriched(hits: DataFrame, vertices: DataFrame) -> DataFrame:
    """Hits with the node of their name and file, null where there is none.

    Of several such nodes the first by line, kind and id counts.
    """
    w = Window.partitionBy("project", "name", "file_path").orderBy("start_line", "kind", "node_id")
    first = vertices.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(
        "project", F.col("name").alias("node_name"), "file_path", "kind", "signature", F.concat_ws("-", "start_line", "end_line").alias("lines")
    )
    return hits.join(first, ["project", "node_name", "file_path"], "left")
