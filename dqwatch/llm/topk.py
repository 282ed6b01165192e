"""Exact top-k inner products with block-at-a-time pruning.

Vectors are sorted by the signs of their first components, so that neighbours resemble each other, and cut into
blocks of consecutive rows; a block keeps its rows as a forward index, and the least and greatest value of each
component. For a query the bound of a block is the sum over components of what the extremes allow. Blocks are
scored in the order of their bounds until a bound falls below the query's kth score; equal bounds are still scored,
since ties go to the smaller id.

Tasks are pairs of a set of blocks and a set of queries, both of bounded size; each returns its k best per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dqwatch.llm.common import read, written

SCALE = 1024
BLOCK_ROWS = 256
#: Rows of candidates and of queries that meet in one task, on average.
SET_ROWS, SET_QUERIES = 8192, 4096


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Rows that are null, hold nulls or non-finite components, or lack an id go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _signs(v: Column, n: int = 16) -> Column:
    return F.concat(*[F.when(F.get(v, i) < 0, "0").otherwise("1") for i in range(n)])


def search_sets(blocks: pd.DataFrame, queries: pd.DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> tuple[list[tuple[int, int, int]], int]:
    """The k best (query_id, vec_id, score) of each query among the candidates, and how many blocks were scored."""
    if blocks.empty or queries.empty:
        return [], 0
    order = blocks.sort_values(["signs", "vec_id"])
    ids = order.vec_id.to_numpy()
    values = np.array(order.v.tolist(), dtype=np.int64).reshape(len(order), -1)
    starts = np.arange(0, len(ids), block_rows)
    high, low = np.maximum.reduceat(values, starts, axis=0), np.minimum.reduceat(values, starts, axis=0)
    asked = np.array(queries.v.tolist(), dtype=np.int64).reshape(len(queries), -1)
    bounds = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
    visits = np.argsort(-bounds, axis=1, kind="stable")
    out, scored = [], 0
    for query_id, q, bound, visit in zip(queries.vec_id.tolist(), asked, bounds, visits, strict=True):
        best, best_ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for b in visit.tolist():
            if len(best) == k and bound[b] < best[-1]:
                break
            scored += 1
            rows = slice(starts[b], starts[b] + block_rows)
            scores, there = values[rows] @ q, ids[rows]
            good = there != query_id
            if len(best) == k:
                good &= scores >= best[-1]
            best, best_ids = np.concatenate([best, scores[good]]), np.concatenate([best_ids, there[good]])
            top = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[top], best_ids[top]
        out += [(query_id, i, s) for i, s in zip(best_ids.tolist(), best.tolist(), strict=True)]
    return out, scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of ``queries`` among ``vectors``; both (vec_id, v).

    A query does not find rows with its own id. Vectors of another length take no part in its search; two queries of
    one id are told apart by nothing and share k ranks. Fewer than k candidates give fewer rows. Products must fit
    63 bits.
    """
    vectors = written(vectors.select("vec_id", "v", F.size("v").alias("dims"), _signs(F.col("v")).alias("signs")), "vectors")
    queries = written(queries.select("vec_id", "v", F.size("v").alias("dims")).distinct(), "queries")
    n_sets = -(-vectors.count() // SET_ROWS) or 1
    n_asked = -(-queries.count() // SET_QUERIES) or 1
    # ranges of (signs, id): equal vectors are many rows of different ids, so no range is forced to be large
    ranged = vectors.repartitionByRange(n_sets, "dims", "signs", "vec_id").withColumn("set", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    n_sets = (ranged.agg(F.max("set")).first()[0] or 0) + 1
    candidates = ranged.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    asked = queries.withColumn("ask", F.pmod(F.xxhash64("vec_id"), F.lit(n_asked)).cast("int")).withColumn(
        "set", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1)))
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, _ = search_sets(left, right, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["set", "ask", "dims"]
    parts = candidates.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows of ``embeddings`` for every row whose vec_id is divisible by 100."""
    vectors = quantised(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


#: The same over all pairs.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
