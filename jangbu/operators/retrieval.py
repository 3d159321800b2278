"""Dense retrieval and its metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jangbu.runtime import cut

#: Most query vectors one broadcast block holds.
BLOCK = 2_000


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, same_scope: str | None = None) -> DataFrame:
    """``query_id, vec_id, similarity, rank``: the ``k`` nearest vectors of every query by cosine, exactly, the query itself left out.

    ``queries`` has ``query_id, embedding`` and ``vectors`` ``vec_id, embedding``;
    with ``same_scope`` both have that column and only vectors of the query's
    scope count, before the cut.  Queries come in broadcast blocks of at most
    ``BLOCK``; each partition keeps its own best ``k`` before the shuffle.
    """
    if k < 1:
        raise ValueError("k must be positive")
    queries = cut(queries)
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    scope = [same_scope] if same_scope else []
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = part.select("query_id", "embedding", *scope).collect()  # at most about BLOCK vectors
        found = _block(rows, vectors, k, same_scope)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(rows: list, vectors: DataFrame, k: int, scope: str | None) -> DataFrame:
    ids = np.array([r.query_id for r in rows], np.int64)
    q = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1)
    q = q / np.sqrt((q * q).sum(1, keepdims=True).clip(1e-20))
    scopes = np.array([r[scope] for r in rows]) if scope else None
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q, scopes))

    def best(batches):
        ids, q, scopes = shared.value
        for b in batches:
            if not len(b) or not len(ids):
                continue
            v = np.array(b["embedding"].tolist(), np.float64)
            v = v / np.sqrt((v * v).sum(1, keepdims=True).clip(1e-20))
            key = b["vec_id"].to_numpy()
            sim = np.round(q @ v.T, 6)
            sim[ids[:, None] == key[None, :]] = -np.inf
            if scopes is not None:
                sim[scopes[:, None] != b[scope].to_numpy()[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(key, sim.shape), -sim), axis=1)[:, :k]
            top = np.take_along_axis(sim, order, 1)
            keep = np.isfinite(top)
            yield pd.DataFrame({"query_id": np.broadcast_to(ids[:, None], top.shape)[keep], "vec_id": key[order][keep], "similarity": top[keep]})

    return vectors.mapInPandas(best, "query_id long, vec_id long, similarity double")


def stage_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``query_id, n_gold, n_found, recall, precision, mrr`` within the first ``k``; queries without gold are left out."""
    hits = ranked.where(F.col("rank") <= k).join(gold.select("query_id", "vec_id", F.lit(1).alias("g")), ["query_id", "vec_id"], "left")
    got = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count("g").alias("n_found"), F.min(F.when(F.col("g") == 1, F.col("rank"))).alias("first"))
    total = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    m = total.join(got, "query_id", "left").fillna(0, ["n", "n_found"])
    return m.select("query_id", "n_gold", "n_found", F.round(F.col("n_found") / F.col("n_gold"), 6).alias("recall"), F.round(F.col("n_found") / F.greatest("n", F.lit(1)), 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def failure_kinds(ranked: DataFrame, gold: DataFrame, pool: int, context: int) -> DataFrame:
    """``query_id, failure``: ``none`` if every gold is in the context, ``recall_failure`` if one is not even in the pool, else ``rank_failure``."""
    at = gold.join(ranked.select("query_id", "vec_id", "rank"), ["query_id", "vec_id"], "left")
    n = at.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= pool).alias("in_pool"), F.count_if(F.col("rank") <= context).alias("in_context"))
    return n.select("query_id", F.when(F.col("in_context") == F.col("n"), "none").when(F.col("in_pool") < F.col("n"), "recall_failure").otherwise("rank_failure").alias("failure"))
