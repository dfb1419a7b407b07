"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Every component x counts as floor(256 * x). Candidates are dealt by hash to blocks, queries likewise, and every block of
queries meets every block of candidates in one task. A task keeps, per dimension, its candidates sorted by that component.
For a query it reads the lists in step, from the end that the sign of the query's component prefers; candidates met for the
first time are scored in full. No candidate still unseen can score more than the sum, over the dimensions, of the query's
component times the value the list has come to; once that bound is below the k-th score so far, the search ends. The bound
must be strictly below, so ties are complete. The k best of all blocks are ranked per query.

Nulls: rows without an id, and vectors that are null or hold a null, NaN or infinite component, take no part. Rows that repeat
an id are rows of their own: each competes, and each that is a query has its own results, against every row but itself. Only vectors of equal length are compared; an empty table gives an empty result. Scores beyond 64 bits are saturated
before they are ranked. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footlog.llm.common import staged

K, EVERY = 5, 50
#: Candidates and queries of one task.
BLOCK, QUERIES = 8192, 4096
#: Entries of each list that are read before the bound is looked at for the first time; four times as many from then on.
FIRST = 16
_LIMIT = (1 << 63) - 1


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding, row): vectors as arrays of finite doubles, rows numbered; keep the result, as numbers hold for one run."""
    vector = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return rows.where(finite).withColumn("row", F.monotonically_increasing_id())


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.floor(256.0 * np.stack(vectors.to_list()).astype(np.float64))


class Lists:
    """A block of candidates of one length with its sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.rows, self.values, self.order = ids, rows, values, np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=0)

    def best(self, query_row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best candidates but the query's own row, and how many were scored."""
        n, used = len(self.ids), np.flatnonzero(query != 0)
        up, down = used[query[used] < 0], used[query[used] > 0]
        exact = np.abs(self.values).max(initial=0) * np.abs(query).max(initial=0) * max(1, query.size) < 2.0**53
        kind = np.float64 if exact else object  # beyond the exact range of doubles: Python integers
        weights = query if exact else np.array([int(x) for x in query], object)
        seen, done, depth, scored = np.zeros(n, bool), 0, FIRST, 0
        ids, scores = np.empty(0, np.int64), np.empty(0, kind)
        while True:
            depth = n if not len(used) or scored > n / 2 else min(depth, n)  # with most met, the rest is scored at once
            met = np.zeros(n, bool)
            if depth < n:
                met[self.order[done:depth, up].ravel()] = True
                met[self.order[n - depth : n - done, down].ravel()] = True
            else:
                met[:] = True
            new = np.flatnonzero(met & ~seen & (self.rows != query_row))
            seen |= met
            scored += len(new)
            values = self.values[new] if exact else np.array([[int(x) for x in row] for row in self.values[new]], object).reshape(len(new), query.size)
            made = values @ weights if query.size else np.zeros(len(new), kind)
            if not exact:
                made = np.array([max(-_LIMIT - 1, min(_LIMIT, x)) for x in made], object)
            ids, scores = np.concatenate([ids, self.ids[new]]), np.concatenate([scores, made])
            best = np.lexsort((ids, -scores.astype(kind)))[:k] if exact else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
            ids, scores = ids[best], scores[best]
            if depth == n:
                return ids, scores, scored
            if exact and len(ids) == k:
                bound = self.sorted[depth - 1, up] @ query[up] + self.sorted[n - depth, down] @ query[down]
                if bound < scores[-1]:
                    return ids, scores, scored
            done, depth = depth, depth * 4


def _block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    out = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
    sizes = candidates["embedding"].map(len)
    for size, some in queries.groupby(queries["embedding"].map(len)):
        rows = candidates[sizes == size].sort_values("vec_id")
        if not len(rows):
            continue
        lists = Lists(rows["vec_id"].to_numpy(), rows["row"].to_numpy(), _matrix(rows["embedding"]))
        for query_id, query_row, query in zip(some["vec_id"].to_list(), some["row"].to_list(), _matrix(some["embedding"]), strict=True):
            ids, scores, _ = lists.best(query_row, query, k)
            out["query_id"] += [query_id] * len(ids)
            out["query_row"] += [query_row] * len(ids)
            out["vec_id"] += ids.tolist()
            out["score"] += [int(s) for s in scores]
    return pd.DataFrame({c: pd.Series(v, dtype="int64") for c, v in out.items()})


def top_k(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all other rows."""
    rows = staged(usable(embeddings, id_col, vector_col), "topk-vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks, rounds = max(1, math.ceil(rows.count() / block)), max(1, math.ceil(asked.count() / queries))

    def dealt(frame: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        return frame.select("*", F.pmod(F.xxhash64("row", F.lit(own)), F.lit(parts)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias(other))

    left, right = dealt(asked, "q", rounds, "c", blocks), dealt(rows, "c", blocks, "q", rounds)
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(lambda a, b: _block(a, b, k), "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
