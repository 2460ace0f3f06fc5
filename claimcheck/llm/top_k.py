"""Exact top-k by inner product: sorted lists read in order, bounds kept, no random access.

Queries and candidates meet in blocks. In a block every dimension is one list, sorted by
value; a query reads it from the top or from the bottom, by the sign of its own component.
After a depth of the lists, what was read is known and what was not is at most the value
there: upper bounds. Unread values are at least the list's other end: lower bounds. When few
candidates can still reach the k-th best score, reading stops and their scores are resolved.
Bounds and scores are whole numbers, so results are exact and ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 65_536
LEAST_BLOCK = 4_096
READ_ROWS = 8_192
READ_QUERIES = 1_024
DEPTHS = (0.5, 0.75)
RESOLVE_SHARE = 0.15
HITS = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null when the vector or a component is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(vector.isNotNull() & F.forall(vector, finite), whole)


def _number(limit: int) -> type:
    """The cheapest type in which sums up to `limit` are exact."""
    return np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else np.int64


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, x: np.ndarray):
        self.x, self.sorted = x, np.sort(x, axis=0)

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int, lower: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Upper and, if wanted, lower bounds of all scores after `depth` entries of each list."""
        x, top, bottom = self.x, self.sorted[-depth], self.sorted[depth - 1]
        upper = up @ np.maximum(x, top).T + down @ np.minimum(x, bottom).T
        if not lower:
            return upper, None
        seen = up @ np.where(x >= top, x, self.sorted[0]).T
        return upper, seen + down @ np.where(x <= bottom, x, self.sorted[-1]).T


def search_block(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score): the k best of one block for each query, the query's own id left out."""
    limit = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    kind = _number(limit)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order].astype(kind)
    q = q.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, kind))] * len(q)
    lowest = np.iinfo(kind).min if kind is np.int64 else -np.inf
    floor = np.full(len(q), lowest, kind)
    for at in range(0, len(x), READ_ROWS):
        lists, own = Lists(x[at : at + READ_ROWS]), ids[at : at + READ_ROWS]
        n = len(own)
        for s in range(0, len(q), READ_QUERIES):
            part = slice(s, min(s + READ_QUERIES, len(q)))
            for depth in [max(1, int(n * d)) for d in DEPTHS] + [n]:
                upper, lower = lists.bounds(up[part], down[part], depth, (floor[part] == lowest).any() and depth < n)
                enough = floor[part]
                if lower is not None and n > k:
                    # The query's own rows, which may repeat, are none of its k best.
                    lower[own == query_ids[part][:, None]] = lowest
                    enough = np.maximum(enough, np.partition(lower, n - k, axis=1)[:, n - k])
                alive = upper >= enough[:, None]
                if depth == n or alive.mean() <= RESOLVE_SHARE:
                    break
            for i in range(part.start, part.stop):
                left = np.flatnonzero(alive[i - s])
                left = left[own[left] != query_ids[i]]
                if not left.size:
                    continue
                score = upper[i - s, left] if depth == n else lists.x[left] @ q[i]
                if score.size > 4 * k:
                    least = np.partition(score, score.size - k)[score.size - k]
                    left, score = left[score >= least], score[score >= least]
                all_ids, all_scores = np.concatenate([best[i][0], own[left]]), np.concatenate([best[i][1], score])
                top = np.lexsort((all_ids, -all_scores))[:k]
                best[i] = all_ids[top], all_scores[top]
                if len(top) == k:
                    floor[i] = all_scores[top[-1]]
    return [(int(a), int(b), int(c)) for a, (ids_, scores) in zip(query_ids, best) for b, c in zip(ids_, scores)]


def _block(n: int, parallel: int) -> int:
    """Blocks of at most BLOCK_ROWS rows, and enough of them to keep the cores busy."""
    return max(1, math.ceil(n / BLOCK_ROWS), min(parallel, math.ceil(n / LEAST_BLOCK)))


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), flat.size // max(1, len(column)))


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, all if there are fewer.

    Both have vec_id (long) and v (array of long). Rows with a null id or vector take no part;
    vectors only meet vectors of their own length. Candidates with the query's id are left out.
    A query id that repeats counts once, with its least vector; repeated candidates all count.
    """
    spark = queries.sparkSession
    queries = queries.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))
    candidates = candidates.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v")
    parallel = spark.sparkContext.defaultParallelism
    n_candidates = _block(candidates.count(), parallel)
    n_queries = _block(queries.count(), 1)
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "v", F.size("v").alias("d"), spread(n_queries).alias("qb"), every(n_candidates).alias("cb"))
    right = candidates.select("vec_id", "v", F.size("v").alias("d"), spread(n_candidates).alias("cb"), every(n_queries).alias("qb"))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        hits = []
        if q.num_rows and c.num_rows:
            hits = search_block(q.column("vec_id").to_numpy(), _matrix(q), c.column("vec_id").to_numpy(), _matrix(c), k)
        columns = list(zip(*hits)) or [[], [], []]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    hits = left.groupBy("d", "qb", "cb").cogroup(right.groupBy("d", "qb", "cb")).applyInArrow(search, HITS)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.select("query_id", F.row_number().over(ranked).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
