"""Exact top-k inner products by pivot-table elimination.

Vectors become integers, floor(scale * x). Distances of every vector to PIVOTS pivots are computed once; for a query q the largest
of |d(q, p) - d(x, p)| over the pivots p bounds d(q, x) from below, and with the norms the inner product from above,
(|q|^2 + |x|^2 - d(q, x)^2) / 2. Candidates are evaluated in the order of that bound, best first, until it falls below the
k-th best score: what is left can't enter the result.

Queries and candidates meet block by block, and only each block's k best leave a task; so the memory of a task is that of two blocks,
whatever the number of vectors.

Edge cases: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part. Only
vectors of one length are compared. Of rows with one id each is a candidate of its own, and none is one for a query of that id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

PIVOTS, BLOCK, CHUNK = 24, 4096, 256
#: Sums of products below this are exact in doubles; beyond it they are taken in 64-bit integers.
EXACT = 1 << 52

_SCHEMA = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v``: the vectors that take part, as arrays of integers."""
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(ok).select(
        "vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")
    )


class Pivots:
    """A block's distances to its pivots, which are spread out by taking the farthest from those taken."""

    def __init__(self, x: np.ndarray):
        self.whole = x
        self.exact = not len(x) or float(np.abs(x).max()) ** 2 * x.shape[1] < EXACT
        x = self.x = x.astype(np.float64)
        self.norms = np.einsum("ij,ij->i", x, x)
        chosen, far = [0], None
        while True:
            d = self.distance(x, x[chosen[-1]])
            far = d if far is None else np.minimum(far, d)
            if len(chosen) >= min(PIVOTS, len(x)):
                break
            chosen.append(int(far.argmax()))
        self.pivots = x[chosen]
        self.table = np.stack([self.distance(x, p) for p in self.pivots])

    @staticmethod
    def distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        d = x - p
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No score of q with a row of the block is greater; rounding is allowed for."""
        low = np.abs(self.table - self.distance(self.pivots, q)[:, None]).max(axis=0)
        low = np.maximum(low * (1 - 1e-9) - 1e-6, 0)
        return (q @ q + self.norms - low * low) / 2 + 1e-9 * (1 + q @ q + self.norms)

    def best(self, q: np.ndarray, own: int, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to the smaller id, and ``own`` left out."""
        bound = self.bounds(q.astype(np.float64))
        exact = self.exact and float(np.abs(q).max()) ** 2 * len(q) < EXACT
        bound[ids == own] = -np.inf
        order = np.argsort(-bound, kind="stable")
        got_ids, got = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for at in range(0, len(order), CHUNK):
            some = order[at : at + CHUNK]
            some = some[bound[some] > -np.inf]
            if not len(some) or len(got) >= k and bound[some[0]] < got[k - 1]:
                break
            got_ids, got = np.r_[got_ids, ids[some]], np.r_[got, (self.x[some] @ q.astype(np.float64)).astype(np.int64) if exact else self.whole[some] @ q]
            top = np.lexsort((got_ids, -got))[:k]
            got_ids, got = got_ids[top], got[top]
        return got_ids, got


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products with the other rows."""
    held = cut(quantised(vectors, scale))
    n, queries = held.count(), held.where(is_query).count()
    across, down = max(1, -(-n // block)), max(1, -(-queries // block))
    # rows are dealt evenly; each block of candidates meets each block of queries in one group
    cell = F.pmod(F.xxhash64("vec_id", "v"), F.lit(across))
    row = F.pmod(F.xxhash64("v", "vec_id"), F.lit(down))
    size = F.size("v").alias("size")
    candidates = held.select(cell.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("r"), size, F.lit(False).alias("query"), "vec_id", "v")
    asked = held.where(is_query).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("c"), row.alias("r"), size, F.lit(True).alias("query"), "vec_id", "v")

    def run(t: pa.Table) -> pa.Table:
        query = t.column("query").to_numpy().astype(bool)
        ids = t.column("vec_id").to_numpy()
        size = t.column("size")[0].as_py()
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if query.any() and not query.all():
            order = np.argsort(ids[~query], kind="stable")
            own, mine = ids[~query][order], x[~query][order]
            pivots = Pivots(mine)
            for q, name in zip(x[query], ids[query].tolist(), strict=True):
                found, scores = pivots.best(q, name, own, k)
                out.append((np.full(len(found), name), found, scores))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    found = candidates.union(asked).groupBy("c", "r", "size").applyInArrow(run, _SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB: all products.
SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
