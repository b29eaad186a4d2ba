"""Exact top-k search by inner product with norm buckets.

Candidates are grouped by length into BUCKETS classes. A query's k-th best score so far, over
its own length and a bucket's greatest, is the cosine that the bucket's vectors must reach:
over 1 the bucket is passed by. Within a bucket that local threshold picks the pruning, for
each query: a low one cuts off the short vectors, a high one also bounds the rest of the
product once a few large coordinates of the query are multiplied. What is left is verified
by whole products: floating ones where these are exact, of Python's integers where not.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Classes of length, candidates of a block, queries of a chunk, results of a query.
BUCKETS, BLOCK_ROWS, CHUNK_ROWS, K = 16, 8192, 2048, 5
#: From this needed cosine on, coordinates are worth a look; so many of them.
COORDINATE_FROM, COORDINATES = 0.6, 12
#: Queries that are multiplied with a block at once.
SIDE = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def taking_part(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (doubles), dim and the length of floor(scale * v); without null ids and vectors that are null, or hold a null or non-finite component."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(good & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    def whole(x):  # noqa: ANN001, ANN202
        y = x * scale
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + whole(x) * whole(x))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(squares).alias("length"))


def product(a: np.ndarray, b: np.ndarray, scale: int) -> int:
    """The inner product of floor(scale * x), by integers of any size; what a long can't hold becomes the nearest that it can."""

    def whole(x: float) -> int:
        return math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale

    return max(LEAST, min(MOST, sum(whole(x) * whole(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))))


def search(queries: np.ndarray, own: np.ndarray, floors: list[int | None], block: np.ndarray, ids: np.ndarray, k: int = K, scale: int = 256) -> list[tuple[int, int, int]]:
    """Rows (query's vec_id, vec_id, score) of the k best of a block for each query, without scores below its floor.

    own: the queries' vec_ids, left out of their results; ties go to smaller ids.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        v, w = np.floor(queries * scale), np.floor(block * scale)
        length, lengths = np.sqrt((v * v).sum(1)), np.sqrt((w * w).sum(1))
        order = np.argsort(-lengths, kind="stable")
        block, ids, w, lengths = block[order], ids[order], w[order], lengths[order]
        # Sums of whole numbers below 2**53 are exact.
        exact = np.abs(v).max(initial=0) * np.abs(w).max(initial=0) * max(1, v.shape[1]) < 1 << 53
        most = length * lengths[0]
        slack = np.zeros(len(v)) if exact else most * (v.shape[1] + 2) * 2.0**-50
        low = np.array([-np.inf if f is None or f == LEAST else float(f) for f in floors]) - slack
        low -= np.abs(low, where=np.isfinite(low), out=np.zeros(len(low))) * 2.0**-50  # a long as a double may be too large
        needed = np.where(low > 0, low / most, 0.0)  # the local threshold: a cosine
    out: list[tuple[int, int, int]] = []

    def verified(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        if len(rows) > k and np.isfinite(scores).all():
            scores = np.clip(scores, float(LEAST), float(MOST))
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= kth - 2 * slack[i]
            rows, scores = rows[near], scores[near]
        sure = scores.astype(np.int64).tolist() if exact else [product(queries[i], block[r], scale) for r in rows]
        found = sorted((-s, int(c)) for s, c in zip(sure, ids[rows], strict=True) if floors[i] is None or s >= floors[i])
        out.extend((int(own[i]), c, -s) for s, c in found[:k])

    wild = ~np.isfinite(most)  # products of doubles say nothing
    for i in np.flatnonzero(wild):
        rows = np.flatnonzero(ids != own[i])
        verified(i, rows, np.full(len(rows), np.nan))
    reachable = ~wild & (needed * (1 - 1e-9) <= 1)
    for i in np.flatnonzero(reachable & (needed >= COORDINATE_FROM)):
        end = int(np.searchsorted(-lengths, -low[i] / length[i] * (1 - 1e-9), side="right"))
        top = np.argsort(-np.abs(v[i]), kind="stable")[:COORDINATES]
        part = w[:end, top]
        rest = np.sqrt(np.maximum(lengths[:end] ** 2 * (1 + 1e-9) - (part * part).sum(1), 0)) * np.sqrt(max(length[i] ** 2 * (1 + 1e-9) - float(v[i][top] @ v[i][top]), 0.0))
        rows = np.flatnonzero((part @ v[i][top] + rest + 1e-9 * most[i] >= low[i]) & (ids[:end] != own[i]))
        scores = w[rows] @ v[i]
        keep = scores >= low[i]
        verified(i, rows[keep], scores[keep])
    plain = np.flatnonzero(reachable & (needed < COORDINATE_FROM))
    plain = plain[np.argsort(needed[plain], kind="stable")]  # those that reach equally far down the block are taken together
    for at in range(0, len(plain), SIDE):
        some = plain[at : at + SIDE]
        with np.errstate(divide="ignore", invalid="ignore"):
            end = [len(w) if low[i] <= 0 else int(np.searchsorted(-lengths, -low[i] / length[i] * (1 - 1e-9), side="right")) for i in some]
        table = v[some] @ w[: max(end, default=0)].T
        for i, n, scores in zip(some, end, table, strict=True):
            rows = np.flatnonzero((scores[:n] >= low[i]) & (ids[:n] != own[i]))
            verified(i, rows, scores[rows])
    return out


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def top_k(vectors: DataFrame, every: int = 50, k: int = K, scale: int = 256, buckets: int = BUCKETS, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The k best inner products of each vector whose vec_id is divisible by `every` with all other vectors.

    vectors has vec_id and embedding; other columns are ignored. Vectors that are null or
    hold a null or non-finite component take no part; those of different dimensions never
    meet, nor do rows of one vec_id (a repeated row is the query's own) and null ids. Repeated
    rows of a candidate each count; repeated query rows give their results once. Scores are
    exact for all finite components; one that a long can't hold counts as the nearest one that
    it can. An empty table gives an empty result.

    Buckets are runs of lengths; each is dealt into blocks of about block_rows vectors. Queries
    come in chunks. A chunk meets a block in one task, so a task holds block_rows +
    chunk_rows vectors, about. A first round over the longest bucket sets the scores to beat,
    the second passes the blocks that can't.
    """
    # A row's deal is stored with it, so a recomputed task deals as before; repeated rows don't share one.
    numbers = stored(taking_part(vectors, scale).withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    size = numbers.agg(F.count("*").alias("n")).first().n
    queries = numbers.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-size // every // chunk_rows)))))
    cuts = sorted(set(numbers.select(F.percentile_approx("length", [i / buckets for i in range(1, buckets)], 100 * buckets).alias("c")).first().c or [])) if buckets > 1 else []
    placed = numbers.withColumn("bucket", F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("length"))) if cuts else F.lit(0))
    sizes = placed.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("length").alias("most"))
    sizes = sizes.withColumn("deals", F.ceil(F.col("n") / block_rows).cast("int")).withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("bucket")))).drop("n")
    blocks = sizes.select("dim", "bucket", "most", "rank", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    deal = F.pmod("salt", F.col("deals"))
    candidates = placed.join(sizes.select("dim", "bucket", "deals", "rank"), ["dim", "bucket"]).select("dim", "bucket", deal.cast("int").alias("deal"), "rank", "vec_id", "v")

    schema = "query_id long, vec_id long, score long"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            q, c = (_matrix(t.column(f"{s}_v"), t.num_rows) for s, t in (("q", left), ("c", right)))
            rows = search(q, left.column("q_vec_id").to_numpy(), left.column("q_floor").to_pylist(), c, right.column("c_vec_id").to_numpy(), k, scale)
        return pa.table([pa.array([r[j] for r in rows], type=pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    def round_of(asked: DataFrame, met: DataFrame) -> DataFrame:
        """asked: queries with floor, dim, bucket, deal. Candidates are sent once for each chunk."""
        chunks = asked.select("dim", "bucket", "deal", "chunk").distinct()
        right = met.join(chunks, ["dim", "bucket", "deal"])
        keys = ["dim", "bucket", "deal", "chunk"]
        sides = [df.select(*(F.col(c).alias(f"{side}_{c}") for c in (*keys, "vec_id", "v", *more))).groupBy(*(f"{side}_{k}" for k in keys)) for side, df, more in (("q", asked, ["floor"]), ("c", right, []))]
        return sides[0].cogroup(sides[1]).applyInArrow(meet, schema)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    start = queries.join(blocks.where("rank = 1"), "dim").withColumn("floor", F.lit(None).cast("long"))
    first = stored(round_of(start, candidates.where("rank = 1")), "first")
    floors = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    asked = queries.join(floors, "vec_id", "left").join(blocks.where("rank > 1"), "dim")
    # A block whose longest vector can't reach the query's floor is passed by (cosine over 1).
    asked = asked.where(F.col("floor").isNull() | (F.col("floor") <= 0) | (F.col("most") * F.col("length") * (1 + 1e-9) >= F.col("floor").cast("double")))
    rest = round_of(asked, candidates.where("rank > 1"))
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same search in DuckDB's SQL, by whole products.
SQL = """
WITH n AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
