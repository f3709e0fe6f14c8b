"""Exact top-k search by MaxScore (operator 3).

A vector is a document of 2 * d possible terms: one term per dimension and sign, with the
magnitude of the component as its impact. A query term of the same sign adds
|q| * impact to the inner product; a term of the other sign can only lower it, so its score
bound is 0. In a shard, the documents are stored by term (one contiguous posting column per
dimension) and go through in blocks that know their largest impacts:

* terms sorted by score bound are split so that the bounds of the non-essential ones sum to
  less than the query's current k-th score: no document can enter the top-k by them alone;
* the postings of the essential terms are traversed and accumulated;
* the others are probed, largest bound first, only for documents that are still competitive,
  that is, whose partial score plus all remaining bounds reaches the k-th score.

Shards are hash partitions of bounded size; every block of queries meets every shard, and the
shard results are merged per query. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import table

#: Vectors of a shard, queries of a block, vectors that share one set of impact bounds.
SHARD_ROWS, QUERY_ROWS, BLOCK_ROWS = 16_384, 4_096, 2_048


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) of every component, x as double.

    Rows whose vector is null or has a null or non-finite component are left out.
    """
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(vec_col).isNotNull()).where(good).select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def maxscore_block(x, bounds, q, floor_score):
    """Positions in a block and their exact scores that may enter the query's top-k.

    x: float64 or Python integers (rows, dims), column-major; sums are exact in either. bounds: per dimension the
    largest positive and the largest negative magnitude. floor_score: the k-th score so far (None while there
    are fewer).
    """
    import numpy as np

    upper = np.where(q > 0, q * bounds[0], -q * bounds[1])  # score bound of each query term
    if floor_score is None:
        return np.arange(len(x)), x @ q
    by_bound = np.argsort(upper, kind="stable")
    sums = np.cumsum(upper[by_bound])
    n_non = int(np.searchsorted(sums, floor_score, side="left"))  # bounds of these sum to less than the k-th score
    if n_non == len(q):
        return np.arange(0), np.zeros(0)
    essential, probes = by_bound[n_non:], by_bound[:n_non][::-1]
    partial = x[:, essential] @ q[essential]
    rows = np.arange(len(x))
    left = sums[n_non - 1] if n_non else 0
    step = 4
    for at in range(0, len(probes), step):
        alive = partial + left >= floor_score
        if not alive.all():
            rows, partial = rows[alive], partial[alive]
            if not len(rows):
                break
        few = probes[at : at + step]
        partial = partial + x[np.ix_(rows, few)] @ q[few]
        left -= upper[few].sum()
    alive = partial >= floor_score
    return rows[alive], partial[alive]


def search_shard(doc_ids, docs, query_ids, queries, k: int):
    """The k best (query_id, id, score) of one shard for each query of a block, ties to smaller id."""
    import numpy as np

    dims = max(docs.shape[1], queries.shape[1])
    pad = lambda a: np.pad(a, ((0, 0), (0, dims - a.shape[1])))  # noqa: E731  a shorter vector has zeros there
    docs, queries = pad(docs), pad(queries)
    most = float(np.abs(docs).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims
    kind = np.float64 if most < 2.0**53 else object  # float64 sums are exact integers up to there
    blocks = []
    for at in range(0, len(docs), BLOCK_ROWS):
        x = docs[at : at + BLOCK_ROWS]
        bounds = (np.maximum(x.max(axis=0), 0).astype(kind), np.maximum(-x.min(axis=0), 0).astype(kind))
        blocks.append((doc_ids[at : at + BLOCK_ROWS], np.asfortranarray(x.astype(kind)), bounds))
    for qid, q in zip(query_ids, queries.astype(kind), strict=True):
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, kind)
        for ids, x, bounds in blocks:
            kth = best[k - 1] if len(best) >= k else None
            rows, scores = maxscore_block(x, bounds, q, kth)
            keep = ids[rows] != qid
            best_ids, best = np.concatenate([best_ids, ids[rows][keep]]), np.concatenate([best, scores[keep]])
            if len(best) > k:
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
        if len(best) and len(best) <= k:
            top = np.lexsort((best_ids, -best))
            best_ids, best = best_ids[top], best[top]
        for i, s in zip(best_ids.tolist(), best.tolist(), strict=True):
            yield qid, i, max(-(2**63), min(2**63 - 1, int(s)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shards: int | None = None, query_blocks: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): every query's k best rows by integer inner product.

    The query's own id is no candidate; ties go to the smaller id; a query with fewer than k
    candidates gets all. Ids are whole numbers; rows without one take no part, and of rows that
    repeat an id each counts (the same id may then be listed twice). Vectors of unlike length are compared as if padded with
    zeros; scores beyond the long range stop at its ends. An empty table gives no rows.
    Each task holds one shard and one block of queries, both bounded, whatever the input.
    """
    docs = quantise(vectors, id_col, vec_col).where("id is not null")
    asks = quantise(queries, id_col, vec_col).where("id is not null")
    if shards is None or query_blocks is None:
        sizes = vectors.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
        shards = shards or max(1, -(-sizes[0] // SHARD_ROWS))
        query_blocks = query_blocks or max(1, -(-sizes[1] // QUERY_ROWS))
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    series = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = docs.select("id", "v", spread(shards, 1).alias("shard"), series(query_blocks).alias("block"))
    right = asks.select("id", "v", series(shards).alias("shard"), spread(query_blocks, 2).alias("block"))

    def run(key, left_rows, right_rows):
        import numpy as np
        import pyarrow as pa

        def matrix(t):
            lists = t.column("v").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
            out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            return t.column("id").to_numpy(), out

        rows = []
        if left_rows.num_rows and right_rows.num_rows:
            rows = list(search_shard(*matrix(left_rows), *matrix(right_rows), k))
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "id", "score"), cols, strict=True)})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 50 as queries against all other rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
