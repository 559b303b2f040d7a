"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's dimensions are terms. Candidates are cut into blocks; within a block
each term has a postings list of (row, weight). A sparse query row walks its own
terms and scatters weight products into a dense array of scores, one per row of
the block, from which a partition selects the best k. The block winners of a
query are then merged. Blocks have a fixed number of rows, so memory is bounded
at any table size; nothing is broadcast.

Defined cases: vectors that are null or hold a null or non-finite component take
no part, nor do rows without an id; an empty vector scores 0 against every row;
shorter vectors count as padded with zeros; repeated ids count once, with their
smallest vector; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm._store import prepare, stage

CANDIDATE_ROWS = 16384
QUERY_ROWS = 2048
_OUT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, weights): floor(scale * x) of every component, x as double."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    weights = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)
        .select(F.col("vec_id").cast("long").alias("vec_id"), weights.alias("weights"))
        .groupBy("vec_id").agg(F.min("weights").alias("weights"))
    )


def _terms(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of the non-zero components of a column of arrays."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    sizes = np.diff(arr.offsets.to_numpy())
    values = arr.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    used = values != 0
    return rows[used], terms[used], values[used]


def best_in_block(queries: pa.Table, block: pa.Table, k: int) -> pa.Table:
    """The k best rows of a block for each query, ties to the smaller id."""
    empty = pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
    if not queries.num_rows or not block.num_rows:
        return empty
    block = block.sort_by("vec_id")
    ids, n = block["vec_id"].to_numpy(), block.num_rows
    rows, terms, weights = _terms(block["weights"])
    q_ids = queries["query_id"].to_numpy()
    q_rows, q_terms, q_weights = _terms(queries["weights"])
    top = int(np.abs(weights).max(initial=0)) * int(np.abs(q_weights).max(initial=0)) * (int(terms.max(initial=0)) + 1)
    kind = np.int32 if top < 2**31 else np.int64
    order = np.argsort(terms, kind="stable")
    rows, terms, weights = rows[order], terms[order], weights[order].astype(kind)
    postings = {}
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else []
    for a, b in zip(starts, [*starts[1:], len(terms)]):
        if 2 * (b - a) > n:  # a dense list: its missing rows add zero
            full = np.zeros(n, kind)
            full[rows[a:b]] = weights[a:b]
            postings[int(terms[a])] = (None, full)
        else:
            postings[int(terms[a])] = (rows[a:b], weights[a:b])
    bounds = np.searchsorted(q_rows, np.arange(len(q_ids) + 1))
    scores, part = np.zeros(n, kind), np.zeros(n, kind)
    out = []
    for i, query in enumerate(q_ids):
        scores[:] = 0
        for t, w in zip(q_terms[bounds[i]: bounds[i + 1]].tolist(), q_weights[bounds[i]: bounds[i + 1]].astype(kind)):
            at, listed = postings.get(t, (None, None))
            if listed is None:
                continue
            if at is None:
                np.multiply(listed, w, out=part)
                np.add(scores, part, out=scores)
            else:
                scores[at] += listed * w
        own = np.searchsorted(ids, query)
        mine = own < n and ids[own] == query
        least = np.iinfo(kind).min
        if mine:
            scores[own] = least
        left = n - int(mine)
        if left > k:
            bar = np.partition(scores, n - k)[n - k]
            above = np.flatnonzero(scores > bar)
            chosen = np.r_[above, np.flatnonzero(scores == bar)[: k - len(above)]]
        else:
            chosen = np.flatnonzero(np.arange(n) != own) if mine else np.arange(n)
        out.append((np.full(len(chosen), query), ids[chosen], scores[chosen].astype(np.int64)))
    return pa.table({n: pa.array(np.concatenate([o[j] for o in out]), pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})


def exact_top_k(queries: DataFrame, items: DataFrame, k: int = 20, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best items for every query row.

    queries: (query_id, weights); items: (vec_id, weights); weights array<long>.
    Every query meets every block, so both sides are copied once per block of the
    other: rows moved are |Q| * blocks(items) + |items| * blocks(Q).
    """
    prepare(items.sparkSession)
    n_items, n_queries = items.count(), queries.count()
    cs, qs = max(1, -(-n_items // candidate_rows)), max(1, -(-n_queries // query_rows))
    left = queries.select("query_id", "weights", F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int").alias("qb")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cs - 1))))
    right = items.select("vec_id", "weights", F.pmod(F.xxhash64("vec_id"), F.lit(cs)).cast("int").alias("cb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))
    parts = max(items.sparkSession.sparkContext.defaultParallelism, min(cs * qs, 100_000))
    cells = left.repartition(parts, "qb", "cb").groupBy("qb", "cb").cogroup(right.repartition(parts, "qb", "cb").groupBy("qb", "cb"))
    found = cells.applyInArrow(lambda a, b: best_in_block(a, b, k), _OUT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stage(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    queries = vectors.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    return exact_top_k(queries, vectors, 20)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE)))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
