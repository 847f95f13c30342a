"""Exact top-k search by inner product: histograms of all scores, refined until they show each query's k-th score.

A block of queries goes to all tasks. Every pass scores every row, and counts the scores of each query in
buckets of a range; the bucket that holds the k-th score is the next range, until a bucket is one score.
The last pass lets through what lies above the k-th score and the smallest ids at it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, shared_dir, staged

#: Bytes of queries in a block, and rows at most: what the driver holds and sends at a time.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 2048
#: Buckets of a histogram, and scores that a task holds at a time.
BUCKETS, SCORES = 512, 4 << 20
#: Below this bound on any sum of products, doubles are exact.
EXACT = 1 << 53


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id, v: vectors with each component x as floor(scale * x), of rows that take part.

    A vector that is null or holds a null or a component that isn't finite takes no part, nor does a row
    without an id. Rows that repeat an id are rows of their own: `row` tells them apart.
    """
    rows = picked(vectors, vec_id="long", embedding="array<double>").filter("vec_id is not null and embedding is not null")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x * scale))
    return staged(rows.filter(finite).select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v")), "vectors")


def matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    """Vectors as rows of `width` columns; what a vector lacks is 0, what it has beyond that meets no query's component."""
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten()).astype(kind)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=kind)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = at < width
    out[np.repeat(np.arange(len(sizes)), sizes)[kept], at[kept]] = flat[kept]
    return out


class _Block:
    """A block of queries, their ranges so far, and how often a higher score has been seen."""

    def __init__(self, rows: list, longest: float, k: int):
        self.row = np.array([r["row"] for r in rows], dtype=np.int64)
        self.ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        self.width = max(len(r["v"]) for r in rows)
        norms = np.array([np.sqrt(float(sum(x * x for x in r["v"]))) for r in rows])
        bound = float(norms.max()) * longest * (1 + 1e-9) + 1
        if bound >= 1 << 63:
            raise ValueError("a score doesn't fit into 64 bits")
        self.kind = np.float64 if bound < EXACT else np.int64
        self.q = matrix(pa.array([r["v"] for r in rows], pa.list_(pa.int64())), self.width, self.kind).T.copy()
        reach = [int(x) for x in np.ceil(norms * longest * (1 + 1e-9)) + 1]
        self.lo = np.array([-x for x in reach], dtype=self.kind)
        self.span = np.array([2 * x + 1 for x in reach], dtype=self.kind)  # of scores in a range
        self.step = -(-self.span // BUCKETS)  # of scores in a bucket
        self.above = np.zeros(len(rows), dtype=np.int64)
        self.k = k
        self.few = np.zeros(len(rows), dtype=bool)  # fewer than k scores in all
        self.open = np.ones(len(rows), dtype=bool)

    def scores(self, batches):
        """(row ids, vec_ids, scores: rows by queries, places of a query's own row) in parts of at most SCORES."""
        order = np.argsort(self.row)
        step = max(1, SCORES // len(self.row))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, ids = np.asarray(part.column(0)), np.asarray(part.column(1))
                s = matrix(part.column(2), self.width, self.kind) @ self.q
                found = np.minimum(np.searchsorted(self.row, rows, sorter=order), len(order) - 1)
                own = np.flatnonzero(self.row[order[found]] == rows)
                yield ids, s, (own, order[found[own]])

    def count(self, batches):
        """q, b, n: how many scores lie in each bucket of each open query's range."""
        hist = np.zeros(len(self.row) * BUCKETS, dtype=np.int64)
        base = np.arange(len(self.row), dtype=np.int64) * BUCKETS
        for _, s, (own, of) in self.scores(batches):
            at = s - self.lo
            at[own, of] = -1
            inside = (at >= 0) & (at < self.span) & self.open
            hist += np.bincount((np.floor_divide(at, self.step).astype(np.int64) + base)[inside], minlength=len(hist))
        full = np.flatnonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(full // BUCKETS, pa.int32()), pa.array(full % BUCKETS, pa.int32()), pa.array(hist[full])], ["q", "b", "n"])

    def narrow(self, chosen: list) -> None:
        """chosen (q, b, before): the bucket that holds a query's k-th score, and the scores in higher ones."""
        found = {r["q"]: (r["b"], r["before"]) for r in chosen}
        for q in np.flatnonzero(self.open):
            if q not in found:
                self.few[q] = True  # all of its scores are among the k highest
                self.open[q] = False
                continue
            b, before = found[q]
            self.lo[q] += b * self.step[q]
            self.above[q] += before
            self.open[q] = self.step[q] > 1
            self.span[q] = self.step[q]
            self.step[q] = -(-self.span[q] // BUCKETS)

    def highest(self, batches):
        """q, vec_id, score: what is above the k-th score, and the smallest ids at it, as many as may be needed."""
        ties = {}
        for ids, s, (own, of) in self.scores(batches):
            over = (s > self.lo) | self.few
            over[own, of] = False
            at, q = np.nonzero(over)
            yield self._rows(q, ids[at], s[at, q])
            same = (s == self.lo) & ~self.few
            same[own, of] = False
            at, q = np.nonzero(same)
            for one, vec_id in zip(q.tolist(), ids[at].tolist(), strict=True):
                ties.setdefault(one, []).append(vec_id)
            for one in set(q.tolist()):
                ties[one] = sorted(ties[one])[: self.k - int(self.above[one])]
        q = np.repeat(np.array(list(ties), dtype=np.int64), [len(x) for x in ties.values()])
        yield self._rows(q, np.array([i for x in ties.values() for i in x], dtype=np.int64), self.lo[q])

    def _rows(self, q, ids, scores):
        whole = pa.array(scores.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(self.row[q]), pa.array(self.ids[q]), pa.array(ids), whole], ["row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row that `is_query` (of vec_id) picks, the k highest scores
    among all other rows, or all if there are fewer; ties go to smaller ids.

    Vectors of other lengths are filled up with zeros. A row that repeats a query's id is a query of its own and a
    candidate of the other. An empty table, or one without queries or other rows, gives no rows. Scores beyond
    64 bits are an error. The work grows with queries times rows, in blocks of queries; the driver holds one block
    (BLOCK_ROWS rows, give or take what a hash deals unevenly), whose results are in the shared folder before the next.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    facts = rows.agg(F.max(length).alias("longest"), F.count_if(is_query).alias("n"), F.max(F.when(is_query, F.size("v"))).alias("width")).collect()[0]
    kind = "row long, query_id long, vec_id long, score long"
    if not facts["n"]:
        return _ranked(spark.createDataFrame([], kind), k)
    blocks = -(-facts["n"] // min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(1, facts["width"])))))
    queries = rows.filter(is_query).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    if blocks > 1:  # so that a block's rows lie together in the files
        queries = staged(queries.repartitionByRange("block").sortWithinPartitions("block"), "queries")
    to = f"{shared_dir(spark)}/top-k-{uuid.uuid4().hex}"
    for number in range(blocks):
        asked = queries.filter(F.col("block") == number).collect()
        if asked:
            _ranked(_searched(rows, _Block(asked, facts["longest"], k), kind), k).write.mode("append").parquet(to)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(to)


def _searched(rows: DataFrame, block: _Block, kind: str) -> DataFrame:
    higher = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("b")))
    while block.open.any():
        counts = rows.mapInArrow(block.count, "q int, b int, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        need = rows.sparkSession.createDataFrame([(int(q), int(block.k - block.above[q])) for q in np.flatnonzero(block.open)], "q int, need long")
        reached = counts.withColumn("upto", higher).join(F.broadcast(need), "q").filter("upto >= need and upto - n < need")
        block.narrow(reached.select("q", "b", (F.col("upto") - F.col("n")).alias("before")).collect())  # a row a query of the block
    return rows.mapInArrow(block.highest, kind)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB, for queries of ids divisible by 50 and the five highest scores.
ORACLE = """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.r <> v.r),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""
