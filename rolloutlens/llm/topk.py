"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit per dimension, set if the value is above zero. A
code is cut into segments; an index of a block of rows lists the rows by the
value of each segment. For a query, segment search radii grow one segment at
a time: after segment j has been searched up to radius a, and the others
before it too, every row within a * segments + j bits has been met. The search
ends when the kth verified distance is within that bound, so the result is
exact: no row outside can be nearer or, at equal distance, have a smaller id.

Rows are dealt into blocks by a hash of the id, so common vectors or sources
spread evenly, and are shuffled once. A block's rows reach their task first
and become its index, once; then all queries stream past it in batches, so a
task holds the index and one batch. A small table has fewer blocks than the
cluster has partitions; each block is then copied for as many chunks of the
queries, which does not depend on the number of queries. The k best of every
block are merged per query row.

The length of the vectors is the most common one of the table (the longer of
two equally common ones); a code has as many segments as it needs.

Defined results: rows with a null id, or whose vector is null, empty or of
another length than most, have no code and take no part. Ties go to the
smaller id. Repeated rows are separate rows, also as queries: each has its
own k rows. A query is itself among the rows.
Fewer rows than k: all of them. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

K = 10
#: Most rows of an index block (about 50 bytes each for 64 bits).
BLOCK_ROWS = 2_000_000
#: Fewer queries do not make up for an index.
CHUNK_QUERIES = 64
QUERY_EVERY = 20
SEGMENT = 16


def codes(rows: DataFrame, id_col: str, vector_col: str, bits: int = 64) -> DataFrame:
    """id, code: bit i of value i above zero, as a signed long, or an array of longs where there are over 64 bits."""
    v = F.col(vector_col)

    def word(part):
        weight = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(weight, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    code = word(v) if bits <= 64 else F.array(*[word(F.slice(v, a + 1, 64)) for a in range(0, bits, 64)])
    return rows.where(F.col(id_col).isNotNull() & (F.size(v) == bits)).select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def common_length(rows: DataFrame, id_col: str, vector_col: str) -> int:
    """The most common length of the vectors that can take part; 64 if there is none."""
    n = rows.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).groupBy(F.size(vector_col).alias("n")).count()
    top = n.orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 64


class MultiIndex:
    """One block of codes (a column for each 64 bits, if over 64), listed by the value of each 16-bit segment."""

    def __init__(self, ids: np.ndarray, code: np.ndarray, bits: int = 64):
        order = np.argsort(ids, kind="stable")
        self.ids, self.code = ids[order], code[order].view(np.uint64)
        self.words = self.code.reshape(len(ids), -1)
        self.parts = [((self.words[:, SEGMENT * j // 64] >> np.uint64(SEGMENT * j % 64)) & np.uint64(2**SEGMENT - 1)).astype(np.int64)
                      for j in range(-(-bits // SEGMENT))]
        self.rows = [np.argsort(p, kind="stable") for p in self.parts]
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(p, minlength=2**SEGMENT))]) for p in self.parts]
        self.masks: dict[int, np.ndarray] = {}

    def at_radius(self, a: int) -> np.ndarray:
        if a not in self.masks:
            self.masks[a] = np.array([sum(1 << i for i in c) for c in combinations(range(SEGMENT), a)], np.int64)
        return self.masks[a]

    def bucket(self, j: int, values: np.ndarray) -> np.ndarray:
        """Rows whose segment j has one of the values."""
        a, z = self.start[j][values], self.start[j][values + 1]
        n = z - a
        keep = n > 0
        a, n = a[keep], n[keep]
        if not len(n):
            return np.zeros(0, np.int64)
        return self.rows[j][np.repeat(a - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())]

    def search(self, q: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest rows, ties by id."""
        m, code = len(self.parts), np.array([(q >> (64 * w)) & (2**64 - 1) for w in range(self.words.shape[1])], np.uint64)
        best, dist = np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = [(q >> (SEGMENT * j)) & (2**SEGMENT - 1) for j in range(m)]
        for a in range(SEGMENT + 1):
            for j in range(m):
                new = self.bucket(j, own[j] ^ self.at_radius(a))
                if len(new):
                    d = np.bitwise_count(self.words[new] ^ code).sum(axis=1, dtype=np.int64)
                    if len(best) == k:
                        near = d <= dist[-1]
                        new, d = new[near], d[near]
                    rows, first = np.unique(np.concatenate([best, new]), return_index=True)  # a row's place follows its id
                    d = np.concatenate([dist, d])[first]
                    order = np.lexsort((rows, d))[:k]
                    best, dist = rows[order], d[order]
                if len(best) == min(k, len(self.ids)) and (not len(best) or dist[-1] <= a * m + j):
                    return self.ids[best], dist
        return self.ids[best], dist


FOUND = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.int32())])


def _number(code: int | list[int]) -> int:
    return sum((w % 2**64) << (64 * j) for j, w in enumerate(code if isinstance(code, list) else [code]))


def _search_blocks(k: int, bits: int):
    """Batches sorted by block, a block's rows (q null) before the queries."""
    def built(held: list[pa.RecordBatch]) -> MultiIndex:
        t = pa.Table.from_batches(held)
        code = t.column("code").to_numpy()
        return MultiIndex(t.column("id").to_numpy(), np.stack(code) if bits > 64 else code, bits)

    def run(batches):
        block, held, index = None, [], None
        for batch in batches:
            r, is_row = batch.column("r").to_numpy(), batch.column("q").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (is_row[1:] != is_row[:-1]))).tolist() if len(r) else []
            for a, z in zip(cuts, [*cuts[1:], len(r)]):
                part = batch.slice(a, z - a)
                if r[a] != block:
                    block, held, index = r[a], [], None
                if is_row[a]:
                    held.append(part)
                elif held or index:
                    index, held = index or built(held), []
                    got = [index.search(_number(c), k) for c in part.column("code").to_pylist()]
                    n = [len(g[0]) for g in got]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(part.column("q").to_numpy(), n)), pa.array(np.repeat(part.column("id").to_numpy(), n)),
                         pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]).astype(np.int32))], schema=FOUND)
    return run


def search(rows: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, bits: int = 64) -> DataFrame:
    """rows, queries: id and code of so many bits. query_id, rank, neighbor_id,
    distance; k rows (or as many as there are) for every row of ``queries``."""
    asked = C.written(queries.select("id", "code").withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    blocks = max(1, -(-rows.count() // block_rows))
    chunks = max(1, min(C.shuffle_partitions(rows.sparkSession) // blocks, asked.count() // CHUNK_QUERIES))

    def each(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    block, chunk = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.pmod(F.xxhash64("q"), F.lit(chunks))
    left = rows.select(block.alias("b"), each(chunks).alias("c"), F.lit(None).cast("long").alias("q"), "id", "code")
    right = asked.select(each(blocks).alias("b"), chunk.alias("c"), "q", "id", "code")
    d = left.unionByName(right).select((F.col("b") * chunks + F.col("c")).alias("r"), "q", "id", "code")
    near = d.repartition(blocks * chunks, "r").sortWithinPartitions("r", F.col("q").asc_nulls_first()) \
        .mapInArrow(_search_blocks(k, bits), "q long, query_id long, neighbor_id long, distance int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "neighbor_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def query(spark, sf_dir: str) -> DataFrame:
    table = C.table(spark, sf_dir, "embeddings")
    bits = common_length(table, "vec_id", "embedding")
    rows = C.written(codes(table, "vec_id", "embedding", bits), "topk-codes")
    return search(rows, rows.where(F.col("id") % QUERY_EVERY == 0), bits=bits)


SQL = """
WITH n AS (
  SELECT len(embedding) AS n FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1
), c AS (
  SELECT row_number() OVER () AS place, vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = (SELECT n FROM n)
), p AS (
  SELECT q.place, q.id AS query_id, r.id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM c q, c r WHERE q.id % 20 = 0
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, neighbor_id, distance FROM k WHERE rank <= 10
"""
