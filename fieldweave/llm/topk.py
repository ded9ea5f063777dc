"""Exact top-k inner products over norm-sorted vectors.

Vectors are sorted by descending length and kept in blocks. For a query, a
block matters only as far as ``|q| |v|`` reaches the k-th best score so far.
Rows are rotated by the singular vectors of all vectors, so that a few leading
coordinates carry much of a product; by the Cauchy-Schwarz inequality the rest
is at most the product of the residual lengths. What both bounds let through
is scored in integers.

Defined results: components become ``floor(256 x)`` with ``x`` as double; what
overflows a double then is held at its greatest value. Vectors that are null,
empty or hold a null, NaN or infinite component take no part, nor do rows
without an id. Rows that repeat an id are vectors of their own: each is a
candidate for all rows but itself, and each is a query with ranks from 1.
Scores are exact; beyond the range of a long they count as its ends. Vectors
of different lengths have no product and are searched apart. A query without
candidates has no rows; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, table

K = 5
SCALE = 256.0
#: Queries that go to every task at once; with 64 components of 8 bytes, 4 MB.
QUERIES_AT_ONCE = 8192
#: Rows of a block; its scores against some queries are in memory together.
BLOCK_ROWS = 1024
QUERY_ROWS = 256
#: Share of the squared length that the leading coordinates should carry.
LEADING = 0.7
#: Rows of a task.
TASK_ROWS = 20_000
#: Products below these sizes are exact in doubles and in longs.
IN_DOUBLES, IN_LONGS = 2.0**53, 2.0**63
#: Components are cut at this size where only a direction is asked for.
FAR = 1e140

RESULT = "query_id long, query_row long, vec_id long, score long"


def _whole(x: Column) -> Column:
    """The components as whole numbers in doubles; beyond 2^53 doubles are whole."""
    most = float(np.finfo(np.float64).max)

    def one(c: Column) -> Column:
        y = F.least(F.greatest(c.cast("double") * SCALE, F.lit(-most)), F.lit(most))
        return F.when(F.abs(y) < IN_DOUBLES, F.floor(y).cast("double")).otherwise(y)

    return F.transform(x, one)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v, dim, norm2`` of the rows that take part."""
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.explode(F.array(_whole(F.col(vector_col)))).alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    return rows.select("vec_id", "v", F.size("v").alias("dim"), norm2.alias("norm2"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def rotation(vectors: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Right singular vectors of all vectors, largest first, and how many coordinates lead.

    Every task sums the outer products of its rows; the driver adds ``dim`` by
    ``dim`` sums, one for each task.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = np.clip(_matrix(batch.column(0), dim), -FAR, FAR)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = vectors.select("v").mapInArrow(sums, "i int, row array<double>")
    rows = parts.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(dim)]).orderBy("i").collect()
    values, turned = np.linalg.eigh(np.array([list(r)[1:] for r in rows]))
    share = np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
    return np.ascontiguousarray(turned[:, ::-1]), int(min(dim, np.searchsorted(share, LEADING) + 1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of rows of whole numbers, exact; those beyond a long's range at its ends."""
    with np.errstate(over="ignore"):
        most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < IN_DOUBLES:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if most < IN_LONGS:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(high, max(low, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


def best(scores: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest of several (ids, scores), ties to the smaller id."""
    ids, values = (np.concatenate(x) for x in zip(*scores, strict=True))
    order = np.lexsort((ids, ~values))[:k]  # not negated: the least long has no opposite
    return ids[order], values[order]


class Searcher:
    """Keeps the best ``k`` of some queries while blocks of vectors pass by.

    Bounds that overflow rule nothing out.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, floors: np.ndarray, turn: np.ndarray, leading: int, k: int):
        self.ids, self.rows, self.q, self.k, self.leading = ids, rows, queries, k, leading
        self.floor = floors.astype(float)  # the k-th best score so far; a smaller one cannot enter
        self.turn = turn
        self.lead, self.rest, self.norm = self._parts(queries)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.scored = 0

    def _parts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading coordinates, length of the others, and length."""
        with np.errstate(over="ignore", invalid="ignore"):
            rotated = v @ self.turn
            return np.ascontiguousarray(rotated[:, : self.leading]), np.sqrt((rotated[:, self.leading :] ** 2).sum(1)), np.sqrt((v**2).sum(1))

    def block(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray) -> None:
        """``v``: vectors by descending length; ``rows``: a number of its own for each row of the table."""
        lead, rest, norm = self._parts(v)
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-9 * (1 + norm[0] * self.norm.max())
            alive = np.flatnonzero(~(self.norm * norm[0] + slack < self.floor))
            for start in range(0, len(alive), QUERY_ROWS):
                some = alive[start : start + QUERY_ROWS]
                # rows are by length: the prefix that any of these queries can need
                need = float(np.min((self.floor[some] - slack) / np.maximum(self.norm[some], 1e-300)))
                reach = int(np.searchsorted(-norm, -need, side="right")) if np.isfinite(need) else len(norm)
                bound = self.lead[some] @ lead[:reach].T + np.outer(self.rest[some], rest[:reach]) + slack
                hit, row = np.nonzero(~(bound < self.floor[some][:, None]))
                for h in range(0, len(hit), 1 << 18):
                    self._score(some[hit[h : h + (1 << 18)]], row[h : h + (1 << 18)], ids, rows, v)

    def _score(self, q: np.ndarray, row: np.ndarray, ids: np.ndarray, rows: np.ndarray, v: np.ndarray) -> None:
        other = self.rows[q] != rows[row]
        q, row = q[other], row[other]
        self.scored += len(q)
        score = products(self.q[q], v[row])
        cuts = np.flatnonzero(np.diff(q)) + 1
        for at, of, value in zip(np.split(q, cuts), np.split(ids[row], cuts), np.split(score, cuts), strict=True):
            if len(at):
                i = at[0]
                self.found[i] = best([self.found[i], (of, value)], self.k)
                if len(self.found[i][1]) == self.k:
                    self.floor[i] = max(self.floor[i], float(self.found[i][1][-1]))

    def least(self) -> float:
        """The square of the least length that can still matter to any query."""
        with np.errstate(over="ignore", invalid="ignore"):
            length = float(np.min((self.floor - 1e-6 * (1 + np.abs(self.floor))) / np.maximum(self.norm, 1e-300)))
        return length**2 * (1 - 1e-9) if 0 < length < FAR else 0.0


def _search(vectors: DataFrame, lot: Searcher) -> DataFrame:
    """What is found for a lot of queries among ``vectors(vec_id, row, v)``."""
    dim, k = lot.q.shape[1], lot.k
    shared = vectors.sparkSession.sparkContext.broadcast((lot.ids, lot.rows, lot.q, lot.floor, lot.turn, lot.leading))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value, k)
        for batch in batches:
            own, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            m = _matrix(batch.column(2), dim)
            with np.errstate(over="ignore"):
                order = np.argsort(-(m**2).sum(1), kind="stable")
            for start in range(0, len(order), BLOCK_ROWS):
                some = order[start : start + BLOCK_ROWS]
                searcher.block(own[some], rows[some], m[some])
        sizes = [len(x) for x, _ in searcher.found]
        columns = [np.repeat(searcher.ids, sizes), np.repeat(searcher.rows, sizes), np.concatenate([x for x, _ in searcher.found]), np.concatenate([x for _, x in searcher.found])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "query_row", "vec_id", "score"])

    return vectors.select("vec_id", "row", "v").mapInArrow(run, RESULT)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _vectors(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["row"] for r in rows], np.int64), np.array([list(r["v"]) for r in rows], float)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = K, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """The ``k`` highest integer inner products of every query: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on ``vec_id``. Queries go to the tasks in lots
    of bounded size and, as far as files go, of like lengths. Each lot first
    meets the longest vectors; the k-th score then bounds the search through
    all others, and the files of vectors too short for the lot are not read.
    Every vector meets every query unless a bound rules the pair out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    whole = scratch.write(integer_vectors(vectors).withColumn("row", F.monotonically_increasing_id()), "whole")
    parts = []
    for dim, n in sorted((r["dim"], r["count"]) for r in whole.groupBy("dim").count().collect()):
        # Longest first, in rows of equal numbers over the tasks; written, so that lots read it again.
        own = whole.where(F.col("dim") == dim)
        by_norm = scratch.write(own.repartitionByRange(max(1, -(-n // TASK_ROWS)), F.col("norm2").desc()).sortWithinPartitions(F.col("norm2").desc()), f"dim{dim}")
        turn, leading = rotation(by_norm, dim)
        head = _vectors(by_norm.orderBy(F.col("norm2").desc(), "row").limit(BLOCK_ROWS).select("vec_id", "row", "v").collect())
        asked = scratch.write(by_norm.where(is_query).select("vec_id", "row", "v"), f"asked{dim}")
        for lot, rows in enumerate(batched(asked.toLocalIterator(), queries_at_once)):
            first = Searcher(*_vectors(rows), np.full(len(rows), -np.inf), turn, leading, k)
            first.block(*head)
            found = ranked(_search(by_norm.where(F.col("norm2") >= first.least()), first), k)
            parts.append(scratch.write(found, f"found{dim}_{lot}"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""
