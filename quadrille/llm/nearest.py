"""Nearest neighbours by cosine with score-aware anisotropic quantisation.

Vectors are scaled to length 1 and cut into subspaces of SUB dimensions with 16 centres each: four bits a subspace. Centres and codes minimise
|r|^2 + (eta - 1) <r, x>^2 of the residual r, so error parallel to the vector, which moves its inner products, costs eta times as
much as error across it. Centres are fitted on at most SAMPLE vectors; every row is coded. A search scans packed codes (two to a
byte, so a table of 256 sums serves two subspaces), keeps the KEEP best of every CHUNK rows per query, and ranks those again
exactly, in double precision on the original vectors.

Queries run in blocks of about QUERY_BLOCK vectors; only one block (bounded) is broadcast at a time, against all rows. A task
returns k rows per query.

Defined cases: vectors that are null, zero, or hold a null or a non-finite component, and rows without an id, take no part; vectors of
different lengths have no cosine, so each length is searched by itself, with a quantiser and an index of its own; ties in score go to the
smaller id; a row isn't its own neighbour, but other rows with its id are; repeated rows each count, as candidates and as queries; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

SUB, CENTRES, THRESHOLD = 2, 16, 0.2
SAMPLE, ROUNDS = 8192, 5
KEEP, CHUNK = 192, 4096
QUERY_BLOCK, QUERY_SLICE = 2048, 128


class Quantiser:
    """Product quantiser under the anisotropic loss."""

    def __init__(self, dims: int, threshold: float = THRESHOLD):
        self.dims = dims
        self.parts = -(-dims // SUB)
        self.width = self.parts + self.parts % 2  # an even number of codes, two to a byte
        self.eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
        self.centres = np.zeros((self.width, CENTRES, SUB))

    def _cut(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width * SUB))
        out[:, : self.dims] = x
        return out.reshape(len(x), self.width, SUB)

    def fit(self, x: np.ndarray, seed: int = 3) -> "Quantiser":
        """x: unit vectors."""
        cut, r = self._cut(x), np.random.default_rng(seed)
        if not len(x):
            return self
        for m in range(self.width):
            self.centres[m] = cut[r.integers(0, len(x), CENTRES), m] + r.normal(0, 1e-3, (CENTRES, SUB))
            for _ in range(5):  # plain k-means to start with
                near = ((cut[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1)
                for c in np.unique(near):
                    self.centres[m, c] = cut[near == c, m].mean(0)
        for _ in range(ROUNDS):
            codes = self._codes(cut)
            for m in range(self.width):
                residual = cut - self.centres[np.arange(self.width), codes]
                along = (residual * cut).sum((1, 2))
                own = (residual[:, m] * cut[:, m]).sum(1)
                a = along - own + (cut[:, m] ** 2).sum(1)
                for c in np.unique(codes[:, m]):
                    i = codes[:, m] == c
                    v = cut[i, m]
                    left = len(v) * np.eye(SUB) + (self.eta - 1) * v.T @ v
                    self.centres[m, c] = np.linalg.solve(left, (v + (self.eta - 1) * a[i, None] * v).sum(0))
        return self

    def _codes(self, cut: np.ndarray, passes: int = 3) -> np.ndarray:
        """Codes by coordinate descent: one subspace at a time, the others' residual held."""
        cross = ((cut[:, :, None] - self.centres) ** 2).sum(3)
        along = (cut**2).sum(2)[:, :, None] - np.einsum("nms,mcs->nmc", cut, self.centres)
        codes = cross.argmin(2)
        at = np.arange(len(cut))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(passes):
            for m in range(self.width):
                rest = total - along[at, m, codes[:, m]]
                codes[:, m] = (cross[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                total = rest + along[at, m, codes[:, m]]
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Packed codes, one byte per two subspaces."""
        out = np.empty((len(x), self.width // 2), np.uint8)
        for at in range(0, len(x), CHUNK):
            c = self._codes(self._cut(x[at : at + CHUNK])).astype(np.uint8)
            out[at : at + CHUNK] = c[:, ::2] | (c[:, 1::2] << 4)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what each value of each byte adds to each query's score."""
        t = np.einsum("qms,mcs->qmc", self._cut(q), self.centres).astype(np.float32)
        low, high = t[:, ::2], t[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), self.width // 2, 256)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(table: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.select("vec_id", e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))


def lengths(rows: DataFrame) -> list[int]:
    """The lengths of vectors, the most common one first; on ties the larger."""
    per = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).collect()
    return [r["d"] for r in per]


def usable(table: DataFrame, dims: int | None = None) -> DataFrame:
    """The valid rows of one length: the most common one unless it is given."""
    rows = valid(table)
    dims = dims or next(iter(lengths(rows)), 0)
    return rows.where(F.size("embedding") == dims)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def fitted(rows: DataFrame, sample: int = SAMPLE) -> Quantiser | None:
    """rows: as of usable(), on disk."""
    first = rows.limit(1).collect()
    if not first:
        return None
    dims, n = len(first[0]["embedding"]), rows.count()
    share = min(1.0, sample / n)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding").toArrow()
    x = _matrix(drawn.column(0).combine_chunks(), dims) if drawn.num_rows else np.array([first[0]["embedding"]])
    return Quantiser(dims).fit(_unit(x))


def indexed(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """rows with their packed codes and a number of their own each, which holds once the index is written."""
    dims = quantiser.dims

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for b in batches:
            codes = quantiser.encode(_unit(_matrix(b.column(1), dims)))
            own = pa.array(np.arange(at, at + b.num_rows))
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), own], names=["vec_id", "embedding", "codes", "row"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, codes binary, row long")


def _top(approx: np.ndarray, keep: int) -> np.ndarray:
    """Indices of the keep largest values; of equal values at the edge the first ones."""
    if len(approx) <= keep:
        return np.arange(len(approx))
    edge = np.partition(approx, len(approx) - keep)[len(approx) - keep]
    over = np.flatnonzero(approx > edge)
    return np.concatenate((over, np.flatnonzero(approx == edge)[: keep - len(over)]))


def _search_block(quantiser: Quantiser, queries, k: int, keep: int):
    dims = quantiser.dims

    def run(batches):
        own, ids, q = queries.value
        norm_q = np.sqrt((q * q).sum(1))
        best_s = np.full((len(ids), 0), -np.inf)
        best_i = np.zeros((len(ids), 0), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                vec = part.column(0).to_numpy()
                order = np.argsort(vec, kind="stable")
                vec, row, x = vec[order], part.column(3).to_numpy()[order], _matrix(part.column(1), dims)[order]
                norm = np.sqrt((x * x).sum(1))
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(vec), -1)[order].T.copy()
                new_s, new_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
                for lo in range(0, len(ids), QUERY_SLICE):
                    tables = quantiser.tables(q[lo : lo + QUERY_SLICE] / norm_q[lo : lo + QUERY_SLICE, None])
                    approx = np.zeros((len(tables), len(vec)), np.float32)
                    for m in range(len(codes)):
                        approx += tables[:, m].take(codes[m], axis=1)
                    for j in range(len(tables)):
                        i = _top(approx[j], keep + 1)
                        i = np.sort(i[row[i] != own[lo + j]])
                        s = (x[i] * q[lo + j]).sum(1) / (norm[i] * norm_q[lo + j])
                        o = np.lexsort((vec[i], -s))[:k]
                        new_s[lo + j, : len(o)], new_i[lo + j, : len(o)] = s[o], vec[i][o]
                s, i = np.concatenate((best_s, new_s), 1), np.concatenate((best_i, new_i), 1)
                o = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)
        j, c = np.nonzero(best_s > -np.inf)
        if len(j):
            yield pa.RecordBatch.from_arrays([pa.array(own[j]), pa.array(ids[j]), pa.array(best_i[j, c]), pa.array(best_s[j, c])], names=["query_row", "query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, quantiser: Quantiser, queries: DataFrame, k: int = 5, keep: int = KEEP, block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest rows of index (as written) for each of queries, which are rows of it: query_id, rank, vec_id, score."""
    spark = index.sparkSession
    blocks = max(1, math.ceil(queries.count() / block))
    found = None
    for n in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == n).select("row", "vec_id", "embedding").toArrow()
        if not got.num_rows:
            continue
        values = (got.column(0).to_numpy(), got.column(1).to_numpy(), _matrix(got.column(2).combine_chunks(), quantiser.dims))
        part = saved(index.mapInArrow(_search_block(quantiser, spark.sparkContext.broadcast(values), k, keep), "query_row long, query_id long, vec_id long, score double"), f"nearest-{n}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, asked: Column, k: int = 5) -> DataFrame:
    """The k nearest other rows for each row of (vec_id, embedding) for which `asked` holds: query_id, rank, vec_id, score."""
    rows = saved(valid(table), "vectors")
    found = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in lengths(rows):
        own = rows.where(F.size("embedding") == d)
        quantiser = fitted(own)
        index = saved(indexed(own, quantiser), "vector-index")
        found = found.unionByName(search(index, quantiser, index.where(asked), k))
    return found


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
