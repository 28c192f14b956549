"""Hard negatives by one-dimensional distance keys.

Vectors of whole numbers are augmented by one coordinate, sqrt(M^2 - |x|^2) with M the largest length, so that all of them lie on one
sphere and the largest inner product with q is the smallest distance to (q, 0): d^2 = |q|^2 + M^2 - 2 <q, x>. PIVOTS points, fitted by
k-means on at most SAMPLE rows, part the space; the key of a row is (its nearest pivot, its distance to it). Rows are stored sorted by
key, in pages of at most PAGE rows of one pivot with their least and largest distance.

By the triangle inequality, rows within r of q have keys in [d(q, pivot) - r, d(q, pivot) + r]. A search scans the pages that these
intervals reach, over all pivots, then those that a larger r adds, and so on: each round scans an annulus more. It ends once r is no less
than the distance of the k-th best row found (or of the least score asked for): nothing outside can be better. No page is left out
for any other reason, so results are exact. Scores are integers; distances only choose pages, with a slack for rounding.

Anchors meet a page in blocks of ANCHORS, so a task holds a bounded number of them; a page is copied once per block. Only the pivots are
sent to all tasks.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; a shorter vector counts as filled up
with zeros; repeated rows each count, but a row isn't its own neighbour; ties go to the smaller vec_id; a positive of negative score has
no negatives (none can satisfy the bounds); no rows for an empty table; extra columns are ignored. Components beyond 2^63 / SCALE
stop at that value; a score beyond 64 bits is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

SCALE = 256
PIVOTS, SAMPLE, ROUNDS = 16, 4096, 5
PAGE, ANCHORS, SLICE = 2048, 8192, 512
SALT = 64
POSITIVES, NEGATIVES = 5, 10
LEAST_PERCENT, MOST_PERCENT = 30, 90
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_SLACK = 1e-7  # of the largest distance there can be, for rounding
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_numbers(table: DataFrame) -> DataFrame:
    """(vec_id, label, v array<long>) of the rows that take part; each component x is floor(SCALE * x)."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & finite)
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), F.transform(e, lambda x: F.floor(x * SCALE)).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """One row per vector, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(n), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where no sum can leave their whole numbers, else in integers of any size."""
    top = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
    if top(a) * top(b) * max(1, a.shape[1]) < 2**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and (exact.max() > _HIGH or exact.min() < _LOW):
        raise OverflowError("an inner product leaves 64 bits")
    return exact.astype(np.int64)


def _augmented(m: np.ndarray, longest2: float) -> np.ndarray:
    x = m.astype(np.float64)
    return np.concatenate((x, np.sqrt(np.maximum(longest2 - (x * x).sum(1, keepdims=True), 0))), 1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None] - pivots) ** 2).sum(2), 0))


def _fit(x: np.ndarray, pivots: int, seed: int = 7) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = x[r.permutation(len(x))[:pivots]]
    for _ in range(ROUNDS):
        near = _distances(x, centres).argmin(1)
        centres = np.stack([x[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return centres


class Index:
    """Pages of rows sorted by (pivot, distance), in a table of the shared folder."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, page: int = PAGE):
        """rows: (row, vec_id, label, v), row being unique; on disk."""
        length2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        total = rows.agg(F.count(F.lit(1)), F.max(length2), F.max(F.size("v"))).first()
        self.n, self.longest2, self.dims = total[0], total[1] or 0.0, total[2] or 0
        self.reach = 2 * math.sqrt(self.longest2) + 1  # no two points of the sphere's ball are farther apart
        if not self.n:
            return
        share = min(1.0, 2 * SAMPLE / self.n)
        drawn = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) <= share * (1 << 30)).orderBy(F.xxhash64("row")).limit(SAMPLE).select("v").toArrow()
        sample = _matrix(drawn.column(0), self.dims) if drawn.num_rows else np.zeros((1, self.dims), np.int64)
        self.pivots = _fit(_augmented(sample, self.longest2), pivots)
        keyed = rows.mapInArrow(self._keyed(), "row long, vec_id long, label long, v array<long>, pivot int, distance double")
        order = ["pivot", "distance", "row"]
        kind = "page long, pivot int, low double, high double, row array<long>, vec_id array<long>, label array<long>, v binary"
        self.pages = saved(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(self._paged(page), kind), "negatives-pages")

    def _keyed(self):
        dims, longest2, pivots = self.dims, self.longest2, self.pivots

        def run(batches):
            for b in batches:
                parts = [_distances(_augmented(_matrix(b.column(3).slice(at, 1024), dims), longest2), pivots) for at in range(0, b.num_rows, 1024)]
                d = np.concatenate(parts) if parts else np.zeros((0, len(pivots)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], names=[*b.schema.names, "pivot", "distance"])

        return run

    def _paged(self, page: int):
        dims = self.dims
        names = ["page", "pivot", "low", "high", "row", "vec_id", "label", "v"]

        def run(batches):
            from pyspark import TaskContext

            made, part = 0, TaskContext.get().partitionId()
            held = None

            def close(t):
                nonlocal made
                lists = [pa.array([c.to_numpy()]) for c in (t["row"], t["vec_id"], t["label"])]
                d, v = t["distance"].to_numpy(), _matrix(t["v"], dims)
                keys = [pa.array([(part << 32) | made]), pa.array([t["pivot"][0].as_py()], pa.int32()), pa.array([d[0]]), pa.array([d[-1]])]
                made += 1
                return pa.RecordBatch.from_arrays([*keys, *lists, pa.array([v.astype("<i8").tobytes()], pa.binary())], names=names)

            for b in batches:
                t = pa.Table.from_batches([b])
                held = pa.concat_tables([held, t]) if held is not None else t
                while held.num_rows:
                    pivot = held["pivot"].to_numpy()
                    run_length = int(np.searchsorted(pivot, pivot[0], "right"))
                    if run_length == held.num_rows and run_length < page:
                        break  # the page may go on in the next batch
                    k = min(page, run_length)
                    yield close(held.slice(0, k))
                    held = held.slice(k)
            if held is not None and held.num_rows:
                yield close(held)

        return run

    def anchors(self, rows: DataFrame) -> DataFrame:
        """rows (row, vec_id, label, v) with `length2` and their distance `to` every pivot, as points of the last coordinate 0."""
        dims, pivots = self.dims, self.pivots

        def run(batches):
            for b in batches:
                m = _matrix(b.column(3), dims).astype(np.float64)
                to = np.concatenate([_distances(np.pad(m[at : at + 1024], ((0, 0), (0, 1))), pivots) for at in range(0, len(m), 1024)]) if len(m) else np.zeros((0, len(pivots)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, to.size + 1, len(pivots), dtype=np.int32)), pa.array(to.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((m * m).sum(1)), lists], names=[*b.schema.names, "length2", "to"])

        return rows.mapInArrow(run, "row long, vec_id long, label long, v array<long>, length2 double, to array<double>")


def _scan(dims: int, same: bool, k: int):
    """One page and a block of anchors: per anchor and bound, the k best rows of the wanted label between least and most."""

    def run(key, asks: pa.Table, pages: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        if asks.num_rows and pages.num_rows:
            rows, ids, labels = (pages[c].combine_chunks().flatten().to_numpy() for c in ("row", "vec_id", "label"))
            v = np.frombuffer(pages["v"][0].as_py(), "<i8").reshape(len(rows), dims)
            own, own_label = asks["row"].to_numpy(), asks["label"].to_numpy()
            q = _matrix(asks["v"], dims)
            least, most = asks["least"].to_pylist(), asks["most"].to_pylist()
            for at in range(0, len(own), SLICE):
                s = products(q[at : at + SLICE], v)
                fits = ((own_label[at : at + SLICE, None] == labels) == same) & (own[at : at + SLICE, None] != rows)
                for need in range(max(len(m) for m in most[at : at + SLICE])):
                    bound = lambda m, none: np.array([x[need] if need < len(x) else none for x in m[at : at + SLICE]], np.int64)[:, None]  # noqa: B023, E731
                    i, j = np.nonzero(fits & (s >= bound(least, _HIGH)) & (s <= bound(most, _LOW)))
                    order = np.lexsort((rows[j], ids[j], -s[i, j], i))
                    i, j = i[order], j[order]
                    first = np.searchsorted(i, i, "left")
                    best = np.arange(len(i)) - first < k
                    i, j = i[best], j[best]
                    for o, x in zip(out, (own[at + i], np.full(len(i), need), ids[j], rows[j], s[i, j])):
                        o.append(x)
        columns = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["anchor", "need", "id", "row", "score"])

    return run


def best_rows(index: Index, asks: DataFrame, same: bool, k: int, name: str) -> DataFrame:
    """asks: as of index.anchors(), with `least` and `most`: arrays of the bounds of the scores asked for, one or more a row.

    Returns (anchor, need, id, row, score, rank): per anchor and bound (need counts from 0) the k best rows of the same label, or of
    another, scores descending, ties to the smaller id. Rounds go on, with wider annuli, for anchors that aren't certain yet.
    """
    spark, pivots = asks.sparkSession, len(index.pivots)
    blocks = max(1, math.ceil(asks.count() / ANCHORS))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    directory = index.pages.select("page", "pivot", "low", "high", salts)
    order = Window.partitionBy("anchor", "need").orderBy(F.desc("score"), "id", "row")
    away = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("length2") + index.longest2 - 2.0 * score))
    open_asks = saved(asks.where(F.size("most") > 0).select("*", F.lit(-1.0).alias("done"), F.lit(0.0).alias("r")), f"{name}-asks")
    found, turn = None, 0
    while open_asks.count():
        salted = open_asks.select("row", "done", "r", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int").alias("salt"), F.posexplode("to").alias("pivot", "d"))
        gap = F.greatest(F.lit(0.0), F.col("low") - F.col("d"), F.col("d") - F.col("high"))
        hits = salted.join(directory, ["pivot", "salt"]).where((gap <= F.col("r")) & (gap > F.col("done"))).select("row", "page", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).alias("block"))
        carried = hits.join(open_asks.select("row", "label", "v", "least", "most"), "row")
        copied = index.pages.select(F.col("page").alias("own_page"), "row", "vec_id", "label", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("own_block"))
        met = carried.groupBy("page", "block").cogroup(copied.groupBy("own_page", "own_block")).applyInArrow(_scan(index.dims, same, k), "anchor long, need long, id long, row long, score long")
        all_found = met if found is None else met.unionByName(found.drop("rank"))
        found = saved(all_found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"{name}-found-{turn}")
        # the score that any row not scanned yet would have to reach, and how far away such a row may be
        worst = found.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("need", "score"))).alias("kth"))
        told = open_asks.join(worst, open_asks["row"] == worst["anchor"], "left").drop("anchor")
        least = F.transform("least", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i.cast("long")), x)))
        told = told.select(*[c for c in open_asks.columns if c not in ("least", "done", "r")], least.alias("least"), F.col("r").alias("done"), "kth")
        needed = (F.least(F.lit(index.reach), away(F.array_min("least").cast("double"))) + _SLACK * index.reach).alias("needed")
        wider = F.greatest(2 * F.col("done"), F.lit(index.reach / 4))
        # with k rows for every bound the next annulus is the last; else it grows
        certain = F.size(F.coalesce("kth", F.create_map())) == F.size("most")
        told = told.select("*", needed).where(F.col("done") < F.col("needed"))
        told = told.select("*", F.when(certain, F.col("needed")).otherwise(F.least("needed", wider)).alias("r")).drop("kth", "needed")
        turn += 1
        open_asks = saved(told.select(*open_asks.columns), f"{name}-asks-{turn}")
    if found is None:
        return spark.createDataFrame([], "anchor long, need long, id long, row long, score long, rank int")
    return found


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT, most: int = MOST_PERCENT, **how) -> DataFrame:
    """rows: (vec_id, label, v). Per row whose id is divisible by `every`, and each of its best `positives` rows of its label: the best
    `negatives` of other labels whose score lies between `least` and `most` percent of the positive's."""
    rows = saved(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"), "v"), "negatives-rows")
    index = Index(rows, **how)
    if not index.n:
        return rows.sparkSession.createDataFrame([], _OUT)
    anchors = saved(index.anchors(rows.where(F.col("vec_id") % every == 0)), "negatives-anchors")
    bound = lambda v: F.array(F.lit(v).cast("long"))
    liked = best_rows(index, anchors.select("*", bound(_LOW).alias("least"), bound(_HIGH).alias("most")), True, positives, "negatives-like")
    liked = liked.where("score >= 0").select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).cast("long").alias("need"))
    # positives of negative score stand last, so the others' places stay
    score = lambda p: p["positive_score"].cast("decimal(20,0)")
    per = liked.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("need", "positive_score"))).alias("p"))  # at most `positives`
    low, high = F.transform("p", lambda p: F.ceil(score(p) * least / 100).cast("long")), F.transform("p", lambda p: F.floor(score(p) * most / 100).cast("long"))
    asks = anchors.join(per.select(F.col("anchor").alias("row"), low.alias("least"), high.alias("most")), "row")
    unlike = best_rows(index, asks, False, negatives, "negatives-unlike").select("anchor", "need", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = unlike.join(liked, ["anchor", "need"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


OP12_SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.r <> b.r),
liked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS k FROM scored WHERE same QUALIFY k <= {POSITIVES}),
unlike AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b) AS rank
  FROM liked p JOIN scored n ON n.a = p.a AND NOT n.same AND {LEAST_PERCENT} * p.score <= 100 * n.score AND 100 * n.score <= {MOST_PERCENT} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM unlike WHERE rank <= {NEGATIVES}"""
