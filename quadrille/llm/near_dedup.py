"""MinHash near-dedup through an LSH forest.

1. One scan turns every whole text into its set of word shingles and a signature of TREES * DEPTH min-hashes.
   Documents with equal sets become one class, represented by its smallest doc_id.
2. Forest: each tree sorts the classes by its own DEPTH min-hashes. A region is a run of classes whose common prefix reaches the
   region's depth: MIN_DEPTH, and one more, up to MAX_DEPTH, wherever a region would hold over REGION classes. One that does so still
   is cut into blocks, and each two blocks are searched together.
3. In a region every class meets its neighbours by longest common prefix first, the NEXT that follow in the tree's order, and then all
   others that it isn't joined with. Those whose signatures agree in LOOSE of their positions and whose sizes allow the similarity are
   candidates; each region emits only a forest of them. Their components are the units of verification.
4. Verification: a unit's links are all found on full sets, with an inverted index, and a spanning forest of them is emitted. A unit of over
   REGION classes is cut into blocks of which each two are verified together: every two of its classes meet, whatever its size.
5. Components of the links give each document the smallest doc_id it can reach.

Chance of missing one link at the threshold of 0.85: no shared region in any tree, (1 - 0.85**4)**24 = 2e-8, and where all regions of
a class are so crowded that they reach MAX_DEPTH (1 - 0.85**6)**24 = 1.2e-5, at most; signature estimate of 192 positions below LOOSE,
under 1e-6. At 0.80 the first two are 3e-6 and 6.8e-4.

Defined cases: null and empty texts, and texts without words, have the empty set, link with nothing and are kept;
a null doc_id counts as the largest; repeated rows are one document each, in one class; rows of one doc_id with different texts
are one node, linked by any of its texts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, forget, fresh, may_hold, saved
from .graph import components
from .shingles import SHINGLE_WORDS, shingle_set

TREES, DEPTH, MIN_DEPTH, MAX_DEPTH = 24, 8, 4, 6
REGION = 2048
PERCENT = 85
LOOSE = 0.70
NEXT = 8
NO_ID = (1 << 63) - 1

_rng = np.random.RandomState(20240229)
_XOR = _rng.randint(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_ODD = _rng.randint(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """TREES * DEPTH 16-bit residues of the min-hashes of a set (not empty)."""
    h = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    low = np.full(len(_XOR), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):
        x = (h[at : at + 1024, None] ^ _XOR) * _ODD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        np.minimum(low, x.min(0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _signed(words: int):
    def run(batches):
        for b in batches:
            n, sets, sigs = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                n.append(len(s))
                sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n", "digest", "sig"])

    return run


def _tiles(rows: DataFrame, region: int) -> DataFrame:
    """(unit, id, ...): rows (key, size, id, ...) of groups of over `region` ids, cut into blocks of about half of that; each two blocks
    of a group are one unit, so any two ids of a group meet."""
    blocks = F.ceil(2 * F.col("size") / region)
    others = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_j")
    pairs = rows.select("*", F.pmod(F.xxhash64("id"), blocks).alias("_i"), others).where("_i <> _j")
    return pairs.withColumn("unit", F.xxhash64("key", F.least("_i", "_j"), F.greatest("_i", "_j"))).drop("key", "size", "_i", "_j")


def _order(sig: Column, tree: Column, depth: int = DEPTH) -> Column:
    """The first `depth` min-hashes of a tree: what the tree sorts by."""
    return F.call_function("substring", sig, tree * (2 * DEPTH) + 1, F.lit(2 * depth))


def _regions(classes: DataFrame, region: int) -> DataFrame:
    """(unit, tree, id): every class in the regions of the forest that hold two classes or more."""
    at = classes.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    found, scratch = None, []
    for depth in range(MIN_DEPTH, MAX_DEPTH + 1):
        rows = saved(at.select(F.xxhash64("tree", _order(F.col("sig"), F.col("tree"), depth)).alias("key"), "tree", "id"), "forest")
        sizes = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "forest-sizes")
        scratch += [rows, sizes]
        fit = rows.join(sizes.where(F.col("size") <= region).select("key"), "key").select(F.col("key").alias("unit"), "tree", "id")
        found = fit if found is None else found.unionByName(fit)
        crowded = sizes.where(F.col("size") > region)
        if crowded.isEmpty():
            break
        large = rows.join(crowded, "key")
        if depth == MAX_DEPTH:
            found = found.unionByName(_tiles(large, region))
        at = large.select("tree", "id").join(classes.select("id", "sig"), "id")
    out = saved(found, "near-regions")
    forget(*scratch)
    return out


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _flat(parent: np.ndarray) -> np.ndarray:
    """The root of every place."""
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _forest_of(unit: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int, loose: float) -> list[tuple[int, int]]:
    """Places of the pairs that join each unit's candidates; rows are sorted by unit and the tree's order."""
    parent, out = np.arange(len(unit)), []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[fits], b[fits]
        for at in range(0, len(a), 4096):
            x, y = a[at : at + 4096], b[at : at + 4096]
            like = (sig[x] == sig[y]).mean(1) >= loose
            for i, j in zip(x[like].tolist(), y[like].tolist()):
                i_root, j_root = _find(parent, i), _find(parent, j)
                if i_root != j_root:
                    parent[max(i_root, j_root)] = min(i_root, j_root)
                    out.append((i, j))

    for step in range(1, NEXT + 1):  # neighbours in the order; a pair that is joined already adds nothing to a forest
        root = _flat(parent)
        a = np.flatnonzero(unit[:-step] == unit[step:])
        if not len(a):
            return out
        a = a[root[a] != root[a + step]]
        join(a, a + step)
    root = _flat(parent)
    begin = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(unit)]):
        if hi - lo <= NEXT + 1 or (root[lo:hi] == root[lo]).all():
            continue
        for i in range(lo + NEXT + 1, hi):
            own = _flat(parent[lo:hi] - lo)
            far = np.flatnonzero(own[: i - NEXT - lo] != own[i - lo]) + lo
            join(far, np.full(len(far), i))
    return out


def _candidates(percent: int, loose: float):
    """Over rows sorted by unit and order: for each unit a forest over its candidate pairs (estimated similarity and sizes)."""

    def edges(rows: pa.Table) -> pa.RecordBatch:
        unit, ids, n = (rows.column(c).to_numpy() for c in ("unit", "id", "n"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        at = np.array(_forest_of(unit, n, sig, percent, loose), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["u", "v"])

    def run(batches):
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not rows.num_rows:
                continue
            unit = rows.column("unit").to_numpy()
            whole = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
            if whole:
                yield edges(rows.slice(0, whole))
            held = rows.slice(whole)
        if held is not None and held.num_rows:
            yield edges(held)

    return run


def links_of(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, all of them checked on full sets through an inverted index."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, shingle, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[shingle] > 1
    shingle, owner = shingle[shared], owner[shared]
    order = np.argsort(shingle, kind="stable")
    postings, counts = owner[order], np.bincount(shingle, minlength=len(df))
    begin = np.concatenate(([0], np.cumsum(counts)))
    doc_at = np.searchsorted(owner, np.arange(len(sets) + 1))
    parent, out = np.arange(len(sets)), []
    for i in range(len(sets)):
        own = shingle[doc_at[i] : doc_at[i + 1]]
        if not len(own):
            continue
        b, c = begin[own], counts[own]
        shift = np.repeat(b - np.concatenate(([0], np.cumsum(c)[:-1])), c)
        common = np.bincount(postings[np.arange(c.sum()) + shift], minlength=len(sets))[:i]
        for j in np.flatnonzero(100 * common >= percent * (size[:i] + size[i] - common)):
            if common[j]:
                a, r = _find(parent, i), _find(parent, j)
                if a != r:
                    parent[max(a, r)] = min(a, r)
                    out.append((i, j))
    return out


def _verify(percent: int, words: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        return pd.DataFrame([(ids[i], ids[j]) for i, j in links_of(sets, percent)], columns=["u", "v"], dtype="int64")

    return run


def _full_sets(words: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def near_groups(docs: DataFrame, percent: int = PERCENT, words: int = SHINGLE_WORDS, region: int = REGION, loose: float = LOOSE) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, kept."""
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    source = docs.select(key.alias("id"), F.col("text"))
    signed = saved(source.mapInArrow(_signed(words), "id long, n long, digest binary, sig binary"), "near-signed")
    classes = signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("sig").alias("sig"))
    classes = saved(classes, "near-classes")
    regions = _regions(classes, region)
    inside = regions.join(classes, "id").select("unit", "id", "n", "sig", _order(F.col("sig"), F.col("tree")).alias("order"))
    inside = inside.repartition("unit").sortWithinPartitions("unit", "order", "id").select("unit", "id", "n", "sig")
    loose_edges = inside.mapInArrow(_candidates(percent, loose), "u long, v long")
    units = saved(components(loose_edges, "near-loose"), "near-units")  # long lived: the scans below read it
    sizes = units.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = units.join(sizes, "root").select(F.col("root").alias("key"), "size", F.col("node").alias("id"))
    whole = members.where(F.col("size") <= region).select(F.col("key").alias("unit"), "id")
    members = whole.unionByName(_tiles(members.where(F.col("size") > region), region))
    # texts of the candidates only: a bounded bitmap thins the scan, the join is exact
    near = bitmap_of(units.select(F.xxhash64("node")))
    texts = source.where(may_hold(near, F.xxhash64("id"))).join(units.select(F.col("node").alias("id")), "id")
    sets = saved(texts.mapInArrow(_full_sets(words), "id long, shingles binary"), "near-sets")
    links = members.join(sets, "id").groupBy("unit").applyInPandas(_verify(percent, words), "u long, v long")
    found = saved(components(links, "near-links"), "near-components")
    roots = classes.select("digest", "id").join(found, classes["id"] == found["node"], "left").select("digest", F.col("id").alias("class_id"), F.coalesce("root", "id").alias("component"))
    roots = saved(roots, "near-roots")
    out = signed.select("id", "n", "digest").join(roots, "digest", "left")
    null_id = lambda c: F.when(c != NO_ID, c)
    component = F.coalesce(F.col("component"), F.col("id"))
    forget(regions)
    return out.select(null_id(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), null_id(F.coalesce("class_id", "id")).alias("class_id"), null_id(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id; all of docs' columns."""
    (own,) = fresh(docs, "_id")
    drop = near_groups(docs, **how).where(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(drop, docs["doc_id"].eqNullSafe(drop[own]), "left_anti")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
