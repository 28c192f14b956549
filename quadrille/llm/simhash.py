"""SimHash near-dedup through a self-join of a binary trie.

1. One scan turns every whole text into a fingerprint: bit b is 1 if it is set in over half of the XXH64 hashes of the text's shingles,
   repeats included. Documents of one fingerprint become one class; only distinct fingerprints go on.
2. The binary trie of the fingerprints, from the top bit down: a node with over LEAF of them is split by its next STEP bits until no
   leaf holds more, so its depth follows the data.
3. Node pairs are walked together from (root, root): children of both sides meet, the bits in which their prefixes differ are added up, and
   a pair beyond the budget of `bits` is dropped with all that lies below it. Pairs of leaves are what is left.
4. Each pair of leaves goes to one task, which walks the rest of the two subtries in the same way, many node pairs at a time and
   a bounded number at once (WALK), and emits a spanning forest of the pairs found, never the pairs.
5. Components of these links give each document the smallest doc_id it can reach.

No pair within the budget is lost: a pair of nodes is dropped only if all pairs below it differ in more bits.

Defined cases: a text that is null, empty or without words has fingerprint zero and is linked like any other; with fewer words than a
shingle has, all of them are one shingle; a null doc_id counts as the largest, and as null in the result; repeated rows and rows of one doc_id with
different texts are documents of their own, each in its fingerprint's class; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, may_hold, saved
from .graph import components
from .shingles import shingle_hashes

WORDS, SEED, BITS = 3, 42, 2
LEAF, STEP = 8192, 2
WALK = 1 << 18
HOT, SALT = 4096, 64
NO_ID = (1 << 63) - 1
_TOP = np.uint64(63)


def fingerprint(hashes: np.ndarray) -> int:
    """As an unsigned number; zero for no hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def _printed(words: int):
    def run(batches):
        for b in batches:
            prints = np.array([fingerprint(shingle_hashes(t.as_py(), words, SEED)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, print): one row per document; the fingerprint's 64 bits as a long."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("id"), text).mapInArrow(_printed(words), "id long, print long")


# The trie's node at depth d over the bits p is the number 1p in binary (d + 1 bits), so the root is 1; d is at most 60.
def _node(bits: Column, depth: int) -> Column:
    if depth == 0:
        return F.lit(1).cast("long")
    return F.call_function("shiftrightunsigned", bits, F.lit(64 - depth)) + F.lit(1 << depth)


def _depth(node: Column) -> Column:
    return F.length(F.bin(node)) - 1


def trie(prints: DataFrame, leaf: int = LEAF, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """prints: (print), distinct, on disk. Returns (leaves, children): (leaf, print) for every fingerprint, and (node, child) of the
    nodes that were split."""
    spark = prints.sparkSession
    rest, leaves = prints, None
    children = spark.createDataFrame([], "node long, child long")
    for depth in range(0, 61, step):
        at = rest.select("print", _node(F.col("print"), depth).alias("node"))
        sizes = saved(at.groupBy("node").agg(F.count(F.lit(1)).alias("n")), f"trie-{depth}")
        if depth:
            children = children.unionByName(sizes.select(F.shiftright("node", step).alias("node"), F.col("node").alias("child")))
        full = sizes.where((F.col("n") > leaf) & F.lit(depth + step <= 60)).select("node")
        done = at.join(full, "node", "left_anti").select(F.col("node").alias("leaf"), "print")
        leaves = done if leaves is None else leaves.unionByName(done)
        if not full.take(1):
            break
        rest = saved(at.join(full, "node", "left_semi").select("print"), f"trie-rest-{depth}")
    return leaves, children


def _differing(a: Column, b: Column) -> Column:
    """Bits in which the shorter prefix differs from the longer one's beginning."""
    da, db = _depth(a), _depth(b)
    d = F.least(da, db)
    cut = lambda x, depth: F.call_function("shiftright", x, (depth - d).cast("int"))
    return F.bit_count(cut(a, da).bitwiseXOR(cut(b, db)))


def leaf_pairs(children: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): pairs of leaves, a <= b, whose prefixes differ in at most `bits` bits; nodes descend together from the root."""
    spark = children.sparkSession
    root = F.lit(1).cast("long")
    pairs, out, depth = spark.range(1).select(root.alias("a"), root.alias("b")), None, 0
    down = lambda side: children.select(F.col("node").alias(side), F.col("child").alias(f"{side}_child"))
    while True:
        met = pairs.join(down("a"), "a", "left").join(down("b"), "b", "left")
        met = met.select("a", "b", F.col("a_child").isNull().alias("a_leaf"), F.col("b_child").isNull().alias("b_leaf"), F.coalesce("a_child", "a").alias("x"), F.coalesce("b_child", "b").alias("y"))
        met = saved(met, f"trie-pairs-{depth}")
        found = met.where("a_leaf and b_leaf").select("a", "b")
        out = found if out is None else out.unionByName(found)
        going = met.where("not (a_leaf and b_leaf)").where(_differing(F.col("x"), F.col("y")) <= bits)
        pairs = going.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if not going.take(1):
            return out
        depth += 1


def _halves(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where, in each range [lo, hi) of the sorted v, the bit at `depth` turns from 0 to 1."""
    one = np.uint64(1) << (_TOP - depth.astype(np.uint64))
    base = v[lo] & ~((one << np.uint64(1)) - np.uint64(1))
    return np.clip(np.searchsorted(v, base | one), lo, hi)


def walk(a: np.ndarray, b: np.ndarray, depth: int, bits: int, same: bool, limit: int = WALK):
    """Yields arrays (i, j) of the pairs a[i], b[j] that differ in at most `bits` bits; a and b are sorted, their entries agree among
    themselves in the first `depth` bits. same: a is b, and each pair comes once (i < j).

    A pair of nodes is a range of a and one of b with the bits they differ in so far; both halve at each level. Once both hold one
    entry the rest is compared at once. At most about `limit` pairs are taken from the stack at a time.
    """
    if not len(a) or not len(b):
        return
    above = np.uint64(0) if depth == 0 else ~((np.uint64(1) << np.uint64(64 - depth)) - np.uint64(1)) if depth < 64 else ~np.uint64(0)
    start = int(np.bitwise_count((a[0] ^ b[0]) & above))
    if start > bits:
        return
    stack = [tuple(np.array([x], np.int64) for x in (0, len(a), 0, len(b), depth, start))]
    while stack:
        lo, hi, low, high, d, diff = stack.pop()
        if len(lo) > limit:
            stack.append(tuple(x[limit:] for x in (lo, hi, low, high, d, diff)))
            lo, hi, low, high, d, diff = (x[:limit] for x in (lo, hi, low, high, d, diff))
        single = ((hi - lo == 1) & (high - low == 1)) | (d == 64)
        if single.any():
            i, j = lo[single], low[single]
            near = np.bitwise_count(a[i] ^ b[j]) <= bits
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            lo, hi, low, high, d, diff = (x[~single] for x in (lo, hi, low, high, d, diff))
        if not len(lo):
            continue
        mid, middle = _halves(a, lo, hi, d), _halves(b, low, high, d)
        grown = []
        for left, right in ((0, 0), (0, 1), (1, 0), (1, 1)):
            x0, x1 = (mid, hi) if left else (lo, mid)
            y0, y1 = (middle, high) if right else (low, middle)
            now = diff + (left != right)
            keep = (x1 > x0) & (y1 > y0) & (now <= bits)
            if same:
                keep &= x0 <= y0  # of two mirrored pairs of nodes the one in order
            grown.append(tuple(v[keep] for v in (x0, x1, y0, y1, d + 1, now)))
        grown = tuple(np.concatenate(v) for v in zip(*grown))
        if len(grown[0]):
            stack.append(grown)


def _joined(bits: int):
    """All fingerprints of one or two leaves: a spanning forest of the pairs found."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf["a"].iat[0], pdf["b"].iat[0]
        held = {s: np.sort(np.asarray(v, np.int64).view(np.uint64)) for s, v in zip(pdf["side"], pdf["prints"])}
        a, b = held[0], held[0 if first == second else 1]
        depth = min(int(first).bit_length(), int(second).bit_length()) - 1
        parent = np.arange(len(a) + (0 if first == second else len(b)))
        shift = 0 if first == second else len(a)

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        out = []
        for i, j in walk(a, b, depth, bits, first == second):
            while (parent[parent] != parent).any():
                parent = parent[parent]
            apart = parent[i] != parent[j + shift]  # of many close fingerprints, most pairs add nothing to a forest
            for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                p, q = root(x), root(y + shift)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((a[x], b[y]))
        links = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": links[:, 0], "v": links[:, 1]})

    return run


def links(prints: DataFrame, bits: int = BITS, leaf: int = LEAF, step: int = STEP) -> DataFrame:
    """(u, v): links between distinct fingerprints (print), enough of them to connect all that differ in at most `bits` bits."""
    leaves, children = trie(prints, leaf, step)
    pairs = leaf_pairs(children, bits)
    sides = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("leaf"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("leaf"), F.lit(0).alias("side")), F.struct(F.col("b").alias("leaf"), F.lit(1).alias("side")))))
    whole = leaves.groupBy("leaf").agg(F.collect_list("print").alias("prints"))  # one row a leaf, of `leaf` fingerprints at most
    members = pairs.select("a", "b", sides.alias("s")).select("a", "b", "s.leaf", "s.side").join(whole, "leaf")
    return members.select("a", "b", "side", "prints").groupBy("a", "b").applyInPandas(_joined(bits), "u long, v long")


def near_groups(docs: DataFrame, bits: int = BITS, words: int = WORDS, **how) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, class_size (documents of the fingerprint)."""
    printed = saved(fingerprints(docs, words).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "print"), "simhash-prints")
    classes = saved(printed.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    found = saved(components(links(classes.select("print"), bits, **how), "simhash"), "simhash-components")
    rooted = saved(classes.join(found, classes["print"] == found["node"], "left").select("print", "least", "n", F.coalesce("root", "print").alias("root")), "simhash-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    told = saved(rooted.join(named, "root").select("print", "n", "component"), "simhash-told")
    # documents of hot fingerprints are spread over SALT keys; the bitmap holds all of these, and maybe others, on both sides alike
    hot = may_hold(bitmap_of(classes.where(F.col("n") > HOT).select(F.xxhash64("print"))), F.xxhash64("print"))
    own = printed.withColumn("salt", F.when(hot, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALT))).otherwise(0).cast("int"))
    copies = told.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return own.join(copies, ["print", "salt"]).select(
        known("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), known("component").alias("component_id"), F.col("n").alias("class_size")
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
