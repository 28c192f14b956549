"""Exact deduplication through a log-structured merge index.

Texts are equal when identical after every run of white space became one space. A document enters by the SHA-256 of that text:
* memtable: each task fills a table digest -> document ids, bounded by MEMTABLE_ROWS, and flushes it as a run sorted by
  digest. A group of copies is one entry per run, so a hot digest brings as many rows to a shuffle as there are runs, not copies.
* compaction: per digest shard, FAN_IN runs at a time are merged into one with a filter of its own, tier by tier, keeping the
  smallest id and the sum of the copies. Entries that no other run's filter holds move without a merge.
* lookup: runs find their entries' group in the last tier, and their documents' ids are listed again.
* byte verification: of the groups of two and more, the texts themselves are compared with that of the document that stays.
  Only these texts are shuffled (a bounded bitmap of hit digests filters the scan); large groups are salted.
Documents whose bytes differ in spite of equal digests are grouped anew by their text.

Defined cases: null text counts as empty; a null doc_id comes after all others; of repeated rows exactly one is kept; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bitmap_of, forget, may_hold, saved, text_of

MEMTABLE_ROWS = 1 << 16
FAN_IN = 32
SHARD_ENTRIES = 1 << 14
FILTER_BITS_PER_ENTRY, FILTER_PROBES = 10, 4
SALT_ROWS = 64
NO_ID = (1 << 63) - 1  # stands for a null doc_id inside the index: after all others

_RUNS = "run long, shard int, digest binary, min_id long, n long, ids array<long>"
_TIER = "run long, shard int, digest binary, min_id long, n long, src long, bloom binary"
_ENTRY = ["digest", "min_id", "n", "src"]


def normal_text(docs: DataFrame):
    return F.regexp_replace(text_of(docs), SPACE, " ")


def _probes(digests: list[bytes], m: int) -> np.ndarray:
    """FILTER_PROBES positions below m per digest, by double hashing of its own bytes."""
    raw = np.frombuffer(b"".join((d * 16)[:16] for d in digests), "<u8").reshape(-1, 2)
    a, b = raw[:, 0] >> np.uint64(1), (raw[:, 1] >> np.uint64(1)) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(m) for k in range(FILTER_PROBES)], 1).astype(np.int64)


def bloom(digests: list[bytes]) -> bytes:
    m = max(64, -(-FILTER_BITS_PER_ENTRY * len(digests) // 8) * 8)
    bits = np.zeros(m, np.uint8)
    if digests:
        bits[_probes(digests, m).ravel()] = 1
    return np.packbits(bits).tobytes()


def bloom_holds(filter_: bytes, digests: list[bytes]) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8))
    return bits[_probes(digests, len(bits))].all(1)


def _shard_of(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:4].ljust(4, b"\0"), "big") >> (32 - bits) if bits else 0


def _flush_runs(memtable_rows: int, shard_bits: int):
    def run(batches):
        from pyspark import TaskContext

        part, seq, table, rows = TaskContext.get().partitionId(), 0, {}, 0

        def flush():
            keys = sorted(table)
            ids = [sorted(table[k]) for k in keys]
            out = [pa.array([(part << 24) + seq] * len(keys), pa.int64()), pa.array([_shard_of(k, shard_bits) for k in keys], pa.int32()), pa.array(keys, pa.binary()), pa.array([i[0] for i in ids], pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(out, names=["run", "shard", "digest", "min_id", "n", "ids"])

        for b in batches:
            for i, d in zip(b.column(0).fill_null(NO_ID).to_pylist(), b.column(1).to_pylist()):
                table.setdefault(d, []).append(i)
                rows += 1
                if rows >= memtable_rows:
                    yield flush()
                    table, rows, seq = {}, 0, seq + 1
        if table:
            yield flush()

    return run


def _merge(key, pdf):
    """Merges the runs of one (shard, run group) into one run."""
    group, shard = key[1], key[0]
    runs = [g for _, g in pdf.groupby("run", sort=True)]
    if len(runs) == 1:
        best = pdf.sort_values("digest")[_ENTRY]
    else:
        moved, met = [], []
        filters = [(r["bloom"].dropna().iloc[0] if r["bloom"].notna().any() else bloom(list(r["digest"]))) for r in runs]
        for k, r in enumerate(runs):
            digests, maybe = list(r["digest"]), np.zeros(len(r), bool)
            for j, f in enumerate(filters):
                if j != k:
                    maybe |= bloom_holds(f, digests)
            moved.append(r[~maybe])
            met.append(r[maybe])
        met = pd.concat(met).sort_values(["digest", "min_id", "src"]).groupby("digest", sort=False, as_index=False).agg(min_id=("min_id", "first"), n=("n", "sum"), src=("src", "first"))
        best = pd.concat([*(m[_ENTRY] for m in moved), met[_ENTRY]]).sort_values("digest")
    best = best.reset_index(drop=True)
    best.insert(0, "run", group)
    best.insert(1, "shard", shard)
    best["bloom"] = None
    if len(best):
        best.loc[0, "bloom"] = bloom(list(best["digest"]))  # one filter per run and shard
    return best


def build_index(ids_digests: DataFrame, memtable_rows: int = MEMTABLE_ROWS, fan_in: int = FAN_IN, shard_entries: int = SHARD_ENTRIES, rows: int | None = None):
    """ids_digests: (doc_id, digest). Returns the flushed runs and the compacted index (digest, min_id, n)."""
    n = ids_digests.count() if rows is None else rows
    bits = min(24, max(0, math.ceil(math.log2(max(1, n) / shard_entries))))
    runs = saved(ids_digests.mapInArrow(_flush_runs(memtable_rows, bits), _RUNS), "dedup-runs")
    tier = runs.select("run", "shard", "digest", "min_id", "n", F.col("run").alias("src"), F.lit(None).cast("binary").alias("bloom"))
    # runs are numbered by task; a group of the first tier is fan_in tasks wide, of the next fan_in such groups
    tasks = int(runs.agg(F.max(F.shiftright("run", 24))).first()[0] or 0) + 1
    steps = max(1, math.ceil(math.log(tasks) / math.log(fan_in) - 1e-9))
    for level in range(steps):
        at = F.shiftright("run", 24) if level == 0 else F.col("run")
        new = saved(tier.groupBy("shard", F.floor(at / fan_in).alias("grp")).applyInPandas(_merge, _TIER), f"dedup-tier-{level}")
        if level:
            forget(tier)
        tier = new
    return runs, tier


def group_documents(docs: DataFrame, verify: bool = True, digest_bytes: int = 32, **how) -> DataFrame:
    """One row per document: doc_id, text_sha256, keep_id, group_size, kept."""
    norm = normal_text(docs)
    sha = F.sha2(norm, 256)
    keyed = docs.select("doc_id", F.substring(F.unhex(sha), 1, digest_bytes).alias("digest"))
    n = docs.count()
    runs, index = build_index(keyed, rows=n, **how)
    found = runs.join(index.select("digest", F.col("min_id").alias("keep"), F.col("n").alias("group_size"), "src"), "digest")
    rows = found.select("digest", "keep", "group_size", "run", "src", F.posexplode("ids").alias("pos", "id"))
    # of the rows that carry the smallest id exactly one is kept: the first one of the first run that has it
    rows = rows.withColumn("kept", (F.col("id") == F.col("keep")) & (F.col("run") == F.col("src")) & (F.col("pos") == 0))
    rows = rows.select(_null_id("id").alias("doc_id"), "digest", _null_id("keep").alias("keep_id"), "group_size", "kept")
    rows = saved(rows, "dedup-rows")
    if verify:
        rows = _verified(docs, rows, digest_bytes)
    return rows.select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size", "kept")


def _null_id(c: str):
    return F.when(F.col(c) != NO_ID, F.col(c))


def _verified(docs: DataFrame, rows: DataFrame, digest_bytes: int) -> DataFrame:
    hits = rows.where("group_size > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"), "keep_id", "group_size").distinct()
    near = bitmap_of(hits.select(F.xxhash64("_d")))
    norm = normal_text(docs)
    texts = docs.select("doc_id", norm.alias("norm"), F.unhex(F.sha2(norm, 256)).alias("sha")).withColumn("digest", F.substring("sha", 1, digest_bytes))
    texts = texts.where(may_hold(near, F.xxhash64("digest")))
    texts = texts.join(hits, texts["doc_id"].eqNullSafe(hits["_id"]) & (texts["digest"] == hits["_d"]))
    salts = F.ceil(F.col("group_size") / SALT_ROWS)
    texts = saved(texts.select("doc_id", "digest", "sha", "norm", "keep_id", "group_size"), "dedup-hits")
    stays = texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "group_size").agg(F.min("norm").alias("kept_norm"))
    stays = stays.select("digest", "kept_norm", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    copies = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "sha"), salts))
    differ = copies.join(stays, ["digest", "salt"]).where(F.col("norm") != F.col("kept_norm")).select("doc_id", "digest", "sha", "norm")
    differ = saved(differ, "dedup-differ")
    if digest_bytes == 32 and differ.limit(1).count() == 0:
        return rows
    # equal digests, unequal bytes (or shortened digests): all documents of such digests are grouped by their bytes
    weak = differ.select("digest").distinct()
    again = texts.join(weak, "digest", "left_semi") if digest_bytes == 32 else docs.select("doc_id", norm.alias("norm"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    groups = again.groupBy("norm").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    anew = again.select("doc_id", "sha", "norm").join(groups, "norm")
    tied = F.row_number().over(_window(["norm"], ["doc_id"]))
    anew = anew.select("doc_id", F.col("sha").alias("digest"), _null_id("keep").alias("keep_id"), "group_size", (tied == 1).alias("kept"))
    return anew if digest_bytes < 32 else rows.join(weak, "digest", "left_anti").unionByName(anew)


def _window(by, order):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the copies: of equal texts the row with the smallest doc_id, with all of docs' columns, whatever their names."""
    key = lambda c: F.coalesce(c, F.lit(NO_ID)).alias("key")
    kept = group_documents(docs).where("kept").select(key(F.col("doc_id")), F.col("text_sha256").alias("sha")).distinct()
    rows = docs.select(key(docs["doc_id"]), F.sha2(normal_text(docs), 256).alias("sha"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.join(kept, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"]).select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST)
"""
