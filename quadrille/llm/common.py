"""Shared pieces: scratch tables, global running sums, bounded bitmap filters."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where unset one of our own, if all executors are this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quadrille-"))
    return _own_dir[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quadrille/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read back: short lineage that outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing lazy reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside those of docs, whatever docs calls its columns."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_of(docs: DataFrame) -> Column:
    """The text, with null as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def running_sums(df: DataFrame, order: list[str], sums: list[str], name: str) -> DataFrame:
    """df with `<s>_before` for each s in sums: its exact sum over all rows that come earlier in `order`.

    One range shuffle sorts the rows; each partition sums its own, and the partitions' totals (one row each,
    so as many as there are tasks) give every partition its start. Rows that tie in `order` must be equal or
    the caller must not care which of them comes first. The order columns must hold no floating NaN.
    """
    cols = df.columns
    schema = T.StructType(list(df.schema.fields) + [T.StructField(f"{s}_before", T.LongType()) for s in sums] + [T.StructField("_part", T.IntegerType())])

    def scan(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at = [0] * len(sums)
        for b in batches:
            arrays = [b.column(i) for i in range(len(cols))]
            for k, s in enumerate(sums):
                v = b.column(b.schema.get_field_index(s)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(v)
                arrays.append(pa.array(at[k] + total - v, pa.int64()))
                at[k] += int(total[-1]) if len(v) else 0
            arrays.append(pa.array(np.full(b.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*cols, *(f"{s}_before" for s in sums), "_part"])

    ordered = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
    local = saved(ordered.mapInArrow(scan, schema), name)
    totals = local.groupBy("_part").agg(*[F.sum(F.coalesce(s, F.lit(0))).alias(f"{s}_t") for s in sums]).orderBy("_part").collect()
    starts, acc = [], [0] * len(sums)
    for r in totals:
        starts.append((r["_part"], *acc))
        acc = [a + int(r[f"{s}_t"] or 0) for a, s in zip(acc, sums)]
    # as an Arrow table: rows of Python would start a second Python daemon with workers on every executor, which stays
    own = [pa.array([r[0] for r in starts], pa.int32()), *(pa.array([r[k + 1] for r in starts], pa.int64()) for k in range(len(sums)))]
    starts_df = df.sparkSession.createDataFrame(pa.table(own, names=["_part", *(f"{s}_start" for s in sums)]))
    out = local.join(F.broadcast(starts_df), "_part")
    out = out.select(*cols, *[(F.col(f"{s}_before") + F.col(f"{s}_start")).alias(f"{s}_before") for s in sums])
    return out


BITMAP_BITS = (18, 26)  # least and most


def bitmap_of(hashes: DataFrame) -> bytes:
    """A bitmap with one bit set per value of the only (long) column, of 32 bits a value, so that it lets the same share of others through
    at every size; 8 MB at most, which at most 2**20 rows bring to the driver. Beyond 2 million values it lets more through."""
    hashes = hashes.toDF("h")
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], (32 * hashes.count()).bit_length()))
    h = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(h, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out.astype("<u8").tobytes()


def may_hold(bitmap: bytes, hash_col: Column) -> Column:
    """True wherever hash_col's bit is set: a cheap JVM-side filter before a shuffle; an exact join must follow."""
    bits = (len(bitmap) * 8).bit_length() - 1
    h = hash_col.bitwiseAND(F.lit((1 << bits) - 1))
    byte = F.conv(F.hex(F.substring(F.lit(bitmap), (F.shiftright(h, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, h.bitwiseAND(F.lit(7)).cast("int")) == 1
