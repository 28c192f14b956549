"""Sharding by extendible hashing.

Rows are keyed by a 60-bit hash of their key; a bucket is a hash prefix. Starting from one bucket of depth 0, only buckets
over the byte limit split on their next bit, until every bucket fits. STEP bits are settled per round: one aggregation gives the
bytes of every prefix STEP bits deeper under the buckets that are still too large (the directory rows of the round), so a
round costs one small shuffle, and 12 bits a round need two rounds for sixteen million shards.

Rows whose hashes agree in all 60 bits can't be split by hashing: such a bucket gets overflow pages. Its rows are dealt by size class,
c for sizes over 2^(c-1) and up to 2^c, floor(limit / 2^c) rows of a class to a page, so no page is over the limit; a row of over half the
limit is a page of its own, and only a single row larger than the limit makes a page larger than that. Page numbers are
class * 2^40 + the page within the class.

Defined cases: null text has 0 bytes; a null key is hashed by its text; repeated rows share a bucket and count each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, running_sums, saved, text_of

BITS, STEP = 60, 12
SHARD_BYTES = 8 << 20


def key_hash(key: Column, text: Column) -> Column:
    """60 bits of md5 of the key as text; of the text with a mark before it where the key is null."""
    hexed = F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("text:"), text)))
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def _prefix(depth: int | Column) -> Column:
    if isinstance(depth, int):
        return F.shiftright("h", BITS - depth)
    return F.call_function("shiftright", F.col("h"), F.lit(BITS) - depth)


def assign(sized: DataFrame, limit: int = SHARD_BYTES, step: int = STEP) -> DataFrame:
    """sized: (doc_id, h, bytes), on disk. Adds depth, prefix, page and shard_bytes."""
    open_rows, done, at = sized, [], 0
    while True:
        deep = min(at + step, BITS)
        fine = open_rows.groupBy(_prefix(deep).alias("fine")).agg(F.sum("bytes").alias("fine_bytes"))
        # every depth from `at` to `deep` at once: each fine prefix stands under one bucket per depth
        spread = fine.select("fine", "fine_bytes", F.explode(F.sequence(F.lit(at), F.lit(deep))).alias("depth"))
        spread = spread.withColumn("prefix", F.call_function("shiftright", F.col("fine"), F.lit(deep) - F.col("depth")))
        spread = saved(spread, f"shard-spread-{at}")
        buckets = spread.groupBy("depth", "prefix").agg(F.sum("fine_bytes").alias("bucket_bytes"))
        fits = spread.join(buckets.where(F.col("bucket_bytes") <= limit), ["depth", "prefix"])
        leaf = fits.groupBy("fine").agg(F.min(F.struct("depth", "prefix", "bucket_bytes")).alias("leaf"))
        leaf = saved(leaf.select("fine", "leaf.*"), f"shard-directory-{at}")
        hit = open_rows.withColumn("fine", _prefix(deep)).join(leaf, "fine", "left")
        settled = hit.where("depth is not null")
        done.append(settled.select("doc_id", "h", "bytes", "depth", "prefix", F.lit(0).cast("long").alias("page"), F.col("bucket_bytes").alias("shard_bytes")))
        rest = fine.join(leaf, "fine", "left_anti")
        if rest.limit(1).count() == 0:
            break
        open_rows = saved(hit.where("depth is null").select(*sized.columns), f"shard-open-{deep}")
        at = deep
        if at == BITS:
            done.append(_pages(open_rows, limit))
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of buckets whose hashes are all equal."""
    size = F.when(F.col("bytes") > 1, F.char_length(F.bin(F.col("bytes") - 1))).otherwise(0).cast("long")
    classed = rows.withColumn("one", F.lit(1).cast("long")).withColumn("size", size)
    counted = running_sums(classed, ["h", "size", "bytes", "doc_id"], ["one"], "shard-overflow")
    starts = counted.groupBy("h", "size").agg(F.min("one_before").alias("start"))
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.pow(F.lit(2.0), F.col("size"))))
    page = F.col("size") * (1 << 40) + F.floor((F.col("one_before") - F.col("start")) / per)
    paged = saved(counted.join(starts, ["h", "size"]).withColumn("page", page).drop("one", "size", "one_before", "start"), "shard-paged")
    sums = paged.groupBy("h", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return paged.join(sums, ["h", "page"]).select("doc_id", "h", "bytes", F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), "page", "shard_bytes")


def _placed(docs: DataFrame, limit: int, step: int = STEP) -> DataFrame:
    text = text_of(docs)
    sized = saved(docs.select("doc_id", key_hash(docs["doc_id"], text).alias("h"), F.octet_length(text).cast("long").alias("bytes")), "shard-keys")
    return assign(sized, limit, step)


def shard(docs: DataFrame, limit: int = SHARD_BYTES, step: int = STEP) -> DataFrame:
    """One row per document: doc_id, bytes, depth, prefix, page, shard_bytes; (depth, prefix, page) names the shard."""
    return _placed(docs, limit, step).drop("h")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Writes docs, with all of their columns, as Parquet folders shard=<depth>-<prefix>-<page>, each row in its shard; returns the assignment.

    The rows of a bucket are found again by their hash; in a bucket of several pages by (hash, bytes) and their number among the rows that
    agree in both, any of which may take any of these places.
    """
    placed = saved(_placed(docs, limit), "shard-placed")
    h, n, k, shard_name = fresh(docs, "_h", "_bytes", "_k", "shard")
    text = text_of(docs)
    own = docs.select("*", key_hash(docs["doc_id"], text).alias(h), F.octet_length(text).cast("long").alias(n))
    name = F.concat_ws("-", "depth", "prefix", "page").alias(shard_name)
    whole = placed.where(F.col("depth") < BITS).select(F.col("h").alias(h), name).distinct()
    split = placed.where(F.col("depth") == BITS)
    among = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0))).alias(k)
    places = split.select(F.col("h").alias(h), F.col("bytes").alias(n), name, among("h", "bytes"))
    paged = own.join(split.select(F.col("h").alias(h)).distinct(), h, "left_semi").select("*", among(h, n)).join(places, [h, n, k])
    tagged = own.join(whole, h).select(*docs.columns, shard_name).unionByName(paged.select(*docs.columns, shard_name))
    tagged.repartition(shard_name).write.partitionBy(shard_name).parquet(path)
    return placed.drop("h")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = f"""
WITH k AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
d AS (SELECT k.*, CAST(r.depth AS INTEGER) AS depth, h >> ({BITS} - r.depth)::INT AS prefix FROM k, range(0, 33) r(depth)),
b AS (SELECT depth, prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes FROM d GROUP BY ALL HAVING sum(bytes) <= {SHARD_BYTES})
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, depth, prefix, CAST(0 AS BIGINT) AS page, shard_bytes
FROM d JOIN b USING (depth, prefix)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""
