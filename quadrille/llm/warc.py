"""WARC records and a Merkle fixity audit of their replicas.

A page becomes one WARC/1.0 response record; records stand in page_id order, and a record's offset is the sum of the lengths before it.
Leaf of the tree: SHA-256 over the record's ordered offset range and its bytes. Inner node: SHA-256 over the range it covers and
its children's hashes in order, FAN_OUT to a node, so a level groups bounded lists. Audit: the roots of two replicas are compared; where they differ the
audit descends, level by level, only into the children of nodes that differ, until it arrives at the records.
Everything is DataFrame expressions; what reaches the driver is one root per replica and level sizes.

Defined cases: null url and html count as empty; a null page_id stands last, with the record id `null`; repeated pages are records of
their own, ordered by url and html; an empty table has no tree and no rows; a record missing from, or added to, a replica shows as
a mismatch of its position; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_sums, saved

FAN_OUT = 16
DATE = "2024-01-01T00:00:00Z"
DAMAGE_EVERY = 97


def record_of(page_id: Column, url: Column, html: Column) -> Column:
    """The WARC record of a page, as text whose UTF-8 bytes are the record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def parse_record(record: Column) -> dict[str, Column]:
    """url and html of a record."""
    url = F.regexp_extract(record, r"WARC-Target-URI: ([^\r]*)\r\n", 1)
    start = F.instr(record, "\r\n\r\n") + 4
    return {"url": url, "html": F.call_function("substring", record, start, F.char_length(record) - start - 3)}


def archive(pages: DataFrame) -> DataFrame:
    """(pos, offset, length, page_id, record): the records in order, written to the shared folder."""
    record = record_of(pages["page_id"], pages["url"], pages["html"])
    made = pages.select("page_id", F.coalesce("url", F.lit("")).alias("_url"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("_sha"), record.alias("record"), F.octet_length(record).cast("long").alias("length"), F.lit(1).cast("long").alias("one"))
    placed = running_sums(made, ["page_id", "_url", "_sha"], ["length", "one"], "warc")
    return placed.select(F.col("one_before").alias("pos"), F.col("length_before").alias("offset"), "length", "page_id", "record")


def leaves(records: DataFrame) -> DataFrame:
    """Level 0 of the tree: (level, pos, start, stop, hash)."""
    span = F.concat_ws("-", F.col("offset"), F.col("offset") + F.col("length"))
    digest = F.sha2(F.concat(span, F.lit("|"), F.col("record")), 256)
    return records.select(F.lit(0).alias("level"), "pos", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), digest.alias("hash"))


def tree(records: DataFrame, name: str = "merkle") -> list[DataFrame]:
    """The levels of the Merkle tree over records, leaves first, root last."""
    levels = [saved(leaves(records), f"{name}-0")]
    n = levels[0].count()
    for k in range(1, max(1, math.ceil(math.log(max(n, 2)) / math.log(FAN_OUT) - 1e-9)) + 1):
        below = levels[-1]
        kids = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        up = below.groupBy(F.floor(F.col("pos") / FAN_OUT).alias("pos")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), kids.alias("kids"))
        joined = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
        node = F.sha2(F.concat(F.concat_ws("-", "start", "stop"), F.lit("|"), joined), 256)
        levels.append(saved(up.select(F.lit(k).alias("level"), "pos", "start", "stop", node.alias("hash")), f"{name}-{k}"))
    return levels


def mismatches(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(pos) of the records in which two replicas differ, found from the roots down."""
    spark = ours[0].sparkSession
    depth = max(len(ours), len(theirs))
    suspects = None
    for k in range(depth - 1, -1, -1):
        a, b = (t[k] if k < len(t) else t[-1].where("false") for t in (ours, theirs))
        if suspects is not None:
            kids = suspects.select(F.explode(F.sequence(F.col("pos") * FAN_OUT, F.col("pos") * FAN_OUT + (FAN_OUT - 1))).alias("pos"))
            a, b = a.join(kids, "pos"), b.join(kids, "pos")
        both = a.select("pos", F.col("hash").alias("h1")).join(b.select("pos", F.col("hash").alias("h2")), "pos", "full")
        suspects = saved(both.where(~F.col("h1").eqNullSafe(F.col("h2"))).select("pos"), f"audit-{k}")
        if suspects.limit(1).count() == 0:
            return spark.createDataFrame([], "pos long")
    return suspects


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record of the first archive: page_id, record_offset, length, record_sha256, intact."""
    bad = mismatches(tree(records, "merkle-a"), tree(replica, "merkle-b")).withColumn("bad", F.lit(True))
    rows = records.select("pos", "page_id", F.col("offset").alias("record_offset"), "length", F.sha2("record", 256).alias("record_sha256"))
    return rows.join(bad, "pos", "left").select("page_id", "record_offset", "length", "record_sha256", F.col("bad").isNull().alias("intact"))


def damaged(records: DataFrame, every: int = DAMAGE_EVERY) -> DataFrame:
    """A replica in which the last byte of the body of every `every`-th page_id is overwritten by `~`: known corruption to be found."""
    hurt = F.concat(F.expr("substring(record, 1, char_length(record) - 5)"), F.lit("~"), F.lit("\r\n\r\n"))
    return records.withColumn("record", F.when(F.col("page_id") % every == 0, hurt).otherwise(F.col("record")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return audit(records, damaged(records))


OP6_SQL = f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'null')
         || '>' || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR)
         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages),
l AS (SELECT *, CAST(octet_length(encode(rec)) AS BIGINT) AS length FROM r)
SELECT page_id,
       CAST(coalesce(sum(length) OVER (ORDER BY page_id NULLS LAST, u, sha256(h) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
       length, sha256(rec) AS record_sha256,
       NOT coalesce(page_id % {DAMAGE_EVERY} = 0 AND right(rec, 5) <> '~' || chr(13) || chr(10) || chr(13) || chr(10), FALSE) AS intact
FROM l
"""
