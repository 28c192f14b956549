"""How far the sources of a language differ from each other in their words: sums of absolute differences of smoothed term shares.

Every language keeps the terms of at least `least_docs` of its documents. A source gives each kept term the share
p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), N its occurrences of kept terms, V how many terms are kept; all in integers.

The sum over all V terms of |p - q| for two sources isn't taken term by term. By inclusion and exclusion over the terms that each
source has (its support):
* a term that neither has costs |p0 - q0|, p0 and q0 being the shares at count 0: a constant, V - |A| - |B| + |A and B| times;
* a term of one source costs |p - q0|, which depends on its count alone: the source's histogram of shares prices all of them at once;
* a term of both is found by joining the postings (only terms that occur), and corrects what the first two took it for.

Texts are counted in one scan, whose tasks add up their own terms before anything is shuffled; nothing is collected. A pair of
sources is summed once for both directions, and what is joined on a language alone is spread over SALT keys.

Defined cases: null text, lang and source count as ''; empty texts and sources without a kept term take part with count 0; a language
that keeps no term has pairs of value 0; repeated rows each count; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
HELD = 1 << 18  # terms that a task holds before it hands them on
SALT = 16

#: bytes of terms: ASCII letters, lower-cased, and all of the other characters; the rest parts them
_TERM_BYTES = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _counted(batches):
    """(lang, source, term, n, docs): what a task has read, added up as far as HELD terms allow."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out():
        for (lang, source), (n, docs) in found.items():
            k = len(n)
            columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            for at in range(0, k, 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 16) for c in columns], names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            own = Counter(terms_of(text.as_py()))
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            n.update(own)
            docs.update(own.keys())
            held += len(n)
            if held > HELD:
                yield from out()
                found, held = {}, 0
    yield from out()


def _named(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(docs[c], F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), empty("text"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    texts = _named(docs).select("lang", "source", F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, v: Column, prior: int) -> Column:
    """The share as a long, exactly: the product can leave 64 bits, the quotient can't."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = wide(count + prior) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + prior * v)
    return F.when(below > 0, 1 + F.call_function("div", above, below)).cast("long")


def _ranked(rows: DataFrame) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, prior: int = PRIOR, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: item is each other source of the language, value the sum of differences.
    Part `term`: item is one of the `top` terms of the source whose share is above that of its language, value by how much."""
    terms = saved(term_counts(docs), "divergence-terms")
    kept = saved(terms.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("of_lang").alias("lang_total"))
    held = terms.drop("docs").join(kept, ["lang", "term"])
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
    groups = _named(docs).select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total", "support"])
    groups = saved(groups.withColumn("p0", _share(F.lit(0).cast("long"), F.col("total"), F.col("v"), prior)), "divergence-groups")
    postings = held.join(groups, ["lang", "source"])
    shares = _share(F.col("n"), F.col("total"), F.col("v"), prior).alias("p"), _share(F.col("of_lang"), F.col("lang_total"), F.col("v"), prior).alias("q")
    postings = saved(postings.select("lang", "source", "term", "p0", *shares), "divergence-postings")

    salt = F.pmod(F.xxhash64("source"), F.lit(SALT))
    a = groups.select("lang", F.col("source").alias("a"), F.col("support").alias("na"), F.col("p0").alias("a0"), "v", salt.alias("salt"))
    b = groups.select("lang", F.col("source").alias("b"), F.col("support").alias("nb"), F.col("p0").alias("b0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    pairs = saved(a.join(b, ["lang", "salt"]).where("a < b").drop("salt"), "divergence-pairs")
    # terms of neither, had the two no term in common
    neither = pairs.select("lang", "a", "b", F.coalesce((F.col("v") - F.col("na") - F.col("nb")) * F.abs(F.col("a0") - F.col("b0")), F.lit(0)).alias("value"))
    # terms of one, priced by the histogram of its shares
    histogram = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select("lang", "a", "b", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b0").alias("other0")), F.struct(F.col("b").alias("source"), F.col("a0").alias("other0")))).alias("s"))
    one = sides.select("lang", "a", "b", "s.source", "s.other0").join(histogram, ["lang", "source"]).select("lang", "a", "b", (F.col("n") * F.abs(F.col("p") - F.col("other0"))).alias("value"))
    # terms of both: their true difference for what the two sums above took them for
    left = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    right = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", (apart("pa", "pb") - apart("pa", "b0") - apart("pb", "a0") + apart("a0", "b0")).alias("value"))
    total = neither.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pair = _ranked(total.select("lang", "value", F.explode(ways).alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value"))
    over = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pair.unionByName(_ranked(over).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(d) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, l.v, coalesce(c.n, 0) AS n, 1 + (CAST({SCALE} AS HUGEINT) * (k.n + {PRIOR})) // (l.total + {PRIOR} * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
shares AS (SELECT c.*, 1 + (CAST({SCALE} AS HUGEINT) * (c.n + {PRIOR})) // (s.total + {PRIOR} * c.v) AS p FROM cells c JOIN sums s ON s.lang = c.lang AND s.source = c.source),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
parts AS (
  SELECT p.lang, p.source, 'pair' AS part, p.item, CAST(coalesce(a.value, 0) AS BIGINT) AS value FROM pairs p LEFT JOIN apart a ON a.lang = p.lang AND a.source = p.source AND a.item = p.item
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
