"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share `share` times all words; a target stops at `cap` times its source's words and the excess is shared again by weight.
A document's expected copies are target / source words. The whole part is taken at once; the fractional parts are rounded by
pivotal pairing: two open documents exchange expected *words* (so the source's sum stays exact) until one of them is at 0 or
1. Chunks of a source pair on their own; each leaves one open document, and a tree of `fan_in`-way steps pairs those, so at
the root a source misses its target by less than one document; pairing goes from large to small, so that one is small.

Defined cases: null text counts 0 words; a document of 0 words takes 0 words; a null source is a source of its own, last
in order; an empty table gives an empty result; repeated rows are separate documents; extra columns are ignored, and
random draws depend only on seed, source, chunk and the ordered rows, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running_sums, saved, text_of, word_count

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
CHUNK_ROWS, FAN_IN = 4096, 16
_ROW = "doc_id long, source string, size long, source_size long, target double, copies int, frac double, chunk long, levels int"


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, n, target. The loop moves two sums per step to the driver."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_sums(per, ["source"], ["one"], "source-rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    ranked = saved(ranked.select("source", "source_size", "n", w.alias("w")), "sources")
    goal = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, fixed = 0.0, -1
    while True:
        over = F.col("w") * F.lit(level) > F.lit(cap) * F.col("source_size")
        r = ranked.agg(F.sum(F.when(over, cap * F.col("source_size"))), F.sum(F.when(~over, F.col("w"))), F.count(F.when(over, 1))).first()
        if r[2] == fixed:
            break
        fixed, free = r[2], float(r[1] or 0.0)
        level = (goal - float(r[0] or 0.0)) / free if free else math.inf
        if not free:
            break
    target = F.least(F.col("w") * F.lit(level), F.lit(cap) * F.col("source_size").cast("double")) if math.isfinite(level) else F.lit(cap) * F.col("source_size")
    return ranked.select("source", "source_size", "n", target.cast("double").alias("target"))


def _pivot(sizes: np.ndarray, fracs: np.ndarray, rng) -> int:
    """Rounds fracs in place, pair by pair; returns the index of the one left open, or -1."""
    held = -1
    for i in range(len(fracs)):
        if not 0.0 < fracs[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        p, q, s, t = fracs[held], fracs[i], sizes[held], sizes[i]
        up, down = min(1.0 - p, q * t / s), min(p, (1.0 - q) * t / s)
        if rng.random() * (up + down) < down:
            p2, q2 = (1.0, q - up * s / t) if up == 1.0 - p else (p + up, 0.0)
        else:
            p2, q2 = (0.0, q + down * s / t) if down == p else (p - down, 1.0)
        fracs[held], fracs[i] = (min(max(x, 0.0), 1.0) for x in (p2, q2))
        p_open, q_open = 0.0 < fracs[held] < 1.0, 0.0 < fracs[i] < 1.0
        held = held if p_open else i if q_open else -1
    return held


def _round_group(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "frac"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
        src, chunk = pdf["source"].iloc[0], int(pdf["chunk"].iloc[0])
        key = f"{seed}|{'' if src is None else 's' + str(src)}|{chunk}|{last}|{len(pdf)}"
        rng = np.random.default_rng(zlib.crc32(key.encode()))
        fracs, sizes = pdf["frac"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
        left = _pivot(sizes, fracs, rng)
        if last and left >= 0:
            fracs[left] = 1.0 if rng.random() < fracs[left] else 0.0
        shut = (fracs == 0.0) | (fracs == 1.0)
        pdf["copies"] = pdf["copies"].to_numpy() + np.where(shut, fracs, 0.0).astype(np.int32)
        pdf["frac"] = np.where(shut, 0.0, fracs)
        pdf["copies"] = pdf["copies"].astype(np.int32)
        return pdf

    return run


def mix_sized(sized: DataFrame, seed: int = 7, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """sized: (doc_id, source, size), already on disk. Adds source_size, target and copies (0 .. cap)."""
    targets = source_targets(sized, weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chunks = F.ceil(F.col("n") / chunk_rows)
    cols = ["doc_id", "source", "size", "source_size", "target", "copies", "frac", "chunk", "levels"]
    other = targets.select(F.col("source").alias("_s"), "source_size", "n", "target")
    rows = (
        sized.join(other, sized["source"].eqNullSafe(other["_s"]))
        .withColumn("whole", F.floor(ratio))
        .withColumn("copies", F.col("whole").cast("int"))
        .withColumn("frac", F.when(F.col("size") > 0, ratio - F.col("whole")).otherwise(0.0))
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), chunks))
        .withColumn("levels", F.ceil(F.log(F.greatest(chunks, F.lit(1))) / math.log(fan_in) - 1e-9).cast("int"))
        .select(*cols)
    )
    done, level = [], 0
    most = int(targets.agg(F.max(F.ceil(F.col("n") / chunk_rows))).first()[0] or 1)
    deep = max(0, math.ceil(math.log(most) / math.log(fan_in) - 1e-9))
    while True:
        out = saved(rows.groupBy("source", "chunk").applyInPandas(_round_group(seed + level, level == deep), _ROW), f"mix-{level}")
        done.append(out.where("frac = 0"))
        if level == deep:
            break
        rows = out.where("frac > 0").withColumn("chunk", F.floor(F.col("chunk") / fan_in))
        level += 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.drop("frac", "chunk", "levels")


def _sized(docs: DataFrame) -> DataFrame:
    return saved(docs.select("doc_id", "source", word_count(text_of(docs)).alias("size")), "sizes")


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words, repeats counted)."""
    return mix_sized(_sized(docs), **how).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """docs as mixed: each row as often as it is taken, with all of docs' columns, whatever their names.

    Rows are matched by (doc_id, source, size). Rows that agree in all three have their copies dealt in the order of their texts' hashes, then
    of all their columns' (rows that agree there too are the same); a row of 0 words is taken as often as its source's ratio says, in whole
    copies. The texts are shuffled once, by a merge join at every size: what is taken grows with the documents and is never broadcast.
    """
    key = ["doc_id", "source", "size"]
    taken = saved(mix_sized(_sized(docs), **how).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")), "mix-taken")
    plain = [docs[c] for c in docs.columns if not re.search("map<|variant", docs.schema[c].dataType.simpleString())]
    mine = {"k0": docs["doc_id"], "k1": docs["source"], "k2": word_count(text_of(docs)), "order": F.struct(F.xxhash64(docs["text"]), F.xxhash64(*plain))}
    rows = docs.select(*[c.alias(n) for n, c in mine.items()], F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = rows["k0"].eqNullSafe(taken["doc_id"]) & rows["k1"].eqNullSafe(taken["source"]) & (rows["k2"] == taken["size"])
    both = rows.join(taken.hint("merge"), same).drop(*key)
    one = both.where("n = 1").withColumn("at", F.lit(0).cast("long"))
    if taken.where("n > 1").limit(1).count():
        order = Window.partitionBy("k0", "k1", "k2").orderBy("order")
        one = one.unionByName(both.where("n > 1").withColumn("at", (F.row_number().over(order) - 1).cast("long")))
    times = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("at") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return one.withColumn("time", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
