"""Exact dedup, near dedup, mixing, sharding, WARC: brute-force comparisons and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup, graph, language, mixing, near_dedup, sharding, warc
from quadrille.llm.common import running_sums
from quadrille.llm.shingles import shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep long, digest string, size string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 5, "x", "y") for i, t, s in rows], DOCS)


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    base = [words(r, 60) for _ in range(12)]
    out = [(100 + k, b, f"s{k % 3}") for k, b in enumerate(base)]
    for k, b in enumerate(base[:8]):
        w = b.split()
        for j in range(1, 5):
            v = list(w)
            for _ in range(j):
                v[r.randrange(len(v))] = "new"
            out.append((200 + 10 * k + j, " ".join(v), None if j == 2 else "s0"))
    out += [(50, base[0].replace(" ", "\t\n "), "s1"), (51, base[0].upper(), "s1"), (52, base[3], "s0"), (52, base[3], "s0"), (None, base[3], "s2"), (None, None, None)]
    out += [(60, None, "s0"), (61, "", "s1"), (62, " \n", None), (63, "a b c", "s0"), (64, "A  B c", "s0"), (65, words(r, 30_000, 10**6), "hot")]
    return out


def test_exact_groups(spark, rows):
    want = {}
    for i, t, _ in rows:
        want.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    for how in ({}, {"memtable_rows": 5, "fan_in": 2, "shard_entries": 4}, {"digest_bytes": 1}):
        got = exact_dedup.group_documents(table(spark, rows).repartition(7), **how).collect()
        assert len(got) == len(rows)
        by = {}
        for g in got:
            by.setdefault(g["text_sha256"], []).append(g)
        assert set(by) == {hashlib.sha256(t.encode()).hexdigest() for t in want}
        for t, ids in want.items():
            group = by[hashlib.sha256(t.encode()).hexdigest()]
            least = min((i for i in ids if i is not None), default=None)
            assert sorted(map(str, (g["doc_id"] for g in group))) == sorted(map(str, ids))
            assert {(g["keep_id"], g["group_size"]) for g in group} == {(least, len(ids))}
            assert [g["doc_id"] for g in group if g["kept"]] == [least]
    kept = exact_dedup.keep_first(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and kept.count() == len(want)


def test_bloom_has_no_false_negatives():
    keys = [hashlib.sha256(bytes([k])).digest() for k in range(200)]
    f = exact_dedup.bloom(keys)
    assert exact_dedup.bloom_holds(f, keys).all()
    assert exact_dedup.bloom_holds(f, [hashlib.sha256(b"%d" % k).digest() for k in range(1000)]).mean() < 0.05


def plain_shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())


def brute_components(rows, percent):
    sets = [plain_shingles(t) for _, t, _ in rows]
    key = [i if i is not None else near_dedup.NO_ID for i, _, _ in rows]
    root = {k: k for k in key}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(key[a]), find(key[b])
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in key}, {k: len(s) for k, s in zip(key, sets)}


@pytest.mark.parametrize("region", [2048, 3])
def test_near_groups(spark, rows, region):
    want, sizes = brute_components(rows, 85)
    got = near_dedup.near_groups(table(spark, rows), region=region).collect()
    assert len(got) == len(rows)
    for g in got:
        k = g["doc_id"] if g["doc_id"] is not None else near_dedup.NO_ID
        c = g["component_id"] if g["component_id"] is not None else near_dedup.NO_ID
        if region == 2048 and g["doc_id"] is not None:
            assert (c, g["kept"]) == (want[k], want[k] == k), k
            assert g["n_shingles"] == sizes[k]
        assert c <= k
    assert near_dedup.keep_one(table(spark, rows)).columns == table(spark, rows).columns


def test_near_groups_of_oversized_regions(spark, rows):
    base = [f"b{k}" for k in range(400)]
    some = []
    for k in range(20):  # 40 texts in one region at every depth; only the two that differ from the base in the same word are linked
        for j in range(2):
            some.append((1000 + 20 * j + k * 7 % 20, " ".join(base[: 9 + 20 * k] + [f"new{j}"] + base[10 + 20 * k :]), "s0"))
    want, _ = brute_components(some, 97)
    assert len(set(want.values())) == 20
    got = near_dedup.near_groups(table(spark, some), percent=97, region=20).collect()
    assert {g["doc_id"]: g["component_id"] for g in got} == want
    some = [x for x in rows if x[0] is not None]
    want, _ = brute_components(some, 85)
    got = near_dedup.near_groups(table(spark, some), region=3).collect()
    assert {g["doc_id"]: g["component_id"] for g in got} == want


def region_pairs(spark, sigs, region):
    classes = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sigs)], "id long, sig binary")
    units = {}
    for u in near_dedup._regions(classes, region).collect():
        units.setdefault(u["unit"], set()).add(u["id"])
    return {(a, b) for m in units.values() for a in m for b in m if a < b}


def test_depth_follows_the_region(spark):
    r = np.random.default_rng(3)
    sigs = r.integers(0, 1 << 16, (9, near_dedup.TREES * near_dedup.DEPTH), dtype=np.uint16)
    sigs[:, : near_dedup.MIN_DEPTH] = 7  # one region of the first tree
    sigs[:5, near_dedup.MIN_DEPTH] = 8  # with two branches below it, of which one branches again
    sigs[5:, near_dedup.MIN_DEPTH] = 9
    sigs[:3, near_dedup.MIN_DEPTH + 1] = 1
    every = lambda ids: {(a, b) for b in ids for a in ids if a < b}
    assert region_pairs(spark, sigs, 9) == every(range(9))
    assert region_pairs(spark, sigs, 5) == every(range(5)) | every(range(5, 9))
    assert region_pairs(spark, sigs, 4) == every(range(3)) | every(range(5, 9))


def test_regions_crowded_at_every_depth_are_searched_whole(spark):
    r = np.random.default_rng(3)
    sigs = r.integers(0, 1 << 16, (9, near_dedup.TREES * near_dedup.DEPTH), dtype=np.uint16)
    sigs[:, : near_dedup.MAX_DEPTH] = 7
    for region in (9, 3):
        assert region_pairs(spark, sigs, region) == {(a, b) for b in range(9) for a in range(b)}


def test_forest_of_a_region_joins_what_all_pairs_join():
    r = np.random.default_rng(5)
    base = r.integers(0, 9, (6, 192), dtype=np.uint16)
    sig = base[r.integers(0, 6, 300)].copy()
    change = r.random(sig.shape) < r.random((300, 1)) * 0.3
    sig[change] = r.integers(0, 9, int(change.sum()))
    unit, n = np.sort(r.integers(0, 12, 300)), r.integers(80, 101, 300)
    label = list(range(300))
    for b in range(300):
        for a in range(b):
            fits = unit[a] == unit[b] and 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b])
            if fits and (sig[a] == sig[b]).mean() >= 0.7 and label[a] != label[b]:
                label = [label[a] if x == label[b] else x for x in label]
    got = list(range(300))
    pairs = near_dedup._forest_of(unit, n, sig, 85, 0.7)
    for a, b in pairs:
        assert got[a] != got[b]
        got = [got[a] if x == got[b] else x for x in got]
    groups = lambda x: {frozenset(i for i in range(300) if x[i] == v) for v in x}
    assert groups(got) == groups(label)


def test_shingle_hashes_follow_the_words():
    assert len(shingle_set(None)) == len(shingle_set(" \t")) == 0
    assert (shingle_set("a B\tc  d e f") == shingle_set(" A b c d\nE f ")).all()
    assert len(shingle_set("a b c")) == 1 and len(shingle_set("a b c d e f g")) == 3
    assert set(shingle_set("a b c d e x")) & set(shingle_set("q a b c d e"))


def test_texts_that_polynomials_confuse_stay_apart(spark):
    """Thue-Morse words agree with their complements under any polynomial modulo 2**64."""
    bits = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    rows = [(1, bits, "s"), (2, bits.translate({97: 98, 98: 97}), "s")]
    got = near_dedup.near_groups(table(spark, rows)).collect()
    assert {(g["doc_id"], g["component_id"], g["kept"], g["n_shingles"]) for g in got} == {(1, 1, True, 1), (2, 2, True, 1)}


def test_mixing(spark, rows):
    got = mixing.mix(table(spark, rows), chunk_rows=3, fan_in=2).collect()
    again = mixing.mix(table(spark, rows).repartition(5), chunk_rows=3, fan_in=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = {s: 0 for s in order}
    for g in got:
        assert g["source_size"] == size[g["source"]] and abs(g["target"] - target[g["source"]]) < 1e-6
        assert 0 <= g["taken"] <= 2 * g["size"]
        taken[g["source"]] += g["taken"]
    for s in order:
        biggest = max(g["size"] for g in got if g["source"] == s)
        assert abs(taken[s] - target[s]) <= biggest
    mixed = mixing.mixed_rows(table(spark, rows))
    assert mixed.columns == table(spark, rows).columns


def test_running_sums_start_no_other_python_workers(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("n")).repartition(5)
    out = running_sums(d, ["x"], ["n"], "sums")
    assert "ExistingRDD" not in out._jdf.queryExecution().toString()  # rows of Python, by way of a daemon and workers of their own
    total = 0
    for r in out.orderBy("x").collect():
        assert r["n_before"] == total
        total += r["n"] or 0
    assert running_sums(d.where("false"), ["x"], ["n"], "sums").columns == ["x", "n", "n_before"]
    assert running_sums(d.where("false"), ["x"], ["n"], "sums").count() == 0


def test_pivot_keeps_expectations():
    sizes = np.array([5.0, 3.0, 8.0, 2.0, 7.0])
    total = np.zeros(5)
    for seed in range(3000):
        f = np.full(5, 0.4)
        left = mixing._pivot(sizes, f, np.random.default_rng(seed))
        assert abs((f * sizes).sum() - 0.4 * sizes.sum()) < 1e-9
        assert all(x in (0.0, 1.0) for k, x in enumerate(f) if k != left)
        total += f
    assert np.abs(total / 3000 - 0.4).max() < 0.05


def test_sharding(spark, rows):
    limit = 900
    for step in (2, 12):
        got = sharding.shard(table(spark, rows), limit, step).collect()
        assert len(got) == len(rows)
        sums = {}
        for g in got:
            sums[(g["depth"], g["prefix"], g["page"])] = sums.get((g["depth"], g["prefix"], g["page"]), 0) + g["bytes"]
        for g in got:
            total = sums[(g["depth"], g["prefix"], g["page"])]
            assert total == g["shard_bytes"] and (total <= limit or total == g["bytes"])
    one = table(spark, [(7, "x" * 100, "s")] * 40)
    pages = sharding.shard(one, 1000).collect()
    assert {p["depth"] for p in pages} == {60} and max(p["shard_bytes"] for p in pages) <= 1000
    mixed = sharding.shard(table(spark, [(7, "x" * n, "s") for n in (45, 90, 0, 1, 1, 2, 64, 65, 33, 100, 101, 250, 128)]), 100).collect()
    assert all(p["shard_bytes"] <= 100 or p["shard_bytes"] == p["bytes"] for p in mixed) and len({p["page"] for p in mixed}) < 13


def test_shards_written_hold_every_row(spark, tmp_path):
    rows = [(7, "x" * n, "s") for n in (45, 90, 45, 45, 90, 10)] + [(k, "y" * 30, None) for k in range(40)] + [(None, "no key", "s"), (None, None, "s"), (3, "y" * 30, "again")]
    docs = table(spark, rows).selectExpr("*", "doc_id + 1 as _id", "'mine' as shard", "1 as _h")
    placed = sharding.write_shards(docs, str(tmp_path / "shards"), 100)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    sums = {r["_shard"]: r["n"] for r in back.groupBy("_shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).collect()}
    assert sums == {f"{p['depth']}-{p['prefix']}-{p['page']}": p["shard_bytes"] for p in placed.collect()} and max(sums.values()) <= 100


def test_warc_audit(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>é" + "x" * (k % 13)) for k in range(70)] + [(None, None, None), (5, "http://h/5", "again")], "page_id long, url string, html string")
    records = warc.archive(pages)
    rows = {r["pos"]: r for r in records.collect()}
    assert sorted(rows) == list(range(72))
    at = 0
    for k in range(72):
        r = rows[k]
        assert r["offset"] == at and r["length"] == len(r["record"].encode())
        at += r["length"]
    assert warc.audit(records, records).where("not intact").count() == 0
    hurt = records.withColumn("record", F.when(F.col("pos").isin(3, 40, 71), F.concat(F.col("record"), F.lit("!"))).otherwise(F.col("record")))
    bad = warc.audit(records, hurt).where("not intact")
    assert sorted(r["record_offset"] for r in bad.collect()) == [rows[k]["offset"] for k in (3, 40, 71)]
    assert warc.audit(records, records.where("pos <> 20")).where("not intact").count() == 1
    parsed = warc.parse_record(F.col("record"))
    back = records.select("page_id", parsed["url"].alias("url"), parsed["html"].alias("html"))
    filled = pages.fillna("")
    assert sorted(map(str, back.collect())) == sorted(map(str, filled.collect()))


def test_empty_tables(spark):
    none = table(spark, [])
    assert exact_dedup.group_documents(none).count() == 0 and exact_dedup.keep_first(none).count() == 0
    assert near_dedup.near_groups(none).count() == 0 and mixing.mix(none).count() == 0 and sharding.shard(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.audit(warc.archive(pages), warc.archive(pages)).count() == 0
    assert zlib.crc32(b"") == 0


def test_clashing_columns_and_ties(spark):
    names = ["score", "lang_pred", "_sha", "_key", "_id", "copies", "row", "n", "at", "time", "order", "key", "k0", "_n", "_copies"]
    texts = ["alpha beta gamma delta epsilon zeta", "alpha  beta gamma delta epsilon zeta", None, "", "one two three", "one two three", "x " * 50_000]
    rows = [(k if k != 4 else None, t, "en", "ab"[k % 2], *[f"{k}-{c}" for c in names]) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0]]  # repeated rows
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))
    whole = {tuple(r) for r in rows}
    for out in (exact_dedup.keep_first(d), near_dedup.keep_one(d), mixing.mixed_rows(d), language.keep_identified(d, 0.0)):
        assert out.columns == d.columns
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= whole
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in exact_dedup.keep_first(d).collect()) == [(False, k) for k in (0, 2, 5, 6)]
    per = Counter(tuple(r) for r in mixing.mixed_rows(d).collect())
    size = lambda t: len((t or "").split())
    taken = Counter()
    for r in mixing.mix(d).collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["copies"]
    want = Counter()
    for r, k in per.items():
        want[r[0], r[3], size(r[1])] += k
    assert want == +taken
    none = d.where("false")
    for out in (exact_dedup.keep_first(none), near_dedup.keep_one(none), mixing.mixed_rows(none), language.keep_identified(none)):
        assert out.count() == 0 and out.columns == d.columns


def test_marks_of_large_graphs(spark):
    many = spark.range(40_000_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert graph._mark(many) == graph._mark(many) and graph._mark(many)[0] == 40_000_000
