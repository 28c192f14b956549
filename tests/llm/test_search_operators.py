"""SimHash, hard negatives, source divergence: brute-force comparisons and edge cases."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from quadrille.llm import divergence, negatives, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, print long, salt int"


def docs_table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None, "x", 5, 1) for i, t, g, s in rows], DOCS)


def plain_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", lower) if x]
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def plain_components(rows, bits=2):
    prints = [plain_print(t) for _, t, _, _ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {k: min((r[0] for r, x in zip(rows, label) if x == k and r[0] is not None), default=None) for k in set(label)}
    return sorted(((r[0], f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, label)), key=str)


@pytest.fixture(scope="module")
def near_rows():
    r = random.Random(11)
    base = [[f"w{r.randrange(300)}" for _ in range(150)] for _ in range(25)]
    rows = [(k, " ".join(w), "en", "s") for k, w in enumerate(base)]
    for k, w in enumerate(base):
        for j in range(4):
            v = list(w)
            v[r.randrange(150)] = "other"
            rows.append((100 + 10 * k + j, " \t".join(v), "en", "s"))
    rows += [(900 + k, rows[3][1], "en", "s") for k in range(30)]
    rows += [(901, rows[3][1], "en", "s"), (None, rows[4][1], "en", None), (None, None, None, None), (70, None, None, "s"), (71, "", "en", "s"), (72, " \n\t", "en", "s")]
    rows += [(73, "one", "en", "s"), (74, "ONE", "en", "s"), (75, "one two", "en", "s"), (76, " ".join(f"long{r.randrange(50)}" for _ in range(20_000)), "en", "s"), (77, "É é", "en", "s"), (78, "é É", "en", "s")]
    return rows


@pytest.mark.parametrize("how", [{}, {"leaf": 4, "step": 2}])
def test_simhash_against_all_pairs(spark, near_rows, how):
    got = simhash.near_groups(docs_table(spark, near_rows).repartition(5), **how).select("doc_id", "fingerprint", "component_id").collect()
    want = plain_components(near_rows)
    assert sorted(map(tuple, got), key=str) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_groups(docs_table(spark, [])).count() == 0


def test_trie_walk_finds_each_pair_once():
    r = np.random.default_rng(1)
    v = {int(x) << 1 for x in r.integers(0, 1 << 63, 200)}
    for b in list(v)[:8]:
        for _ in range(40):
            x = b
            for k in r.integers(0, 64, r.integers(0, 4)):
                x ^= 1 << int(k)
            v.add(x)
    v = np.array(sorted(v), np.uint64)
    want = sorted((i, j) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= 2).tolist() if i < j)
    assert sorted(p for i, j in simhash.walk(v, v, 0, 2, True, limit=40) for p in zip(i.tolist(), j.tolist())) == want and len(want) > 500


def test_hot_fingerprints_are_spread(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 10)
    rows = [(k, "same words here", "en", "s") for k in range(200)] + [(1000 + k, f"word{k} and word{k} or word{k}", "en", "s") for k in range(20)]
    got = simhash.near_groups(docs_table(spark, rows)).collect()
    assert len(got) == 220 and {g["component_id"] for g in got if g["doc_id"] < 1000} == {0} and {g["class_size"] for g in got if g["doc_id"] < 1000} == {200}


def plain_negatives(rows):
    use = [(i, (g + 1) % 10 if i % 7 == 0 else g, [math.floor(256 * x) for x in v]) for i, g, v in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, g, v) in enumerate(use):
        if i % 100:
            continue
        near = sorted((-score(v, w), j, m) for m, (j, h, w) in enumerate(use) if m != k)
        like = [(j, -s) for s, j, m in near if use[m][1] == g][:5]
        for j, p in like:
            fit = [(o, -s) for s, o, m in near if use[m][1] != g and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(i, j, r + 1, o, p, n) for r, (o, n) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, dims, spread=1.0):
    r = np.random.default_rng(seed)
    return [(k, int(r.integers(0, 10)), [float(x) for x in r.normal(0, spread, dims)]) for k in range(n)]


@pytest.mark.parametrize("seed,dims,how", [(1, 8, {"pivots": 4, "page": 16}), (2, 3, {"pivots": 3, "page": 5}), (3, 24, {})])
def test_negatives_against_all_pairs(spark, seed, dims, how):
    rows = vectors(seed, 420, dims)
    rows += [(600 + k, 3, rows[100][2]) for k in range(60)] + [rows[100], rows[200], rows[50]]  # repeated vectors, anchors and rows
    rows += [(1000, None, [1.0] * dims), (1100, 2, None), (1200, 2, [float("nan")] + [1.0] * (dims - 1)), (1300, 2, [None] * dims), (1400, 4, [0.0] * dims), (1500, 4, [0.5, 0.5]), (None, 4, [1.0] * dims)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, page string, row int").repartition(6)
    moved = negatives.whole_numbers(table).selectExpr("vec_id", "case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label", "v")
    got = negatives.hard_negatives(moved, **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_negatives_of_few_rows(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert negatives.hard_negatives(negatives.whole_numbers(table([]))).count() == 0
    assert negatives.hard_negatives(negatives.whole_numbers(table([(1, 1, [1.0])]))).count() == 0
    assert negatives.hard_negatives(negatives.whole_numbers(table([(100, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [0.5])]))).count() == 0
    big = [(100, 1, [2.0**20]), (1, 1, [2.0**20]), (2, 2, [2.0**19]), (3, 2, [2.0**18])]
    assert sorted(r["negative_id"] for r in negatives.hard_negatives(negatives.whole_numbers(table(big))).collect()) == [2]
    assert (negatives.products(np.array([[2**40, 1]]), np.array([[2**20, 3]])) == [[2**60 + 3]]).all()


def plain_divergence(rows, least, prior, top):
    texts = [(g or "", s or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, g, s in rows]
    out = []
    for lang in {g for g, _, _ in texts}:
        own = [(s, w) for g, s, w in texts if g == lang]
        df, total = {}, {}
        for _, w in own:
            for t in set(w):
                df[t] = df.get(t, 0) + 1
        kept = {t for t in df if df[t] >= least}
        counts = {}
        for s, w in own:
            c = counts.setdefault(s, {})
            for t in w:
                if t in kept:
                    c[t] = c.get(t, 0) + 1
                    total[t] = total.get(t, 0) + 1
        share = lambda c: {t: 1 + 10**9 * (c.get(t, 0) + prior) // (sum(c.values()) + prior * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in counts[s] if p[s][t] > q[t])[:top]
            out += [(lang, s, part, o, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, o) in enumerate(found)]
    return sorted(out)


def test_divergence_against_all_terms(spark, monkeypatch):
    r = random.Random(5)
    rows = []
    for k in range(240):
        s = r.choice(["a", "a", "b", "ÿ", "z", None, ""])
        words = [r.choice(["the", "The", "É", "é", "x1y", "naïve", "日本", "b-c", f"{s}own", f"w{r.randrange(40)}"]) for _ in range(r.randrange(0, 30))]
        rows.append((k, " ".join(words), r.choice(["en", "en", "de", None]), s))
    rows += [(None, None, "en", "silent"), (300, "", "fr", "only"), (301, "rare words", "fr", "second"), (302, "12 34 _", "it", "alone"), rows[0], rows[0], (303, "the " * 30_000, "en", "long")]
    for how in ((30, 5, 50), (3, 1, 4)):
        got = divergence.divergence(docs_table(spark, rows).repartition(4), *how).collect()
        assert sorted(map(tuple, got)) == plain_divergence(rows, *how)
    monkeypatch.setattr(divergence, "HELD", 7)
    assert sorted(map(tuple, divergence.divergence(docs_table(spark, rows).coalesce(1)).collect())) == plain_divergence(rows, 30, 5, 50)
    assert divergence.divergence(docs_table(spark, [])).count() == 0
