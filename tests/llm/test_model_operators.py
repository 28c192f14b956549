"""Token files, SentencePiece, nearest neighbours, language and LM scoring: libraries, brute force, held-out figures, edge cases."""

import heapq
import math
import os
import pathlib
import struct
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import language, lm, nearest, sentencepiece, token_store
from quadrille.llm.common import shared_dir

TEXTS = [
    None, "", "a", " ", "  x  y\n\n\tz ", "The quick brown fox, isn't it?", "日本語 テスト x", "🙂 ok\r\n", "<s> <|endoftext|>x</s>", "<|ENDOFTEXT|> <|EndOfText|> a<|STARTOFTEXT|>B <|startoftext|><|x|> <| A|B|>", "ﬁ É é ½ İstanbul ΟΔΥΣΣΕΥΣ", "\x01 a\x1cb a\x85b\xa0c !\x1c!",
    "it's don't 'sa ''s x's'd 12a3", "def f(x):\n        return x + 1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa ---------------", "long words and " * 3000,
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(10 * k, t, "en", 1, "z") for k, t in enumerate(texts)], "doc_id long, text string, lang string, start long, ids string")


def test_sentencepiece_equals_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL))
    coded = sentencepiece.decode(sentencepiece.encode(docs(spark))).orderBy("doc_id").collect()
    for row, t in zip(coded, TEXTS):
        assert row["ids"] == sp.encode(t or "") and row["decoded"] == (t or "")
    d = sentencepiece.digests(docs(spark)).collect()
    assert all(r["round_trip"] for r in d) and len(d) == len(TEXTS)


def test_pieces_of_a_batch_take_little_memory(spark):
    from sentencepiece import SentencePieceProcessor

    class Caught:  # digests() of it is the function that a worker runs
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    r = np.random.default_rng(3)
    vocabulary = np.array(["".join(map(chr, r.integers(97, 123, 5))) for _ in range(3000)])
    texts = [" ".join(vocabulary[r.integers(0, 3000, 600)]) for _ in range(2000)]
    texts[7:9] = [None, " ".join(vocabulary[r.integers(0, 3000, 120_000)])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    sentencepiece.Pieces.load(sentencepiece.model_path())
    run = sentencepiece.digests(Caught())
    tracemalloc.start()
    rows = [x for out in run(iter([batch])) for x in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    assert [x["doc_id"] for x in rows] == list(range(len(texts))) and all(x["round_trip"] for x in rows)
    sp = SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL))
    for k in (0, 7, 8, 9, 1999):
        ids = sp.encode(texts[k] or "")
        assert rows[k]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and rows[k]["n_pieces"] == len(ids)


def test_piece_cache_is_bounded_and_keeps_words_in_use(monkeypatch):
    monkeypatch.setattr(sentencepiece, "CACHE_WORDS", 400)
    sp = sentencepiece.Pieces([("<unk>", 0.0, 2)] + [(p, -1.0, 1) for p in ("▁", *"abcdefghij")], sentencepiece.UNIGRAM)
    coded, encode = [], sp.encode_words
    monkeypatch.setattr(sp, "encode_words", lambda words: coded.extend(words) or encode(words))
    for k in range(100):
        text = " ".join(["abc", *("".join("abcdefghij"[int(c)] for c in str(1000 + 50 * k + j)) for j in range(50))])
        (ids,) = sp.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == [1 if c == " " else 2 + ord(c) - 97 for c in " " + text]
        assert len(sp.words) + len(sp.older) <= 400
    assert coded.count(" abc") == 1


def test_unigram_forward_pass_is_viterbi():
    r = np.random.default_rng(1)
    pieces = [("<unk>", 0.0, 2)] + [(p, float(-r.integers(1, 90)), 1) for p in ("a", "b", "c", "ab", "bc", "abc", "ca", "▁", "▁a", "▁ab")]
    sp = sentencepiece.Pieces(pieces, sentencepiece.UNIGRAM)
    score = {p: s for p, s, _ in pieces}

    def best(w):
        return max([0.0] if not w else [score[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in score], default=-math.inf)

    words = sorted({" " * int(r.integers(0, 2)) + "".join(r.choice(list("abc"), int(r.integers(1, 9)))) for _ in range(200)})
    for w, ids in zip(words, sp.encode_words(words)):
        assert sum(sp.score[i] for i in np.frombuffer(ids, "<u4")) == best(w.replace(" ", "▁"))


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.tokenizer_path())
    uri = str(tmp_path / "store")
    token_store.write_store(docs(spark).repartition(3), uri, token_store.tokenizer_path(), file_ids=2000)
    got = token_store.read_store(spark, uri).orderBy("doc_id").collect()
    start = 0
    for row, text in zip(got, TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids + [token_store.END_ID]
        assert (row["start"], row["n_tokens"], row["ids"]) == (start, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    assert len([f for f in os.listdir(uri) if f.endswith(".rans")]) > 2


def test_encoder_equals_the_library_on_odd_words():
    encoder = token_store.WordEncoder(token_store.tokenizer_path())
    bits = ["a", "B", "Bar's", "'s", "DON'T", "x1", "12", "é", "É", "ß", "İ", "ſ", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "ABC<|", "|>", "...", "!?", "`a`", "漢字"]
    bits += [" ", " ", "\x0b", "\x1c", "\x85", "\t", "\n", "", "\u0301", "🙂", "a_b", "'LL", "\u200b", "ﬁ", "À", "Œ", "^", "x~y", "\u2028"]
    rng = np.random.RandomState(5)
    texts = ["".join(rng.choice(bits, rng.randint(15))) for _ in range(4000)] + [None, "", " ", "a" * 5000, "!" * 3000]
    for at in range(0, len(texts), 777):
        some = texts[at : at + 777]
        assert encoder.encode(some) == [np.array(encoder.lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in some]
    flat, ends = encoder.encode_flat(pa.array(texts).slice(3, 9))
    assert flat.tobytes() == b"".join(encoder.encode(texts[3:12])) and len(ends) == 9
    assert encoder.encode([]) == []


def test_rans_blocks():
    r = np.random.default_rng(0)
    ids = np.minimum(r.zipf(1.3, 70_001), 999).astype(np.uint32)
    coder = token_store.Coder(token_store.frequencies(np.bincount(ids, minlength=1200)), lanes=64, checkpoint=100)
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all() and len(block) < 2 * len(ids)
    assert (coder.decode(block, 2, 4) == ids[2 * 6400 : 4 * 6400]).all()
    hurt = bytearray(block)
    hurt[-3] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(hurt))
    assert len(coder.decode(coder.encode(ids[:0]))) == 0
    for counts in (np.ones(50_000, np.int64), np.array([0, 10**15, 1])):
        f = token_store.frequencies(counts)
        assert f.sum() == 1 << token_store.SCALE and ((f > 0) == (counts > 0)).all()


def test_nearest_recall_and_edges(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 16)) + 3 * r.normal(size=(20, 16))[r.integers(0, 20, 1500)]
    rows = [(k, [float(v) for v in x[k]]) for k in range(1500)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [1.0] * 3), (None, [1.0] * 16), (2005, [float("inf")] * 16)]
    rows += [(3000 + k, rows[50][1]) for k in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    use = nearest.saved(nearest.usable(table), "t")
    assert use.count() == 1509
    q = nearest.fitted(use)
    index = nearest.saved(nearest.indexed(use, q), "t")
    got = {}
    for g in nearest.search(index, q, index.where("vec_id % 50 = 0 and vec_id < 1500"), block=10).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    ids = np.array([i for i, v in rows if i is not None and (i < 1500 or i >= 3000)])
    data = np.array([v for i, v in rows if i is not None and (i < 1500 or i >= 3000)], np.float32).astype(float)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hit = 0
    for i in range(0, 1500, 50):
        s = unit @ unit[i]
        s[i] = -2
        best = set(ids[np.lexsort((ids, -s.round(12)))[:5]])
        hit += len(best & {v for _, v, _ in got[i]})
        assert [k for k, _, _ in sorted(got[i])] == [1, 2, 3, 4, 5]
    assert hit >= 0.9 * 5 * 30
    assert [v for _, v, _ in sorted(got[50])] == [3000, 3001, 3002, 3003, 3004]
    assert nearest.op3_nearest.__name__ == "op3_nearest"

def test_nearest_of_repeated_ids_and_mixed_lengths(spark):
    r = np.random.default_rng(4)
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.1]), (50, [1.0, 0.0]), (7, [0.0, 1.0]), (100, [1.0, 2.0, 3.0]), (8, [3.0, 2.0, 1.0]), (150, [5.0])]
    rows += [(k + 1000, [float(v) for v in r.normal(size=2 + k % 2)]) for k in range(1, 49)]
    got = {}
    for g in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0, k=3).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], round(g["score"], 9)))
    want = {}
    for i, (q, v) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((-round(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), 9), c) for j, (c, w) in enumerate(rows) if j != i and len(w) == len(v))
            want.setdefault(q, []).extend((n + 1, c, -s) for n, (s, c) in enumerate(near[:3]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items() if x}
    assert len(got[50]) == 9 and 150 not in got



def corpus(n, seed=0):
    r = np.random.default_rng(seed)
    parts = {"en": ["the", "ing", "tion", "er", "and"], "de": ["sch", "ung", "ich", "ein", "ß"], "fr": ["eau", "que", "é", "oi", "les"]}
    out = []
    for k in range(n):
        lang = ("en", "de", "fr")[k % 3]
        out.append((k, " ".join("".join(r.choice(parts[lang], 2)) for _ in range(int(r.integers(5, 60)))), lang))
    return out


def test_language(spark):
    rows = corpus(300) + [(900, None, "en"), (901, "", "en"), (902, "123 !!", None), (903, "²", "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table, windows=300)
    got = {g["doc_id"]: g for g in language.identify(table, model).collect()}
    held = [k for k, _, _ in rows[:300] if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum(got[k]["lang_pred"] == rows[k][2] for k in held)
    assert right >= 0.95 * len(held) and all(got[k]["lang_pred"] == "und" for k in (900, 901, 902, 903))
    assert all(0 <= g["score"] <= 1 for g in got.values())
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.train(none) is None and language.identify(none, None).first()["lang_pred"] == "und"
    assert language.keep_identified(table).columns == ["doc_id", "text", "lang"]
    text = "é" * 1000
    assert language.windows_of(text).size >= 2000  # the whole text, not a prefix


def test_lm_counts_and_scores(spark):
    rows = [(k, t) for k, t, _ in corpus(120, 3)] + [(500, None), (501, ""), (502, "zzzz qqqq"), (None, "the the"), (503, "The\tTHE")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), hot=20).collect()
    train = Counter()
    split = lambda t: (t or "").encode().lower().split() + [lm.END]
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(split(t))
    n, v = sum(train.values()), len(train)
    text = dict(rows)
    for g in got:
        w = split(text[g["doc_id"]])
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert abs(g["base_score"] - sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        assert g["score"] < 0 and g["held_out"] == (g["doc_id"] is not None and zlib.crc32(str(g["doc_id"]).encode()) % 7 == 2)
    assert len(got) == len(rows)
    per = {g["doc_id"]: g["score"] / g["n_tokens"] for g in got}
    assert per[503] > per[502]  # known words are likelier than unknown ones


def slow_chance(mixer, pairs):
    """One decision's probability of 1, by scalars alone."""
    x = [max(-12.0, min(12.0, math.log((b + 0.2) / (a + 0.2)))) for a, b in pairs] + [0.3]
    top, low = sum(pairs[-1]), sum(pairs[-2])
    g = min(int(math.log2(top + 1)), lm.LEVELS - 1) * lm.LOW_LEVELS + min(int(math.log2(low + 1)) // 3, lm.LOW_LEVELS - 1)
    s = max(-16.0, min(16.0, sum(u * w for u, w in zip(x, mixer.w[g]))))
    where = (max(-lm.SPAN, min(lm.SPAN, s)) + lm.SPAN) / (2 * lm.SPAN) * (lm.CELLS - 1)
    at = min(int(where), lm.CELLS - 2)

    def cell(k):
        z = -lm.SPAN + 2 * lm.SPAN * k / (lm.CELLS - 1)
        return (mixer.hits[1, g, k] + 8 / (1 + math.exp(-z))) / (mixer.hits[0, g, k] + mixer.hits[1, g, k] + 8)

    p = (1 / (1 + math.exp(-s)) + cell(at) * (1 - where + at) + cell(at + 1) * (where - at)) / 2
    return max(1e-7, min(1 - 1e-7, p))


def test_lm_dictionary_against_brute_force(monkeypatch):
    r = np.random.default_rng(3)
    cells = r.integers(0, 30, (9, lm.CLASSES)) * (r.random((9, lm.CLASSES)) < 0.4)
    held = []
    monkeypatch.setattr(lm, "Mixer", lambda real=lm.Mixer: held.append(real()) or held[-1])
    table = lm.dictionary_table(cells)
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-4)  # a distribution in every class
    tree, mixer = lm.Tree(cells.sum(1)), held[0]
    assert (mixer.hits.sum(), len(tree.sons)) == (sum(cells[s].sum() * n for s, n in enumerate(tree.paths()[0])), 8)

    def leaves(node):
        return [node] if node < 9 else [x for son in tree.sons[node - 9] for x in leaves(int(son))]

    for symbol in range(9):
        for k in range(0, lm.CLASSES, 7):
            want, node = 0.0, 9 + len(tree.sons) - 1
            while node >= 9:
                sons = [leaves(int(x)) for x in tree.sons[node - 9]]
                word = [c for c in range(lm.CLASSES) if c // 2 == k // 2]
                flag = [c for c in range(lm.CLASSES) if c % 2 == k % 2]
                pairs = [tuple(float(cells[np.ix_(son, cs)].sum()) for son in sons) for cs in (list(range(lm.CLASSES)), flag, word, [k])]
                p = slow_chance(mixer, pairs)
                bit = int(symbol in sons[1])
                want += math.log10(p if bit else 1 - p)
                node = int(tree.sons[node - 9][bit])
            assert abs(table[k, symbol] - want) < 1e-4


def test_lm_speller_is_a_distribution():
    r = np.random.default_rng(8)
    words = sorted({bytes(r.integers(97, 103, r.integers(1, 9)).astype(np.uint8)) for _ in range(2000)} | {"é日".encode(), b"\0", b"x" * 300})
    owner, keys = lm.grams_of(words)
    slow = []
    for w in words:
        symbols = [0] * 4 + [c + 1 for c in w] + [lm.EOW]
        slow += [sum(s << (9 * (4 - j)) for j, s in enumerate(symbols[k - 4 : k + 1])) for k in range(4, len(symbols))]
    assert keys.tolist() == slow and owner.tolist() == [k for k, w in enumerate(words) for _ in range(len(w) + 1)]
    grams, n = np.unique(keys, return_counts=True)
    speller = lm.Speller(grams, n)
    for context in (0, grams[5] >> 9, (98 << 27) | (99 << 18) | (300 << 9) | 5):
        assert abs((10.0 ** speller._log10((np.int64(context) << 9) | np.arange(lm.EOW + 1))).sum() - 1) < 1e-9
    logs = speller.log10(words)
    assert np.allclose(logs, [speller._log10(lm.grams_of([w])[1]).sum() for w in words])
    assert speller.log10([b"abc"])[0] > speller.log10([b"qzj"])[0]
    assert lm.Speller(grams[:0], n[:0]).log10([b"ab"])[0] < 0


def test_lm_classes():
    # ids: function words below FUNCTION; the token before tells, else the one that told last; a text begins anew
    ids = np.array([40, 2, 50, 51, 3, 3, 60, 60], np.uint16)
    closing = np.zeros(70, bool)
    closing[51] = True
    f = lm.FUNCTION
    assert lm.classes_of(ids, np.array([0, 6]), closing).tolist() == [2 * f + 1, 2 * f, 4, 4, 5, 6, 2 * f + 1, 2 * f]


def test_lm_words_before():
    # back to the last word that is no function word, CHAIN words at most, never beyond the text's beginning
    r = np.random.default_rng(1)
    names = r.choice([0, 1, 2, 40, 41, 1 << 20], 400)
    begins = np.array([0, 1, 2, 50, 300])
    want = []
    for k in range(len(names)):
        own, start = [], begins[begins <= k].max()
        while len(own) < lm.CHAIN and k - len(own) > start and (not own or own[-1] < lm.FUNCTION):
            own.append(int(names[k - len(own) - 1]))
        want.append((tuple(own), len(own) < lm.CHAIN and (not own or own[-1] < lm.FUNCTION)))
    got = lm.chains_of(names, begins).tolist()
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) > 50


def test_lm_words_before_give_a_distribution():
    r = np.random.default_rng(7)
    cells = r.integers(0, 30, (9, lm.CLASSES)).astype(np.float32)
    tree, logits = lm.dictionary_logits(cells)
    context, cls, symbol = (x.ravel() for x in np.meshgrid(np.arange(40), [3, 8, 20], np.arange(9), indexing="ij"))
    n = r.integers(0, 9, len(symbol)) * (r.random(len(symbol)) < 0.3) * (context > 1)
    n[(context == 1) & (cls == 3) & (symbol == 4)] = 1
    gain = lm.sharpened(context, cls, symbol, n, tree.paths(), logits)
    mass = (10.0 ** (lm.table_of(tree, logits)[cls, symbol] + gain)).reshape(40, 3, 9).sum(2)
    assert np.allclose(mass, 1, atol=1e-4)
    assert (gain[context < 2] == 0).all() and np.abs(gain[context > 1]).max() > 0.3  # not met, or once: the class alone tells
    rows = np.zeros(len(symbol), lm.CELL)
    rows["step"], rows["class"], rows["symbol"], rows["n"] = context, cls, symbol, n
    twice = np.concatenate([rows, rows[::-1]])  # two blocks' cells count together
    rows["n"] *= 2
    assert np.array_equal(lm.gains(twice, tree.paths(), logits)[: len(rows)], lm.gains(rows, tree.paths(), logits))
    assert np.array_equal(lm.unpacked(lm.packed(rows), len(rows), lm.CELL), rows)


def test_lm_tells_words_by_the_word_before(spark, monkeypatch):
    # 200 words, each with one successor: in this order they are told by the word before, in another order they aren't
    r = np.random.default_rng(9)
    words, after = ["".join(r.choice(list("abcdefgh"), 6)) for _ in range(200)], r.permutation(200)

    def walk(k):
        out = [k % 200]
        while len(out) < 60:
            out.append(int(r.integers(200)) if r.random() < 0.05 else int(after[out[-1]]))
        return [words[x] for x in out]

    rows = [(k, walk(k)) for k in range(250)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2][:8]
    other = [(1000 + k, list(r.permutation(dict(rows)[i]))) for k, i in enumerate(held)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in rows + other], "doc_id long, text string")
    got = {g["doc_id"]: g["score"] / g["n_tokens"] for g in lm.score(table).collect()}
    assert all(got[i] > got[1000 + k] + 0.8 for k, i in enumerate(held))
    monkeypatch.setattr(lm, "BLOCK", 700)
    many = {g["doc_id"]: g["score"] / g["n_tokens"] for g in lm.score(table).collect()}
    assert many.keys() == got.keys() and all(abs(many[i] - x) < 1e-4 for i, x in got.items())  # the blocks are no part of the model
    monkeypatch.setattr(lm, "SHARD", 2000)
    shards = {g["doc_id"]: g["score"] / g["n_tokens"] for g in lm.score(table).collect()}
    assert shards.keys() == got.keys() and all(shards[i] > shards[1000 + k] + 0.8 for k, i in enumerate(held))


def test_lm_beats_the_base_and_uses_other_words(spark):
    r = np.random.default_rng(2)
    tongues = [["".join(r.choice(list(letters), 4)) for _ in range(150)] for letters in ("abcde", "vwxyz")]
    rows = [(k, " ".join([("the", "der")[k % 2] if j % 4 == 0 else str(r.choice(tongues[k % 2])) for j in range(120)]) + ".") for k in range(300)]
    mixed = [(1000 + k, " ".join(w for pair in zip(rows[k][1].split(), rows[k + 1][1].split()) for w in pair)) for k in range(2)]
    mixed = [(i, t) for i, t in mixed]
    got = lm.score(spark.createDataFrame(rows + [(10**6 + 1, "the " * 40_000)] + mixed, "doc_id long, text string")).collect()
    for held in (True, False):
        part = [g for g in got if g["held_out"] == held and g["doc_id"] < 1000]
        assert sum(g["score"] for g in part) > sum(g["base_score"] for g in part)
    per = {g["doc_id"]: g["score"] / g["n_tokens"] for g in got}
    assert per[1000] < min(per[0], per[1])  # the same words, where others stand before them
    assert {g["doc_id"]: g["n_tokens"] for g in got}[10**6 + 1] == 40_001


def test_lm_words_outside_the_dictionary_use_their_contexts(spark):
    # the dictionary holds the end and two function words alone; all other words are told by the word before them
    r = np.random.default_rng(4)
    tongues = [["".join(r.choice(list("abcdefgh"), 5)) for _ in range(60)] for _ in range(2)]
    rows = [(k, " ".join(f"{('the', 'der')[k % 2]} {r.choice(tongues[k % 2])}" for _ in range(100))) for k in range(200)]
    swap = {"the": "der", "der": "the"}
    swapped = [(1000 + k, " ".join(swap.get(w, w) for w in t.split())) for k, t in rows[:8]]
    table = spark.createDataFrame(rows + swapped, "doc_id long, text string")
    got = {shelf: {g["doc_id"]: g for g in lm.score(table, hot=3, shelf=shelf).collect()} for shelf in (1 << 20, 3000)}
    for per in got.values():
        for k in range(8):
            assert per[1000 + k]["score"] < per[k]["score"] - 15  # of 100 words outside; 0.3 each in log10 tells the two halves apart
    again = {g["doc_id"]: g["score"] for g in lm.score(table.repartition(5), hot=3, shelf=3000).collect()}
    assert all(abs(again[k] - g["score"]) < 1e-6 for k, g in got[3000].items())


def test_lm_tokens():
    texts = pa.array(["  A b\x0bC\x0c\x1cD é X ", None, "", "  \t", "Z", "\0 q\r\nÉA.", "a b "])
    for part in (texts, texts.slice(2, 3), texts.slice(0, 0)):
        words, sizes = lm.tokens_of(part)
        want = [(t or "").encode().lower().split() + [lm.END] for t in part.to_pylist()]
        assert words.to_pylist() == [w for own in want for w in own] and sizes.tolist() == [len(own) for own in want]


def test_lm_tree_against_a_heap():
    r = np.random.default_rng(12)
    for n in (1, 2, 3, 500):
        counts = r.zipf(1.4, n).clip(0, 1000).astype(float)
        heap = sorted((int(c) + 1, k) for k, c in enumerate(counts))
        tree, sons = lm.Tree(counts), []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            sons.append([a[1], b[1]])
            heapq.heappush(heap, (a[0] + b[0], n + len(sons) - 1))
        assert tree.sons.tolist() == sons
        edges = r.random((n - 1, 2, 3))
        size, begin, nodes, bits = tree.paths()
        slow = [sum((edges[nodes[at], bits[at]] for at in range(b, b + m)), np.zeros(3)) for b, m in zip(begin, size)]
        assert np.allclose(tree.down(edges), slow) and tree.up(counts).tolist()[-1] == counts.sum()


def test_lm_leaves_nothing_behind_but_what_is_read_again(spark):
    # what counting words and cells and the shelves need is gone before the shards' shuffles begin
    rows = [(k, t) for k, t, _ in corpus(120, 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = pathlib.Path(shared_dir(spark)) / "quadrille"
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f.getName() for f in map(disk.getAllFiles().apply, range(disk.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    before, words = names(), set(scratch.glob("lm-words-*"))
    scored = lm.score(table, hot=20)
    for _ in range(50):  # files go in the background
        if names() <= before:
            break
        time.sleep(0.1)
    assert names() <= before and set(scratch.glob("lm-words-*")) == words
    assert scored.count() == len(rows)


def test_lm_without_training_rows(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:6]
    texts = ["a b c.", "", "a a a", None, "d", "b c."]
    got = {g["doc_id"]: g for g in lm.score(spark.createDataFrame(list(zip(held, texts)), "doc_id long, text string")).collect()}
    assert len(got) == 6
    for i, t in zip(held, texts):
        g = got[i]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"], g["base_score"]) == (len((t or "").split()) + 1, 0, 0, 0) and -1000 < g["score"] < 0


def test_lm_shelf_is_a_distribution():
    r = np.random.default_rng(6)
    words, n = [b"w%d" % k for k in range(40)], 3000
    code, cls = r.integers(0, 50, n), r.integers(0, lm.CLASSES, n)
    train, times = (code < 40) & (r.random(n) < 0.8), r.integers(1, 4, n)
    names = [words[k] if k < 40 else b"new%d" % k for k in code]
    spelled = lambda ws: np.array([-float(w[3:]) for w in ws])
    c, fresh, logs = lm.shelved(pa.array(names, pa.binary()), cls * 2 + train, times, spelled)
    cells = np.zeros((40, lm.CLASSES))
    np.add.at(cells, (code[train], cls[train]), times[train])
    assert (cells.sum(1) > 0).all() and c.tolist() == [cells[k].sum() if k < 40 else 0 for k in code]
    assert fresh.tolist() == (code >= 40).tolist() and logs[fresh].tolist() == (-code[fresh]).tolist()
    order = sorted(range(40), key=words.__getitem__)
    table = lm.dictionary_table(cells[order])
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-4)
    assert np.allclose(logs[~fresh], [table[u, order.index(k)] for k, u in zip(code[~fresh], cls[~fresh])])
    mixed_up = r.permutation(n)
    assert np.array_equal(lm.shelved(pa.array([names[k] for k in mixed_up], pa.binary()), (cls * 2 + train)[mixed_up], times[mixed_up], spelled)[2], logs[mixed_up])


def test_empty_tables(spark):
    none = docs(spark, [])
    assert sentencepiece.digests(none).count() == 0
    assert lm.score(none).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.usable(empty).count() == 0 and nearest.fitted(nearest.usable(empty)) is None


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, t, lang, f"s{k % 3}", len(t)) for k, t, lang in corpus(90, 5)]
    rows += [(200 + k, rows[k][1], "en", "s0", 1) for k in range(10)] + [(300, "123", "en", "s1", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = lm.saved(stage(spark, d, str(tmp_path)), "t")
        ids = {r["doc_id"] for r in d.select("doc_id").collect()}
        if k < 4:
            assert d.columns == names
        assert before is None or ids <= before
        if k == 1:
            assert not ids & set(range(200, 210)) and 300 not in ids
        before = ids
    assert d.where("not round_trip").count() == 0 and len(before) > 20
