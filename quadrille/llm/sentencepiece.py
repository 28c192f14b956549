"""SentencePiece encoding and decoding by a shared-prefix forward pass over distinct words.

A text is cut into marked words (a run of spaces and what follows); no piece of the vocabulary reaches across such a cut. The
distinct words of a batch are sorted, which is the depth-first order of their trie: a word keeps the forward table of the
prefix it shares with the word before and fills in the rest only.

Forward table, per prefix of a word: the last piece of the best segmentation of that prefix. In a unigram model "best" is the largest sum
of scores (Viterbi). In a BPE model the sum of scores does not give the model's own result; there the survivor is the one
piece that can stand after the survivor of what is left of it, i.e. a pair that no earlier merge would have broken up.
Ids are those of the model's own library; see the tests. Characters outside the vocabulary become byte pieces.

Defined cases: null counts as empty and has no ids; U+2581 counts as a space, as the model has it; other characters,
line breaks included, survive the round trip; a model without byte pieces gives its unknown id. Repeated rows are encoded alike; an empty
table gives no rows; extra columns are kept by encode() and decode().
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
CACHE_WORDS, CACHE_PAIRS = 200_000, 1 << 18  # a worker keeps these from task to task
SLICE_ROWS, SLICE_SIZE = 2048, 1 << 19  # of a batch at a time: rows, and bytes of text or ids
MODEL = "piece_bpe_32k.model"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


class Pieces:
    """A vocabulary, its trie and the forward pass over sorted words."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int):
        self.kind = kind
        self.text = [p for p, _, _ in pieces]
        self.score = [s for _, s, _ in pieces]
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == _UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == _BYTE}
        self.vocab = {p: i for i, (p, _, t) in enumerate(pieces) if t in (_NORMAL, _USER)}
        order = {s: r for r, s in enumerate(sorted({s for _, s, _ in pieces}, reverse=True))}
        self.rank = [order[s] for s in self.score]
        self.raw = [self._decoded(i, t) for i, (_, _, t) in enumerate(pieces)]
        multi = {c for p in self.vocab if len(p) > 1 for c in p}
        self.cut_lines = "\n" not in multi
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        usable = self.vocab if kind == UNIGRAM else self._reachable()
        self.trie: dict = {}
        for p, i in usable.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    @functools.lru_cache(4)
    def load(cls, path: str) -> "Pieces":
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        return cls([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type)

    def _decoded(self, i: int, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(self.text[i][3:5], 16)])
        return b"" if kind == _CONTROL else self.text[i].replace(MARK, " ").encode()

    def merge(self, text: str) -> tuple[list[int], dict[int, tuple[int, int]]]:
        """Greedy merging by score, leftmost first, and the last merge that made each piece met on the way."""
        parts, made = list(text), {}
        while len(parts) > 1:
            best = min(((self.rank[self.vocab[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.vocab), default=None)
            if best is None:
                break
            k = best[1]
            a, b = parts[k], parts[k + 1]
            made[self.vocab[a + b]] = (self.vocab.get(a, -1), self.vocab.get(b, -1))
            parts[k : k + 2] = [a + b]
        return parts, made

    def _reachable(self) -> dict[str, int]:
        out = {}
        for p, i in self.vocab.items():
            if len(p) > 1:
                parts, made = self.merge(p)
                if len(parts) > 1:
                    continue
                self.split[i] = made[i]
            out[p] = i
        return out

    def stands(self, a: int, b: int) -> bool:
        """Whether pieces a, b beside each other are what merging their text gives.

        Walks both pieces back, the later merge first: at each moment the two parts at the seam must not have had a merge that came before
        the one just undone (on equal ranks the left one comes first).
        """
        key = (a << 20) | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        text, rank, split, left, right = self.text, self.rank, self.split, a, b
        bound = float("inf")
        while True:
            both = self.vocab.get(text[left] + text[right])
            if both is not None and rank[both] < bound:
                ok = False
                break
            in_left, in_right = split.get(left), split.get(right)
            if in_left is None and in_right is None:
                ok = True
                break
            if in_right is None or (in_left is not None and rank[left] > rank[right]):
                bound, left = rank[left], in_left[1]
            else:
                bound, right = rank[right] + 0.5, in_right[0]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each of the sorted distinct words; a space at the front of a word is its mark."""
        trie, unigram, score, out = self.trie, self.kind == UNIGRAM, self.score, []
        before, last, best, begun = "", [-1], [0.0], [[]]
        # per prefix length n: last[n] (id, or -2 - code point outside the vocabulary), best[n] (its score sum), begun[n] (open trie nodes)
        for raw in words:
            word = raw.replace(" ", MARK)
            n = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                n += 1
            del last[n + 1 :], best[n + 1 :], begun[n + 1 :]
            for at in range(n, len(word)):
                c, alive, found = word[at], [], []
                for start, node in begun[at]:
                    node = node.get(c)
                    if node is not None:
                        alive.append((start, node))
                        i = node.get("")
                        if i is not None:
                            found.append((start, i))
                node = trie.get(c)
                if node is not None:
                    alive.append((at, node))
                    i = node.get("")
                    if i is not None:
                        found.append((at, i))
                begun.append(alive)
                if not found:
                    last.append(-2 - ord(c))
                    best.append(best[at] - 1e4)
                elif unigram:
                    s, i = max(((best[start] + score[i], i) for start, i in found), key=lambda x: x[0])
                    last.append(i)
                    best.append(s)
                else:
                    for start, i in found:
                        p = last[start]
                        if p < 0 or self.stands(p, i):
                            last.append(i)
                            break
                    else:
                        last.append(self.vocab[c])
                    best.append(0.0)
            before, ids, k = word, [], len(word)
            while k:
                i = last[k]
                if i >= 0:
                    ids.append(i)
                    k -= len(self.text[i])
                else:
                    raw_char = chr(-2 - i).encode("utf-8", "surrogatepass")
                    ids.extend([self.bytes[x] for x in reversed(raw_char)] if self.bytes else [self.unknown])
                    k -= 1
            out.append(np.array(ids[::-1], "<u4").tobytes())
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text, as little-endian unsigned 32-bit integers."""
        cut = re.compile(r" +[^ \n]*|\n|[^ \n]+" if self.cut_lines else r" +[^ ]*")
        split = [cut.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new = set().union(*split)
        if len(self.words) + len(new - self.words.keys()) > CACHE_WORDS // 2:  # words in use come back from the older half
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        fresh = []
        for w in new - words.keys():
            if w in older:
                words[w] = older[w]
            else:
                fresh.append(w)
        fresh.sort()
        for w, ids in zip(fresh, self.encode_words(fresh)):
            words[w] = ids
        get = words.__getitem__
        return [b"".join(map(get, units)) for units in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the space that encoding puts in front."""
        out = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _with_column(b: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [k for k in range(b.num_columns) if b.schema.names[k] != name]
    return pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), values], names=[*(b.schema.names[k] for k in keep), name])


def _slices(batches, column: str):
    """The batches in slices, so that what is made of a slice stays small however long its texts are; a longer text is a slice of its own."""
    for b in batches:
        c = b.column(b.schema.get_field_index(column))
        n = pc.list_value_length(c) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else pc.binary_length(c)
        ends = np.cumsum(n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_SIZE, "right"))
            to = min(at + SLICE_ROWS, max(at + 1, fit))
            yield b.slice(at, to - at)
            at = to


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with `ids`, an array of piece ids of the whole text."""
    path = model_path(model)

    def run(batches):
        sp = Pieces.load(path)
        for b in _slices(batches, "text"):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in sp.encode(b.column(b.schema.get_field_index("text")).to_pylist())]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield _with_column(b, "ids", values)

    return docs.mapInArrow(run, _added(docs, "ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded with `decoded`, the text of its `ids` (null: empty)."""
    path = model_path(model)

    def run(batches):
        sp = Pieces.load(path)
        for b in _slices(batches, "ids"):
            ids = b.column(b.schema.get_field_index("ids"))
            texts = [sp.decode(np.asarray(x.values)).decode("utf-8", "replace") if x.is_valid else "" for x in ids]
            yield _with_column(b, "decoded", pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, _added(encoded, "decoded", T.StringType()))


def digests(docs: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit), n_bytes and
    text_crc32 of the decoded text, round_trip (it equals the text, spaces for U+2581); the ids too where asked for."""
    path = model_path(model)
    names = ["doc_id", "n_pieces", "ids_crc32", "n_bytes", "text_crc32", "round_trip"] + ["ids"] * with_ids

    def run(batches):
        sp = Pieces.load(path)
        for b in _slices(batches, "text"):
            texts = b.column(1).to_pylist()
            cols: list[list] = [[] for _ in names[1:6]]
            coded = sp.encode(texts)
            for t, x in zip(texts, coded):
                back = sp.decode(np.frombuffer(x, "<u4"))
                same = back == (t or "").replace(MARK, " ").encode("utf-8", "surrogatepass")
                for c, v in zip(cols, (len(x) // 4, zlib.crc32(x), len(back), zlib.crc32(back), same)):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            arrays = [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            if with_ids:
                flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded]))).astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, text_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
