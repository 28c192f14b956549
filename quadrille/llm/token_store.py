"""Token-id files coded by a static range asymmetric numeral system (rANS).

Encoding uses the tokenizers library. Its vocabulary's pre-tokens never hold white space, so a text is cut at ASCII white space, a batch's distinct
words are cut into pre-tokens by the tokenizer's own pattern, and each distinct pre-token is encoded by the library once for as long as a worker's
cache holds it; words with characters for which that shortcut isn't provably the same, or with `<|`, are encoded by the library as they stand.

File format, all little-endian. `table.rans`: magic, scale bits, vocabulary size, one frequency per id (they sum to 2**scale bits), crc32; it is shared by all
files. `part-NNNNN.rans`: magic, number of documents and of blocks, doc_ids, ids per document, then blocks. A block codes up to BLOCK ids on its
own: LANES coder states interleave over it, id k going to lane k mod LANES; every CHECKPOINT steps its header keeps the states and the place in the
word stream, with a crc32 of the ids from there to the next checkpoint, so that decoding can start at any checkpoint, in
parallel, and errors are found. Files hold ascending ranges of doc_id, documents in ascending order.

Defined cases: null text counts as empty and has the end id alone; a null doc_id comes last, repeated doc_ids follow each other
(shorter id lists first); an empty table writes the table only and reads back as no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, saved, scratch_path

TOKENIZER, END_ID = "word_bpe_49k.json", 2
SCALE, LANES, BLOCK, CHECKPOINT = 20, 1024, 1 << 20, 256
FILE_IDS = 8 << 20
PART_ROWS, PART_BYTES = 2048, 64 << 20  # of the texts encoded at once
CACHE_WORDS, CACHE_BYTES = 400_000, 8 << 20  # a generation of the cache: entries, and bytes of the words learnt in it
_LOW = np.uint64(1 << 31)
_MAGIC, _TABLE_MAGIC = b"RANSIDS1", b"RANSTAB1"
NO_ID = (1 << 63) - 1

# --- text to ids -----------------------------------------------------------------------------------------------

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_PLAIN = regex.compile(r"[!-/0-9:-@A-Z\[-`a-z{-~À-ÿŒœ]+")
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # the vocabulary file's own split pattern


class WordEncoder:
    """Ids of whole texts by the tokenizers library, with distinct pre-tokens encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        suffix = self.lib.model.end_of_word_suffix
        self.closes = np.zeros(self.lib.get_vocab_size(), bool)  # ids that end a pre-token
        for t, i in self.lib.get_vocab().items():
            self.closes[i] = bool(suffix) and t.endswith(suffix)
        # ids by pre-token, or by word where a word isn't letters and marks alone; two generations: when the younger is full, by
        # entries or by bytes, it becomes the older, so frequent entries stay
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    @classmethod
    @functools.lru_cache(4)
    def load(cls, path: str) -> "WordEncoder":
        return cls(path)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _missing(self, entries) -> set[bytes]:
        """Those of entries whose ids aren't held; ids of the older generation move to the younger."""
        missing = set(entries).difference(self.known)
        moved = {w: self.older[w] for w in missing.intersection(self.older)}
        self.known.update(moved)
        return missing.difference(moved)

    def _ids_of_pretokens(self, pretokens: list[bytes]) -> list[bytes]:
        new = sorted(self._missing(pretokens))
        for at in range(0, len(new), 96):  # the library's time a word grows with the text's length
            chunk = new[at : at + 96]
            e = self.lib.encode_batch_fast([b" ".join(chunk).decode()], add_special_tokens=False)[0]
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(chunk) and ends[-1] == len(ids):
                raw, stops = ids.tobytes(), (4 * ends).tolist()
                self.known.update(zip(chunk, [raw[i:j] for i, j in zip([0, *stops[:-1]], stops)]))
            else:
                self.known.update(zip(chunk, self._whole([p.decode() for p in chunk])))
        self.held += sum(map(len, new))
        return list(map(self.known.__getitem__, pretokens))

    def _ids_of_words(self, words: list[bytes]) -> list[bytes]:
        """Of words of any kind, in lower case (A-Z) but for those with a special token's first characters: these match raw text."""
        cut, other = {}, []
        new = self._missing(words)
        for w in new:
            t = w.decode("utf-8", "replace")
            if _PLAIN.fullmatch(t) and "<|" not in t:
                cut[w] = [p.encode() for p in _PRETOKEN.findall(t.lower())]
            else:
                other.append((w, t))
        pieces = list(set().union(*cut.values()))
        ids = dict(zip(pieces, self._ids_of_pretokens(pieces)))
        self.known.update((w, b"".join([ids[p] for p in of])) for w, of in cut.items())
        self.known.update(zip([w for w, _ in other], self._whole([t for _, t in other])))
        self.held += sum(map(len, new))
        return list(map(self.known.__getitem__, words))

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: strings. The ids of all texts in a row, and the place where each text's end."""
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        raw = pc.any(pc.match_substring(texts, "<|")).as_py()
        split = pc.ascii_split_whitespace(texts.fill_null("") if raw else pc.ascii_lower(texts.fill_null("")))
        words = split.flatten()
        if raw:
            words = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        coded = words.dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        # most words are a run of letters and a run of marks, both maybe empty
        stem = pc.ascii_rtrim(distinct, _MARKS.decode())
        simple = pc.and_(pc.ascii_is_alpha(stem), pc.invert(pc.match_substring(distinct, "<|")))
        stems = stem.filter(simple).dictionary_encode()
        tails = pc.ascii_ltrim(distinct.filter(simple), _LETTERS).dictionary_encode()
        listed = lambda a: a.cast(pa.binary()).to_pylist()
        marks = [t for t in listed(tails.dictionary) if t]
        ids = dict(zip(marks, self._ids_of_pretokens(marks)))
        parts = self._ids_of_pretokens(listed(stems.dictionary))
        n_stems = len(parts)
        parts += [ids.get(t, b"") for t in listed(tails.dictionary)]
        n_tails = len(parts)
        parts += self._ids_of_words(listed(distinct.filter(pc.invert(simple))))
        parts.append(b"")
        is_simple = simple.to_numpy(zero_copy_only=False)
        pair = np.full((len(distinct), 2), len(parts) - 1, np.int64)
        pair[is_simple, 0] = stems.indices.to_numpy()
        pair[is_simple, 1] = tails.indices.to_numpy() + n_stems
        pair[~is_simple, 0] = np.arange(n_tails, len(parts) - 1)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        by_word, ends = _picked(np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size, size, pair.ravel())
        ends = ends[1::2]
        size = np.diff(ends, prepend=0)
        flat, ends = _picked(by_word, ends - size, size, at)
        stops = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        return flat, np.concatenate(([0], ends))[stops]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw = pa.array([(t or "").encode("utf-8", "surrogatepass") for t in texts], pa.binary())
        flat, ends = self.encode_flat(raw.view(pa.string()))
        return [x.tobytes() for x in np.split(flat, ends[:-1])] if len(ends) else []


def _picked(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `pick` of flat, one behind the other, and the place where each ends; run k is flat[begin[k] : begin[k] + size[k]]."""
    sizes = size[pick]
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[pick] - (ends - sizes), sizes)], ends


# --- rANS ------------------------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to sum to 2**scale, at least 1 wherever a count is above 0."""
    total, goal = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.uint32)
    f = np.where(counts > 0, np.maximum(1, np.floor(counts / total * goal)), 0).astype(np.int64)
    off = goal - int(f.sum())
    order = np.argsort(-f, kind="stable")
    while off:
        if off > 0:
            f[order[0]] += off
            off = 0
        else:
            for i in order:
                take = min(-off, int(f[i]) // 2)
                f[i] -= take
                off += take
                if not off:
                    break
    return f.astype(np.uint32)


class Coder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE, lanes: int = LANES, checkpoint: int = CHECKPOINT):
        self.scale, self.lanes, self.checkpoint = scale, lanes, checkpoint
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64) if len(freq) else self.freq
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.limit = self.freq << np.uint64(31 - scale + 32)

    def encode(self, ids: np.ndarray) -> bytes:
        """One block: header, checkpoints, words."""
        n, lanes, k = len(ids), self.lanes, np.uint64(self.scale)
        steps = -(-n // lanes)
        x = np.full(lanes, _LOW, np.uint64)
        words, counts, marks = [], np.zeros(steps, np.int64), []
        for s in range(steps - 1, -1, -1):
            sym = ids[s * lanes : (s + 1) * lanes]
            m = len(sym)
            state, f = x[:m], self.freq[sym]
            full = state >= self.limit[sym]
            if full.any():
                out = state[full]
                words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
                counts[s] = len(out)
                state = np.where(full, state >> np.uint64(32), state)
            q = state // f
            x[:m] = (q << k) + (state - q * f) + self.cum[sym]
            if s % self.checkpoint == 0:
                marks.append((s, x.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        place = np.concatenate(([0], np.cumsum(counts)))
        payload = stream.tobytes()
        head = [struct.pack("<IIIIII", n, lanes, self.checkpoint, len(marks), len(stream), zlib.crc32(payload))]
        span = lanes * self.checkpoint
        for s, states in reversed(marks):
            part = ids[s * lanes : s * lanes + span].astype("<u4").tobytes()
            head.append(struct.pack("<QI", int(place[s]), zlib.crc32(part)) + states.astype("<u8").tobytes())
        return b"".join(head) + payload

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of checkpoints first .. last - 1 of a block (all of them), checked against their checksums."""
        n, lanes, every, marks, words, crc = struct.unpack_from("<IIIIII", block)
        at, size = 24, 12 + 8 * lanes
        body = at + marks * size
        payload = block[body : body + 4 * words]
        if zlib.crc32(payload) != crc:
            raise ValueError("damaged block: its words don't match their checksum")
        stream, k, mask = np.frombuffer(payload, "<u4").astype(np.uint64), np.uint64(self.scale), np.uint64((1 << self.scale) - 1)
        out = []
        for c in range(first, marks if last is None else min(last, marks)):
            place, want = struct.unpack_from("<QI", block, at + c * size)
            x = np.frombuffer(block, "<u8", lanes, at + c * size + 12).astype(np.uint64)
            begin, end = c * every * lanes, min(n, (c + 1) * every * lanes)
            ids = np.empty(end - begin, np.uint32)
            for s in range(0, end - begin, lanes):
                m = min(lanes, end - begin - s)
                state = x[:m]
                slot = state & mask
                sym = self.slots[slot]
                ids[s : s + m] = sym
                state = self.freq[sym] * (state >> k) + slot - self.cum[sym]
                low = np.flatnonzero(state < _LOW)
                if len(low):
                    state[low] = (state[low] << np.uint64(32)) | stream[place : place + len(low)]
                    place += len(low)
                x[:m] = state
            if zlib.crc32(ids.tobytes()) != want:
                raise ValueError("damaged block: ids don't match their checksum")
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def pack_table(freq: np.ndarray, scale: int = SCALE) -> bytes:
    body = struct.pack("<II", scale, len(freq)) + freq.astype("<u4").tobytes()
    return _TABLE_MAGIC + body + struct.pack("<I", zlib.crc32(body))


def unpack_table(raw: bytes) -> tuple[np.ndarray, int]:
    body = raw[8:-4]
    if raw[:8] != _TABLE_MAGIC or zlib.crc32(body) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("not a frequency table, or a damaged one")
    scale, n = struct.unpack_from("<II", body)
    return np.frombuffer(body, "<u4", n, 8).astype(np.uint32), scale


def pack_file(number: int, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, coder: Coder, block: int = BLOCK) -> bytes:
    blocks = [coder.encode(ids[at : at + block]) for at in range(0, len(ids), block)]
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes(), 1)
    head = _MAGIC + struct.pack("<IQQII", number, len(doc_ids), len(ids), len(blocks), len(index)) + index
    return head + b"".join(struct.pack("<II", len(b), zlib.crc32(head)) + b for b in blocks)


def unpack_file(raw: bytes, coder: Coder) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(file number, doc_ids, ids per document, all ids)."""
    if raw[:8] != _MAGIC:
        raise ValueError("not a token-id file")
    number, docs, total, blocks, size = struct.unpack_from("<IQQII", raw, 8)
    at = 8 + struct.calcsize("<IQQII")
    index = np.frombuffer(zlib.decompress(raw[at : at + size]), "<i8")
    at += size
    head = zlib.crc32(raw[:at])
    parts = []
    for _ in range(blocks):
        n, crc = struct.unpack_from("<II", raw, at)
        if crc != head:
            raise ValueError("damaged file: its head doesn't match the blocks")
        parts.append(coder.decode(raw[at + 8 : at + 8 + n]))
        at += 8 + n
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(ids) != total:
        raise ValueError("damaged file: ids are missing")
    return number, index[:docs], index[docs:], ids


# --- DataFrames ------------------------------------------------------------------------------------------------


def _put(uri: str, name: str, raw: bytes) -> None:
    """Writes a file under a temporary name and moves it into place, so that repeated tasks are harmless."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(raw)
    store.move(part, f"{path}/{name}")


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, ids): per document its ids with end_id behind them, as little-endian bytes; and per task rows (null, id, count)."""

    def run(batches):
        enc = WordEncoder.load(path)
        size = max(enc.lib.get_vocab_size(), end_id + 1)
        kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        counts = np.zeros(size, np.int64)
        for b in batches:
            rows = max(1, min(PART_ROWS, PART_BYTES * b.num_rows // max(1, b.nbytes)))
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                flat, ends = enc.encode_flat(part.column(1))
                counts += np.bincount(flat, minlength=size)
                counts[end_id] += len(ends)
                n = np.diff(ends, prepend=0) + 1
                raw = np.insert(flat.astype(kind), ends, end_id)
                stops = np.concatenate(([0], np.cumsum(n))) * kind.itemsize
                ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).fill_null(NO_ID), pa.array(n), ids, pa.nulls(len(n), pa.int64())], names=["doc_id", "n", "ids", "id"])
        seen = np.flatnonzero(counts)
        none = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(counts[seen]), pa.nulls(len(seen), pa.binary()), pa.array(seen)], names=["doc_id", "n", "ids", "id"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary, id long")


def write_store(docs: DataFrame, uri: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> int:
    """Encodes docs and writes table.rans and the data files under uri. Returns the number of ids."""
    coded = saved(tokenized(docs, tokenizer, end_id), "token-ids")
    rows = coded.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many as the vocabulary has ids
    size = max([end_id, *(r["id"] for r in rows)]) + 1
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    freq = frequencies(counts)
    total = int(counts.sum())
    _put(uri, "table.rans", pack_table(freq))
    if not rows:
        return 0
    shared = docs.sparkSession.sparkContext.broadcast(freq)  # bounded by the vocabulary
    files = max(1, -(-total // file_ids))
    ordered = coded.where("id is null").select("doc_id", "n", "ids").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "n", "ids")

    def run(batches):
        from pyspark import TaskContext

        number, doc_ids, lengths, ids = TaskContext.get().partitionId(), [], [], []
        for b in batches:
            n, raw = b.column(1).to_numpy(), b.column(2)
            doc_ids.append(b.column(0).to_numpy())
            lengths.append(n)
            for x in raw:
                v = x.as_buffer()
                ids.append((len(v), v.to_pybytes()))
        if doc_ids:
            lengths, doc_ids = np.concatenate(lengths), np.concatenate(doc_ids)
            kind = np.dtype("<u2") if sum(s for s, _ in ids) == 2 * int(lengths.sum()) else np.dtype("<u4")
            flat = np.frombuffer(b"".join(v for _, v in ids), kind)
            raw = pack_file(number, doc_ids, lengths, flat, Coder(shared.value))
            _put(uri, f"part-{number:05d}.rans", raw)
            yield pa.RecordBatch.from_pydict({"file": [number], "bytes": [len(raw)]}, schema=pa.schema([("file", pa.int64()), ("bytes", pa.int64())]))

    ordered.mapInArrow(run, "file long, bytes long").agg(F.sum("bytes")).collect()
    forget(coded)
    return total


def read_store(spark: SparkSession, uri: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 [, ids]) of every document in the files under uri, decoded and checked there."""
    table = spark.read.format("binaryFile").load(f"{uri}/table.rans").first()["content"]
    freq, scale = unpack_table(bytes(table))
    shared = spark.sparkContext.broadcast((freq, scale))  # bounded by the vocabulary
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.rans").load(uri).select("content")
    names = ["file", "doc_id", "before", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "file long, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        coder = Coder(*shared.value)
        for b in batches:
            for k in range(b.num_rows):
                number, doc_ids, lengths, ids = unpack_file(b.column(0)[k].as_buffer().to_pybytes(), coder)
                ends = np.cumsum(lengths)
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip((ends - lengths).tolist(), ends.tolist())]
                for at in range(0, len(doc_ids), 4096):
                    z = slice(at, at + 4096)
                    m = len(doc_ids[z])
                    none = doc_ids[z] == NO_ID
                    cols = [pa.array(np.full(m, number)), pa.array(doc_ids[z], mask=none), pa.array((ends - lengths)[z]), pa.array(lengths[z]), pa.array(crc[z], pa.int64())]
                    if with_ids:
                        edge = np.concatenate(([0], np.cumsum(lengths[z]))).astype(np.int32)
                        first = int((ends - lengths)[at])
                        cols.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(ids[first : first + int(edge[-1])].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = saved(files.mapInArrow(run, schema), "token-rows")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("t")).orderBy("file").collect()  # one row per file
    acc, starts = 0, []
    for r in totals:
        starts.append((r["file"], acc))
        acc += r["t"]
    starts = spark.createDataFrame(starts, "file long, file_start long")
    out = rows.join(F.broadcast(starts), "file").withColumn("start", F.col("before") + F.col("file_start"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), uri, tokenizer_path())
    return read_store(spark, uri, with_ids=False)
