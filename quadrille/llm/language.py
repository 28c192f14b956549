"""Language identification by a byte convolutional network trained and applied in numpy.

Input: the UTF-8 bytes of a text, A-Z lower-cased, cut into windows of WINDOW bytes that cover the whole text (the last one
padded with zeros). Network: byte embedding, filters of several WIDTHS, ReLU, max pooling over the window, softmax. A text's
probabilities are the mean of its windows', weighted by their bytes.

Training reads labelled rows only: at most SAMPLE_WINDOWS windows in all, an equal share per language, of documents drawn by a hash
of doc_id from all rows with a label that are not held out, at places drawn from their whole texts. That bound is
what reaches the driver. Language, source and doc_id are never inputs of a prediction.

Defined cases: null, empty and letterless texts get `und` with score 1; without any labelled row every text gets `und` with
score 0; rows with a null doc_id aren't used for training; repeated rows are predicted alike; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
SAMPLE_WINDOWS, WINDOWS_PER_DOC = 12_000, 3  # windows in all, a window of every language at least; windows of a document
EPOCHS, BATCH, RATE, SEED = 8, 64, 3e-3, 11
MIN_SCORE = 0.3
_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: Column, mod: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 0, F.lit(False))


def windows_of(text: str, width: int = WINDOW) -> np.ndarray:
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    n = max(1, -(-len(raw) // width))
    out = np.zeros(n * width, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, width)


class ByteCNN:
    """A one-layer byte CNN; `labels` gives the classes their names."""

    def __init__(self, labels: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"emb": r.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        self.p["emb"][0] = 0
        for w in WIDTHS:
            self.p[f"f{w}"] = r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.p["bias"] = np.zeros(len(labels), np.float32)

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        n, t, e = x.shape
        return np.lib.stride_tricks.as_strided(x, (n, t - w + 1, w * e), (x.strides[0], x.strides[1], x.strides[2])).reshape(-1, w * e)

    def forward(self, windows: np.ndarray, keep: bool = False):
        x = np.ascontiguousarray(self.p["emb"][windows])
        pooled, kept = [], []
        for w in WIDTHS:
            cols = self._columns(x, w)
            z = (cols @ self.p[f"f{w}"]).reshape(len(windows), -1, FILTERS)
            at = z.argmax(1) if keep else None
            top = np.take_along_axis(z, at[:, None], 1)[:, 0] if keep else z.max(1)
            top = top + self.p[f"b{w}"]
            pooled.append(np.maximum(top, 0))
            kept.append((at, top))
        h = np.concatenate(pooled, 1)
        s = h @ self.p["out"] + self.p["bias"]
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True), (x, h, kept)

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> "ByteCNN":
        r = np.random.default_rng(seed)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), BATCH):
                i = order[at : at + BATCH]
                p, (x, h, kept) = self.forward(windows[i], True)
                d = p
                d[np.arange(len(i)), y[i]] -= 1
                d /= len(i)
                g = {"out": h.T @ d, "bias": d.sum(0)}
                dh = d @ self.p["out"].T
                dx = np.zeros_like(x)
                for k, w in enumerate(WIDTHS):
                    pos, top = kept[k]
                    dz = dh[:, k * FILTERS : (k + 1) * FILTERS] * (top > 0)
                    patch = np.stack([x[np.arange(len(i))[:, None], pos + j] for j in range(w)], 2).reshape(len(i), FILTERS, -1)
                    g[f"f{w}"] = np.einsum("nfc,nf->cf", patch, dz)
                    g[f"b{w}"] = dz.sum(0)
                    back = (dz[:, :, None] * self.p[f"f{w}"].T[None]).reshape(len(i), FILTERS, w, EMBED)
                    for j in range(w):
                        np.add.at(dx, (np.arange(len(i))[:, None], pos + j), back[:, :, j])
                g["emb"] = np.zeros_like(self.p["emb"])
                hit = np.flatnonzero(np.abs(dx).sum(2).ravel())
                np.add.at(g["emb"], windows[i].ravel()[hit], dx.reshape(-1, EMBED)[hit])
                g["emb"][0] = 0
                step += 1
                rate = RATE * (1 - 0.9 * epoch / epochs)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[str], batch: int = 256) -> np.ndarray:
        """Class probabilities of each text."""
        out = np.zeros((len(texts), len(self.labels)))
        parts, owner, weight, held = [], [], [], 0

        def drain():
            nonlocal parts, owner, weight, held
            if parts:
                w, o, b = np.concatenate(parts), np.concatenate(owner), np.concatenate(weight)
                for at in range(0, len(w), batch):
                    p, _ = self.forward(w[at : at + batch])
                    np.add.at(out, o[at : at + batch], p * b[at : at + batch, None])
            parts, owner, weight, held = [], [], [], 0

        for i, t in enumerate(texts):
            w = windows_of(t)
            parts.append(w)
            owner.append(np.full(len(w), i))
            weight.append(np.maximum((w != 0).sum(1), 1).astype(float))
            held += len(w)
            if held >= 8 * batch:
                drain()
        drain()
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


def train(docs: DataFrame, mod: int = 5, windows: int = SAMPLE_WINDOWS, seed: int = SEED) -> ByteCNN | None:
    """A network fitted on a bounded sample of the labelled documents that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = max(1, windows // len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, 1.2 * each / (WINDOWS_PER_DOC * n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.where(draw < F.element_at(share, F.col("lang"))).select("doc_id", "lang", "text")

    def cut(batches):
        for b in batches:
            rows = []
            for i, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
                r = np.random.default_rng(zlib.crc32(f"{seed}|{i}".encode()))
                for _ in range(WINDOWS_PER_DOC):
                    at = int(r.integers(0, max(1, len(raw) - WINDOW + 1)))
                    rows.append((i, lang, raw[at : at + WINDOW].tobytes()))
            yield pa.RecordBatch.from_pydict({k: [x[j] for x in rows] for j, k in enumerate(("doc_id", "lang", "window"))}, schema=pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("window", pa.binary())]))

    got = sorted(map(tuple, drawn.mapInArrow(cut, "doc_id long, lang string, window binary").distinct().collect()))
    labels = sorted(counts)
    r = np.random.default_rng(seed)
    per: dict[str, list[bytes]] = {k: [] for k in labels}
    for j in r.permutation(len(got)):
        if len(per[got[j][1]]) < each:
            per[got[j][1]].append(got[j][2])
    data = [(w.ljust(WINDOW, b"\0"), k) for k, lang in enumerate(labels) for w in per[lang]]
    if not data:
        return None
    x = np.frombuffer(b"".join(w for w, _ in data), np.uint8).reshape(-1, WINDOW)
    return ByteCNN(labels, seed).fit(x, np.array([k for _, k in data]))


def identify(docs: DataFrame, model: ByteCNN | None, pred_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the prediction and its score beside their own columns; columns of docs by these two names give way."""
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c not in (pred_name, score_name)]
    at = docs.columns.index("text")
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(pred_name, T.StringType()), T.StructField(score_name, T.DoubleType())])

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                texts = part.column(at).to_pylist()
                lettered = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
                pred, score = ["und"] * len(texts), [0.0 if model is None else 1.0] * len(texts)
                if model is not None and lettered:
                    probs = model.predict([texts[k] for k in lettered])
                    for k, p in zip(lettered, probs):
                        best = int(p.argmax())
                        pred[k], score[k] = model.labels[best], float(min(1.0, max(0.0, p[best])))
                cols = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, pred_name, score_name])

    return docs.select(*docs.columns).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs whose language the network recognises: not `und`, and with a score of min_score or more."""
    pred, score = fresh(docs, "lang_pred", "score")
    known = identify(docs, train(docs), pred, score).where((F.col(pred) != "und") & (F.col(score) >= min_score))
    return known.select(*docs.columns)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
