"""Language-model scoring by online logistic context mixing.

The model gives a probability to a text's tokens: words, lower-cased in A-Z, and one end of text. Every token is a row of binary decisions:
* Dictionary: the path of the word, or of an escape, in a Huffman tree over the HOT most frequent training words. The context
  crosses words: the last of the FUNCTION most frequent words before the token (it tells language and style) and whether the
  token before closed a sentence. Predictors count each decision under no context, under either and under both.
* Novelty: an escaped word is one of training or new.
* Shelves: all training words outside the dictionary, however many and however rare, stand on shelves by a hash; the shelf is the path in a
  tree over shelves, the word the path in its shelf's tree, under the same contexts, predictors and mixing as the dictionary's.
* Words before: the decisions of the dictionary's path are mixed a second time, with a predictor that counts them under the words before
  the token, back to the last that is no function word: the word before, or after function words two or three. Any word counts
  as a context, in the dictionary or not; a context speaks from its second occurrence on.
* Spelling: a new word is spelled byte by byte, each byte by its path in a Huffman tree over bytes; predictors count each decision under the
  last 1 to 4 bytes, learnt from the kinds of rare words, not from their occurrences, as a new word is the next of these.
The predictors' logits are mixed by weights that a gate selects (how much the two sharpest contexts have seen); the weights
learn online from the coding error, and an adaptive map refines the mixed probability. One occurrence is left out of the counts
while weights are learnt, as an online coder would have it. All contexts of a decision make 64-bit hash keys or direct indices, without collisions that matter.

What is gathered grows with the corpus: the counts of all words under all contexts, held a shelf at a time by the tasks and never whole, and
the strings of up to five bytes that occur. Counts under the words before are held by shards of contexts: blocks of texts send them their distinct
cells and get back, for each, what these contexts add to its log10 probability. Counts of the dictionary's contexts are a table of at most CLASSES * HOT cells in the driver, those of the
shelves one of CLASSES for each SHELF occurrences of escaped words. As a decision depends on its
context and its counts alone, the mixer runs over distinct (context, decision) cells weighted by their counts, so its cost doesn't grow
with repetition; a text is scored by adding up cells.

Defined cases: null text counts as empty: one end token; rows with a null doc_id are training rows; without training rows N = V = 0
and base_score is 0; repeated rows count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, saved
from .shingles import mix64

HOT = (1 << 16) - 8  # words of the dictionary: ids fit 16 bits
LEAST = 8  # occurrences of a word of the dictionary: rarer ones tell what escaped and new words are like, however small the corpus
SHELF = 1 << 16  # occurrences of escaped words for each shelf
FUNCTION = 31
CLASSES = 2 * (FUNCTION + 1)
FLUSH_BYTES = 48 << 20  # of tokens that are counted at once
END = b"\n"  # the end of text as a word: no word holds white space
MARKS = b".!?"  # at a word's end they close a sentence
ORDERS = (1, 2, 3, 4)  # bytes of context within the word
EOW = 257  # symbols of a spelled word: 0 before its begin, byte + 1, its end
LEVELS, LOW_LEVELS = 14, 4
GATES = LEVELS * LOW_LEVELS
CONTEXTS = 4
INPUTS = CONTEXTS + 1
BATCH, PRIOR = 16_384, 4.0
CHAIN = 3  # words before a token that are its context, at most
BLOCK = 1 << 20  # tokens of a block of texts
SHARD = 1 << 20  # tokens for each shard of contexts
SPEAK = 2  # occurrences from which on a context of words before speaks
REST_BITS = 23  # of a cell's key, for class and symbol, behind its context's 41
STUDY = 20_000  # grams whose decisions stand in memory at once
CELLS, SPAN = 33, 8.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# --- binary decisions ------------------------------------------------------------------------------------------


class Tree:
    """Huffman tree over symbols. Nodes are numbered leaves first, then inner nodes in the order of their making, the root last."""

    def __init__(self, counts: np.ndarray):
        self.leaves = n = len(counts)
        weight = np.asarray(counts).astype(np.int64) + 1
        order = np.argsort(weight, kind="stable")
        leaf, ids = [*weight[order].tolist(), np.inf], order.tolist()
        inner, sons = [np.inf] * max(1, n), []  # inner nodes come in the order of their weights: the lightest is the first of either row
        i = j = 0
        for k in range(n - 1):
            total = 0
            for _ in (0, 1):
                if leaf[i] <= inner[j]:
                    total += leaf[i]
                    sons.append(ids[i])
                    i += 1
                else:
                    total += inner[j]
                    sons.append(n + j)
                    j += 1
            inner[k] = total
        self.sons = np.array(sons, np.int64).reshape(-1, 2)  # of inner node n + i, by the bit
        self.levels, level = [], np.arange(max(0, n - 1))[-1:]  # inner nodes by depth
        while len(level):
            self.levels.append(level)
            level = self.sons[level].ravel()
            level = level[level >= n] - n

    def up(self, leaf_values: np.ndarray) -> np.ndarray:
        """Sums of the leaves (first axis) under every node."""
        out = np.zeros((self.leaves + len(self.sons), *leaf_values.shape[1:]), leaf_values.dtype)
        out[: self.leaves] = leaf_values
        for level in reversed(self.levels):
            a, b = self.sons[level].T
            out[self.leaves + level] = out[a] + out[b]
        return out

    def down(self, edge_values: np.ndarray) -> np.ndarray:
        """Sums of edge values (inner node, bit, ...) on the way from the root to every leaf."""
        out = np.zeros((self.leaves + len(self.sons), *edge_values.shape[2:]), edge_values.dtype)
        for level in self.levels:
            for bit in (0, 1):
                out[self.sons[level, bit]] = out[self.leaves + level] + edge_values[level, bit]
        return out[: self.leaves]

    def paths(self):
        """Per leaf: number of decisions, where they begin, and all inner nodes and bits, root first."""
        steps: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves + len(self.sons))]
        for i in range(len(self.sons) - 1, -1, -1):
            for bit in (0, 1):
                steps[self.sons[i, bit]] = [*steps[self.leaves + i], (i, bit)]
        size = np.array([len(s) for s in steps[: self.leaves]])
        flat = [x for s in steps[: self.leaves] for x in s]
        return size, np.cumsum(size) - size, np.array([x for x, _ in flat], np.int64), np.array([b for _, b in flat], np.int8)


# --- mixing ----------------------------------------------------------------------------------------------------


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.2) / (n0 + 0.2)).clip(-12, 12)


def gate_of(sharpest: np.ndarray, next_one: np.ndarray) -> np.ndarray:
    level, low = (np.frexp(n + 1)[1].astype(np.int64) - 1 for n in (sharpest, next_one))  # whole part of log2
    return np.minimum(level, LEVELS - 1) * LOW_LEVELS + np.minimum(low // 3, LOW_LEVELS - 1)


class Mixer:
    """Gated weights over the predictors' logits, learnt online with second-order steps, and the adaptive map behind them.

    counts everywhere: per context, from the broadest to the sharpest, the pair of counts of 0 and of 1."""

    def __init__(self, inputs: int = INPUTS):
        self.w = np.zeros((GATES, inputs))
        self.known = np.tile(np.eye(inputs) * PRIOR, (GATES, 1, 1))  # information gathered per gate
        self.hits = np.zeros((2, GATES, CELLS))  # the map's decisions that were 0 and 1, by gate and cell
        self.begin()

    def begin(self) -> None:
        self.w[:, CONTEXTS - 1], self.w[: 2 * LOW_LEVELS, CONTEXTS - 1] = 0.8, 0.2
        self.w[:, CONTEXTS - 2], self.w[: 2 * LOW_LEVELS, CONTEXTS - 2] = 0.2, 0.5
        self.w[: 2 * LOW_LEVELS, CONTEXTS - 3] = 0.3

    def inputs(self, counts):
        x = np.stack([_stretch(a, b) for a, b in counts] + [np.full(len(counts[0][0]), 0.3)], 1)
        return x, gate_of(counts[-1][0] + counts[-1][1], counts[-2][0] + counts[-2][1])

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.einsum("nk,nk->n", x, self.w[gate]).clip(-16, 16)

    def study(self, counts, bit: np.ndarray, weight: np.ndarray) -> None:
        """Learns from decisions that occurred `weight` times, each with one occurrence of itself left out of the counts."""
        own = [(np.maximum(a - (bit == 0), 0), np.maximum(b - (bit == 1), 0)) for a, b in counts]
        x, gate = self.inputs(own)
        self.learn(x, gate, bit, weight)

    def learn(self, x, gate, bit, weight) -> None:
        """One online pass. Per batch: predict, note the outcome in the map, then move each gate's weights by its information."""
        for at in range(0, len(bit), BATCH):
            z = slice(at, at + BATCH)
            order = np.argsort(gate[z].astype(np.uint8), kind="stable")
            g, u, y, m = gate[z][order], x[z][order], bit[z][order], weight[z][order]
            s = self.mixed(u, g)
            cell = g * CELLS + np.rint((s.clip(-SPAN, SPAN) + SPAN) / (2 * SPAN) * (CELLS - 1)).astype(np.int64)
            for b in (0, 1):
                self.hits[b] += np.bincount(cell[y == b], m[y == b], GATES * CELLS).reshape(GATES, CELLS)
            p = 1 / (1 + np.exp(-s))
            slope, pull = (m * np.maximum(p * (1 - p), 1e-4))[:, None] * u, (y - p) * m
            edges = np.searchsorted(g, np.arange(GATES + 1))
            met, pulls = np.flatnonzero(np.diff(edges)), []
            for k in met.tolist():
                r = slice(edges[k], edges[k + 1])
                self.known[k] += u[r].T @ slope[r]
                pulls.append(u[r].T @ pull[r])
            self.w[met] += np.linalg.solve(self.known[met], np.array(pulls)[:, :, None])[:, :, 0].clip(-0.5, 0.5)

    def chance(self, counts) -> np.ndarray:
        """The refined probability that a bit is 1."""
        x, gate = self.inputs(counts)
        s = self.mixed(x, gate)
        where = (s.clip(-SPAN, SPAN) + SPAN) / (2 * SPAN) * (CELLS - 1)
        low = np.minimum(where.astype(np.int64), CELLS - 2)
        share = where - low
        centre = 1 / (1 + np.exp(-np.linspace(-SPAN, SPAN, CELLS)))
        prior = 8.0
        refined = (self.hits[1] + prior * centre) / (self.hits[0] + self.hits[1] + prior)
        p = (1 / (1 + np.exp(-s)) + refined[gate, low] * (1 - share) + refined[gate, low + 1] * share) / 2
        return p.clip(1e-7, 1 - 1e-7)


# --- the dictionary --------------------------------------------------------------------------------------------


def dictionary_table(cells: np.ndarray, chunk: int = 1024, wanted: np.ndarray | None = None) -> np.ndarray:
    """cells: (symbols, CLASSES) training counts: of dictionary words and, last, the escape; of shelves; of a shelf's words.

    Returns their log10 probabilities by class; where wanted (symbols, CLASSES) is given, only its cells are right, others aren't worked out."""
    return table_of(*dictionary_logits(cells, chunk, wanted))


def table_of(tree: Tree, logits: np.ndarray) -> np.ndarray:
    edges = np.stack([np.logaddexp(0, logits), np.logaddexp(0, -logits)], 1)
    edges *= np.float32(-np.log10(np.e))
    return np.ascontiguousarray(tree.down(edges).T)


def dictionary_logits(cells: np.ndarray, chunk: int = 1024, wanted: np.ndarray | None = None) -> tuple[Tree, np.ndarray]:
    """The tree over the symbols, and per inner node and class the logit of the bit being 1."""
    tree = Tree(cells.sum(1, dtype=np.float64))
    per = tree.up(cells.astype(np.float32, copy=False))
    mixer, logits = Mixer(), np.zeros((len(tree.sons), CLASSES), np.float32)

    def contexts(nodes: np.ndarray):
        """Sums of the nodes' sons, by bit: of all classes, by whether a sentence closed, by function word, by class."""
        out = []
        for b in (0, 1):
            n = per[tree.sons[nodes, b]].astype(np.float64)
            open_, closed = n[:, ::2], n[:, 1::2]
            flag = np.stack([open_.sum(1), closed.sum(1)], 1)
            out.append((flag.sum(1), flag, open_ + closed, n))
        return out

    def at_cells(sums, here: np.ndarray):
        node, cls = here // CLASSES, here % CLASSES
        return [tuple(s[k][where] for s in sums) for k, where in enumerate((node, (node, cls % 2), (node, cls // 2), (node, cls)))]

    mixed_up = np.random.default_rng(11).permutation(len(tree.sons))
    for at in range(0, len(mixed_up), chunk):
        sums = contexts(mixed_up[at : at + chunk])
        for bit in (0, 1):
            counts = at_cells(sums, np.flatnonzero(sums[bit][3]))
            mixer.study(counts, np.full(len(counts[-1][bit]), bit, np.int8), counts[-1][bit])
    passed = None if wanted is None else tree.up(wanted)[tree.leaves :]  # adding booleans: any wanted cell below
    for at in range(0, len(tree.sons), chunk):
        nodes = np.arange(at, min(at + chunk, len(tree.sons)))
        here = np.arange(len(nodes) * CLASSES) if passed is None else np.flatnonzero(passed[nodes])
        p = mixer.chance(at_cells(contexts(nodes), here))
        logits[at : at + chunk].reshape(-1)[here] = np.log(p / (1 - p))
    return tree, logits


def classes_of(ids: np.ndarray, begins: np.ndarray, closing: np.ndarray) -> np.ndarray:
    """Class of every token: ids of tokens of texts on end, which begin at `begins`; closing: per id, whether it closes a sentence."""
    n = len(ids)
    at, first = np.arange(n), np.zeros(n, bool)
    first[begins] = True
    shown = np.concatenate(([False], ids[:-1] < FUNCTION))  # the token before is a function word
    last = np.maximum.accumulate(np.where(shown | first, at, 0))
    word = np.where(first[last] | (last == 0), FUNCTION, ids[np.maximum(last - 1, 0)].astype(np.int64))
    closed = np.concatenate(([True], closing[ids[:-1]])) | first
    return word * 2 + closed


# --- words before ----------------------------------------------------------------------------------------------


def chains_of(names: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Per token, a hash of the words before it: back to the last that is no function word, CHAIN words at most.

    names: a number per token's word, below FUNCTION for function words; a text begins after nothing."""
    n = len(names)
    pos = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    own = mix64((names + 1).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    whole, goes_on = np.zeros(n, np.uint64), np.ones(n, bool)
    for back in range(1, CHAIN + 1):
        here = goes_on & (pos >= back)
        whole += np.where(here, np.roll(own, back), np.uint64(back)) * goes_on * np.uint64(pow(0xD6E8FEB86659FD93, back, 1 << 64))
        goes_on = here & (np.roll(names, back) < FUNCTION)
    return mix64(whole)


REST = np.dtype([("next", "u1"), ("row", "<u4"), ("under", "u1"), ("times", "<u4")])  # next: whether the row is of the next word
CELL = np.dtype([("step", "<u8"), ("class", "u1"), ("symbol", "<u4"), ("n", "<u4")])


def packed(rows: np.ndarray) -> bytes:
    """Rows of fixed width by bytes' places, which compresses well."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T), asbytes=True)


def unpacked(blob: bytes, n: int, kind: np.dtype) -> np.ndarray:
    flat = np.frombuffer(pa.Codec("zstd").decompress(blob, n * kind.itemsize, asbytes=True), np.uint8)
    return np.array(flat.reshape(kind.itemsize, n).T, order="C").view(kind).ravel()  # a copy, of a single row too


def short(x: np.ndarray) -> np.ndarray:
    """Rounded to 16 bits of mantissa, which packs better."""
    return ((x.astype("<f4").view("<u4") + np.uint32(1 << 7)) & np.uint32(0xFFFFFF00)).view("<f4")


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.append(np.ones(len(ordered[:1]), bool), ordered[1:] != ordered[:-1])]


class Block:
    """Texts on end: their tokens' classes and symbols, and their distinct cells (contexts of words before, class, symbol), ordered by context."""

    def __init__(self, ids: np.ndarray, tail: np.ndarray, sizes: np.ndarray, closing: np.ndarray):
        other = len(closing) - 2
        self.begins = np.cumsum(sizes) - sizes
        self.classes, self.symbols = classes_of(ids, self.begins, closing), np.minimum(ids, other).astype(np.int64)
        names = ids.astype(np.int64)
        names[ids >= other] = tail.astype(np.int64) + (1 << 16)  # words outside the dictionary go by their hash
        key = chains_of(names, self.begins) >> np.uint64(REST_BITS) << np.uint64(REST_BITS)
        self.key = key | (self.classes << 17 | self.symbols).astype(np.uint64)  # of each token
        self.keys = _distinct(np.sort(self.key))

    def by_shard(self, shards: int) -> np.ndarray:
        """Where each shard's cells begin and end: contexts go to shards by ranges of their hash."""
        bits = min(64 - REST_BITS, 32)
        shard = ((self.keys >> np.uint64(64 - bits)) * np.uint64(shards)) >> np.uint64(bits)
        return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))

    def rows(self, counted: np.ndarray) -> np.ndarray:
        """The cells' rows; counted: whether each token is in the counts. A cell's step is its context's."""
        out, rest = np.zeros(len(self.keys), CELL), self.keys & np.uint64((1 << REST_BITS) - 1)
        out["step"], out["class"], out["symbol"] = self.keys >> np.uint64(REST_BITS), rest >> np.uint64(17), rest & np.uint64((1 << 17) - 1)
        met = np.sort(self.key[counted])
        own = _distinct(met)
        out["n"][np.searchsorted(self.keys, own)] = np.diff(np.searchsorted(met, own), append=len(met))
        return out

    def by_token(self, values: np.ndarray) -> np.ndarray:
        """Each token's, of values of the cells."""
        order = np.argsort(self.key)
        met, out = self.key[order], np.empty(len(order), values.dtype)
        out[order] = np.repeat(values, np.diff(np.searchsorted(met, self.keys), append=len(met)))
        return out


class Sharpener(Mixer):
    """Mixes a decision's logit by class with its counts under the words before.

    counts: the class's logit, then the pair of counts."""

    def __init__(self):
        super().__init__(3)

    def begin(self) -> None:
        self.w[:, 0], self.w[:, 1] = 0.7, 0.3

    def inputs(self, counts):
        z, (n0, n1) = counts
        x = np.empty((len(z), 3), np.float32)
        x[:, 0], x[:, 1], x[:, 2] = z, _stretch(n0, n1), 0.3
        return x, gate_of(n0 + n1, np.where(np.minimum(n0, n1) > 0, 7, 0))  # apart: contexts in which the decision was always the same

    def study(self, counts, bit: np.ndarray, weight: np.ndarray) -> None:
        z, (n0, n1) = counts
        x, gate = self.inputs((z, (np.maximum(n0 - (bit == 0), 0), np.maximum(n1 - (bit == 1), 0))))
        self.learn(x, gate, bit, weight)


def gains(rows: np.ndarray, paths, logits: np.ndarray) -> np.ndarray:
    """What the words before add to the log10 probabilities of a shard's cells, which blocks share."""
    keys, back = np.unique(rows["step"] << np.uint64(REST_BITS) | rows["class"].astype(np.uint64) << np.uint64(17) | rows["symbol"], return_inverse=True)
    context = np.cumsum(np.diff(keys >> np.uint64(REST_BITS), prepend=keys[:1] >> np.uint64(REST_BITS)) > 0)
    rest = (keys & np.uint64((1 << REST_BITS) - 1)).astype(np.int64)
    return sharpened(context, rest >> 17, rest & ((1 << 17) - 1), np.bincount(back, rows["n"], len(keys)), paths, logits)[back]


def _narrowed(group: np.ndarray) -> np.ndarray:
    """Groups numbered without gaps, in the same order."""
    used = np.zeros(int(group.max(initial=-1)) + 1, bool)
    used[group] = True
    return (np.cumsum(used) - 1)[group]


def sharpened(context: np.ndarray, classes: np.ndarray, symbols: np.ndarray, n: np.ndarray, paths, logits: np.ndarray) -> np.ndarray:
    """What the words before add to the log10 probabilities of distinct cells, ordered by context and class; context: a number for the words before, n: counts.

    All cells go down the tree together. On each level the mixer learns from the level's decisions first, then gives their
    probabilities, so that those of a context's words sum to 1. Where the words before have not spoken, the class's probability stands."""
    size, begin, nodes, bits = paths
    mixer, gain = Sharpener(), np.zeros(len(symbols))
    group, decision = context, np.cumsum(np.diff(context * CLASSES + classes, prepend=-1) > 0) - 1
    keep = np.bincount(context, n)[context] >= SPEAK if len(n) else n > 0
    on, at, stop, weight = np.arange(len(symbols)), begin[symbols], (begin + size)[symbols], n.astype(np.float32)
    while True:
        keep = np.flatnonzero(keep & (at < stop))  # cells of a context are at one node, and end at a leaf together
        if not len(keep):
            return gain
        on, at, stop, weight, classes = on[keep], at[keep], stop[keep], weight[keep], classes[keep]
        group, decision = _narrowed(group[keep]), _narrowed(decision[keep])
        bit = bits[at]
        below, side = group * 2 + bit, decision * 2 + bit
        under = np.bincount(below, weight, 2 * int(group.max()) + 2).astype(np.float32)
        own = np.bincount(side, weight, 2 * int(decision.max()) + 2)
        pick = np.empty(len(own) // 2, np.int64)
        pick[decision] = np.arange(len(on))  # a cell for each decision: node, class and context are its own
        before = logits[nodes[at[pick]], classes[pick]]
        n0, n1 = under[::2][group[pick]], under[1::2][group[pick]]
        for v in (0, 1):
            some = np.flatnonzero(own[v::2])
            mixer.study((before[some], (n0[some], n1[some])), np.full(len(some), v, np.int8), own[v::2][some])
        after = mixer.chance((before, (n0, n1)))
        more = np.stack([np.log(1 - after) + np.logaddexp(0, before), np.log(after) + np.logaddexp(0, -before)], 1) / np.log(10)
        gain[on] += more.ravel()[side]
        keep, group, decision = under[below] >= SPEAK, below, side
        at += 1


# --- spelling --------------------------------------------------------------------------------------------------


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per symbol of the words' spellings: the word's index, and the symbol with the four before it, nine bits each."""
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    flat = np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8).astype(np.int64) + 1
    stops = np.cumsum(lengths)
    flat[stops - 1] = EOW
    owner = np.repeat(np.arange(len(words)), lengths)
    pos = np.arange(len(flat)) - (stops - lengths)[owner]
    key = flat.copy()
    for back in range(1, 5):
        key[back:] |= np.where(pos[back:] >= back, flat[:-back], 0) << (9 * back)
    return owner, key


class Counts:
    """Counts of 0 and 1 by 64-bit key, one row per key seen."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, back = np.unique(keys, return_inverse=True)
        self.n = np.stack([np.bincount(back, n[:, b], len(self.keys)) for b in (0, 1)], 1).astype(np.float32)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys))
        u, back = np.unique(keys, return_inverse=True)  # neighbouring searches stay in the cache
        at = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
        out = np.where((self.keys[at] == u)[:, None], self.n[at], 0).astype(np.float64)[back]
        return out[:, 0], out[:, 1]


class Speller:
    """Probabilities of new words' bytes. grams: distinct values of grams_of; counts: in how many rare words they occur."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        per = np.zeros(EOW + 1)
        np.add.at(per, grams & 511, counts)
        self.paths = Tree(per).paths()
        self.tables: list[Counts] = []
        for order in ORDERS:  # one context and STUDY grams at a time: the driver's memory never holds all decisions
            keys, sums = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.float32)]
            for at in range(0, len(grams), STUDY):
                owner, bit, (k,) = self._decisions(grams[at : at + STUDY], (order,))
                weight = counts[at : at + STUDY][owner].astype(np.float64)
                part = Counts(k, np.stack([weight * (bit == 0), weight * (bit == 1)], 1))
                keys.append(part.keys)
                sums.append(part.n)
            self.tables.append(Counts(np.concatenate(keys), np.concatenate(sums)))
        self.mixer = Mixer()
        order = np.random.default_rng(5).permutation(len(grams))
        for at in range(0, len(order), STUDY):
            part = order[at : at + STUDY]
            owner, bit, keys = self._decisions(grams[part])
            mixed_up = np.random.default_rng(at).permutation(len(bit))
            found = [t.of(k[mixed_up]) for t, k in zip(self.tables, keys)]
            self.mixer.study(found, bit[mixed_up], counts[part][owner[mixed_up]].astype(np.float64))
        self.grams, self.logs = grams, np.zeros(0)
        self.logs = self._log10(grams)

    def _decisions(self, grams: np.ndarray, orders=ORDERS):
        size, begin, nodes, bits = self.paths
        symbol = grams & 511
        m = size[symbol]
        owner = np.repeat(np.arange(len(grams)), m)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m) + begin[symbol[owner]]
        salt = nodes[k].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        keys = []
        for order in orders:
            h = mix64(((grams >> 9) & ((1 << (9 * order)) - 1)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(order))
            keys.append((h[owner] ^ salt) * np.uint64(0x9FB21C651E98DF25))
        return owner, bits[k], keys

    def _log10(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        for at in range(0, len(grams), STUDY):
            part = grams[at : at + STUDY]
            owner, bit, keys = self._decisions(part)
            if len(owner):
                p = self.mixer.chance([t.of(k) for t, k in zip(self.tables, keys)])
                out[at : at + len(part)] = np.bincount(owner, np.log10(np.where(bit == 1, p, 1 - p)), len(part))
        return out

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word's spelling with its end. Grams seen in training are looked up, others are mixed now."""
        owner, key = grams_of(words)
        u, back = np.unique(key, return_inverse=True)
        at = np.minimum(np.searchsorted(self.grams, u), max(0, len(self.grams) - 1))
        known = self.grams[at] == u if len(self.grams) else np.zeros(len(u), bool)
        logs = np.zeros(len(u))
        logs[known] = self.logs[at[known]]
        logs[~known] = self._log10(u[~known])
        return np.bincount(owner, logs[back], len(words))


# --- training and scoring --------------------------------------------------------------------------------------


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' tokens on end (words lower-cased in A-Z, after each text END), and each text's number of them; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = pa.concat_arrays([lists.flatten().cast(pa.binary()), pa.array([END], pa.binary())])
    full = pc.binary_length(words).to_numpy()[:-1] > 0  # white space at a text's ends leaves empty words
    sizes = np.diff(np.append(0, np.cumsum(full))[lists.offsets.to_numpy()]) + 1
    at, inside = np.full(sizes.sum(), len(full)), np.ones(sizes.sum(), bool)
    inside[np.cumsum(sizes) - 1] = False
    at[inside] = np.flatnonzero(full)
    return words.take(pa.array(at)), sizes


def _bytes(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, t): occurrences of each word (END included) in training and in all documents."""
    rows = docs.select((~held_out(docs["doc_id"])).alias("train"), docs["text"])

    def run(batches):
        parts: list[pa.Array] = []
        trains: list[np.ndarray] = []

        def flush():
            coded_words = pa.concat_arrays(parts).dictionary_encode()
            words, code, train = coded_words.dictionary, coded_words.indices.to_numpy(), np.concatenate(trains)
            c, t = np.bincount(code[train], minlength=len(words)), np.bincount(code, minlength=len(words))
            for x in (parts, trains):
                x.clear()
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([words.slice(at, 50_000), pa.array(c[at : at + 50_000]), pa.array(t[at : at + 50_000])], names=["word", "c", "t"])

        held = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                words, sizes = tokens_of(b.column(1).slice(at, 256))
                parts.append(words)
                trains.append(np.repeat(b.column(0).slice(at, 256).to_numpy(zero_copy_only=False), sizes))
                held += words.nbytes
                if held >= FLUSH_BYTES:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, "word binary, c long, t long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def rare_grams(rare: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the spellings of (word): distinct ones, ascending, with counts. As many reach the driver as strings of five bytes occur."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 50_000):
                u, n = np.unique(grams_of(_bytes(b.column(0).slice(at, 50_000)))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["g", "n"])

    got = rare.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    g, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(g)
    return g[order], n[order]


def shelf_of(word: bytes, shelves: int) -> int:
    return zlib.crc32(word) % shelves


def coded(docs: DataFrame, known, shelves: int) -> DataFrame:
    """Rows of three kinds: one per block of documents with the ids of its tokens (16 bits each), the hashes of its words outside the dictionary in order
    and its documents' columns; one per block and shelf with these words (packed: `size` of them, and their rows); and per task rows of counted cells (class, id, n).

    known: broadcast dictionary word -> id. Ids behind the dictionary's stand for other words, the second of them for ones that close a sentence.
    Other words are told apart by `under`: twice their class, and one more in training rows. Cells behind the escape's are the shelves'.
    A block's documents have the row numbers from its own on."""
    rows = docs.select("doc_id", (~held_out(docs["doc_id"])).alias("train"), docs["text"])
    many = {"doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "n_bytes": pa.list_(pa.int64()), "trains": pa.list_(pa.bool_())}
    kinds = {"block": pa.int64(), "shelf": pa.int32(), "size": pa.int32(), "bytes": pa.int32(), "words": pa.binary(), "packed": pa.binary()}
    kinds |= {**many, "ids": pa.binary(), "tail": pa.binary(), "class": pa.int32(), "id": pa.int32(), "n": pa.int64()}
    schema = "block long, shelf int, size int, bytes int, words binary, packed binary, doc_ids array<long>, sizes array<long>, n_bytes array<long>, trains array<boolean>, ids binary, tail binary, class int, id int, n long"

    def batch_of(**given):
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[c], k) if c in given else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))

    def run(batches):
        from pyspark import TaskContext

        row, other = TaskContext.get().partitionId() << 40, len(known.value)
        closing, dictionary = closing_ids(known.value), pa.array(list(known.value), pa.binary())  # in the order of their ids
        cells = np.zeros((CLASSES, other + 1 + shelves), np.int64)
        width = cells.shape[1]
        block: dict[str, list] = {c: [] for c in (*many, "ids", "tail", "others", "owner", "under")}

        def flush():
            number = row - len(block["sizes"])
            if sum(map(len, block["tail"])):
                coded_words = pa.concat_arrays(block["others"]).dictionary_encode()
                met = _bytes(coded_words.dictionary)
                shelf = np.fromiter(map(zlib.crc32, met), np.uint32, len(met)) % np.uint32(shelves)  # as shelf_of
                order = np.argsort(shelf, kind="stable")
                place = np.empty(len(met), np.uint64)
                place[order] = np.arange(len(met), dtype=np.uint64)  # a word's, ordered by shelf
                own = place[coded_words.indices.to_numpy()] << np.uint64(40) | np.concatenate(block["owner"]) << np.uint64(8) | np.concatenate(block["under"])
                own.sort()
                keys = _distinct(own)
                starts, word = np.searchsorted(own, keys), (keys >> np.uint64(40)).astype(np.int64)
                rest = np.zeros(len(keys), REST)
                rest["row"], rest["under"] = keys >> np.uint64(8) & np.uint64(0xFFFFFFFF), keys & np.uint64(0xFF)
                rest["next"], rest["times"] = np.diff(word, prepend=0), np.diff(starts, append=len(own))
                first = np.append(np.flatnonzero(np.diff(shelf[order].astype(np.int64), prepend=-1)), len(met))  # words, and rows of words, at which shelves begin
                edges = np.searchsorted(word, first)
                rest["next"][edges[:-1]] = 0
                parts = [b"\n".join([met[k] if met[k] != END else b"" for k in order[a:z].tolist()]) for a, z in zip(first[:-1], first[1:])]
                yield batch_of(
                    block=[number] * len(parts), shelf=shelf[order[first[:-1]]].astype(np.int32), size=np.diff(edges), bytes=[len(x) for x in parts],
                    words=[pa.Codec("zstd").compress(x, asbytes=True) for x in parts], packed=[packed(rest[a:z]) for a, z in zip(edges[:-1], edges[1:])],
                )
            yield batch_of(block=[number], ids=[b"".join(x.tobytes() for x in block["ids"])], tail=[b"".join(x.tobytes() for x in block["tail"])], **{c: [block[c]] for c in many})
            for x in block.values():
                x.clear()

        held = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                words, sizes = tokens_of(part.column(2))
                found = pc.index_in(words, value_set=dictionary)
                spots = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
                others = words.take(pa.array(spots))
                ids = found.fill_null(other).to_numpy().astype(np.uint16)
                names = _bytes(others)
                ids[spots] += np.fromiter((w[-1] in MARKS for w in names), np.uint16, len(names))
                tail, owner = np.fromiter(map(zlib.crc32, names), np.uint32, len(names)), np.repeat(np.arange(len(sizes)), sizes)
                trains, lengths = part.column(1).to_pylist(), pc.binary_length(part.column(2)).fill_null(0).to_pylist()
                begins, is_train = np.cumsum(sizes) - sizes, np.array(trains, bool)[owner]
                classes = classes_of(ids, begins, closing)
                np.add.at(cells.ravel(), (classes * width + np.minimum(ids, other))[is_train], 1)
                shelf = classes[spots] * width + other + 1 + (tail % np.uint32(shelves)).astype(np.int64)  # as shelf_of
                np.add.at(cells.ravel(), shelf[is_train[spots]], 1)
                block["others"].append(others)
                block["owner"].append((len(block["sizes"]) + owner[spots]).astype(np.uint64))
                block["under"].append((2 * classes[spots] + is_train[spots]).astype(np.uint64))
                row += part.num_rows
                for c, x in (("doc_ids", part.column(0).to_pylist()), ("sizes", sizes.tolist()), ("n_bytes", lengths), ("trains", trains)):
                    block[c] += x
                block["ids"].append(ids)
                block["tail"].append(tail)
                held += len(ids)
                if held >= BLOCK:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()
        k, i = np.nonzero(cells)
        for at in range(0, len(k), 100_000):
            z = slice(at, at + 100_000)
            yield batch_of(**{"class": k[z], "id": i[z], "n": cells[k[z], i[z]]})

    return rows.mapInArrow(run, schema)


def closing_ids(known: dict[bytes, int]) -> np.ndarray:
    """Per id, whether it closes a sentence; the two ids of other words behind the dictionary's."""
    out = np.zeros(len(known) + 2, bool)
    out[[i for w, i in known.items() if w[-1] in MARKS]] = True
    out[len(known) + 1] = True
    return out


def shelved(words: pa.Array, under: np.ndarray, times: np.ndarray, spelled) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all occurrences of a shelf's words: their words' training counts, whether new, and their log10 probabilities in the shelf or as spelled.

    spelled: function of a list of new words, to their spellings' log10 probabilities."""
    coded_words = words.dictionary_encode()
    kinds = coded_words.dictionary
    order = pc.sort_indices(kinds).to_numpy()  # the words' order is the same however the rows came
    place = np.empty(len(kinds), np.int64)
    place[order] = np.arange(len(kinds))
    code, cls = place[coded_words.indices.to_numpy()], (under >> 1).astype(np.int64)
    cells = np.bincount(code * CLASSES + cls, times * (under & 1), len(kinds) * CLASSES).reshape(len(kinds), CLASSES)
    count = cells.sum(1)
    old = np.flatnonzero(count)
    wanted = np.zeros((len(kinds), CLASSES), bool)
    wanted[code, cls] = True
    at = np.cumsum(count > 0) - 1  # of a word of training, among these
    logs = np.zeros(len(code))
    is_old = count[code] > 0
    if len(old):
        logs[is_old] = dictionary_table(cells[old], wanted=wanted[old])[cls[is_old], at[code[is_old]]]
    if len(old) < len(kinds):
        fresh = np.flatnonzero(count == 0)
        value = np.zeros(len(kinds))
        value[fresh] = spelled(_bytes(kinds.take(pa.array(order[fresh]))))
        logs[~is_old] = value[code[~is_old]]
    return count[code], ~is_old, logs


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, a query's shuffle files go when it ends: its result is saved or in the driver. Else they stay beside those of all later ones."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def score(docs: DataFrame, hot: int = HOT, shelf: int = SHELF) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    with shuffles_dropped(spark):
        vocabulary = saved(word_counts(docs), "lm-words")
        totals = vocabulary.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("t"), F.count(F.when(F.col("c") == 1, 1))).first()
        n, v = int(totals[0] or 0), int(totals[1] or 0)
        seen = vocabulary.where("c > 0")
        top = seen.where((F.col("c") >= LEAST) | (F.col("word") == F.lit(END))).orderBy(F.desc(F.col("word") == F.lit(END)), F.desc("c"), "word").limit(hot).toArrow()  # at most `hot` rows
        words, counts = top.column(0).to_pylist(), top.column(1).to_numpy()
        shelves = max(1, -(-(int(totals[2] or 0) - int(top.column(2).to_numpy().sum())) // shelf))
        order = np.argsort(-counts, kind="stable")
        words, counts = [words[k] for k in order], counts[order]
        known = spark.sparkContext.broadcast({w: k for k, w in enumerate(words)})  # at most `hot` words

        hot_words = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
        grams = rare_grams(seen.join(F.broadcast(hot_words), "word", "left_anti").select("word"))
        forget(vocabulary)
        first = saved(coded(docs, known, shelves), "lm-docs")
        got = first.where("class is not null").groupBy("class", "id").agg(F.sum("n").alias("n")).toArrow()  # CLASSES * (hot + 1 + shelves) rows at most
    n_rare, n_once = n - int(counts.sum()), int(totals[3]) - int((counts == 1).sum())
    new = (n_once + 0.5) / (n_rare + 1.0)  # an escaped word's chance to be new: had each single word been left out, it would be
    speller = spark.sparkContext.broadcast(Speller(*grams))
    del grams
    cells = np.zeros((len(words) + 1 + shelves, CLASSES), np.float32)
    cells[got.column(1).to_numpy(), got.column(0).to_numpy()] = got.column(2).to_numpy()
    del got
    tree, logits = dictionary_logits(cells[: len(words) + 1])
    log_table, size_paths = table_of(tree, logits), tree.paths()
    shelf_logs = spark.sparkContext.broadcast(dictionary_table(cells[len(words) + 1 :]))
    del cells, tree
    sharp = spark.sparkContext.broadcast((size_paths, logits))
    tables = spark.sparkContext.broadcast((log_table, np.log10(counts + 1.0)))

    def on_shelf(key, got):
        rows, names = [], []
        for block, size, length, words, blob in zip(*(got.column(c).to_pylist() for c in ("block", "size", "bytes", "words", "packed"))):
            part = unpacked(blob, size, REST)
            rows.append((len(names) + np.cumsum(part["next"], dtype=np.int64), part["row"] + np.int64(block), part["under"].astype(np.int64), part["times"].astype(np.int64)))
            names += [w or END for w in pa.Codec("zstd").decompress(words, length, asbytes=True).split(b"\n")]
        word, row, under, k = (np.concatenate(x) for x in zip(*rows))
        kinds = pa.array(names, pa.binary()).dictionary_encode()  # blocks share words
        words = pa.DictionaryArray.from_arrays(kinds.indices.to_numpy()[word], kinds.dictionary)
        del names, rows
        c, fresh, logs = shelved(words, under, k, speller.value.log10)
        logs = logs + np.where(fresh, np.log10(new), np.log10(1 - new) + shelf_logs.value[under >> 1, key[0].as_py()])
        rows, back = np.unique(row, return_inverse=True)
        sums = [np.bincount(back, k * x, len(rows)) for x in (np.log10(c + 1), logs)]
        return pa.table({"row": rows, "rare_base": sums[0], "rare_logp": sums[1], "rare_hits": np.bincount(back, k * ~fresh, len(rows)).astype(np.int64)})

    blocks = first.where("ids is not null").select("block", "doc_ids", "sizes", "n_bytes", "trains", "ids", "tail")
    shards = max(1, -(-int(totals[2] or 0) // SHARD))

    closing = spark.sparkContext.broadcast(closing_ids(known.value))

    def block_of(ids: bytes, tail: bytes, sizes: np.ndarray) -> Block:
        return Block(np.frombuffer(ids, np.uint16), np.frombuffer(tail, np.uint32), sizes, closing.value)

    def cells_of(batches):
        for b in batches:
            for k in range(b.num_rows):
                number, sizes, trains, ids, tail = (b.column(c)[k] for c in (0, 2, 4, 5, 6))
                sizes = sizes.values.to_numpy()
                got = block_of(ids.as_py(), tail.as_py(), sizes)
                rows = got.rows(np.repeat(trains.values.to_numpy(zero_copy_only=False), sizes))
                edges = got.by_shard(shards)
                parts = [(s, rows[edges[s] : edges[s + 1]]) for s in np.flatnonzero(np.diff(edges)).tolist()]
                for _, part in parts:
                    part["step"][1:] = np.diff(part["step"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in (([s for s, _ in parts], pa.int32()), ([number.as_py()] * len(parts), pa.int64()), ([len(p) for _, p in parts], pa.int32()), ([packed(p) for _, p in parts], pa.binary()))],
                    names=["shard", "block", "cells", "packed"],
                )

    def on_shard(key, got):
        order = np.argsort(got.column("block").to_numpy())
        sizes, blobs = got.column("cells").to_numpy()[order], got.column("packed").to_pylist()
        rows = [unpacked(blobs[k], int(m), CELL) for k, m in zip(order, sizes)]
        for x in rows:
            x["step"] = np.cumsum(x["step"], dtype=np.uint64)
        rows = np.concatenate(rows)
        gain = short(gains(rows, *sharp.value))
        edges = np.cumsum(np.append(0, sizes))
        gain = [packed(gain[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({"block": got.column("block").to_numpy()[order], "shard": pa.array([key[0].as_py()] * len(order), pa.int32()), "cells": sizes, "packed": gain})

    def run(key, left, right):
        log_table, base_of = tables.value
        other, out = len(base_of), []
        right = right.sort_by("shard")
        gain = np.concatenate([unpacked(x, n, np.dtype(np.float32)) for x, n in zip(right.column("packed").to_pylist(), right.column("cells").to_pylist())])
        sizes = left.column("sizes")[0].values.to_numpy()
        b = block_of(left.column("ids")[0].as_py(), left.column("tail")[0].as_py(), sizes)
        logs = log_table[b.classes, b.symbols].astype(np.float64) + b.by_token(gain)
        out = [np.add.reduceat(x, b.begins) for x in ((b.symbols < other).astype(np.int64), np.append(base_of, 0.0)[b.symbols], logs)]
        row = np.arange(len(sizes)) + left.column("block")[0].as_py()
        return pa.table([pa.array(row), left.column("doc_ids")[0].values, pa.array(sizes), *(pa.array(x) for x in out), left.column("n_bytes")[0].values], names=["row", "doc_id", "n_tokens", "hits", "base", "logp", "n_bytes"])

    back = blocks.mapInArrow(cells_of, "shard int, block long, cells int, packed binary").groupBy("shard").applyInArrow(on_shard, "block long, shard int, cells int, packed binary")
    per_doc = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, "row long, doc_id long, n_tokens long, hits long, base double, logp double, n_bytes long")
    rest = first.where("shelf is not null").select("shelf", "block", "size", "bytes", "words", "packed")
    rest = rest.groupBy("shelf").applyInArrow(on_shelf, "row long, rare_base double, rare_logp double, rare_hits long")
    with shuffles_dropped(spark):  # before the shards' shuffles begin
        rest = saved(rest.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("rare_base", "rare_logp", "rare_hits")]), "lm-rest")
    speller.destroy()
    shelf_logs.destroy()
    both = per_doc.join(rest, "row", "left")
    nil = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("base") + nil("rare_base") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    total = F.col("logp") + nil("rare_logp")
    per_byte = F.when(F.col("n_bytes") > 0, -total * float(np.log2(10)) / F.col("n_bytes"))
    return both.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("hits") + nil("rare_hits")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), total.alias("score"), "n_bytes", per_byte.alias("bits_per_byte"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
