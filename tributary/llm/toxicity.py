"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a learned vector (if the training rows have it often enough)
and as the mean of learned vectors of its hashed character trigrams. Two gated
recurrent layers read a window of words from either side; attention weighs
their states; a linear layer gives a logit. A document is read in overlapping
windows from its first word to its last, and its score is that of its worst
window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import arrow, on_leaving, pieces, prepare, rows_of, stored, text_of
from tributary.llm.hashing import grams

#: Words in a window, and words from one window's start to the next.
WINDOW, STEP = 48, 24
HIDDEN, WORD_DIM, CHAR_DIM, BUCKETS = 8, 8, 8, 1 << 13
#: Bound of the training sample: labelled rows of each kind. Their texts are read whole.
SAMPLE = 2000
#: Words of training texts whose windows are ranked at a time.
GROUP_WORDS = 1 << 19
#: Training rows that must hold a word before it has a vector of its own.
LEAST = 4
_EDGES = ".,;:!?\"'()[]{}<>«»“”„*_-#$%&…"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def trigram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of ^word$, and where each word's begin."""
    raw = [b"^" + w.encode() + b"$$" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw])
    ends = np.cumsum(sizes)
    keep = np.ones(len(data), bool)
    keep[ends - 1] = keep[ends - 2] = False
    h = np.concatenate([grams(data, 3), np.zeros(2, np.uint64)])[keep]
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([[0], np.cumsum(sizes - 2)[:-1]])


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows over n words; the last window ends with the last word."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    out = np.arange(0, n - WINDOW, STEP)
    return np.append(out, n - WINDOW)


def over_windows(numbers: list[np.ndarray], measure, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all overlapping windows of texts, given as word numbers: number of the text, first word, and measure(index, real).

    index has a row of word numbers for each of some windows; real marks those that are not padding, or is None where none are.
    """
    sizes = np.array([len(x) for x in numbers], np.int64)
    starts = [window_starts(n) for n in sizes]
    owner = np.repeat(np.arange(len(numbers)), [len(s) for s in starts])
    first = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    flat = np.concatenate([*numbers, np.zeros(WINDOW, np.int64)])
    base = np.cumsum(sizes) - sizes
    out, short = np.empty(len(owner), np.float32), sizes[owner] < WINDOW
    for kind in (False, True):
        which = np.flatnonzero(short == kind)
        for i in range(0, len(which), block):
            w = which[i : i + block]
            index = flat[(base[owner[w]] + first[w])[:, None] + np.arange(WINDOW)]
            real = None
            if kind:
                real = np.arange(WINDOW) < sizes[owner[w]][:, None]
                index = np.where(real, index, 0)
            out[w] = measure(index, real)
    return owner, first, out


class Network:
    def __init__(self, vocabulary: dict[str, int], lean: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        n, h = WORD_DIM + CHAR_DIM, HIDDEN
        small = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "word": small(len(vocabulary) + 1, WORD_DIM), "char": small(BUCKETS, CHAR_DIM),
            "W": small(2, n, 3 * h) * 3, "U": small(2, h, 3 * h) * 3, "b": np.zeros((2, 1, 3 * h), np.float32),
            "a": small(2 * h), "o": small(2 * h) * 3, "c": np.array([-1.0], np.float32),
        }
        self.p["word"][1:, 0] = lean
        self.p["word"][0] = 0

    def rows(self, words: list[str]) -> np.ndarray:
        """The inputs of words as they stand in a text: lower case, without marks at their edges."""
        bare = [w.lower().strip(_EDGES) for w in words]
        ids, at = trigram_ids(bare)
        mean = np.add.reduceat(self.p["char"][ids], at, axis=0) / np.diff(np.append(at, len(ids)))[:, None]
        return np.concatenate([self.p["word"][[self.vocabulary.get(w, 0) for w in bare]], mean], axis=1).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What words add to the gates of either direction: (2, words, 3 * HIDDEN)."""
        return x @ self.p["W"] + self.p["b"]

    def score(self, gates: np.ndarray, index: np.ndarray, real: np.ndarray | None) -> np.ndarray:
        """Logits of windows: rows of index are windows of word numbers into gates; real marks words that are not padding."""
        n, t_max = index.shape
        h, u = HIDDEN, self.p["U"]
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((t_max, n, 2, h), np.float32)
        x = np.empty((2, n, 3 * h), np.float32)
        for t in range(t_max):
            b = t_max - 1 - t
            np.take(gates[0], index[:, t], axis=0, out=x[0])
            np.take(gates[1], index[:, b], axis=0, out=x[1])
            y = state @ u
            zr = x[..., : 2 * h] + y[..., : 2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z = zr[..., :h]
            c = y[..., 2 * h :] * zr[..., h:]
            c += x[..., 2 * h :]
            np.tanh(c, out=c)
            new = c + z * (state - c)
            if real is not None:
                m = np.stack([real[:, t], real[:, b]])[..., None]
                new = np.where(m, new, state)
            state = new
            states[t, :, 0] = state[0]
            states[b, :, 1] = state[1]
        flat = states.reshape(t_max, n, 2 * h)
        weight = flat @ self.p["a"]
        if real is not None:
            weight = np.where(real.T, weight, -1e9)
        weight = np.exp(weight - weight.max(0))
        if real is not None:
            weight *= real.T
        out = (weight * (flat @ self.p["o"])).sum(0) / np.maximum(weight.sum(0), 1e-9)
        return out + self.p["c"][0]

    def gradient(self, x: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss over windows of inputs x (windows, words, inputs), gradients of the shared weights, and of x."""
        n, t_max, _ = x.shape
        h, p = HIDDEN, self.p
        both, mask = np.stack([x, x[:, ::-1]]), np.stack([real, real[:, ::-1]])[..., None].astype(np.float32)
        pre = np.einsum("dnti,dij->dntj", both, p["W"], optimize=True) + p["b"][:, None]
        state, kept = np.zeros((2, n, h), np.float32), []
        states = np.empty((2, n, t_max, h), np.float32)
        for t in range(t_max):
            y = state @ p["U"]
            z, r = _sigmoid(pre[:, :, t, :h] + y[..., :h]), _sigmoid(pre[:, :, t, h : 2 * h] + y[..., h : 2 * h])
            c = np.tanh(pre[:, :, t, 2 * h :] + r * y[..., 2 * h :])
            kept.append((state, y, z, r, c))
            state = state + mask[:, :, t] * ((1 - z) * (c - state))
            states[:, :, t] = state
        flat = np.concatenate([states[0], states[1][:, ::-1]], axis=2)
        weight = np.where(real, flat @ p["a"], -1e9)
        weight = np.exp(weight - weight.max(1, keepdims=True)) * real
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
        value = flat @ p["o"]
        logit = (weight * value).sum(1) + p["c"][0]
        prob = _sigmoid(logit)
        loss = float(-np.mean(np.log(np.where(label > 0, prob, 1 - prob) + 1e-9)))
        d_logit = (prob - label)[:, None] / n
        d_weight = weight * (value - (weight * value).sum(1, keepdims=True)) * d_logit
        g = {"c": d_logit.sum(0), "o": np.einsum("nt,nth->h", weight * d_logit, flat), "a": np.einsum("nt,nth->h", d_weight, flat)}
        d_flat = (weight * d_logit)[..., None] * p["o"] + d_weight[..., None] * p["a"]
        d_states = np.stack([d_flat[..., :h], d_flat[:, ::-1, h:]])
        d_pre, d_u, d_state = np.zeros_like(pre), np.zeros_like(p["U"]), np.zeros((2, n, h), np.float32)
        for t in range(t_max - 1, -1, -1):
            before, y, z, r, c = kept[t]
            d = d_state + d_states[:, :, t]
            dm = d * mask[:, :, t]
            dz, dc = dm * (before - c), dm * (1 - z) * (1 - c * c)
            dy_n = dc * r
            d_zr = np.concatenate([dz * z * (1 - z), dc * y[..., 2 * h :] * r * (1 - r)], axis=2)
            d_pre[:, :, t] = np.concatenate([d_zr, dc], axis=2)
            dy = np.concatenate([d_zr, dy_n], axis=2)
            d_u += before.transpose(0, 2, 1) @ dy
            d_state = d - dm * (1 - z) + dy @ p["U"].transpose(0, 2, 1)
        g["U"], g["b"] = d_u, d_pre.sum((1, 2))[:, None]
        g["W"] = np.einsum("dnti,dntj->dij", both, d_pre, optimize=True)
        dx = np.einsum("dntj,dij->dnti", d_pre, p["W"], optimize=True)
        return loss, g, dx[0] + dx[1][:, ::-1]


class Scorer:
    """Scores texts; keeps the gate inputs of the words that it has met, up to a bound."""

    KEPT = 100_000

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.gates = np.zeros((2, 1 << 12, 3 * HIDDEN), np.float32)

    def _numbers(self, lists: list[list[str]]) -> list[np.ndarray]:
        need: set[str] = set()
        for x in lists:
            need.update(x)
        if len(self.number) + len(need) > self.KEPT:
            self._clear()
        new = sorted(need.difference(self.number))
        if new:
            at = len(self.number)
            while at + len(new) > self.gates.shape[1]:
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)], axis=1)
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.gates[:, at + i : at + i + len(part)] = self.net.project(self.net.rows(part))
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
        get = self.number.__getitem__
        return [np.fromiter(map(get, x), np.int64, len(x)) for x in lists]

    def windows(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all overlapping windows: number of the text, first word, and logit."""
        numbers = self._numbers(lists)
        return over_windows(numbers, lambda index, real: self.net.score(self.gates, index, real))

    def scores(self, texts: list[str]) -> np.ndarray:
        owner, _, logit = self.windows([t.split() for t in texts])
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, logit)
        return 1 / (1 + np.exp(-worst))


def numbered(texts: Iterable[str]) -> tuple[list[np.ndarray], list[str]]:
    """Whole texts as 32-bit word numbers, and the words, lower case and without marks at their edges; number 0 is the empty word."""
    number: dict[str, int] = {"": 0}
    lists = []
    for t in texts:
        bare = [w.lower().strip(_EDGES) for w in t.split()]
        lists.append(np.fromiter((number.setdefault(w, len(number)) for w in bare), np.int32, len(bare)))
    return lists, list(number)


def groups_of(lists: list[np.ndarray], limit: int = GROUP_WORDS):
    """Ranges of texts with about limit words each, at least one text."""
    at, total = 0, 0
    for k, x in enumerate(lists):
        if k > at and total + len(x) > limit:
            yield at, k
            at, total = k, 0
        total += len(x)
    if at < len(lists):
        yield at, len(lists)


def worst_windows(lists: list[np.ndarray], labels: np.ndarray, rank, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of each text's window of highest rank, and of the next two where its label is 0; ties by chance.

    rank(used) gives a measure for over_windows whose numbers point into used,
    the words that a group of texts has. Every window of every text is ranked; a
    group's ranks are let go before the next is read.
    """
    texts, firsts = [], []
    for low, high in groups_of(lists):
        used, local = np.unique(np.concatenate([*lists[low:high], np.zeros(1, np.int32)]), return_inverse=True)
        ends = np.cumsum([len(x) for x in lists[low:high]])
        owner, first, value = over_windows(np.split(local[:-1], ends[:-1]), rank(used))
        order = np.lexsort((rng.random(len(value)), -value, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen = order[(place == 0) | ((labels[low + owner[order]] == 0) & (place < 3))]
        texts.append(low + owner[chosen])
        firsts.append(first[chosen])
    return np.concatenate(texts), np.concatenate(firsts)


def train(lists: list[np.ndarray], strings: list[str], labels: np.ndarray, rounds: int = 3, epochs: int = 4, seed: int = 5) -> Network:
    """Fits the network to the worst windows of labelled texts (see numbered()), which it picks anew in each round.

    Word vectors start with one coordinate that leans the way the word's
    training rows are labelled. With no rows, or none of one kind, every score
    stays near the base rate.
    """
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, len(strings)), np.int64)
    for x, label in zip(lists, labels, strict=True):
        seen[int(label), np.unique(x)] += 1
    frequent = sorted((k for k in np.flatnonzero(seen.sum(0) >= LEAST).tolist() if k), key=strings.__getitem__)
    total = np.maximum(np.bincount(labels.astype(int), minlength=2), 1)
    odds = np.log((seen[1, frequent] + 0.5) / (total[1] + 1)) - np.log((seen[0, frequent] + 0.5) / (total[0] + 1))
    lean = odds.astype(np.float32)
    net = Network({strings[k]: i + 1 for i, k in enumerate(frequent)}, lean / 4, seed)
    if len(set(labels.tolist())) < 2:
        net.p["c"][0] = -3.0 if not len(labels) or labels.max() == 0 else 3.0
        return net
    worth = np.zeros(len(strings), np.float32)
    worth[frequent] = lean

    def by_worth(used):
        mine = worth[used]

        def measure(index, real):
            value = mine[index] if real is None else np.where(real, mine[index], -np.inf)
            best = value.max(1)
            return np.where(np.isfinite(best), best, 0)

        return measure

    def by_network(used):
        gates = np.empty((2, len(used), 3 * HIDDEN), np.float32)
        for i in range(0, len(used), 20_000):
            gates[:, i : i + 20_000] = net.project(net.rows([strings[k] for k in used[i : i + 20_000]]))
        return lambda index, real: net.score(gates, index, real)

    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        owner, first = worst_windows(lists, labels, by_network if turn else by_worth, rng)
        picks = [lists[o][f : f + WINDOW] for o, f in zip(owner, first, strict=True)]
        used = sorted(set(np.concatenate(picks).tolist()) | {0}, key=strings.__getitem__)
        words = [strings[k] for k in used]
        number = dict(zip(used, range(len(used)), strict=True))
        own = np.array([net.vocabulary.get(w, 0) for w in words])
        ids, at = trigram_ids(words)
        count = np.diff(np.append(at, len(ids)))
        owner_word = np.repeat(np.arange(len(words)), count)
        index, real = np.zeros((len(picks), WINDOW), np.int64), np.zeros((len(picks), WINDOW), bool)
        for k, x in enumerate(picks):
            index[k, : len(x)], real[k, : len(x)] = [number[w] for w in x.tolist()], True
        goal = labels[owner].astype(np.float32)
        for _ in range(epochs):
            perm = rng.permutation(len(picks))
            for i in range(0, len(perm), 128):
                w = perm[i : i + 128]
                near, local = np.unique(index[w], return_inverse=True)
                local = local.reshape(len(w), WINDOW)
                pick = np.isin(owner_word, near, assume_unique=False)
                sub_ids, sub_own = ids[pick], np.searchsorted(near, owner_word[pick])
                mean = np.zeros((len(near), CHAR_DIM), np.float32)
                np.add.at(mean, sub_own, net.p["char"][sub_ids])
                mean /= count[near][:, None]
                x = np.concatenate([net.p["word"][own[near]], mean], axis=1)[local]
                _, g, dx = net.gradient(x, real[w], goal[w])
                d = np.zeros((len(near), WORD_DIM + CHAR_DIM), np.float32)
                np.add.at(d, local.ravel(), dx.reshape(-1, dx.shape[2]))
                g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
                np.add.at(g["word"], own[near], d[:, :WORD_DIM])
                g["word"][0] = 0
                np.add.at(g["char"], sub_ids, (d[:, WORD_DIM:] / count[near][:, None])[sub_own])
                step += 1
                for k, v in net.p.items():
                    m, s = adam[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.01 * (g[k] ** 2 - s)
                    v -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def held_out(doc_id: str | None) -> bool:
    return doc_id is not None and zlib.crc32(doc_id.encode()) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> DataFrame:
    """i, text, toxic and the text's hash of at most sample labelled rows of each kind that are not held out.

    The ids are chosen by hash, in Spark; the broadcast has at most 2 * sample
    rows. Texts are whole: a label may owe to any part of one. Of rows that
    share an id the one with the least hash of its text is taken, so repeated
    ids don't pass the bound.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("i"), F.col("toxic").cast("int").alias("toxic"))
    lab = lab.where(F.col("i").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("i").cast("string").cast("binary")) % 5 != 0)).distinct()
    picks = [lab.where(F.col("toxic") == k).orderBy(F.xxhash64("i"), "i").limit(sample) for k in (0, 1)]
    ids = F.broadcast(picks[0].unionByName(picks[1]))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("text")).join(ids, "i")
    rows = rows.select("i", "text", "toxic", F.md5("text").alias("hash"))
    return rows.groupBy("i", "toxic").agg(F.min_by("text", "hash").alias("text"), F.min("hash").alias("hash"))


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Network:
    """The network of a sample of labelled rows. Their texts come to the driver a part at a time, and it keeps them as word numbers."""
    prepare(docs.sparkSession)
    keys: list[tuple[int, str, int]] = []

    def texts():
        for r in stored(training_rows(docs, labels, id_col, text_col, sample), "training").toLocalIterator():
            keys.append((r.i, r.hash, r.toxic))
            yield r.text

    lists, strings = numbered(texts())
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return train([lists[k] for k in order], strings, np.array([keys[k][2] for k in order], np.int64))


_scorers: dict[str, Scorer] = {}
on_leaving("toxicity", _scorers.clear)


def _scorer(key: str, net: Network) -> Scorer:
    """This worker's scorer of a network: tasks of one query share what it has met."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(net)
    return _scorers[key]


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5): every row, whole texts, no shuffle.

    The score depends on nothing but the text. Null and empty texts are one
    empty window. Ids may repeat or be null (then not held out). An empty table
    gives no rows. Columns other than the two named are not looked at. The
    network is sent to the executors: its size is bounded by the training sample.
    """
    spark = prepare(docs.sparkSession)
    sent, key = spark.sparkContext.broadcast(net), f"{id(net)}-{np.random.default_rng().integers(1 << 62)}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def score(batches):
        scorer = _scorer(key, sent.value)
        for whole in batches:
            for b in pieces(whole, 2 << 20):
                s = scorer.scores(b.column("text").to_pylist()).astype(np.float64)
                held = [held_out(None if i is None else str(i)) for i in b.column("doc_id").to_pylist()]
                yield rows_of({"doc_id": b.column("doc_id"), "held_out": held, "score": s, "predicted": (s >= 0.5).astype(np.int32)}, SCORES)

    return arrow(rows, "toxicity", score, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below 0.5. No shuffle, no join: ids play no part.

    Whole texts are scored; null and empty ones as one empty window. Repeated rows
    fare alike, an empty table gives no rows, and columns that share a name with
    what score_documents returns pass as they are.
    """
    spark = prepare(docs.sparkSession)
    sent, key = spark.sparkContext.broadcast(net), f"{id(net)}-{np.random.default_rng().integers(1 << 62)}"

    def keep(batches):
        scorer = _scorer(key, sent.value)
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            for i in range(0, len(texts), 500):
                good = scorer.scores(texts[i : i + 500]) < 0.5
                yield b.slice(i, 500).filter(pa.array(good))

    return arrow(docs, "toxicity", keep, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, fit(docs, labels))
