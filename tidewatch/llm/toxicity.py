"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own vector (if the training sample holds it often enough) beside the mean of
the vectors of its character 3- and 4-grams. Two gated recurrent passes read a window, attention
weighs the places, and a logistic output scores the window. A document's score is the highest of
all its overlapping windows, so one passage is enough and length does not dilute it. Training knows
labels of documents only: each round scores the windows of the sample, takes the highest one of
every document, and takes gradient steps on those.

The sample is bounded by ``rows`` documents of each class and ``windows`` windows of each; which
rows are taken depends on a hash of their ids alone. Everything else covers all rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from tidewatch.llm.common import alnum_words, bounded_batches, map_text, sliced, utf8, worker_cache

WINDOW = 48
STRIDE = 24
HIDDEN = 12
WIDTH = 12
GRAMS = 1 << 14
ROWS = 2500
WINDOWS = 10
ROUNDS = 10
BATCH = 64
LEAST_STEPS = 30
CUTOFF = 0.7
_CACHE = 150_000
# Words whose grams are summed at once, and spare rows of the cache.
_PART = 4096
# Windows of the sample that are scored at once while training, whole batches of the scorer.
SLICE = 2048


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n words; the last one ends with the last word."""
    starts = list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n else []
    return [(s, min(s + WINDOW, n)) for s in starts]


def gram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- and 4-grams of ``^word$`` for all words in a row, and how many each word has."""
    raw = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(raw))  # bytes to the end of the own word
    pad = np.concatenate([raw, np.zeros(3, np.uint64)])
    three = pad[:-3] | pad[1:-2] << np.uint64(8) | pad[2:-1] << np.uint64(16)
    four = three | pad[3:] << np.uint64(24) | np.uint64(1 << 40)
    mix = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - GRAMS.bit_length() + 1)
    hashed = np.concatenate([(three * mix >> shift)[left >= 3], (four * mix >> shift)[left >= 4]])
    owners = np.concatenate([owner[left >= 3], owner[left >= 4]])
    order = np.argsort(owners, kind="stable")
    return hashed[order].astype(np.int64), np.bincount(owners, minlength=len(words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name, scores and gradients. Both directions share one input product."""

    def __init__(self, words: list[bytes], seed: int = 7):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, 2 * WIDTH
        self.vocabulary = {w: i + 1 for i, w in enumerate(words)}  # 0: a word of its grams only

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": draw(len(words) + 1, WIDTH, scale=0.3),
            "gram": draw(GRAMS, WIDTH, scale=0.3),
            "input": draw(e, 6 * h, scale=e**-0.5),
            "bias": np.zeros(6 * h, np.float32),
            "ahead": draw(h, 3 * h, scale=h**-0.5),
            "back": draw(h, 3 * h, scale=h**-0.5),
            "look": draw(2 * h, 2 * h, scale=(2 * h) ** -0.5),
            "look_bias": np.zeros(2 * h, np.float32),
            "weigh": draw(2 * h, scale=(2 * h) ** -0.5),
            "out": draw(2 * h, scale=(2 * h) ** -0.5),
            "out_bias": np.full(1, -1, np.float32),
        }
        self.p["word"][0] = 0

    @classmethod
    def of(cls, words: list[bytes], parameters: dict[str, np.ndarray]) -> Network:
        network = cls([])
        network.vocabulary = {w: i + 1 for i, w in enumerate(words)}
        network.p = parameters
        return network

    def vectors(self, words: list[bytes]):
        """Input vectors of words, and what their gradient needs."""
        own = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        grams, counts = gram_rows(words)
        owner = np.repeat(np.arange(len(words)), counts)
        total = np.zeros((len(words), WIDTH), np.float32)
        if len(grams):
            has = np.flatnonzero(counts)
            first = np.concatenate([[0], np.cumsum(counts[has])[:-1]])
            total[has] = np.add.reduceat(self.p["gram"][grams], first, axis=0)
        total /= np.maximum(counts, 1)[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][own], total], 1), (own, grams, owner, counts)

    def project(self, words: list[bytes]) -> np.ndarray:
        """Input products of words for all gates of both directions. Grams are many times the words'
        size, so they are summed for some words at a time."""
        inputs = np.empty((len(words), 2 * WIDTH), np.float32)
        for start in range(0, len(words), _PART):
            inputs[start : start + _PART] = self.vectors(words[start : start + _PART])[0]
        return inputs @ self.p["input"] + self.p["bias"]

    def _pass(self, x, mask, weights, order, keep):
        n, h = x.shape[0], HIDDEN
        state = np.zeros((n, h), np.float32)
        out, saved = np.zeros((n, x.shape[1], h), np.float32), {}
        for t in order:
            rec = state @ weights
            zr = _sigmoid(x[:, t, : 2 * h] + rec[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, t, 2 * h :] + r * rec[:, 2 * h :])
            m = mask[:, t, None]
            following = state + m * (1 - z) * (new - state)
            if keep:
                saved[t] = (state, z, r, new, rec[:, 2 * h :])
            state = following
            out[:, t] = state
        return out, saved

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Scores of windows from their input products (window, place, gate)."""
        h, length = HIDDEN, x.shape[1]
        one, s1 = self._pass(x[:, :, : 3 * h], mask, self.p["ahead"], range(length), keep)
        two, s2 = self._pass(x[:, :, 3 * h :], mask, self.p["back"], range(length - 1, -1, -1), keep)
        both = np.concatenate([one, two], 2)
        seen = np.tanh(both @ self.p["look"] + self.p["look_bias"])
        weight = seen @ self.p["weigh"] + (mask - 1) * 1e9
        weight = np.exp(weight - weight.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = (both * weight[:, :, None]).sum(1)
        score = _sigmoid(pooled @ self.p["out"] + self.p["out_bias"][0])
        return score, (s1, s2, both, seen, weight, pooled)

    def gradients(self, x, mask, target):
        """Loss gradients of the parameters behind ``x``, and of ``x``."""
        score, (s1, s2, both, seen, weight, pooled) = self.forward(x, mask, True)
        n, h, g = len(target), HIDDEN, {}
        d = ((score - target) / n).astype(np.float32)
        g["out"], g["out_bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * self.p["out"]
        dboth = weight[:, :, None] * dpool[:, None, :]
        dweight = (both * dpool[:, None, :]).sum(2)
        dlogit = weight * (dweight - (weight * dweight).sum(1, keepdims=True))
        g["weigh"] = np.einsum("ntk,nt->k", seen, dlogit)
        dseen = dlogit[:, :, None] * self.p["weigh"] * (1 - seen**2)
        flat = both.reshape(-1, 2 * h)
        g["look"] = flat.T @ dseen.reshape(-1, 2 * h)
        g["look_bias"] = dseen.sum((0, 1))
        dboth = dboth + dseen @ self.p["look"].T
        dx = np.zeros_like(x)
        length = x.shape[1]
        for name, saved, at, order in (
            ("ahead", s1, 0, range(length - 1, -1, -1)),
            ("back", s2, 1, range(length)),
        ):
            weights, gw = self.p[name], np.zeros_like(self.p[name])
            ds = np.zeros((n, h), np.float32)
            for t in order:
                state, z, r, new, rec = saved[t]
                ds = ds + dboth[:, t, at * h : (at + 1) * h]
                m = mask[:, t, None]
                dn = ds * m * (1 - z) * (1 - new**2)
                dz = ds * m * (state - new) * z * (1 - z)
                dr = dn * rec * r * (1 - r)
                inputs = np.concatenate([dz, dr, dn], 1)
                recurrent = np.concatenate([dz, dr, dn * r], 1)
                dx[:, t, at * 3 * h : (at + 1) * 3 * h] = inputs
                gw += state.T @ recurrent
                ds = ds * (1 - m * (1 - z)) + recurrent @ weights.T
            g[name] = gw
        return g, dx

    def step(self, texts: list[list[bytes]], target: np.ndarray):
        """Gradients of all parameters for one batch of windows."""
        distinct = sorted({w for t in texts for w in t})
        index = {w: i for i, w in enumerate(distinct)}
        vec, (own, grams, owner, counts) = self.vectors(distinct)
        rows, mask = padded([[index[w] for w in t] for t in texts])
        g, dx = self.gradients((vec @ self.p["input"] + self.p["bias"])[rows], mask, target)
        dproj = np.zeros((len(distinct), dx.shape[2]), np.float32)
        np.add.at(dproj, rows[mask > 0], dx[mask > 0])
        g["input"], g["bias"] = vec.T @ dproj, dproj.sum(0)
        dvec = dproj @ self.p["input"].T
        g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        np.add.at(g["word"], own, dvec[:, :WIDTH])
        g["word"][0] = 0
        np.add.at(g["gram"], grams, (dvec[:, WIDTH:] / np.maximum(counts, 1)[:, None])[owner])
        return g


def padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(rows), WINDOW), np.int64)
    mask = np.zeros((len(rows), WINDOW), np.float32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
        mask[i, : len(r)] = 1
    return out, mask


class Scorer:
    """Scores whole texts; remembers the input products of words."""

    def __init__(self, network: Network):
        self.network, self.index = network, {}
        # filled from the front, so that few new words copy nothing; row 0 is a place without a word
        self.rows = np.zeros((1, 6 * HIDDEN), np.float32)

    def _numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.index) > _CACHE:
            self.index = {}
        index = self.index
        new = list({w for t in texts for w in t if w not in index})
        used = len(index) + 1
        if used + len(new) > len(self.rows):
            room = np.empty((used + len(new) + _PART, 6 * HIDDEN), np.float32)
            room[:used] = self.rows[:used]
            self.rows = room
        for start in range(0, len(new), 50_000):
            part = new[start : start + 50_000]
            at = used + start
            index.update(zip(part, range(at, at + len(part))))
            self.rows[at : at + len(part)] = self.network.project(part)
        return [np.array([index[w] for w in t], np.int64) for t in texts]

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Scores of all windows, and how many each text has."""
        numbers = self._numbers([alnum_words(t) for t in texts])
        spans = [windows(len(t)) for t in numbers]
        counts = [len(s) for s in spans]
        total = sum(counts)
        rows = np.zeros((total, WINDOW), np.int64)
        i = 0
        for t, own in zip(numbers, spans):
            for s, e in own:
                rows[i, : e - s] = t[s:e]
                i += 1
        scores = np.zeros(total, np.float32)
        for start in range(0, total, 512):
            part = rows[start : start + 512]
            scores[start : start + 512] = self.network.forward(self.rows[part], (part > 0).astype(np.float32))[0]
        return scores, counts

    def score(self, texts: list[bytes]) -> list[float]:
        scores, counts = self.windows(texts)
        out, at = [], 0
        for c in counts:
            out.append(float(scores[at : at + c].max()) if c else 0.0)
            at += c
        return out


def _scores(network: Network, flat: list[list[bytes]]) -> np.ndarray:
    """Scores of windows that are held as words. A slice of them is scored at a time, and the input
    products of its words go with it."""
    slices = (flat[at : at + SLICE] for at in range(0, len(flat), SLICE))
    return np.concatenate([Scorer(network).windows([b" ".join(t) for t in part])[0] for part in slices])


def train(sample: list[tuple[list[bytes], int]], rounds: int = ROUNDS, seed: int = 7) -> Network | None:
    """Fit on (windows of a document, label); None if a class is missing."""
    if len({y for _, y in sample}) < 2:
        return None
    seen: dict[bytes, int] = {}
    for texts, _ in sample:
        for w in {w for t in texts for w in alnum_words(t)}:
            seen[w] = seen.get(w, 0) + 1
    network = Network(sorted(w for w, n in seen.items() if n >= 5), seed)
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    label = np.array([y for _, y in sample], np.float32)
    # every distinct word is held once, the windows refer to it
    held: dict[bytes, bytes] = {}
    flat = [[held.setdefault(w, w) for w in alnum_words(t)] for texts, _ in sample for t in texts]
    counts = np.array([len(texts) for texts, _ in sample])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    steps = 0
    for r in range(rounds):
        if r == 0:
            chosen = first + rng.integers(0, counts)
        else:
            scores = _scores(network, flat)
            chosen = np.array([f + int(np.argmax(scores[f : f + c])) for f, c in zip(first, counts)])
        # a small sample is gone through more than once
        order = np.resize(rng.permutation(len(sample)), max(len(sample), LEAST_STEPS * BATCH))
        for start in range(0, len(order), BATCH):
            at = order[start : start + BATCH]
            g = network.step([flat[chosen[i]] for i in at], label[at])
            norm = float(np.sqrt(sum(float((v**2).sum()) for v in g.values())))
            steps += 1
            rate = 0.01 * (1 - r / (rounds + 1))
            for k, v in g.items():
                v = v * min(1.0, 5 / (norm + 1e-9))
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                network.p[k] -= (
                    rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)
                ).astype(np.float32)
    return network


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def spaced(text: bytes, most: int) -> list[bytes]:
    """At most ``most`` windows of a text, evenly over its whole length."""
    words = alnum_words(text)
    own = windows(len(words))
    if len(own) > most:
        own = [own[round(i * (len(own) - 1) / (most - 1))] for i in range(most)]
    return [b" ".join(words[s:e]) for s, e in own]


def fit(
    documents: DataFrame,
    labels: DataFrame,
    rows: int = ROWS,
    rounds: int = ROUNDS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Network | None:
    """Train on a bounded sample of labelled rows that are not held out.

    The ids of each class with the lowest hashes are chosen from the labels alone and sent to the
    documents, which are scanned without a shuffle. A doc_id labelled more than once counts as
    toxic if one of its labels says so; null labels and ids are left out; null texts give no window.
    Of several texts under one chosen id the one with the lowest hash is taken, so at most
    ``2 * rows`` texts reach the driver.
    """
    bounded_batches(documents.sparkSession)
    known = (
        labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col("toxic").cast("int").alias("y"))
        .filter("id is not null and y is not null")
        .filter(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    # at most 2 * rows rows, so the broadcast and what reaches the driver are bounded
    ids = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows)
        ids = part if ids is None else ids.unionByName(part)
    found = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("t")).join(
        F.broadcast(ids), "id"
    )
    one = found.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("one"))
    found = one.select("id", F.col("one.t").alias("t"), "y")

    def cut(batches):
        for batch in sliced(batches, "t"):
            own = [spaced(t, WINDOWS) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(own, pa.list_(pa.binary()))],
                names=["id", "y", "own"],
            )

    cut_rows = found.mapInArrow(cut, "id bigint, y int, own array<binary>").collect()
    sample = sorted({(r.id, r.y, tuple(bytes(w) for w in r.own)) for r in cut_rows if r.own})
    return train([(list(own), y) for _, y, own in sample], rounds)


def score(df: DataFrame, network: Network | None, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score of every whole text: 0 for null, empty and wordless ones or without a model.

    Rows are scored one by one: repeated rows repeat the score. A column named like the score is
    replaced.
    """
    # plain data: a few megabytes, bounded by the sample and the number of grams
    shipped = df.sparkSession.sparkContext.broadcast(
        None if network is None else (list(network.vocabulary), network.p)
    )

    def make():
        if shipped.value is None:
            return lambda texts: [[0.0] * len(texts)]
        words, parameters = shipped.value
        stamp = zlib.crc32(parameters["out"].tobytes() + parameters["input"].tobytes())
        scorer = worker_cache(f"toxicity:{stamp}", lambda: Scorer(Network.of(words, parameters)))
        return lambda texts: [scorer.score(texts)]

    return map_text(df, text, [StructField(name, DoubleType(), False)], make)
