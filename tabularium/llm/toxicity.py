"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and applied in numpy.

A word comes in twice: as an embedding of its hash, and as the mean embedding of its character n-grams (four bytes). A window of
``WINDOW`` words is read in both directions by gated recurrent units, its states are pooled by attention, and a linear
layer scores it. All windows of a text, each overlapping half of the next, are scored; the text's score is that of its
worst window, brought to a probability by a logistic curve fitted at the labels' own proportions.

Labels are of documents, so training picks windows: of a toxic document the one that scores highest so far, of others
their highest and some at random. The first coordinate of both embeddings starts as the log-odds of the bucket among
the training documents, by which the first windows are picked.

Defined cases: a null text, and one without words, is one window of nothing; shorter texts than a window are one
shorter window; of a long text all windows are scored; with one label only, or none, every score is that label's share
(0.5 if there is none); labels other than 0 and 1 (null too) aren't learned from; of a key with several texts one is
learned from; repeated rows stay; a null key isn't held out, and keys may be of any type; an empty table gives no rows;
columns other than key and text are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER_ASCII, joined, runs, span_hashes
from .quality import labelled_sample, logistic, score_documents

WINDOW, STRIDE = 24, 12
#: Buckets and sizes of the two embeddings, and the size of a direction's state.
WORDS, CHARS, WIDTH, STATE = 1 << 16, 1 << 15, 6, 8
#: Most labelled documents of each label that are fitted on (excerpts of very long ones).
PER_LABEL = 2400
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.01, 42
#: Windows that are read in step.
LANES = 2048
LETTER = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])


@dataclass
class Windows:
    """Texts as windows of distinct words."""

    word: np.ndarray  # bucket of each distinct word
    gram: np.ndarray  # buckets of the character n-grams of all distinct words, one word after the other
    gram_at: np.ndarray  # where each distinct word's character n-grams begin (and the end)
    at: np.ndarray  # windows x WINDOW: distinct word + 1, or 0 beyond the end
    doc: np.ndarray  # of each window


def windows(texts: list[str | None]) -> Windows:
    data, starts = joined(texts)
    data = np.frombuffer(data.tobytes().translate(LOWER_ASCII), np.uint8)
    begin, end = runs(LETTER[data])
    hashes = span_hashes(data, begin, end)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    doc = np.searchsorted(starts, begin, "right") - 1
    n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    offset = np.concatenate(([0], np.cumsum(n)))
    per = np.maximum(1, -(-(n - STRIDE) // STRIDE))
    of = np.repeat(np.arange(len(texts)), per)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    at = (offset[of] + nth * STRIDE)[:, None] + np.arange(WINDOW)
    inside = at < offset[of + 1][:, None]
    padded = np.append(number + 1, 0)
    at = np.where(inside, padded[np.minimum(at, len(number))], 0).astype(np.int32)
    a, b = begin[first], end[first]
    size = b - a  # an n-gram for each byte: the one before, itself and the two after, blank beyond the word
    gram_at = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(gram_at[-1]) - np.repeat(gram_at[:-1] - a, size)
    blank = np.array([32], np.uint8)
    around = np.concatenate((blank, np.where(LETTER[data], data, np.uint8(32)), blank, blank))
    gram = around[place].astype(np.int64)
    for k in (1, 2, 3):
        gram = gram << 8 | around[place + k]
    gram = (gram * 2654435761 >> 13 & CHARS - 1).astype(np.int32)
    return Windows((distinct % np.uint64(WORDS)).astype(np.int64), gram, gram_at, at, of)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters by name, forward pass, and gradients."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {"word": small(WORDS, WIDTH), "char": small(CHARS, WIDTH), "attend": small(2 * STATE), "out": small(2 * STATE), "bias": np.zeros(1, np.float32)}
        for d in ("f", "b"):
            w = small(2 * WIDTH, 3 * STATE)
            w[0] += rng.standard_normal(3 * STATE) * 0.5  # the coordinates that start as log-odds
            w[WIDTH] += rng.standard_normal(3 * STATE) * 0.25
            self.p |= {f"in_{d}": w, f"rec_{d}": small(STATE, 3 * STATE) * 3, f"b_{d}": np.zeros(3 * STATE, np.float32)}

    def inputs(self, w: Windows) -> np.ndarray:
        """Word and character embedding of each distinct word."""
        total = np.add.reduceat(self.p["char"][w.gram], w.gram_at[:-1], axis=0) if len(w.word) else np.zeros((0, WIDTH), np.float32)
        return np.hstack([self.p["word"][w.word], total / np.maximum(1, np.diff(w.gram_at))[:, None]]).astype(np.float32)

    def project(self, w: Windows) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The inputs of all distinct words, and what they bring to the gates of either direction (row 0: no word)."""
        x = self.inputs(w)
        return x, {d: np.vstack([np.zeros((1, 3 * STATE), np.float32), x @ self.p[f"in_{d}"] + self.p[f"b_{d}"]]) for d in "fb"}

    def scores(self, w: Windows) -> np.ndarray:
        """The scores of all windows."""
        made = self.project(w)
        return np.concatenate([self.forward(made, w.at[a : a + LANES]) for a in range(0, len(w.at), LANES)])

    def forward(self, made: tuple[np.ndarray, dict[str, np.ndarray]], at: np.ndarray, keep: bool = False):
        """The score of each window before the curve, and what ``backward`` needs."""
        x, projections = made
        mask = at > 0
        full = mask.all(axis=0)
        states, tape = np.zeros((WINDOW, len(at), 2 * STATE), np.float32), []
        for k, d in enumerate("fb"):
            proj = projections[d]
            h, u = np.zeros((len(at), STATE), np.float32), self.p[f"rec_{d}"]
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g, r = proj[at[:, t]], h @ u
                zr = _sigmoid(g[:, : 2 * STATE] + r[:, : 2 * STATE])
                z, reset = zr[:, :STATE], zr[:, STATE:]
                new = np.tanh(g[:, 2 * STATE :] + reset * r[:, 2 * STATE :])
                nxt = new + z * (h - new)
                m = mask[:, t, None]
                if not full[t]:
                    nxt = np.where(m, nxt, h)
                if keep:
                    tape.append((d, t, h, z, reset, new, r[:, 2 * STATE :], m))
                h = nxt
                states[t, :, k * STATE : (k + 1) * STATE] = h
        a = np.where(mask.T, states @ self.p["attend"], -30)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * states).sum(axis=0)
        score = pooled @ self.p["out"] + self.p["bias"]
        return (score, (x, states, a, pooled, tape)) if keep else score

    def backward(self, w: Windows, at: np.ndarray, kept, dscore: np.ndarray) -> dict[str, np.ndarray]:
        x, states, a, pooled, tape = kept
        g = {"out": pooled.T @ dscore, "bias": dscore.sum(keepdims=True)}
        dpool = dscore[:, None] * self.p["out"]
        dstates = a[:, :, None] * dpool
        da = (states * dpool).sum(axis=2)
        da = a * (da - (a * da).sum(axis=0))
        g["attend"] = np.einsum("tnk,tn->k", states, da)
        dstates += da[:, :, None] * self.p["attend"]
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = self.p[f"rec_{d}"]
            dproj, du, carry = np.zeros((len(x) + 1, 3 * STATE), np.float32), np.zeros_like(u), np.zeros((len(at), STATE), np.float32)
            for _, t, h, z, reset, new, rn, m in reversed([s for s in tape if s[0] == d]):
                dh = carry + dstates[t, :, k * STATE : (k + 1) * STATE]
                dn = np.where(m, dh, 0)
                dnew = dn * (1 - z) * (1 - new * new)
                dz = dn * (h - new) * z * (1 - z)
                dr = dnew * rn * reset * (1 - reset)
                dg = np.hstack([dz, dr, dnew])
                drec = np.hstack([dz, dr, dnew * reset])
                np.add.at(dproj, at[:, t], dg)
                du += h.T @ drec
                carry = np.where(m, dh * z + drec @ u.T, dh)
            dproj = dproj[1:]
            g |= {f"rec_{d}": du, f"in_{d}": x.T @ dproj, f"b_{d}": dproj.sum(axis=0)}
            dx += dproj @ self.p[f"in_{d}"].T
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        used = np.unique(at[at > 0]) - 1
        np.add.at(g["word"], w.word[used], dx[used, :WIDTH])
        for i in used.tolist():
            s, e = w.gram_at[i], w.gram_at[i + 1]
            np.add.at(g["char"], w.gram[s:e], dx[i, WIDTH:] / (e - s))
        return g


@dataclass
class Model:
    network: Network | None
    curve: np.ndarray
    constant: float | None = None

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """The highest window score of each text."""
        w = windows(texts)
        s = self.network.scores(w)
        return np.maximum.reduceat(s, np.flatnonzero(np.concatenate(([True], np.diff(w.doc) > 0))))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text's label is 1."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        s = self.raw(texts)
        return _sigmoid(np.clip(np.column_stack([np.ones(len(s)), s]) @ self.curve, -30, 30))


def _log_odds(present: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds of toxic among the documents that hold each bucket, shrunk where few do."""
    n = [np.zeros(size), np.zeros(size)]
    for buckets, label in zip(present, y.tolist()):
        n[label][np.unique(buckets)] += 1
    total = [max(1, (y == k).sum()) for k in (0, 1)]
    return np.clip(np.log((n[1] / total[1] + 2 / total[1]) / (n[0] / total[0] + 2 / total[0])), -3, 3)


def fit(rows: list[tuple[str | None, int]], counts: dict[int, int], *, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    y = np.array([label for _, label in rows])
    if len(set(y.tolist())) < 2:
        return Model(None, np.zeros(2), float(y[0]) if len(y) else 0.5)
    rng, net = np.random.default_rng(seed), Network(seed)
    texts = [t for t, _ in rows]
    w = windows(texts)
    words = [np.unique(w.at[a:b]) for a, b in zip(*_bounds(w.doc))]
    words = [x[x > 0] - 1 for x in words]
    by_word = _log_odds([w.word[x] for x in words], y, WORDS)
    by_char = _log_odds([np.concatenate([w.gram[w.gram_at[i] : w.gram_at[i + 1]] for i in x.tolist()] or [np.zeros(0, np.int64)]) for x in words], y, CHARS)
    net.p["word"][:, 0], net.p["char"][:, 0] = by_word, by_char
    begin, end = _bounds(w.doc)
    odds = np.append(0, by_word[w.word])
    score = odds[w.at].max(axis=1)
    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        best = np.array([a + int(score[a:b].argmax()) for a, b in zip(begin, end)])
        some = np.array([rng.integers(a, b) for a, b in zip(begin, end)])
        rest = score.copy()
        rest[best] = -np.inf
        second = np.array([a + int(rest[a:b].argmax()) for a, b in zip(begin, end)])
        pick = np.concatenate([best, second[y == 0], some[y == 0]])
        target = np.concatenate([y, np.zeros(2 * (y == 0).sum())]).astype(np.float32)
        order = rng.permutation(len(pick))
        for a in range(0, len(order), BATCH):
            i = order[a : a + BATCH]
            at = w.at[pick[i]]
            sub, at = _only(w, at)
            s, kept = net.forward(net.project(sub), at, keep=True)
            g = net.backward(sub, at, kept, ((_sigmoid(s) - target[i]) / len(i)).astype(np.float32))
            step += 1
            for k, v in g.items():
                m = adam[k]
                m[0] += 0.1 * (v - m[0])
                m[1] += 0.01 * (v * v - m[1])
                net.p[k] -= (RATE * (1 - epoch / epochs * 0.8) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        score = net.scores(w)
    model = Model(net, np.zeros(2))
    s = model.raw(texts)
    weight = np.array([counts[k] for k in y.tolist()]) / np.array([(y == k).sum() for k in y.tolist()])
    model.curve = logistic(np.column_stack([np.ones(len(s)), s]), y.astype(float), weight * len(y) / weight.sum())
    return model


def _bounds(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(doc)) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(doc)]))


def _only(w: Windows, at: np.ndarray) -> tuple[Windows, np.ndarray]:
    """The same windows over just the words that they hold."""
    used, number = np.unique(at, return_inverse=True)
    number = number.reshape(at.shape)
    words = used[used > 0] - 1
    if not len(used) or used[0] > 0:
        number = number + 1
    size = np.diff(w.gram_at)[words]
    gram_at = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(gram_at[-1]) - np.repeat(gram_at[:-1] - w.gram_at[words], size)
    return Windows(w.word[words], w.gram[place], gram_at, at, np.zeros(0)), number


def document_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, modulus: int = 3, held: int = 1, threshold: float = 0.7, per_label: int = PER_LABEL) -> DataFrame:
    """Scores of all documents by a network learned from ``labels.toxic`` of those not held out."""
    rows, counts = labelled_sample(spark, docs, labels, "toxic", modulus, held, per_label)
    return score_documents(spark, docs, fit(rows, counts), threshold, modulus, held)
