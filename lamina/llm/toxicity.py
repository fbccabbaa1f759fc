"""Toxicity scores of overlapping windows by a bidirectional gated recurrent network with attention pooling.

Inputs of a word come from its characters and from the word as a whole: evidence of its byte n-grams and of the
word (lower bounds of the log-odds of their document frequencies in labelled documents) and learnt embeddings of both. The
network reads WINDOW words at a time, all overlapping windows (one every STRIDE = 1 words) of the whole text; attention pools its states
into the window's logit, and a document's score is the calibrated logit of its most toxic window. All is trained
in numpy on a bounded sample of labelled rows: most of it gives the evidence and trains the network, each document by
the evidence of the folds that it isn't in; a toxic document stands for its highest windows (of those every LEARNT_STRIDE
words); what is left calibrates, on all windows.
Training is one task on an executor, whose memory the sample's bounds bound; the driver only passes the model on.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, give_back, held, row_of, settled, table, tune, without
from .quality import held_out, labelled

#: Labelled rows to learn from, at most: of label 1, of label 0. Rows are taken in the order of a hash of their ids,
#: whatever their texts; the sample of a label ends with the row that brings it to SAMPLE_BYTES of text.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 1500, 3000, 24 << 20
#: Words of a window and from one window to the next; size of the state in each direction.
WINDOW, STRIDE, STATE = 16, 1, 8
#: Words from one window to the next among those that the network learns from.
LEARNT_STRIDE = 8
#: Features kept as evidence at most (a fixed size), slots of the sieve before them and of the embeddings; size of an embedding.
EVIDENCE, SIEVE, SLOTS, EMBED = 100_000, 1 << 22, 1 << 13, 4
#: Lengths of byte n-grams; documents of label 1 that a feature needs to count as evidence.
GRAMS, LEAST_DOCS = (3, 4, 5), 3
EPOCHS, RATE, BATCH, SEED = 8, 0.01, 256, 11
#: Parts of the sample whose evidence comes from the others while the network learns.
FOLDS = 5
#: Epochs in which the evidence alone chooses the window that stands for a document.
TRUSTED = 4
#: Bytes of words with their inputs that a worker keeps (a word takes WORD_BYTES and its own); windows that the network
#: reads, and words that are hashed, at once.
CACHE_BYTES, WORD_BYTES, AT_ONCE, WORDS_AT_ONCE = 48 << 20, 400, 2048, 20_000
THRESHOLD = 0.5

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PLAIN).split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, word by word; where each word's begin; hashes of the words."""
    sizes = np.array([len(w) + 3 for w in words], np.int64)
    flat = np.frombuffer(b"<<" + b"><<".join(words) + b">", np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    end_of = np.repeat(ends, sizes)
    word_of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat))
    prime = np.uint64(1099511628211)
    which, hashes = [], []
    h = flat + np.uint64(1)
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * prime + flat[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            ok = place[: len(h)] + n <= end_of[: len(h)]
            which.append(word_of[: len(h)][ok])
            hashes.append(h[ok] + np.uint64(n))
    which, hashes = np.concatenate(which), np.concatenate(hashes)
    order = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[order], np.arange(len(words)))
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(flat) - 1, prime)])
    whole = np.add.reduceat((flat + np.uint64(1)) * powers[place - np.repeat(ends - sizes, sizes)], ends - sizes)
    return _mixed(hashes[order]), starts, _mixed(whole + np.uint64(77))


class Evidence:
    """Lower bounds of the log-odds of document frequencies of n-grams and words, by their 64-bit hashes."""

    def __init__(self, known: np.ndarray, p: np.ndarray, n: np.ndarray, toxic: float, clean: float):
        """Of features' hashes in order: how many of so many documents of label 1 and of label 0 have them."""
        odds = np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))
        z = odds - 2 * np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        z[p < LEAST_DOCS] = 0
        best = np.flatnonzero(z > 0)
        best = best[np.argsort(-z[best], kind="stable")[:EVIDENCE]]
        best.sort()
        self.hashes, self.z = known[best], z[best].astype(np.float32)
        self._sieve()

    def _sieve(self) -> None:
        self.maybe = np.zeros(SIEVE, bool)  # most hashes are told apart here, the rest by search
        self.maybe[(self.hashes % np.uint64(SIEVE)).astype(np.int64)] = True

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "z": self.z}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._sieve()

    @classmethod
    def of_documents(cls, docs: list[list[bytes]], y: np.ndarray, fold: np.ndarray | None = None) -> list[Evidence]:
        """That of all documents, and for each fold that of the documents outside it."""
        fold = np.zeros(len(docs), int) if fold is None else fold
        folds = int(fold.max()) + 1
        # one document at a time: first what LEAST_DOCS documents of label 1 have, then how many of label 0 have that
        known, p = np.zeros(0, np.uint64), np.zeros((folds, 0), np.int16)
        waiting: list[np.ndarray] = []
        whose: list[int] = []
        toxic = np.flatnonzero(y == 1)
        for at, i in enumerate(toxic.tolist()):
            waiting.append(cls._distinct(docs[i]))
            whose.append(fold[i])
            if len(waiting) == 64 or at + 1 == len(toxic):
                both, inverse = np.unique(np.concatenate([known, *waiting]), return_inverse=True)
                more = np.zeros((folds, len(both)), np.int16)
                more[:, inverse[: len(known)]] = p
                np.add.at(more, (np.repeat(whose, [len(w) for w in waiting]), inverse[len(known) :]), 1)
                known, p, waiting, whose = both, more, [], []
        often = p.sum(0) >= LEAST_DOCS
        known, p = known[often], p[:, often]
        n = np.zeros((folds, len(known)), np.int16)
        for i in np.flatnonzero(y == 0).tolist() if len(known) else []:
            own = cls._distinct(docs[i])
            found = np.minimum(np.searchsorted(known, own), len(known) - 1)
            n[fold[i], found[known[found] == own]] += 1
        out = []
        for k in range(-1, folds if folds > 1 else 0):
            off = fold == k
            gone = (p[k], n[k]) if k >= 0 else (0, 0)
            out.append(cls(known, (p.sum(0) - gone[0]).astype(float), (n.sum(0) - gone[1]).astype(float), y[~off].sum(), (1 - y[~off]).sum()))
        return out

    @staticmethod
    def _distinct(words: list[bytes]) -> np.ndarray:
        """Hashes of all n-grams and words of a document."""
        if not words:
            return np.zeros(0, np.uint64)
        grams, _, whole = features(sorted(set(words)))
        return np.unique(np.r_[grams, whole])

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.float32)
        at = np.flatnonzero(self.maybe[(hashes % np.uint64(SIEVE)).astype(np.int64)])
        if len(at):
            found = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[found] == hashes[at], self.z[found], 0)
        return out

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Fixed inputs of each word; slots of its n-grams, where they begin, slot of the word."""
        if len(words) > WORDS_AT_ONCE:
            return _joined([self.inputs(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)])
        grams, starts, whole = features(words)
        z = self.of(grams)
        top = np.maximum.reduceat(z, starts)
        mean = np.add.reduceat(z, starts) / np.diff(np.r_[starts, len(grams)])
        fixed = np.stack([top / 2, mean / 2, self.of(whole) / 2, np.array([len(w) for w in words]) / 16], 1).astype(np.float32)
        return fixed, (grams % np.uint64(SLOTS)).astype(np.int32), starts, (whole % np.uint64(SLOTS)).astype(np.int32)


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of several lists of words as those of one list."""
    before = np.cumsum([0, *(len(g) for _, g, _, _ in parts)])
    return tuple(np.concatenate([p[k] + before[i] if k == 2 else p[k] for i, p in enumerate(parts)]) for k in range(4))


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


FIXED = 4
INPUT = FIXED + 2 * EMBED


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self):
        rng = np.random.default_rng(SEED)
        draw = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"gram": draw(SLOTS, EMBED), "word": draw(SLOTS, EMBED)}  # small, and slow to learn: the evidence leads
        for d in "fb":
            self.p |= {f"W{d}": draw(INPUT, 3 * STATE), f"U{d}": draw(STATE, 3 * STATE), f"c{d}": np.zeros(3 * STATE, np.float32)}
        self.p |= {"a": draw(2 * STATE), "o": draw(2 * STATE), "o0": np.zeros(1, np.float32)}
        self.step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.t = 0

    def embed(self, inputs: tuple) -> np.ndarray:
        fixed, grams, starts, word = inputs
        n = np.diff(np.r_[starts, len(grams)])[:, None]
        return np.hstack([fixed, np.add.reduceat(self.p["gram"][grams], starts, axis=0) / n, self.p["word"][word]]).astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Of words' inputs, what both directions add at each step."""
        return np.hstack([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]])

    def forward(self, proj: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows; ids (windows, WINDOW) index proj, size words of each are real and come first."""
        n, S = len(ids), STATE
        states = np.zeros((WINDOW, n, 2 * S), np.float32)
        tape = {}
        for d, off in (("f", 0), ("b", 3 * S)):
            U, h = self.p[f"U{d}"], np.zeros((n, S), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                on = (t < size)[:, None]
                x, u = proj[ids[:, t], off : off + 3 * S], h @ U
                zr = _sigmoid(x[:, : 2 * S] + u[:, : 2 * S])
                c = np.tanh(x[:, 2 * S :] + zr[:, S:] * u[:, 2 * S :])
                new = np.where(on, c + zr[:, :S] * (h - c), h)
                if keep:
                    tape[d, t] = on, h, zr, c, u
                states[t, :, off // 3 : off // 3 + S] = h = new
        score = states @ self.p["a"] + np.where(np.arange(WINDOW)[:, None] < size, 0, -1e9).astype(np.float32)
        e = np.exp(score - score.max(0))
        alpha = e / e.sum(0)
        pooled = np.einsum("tn,tnk->nk", alpha, states)
        logit = pooled @ self.p["o"] + self.p["o0"]
        return (logit, (states, alpha, pooled, tape)) if keep else logit

    def slide(self, proj: np.ndarray) -> np.ndarray:
        """Logits of all windows of WINDOW words in a row of words (as projected), as forward() has them but for rounding."""
        n, S = len(proj) - WINDOW + 1, STATE
        x = np.ascontiguousarray(proj.T)  # windows side by side: step t of all of them is a slice
        for off in (0, 3 * S):  # the gates' inputs are negative, as their exponential is taken
            np.negative(x[off : off + 2 * S], out=x[off : off + 2 * S])
        score, value = np.zeros((WINDOW, n), np.float32), np.zeros((WINDOW, n), np.float32)
        for d, off in (("f", 0), ("b", 3 * S)):
            own = slice(off // 3, off // 3 + S)
            U = self.p[f"U{d}"].T.copy()
            U[: 2 * S] *= -1
            both = np.ascontiguousarray(np.vstack([U, self.p["a"][own], self.p["o"][own]]))
            h, u, zr, c = np.zeros((S, n), np.float32), np.zeros((3 * S + 2, n), np.float32), np.empty((2 * S, n), np.float32), np.empty((S, n), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                np.add(x[off : off + 2 * S, t : t + n], u[: 2 * S], out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.multiply(zr[S:], u[2 * S : 3 * S], out=c)
                c += x[off + 2 * S : off + 3 * S, t : t + n]
                np.tanh(c, out=c)
                h -= c
                h *= zr[:S]
                h += c
                np.matmul(both, h, out=u)
                score[t] += u[3 * S]
                value[t] += u[3 * S + 1]
        score -= score.max(0)
        np.exp(score, out=score)
        value *= score
        return value.sum(0) / score.sum(0) + self.p["o0"]

    def train(self, inputs: tuple, ids: np.ndarray, size: np.ndarray, y: np.ndarray) -> None:
        """One step of Adam on cross-entropy; inputs are those of the words that ids index."""
        S, p = STATE, self.p
        x = self.embed(inputs)
        proj = self.projected(x)
        logit, (states, alpha, pooled, tape) = self.forward(proj, ids, size, True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["o"], g["o0"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["o"]
        dalpha = np.einsum("nk,tnk->tn", dpool, states)
        dscore = alpha * (dalpha - (alpha * dalpha).sum(0))
        g["a"] = np.einsum("tn,tnk->k", dscore, states)
        dstates = alpha[:, :, None] * dpool + dscore[:, :, None] * p["a"]
        dproj = np.zeros_like(proj)
        for d, off in (("f", 0), ("b", 3 * S)):
            U, dh = p[f"U{d}"], np.zeros((len(ids), S), np.float32)
            for t in range(WINDOW - 1, -1, -1) if d == "f" else range(WINDOW):
                on, h, zr, c, u = tape[d, t]
                dh = dh + dstates[t, :, off // 3 : off // 3 + S]
                z, r = zr[:, :S], zr[:, S:]
                live = np.where(on, dh, 0)
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (h - c) * z * (1 - z)
                dr = dc * u[:, 2 * S :] * r * (1 - r)
                du = np.hstack([dz, dr, dc * r])
                np.add.at(dproj[:, off : off + 3 * S], ids[:, t], np.hstack([dz, dr, dc]))
                g[f"U{d}"] += h.T @ du
                dh = np.where(on, live * z + du @ U.T, dh)
            part = dproj[:, off : off + 3 * S]
            g[f"W{d}"], g[f"c{d}"] = x.T @ part, part.sum(0)
        dx = dproj[:, : 3 * S] @ p["Wf"].T + dproj[:, 3 * S :] @ p["Wb"].T
        fixed, grams, starts, word = inputs
        n = np.diff(np.r_[starts, len(grams)])
        np.add.at(g["gram"], grams, np.repeat(dx[:, FIXED : FIXED + EMBED] / n[:, None], n, axis=0))
        np.add.at(g["word"], word, dx[:, FIXED + EMBED :])
        self.t += 1
        for k, v in g.items():
            m, s = self.step[k]
            m += 0.1 * (v - m)
            s += 0.001 * (v * v - s)
            p[k] -= (RATE if k not in ("gram", "word") else RATE / 50) * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)


def windows(n: int, stride: int = STRIDE) -> list[int]:
    """Starts of the windows of n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, stride), n - WINDOW]


def _layout(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of the windows to learn from of documents (word numbers), how many are real, and the documents' windows' starts."""
    ids, sizes, at = [], [], [0]
    for d in docs:
        n = len(d)
        if n <= WINDOW:
            ids.append(np.pad(d, (0, WINDOW - n))[None])
            sizes.append(np.array([max(n, 1)]))
            at.append(at[-1] + 1)
        else:
            s = np.array(windows(n, LEARNT_STRIDE))
            ids.append(d[s[:, None] + np.arange(WINDOW)])
            sizes.append(np.full(len(s), WINDOW))
            at.append(at[-1] + len(s))
    return np.concatenate(ids), np.concatenate(sizes), np.array(at)


class Model:
    def __init__(self, evidence: Evidence, network: Network, scale: float, shift: float):
        self.evidence, self.network, self.scale, self.shift = evidence, network, scale, shift

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip(self.scale * logits + self.shift, -30, 30))


class Scorer:
    """Of one worker: a model and the projected inputs of words seen; word 0 stands for no word."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.proj = self._project([b""])
        self.bytes = 0

    def _project(self, words: list[bytes]) -> np.ndarray:
        parts = [words[i : i + 20_000] for i in range(0, len(words), 20_000)]
        return np.concatenate([self.model.network.projected(self.model.network.embed(self.model.evidence.inputs(p))) for p in parts])

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit of each text's windows, all of them."""
        if self.bytes > CACHE_BYTES:
            self.clear()
        number = self.number
        split = [words_of(t) for t in texts]
        new = [w for w in set().union(*split) if w not in number]
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new))))
            self.proj = np.concatenate([self.proj, self._project(new)])
            self.bytes += sum(map(len, new)) + WORD_BYTES * len(new)
        docs = [np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in split]
        out = np.empty(len(docs), np.float32)
        size = np.array([len(d) for d in docs])
        short, long = np.flatnonzero(size <= WINDOW), np.flatnonzero(size > WINDOW)
        if len(short):
            ids, sizes, _ = _layout([docs[i] for i in short])
            out[short] = np.concatenate([self.model.network.forward(self.proj, ids[i : i + AT_ONCE], sizes[i : i + AT_ONCE]) for i in range(0, len(ids), AT_ONCE)])
        if len(long):
            words = np.concatenate([docs[i] for i in long])
            n = len(words) - WINDOW + 1
            logits = np.concatenate([self.model.network.slide(self.proj[words[i : i + AT_ONCE + WINDOW - 1]]) for i in range(0, n, AT_ONCE)])
            ends = np.cumsum(size[long])
            bounds = np.stack([ends - size[long], ends - WINDOW + 1], 1).ravel()  # windows over two texts lie between
            out[long] = np.maximum.reduceat(np.r_[logits, np.float32(0)], bounds)[::2]
        return out


def fit(sample: Iterable[tuple[str | None, float]]) -> Model | None:
    """Of texts and labels, of equal texts the first; None if either label is missing."""
    seen: set[bytes] = set()
    known: dict[bytes, bytes] = {}  # one object for all places of a word
    docs, labels = [], []
    for text, label in sample:
        key = hashlib.blake2b((text or "").encode(), digest_size=16).digest()
        if key not in seen:
            seen.add(key)
            docs.append([known.setdefault(w, w) for w in words_of(text)])
            labels.append(label)
    del seen, known
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(SEED)
    fold = np.zeros(len(y), int)
    for label in (0, 1):  # FOLDS parts to learn from and one to calibrate on, each with both labels as far as there are enough
        own = rng.permutation(np.flatnonzero(y == label))
        fold[own] = np.arange(len(own)) % (FOLDS + 1)
    learnt = fold < FOLDS if len(set(y[fold < FOLDS])) == 2 else np.ones(len(y), bool)
    own = np.flatnonzero(learnt)
    evidence, *apart = Evidence.of_documents([docs[i] for i in own], y[own], np.minimum(fold[own], FOLDS - 1))
    model = Model(evidence, Network(), 1.0, 0.0)
    _train(model, apart or [evidence], [docs[i] for i in own], y[own], np.minimum(fold[own], FOLDS - 1), rng)
    check = np.flatnonzero(~learnt) if len(set(y[~learnt])) == 2 else np.arange(len(y))
    logits = np.concatenate([Scorer(model).logits([" ".join(w.decode() for w in docs[i]) for i in check[k : k + 256]]) for k in range(0, len(check), 256)])
    model.scale, model.shift = _platt(logits, y[check])
    return model


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit with a slight pull towards no scale, by Newton's method."""
    w = np.zeros(2)
    A = np.stack([x, np.ones_like(x)], 1).astype(float)
    for _ in range(50):
        q = _sigmoid(np.clip(A @ w, -30, 30))
        grad = A.T @ (q - y) + np.array([0.05, 0.01]) * w
        hess = (A * (q * (1 - q))[:, None]).T @ A + np.diag([0.05, 0.01])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _train(model: Model, apart: list[Evidence], docs: list[list[bytes]], y: np.ndarray, fold: np.ndarray, rng: np.random.Generator) -> None:
    """Words of a document have the evidence of the other folds, as those of a new document have that of all."""
    fold = fold if len(apart) > 1 else np.zeros(len(docs), int)
    vocabulary: dict[bytes, int] = {b"": 0}
    numbers = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in d), np.int32, len(d)) for d in docs]
    words = list(vocabulary)
    del vocabulary
    _, grams, starts, slot = apart[0].inputs(words)  # a word's slots are the same in all folds, its evidence isn't
    ends = np.r_[starts[1:], len(grams)]
    known, fixed, begins = [], [], [0]
    for k, evidence in enumerate(apart):
        mine = np.flatnonzero(fold == k).tolist()
        known.append(np.unique(np.concatenate([np.zeros(1, np.int32), *(numbers[i] for i in mine)])))
        for i in mine:
            numbers[i] = (begins[-1] + np.searchsorted(known[-1], numbers[i])).astype(np.int32)
        fixed += [evidence.inputs([words[w] for w in known[-1][i : i + WORDS_AT_ONCE].tolist()])[0] for i in range(0, len(known[-1]), WORDS_AT_ONCE)]
        begins.append(begins[-1] + len(known[-1]))
    word, fixed = np.concatenate(known), np.concatenate(fixed)
    del words, known

    def inputs(used: np.ndarray) -> tuple:
        """Inputs of words by their numbers over all folds."""
        w = word[used]
        n = ends[w] - starts[w]
        return fixed[used], grams[_ramp(n) + np.repeat(starts[w], n)], np.cumsum(n) - n, slot[w]

    ids, sizes, at = _layout(numbers)
    owner = np.repeat(np.arange(len(docs)), np.diff(at))
    # at first a document's window with the most evidence stands for it
    logits = np.concatenate([fixed[:, 0][ids[i : i + AT_ONCE]].max(1) + fixed[:, 2][ids[i : i + AT_ONCE]].max(1) for i in range(0, len(ids), AT_ONCE)])
    for epoch in range(EPOCHS):
        order = np.lexsort((-logits, owner))
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order)) - at[owner[order]]
        high = np.flatnonzero(rank < 1)
        other = np.flatnonzero((y[owner] == 0) & (rng.random(len(owner)) < min(1, 2 * len(docs) / len(owner))))
        toxic = high[y[owner[high]] == 1]
        again = np.tile(toxic, max(0, (len(high) + len(other)) // (3 * len(toxic)) - 1))  # a third of the windows are toxic
        chosen = rng.permutation(np.r_[high, other, again])
        for i in range(0, len(chosen), BATCH):
            b = chosen[i : i + BATCH]
            used, local = np.unique(ids[b], return_inverse=True)
            target = y[owner[b]]
            model.network.train(inputs(used), local.reshape(len(b), WINDOW), sizes[b], target)
        if epoch < TRUSTED:
            continue
        for k, (begin, end) in enumerate(zip(begins, begins[1:])):  # a fold's words at a time, as projected ones take the most
            proj = np.empty((end - begin, 6 * STATE), np.float32)
            for i in range(begin, end, WORDS_AT_ONCE):
                used = np.arange(i, min(i + WORDS_AT_ONCE, end))
                proj[used - begin] = model.network.projected(model.network.embed(inputs(used)))
            own = np.flatnonzero(fold[owner] == k)
            for i in range(0, len(own), AT_ONCE):
                w = own[i : i + AT_ONCE]
                logits[w] = model.network.forward(proj, np.maximum(ids[w] - begin, 0), sizes[w])  # word 0 fills short documents


def sample_of(docs: DataFrame, labels: DataFrame, label: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, y, text: the bounded sample of labelled rows that aren't held out; of repeated ids the least text."""
    y = labelled(labels, label)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = y.where("y = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(y.where("y = 0").orderBy(*order).limit(CLEAN_ROWS))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = scratch.keep(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    before = F.sum("size").over(W.partitionBy("y").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    sizes = rows.select("doc_id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    taken = sizes.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < SAMPLE_BYTES).select("doc_id")
    return rows.join(F.broadcast(taken), "doc_id", "left_semi")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from a bounded sample of the labelled rows that aren't held out, trained in one task on an executor.

    labels has doc_id and the label; of repeated ids the smallest label counts, null ids and labels don't. None if
    the sample lacks either label.
    """
    spark = docs.sparkSession
    tune(spark)
    sample = sample_of(docs, labels, label, Scratch(spark), id_col, text_col)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity training", lambda: None)
        rows = ((t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        model = fit(rows)
        if model is not None:
            model.network.step = {}
            blob = pickle.dumps(model, 5)
            del model
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["model"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = ordered.select("text", "y").mapInArrow(train, "model binary").collect()  # one row, of fixed size at most
    return pickle.loads(found[0].model) if found else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: row, doc_id, score double in 0 to 1, from all overlapping windows of the whole text.

    Null and empty texts are scored as one window without words; repeated rows and null ids give a row each.
    Without a model (no labels of both kinds) each score is 0.
    """
    docs = settled(docs)
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    columns = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return columns.select("row", F.col("doc_id").alias(id_col), F.lit(0.0).alias("score"))
    model.network.step = {}
    blob = pickle.dumps(model, 5)  # of fixed size at most
    key = "toxicity", hashlib.sha256(blob).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(key, lambda: Scorer(pickle.loads(blob)))
        for b in batches:
            s = scorer.model.calibrated(scorer.logits(b.column(2).to_pylist())) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["row", "doc_id", "score"])

    return columns.mapInArrow(run, f"row {columns.schema['row'].dataType.simpleString()}, doc_id {kind}, score double").withColumnRenamed("doc_id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score under THRESHOLD, with all columns of docs.

    Null and empty texts are scored like others, repeated rows alike; without labels of both kinds all rows stay, and
    an empty table stays empty.
    """
    docs = settled(docs)
    return without(docs, score(docs, learn(docs, labels)).where(F.col("score") >= THRESHOLD))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
