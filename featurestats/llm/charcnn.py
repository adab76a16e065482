"""A character convolutional network in numpy: embedding, one convolution, global maximum, logistic output.

Two filters sets are pooled apart: over the candidate itself and over its whole window.  A candidate of more than ``STEP`` characters is read by
windows ``STEP`` apart, the last of which begins ``STEP`` characters before its end; its score is their maximum.  ``calibrate`` fits the scale
and offset of the output on rows kept from training (Platt) and the highest threshold that keeps a given recall there; it
warns if the precision there is under a floor.
"""

from __future__ import annotations

import warnings

import numpy as np

BEFORE, WIDTH = 32, 96  # characters before a candidate, and in all
STEP = 32  # characters from a window to the next, at most
CLASSES = 98  # 0 padding, 1..95 printable ASCII, 96 other letters, 97 the rest


def count_windows(length):
    """How many windows a candidate of ``length`` characters (a number or an array) has."""
    return np.maximum(-(-length // STEP), 1)


def encode_window(text: str, start: int, end: int) -> tuple[bytes, int]:
    """Character classes of all windows of text[start:end] (the candidate begins at BEFORE) and the candidate's length."""
    width = WIDTH + max(end - start - STEP, 0)
    window = text[max(0, start - BEFORE):start - BEFORE + width]
    codes = bytes(BEFORE - min(start, BEFORE)) + bytes(ord(c) - 31 if 32 <= ord(c) < 127 else 96 if c.isalpha() else 97 for c in window)
    return codes.ljust(width, b"\0"), end - start


def balanced(labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weights, scaled so that both classes count alike."""
    ones, whole = (weights * labels).sum(), max(weights.sum(), 1e-9)
    return weights * np.where(labels == 1, 0.5 / max(ones / whole, 1e-9), 0.5 / max(1 - ones / whole, 1e-9))


class CharCnn:
    def __init__(self, seed: int = 8, depth: int = 8, filters: int = 16, width: int = 5):
        rng = np.random.default_rng(seed)
        self.width, self.scale, self.offset, self.threshold, self.precision = width, 1.0, 0.0, 1.0, 0.0
        self.p = {
            "emb": rng.normal(0, 0.5, (CLASSES, depth)),
            "conv": rng.normal(0, (width * depth) ** -0.5, (width * depth, filters)),
            "bias": np.zeros(filters),
            "out": rng.normal(0, (2 * filters) ** -0.5, 2 * filters),
            "b": np.zeros(1),
        }
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0

    def _hidden(self, codes: np.ndarray) -> np.ndarray:
        """The filters' outputs at each position: a sum of what each character gives at each place of the filter."""
        positions, depth = WIDTH - self.width + 1, self.p["emb"].shape[1]
        given = self.p["emb"] @ self.p["conv"].reshape(self.width, depth, -1)
        h = given[0][codes[:, :positions]]
        for k in range(1, self.width):
            h += given[k][codes[:, k:k + positions]]
        h += self.p["bias"]
        return np.ascontiguousarray(np.maximum(h, 0, out=h).transpose(0, 2, 1))

    def _forward(self, codes: np.ndarray, lengths: np.ndarray):
        h = self._hidden(codes)
        outside = np.arange(BEFORE, h.shape[2]) >= BEFORE + np.maximum(lengths - self.width + 1, 1)[:, None]
        inner = np.where(outside[:, None, :], -1.0, h[:, :, BEFORE:])
        best, best_all = inner.argmax(2), h.argmax(2)
        pooled = np.concatenate([np.take_along_axis(inner, best[:, :, None], 2)[:, :, 0], np.take_along_axis(h, best_all[:, :, None], 2)[:, :, 0]], 1)
        return pooled @ self.p["out"] + self.p["b"][0], (pooled, best + BEFORE, best_all)

    def _gradient(self, codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
        logit, (pooled, best, best_all) = self._forward(codes, lengths)
        d = weights * (1 / (1 + np.exp(-logit)) - labels) / len(codes)
        filters = pooled.shape[1] // 2
        g = {"out": pooled.T @ d, "b": np.array([d.sum()]), "bias": np.zeros(filters)}
        g["conv"], g["emb"] = np.zeros_like(self.p["conv"]), np.zeros_like(self.p["emb"])
        rows = np.arange(len(codes))[:, None]
        depth = self.p["emb"].shape[1]
        for half, at in ((0, best), (1, best_all)):
            active = pooled[:, half * filters:(half + 1) * filters] > 0
            dh = d[:, None] * self.p["out"][half * filters:(half + 1) * filters] * active
            g["bias"] += dh.sum(0)
            # What each class of characters had to do with each filter at each of its places.
            where = codes[rows[:, :, None], at[:, :, None] + np.arange(self.width)]
            slot = (where * filters + np.arange(filters)[:, None]) * self.width + np.arange(self.width)
            share = np.bincount(slot.ravel(), np.repeat(dh.ravel(), self.width), CLASSES * filters * self.width).reshape(CLASSES, filters, self.width)
            g["conv"] += np.tensordot(share, self.p["emb"], (0, 0)).transpose(1, 2, 0).reshape(-1, filters)
            g["emb"] += np.tensordot(share, self.p["conv"].reshape(self.width, depth, filters), ((1, 2), (2, 0)))
        return g

    def epoch(self, codes, lengths, labels, weights, order, batch: int = 64, rate: float = 0.01) -> "CharCnn":
        """Adam on the weighted logistic loss, over the rows in ``order``."""
        for k in range(0, len(order), batch):
            rows, self.t = order[k:k + batch], self.t + 1
            for name, g in self._gradient(codes[rows], lengths[rows], labels[rows], weights[rows]).items():
                self.m[name] = 0.9 * self.m[name] + 0.1 * g
                self.v[name] = 0.999 * self.v[name] + 0.001 * g * g
                self.p[name] = self.p[name] - rate * (self.m[name] / (1 - 0.9**self.t)) / (np.sqrt(self.v[name] / (1 - 0.999**self.t)) + 1e-8)
        return self

    def fit(self, codes, lengths, labels, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 8) -> "CharCnn":
        """Adam on the logistic loss, classes weighted to count alike."""
        rng, weights = np.random.default_rng(seed), balanced(labels, np.ones(len(labels)))
        for _ in range(epochs):
            self.epoch(codes, lengths, labels, weights, rng.permutation(len(labels)), batch, rate)
        return self

    def state(self) -> np.ndarray:
        """Parameters, Adam's moments and steps as one vector, so that networks trained apart can be averaged."""
        return np.concatenate([part[name].ravel() for part in (self.p, self.m, self.v) for name in sorted(part)] + [[self.t]])

    def load(self, state: np.ndarray) -> "CharCnn":
        at = 0
        for part in (self.p, self.m, self.v):
            for name in sorted(part):
                size, shape = part[name].size, part[name].shape
                part[name], at = state[at:at + size].reshape(shape).copy(), at + size
        self.t = float(state[-1])
        return self

    def calibrate(self, codes, lengths, labels, recall: float, floor: float) -> "CharCnn":
        self.platt(self._forward(codes, lengths)[0], labels, np.ones(len(labels)))
        score = self.score(codes, lengths)
        return self.constrain(score[labels == 1], score[labels == 0], recall, floor)

    def platt(self, logit: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> "CharCnn":
        """Scale and offset from logits, each standing for ``counts`` rows."""
        # Platt's targets keep the slope finite when the classes part cleanly.
        n1, n0 = (counts * labels).sum(), (counts * (1 - labels)).sum()
        target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 1.0, 0.0

        def loss(a: float, b: float) -> float:
            z = a * logit + b
            return float((counts * (np.logaddexp(0, z) - target * z)).sum() + 5e-4 * a * a)

        now = loss(a, b)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
            e, w = counts * (p - target), counts * np.maximum(p * (1 - p), 1e-6)
            hess = np.array([[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, np.array([(e * logit).sum() + 1e-3 * a, e.sum()]))
            rate = 1.0
            while rate > 1e-6 and loss(a - rate * step[0], b - rate * step[1]) > now:  # Newton may step too far
                rate /= 2
            a, b = a - rate * step[0], b - rate * step[1]
            before, now = now, loss(a, b)
            if before - now < 1e-9:
                break
        self.scale, self.offset = float(a), float(b)
        return self

    def constrain(self, secrets: np.ndarray, others: np.ndarray, recall: float, floor: float, n_secrets=None, n_others=None) -> "CharCnn":
        """The highest threshold that finds ``recall`` of these secrets' scores, and the precision it leaves; a score
        stands for one row, or for as many as ``n_secrets`` and ``n_others`` say."""
        n_secrets = np.ones(len(secrets)) if n_secrets is None else n_secrets
        n_others = np.ones(len(others)) if n_others is None else n_others
        if len(secrets):
            order = np.argsort(secrets, kind="stable")
            upto = np.cumsum(n_secrets[order])
            self.threshold = float(secrets[order][np.searchsorted(upto, int((1 - recall) * upto[-1]), side="right")])
            hits, false = n_secrets[secrets >= self.threshold].sum(), n_others[others >= self.threshold].sum()
            self.precision = float(hits / (hits + false))
            if self.precision < floor:
                warnings.warn(f"a recall of {recall} leaves a precision of {self.precision:.3f}, under {floor}", stacklevel=2)
        return self

    def logits(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0)
        return np.concatenate([self._forward(codes[k:k + 1024], lengths[k:k + 1024])[0] for k in range(0, len(codes), 1024)])

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.offset, -30, 30)))

    def score(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(codes, lengths))

    def score_runs(self, runs: list[tuple[bytes, int]], at_once: int = 1024) -> np.ndarray:
        """The highest score of each candidate's windows; ``at_once`` windows are held at a time."""
        best = np.zeros(len(runs))
        sizes = count_windows(np.array([n for _, n in runs], np.int64))
        owner = np.repeat(np.arange(len(runs)), sizes)
        size = np.repeat(np.array([n for _, n in runs], np.int64), sizes)
        place = np.minimum((np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * STEP, np.maximum(size - STEP, 0))
        lengths = np.minimum(size - place, WIDTH - BEFORE)
        for k in range(0, len(owner), at_once):
            mine = owner[k:k + at_once]
            flat = b"".join(runs[i][0][s:s + WIDTH] for i, s in zip(mine.tolist(), place[k:k + at_once].tolist()))
            score = self.score(np.frombuffer(flat, np.uint8).reshape(-1, WIDTH).astype(np.int64), lengths[k:k + at_once])
            np.maximum.at(best, mine, score)
        return best
