"""A small causal self-attention model in numpy: training on windows, batched scoring.

The next class is predicted from the bigram log-probabilities of the current one plus what one masked
attention head reads from the window before it. The output has two levels: frequent classes and bands of
rarer ones first, then the class within its band, which is computed only where a target lies in the band.
"""

from __future__ import annotations

import copy

import numpy as np

WINDOW = 48
STEP = 32
WIDTH = 16
# Classes that are outputs of the first level; the rest is cut into bands that grow by this factor.
DIRECT = 60
MASKED = np.float32(-1e9)
PRIOR = 5.0


def bands(classes: int) -> list[tuple[int, int]]:
    """Bounds of the bands of rarer classes: each reaches to twice the classes before it."""
    found, low = [], DIRECT
    while low < classes:
        found.append((low, min(2 * low + 8, classes)))
        low = found[-1][1]
    return found


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x *= 1 / x.sum(axis=-1, keepdims=True)
    return x


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of each row, drawn to the column sums as by PRIOR observations of them."""
    overall = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * counts.shape[1])
    return np.log((counts + PRIOR * overall) / (counts.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32)


class Model:
    """Weights of the head; ``counts`` says how often each class follows each, and makes the fixed part."""

    def __init__(self, counts: np.ndarray, seed: int = 7) -> None:
        classes, rng = len(counts), np.random.default_rng(seed)
        self.bands = bands(classes)
        self.direct = min(DIRECT, classes)
        first = np.concatenate(
            [counts[:, :self.direct], *[counts[:, a:b].sum(axis=1, keepdims=True) for a, b in self.bands]], axis=1)
        self.bigram = [_smoothed(first), *[_smoothed(counts[:, a:b]) for a, b in self.bands]]
        self.chance = [np.exp(table) for table in self.bigram]
        self.symbol = np.arange(classes)
        for i, (a, b) in enumerate(self.bands):
            self.symbol[a:b] = self.direct + i

        def start(*shape, scale=0.05):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.weights = {
            "token": start(classes, WIDTH, scale=0.3), "place": start(WINDOW, WIDTH),
            "query": start(WIDTH, WIDTH, scale=0.2), "key": start(WIDTH, WIDTH, scale=0.2),
            "value": start(WIDTH, WIDTH, scale=0.2)}
        for i, table in enumerate(self.bigram):
            self.weights[f"out{i}"] = start(WIDTH, table.shape[1], scale=0.02)
        self.mask = np.where(np.tri(WINDOW, dtype=bool), np.float32(0), MASKED)

    def copied(self) -> Model:
        """A model of the same weights that can be trained by itself."""
        other = copy.copy(self)
        other.weights = {n: w.copy() for n, w in self.weights.items()}
        return other

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([w.reshape(-1) for w in self.weights.values()])

    def load(self, flat: np.ndarray) -> None:
        """Takes the weights from a row as made by ``flat``."""
        ends = np.cumsum([w.size for w in self.weights.values()])
        for (name, w), part in zip(self.weights.items(), np.split(flat, ends[:-1]), strict=True):
            self.weights[name] = part.reshape(w.shape).astype(np.float32)

    def hidden(self, windows: np.ndarray, first: int = 0):
        """What attention reads at the places from ``first`` on, and the parts that training needs."""
        w, (count, length) = self.weights, windows.shape
        x = np.take(w["token"], windows, axis=0, mode="clip")
        x += w["place"][:length]
        flat = x.reshape(-1, WIDTH)
        k, v = (flat @ w["key"]).reshape(x.shape), (flat @ w["value"]).reshape(x.shape)
        q = (np.ascontiguousarray(x[:, first:]).reshape(-1, WIDTH) @ w["query"]).reshape(count, length - first, WIDTH)
        scores = (q * np.float32(WIDTH ** -0.5)) @ k.transpose(0, 2, 1)
        scores += self.mask[first:length, :length]
        a = _softmax(scores)
        return np.tanh(a @ v), (x, q, k, v, a)

    def _outputs(self, targets: np.ndarray):
        """Each level's table, with the places of its targets and which output they are there. A target
        below zero is none."""
        there = np.flatnonzero(targets >= 0)
        yield 0, there, self.symbol[targets[there]]
        for i, (low, high) in enumerate(self.bands, 1):
            at = np.flatnonzero((targets >= low) & (targets < high))
            yield i, at, targets[at] - low

    def log_probability(self, windows: np.ndarray, targets: np.ndarray, first: int) -> np.ndarray:
        """Natural log-probability of ``targets``, the classes after the places from ``first`` on; zero where
        a target is below zero."""
        read = self.hidden(windows, first)[0].reshape(-1, WIDTH)
        given, flat = windows[:, first:].reshape(-1), targets.reshape(-1)
        total = np.zeros(len(flat))
        for i, at, wanted in self._outputs(flat):
            out = self.weights[f"out{i}"]
            here, now = (read, given) if len(at) == len(flat) else (read[at], given[at])
            # The sum of exp(log-probability + reading), without a shift: the reading is bounded by tanh.
            raised = here @ out
            np.exp(raised, out=raised)
            whole = np.einsum("ij,ij->i", raised, np.take(self.chance[i], now, axis=0, mode="clip"))
            total[at] += self.bigram[i][now, wanted] + np.einsum(
                "ij,ij->i", here, np.take(np.ascontiguousarray(out.T), wanted, axis=0)) - np.log(whole)
        return total.reshape(targets.shape)

    def train(self, windows: np.ndarray, epochs: int = 2, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the mean cross-entropy; ``windows`` have WINDOW + 1 classes, each the target of the one before.
        A class below zero marks places that do not exist."""
        rng = np.random.default_rng(seed)
        moments = {n: [np.zeros_like(p), np.zeros_like(p)] for n, p in self.weights.items()}
        step, steps = 0, max(1, epochs * -(-len(windows) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for low in range(0, len(order), batch):
                grads = self._gradients(windows[order[low:low + batch]])
                step += 1
                now = np.float32(rate * min(1.0, step / 50) * (1.0 - 0.95 * step / steps))
                for name, grad in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    self.weights[name] -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)

    def _gradients(self, windows: np.ndarray) -> dict[str, np.ndarray]:
        w, scale = self.weights, np.float32(WIDTH ** 0.5)
        given, targets = np.maximum(windows[:, :-1], 0), windows[:, 1:].reshape(-1)
        h, (x, q, k, v, a) = self.hidden(given)
        read, current = h.reshape(-1, WIDTH), given.reshape(-1)
        grads, d_h = {}, np.zeros_like(read)
        for i, at, wanted in self._outputs(targets):
            error = _softmax(read[at] @ w[f"out{i}"] + self.bigram[i][current[at]])
            error[np.arange(len(at)), wanted] -= 1
            error /= max(1, int((targets >= 0).sum()))
            grads[f"out{i}"] = read[at].T @ error
            d_h[at] += error @ w[f"out{i}"].T
        d_read = (d_h * (1 - read ** 2)).reshape(h.shape)
        d_a = d_read @ v.transpose(0, 2, 1)
        d_scores = a * (d_a - (d_a * a).sum(axis=-1, keepdims=True)) / scale
        d_q, d_k, d_v = d_scores @ k, d_scores.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ d_read
        d_x = d_q @ w["query"].T + d_k @ w["key"].T + d_v @ w["value"].T
        flat_x = x.reshape(-1, WIDTH)
        token = np.zeros_like(w["token"])
        np.add.at(token, current, d_x.reshape(-1, WIDTH))
        place = np.zeros_like(w["place"])
        place[:x.shape[1]] = d_x.sum(axis=0)
        return grads | {"token": token, "place": place, "query": flat_x.T @ d_q.reshape(-1, WIDTH),
                        "key": flat_x.T @ d_k.reshape(-1, WIDTH), "value": flat_x.T @ d_v.reshape(-1, WIDTH)}
