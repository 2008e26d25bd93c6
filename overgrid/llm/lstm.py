"""A bidirectional LSTM that labels every step of a sequence, in numpy: forward, backward in time, Adam."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 16
STEPS, BATCH, CROP = 420, 24, 48


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights of both directions and of the output."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def new(width: int, random: np.random.Generator) -> Labeller:
        weights = {}
        for d in "fb":
            weights[f"x{d}"] = random.normal(0, 0.3 / np.sqrt(width / 16), (width, 4 * HIDDEN))
            weights[f"h{d}"] = random.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
            weights[f"b{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        weights["o"] = random.normal(0, 0.3, 2 * HIDDEN)
        weights["c"] = np.zeros(1)
        return Labeller(weights)

    def odds(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log odds of each step; ``x`` is (batch, steps, width), padding has mask 0."""
        return self._forward(x, mask)[0]

    def _forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        states = {d: self._run(x, mask, d) for d in "fb"}
        hidden = np.concatenate([states["f"]["h"], states["b"]["h"]], axis=2)
        return hidden @ self.weights["o"] + self.weights["c"], states | {"hidden": hidden}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> dict:
        batch, steps, _ = x.shape
        inputs = x @ self.weights["x" + d] + self.weights["b" + d]
        h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        held = {k: np.zeros((batch, steps, HIDDEN)) for k in ("h", "c", "i", "f", "g", "o", "h0", "c0")}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            held["h0"][:, t], held["c0"][:, t] = h, c
            gates = inputs[:, t] + h @ self.weights["h" + d]
            i, f, o = (sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 3))
            g = np.tanh(gates[:, 2 * HIDDEN : 3 * HIDDEN])
            m = mask[:, t, None]
            c = m * (f * c + i * g) + (1 - m) * c
            h = m * (o * np.tanh(c)) + (1 - m) * h
            for k, v in zip("ifgohc", (i, f, g, o, h, c), strict=True):
                held[k][:, t] = v
        return held

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the steps that are not padding."""
        odds, states = self._forward(x, mask)
        error = (sigmoid(odds) - y) * mask / max(1.0, mask.sum())
        out = {"o": np.einsum("bt,bth->h", error, states["hidden"]), "c": np.array([error.sum()])}
        for n, d in enumerate("fb"):
            above = error[:, :, None] * self.weights["o"][n * HIDDEN : (n + 1) * HIDDEN]
            out |= self._back(x, mask, states[d], above, d)
        return out

    def _back(self, x: np.ndarray, mask: np.ndarray, s: dict, above: np.ndarray, d: str) -> dict[str, np.ndarray]:
        batch, steps, _ = x.shape
        dh, dc = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        gates = np.zeros((batch, steps, 4 * HIDDEN))
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            m = mask[:, t, None]
            i, f, g, o, c, c0 = (s[k][:, t] for k in ("i", "f", "g", "o", "c", "c0"))
            dh = dh + above[:, t]
            squashed = np.tanh(c)
            dnew = dc + dh * m * o * (1 - squashed**2)
            parts = (dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), dnew * i * (1 - g**2), dh * squashed * o * (1 - o))
            gates[:, t] = np.concatenate(parts, axis=1) * m
            dh = gates[:, t] @ self.weights["h" + d].T + dh * (1 - m)
            dc = dnew * (m * f + (1 - m))
        flat = gates.reshape(-1, 4 * HIDDEN)
        return {"x" + d: x.reshape(-1, x.shape[2]).T @ flat, "h" + d: s["h0"].reshape(-1, HIDDEN).T @ flat, "b" + d: flat.sum(0)}


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of one width as one array, and the mask of what is not padding."""
    steps = max(len(s) for s in sequences)
    out = np.zeros((len(sequences), steps, sequences[0].shape[1]))
    mask = np.zeros((len(sequences), steps))
    for k, s in enumerate(sequences):
        out[k, : len(s)], mask[k, : len(s)] = s, 1
    return out, mask


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], seed: int = 3) -> Labeller:
    """Adam on random crops of the training sequences."""
    random = np.random.default_rng(seed)
    model = Labeller.new(sequences[0].shape[1], random)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for t in range(1, STEPS + 1):
        chosen = random.integers(0, len(sequences), BATCH)
        starts = [int(random.integers(0, max(1, len(sequences[k]) - CROP + 1))) for k in chosen]
        x, mask = padded([sequences[k][a : a + CROP] for k, a in zip(chosen, starts, strict=True)])
        y, _ = padded([labels[k][a : a + CROP, None] for k, a in zip(chosen, starts, strict=True)])
        for k, g in model.gradients(x, mask, y[:, :, 0]).items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g**2
            rate = 0.03 * (1 - 0.8 * t / STEPS)
            model.weights[k] = model.weights[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return model


def label(model: Labeller, sequences: list[np.ndarray], batch: int = 64) -> list[np.ndarray]:
    """Probabilities of every step; sequences of like length run together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
    order = sorted((k for k in range(len(sequences)) if len(sequences[k])), key=lambda k: len(sequences[k]))
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        odds = model.odds(*padded([sequences[k] for k in some]))
        for row, k in zip(odds, some, strict=True):
            out[k] = sigmoid(row[: len(sequences[k])])
    return out
