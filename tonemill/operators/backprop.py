"""Dense layers with ReLU between them and softmax cross-entropy: loss and gradient of a batch, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Layer = tuple[np.ndarray, np.ndarray]


def split_layers(flat: np.ndarray, sizes: Sequence[int]) -> list[Layer]:
    """Views of ``flat`` as (weights, bias) of every layer; ``sizes`` are the widths from input to classes."""
    layers, at = [], 0
    for fan_in, fan_out in zip(sizes, sizes[1:]):
        w = flat[at : at + fan_out * fan_in].reshape(fan_out, fan_in)
        at += w.size
        layers.append((w, flat[at : at + fan_out]))
        at += fan_out
    return layers


def flat_layers(layers: Sequence[Layer]) -> np.ndarray:
    return np.concatenate([np.concatenate([np.ravel(w), np.ravel(b)]) for w, b in layers]).astype(float)


def start_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    """A single layer starts at zero (its loss is convex), more layers uniformly within 1 / sqrt(inputs)."""
    if len(sizes) == 2:
        return np.zeros((sizes[0] + 1) * sizes[1])
    rng = np.random.default_rng(seed)
    return flat_layers(
        [(rng.uniform(-1, 1, (o, i)) / np.sqrt(i), rng.uniform(-1, 1, o) / np.sqrt(i)) for i, o in zip(sizes, sizes[1:])]
    )


def bias_mask(sizes: Sequence[int]) -> np.ndarray:
    """True where a flat parameter is a bias."""
    return np.concatenate([np.r_[np.zeros(i * o, bool), np.ones(o, bool)] for i, o in zip(sizes, sizes[1:])])


def kept_units(rows: np.ndarray, units: int, key: int, rate: float) -> np.ndarray:
    """Which units stay in each row under dropout: a hash of row, unit and key, the same in whatever task the row is."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, units + 1, dtype=np.uint64)[None, :]
        x += np.uint64(key) * np.uint64(0xBF58476D1CE4E5B9)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / (1 << 53) >= rate


def loss_and_gradient(
    flat: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, key: int = 0, dropout: float = 0.0
) -> tuple[float, np.ndarray]:
    """Summed loss of the rows and its gradient, backwards through all layers."""
    layers = split_layers(flat, sizes)
    inputs, slopes = [], []
    for i, (w, b) in enumerate(layers):
        inputs.append(x)
        x = x @ w.T + b
        if i < len(layers) - 1:
            slope = (x > 0).astype(float)
            if dropout:
                slope *= kept_units(rows, x.shape[1], key * len(layers) + i, dropout) / (1 - dropout)
            slopes.append(slope)
            x = x * slope
    x = x - x.max(axis=1, keepdims=True)
    log_sum = np.log(np.exp(x).sum(axis=1))
    here = np.arange(len(y))
    loss = float((log_sum - x[here, y]).sum())
    back = np.exp(x - log_sum[:, None])
    back[here, y] -= 1.0
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts[:0] = [(back.T @ inputs[i]).ravel(), back.sum(axis=0)]
        if i:
            back = (back @ layers[i][0]) * slopes[i - 1]
    return loss, np.concatenate(parts)
