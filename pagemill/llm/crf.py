"""Linear-chain conditional random fields over discrete features, on numpy.

A position has a fixed number of features, each the number of a weight row; its
emission scores are the sum of those rows. Training is full-batch maximum likelihood
(forward-backward over padded sequences, Adam); decoding is Viterbi, both in step
over many sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    weights: np.ndarray  # features x states
    moves: np.ndarray  # states x states, from and to
    first: np.ndarray  # states, at the start

    @property
    def states(self) -> int:
        return len(self.first)


def empty(features: int, states: int) -> Model:
    """A model that has seen nothing: all tags score alike."""
    return Model(np.zeros((features, states)), np.zeros((states, states)), np.zeros(states))


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(sizes.max(initial=0)), *rows[0].shape[1:]), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, sizes


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def fit(
    sequences: list[np.ndarray], tags: list[np.ndarray], features: int, states: int, epochs: int = 60, l2: float = 1e-4
) -> Model:
    """Model for sequences (positions x features each) with their tags; no sequences give the empty model."""
    model = empty(features, states)
    keep = [i for i, s in enumerate(sequences) if len(s)]
    if not keep:
        return model
    x, sizes = _padded([sequences[i] for i in keep])
    y, _ = _padded([tags[i] for i in keep])
    n, length, fields = x.shape
    inside = np.arange(length) < sizes[:, None]
    total = inside.sum()
    gold = np.eye(states)[y] * inside[:, :, None]
    gold_moves = np.einsum("nts,ntu->su", gold[:, :-1], gold[:, 1:])
    gold_first = gold[:, 0].sum(axis=0)
    params = [model.weights, model.moves, model.first]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = np.arange(n)
    for epoch in range(1, epochs + 1):
        weights, moves, first = params
        score = weights[x].sum(axis=2)
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0] + first
        for t in range(1, length):
            alpha[:, t] = _logsum(alpha[:, t - 1, :, None] + moves, 1) + score[:, t]
        for t in range(length - 2, -1, -1):
            step = _logsum(moves + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(inside[:, t + 1, None], step, 0)
        norm = _logsum(alpha[rows, sizes - 1], 1)
        share = np.exp(np.minimum(alpha + beta - norm[:, None, None], 0)) * inside[:, :, None]
        pair = alpha[:, :-1, :, None] + moves + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - norm[:, None, None, None]
        pair = (np.exp(np.minimum(pair, 0)) * inside[:, 1:, None, None]).sum(axis=(0, 1))
        slope = (share - gold)[inside]
        of = x[inside]
        down = np.zeros_like(weights)
        for f in range(fields):
            for s in range(states):
                down[:, s] += np.bincount(of[:, f], slope[:, s], minlength=features)
        grads = [down / total, (pair - gold_moves) / total, (share[:, 0].sum(axis=0) - gold_first) / total]
        for p, g, a, b in zip(params, grads, mean, square, strict=True):
            g += l2 * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= 0.3 * (a / (1 - 0.9**epoch)) / (np.sqrt(b / (1 - 0.99**epoch)) + 1e-8)
    return model


def viterbi(model: Model, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Best tags of each sequence; of tags that score alike the lowest."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(sequences)
    # Longest first, so that the sequences still open are always a prefix.
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: -len(sequences[i]))
    if not order:
        return out
    sizes = np.array([len(sequences[i]) for i in order])
    score = model.weights[np.concatenate([sequences[i] for i in order])].sum(axis=1)
    start = np.cumsum(sizes) - sizes
    best = score[start] + model.first
    back = np.zeros((len(score), model.states), np.int8)
    for t in range(1, sizes[0]):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        at = start[:n] + t
        through = best[:n, :, None] + model.moves
        back[at] = through.argmax(axis=1)
        best[:n] = through.max(axis=1) + score[at]
    tag = best.argmax(axis=1)
    tags = np.empty(len(score), np.int64)
    for t in range(sizes[0] - 1, -1, -1):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        at = start[:n] + t
        ended = sizes[:n] - 1 == t
        now = np.where(ended, tag[:n], 0)
        if t < sizes[0] - 1:
            m = int(np.searchsorted(-sizes, -(t + 1), side="left"))
            later = start[:m] + t + 1
            now[:m] = back[later, tags[later]]
        tags[at] = now
    for i, a, n in zip(order, start, sizes, strict=True):
        out[i] = tags[a : a + n]
    return out
