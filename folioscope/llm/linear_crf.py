"""Linear-chain conditional random field over feature ids: likelihood training and Viterbi decoding in numpy batches.

A sequence is a matrix of feature ids, one row per token, a fixed number of ids per row, -1 for none. Labels are whole
numbers below `labels`. Scores of a path are emission weights of the features, transitions, and a score for the first label.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

CELLS = 4_000_000  # tokens x labels of one batch


@dataclass
class Model:
    emit: np.ndarray  # features x labels
    move: np.ndarray  # from x to
    start: np.ndarray

    def scores(self, ids: np.ndarray) -> np.ndarray:
        padded = np.vstack((self.emit, np.zeros((1, self.emit.shape[1]))))  # id -1 is the last row
        out = np.zeros((len(ids), self.emit.shape[1]))
        for column in range(ids.shape[1]):
            out += padded[ids[:, column]]
        return out


def batches(lengths: np.ndarray, labels: int) -> Iterator[np.ndarray]:
    """Sequence numbers by falling length, in batches of bounded padded size."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        many = max(1, CELLS // (max(int(lengths[order[at]]), 1) * labels))
        yield order[at : at + many]
        at += many


def padded(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """time x sequence x ... of the sequences `rows`, and their lengths."""
    lengths = np.diff(bounds)[rows]
    out = np.zeros((int(lengths.max(initial=0)), len(rows), *values.shape[1:]), dtype=values.dtype)
    for i, r in enumerate(rows):
        out[: lengths[i], i] = values[bounds[r] : bounds[r + 1]]
    return out, lengths


def decode(model: Model, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best labels of every sequence, token after token. On ties the smaller label wins."""
    out = np.zeros(len(ids), dtype=np.int64)
    labels = len(model.start)
    for rows in batches(np.diff(bounds), labels):
        scores, lengths = padded(model.scores(ids[np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])]),
                                 np.concatenate(([0], np.cumsum(np.diff(bounds)[rows]))), np.arange(len(rows)))
        if not len(scores):
            continue
        best = scores[0] + model.start
        last = best.copy()
        back = np.zeros((len(scores), len(rows), labels), dtype=np.int8)
        for t in range(1, len(scores)):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            through = best[:live, :, None] + model.move
            back[t, :live] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[t, :live]
            last[:live] = best
        label = last.argmax(axis=1)
        for t in range(len(scores) - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            out[bounds[rows[:live]] + t] = label[:live]
            label[:live] = back[t, np.arange(live), label[:live]]
    return out


def likelihood(model: Model, ids: np.ndarray, bounds: np.ndarray, gold: np.ndarray) -> tuple[float, Model]:
    """Log-likelihood of the labels `gold`, and its gradient."""
    labels = len(model.start)
    total, d_scores = 0.0, np.zeros((len(ids), labels))
    d_move, d_start = np.zeros_like(model.move), np.zeros_like(model.start)
    all_scores = model.scores(ids)
    step = np.exp(model.move)
    for rows in batches(np.diff(bounds), labels):
        scores, lengths = padded(all_scores, bounds, rows)
        if not len(scores):
            continue
        top = scores.max(axis=2, keepdims=True)
        weight = np.exp(scores - top)
        times, n = scores.shape[:2]
        ahead, scale = np.zeros((times, n, labels)), np.ones((times, n))
        for t in range(times):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            came = np.exp(model.start)[None, :] if t == 0 else ahead[t - 1, :live] @ step
            now = came * weight[t, :live]
            scale[t, :live] = now.sum(axis=1)
            ahead[t, :live] = now / scale[t, :live, None]
        mask = np.arange(times)[:, None] < lengths[None, :]
        total -= float(((np.log(scale) + top[:, :, 0]) * mask).sum())
        after = np.ones((n, labels))
        for t in range(times - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            chance = ahead[t, :live] * after[:live]
            at = bounds[rows[:live]] + t
            d_scores[at] -= chance
            own = gold[at]
            d_scores[at, own] += 1
            total += float(scores[t, np.arange(live), own].sum())
            carried = weight[t, :live] * after[:live] / scale[t, :live, None]
            if t:
                d_move -= step * (ahead[t - 1, :live].T @ carried)
                np.add.at(d_move, (gold[at - 1], own), 1)
                total += float(model.move[gold[at - 1], own].sum())
                after[:live] = carried @ step.T
            else:
                d_start -= chance.sum(axis=0)
                np.add.at(d_start, own, 1)
                total += float(model.start[own].sum())
    d_emit = np.zeros_like(model.emit)
    flat = ids.reshape(-1)
    known = flat >= 0
    for label in range(labels):
        d_emit[:, label] = np.bincount(flat[known], weights=np.repeat(d_scores[:, label], ids.shape[1])[known], minlength=len(model.emit))
    return total, Model(d_emit, d_move, d_start)


def minimise(value_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, kept: int = 8) -> np.ndarray:
    """Quasi-Newton descent with `kept` remembered steps and halved step lengths."""
    value, slope = value_and_slope(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, used = slope.copy(), []
        for s, y in reversed(moves):
            a = (s @ way) / (s @ y)
            way -= a * y
            used.append(a)
        if moves:
            s, y = moves[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(used), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        length = 1.0 if moves else 1.0 / max(1.0, float(np.abs(slope).sum()))
        drop = float(slope @ way)
        if drop <= 1e-9:
            break
        while length > 1e-10:
            new_x = x - length * way
            new_value, new_slope = value_and_slope(new_x)
            if new_value <= value - 1e-4 * length * drop:
                break
            length /= 2
        else:
            break
        s, y = new_x - x, new_slope - slope
        if s @ y > 1e-10:
            moves = [*moves[-kept + 1 :], (s, y)]
        done = value - new_value < 1e-6 * abs(value)
        x, value, slope = new_x, new_value, new_slope
        if done:
            break
    return x


def train(ids: np.ndarray, bounds: np.ndarray, gold: np.ndarray, features: int, labels: int, decay: float = 0.02, rounds: int = 80) -> Model:
    """The model of largest likelihood less decay / 2 times the squared weights."""
    cut = features * labels, features * labels + labels * labels

    def shaped(x: np.ndarray) -> Model:
        return Model(x[: cut[0]].reshape(features, labels), x[cut[0] : cut[1]].reshape(labels, labels), x[cut[1] :])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = likelihood(shaped(x), ids, bounds, gold)
        flat = np.concatenate((slope.emit.reshape(-1), slope.move.reshape(-1), slope.start))
        return -value + decay / 2 * float(x @ x), -flat + decay * x

    return shaped(minimise(loss, np.zeros(cut[1] + labels), rounds))
