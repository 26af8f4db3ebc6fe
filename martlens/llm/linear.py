"""Logistic regression over sparse or dense rows, and probability scaling."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


#: Entries that are worked on at once.
_PIECE = 1 << 20


class Entries:
    """The columns that hold something in each of some rows, piece by piece.

    A column's value is the same in all rows, so none is kept per entry: values
    go into the weights before a product and into the sums after one. Only a
    piece at a time is blown up to 64-bit numbers.
    """

    def __init__(self, columns: np.ndarray, lengths: np.ndarray) -> None:
        self.columns, self.n = columns, len(lengths)
        self.pieces = []
        ends = np.cumsum(lengths)
        low = 0
        while low < self.n:
            begin = int(ends[low] - lengths[low])
            high = max(low + 1, int(np.searchsorted(ends, begin + _PIECE, "right")))
            full = low + np.flatnonzero(lengths[low:high])
            if len(full):
                starts = ends[full] - lengths[full] - begin
                self.pieces.append((begin, int(ends[high - 1]), full, starts, lengths[full]))
            low = high

    def by_row(self, per_column: np.ndarray) -> np.ndarray:
        """For each row, the sum over its columns."""
        out = np.zeros(self.n)
        for begin, end, rows, starts, _ in self.pieces:
            out[rows] = np.add.reduceat(per_column[self.columns[begin:end]], starts)
        return out

    def by_column(self, per_row: np.ndarray, size: int) -> np.ndarray:
        """For each column, the sum over the rows that have it."""
        out = np.zeros(size)
        for begin, end, rows, _, lengths in self.pieces:
            each = np.repeat(per_row[rows], lengths)
            out += np.bincount(self.columns[begin:end], each, minlength=size)
        return out


def fit_marked(
    columns: np.ndarray,
    lengths: np.ndarray,
    values: np.ndarray,
    labels: np.ndarray,
    penalty: float,
    rounds: int = 60,
) -> tuple[np.ndarray, float]:
    """Weights and offset of ``labels`` on rows that each have some of the columns.

    ``columns`` are those of all rows, one row after another, ``lengths`` how
    many each has, ``values`` what a column counts where a row has it.
    Minimises the mean log loss plus ``penalty / 2`` times the squared
    weights, by accelerated gradient steps of safe length.
    """
    n, size, entries = len(labels), len(values), Entries(columns, lengths)
    weights, offset = np.zeros(size), float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
    ahead, ahead_offset = weights.copy(), offset
    per_row = entries.by_row(values * values)
    step = 1 / (0.25 * (per_row.max(initial=0.0) + 1) + penalty)
    step = max(step, 1 / (0.25 * (4 * per_row.mean() + 1) + penalty)) if n else step
    pace = 1.0
    loss_before = np.inf
    for _ in range(rounds):
        score = entries.by_row(values * ahead) + ahead_offset
        error = sigmoid(score) - labels
        gradient = values * entries.by_column(error, size) / n + penalty * ahead
        new, new_offset = ahead - step * gradient, ahead_offset - step * error.mean()
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / faster * (new - weights)
        ahead_offset = new_offset + (pace - 1) / faster * (new_offset - offset)
        loss = np.logaddexp(0, np.where(labels > 0, -score, score)).mean()
        if loss > loss_before:  # too far ahead: begin anew from here
            ahead, ahead_offset, faster = new.copy(), new_offset, 1.0
        weights, offset, pace, loss_before = new, new_offset, faster, loss
    return weights, float(offset)


def fit_dense(x: np.ndarray, labels: np.ndarray, penalty: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Weights (the last one is the offset) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(x @ weights)
        gradient = x.T @ (p - labels) / len(x) + ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(ridge + 1e-9)
        change = np.linalg.solve(curve, gradient)
        size = np.abs(change).max()
        weights -= change * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-8:
            break
    return weights
