"""Non-negative positive-unlabelled learning of a linear classifier on hashed text features."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from .features import Rows, row_numbers


@dataclass(frozen=True)
class PUSettings:
    """Bounds and constants of training.

    positives, unlabelled: rows of the labels table to learn from, at most; of the latter
    the labels stay unread.  prior: the share of positives among the unlabelled; None
    to estimate it from scores.
    """

    bits: int = 18
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)
    positives: int = 3000
    unlabelled: int = 6000
    prior: float | None = None
    first_prior: float = 0.1
    least_recall: float = 0.7
    least_texts: int = 5
    surprise: float = 5.0
    passes: int = 250
    step: float = 0.05
    decay: float = 2e-4
    slack: float = 0.0


@dataclass
class LinearModel:
    weights: np.ndarray
    bias: float
    settings: PUSettings

    def scores(self, rows: Rows) -> np.ndarray:
        docs = len(rows.starts) - 1
        total = np.bincount(row_numbers(rows), weights=self.weights[rows.ids], minlength=docs) if docs else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))


def risk(g: np.ndarray, positive: np.ndarray, prior: float, slack: float) -> tuple[float, np.ndarray]:
    """prior R_p(+) + max(0, R_u(-) - prior R_p(-)) with logistic losses, and its slope in g.

    Where the estimate of the negatives' risk falls below zero, the slope is that of
    this term alone, turned round (Kiryo and others, 2017), so that a flexible model
    can't turn unlabelled positives into negatives.
    """
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    p = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
    loss_negative = np.logaddexp(0, g)
    of_positives = prior * np.logaddexp(0, -g)[positive].sum() / n_p
    negatives = loss_negative[~positive].sum() / n_u - prior * loss_negative[positive].sum() / n_p
    slope = np.where(positive, -prior * p / n_p, p / n_u)
    if negatives < -slack:
        return of_positives, -slope
    slope[positive] += prior / n_p * (p[positive] - 1)
    return of_positives + max(0.0, negatives), slope


def train(rows: Rows, positive: np.ndarray, prior: float, settings: PUSettings) -> LinearModel:
    """Minimise the risk by gradient steps over all rows.

    Only features get a weight that at least ``least_texts`` toxic texts hold,
    ``surprise`` standard deviations more of them than of the unlabelled.  Without
    positives every score is low and alike.
    """
    if not positive.any():
        return LinearModel(np.zeros(1 << settings.bits), -4.0, settings)
    of_positive = np.repeat(positive, np.diff(rows.starts))
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    in_p = np.bincount(rows.ids[of_positive], minlength=1 << settings.bits)
    in_u = np.bincount(rows.ids[~of_positive], minlength=1 << settings.bits)
    usual = n_p * (in_u + 1) / (n_u + 2)
    chosen = (in_p >= settings.least_texts) & ((in_p - usual) / np.sqrt(usual) >= settings.surprise)
    keep = np.flatnonzero(chosen[rows.ids])
    row = np.searchsorted(rows.starts, keep, "right") - 1
    ids, n, docs = (np.cumsum(chosen) - 1)[rows.ids[keep]], int(chosen.sum()), len(positive)
    weights, bias = np.zeros(n), 0.0
    first, second, bias_1, bias_2 = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, settings.passes + 1):
        g = np.bincount(row, weights=weights[ids], minlength=docs) + bias
        _, slope = risk(g, positive, prior, settings.slack)
        gradient = np.bincount(ids, weights=slope[row], minlength=n) + settings.decay * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights -= settings.step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        g0 = slope.sum()
        bias_1, bias_2 = 0.9 * bias_1 + 0.1 * g0, 0.999 * bias_2 + 0.001 * g0**2
        bias -= settings.step * (bias_1 / (1 - 0.9**t)) / (np.sqrt(bias_2 / (1 - 0.999**t)) + 1e-8)
    full = np.zeros(1 << settings.bits)
    full[chosen] = weights
    return LinearModel(full, bias, settings)


def share_above(of_positives: np.ndarray, of_unlabelled: np.ndarray, least_recall: float) -> float:
    """The share of positives among the unlabelled, by scores of both that no training saw.

    At any threshold the unlabelled above it hold at least the positives' part of them;
    the least ratio of the two shares above, where enough positives are, bounds the prior.
    A standard error is added to the share of the unlabelled.
    """
    ordered, n = np.sort(of_positives), max(1, len(of_unlabelled))
    cuts = ordered[: max(1, int(len(ordered) * (1 - least_recall)))]
    above_p = 1 - np.searchsorted(ordered, cuts, "left") / len(ordered)
    above_u = 1 - np.searchsorted(np.sort(of_unlabelled), cuts, "left") / n
    return float(((above_u + np.sqrt(above_u * (1 - above_u) / n)) / above_p).min())


def subset(rows: Rows, chosen: np.ndarray) -> Rows:
    keep = np.repeat(chosen, np.diff(rows.starts))
    starts = np.concatenate([[0], np.cumsum(np.diff(rows.starts)[chosen])])
    return Rows(starts, rows.ids[keep], rows.counts[keep] if len(rows.counts) else rows.counts, rows.dense[chosen])


def estimated_prior(rows: Rows, positive: np.ndarray, ids: np.ndarray, settings: PUSettings) -> float:
    """Train on half of the documents and score the others, both ways; compare the two shares above a threshold.

    A document that is among the positives and the unlabelled is in one half with both.
    Scores that don't tell positives apart give no estimate under a half; then it is
    ``first_prior``.
    """
    half = np.array([zlib.crc32(str(i).encode()) >> 8 & 1 for i in ids.tolist()], np.bool_)
    scores = np.zeros(len(positive))
    for seen in (half, ~half):
        if not positive[seen].any() or positive[seen].all():
            return settings.first_prior
        model = train(subset(rows, seen), positive[seen], settings.first_prior, settings)
        scores[~seen] = model.scores(subset(rows, ~seen))
    found = share_above(scores[positive], scores[~positive], settings.least_recall)
    return found if 0 < found < 0.5 else settings.first_prior
