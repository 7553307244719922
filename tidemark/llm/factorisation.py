"""A factorisation machine on hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .features import Rows, row_numbers


@dataclass(frozen=True)
class FMSettings:
    """Bounds and constants of training; ``examples`` bounds the labelled sample."""

    bits: int = 16
    prefixes: tuple[int, ...] = ()
    rank: int = 6
    examples: int = 8000
    passes: int = 8
    batch: int = 128
    step: float = 0.05
    decay: float = 1e-4
    word_scale: float = 0.5
    least_texts: int = 3


def inputs(rows: Rows, words: int, mean: np.ndarray, spread: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value): damped word counts of unit length a row times ``scale``, then the dense columns."""
    docs = len(rows.starts) - 1
    row = row_numbers(rows)
    value = np.log1p(rows.counts.astype(np.float64))
    length = np.sqrt(np.bincount(row, weights=value**2, minlength=docs)) if docs else np.zeros(0)
    dense = np.clip((rows.dense - mean) / spread, -4, 4)
    row = np.concatenate([row, np.repeat(np.arange(docs), dense.shape[1])])
    value = np.concatenate([scale * value / np.maximum(length, 1e-9)[row[: len(value)]], dense.ravel() / np.sqrt(dense.shape[1])])
    return row, np.concatenate([rows.ids.astype(np.int64), np.tile(words + np.arange(dense.shape[1]), docs)]), value


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    settings: FMSettings

    def raw(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """bias + w.x + the sum over factors of ((v.x)^2 - v^2.x^2) / 2: linear in the features of a row."""
        total = self.bias + np.bincount(row, weights=self.linear[feature] * value, minlength=docs)
        for k in range(self.factors.shape[1]):
            vx = self.factors[feature, k] * value
            total += 0.5 * (np.bincount(row, weights=vx, minlength=docs) ** 2 - np.bincount(row, weights=vx**2, minlength=docs))
        return total

    def scores(self, rows: Rows) -> np.ndarray:
        docs = len(rows.starts) - 1
        if not docs:
            return np.zeros(0)
        row, feature, value = inputs(rows, 1 << self.settings.bits, self.mean, self.spread, self.settings.word_scale)
        return 1 / (1 + np.exp(-np.clip(self.raw(row, feature, value, docs), -40, 40)))


def train(rows: Rows, label: np.ndarray, settings: FMSettings) -> FactorisationMachine:
    """Logistic loss, AdaGrad in small batches, the order drawn from a fixed seed.

    Words seen in fewer than ``least_texts`` examples keep zero weights.  Without examples every score is 0.5.
    """
    if not len(label):
        dense = rows.dense.shape[1]
        size = (1 << settings.bits) + dense
        return FactorisationMachine(0.0, np.zeros(size), np.zeros((size, settings.rank)), np.zeros(dense), np.ones(dense), settings)
    rng, words, docs = np.random.default_rng(7), 1 << settings.bits, len(label)
    mean, spread = rows.dense.mean(axis=0), rows.dense.std(axis=0) + 1e-3
    size = words + rows.dense.shape[1]
    row, feature, value = inputs(rows, words, mean, spread, settings.word_scale)
    common = np.bincount(feature, minlength=size) >= settings.least_texts
    order = np.argsort(row[common[feature]], kind="stable")
    row, feature, value = row[common[feature]][order], feature[common[feature]][order], value[common[feature]][order]
    starts = np.searchsorted(row, np.arange(docs + 1))
    model = FactorisationMachine(0.0, np.zeros(size), np.where(common[:, None], rng.normal(0, 0.05, (size, settings.rank)), 0), mean, spread, settings)
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, settings.rank), 1e-6), 1e-6
    model.bias = float(np.log((label.sum() + 1) / (docs - label.sum() + 1)))
    for _ in range(settings.passes):
        for some in np.array_split(rng.permutation(docs), max(1, docs // settings.batch)):
            count = starts[some + 1] - starts[some]
            at = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            r, f, x = np.repeat(np.arange(len(some)), count), feature[at], value[at]
            g = 1 / (1 + np.exp(-np.clip(model.raw(r, f, x, len(some)), -40, 40))) - label[some]
            ids, place = np.unique(f, return_inverse=True)
            gx = g[r] * x / len(some)
            step_w = np.bincount(place, weights=gx, minlength=len(ids)) + settings.decay * model.linear[ids]
            steps_v = []
            for k in range(settings.rank):
                v = model.factors[f, k]
                inner = np.bincount(r, weights=v * x, minlength=len(some))
                steps_v.append(np.bincount(place, weights=gx * (inner[r] - v * x), minlength=len(ids)) + settings.decay * model.factors[ids, k])
            step_v = np.stack(steps_v, axis=1)
            seen_w[ids] += step_w**2
            seen_v[ids] += step_v**2
            seen_b += g.mean() ** 2
            model.linear[ids] -= settings.step * step_w / np.sqrt(seen_w[ids])
            model.factors[ids] -= settings.step * step_v / np.sqrt(seen_v[ids])
            model.bias -= settings.step * g.mean() / np.sqrt(seen_b)
    return model
