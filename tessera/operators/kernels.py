"""Support vector regression on random Fourier features, and a network of one hidden layer: trained where the rows are.

Partitions send sums (or parameters, averaged by rows) of fixed size, which Spark adds in pieces; no table is ever in one task
or on the driver. All folds are trained in the same passes: a row counts for every model but that of its own fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Random features, passes of reweighting, and the least distance from the tube that weighs a row.
FEATURES, PASSES, LEAST = 200, 12, 1e-3
#: Rounds of averaging, passes over a batch within a round, rows of a step.
ROUNDS, EPOCHS, STEP = 10, 30, 64
#: Rows of a partition that are worked on at a time.
BLOCK = 8_192
_PIECE = 1 << 14


def learns(codes: np.ndarray, key: int, inner: int = 0) -> np.ndarray:
    """Which rows the model of a key learns from: those of the other folds; of the other inner folds, too, where codes and keys hold both (fold * inner + inner fold)."""
    if not inner:
        return codes != key
    return (codes // inner != key // inner) & (codes % inner != key % inner)


def judged(codes: np.ndarray, key: int, inner: int) -> np.ndarray:
    """Which rows judge the model of an outer and inner fold: those of the inner fold outside of the outer one."""
    return (codes // inner != key // inner) & (codes % inner == key % inner)


def squared_errors(df: DataFrame, x: Sequence[str], y: str, code: str, models: dict[int, list[tuple[SupportVectors | Network, dict]]], inner: int) -> dict[int, list[float]]:
    """Mean squared error of the models of every key (a list, one per setting) on the rows that judge them, in one pass; NaN without rows."""
    keys = list(models)

    def add(v: np.ndarray, _: int) -> np.ndarray:
        out = []
        for k in keys:
            z = v[judged(v[:, -1], k, inner)]
            out.append(float(len(z)))
            out += [float(((kernel.predict(state, z[:, :-2]) - z[:, -2]) ** 2).sum()) if len(z) else 0.0 for kernel, state in models[k]]
        return np.array(out)

    sums, at, found = summed(df, [*x, y, code], add), 0, {}
    for k in keys:
        n, part = sums[at], sums[at + 1 : at + 1 + len(models[k])]
        found[k] = (part / n).tolist() if n else [float("nan")] * len(part)
        at += 1 + len(models[k])
    return found


def summed(df: DataFrame, columns: Sequence[str], add: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Sum over all partitions of what ``add`` makes of their rows (a matrix of the columns, and the partition's number)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """A partition's rows, BLOCK at a time, however Arrow has cut them."""
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([np.asarray(c.cast(pa.float64()).fill_null(np.nan)) for c in batch.columns], 1))
            n += len(batch)
            while n >= BLOCK:
                rows = np.concatenate(held)
                yield rows[:BLOCK]
                held, n = [rows[BLOCK:]], n - BLOCK
        if n:
            yield np.concatenate(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in blocks(batches):
            part = add(x, TaskContext.get().partitionId())
            total = part if total is None else total + part
        if total is not None:
            pieces = [total[i : i + _PIECE].tobytes() for i in range(0, len(total), _PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "numbers"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, numbers in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(numbers.as_buffer(), float)
                sums[piece] = sums[piece] + x if piece in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "numbers"])

    kind = "piece int, numbers binary"
    rows = df.select(*[F.col(f"`{c}`").cast("double") for c in columns]).mapInArrow(run, kind).repartition(8, "piece").mapInArrow(fold, kind).collect()
    return np.concatenate([np.frombuffer(r.numbers, float) for r in sorted(rows, key=lambda r: r.piece)]) if rows else np.zeros(0)


def _scales(df: DataFrame, x: Sequence[str], y: str, fold: str, keys: Sequence[int], inner: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Means and deviations of predictors and target over the training rows of every key."""
    p = len(x) + 1

    def add(v: np.ndarray, _: int) -> np.ndarray:
        out = []
        for k in keys:
            z = v[learns(v[:, p], k, inner), :p]
            out += [[len(z)], z.sum(0), (z**2).sum(0)]
        return np.concatenate(out)

    shift = np.array(df.agg(*[F.avg(f"`{c}`").cast("double") for c in (*x, y)]).first(), float)  # sums of squares about the mean keep their digits
    sums = summed(df.select(*[(F.col(f"`{c}`") - F.lit(float(s))).alias(f"v{i}") for i, (c, s) in enumerate(zip((*x, y), shift, strict=True))], F.col(fold).alias("k")), [*(f"v{i}" for i in range(p)), "k"], add)
    found = {}
    for k, part in zip(keys, sums.reshape(len(keys), -1), strict=True):
        n, first, second = part[0], part[1 : p + 1], part[p + 1 :]
        if n < 2:
            raise ValueError(f"fold {k} leaves {int(n)} rows to learn from")
        sd = np.sqrt(np.maximum(second / n - (first / n) ** 2, 0))
        found[k] = (shift + first / n, np.where(sd > 0, sd, 1.0))
    return found


class SupportVectors:
    """Regression with an insensitive tube: random Fourier features of the RBF kernel, fitted by reweighted least squares."""

    def __init__(self, c: float = 1.0, epsilon: float = 0.1, gamma: float | None = None, features: int = FEATURES, seed: int = 0):
        self.c, self.epsilon, self.gamma, self.features, self.seed = c, epsilon, gamma, features, seed

    def map(self, z: np.ndarray) -> np.ndarray:
        """Features of standardised rows, and a one."""
        rng = np.random.default_rng(self.seed)
        gamma = self.gamma or 1 / z.shape[1]
        w, b = rng.normal(0, np.sqrt(2 * gamma), (z.shape[1], self.features)), rng.uniform(0, 2 * np.pi, self.features)
        return np.hstack([np.sqrt(2 / self.features) * np.cos(z @ w + b), np.ones((len(z), 1))])

    def fit(self, df: DataFrame, x: Sequence[str], y: str, fold: str, keys: Sequence[int], inner: int = 0) -> dict[int, dict]:
        scales, q = _scales(df, x, y, fold, keys, inner), self.features + 1
        weights = {k: None for k in keys}
        for _ in range(PASSES):

            def add(v: np.ndarray, _: int, weights=weights) -> np.ndarray:
                out = []
                for k in keys:
                    z = (v[learns(v[:, -1], k, inner), :-1] - scales[k][0]) / scales[k][1]
                    h, t = self.map(z[:, :-1]), z[:, -1]
                    if weights[k] is None:
                        a, target = np.ones(len(t)), t
                    else:  # rows within the tube count nothing, the others by the distance from it
                        r = t - h @ weights[k]
                        off = np.abs(r) - self.epsilon
                        a, target = np.where(off > 0, 1 / np.maximum(off, LEAST), 0), t - self.epsilon * np.sign(r)
                    out += [(h.T @ (h * a[:, None])).ravel(), h.T @ (a * target)]
                return np.concatenate(out)

            sums = summed(df, [*x, y, fold], add).reshape(len(keys), -1)
            ridge = np.diag(np.append(np.full(self.features, 1 / self.c), 1e-6))
            weights = {k: np.linalg.solve(s[: q * q].reshape(q, q) + ridge, s[q * q :]) for k, s in zip(keys, sums, strict=True)}
        return {k: {"center": scales[k][0].tolist(), "scale": scales[k][1].tolist(), "weights": weights[k].tolist()} for k in keys}

    def predict(self, state: dict, v: np.ndarray) -> np.ndarray:
        center, scale = np.array(state["center"]), np.array(state["scale"])
        return self.map((v - center[:-1]) / scale[:-1]) @ np.array(state["weights"]) * scale[-1] + center[-1]


class SupportVectorClassifier(SupportVectors):
    """Classes by squared hinge loss on the same features, one against the rest, with probabilities.

    Every class's margin is turned into a probability by a sigmoid, fitted on margins of models that haven't seen the row:
    three of them are trained beside the final one, each without the rows of one part, in the same passes.
    """

    PARTS = 3

    def __init__(self, c: float = 1.0, gamma: float | None = None, features: int = FEATURES, seed: int = 0):
        super().__init__(c, 0.0, gamma, features, seed)

    def fit_classes(self, df: DataFrame, x: Sequence[str], y: str, part: str, n_classes: int) -> dict:
        """State of the classifier; ``y`` holds class numbers from 0, ``part`` the parts 0 to PARTS - 1."""
        keys, q = list(range(self.PARTS + 1)), self.features + 1  # the last key leaves no part out
        scales = _scales(df, x, y, part, keys)
        ones = list(range(n_classes)) if n_classes > 2 else [1]
        z = lambda v, k: (v[:, :-2] - scales[k][0][:-1]) / scales[k][1][:-1]
        weights = np.zeros((len(keys), len(ones), q))
        for _ in range(PASSES):

            def add(v: np.ndarray, _: int, weights=weights) -> np.ndarray:
                out = []
                for i, k in enumerate(keys):
                    own = v[learns(v[:, -1], k)]
                    h = self.map(z(own, k))
                    for j, c in enumerate(ones):
                        t = np.where(own[:, -2] == c, 1.0, -1.0)
                        a = (t * (h @ weights[i, j]) < 1).astype(float)  # rows beyond the margin count nothing
                        out += [(h.T @ (h * a[:, None])).ravel(), h.T @ (a * t)]
                return np.concatenate(out)

            sums = summed(df, [*x, y, part], add).reshape(len(keys), len(ones), -1)
            ridge = np.diag(np.append(np.full(self.features, 1 / (2 * self.c)), 1e-6))
            weights = np.array([[np.linalg.solve(s[: q * q].reshape(q, q) + ridge, s[q * q :]) for s in row] for row in sums])

        def margins(v: np.ndarray) -> np.ndarray:
            """Of every row and class, by the model without the row's part."""
            out = np.zeros((len(v), len(ones)))
            for i, k in enumerate(keys[:-1]):
                at = v[:, -1] == k
                out[at] = self.map(z(v[at], k)) @ weights[i].T
            return out

        counts = summed(df, [*x, y, part], lambda v, _: np.array([float((v[:, -2] == c).sum()) for c in ones] + [float(len(v))]))
        yes, no = counts[:-1], counts[-1] - counts[:-1]
        high, low = (yes + 1) / (yes + 2), 1 / (no + 2)
        sigmoid = np.stack([np.full(len(ones), 1.0), np.log((yes + 1) / (no + 1))], 1)
        for _ in range(PASSES):

            def slopes(v: np.ndarray, _: int, sigmoid=sigmoid) -> np.ndarray:
                m, out = margins(v), []
                for j, c in enumerate(ones):
                    p = 1 / (1 + np.exp(-np.clip(sigmoid[j, 0] * m[:, j] + sigmoid[j, 1], -30, 30)))
                    e, w = p - np.where(v[:, -2] == c, high[j], low[j]), p * (1 - p)
                    out += [e @ m[:, j], e.sum(), w @ m[:, j] ** 2, w @ m[:, j], w.sum()]
                return np.array(out)

            g = summed(df, [*x, y, part], slopes).reshape(len(ones), 5)
            steps = np.array([np.linalg.solve([[a + 1e-6, b], [b, d + 1e-6]], [s, i]) for s, i, a, b, d in g])
            sigmoid = sigmoid - np.clip(steps, -2, 2)
            if np.abs(steps).max() < 1e-8:
                break
        center, scale = scales[keys[-1]]
        return {"center": center[:-1].tolist(), "scale": scale[:-1].tolist(), "weights": weights[-1].tolist(), "sigmoid": sigmoid.tolist()}

    def probabilities(self, state: dict, v: np.ndarray) -> np.ndarray:
        """A column per class; rows add up to 1."""
        m = self.map((v - np.array(state["center"])) / np.array(state["scale"])) @ np.array(state["weights"]).T
        s = np.array(state["sigmoid"])
        p = 1 / (1 + np.exp(-np.clip(m * s[:, 0] + s[:, 1], -30, 30)))
        return np.hstack([1 - p, p]) if p.shape[1] == 1 else p / p.sum(1, keepdims=True)


def class_probabilities(df: DataFrame, x: Sequence[str], kernel: SupportVectorClassifier, state: dict, out: str) -> DataFrame:
    """Adds the array of every row's class probabilities."""

    def value(*columns):
        import pandas as pd

        return pd.Series(list(kernel.probabilities(state, np.stack([c.to_numpy(float) for c in columns], 1))))

    return df.withColumn(out, F.pandas_udf(value, "array<double>")(*[F.col(f"`{c}`").cast("double") for c in x]))


class Network:
    """One hidden logistic layer on standardised rows and target: steps of Adam within partitions, parameters averaged."""

    def __init__(self, hidden: int = 100, ridge: float = 1e-4, rate: float = 0.01, seed: int = 0):
        self.hidden, self.ridge, self.rate, self.seed = hidden, ridge, rate, seed

    def _parts(self, theta: np.ndarray, p: int) -> list[np.ndarray]:
        h = self.hidden
        return [theta[: p * h].reshape(p, h), theta[p * h : p * h + h], theta[p * h + h : p * h + 2 * h], theta[p * h + 2 * h :]]

    def gradient(self, theta: np.ndarray, z: np.ndarray, t: np.ndarray) -> np.ndarray:
        w, b, u, c = self._parts(theta, z.shape[1])
        h = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        e = (h @ u + c - t) / len(t)
        back = np.outer(e, u) * h * (1 - h)
        return np.concatenate([(z.T @ back + self.ridge * w).ravel(), back.sum(0), h.T @ e + self.ridge * u, [e.sum()]])

    def _steps(self, theta: np.ndarray, z: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        m, v, n = np.zeros_like(theta), np.zeros_like(theta), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(t))
            for lo in range(0, len(t), STEP):
                at, n = order[lo : lo + STEP], n + 1
                g = self.gradient(theta, z[at], t[at])
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                theta = theta - self.rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
        return theta

    def fit(self, df: DataFrame, x: Sequence[str], y: str, fold: str, keys: Sequence[int], inner: int = 0) -> dict[int, dict]:
        scales, p, rng = _scales(df, x, y, fold, keys, inner), len(x), np.random.default_rng(self.seed)
        first = np.concatenate([rng.normal(0, 1 / np.sqrt(p), p * self.hidden), np.zeros(self.hidden), rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), [0.0]])
        theta = {k: first for k in keys}
        for number in range(ROUNDS):

            def add(v: np.ndarray, part: int, theta=theta, number=number) -> np.ndarray:
                out = []
                for k in keys:
                    z = (v[learns(v[:, -1], k, inner), :-1] - scales[k][0]) / scales[k][1]
                    new = self._steps(theta[k], z[:, :-1], z[:, -1], np.random.default_rng([self.seed, number, part])) if len(z) else theta[k]
                    out.append(np.append(new * len(z), len(z)))
                return np.concatenate(out)

            sums = summed(df, [*x, y, fold], add).reshape(len(keys), -1)
            theta = {k: s[:-1] / s[-1] for k, s in zip(keys, sums, strict=True)}
        return {k: {"center": scales[k][0].tolist(), "scale": scales[k][1].tolist(), "weights": theta[k].tolist()} for k in keys}

    def predict(self, state: dict, v: np.ndarray) -> np.ndarray:
        center, scale = np.array(state["center"]), np.array(state["scale"])
        w, b, u, c = self._parts(np.array(state["weights"]), v.shape[1])
        h = 1 / (1 + np.exp(-np.clip((v - center[:-1]) / scale[:-1] @ w + b, -30, 30)))
        return (h @ u + c) * scale[-1] + center[-1]


KERNELS = {"svr": SupportVectors, "mlp": Network}


def predicted(df: DataFrame, x: Sequence[str], kernel: SupportVectors | Network, states: dict[int, dict], fold: str | None = None) -> DataFrame:
    """Adds predicted to every row: by the model of its fold, or by the only one."""

    def value(*columns):
        import pandas as pd

        v = np.stack([c.to_numpy(float) for c in columns[: len(x)]], 1)
        out = np.full(len(v), np.nan)
        keys = columns[-1].to_numpy() if fold else np.zeros(len(v))
        for k in np.unique(keys):
            at = keys == k
            out[at] = kernel.predict(states[int(k)] if fold else next(iter(states.values())), v[at])
        return pd.Series(out)

    return df.withColumn("predicted", F.pandas_udf(value, "double")(*[F.col(f"`{c}`").cast("double") for c in x], *([F.col(fold)] if fold else [])))
