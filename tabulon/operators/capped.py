"""Models without a pyspark.ml estimator: fitted in NumPy on a bounded sample of rows, applied to all rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A fitted model is the name of a scoring function in SCORES and the arrays it needs, so that it can be written and read.
Fitted = tuple[str, dict]
Fit = Callable[[np.ndarray, np.ndarray, np.random.Generator], Fitted]


class Capped:
    """fit() draws at most cap rows by hash, which is the model's documented bound; transform() scores any number of rows.

    The fitted function gives predictions for regression, and a row of class probabilities for classification.
    """

    def __init__(self, fit: Fit, classes: int, cap: int, seed: int = 42) -> None:
        self.make, self.classes, self.cap, self.seed = fit, classes, cap, seed
        self.fitted: Fitted | None = None

    def fit(self, df: DataFrame) -> Capped:
        rows = df.select("label", vector_to_array("features").alias("x")).orderBy(F.xxhash64("x", "label", F.lit(self.seed)), "label").limit(self.cap).toPandas()
        x = np.array(rows["x"].tolist(), float).reshape(len(rows), -1)
        y = rows["label"].to_numpy(float)
        target = np.eye(self.classes)[y.astype(int)] if self.classes else y[:, None]
        self.fitted = self.make(x, target, np.random.default_rng(self.seed))
        return self

    def state(self) -> dict:
        """What JSON can hold of a fitted model."""
        return {"classes": self.classes, "cap": self.cap, "seed": self.seed, "score": self.fitted[0], "arrays": {k: _written(v) for k, v in self.fitted[1].items()}}

    @classmethod
    def restored(cls, state: dict) -> Capped:
        out = cls(None, state["classes"], state["cap"], state["seed"])
        if state["score"] not in SCORES:
            raise ValueError(f"no model {state['score']!r}")
        out.fitted = state["score"], {k: _read(v) for k, v in state["arrays"].items()}
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        (name, arrays), classes = self.fitted, self.classes
        score = SCORES[name](**arrays)

        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                x = np.array(part.tolist(), float).reshape(len(part), -1)
                out = np.concatenate([score(x[low : low + 1024]) for low in range(0, len(x), 1024)]) if len(x) else np.zeros((0, max(1, classes)))
                yield pd.Series(list(out))

        out = df.withColumn("_p", run(vector_to_array("features")))
        if not classes:
            return out.withColumn("prediction", F.col("_p")[0]).drop("_p")
        best = F.array_position("_p", F.array_max("_p")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("_p")).drop("_p")


def _written(v):  # noqa: ANN001, ANN202
    return [_written(x) for x in v] if isinstance(v, list) else {"array": v.tolist(), "shape": list(v.shape)} if isinstance(v, np.ndarray) else v


def _read(v):  # noqa: ANN001, ANN202
    return [_read(x) for x in v] if isinstance(v, list) else np.array(v["array"], float).reshape(v["shape"]) if isinstance(v, dict) else v


def _shares(p: np.ndarray) -> np.ndarray:
    """Scores of classes as shares, if there are several columns."""
    if p.shape[1] == 1:
        return p
    p = np.maximum(p, 0) + 1e-9
    return p / p.sum(1, keepdims=True)


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    std = x.std(0)
    return x.mean(0), np.where(std > 1e-12, std, 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def _gaussian(gamma: float, x: np.ndarray, weights: np.ndarray, mean: np.ndarray):  # noqa: ANN202
    """Weighted Gaussian kernels around rows."""
    return lambda z: _shares(np.exp(-gamma * _distances(z, x)) @ weights + mean)


def kernel_ridge(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, penalty: float = 1.0):  # noqa: ANN201
    """Least squares in the space of a Gaussian kernel."""
    gamma = 1 / max(1, x.shape[1])
    k = np.exp(-gamma * _distances(x, x))
    mean = y.mean(0)
    return "gaussian", {"gamma": gamma, "x": x, "weights": np.linalg.solve(k + penalty * np.eye(len(x)), y - mean), "mean": mean}


def gaussian_process(x: np.ndarray, y: np.ndarray, rng: np.random.Generator):  # noqa: ANN201
    """The mean of a Gaussian process whose width and noise have the best marginal likelihood of a small grid."""
    mean, best = y.mean(0), None
    d = _distances(x, x)
    for gamma in (0.1, 0.3, 1.0):
        for noise in (0.01, 0.1, 1.0):
            low = np.linalg.cholesky(np.exp(-gamma / max(1, x.shape[1]) * d) + noise * np.eye(len(x)))
            a = np.linalg.solve(low.T, np.linalg.solve(low, y - mean))
            value = -0.5 * float(((y - mean) * a).sum()) - y.shape[1] * float(np.log(np.diag(low)).sum())
            if best is None or value > best[0]:
                best = (value, gamma / max(1, x.shape[1]), a)
    return "gaussian", {"gamma": best[1], "x": x, "weights": best[2], "mean": mean}


def fourier_machine(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, width: int = 300, steps: int = 300):  # noqa: ANN201
    """A Gaussian-kernel support vector machine, approximately: hinge (or absolute) loss on random Fourier features."""
    w, b = rng.standard_normal((x.shape[1], width)) * np.sqrt(2 / max(1, x.shape[1])), rng.uniform(0, 2 * np.pi, width)
    lift = lambda z: np.column_stack([np.cos(z @ w + b) * np.sqrt(2 / width), np.ones(len(z))])
    f, several = lift(x), y.shape[1] > 1
    scale = 1.0 if several else max(float(y.std()), 1e-9)
    t = 2 * y - 1 if several else (y - y.mean()) / scale
    v = np.zeros((width + 1, y.shape[1]))
    for s in range(steps):
        out = f @ v
        g = np.where(t * out < 1, -t, 0) if several else np.sign(out - t) * (np.abs(out - t) > 0.1)
        v -= 5 / np.sqrt(1 + s) * (f.T @ g / len(f) + 1e-4 * v)
    return "fourier", {"w": w, "b": b, "v": v, "several": several, "scale": scale, "mean": 0.0 if several else float(y.mean())}


def _waves(w: np.ndarray, b: np.ndarray, v: np.ndarray, several: bool, scale: float, mean: float):  # noqa: ANN202
    lift = lambda z: np.column_stack([np.cos(z @ w + b) * np.sqrt(2 / len(b)), np.ones(len(z))])
    return (lambda z: _shares(1 / (1 + np.exp(-2 * lift(z) @ v)))) if several else lambda z: lift(z) @ v * scale + mean


def _plane(m: np.ndarray, s: np.ndarray, w: np.ndarray, mean: np.ndarray):  # noqa: ANN202
    """A linear function of scaled columns."""
    return lambda q: (q - m) / s @ w + mean


def _flat(w: np.ndarray) -> Fitted:
    """Weights of columns and, last, the constant."""
    width = len(w) - 1
    return "plane", {"m": np.zeros(width), "s": np.ones(width), "w": w[:-1], "mean": w[-1]}


def theil_sen(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, rounds: int = 300):  # noqa: ANN201
    """The median, coordinate by coordinate, of least-squares fits of random subsets."""
    z, n = np.column_stack([x, np.ones(len(x))]), min(len(x), x.shape[1] + 2)
    fits = [np.linalg.lstsq(z[k], y[k], rcond=None)[0] for k in (rng.choice(len(x), n, False) for _ in range(rounds))]
    return _flat(np.median(np.stack(fits), 0))


def ransac(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, rounds: int = 100):  # noqa: ANN201
    """Least squares on the rows that agree with the random subset most agree with."""
    z, n = np.column_stack([x, np.ones(len(x))]), min(len(x), x.shape[1] + 2)
    limit = np.median(np.abs(y - np.median(y))) or 1.0
    best = np.ones(len(x), bool)
    most = 0
    for _ in range(rounds):
        k = rng.choice(len(x), n, False)
        near = (np.abs(z @ np.linalg.lstsq(z[k], y[k], rcond=None)[0] - y) <= limit).all(1)
        if near.sum() > most:
            best, most = near, near.sum()
    return _flat(np.linalg.lstsq(z[best], y[best], rcond=None)[0])


def bayesian_ridge(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, rounds: int = 50):  # noqa: ANN201
    """Ridge whose penalty follows from the evidence."""
    m, s = _centred(x)
    z, t, mean = (x - m) / s, y - y.mean(0), y.mean(0)
    u, d, vt = np.linalg.svd(z, full_matrices=False)
    noise, weight = 1 / max(float(t.var()), 1e-9), 1.0
    uy = u.T @ t
    for _ in range(rounds):
        gain = d**2 * noise
        w = vt.T @ ((d * noise / (gain + weight))[:, None] * uy)
        used = float((gain / (gain + weight)).sum())
        weight = used / max(float((w**2).sum()), 1e-12)
        noise = (len(z) - used) / max(float(((t - z @ w) ** 2).sum()), 1e-12)
    return "plane", {"m": m, "s": s, "w": w, "mean": mean}


def partial_least_squares(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, parts: int = 2):  # noqa: ANN201
    """Two directions that covary most with the target, one after the other."""
    m, s = _centred(x)
    z, t, mean = (x - m) / s, y - y.mean(0), y.mean(0)
    ws, ps, qs = [], [], []
    for _ in range(min(parts, z.shape[1])):
        w = z.T @ t[:, :1]
        w /= max(float(np.linalg.norm(w)), 1e-12)
        a = z @ w
        size = max(float((a**2).sum()), 1e-12)
        p, q = z.T @ a / size, t.T @ a / size
        z, t = z - a @ p.T, t - a @ q.T
        ws.append(w), ps.append(p), qs.append(q)
    w, p, q = np.hstack(ws), np.hstack(ps), np.hstack(qs)
    beta = w @ np.linalg.pinv(p.T @ w) @ q.T
    return "plane", {"m": m, "s": s, "w": beta, "mean": mean}


def boosted_stumps(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, rounds: int = 200):  # noqa: ANN201
    """AdaBoost of one-split trees: reweighted votes for classes, residual fits for numbers."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.05, 0.95, 19))) for k in range(x.shape[1])]
    several = y.shape[1] > 1
    weights, out, residual = np.full(len(x), 1 / len(x)), [], y - y.mean(0)
    for _ in range(rounds):
        best = None
        target = y if several else residual
        for k, c in enumerate(cuts):
            for v in c:
                side = x[:, k] <= v
                left = (weights[side, None] * target[side]).sum(0) / max(weights[side].sum(), 1e-12)
                right = (weights[~side, None] * target[~side]).sum(0) / max(weights[~side].sum(), 1e-12)
                guess = np.where(side[:, None], left, right)
                loss = float((weights * (guess.argmax(1) != y.argmax(1))).sum()) if several else float((weights * ((target - guess) ** 2).sum(1)).sum())
                if best is None or loss < best[0]:
                    best = (loss, k, v, left, right, guess)
        loss, k, v, left, right, guess = best
        if several:
            wrong = guess.argmax(1) != y.argmax(1)
            vote = np.log((1 - loss + 1e-9) / (loss + 1e-9)) + np.log(y.shape[1] - 1)
            if vote <= 0:
                break
            out.append((k, v, vote * (left == left.max()), vote * (right == right.max())))
            weights = weights * np.exp(np.clip(vote, 0, 10) * wrong)
            weights /= weights.sum()
            if loss < 1e-9:
                break
        else:
            out.append((k, v, 0.2 * left, 0.2 * right))
            residual = residual - 0.2 * guess
    wide = y.shape[1]
    sides = [np.array([np.broadcast_to(o[k], wide) for o in out], float).reshape(len(out), wide) for k in (2, 3)]
    return "stumps", {"columns": np.array([o[0] for o in out], float), "cuts": np.array([o[1] for o in out], float), "left": sides[0], "right": sides[1], "base": np.zeros(wide) if several else y.mean(0)}


def _stumps(columns: np.ndarray, cuts: np.ndarray, left: np.ndarray, right: np.ndarray, base: np.ndarray):  # noqa: ANN202
    def score(z: np.ndarray) -> np.ndarray:
        total = np.zeros((len(z), len(base))) + base
        for k, v, one, two in zip(columns.astype(int), cuts, left, right, strict=True):
            total += np.where((z[:, k] <= v)[:, None], one, two)
        return _shares(total)

    return score


def network(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, hidden: tuple[int, int] = (64, 32), epochs: int = 200, batch: int = 64):  # noqa: ANN201
    """A two-layer network for numbers, trained by Adam."""
    m, s = _centred(x)
    scale, mean = max(float(y.std()), 1e-9), y.mean(0)
    sizes = [x.shape[1], *hidden, y.shape[1]]
    ws = [rng.standard_normal((a, b)) * np.sqrt(2 / max(1, a)) for a, b in zip(sizes, sizes[1:], strict=False)]
    bs = [np.zeros(b) for b in sizes[1:]]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in ws + bs]
    z, t, step = (x - m) / s, (y - mean) / scale, 0

    def forward(q: np.ndarray) -> list[np.ndarray]:
        layers = [q]
        for k, (w, b) in enumerate(zip(ws, bs, strict=True)):
            v = layers[-1] @ w + b
            layers.append(np.maximum(v, 0) if k < len(ws) - 1 else v)
        return layers

    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
            layers, step = forward(z[rows]), step + 1
            g = 2 * (layers[-1] - t[rows]) / len(rows)
            grads_w, grads_b = [], []
            for k in range(len(ws) - 1, -1, -1):
                grads_w.insert(0, layers[k].T @ g + 1e-4 * ws[k])
                grads_b.insert(0, g.sum(0))
                g = (g @ ws[k].T) * (layers[k] > 0)
            for p, grad, mo in zip(ws + bs, grads_w + grads_b, moments, strict=True):
                mo[0][:] = 0.9 * mo[0] + 0.1 * grad
                mo[1][:] = 0.999 * mo[1] + 0.001 * grad**2
                p -= 0.003 * (mo[0] / (1 - 0.9**step)) / (np.sqrt(mo[1] / (1 - 0.999**step)) + 1e-8)
    return "network", {"ws": ws, "bs": bs, "m": m, "s": s, "scale": scale, "mean": mean}


def _layers(ws: list, bs: list, m: np.ndarray, s: np.ndarray, scale: float, mean: np.ndarray):  # noqa: ANN202
    def score(q: np.ndarray) -> np.ndarray:
        out = (q - m) / s
        for k, (w, b) in enumerate(zip(ws, bs, strict=True)):
            out = out @ w + b if k == len(ws) - 1 else np.maximum(out @ w + b, 0)
        return out * scale + mean

    return score


SCORES: dict[str, Callable] = {"gaussian": _gaussian, "fourier": _waves, "plane": _plane, "stumps": _stumps, "network": _layers}


def oversample(df: DataFrame, label: str = "label", features: str = "features", k: int = 5, reference: int = 2000, seed: int = 42) -> DataFrame:
    """df with made rows of rarer classes, each between a row and one of its k nearest of a bounded sample of its class.

    Each row of a class makes as many new ones as bring the class near the largest; all classes are worked on at once.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    most = max(counts.values())
    pools = {}
    for c, n in counts.items():
        if n < most:
            rows = df.where(F.col(label) == c).select(vector_to_array(features).alias("x")).orderBy(F.xxhash64("x", F.lit(seed))).limit(reference).toPandas()
            pools[c] = np.array(rows["x"].tolist(), float)

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[tuple] = []
            for c, x in zip(part["label"], part["x"], strict=True):
                pool = pools.get(c)
                if pool is None or len(pool) < 2:
                    continue
                x = np.array(x, float)
                d = ((pool - x) ** 2).sum(1)
                near = np.argsort(d, kind="stable")[1 : k + 1]
                rng = np.random.default_rng(abs(hash((seed, c, *x.tolist()))) % 2**63)
                extra = (most - counts[c]) / counts[c]
                for _ in range(int(extra) + (rng.random() < extra % 1)):
                    out.append((c, (x + rng.random() * (pool[rng.choice(near)] - x)).tolist()))
            yield pd.DataFrame(out, columns=["label", "x"])

    rows = df.select(F.col(label).cast("double").alias("label"), vector_to_array(features).alias("x"))
    new = rows.mapInPandas(made, "label double, x array<double>")
    return rows.unionByName(new).select(F.col("label").alias(label), array_to_vector("x").alias(features))
