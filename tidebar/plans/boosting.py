"""Gradient boosting over binned features, one logistic model a class, in numpy: all nodes of a tree's level at once.

A training window has a bounded number of bars, so one task learns a fold; folds and strategies run side by side.
Bins are counted for every node and feature of a level by one histogram.
"""

from __future__ import annotations

import numpy as np

# Bins of a feature, most rounds and levels, levels where none are set, rows and columns that sampling must leave.
BINS, MAX_ROUNDS, MAX_DEPTH, DEFAULT_DEPTH, LEAST_ROWS, LEAST_COLUMNS = 32, 200, 6, 4, 50, 2


class Boosted:
    """fit(x, y, classes), predict(x) -> [n, classes] that sum to 1, gain -> importance of each feature."""

    def __init__(self, rounds: int, rate: float, depth: int, min_rows: int, ridge: float, rows: float = 1.0, columns: float = 1.0, seed: int = 0):
        self.rounds, self.rate, self.min_rows, self.ridge = min(rounds, MAX_ROUNDS), rate, min_rows, ridge
        self.depth = min(depth if depth > 0 else DEFAULT_DEPTH, MAX_DEPTH)
        self.rows, self.columns, self.seed = rows, columns, seed

    @classmethod
    def of(cls, genome: dict, seed: int) -> Boosted:
        g = {k.removeprefix("model."): v for k, v in genome.items()}
        return cls(int(g["n_estimators"]), g["learning_rate"], int(g["max_depth"]), int(g["min_child_samples"]), g["reg_lambda"], g["subsample"], g["colsample"], seed)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v, side="left") for e, v in zip(self.edges, x.T, strict=True)], axis=1)

    def _tree(self, xb: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, bin, value) of a heap of nodes: node i has the children 2i+1 and 2i+2; a leaf has feature -1."""
        n, width = xb.shape
        size = (2 << self.depth) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node, alive = np.zeros(n, int), np.ones(n, bool)
        for level in range(self.depth + 1):
            first, nodes = (1 << level) - 1, 1 << level
            at = node[alive] - first
            g, h = (np.bincount(at, w[alive], nodes) for w in (grad, hess))
            value[first : first + nodes] = -g / (h + self.ridge + 1e-300)
            if level == self.depth or not len(at):
                break
            key = ((at[:, None] * width + np.arange(width)) * BINS + xb[alive]).ravel()
            left = [np.bincount(key, w, nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2) for w in (np.repeat(grad[alive], width), np.repeat(hess[alive], width), None)]
            gl, hl, cl = left
            gr, hr, cr = (x[..., -1:] - x for x in left)
            gain = (gl**2 / (hl + self.ridge + 1e-300) + gr**2 / (hr + self.ridge + 1e-300) - (g**2 / (h + self.ridge + 1e-300))[:, None, None]) / 2
            gain[(cl < self.min_rows) | (cr < self.min_rows)] = -np.inf
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(axis=1)
            top = flat[np.arange(nodes), best]
            split = np.flatnonzero(top > 1e-9)
            feature[first + split], cut[first + split] = best[split] // BINS, best[split] % BINS
            np.add.at(self.gain, self._used[best[split] // BINS], top[split])
            f = feature[node]
            alive &= f >= 0
            go = np.flatnonzero(alive)
            node[go] = 2 * node[go] + 1 + (xb[go, f[go]] > cut[node[go]])
        return feature, cut, value

    @staticmethod
    def _walk(tree, xb: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(xb), int)
        while len(go := np.flatnonzero(feature[node] >= 0)):
            f = feature[node[go]]
            node[go] = 2 * node[go] + 1 + (xb[go, f] > cut[node[go]])
        return value[node]

    def fit(self, x: np.ndarray, y: np.ndarray, classes: list[int]) -> Boosted:
        rng = np.random.default_rng(self.seed)
        self.classes, self.edges = classes, np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        xb, n, width = self._binned(x), *x.shape
        self.gain, self.models = np.zeros(width), []
        for c in classes:
            target = (y == c).astype(float)
            share = np.clip(target.mean(), 1e-6, 1 - 1e-6)
            base = float(np.log(share / (1 - share)))
            score, trees = np.full(n, base), []
            for _ in range(self.rounds):
                p = 1 / (1 + np.exp(-score))
                use = np.flatnonzero(rng.random(n) < self.rows) if self.rows < 1 else np.arange(n)
                use = use if len(use) >= LEAST_ROWS else np.arange(n)
                cols = np.flatnonzero(rng.random(width) < self.columns) if self.columns < 1 else np.arange(width)
                self._used = cols if len(cols) >= LEAST_COLUMNS else np.arange(width)
                own = xb[:, self._used]
                tree = self._tree(own[use], (p - target)[use], np.maximum(p * (1 - p), 1e-6)[use])
                trees.append((self._used, tree))
                score += self.rate * self._walk(tree, own)
            self.models.append((base, trees))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        xb = self._binned(x)
        raw = [base + self.rate * sum((self._walk(t, xb[:, cols]) for cols, t in trees), np.zeros(len(xb))) for base, trees in self.models]
        p = 1 / (1 + np.exp(-np.stack(raw, axis=1)))
        return p / (p.sum(axis=1, keepdims=True) + 1e-12)


def _lightgbm(genome: dict, seed: int):
    """The same interface over LightGBM, where it is installed."""
    import lightgbm as lgb

    class Model:
        def fit(self, x, y, classes):
            many = len(classes) > 2
            place = {c: i for i, c in enumerate(classes)}
            options = {"objective": "multiclass" if many else "binary", "num_class": len(classes) if many else 1, "subsample_freq": 1, "verbose": -1, "num_threads": 1, "deterministic": True, "seed": seed}
            options |= {k: genome[f"model.{k}"] for k in ("learning_rate", "num_leaves", "max_depth", "min_child_samples", "subsample", "reg_lambda")} | {"colsample_bytree": genome["model.colsample"]}
            self.model = lgb.train(options, lgb.Dataset(x, label=[place[v] for v in y.tolist()]), num_boost_round=genome["model.n_estimators"])
            self.gain = self.model.feature_importance(importance_type="gain").astype(float)
            return self

        def predict(self, x):
            p = self.model.predict(x)
            return np.stack([1 - p, p], axis=1) if p.ndim == 1 else p

    return Model()


def _sklearn(genome: dict, seed: int):
    """The same interface over scikit-learn, where it is installed; it knows no gain, so features count alike."""
    from sklearn.ensemble import HistGradientBoostingClassifier

    class Model:
        def fit(self, x, y, classes):
            self.classes, depth = classes, genome["model.max_depth"]
            self.model = HistGradientBoostingClassifier(learning_rate=genome["model.learning_rate"], max_iter=genome["model.n_estimators"], max_leaf_nodes=genome["model.num_leaves"], max_depth=depth if depth > 0 else None, min_samples_leaf=genome["model.min_child_samples"], l2_regularization=genome["model.reg_lambda"], early_stopping=False, random_state=seed).fit(x, y)
            self.gain = np.ones(x.shape[1])
            return self

        def predict(self, x):
            known = self.model.classes_.tolist()
            return self.model.predict_proba(x)[:, [known.index(c) for c in self.classes]]

    return Model()


BACKENDS = {"lightgbm": _lightgbm, "sklearn": _sklearn, "numpy": Boosted.of}


def available() -> str:
    """The first backend that is installed."""
    from importlib.util import find_spec

    return next((b for b in ("lightgbm", "sklearn") if find_spec(b)), "numpy")


def make(genome: dict, seed: int, backend: str | None = None):
    return BACKENDS[backend or available()](genome, seed)
