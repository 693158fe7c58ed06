"""Market-state models in NumPy: k-means, Gaussian hidden Markov, jump penalty and change points. States are ranked by severity."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def kmeans(x: np.ndarray, k: int, seed: int, tries: int = 1, rounds: int = 100) -> np.ndarray:
    """Centres of the best of several runs from spread-out starts."""
    best = (np.inf, None)
    for t in range(tries):
        rng = np.random.default_rng(seed + t)
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres) ** 2).sum(2).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
            moved = np.array([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
            if np.allclose(moved, centres, atol=1e-10):
                break
            centres = moved
        inertia = ((x[:, None] - centres) ** 2).sum(2).min(1).sum()
        if inertia < best[0]:
            best = (inertia, centres)
    return best[1]


@dataclass
class Detector:
    """fit(x), then filtered_states(x): at each row the state as known by then, 0 the calmest."""

    n_states: int = 3
    severity: list[int] | None = None
    seed: int = 42
    means: np.ndarray | None = field(default=None, init=False)

    def order(self, means: np.ndarray) -> np.ndarray:
        """States by rising sum of the severity features' means."""
        return np.argsort(means[:, self.severity or list(range(means.shape[1]))].sum(1), kind="stable")

    def fitted(self) -> None:
        if self.means is None:
            raise RuntimeError("fit the model first")

    def filtered_states(self, x: np.ndarray) -> np.ndarray:
        return self.filtered_proba(x).argmax(1)

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        return ((np.atleast_2d(rows)[:, None] - self.means) ** 2).sum(2).argmin(1)


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class HiddenMarkov(Detector):
    """Gaussian emissions, fitted by scaled forward-backward EM from several starts. covariance: diag, spherical (one variance for a state), full (a matrix for each state) or tied (one matrix for all)."""

    covariance: str = "diag"
    rounds: int = 100
    tol: float = 1e-4
    restarts: int = 8
    floor: float = 1e-3

    def __post_init__(self):
        if self.covariance not in ("diag", "spherical", "full", "tied"):
            raise ValueError(f"unknown covariance {self.covariance}; known: diag, spherical, full, tied")

    def density(self, x: np.ndarray, means: np.ndarray, var: np.ndarray) -> np.ndarray:
        """Log densities of rows by state; var: variances by state, or matrices by state."""
        gap = x[:, None] - means
        if var.ndim == 2:
            return -0.5 * (np.log(2 * np.pi * var).sum(1) + (gap**2 / var).sum(2))
        return -0.5 * (x.shape[1] * np.log(2 * np.pi) + np.linalg.slogdet(var)[1] + np.einsum("tki,kij,tkj->tk", gap, np.linalg.inv(var), gap))

    def spread(self, x: np.ndarray, means: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """Variances or matrices of the states, given each row's share in them."""
        k, d = means.shape
        weight = np.maximum(gamma.sum(0), 1e-10)
        if self.covariance in ("diag", "spherical"):
            var = np.maximum(gamma.T @ x**2 / weight[:, None] - means**2, 0)
            return (np.broadcast_to(var.mean(1, keepdims=True), (k, d)) if self.covariance == "spherical" else var) + self.floor
        gap = x[:, None] - means
        moment = np.einsum("tk,tki,tkj->kij", gamma, gap, gap, optimize=True)
        var = np.broadcast_to(moment.sum(0) / weight.sum(), (k, d, d)) if self.covariance == "tied" else moment / weight[:, None, None]
        return var + self.floor * np.eye(d)

    def one_fit(self, x: np.ndarray, seed: int):
        k = self.n_states
        means, var = kmeans(x, k, seed), self.spread(x, np.tile(x.mean(0), (k, 1)), np.full((len(x), k), 1 / k))
        start, move, last = np.full(k, 1 / k), np.full((k, k), 1 / k), -np.inf
        for _ in range(self.rounds):
            logb = self.density(x, means, var)
            top = logb.max(1, keepdims=True)
            b = np.exp(logb - top)
            alpha, scale = np.empty_like(b), np.empty(len(x))
            for t in range(len(x)):
                a = (start if t == 0 else alpha[t - 1] @ move) * b[t]
                scale[t] = max(a.sum(), 1e-300)
                alpha[t] = a / scale[t]
            beta = np.ones_like(b)
            for t in range(len(x) - 2, -1, -1):
                beta[t] = move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
            likelihood = float(np.log(scale).sum() + top.sum())
            gamma = alpha * beta
            gamma /= gamma.sum(1, keepdims=True)
            pair = move * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
            start = np.maximum(gamma[0], 1e-12)
            start /= start.sum()
            move = np.maximum(pair, 1e-12)
            move /= move.sum(1, keepdims=True)
            weight = np.maximum(gamma.sum(0), 1e-10)[:, None]
            means = gamma.T @ x / weight
            var = self.spread(x, means, gamma)
            if abs(likelihood - last) < self.tol:
                break
            last = likelihood
        return likelihood, means, var, start, move

    def fit(self, x: np.ndarray) -> HiddenMarkov:
        fits = [f for r in range(self.restarts) if np.isfinite((f := self.one_fit(x, self.seed + r))[0])]
        if not fits:
            raise RuntimeError("no start gave a finite likelihood")
        _, means, var, start, move = max(fits, key=lambda f: f[0])
        o = self.order(means)
        self.means, self.var, self.start, self.move = means[o], var[o], start[o], move[np.ix_(o, o)]
        return self

    def filtered_proba(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each state at each row, given the rows so far."""
        self.fitted()
        logb, logm = self.density(x, self.means, self.var), np.log(self.move + 1e-300)
        out, now = np.empty_like(logb), np.log(self.start + 1e-300) + logb[0]
        for t in range(len(x)):
            if t:
                now = log_sum(now[:, None] + logm, 0) + logb[t]
            now = now - log_sum(now, 0)
            out[t] = np.exp(now)
        return out

    def smoothed_states(self, x: np.ndarray) -> np.ndarray:
        """The most likely path through all rows."""
        self.fitted()
        logb, logm = self.density(x, self.means, self.var), np.log(self.move + 1e-300)
        now, back = np.log(self.start + 1e-300) + logb[0], np.zeros(logb.shape, dtype=int)
        for t in range(1, len(x)):
            through = now[:, None] + logm
            back[t], now = through.argmax(0), through.max(0) + logb[t]
        return backtrack(back, int(now.argmax()))


def backtrack(back: np.ndarray, last: int) -> np.ndarray:
    path = np.empty(len(back), dtype=int)
    path[-1] = last
    for t in range(len(back) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


@dataclass
class JumpModel(Detector):
    """Centres and a path of states at least squared distance plus a penalty for each jump."""

    penalty: float = 50.0
    tries: int = 10
    rounds: int = 50
    tol: float = 1e-6

    def forward(self, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least cost of a path that ends in each state at each row, and where it came from."""
        value, back = cost.copy(), np.zeros(cost.shape, dtype=int)
        jump = self.penalty * (1 - np.eye(cost.shape[1]))
        for t in range(1, len(cost)):
            through = value[t - 1][:, None] + jump
            back[t] = through.argmin(0)
            value[t] += through.min(0)
        return value, back

    def cost(self, x: np.ndarray, means: np.ndarray) -> np.ndarray:
        return ((x[:, None] - means) ** 2).sum(2)

    def fit(self, x: np.ndarray) -> JumpModel:
        best = (np.inf, None)
        for t in range(self.tries):
            means, last = kmeans(x, self.n_states, self.seed + t), np.inf
            for _ in range(self.rounds):
                value, back = self.forward(self.cost(x, means))
                path, loss = backtrack(back, int(value[-1].argmin())), float(value[-1].min())
                means = np.array([x[path == j].mean(0) if (path == j).any() else means[j] for j in range(self.n_states)])
                if last - loss < self.tol:
                    break
                last = loss
            if loss < best[0]:
                best = (loss, means)
        self.means = best[1][self.order(best[1])]
        return self

    def filtered_proba(self, x: np.ndarray) -> np.ndarray:
        self.fitted()
        return np.eye(self.n_states)[self.forward(self.cost(x, self.means))[0].argmin(1)]

    def smoothed_states(self, x: np.ndarray) -> np.ndarray:
        self.fitted()
        value, back = self.forward(self.cost(x, self.means))
        return backtrack(back, int(value[-1].argmin()))


def breakpoints(x: np.ndarray, penalty: float, least: int = 10, grid: int = 5) -> list[int]:
    """Ends of the segments of least squared error plus penalty each (pruned exact search over a grid)."""
    n = len(x)
    s1, s2 = np.vstack([np.zeros(x.shape[1]), x.cumsum(0)]), np.append(0, (x**2).sum(1).cumsum())

    def error(a, b):
        return s2[b] - s2[a] - ((s1[b] - s1[a]) ** 2).sum(-1) / (b - a)

    ends = [e for e in range(grid, n, grid) if e >= least] + [n]
    best, came, open_ = {0: -penalty}, {}, [0]
    for e in ends:
        starts = np.array([a for a in open_ if e - a >= least], dtype=int)
        if not len(starts):
            continue
        totals = np.array([best[a] for a in starts]) + error(starts, np.full(len(starts), e)) + penalty
        k = int(totals.argmin())
        best[e], came[e] = float(totals[k]), int(starts[k])
        dead = set(starts[totals - penalty > best[e]].tolist())
        open_ = [a for a in open_ if a not in dead] + [e]
    out, e = [], n
    while e:
        out.append(e)
        e = came.get(e, 0)
    return out[::-1]


@dataclass
class ChangePoints(Detector):
    """Segments by change points, each named after the prototype nearest to its mean."""

    least: int = 10
    scale: float = 2.0
    window: int = 126
    grid: int = 5

    def fit(self, x: np.ndarray) -> ChangePoints:
        means = kmeans(x, self.n_states, self.seed, 10)
        self.means = means[self.order(means)]
        return self

    def cuts(self, x: np.ndarray) -> list[int]:
        return breakpoints(x, self.scale * x.shape[1] * np.log(max(len(x), 2)), self.least, self.grid)

    def state_of_window(self, x: np.ndarray) -> int:
        """The state of the last segment of a trailing window."""
        cut = self.cuts(x) if len(x) >= 2 * self.least else [len(x)]
        return int(self.nearest(x[cut[-2] if len(cut) > 1 else 0 :].mean(0))[0])

    def filtered_states(self, x: np.ndarray, start: int = 0) -> np.ndarray:
        """States of rows from start on; each depends on its trailing window alone."""
        self.fitted()
        return np.array([self.state_of_window(x[max(0, t + 1 - self.window) : t + 1]) for t in range(start, len(x))])

    def filtered_proba(self, x: np.ndarray) -> np.ndarray:
        return np.eye(self.n_states)[self.filtered_states(x)]

    def smoothed_states(self, x: np.ndarray) -> np.ndarray:
        self.fitted()
        out, a = np.empty(len(x), dtype=int), 0
        for b in self.cuts(x):
            out[a:b], a = self.nearest(x[a:b].mean(0))[0], b
        return out


def known_markov(start: list, move: list, means: list, var: list) -> HiddenMarkov:
    """A hidden Markov model of known parameters; var: variances by state and feature, or a matrix for each state."""
    model = HiddenMarkov(len(start))
    model.start, model.move, model.means, model.var = (np.array(v, dtype=float) for v in (start, move, means, var))
    return model


def known_jump(means: list, penalty: float) -> JumpModel:
    """A jump model of known centres."""
    model = JumpModel(len(means), penalty=penalty)
    model.means = np.array(means, dtype=float)
    return model


DETECTORS = {"hmm": HiddenMarkov, "jump": JumpModel, "changepoint": ChangePoints}


def make_detector(method: str, **settings) -> Detector:
    if method not in DETECTORS:
        raise ValueError(f"unknown method {method}; known: {', '.join(DETECTORS)}")
    return DETECTORS[method](**settings)


def state_name(rank: int, n: int = 3) -> str:
    if n == 3:
        return ("calm", "volatile", "crisis")[rank]
    return "calm" if rank == 0 else "crisis" if rank == n - 1 else f"state{rank}"
