"""A character-level bidirectional LSTM with a linear-chain CRF, in numpy: training and decoding."""

from __future__ import annotations

import numpy as np

NEVER = np.float32(-1e4)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(e: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """An LSTM over e (time, rows, inputs); gates in the order input, forget, output, candidate."""
    steps, rows, _ = e.shape
    size = u.shape[0]
    given = e @ w + b
    h, c = np.zeros((rows, size), np.float32), np.zeros((rows, size), np.float32)
    out, kept = np.empty((steps, rows, size), np.float32), []
    for t in range(steps):
        z = given[t] + h @ u
        gates, g = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        before, past = c, h
        c = f * c + i * g
        th = np.tanh(c)
        h = o * th
        out[t] = h
        if keep:
            kept.append((i, f, o, g, th, before, past))
    return out, kept


def _back(e, w, u, kept, grad):
    size = u.shape[0]
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], np.float32)
    de = np.empty_like(e)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, g, th, before, past = kept[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - th * th)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw += e[t].T @ dz
        du += past.T @ dz
        db += dz.sum(axis=0)
        de[t] = dz @ w.T
        dh, dc = dz @ u.T, dc * f
    return dw, du, db, de, size


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Tags 0 (outside) and, for kind k, 2k+1 (begin) and 2k+2 (inside); inside follows its own begin or inside only."""

    def __init__(self, symbols: int, kinds: int, size: int = 20, width: int = 12, seed: int = 5):
        g = np.random.Generator(np.random.PCG64(seed))
        self.kinds, self.tags, self.size = kinds, 2 * kinds + 1, size
        draw = lambda *s: (g.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {"e": draw(symbols, width) * 3}
        for d in "fb":
            self.p |= {"w" + d: draw(width, 4 * size), "u" + d: draw(size, 4 * size), "b" + d: np.zeros(4 * size, np.float32)}
            self.p["b" + d][size : 2 * size] = 1
        self.p |= {"o": draw(2 * size, self.tags), "c": np.zeros(self.tags, np.float32), "t": np.zeros((self.tags, self.tags), np.float32)}
        self.banned = np.zeros((self.tags, self.tags), bool)
        for k in range(kinds):
            self.banned[:, 2 * k + 2] = True
            self.banned[[2 * k + 1, 2 * k + 2], 2 * k + 2] = False
        self.first = np.array([t > 0 and t % 2 == 0 for t in range(self.tags)])

    def _moves(self) -> np.ndarray:
        return np.where(self.banned, NEVER, self.p["t"])

    def scores(self, x: np.ndarray, keep: bool = False):
        """Tag scores (time, rows, tags) of symbols x (rows, time)."""
        e = self.p["e"][x.T]
        f, kf = _run(e, self.p["wf"], self.p["uf"], self.p["bf"], keep)
        b, kb = _run(e[::-1], self.p["wb"], self.p["ub"], self.p["bb"], keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        s = h @ self.p["o"] + self.p["c"]
        s[0][:, self.first] = NEVER
        return (s, e, h, kf, kb) if keep else s

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags y (rows, time), and its gradients."""
        s, e, h, kf, kb = self.scores(x, True)
        steps, rows, n = s.shape
        moves = self._moves()
        a, z = np.empty_like(s), np.zeros_like(s)
        a[0] = s[0]
        for t in range(1, steps):
            a[t] = s[t] + _lse(a[t - 1][:, :, None] + moves, 1)
        for t in range(steps - 2, -1, -1):
            z[t] = _lse(moves + (s[t + 1] + z[t + 1])[:, None, :], 2)
        total = _lse(a[-1], 1)
        ds = np.exp(a + z - total[:, None])
        dt = np.zeros_like(moves)
        for t in range(1, steps):
            dt += np.exp(a[t - 1][:, :, None] + moves + (s[t] + z[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        r, gold = np.arange(rows), s[0][np.arange(rows), y[:, 0]].copy()
        ds[0, r, y[:, 0]] -= 1
        for t in range(1, steps):
            gold += s[t][r, y[:, t]] + moves[y[:, t - 1], y[:, t]]
            ds[t, r, y[:, t]] -= 1
            np.add.at(dt, (y[:, t - 1], y[:, t]), -1)
        ds /= rows
        dt = np.where(self.banned, 0, dt / rows).astype(np.float32)
        ds = ds.astype(np.float32)
        ds[0][:, self.first] = 0
        flat = ds.reshape(-1, n)
        g = {"o": h.reshape(-1, 2 * self.size).T @ flat, "c": flat.sum(axis=0), "t": dt}
        dh = ds @ self.p["o"].T
        g["wf"], g["uf"], g["bf"], ef, _ = _back(e, self.p["wf"], self.p["uf"], kf, dh[:, :, : self.size])
        g["wb"], g["ub"], g["bb"], eb, _ = _back(e[::-1], self.p["wb"], self.p["ub"], kb, dh[::-1][:, :, self.size :])
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], x.T, ef + eb[::-1])
        return float((total - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, rows: int = 32, rate: float = 0.02, seed: int = 9) -> list[float]:
        """Adam over mini-batches in a fixed order; the losses."""
        g = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for t in range(1, steps + 1):
            pick = g.integers(0, len(x), rows)
            loss, grad = self.step(x[pick], y[pick])
            norm = np.sqrt(sum(float((d * d).sum()) for d in grad.values()))
            scale, now = min(1.0, 5 / (norm + 1e-9)), rate * min(1, 3 * (1 - t / (steps + 1)))
            for k, d in grad.items():
                d = d * scale
                m[k] = 0.9 * m[k] + 0.1 * d
                v2[k] = 0.99 * v2[k] + 0.01 * d * d
                self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    def sure(self, x: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """How likely each of these tags is (rows, time), over all sequences of tags of symbols x."""
        s = self.scores(x)
        steps, rows, _ = s.shape
        moves = self._moves()
        a, z = np.empty_like(s), np.zeros_like(s)
        a[0] = s[0]
        for t in range(1, steps):
            a[t] = s[t] + _lse(a[t - 1][:, :, None] + moves, 1)
        for t in range(steps - 2, -1, -1):
            z[t] = _lse(moves + (s[t + 1] + z[t + 1])[:, None, :], 2)
        own = np.take_along_axis(a + z, tags.T[:, :, None].astype(np.int64), 2)[:, :, 0]
        return np.exp(np.minimum(own - _lse(a[-1], 1), 0)).T

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (rows, time) of symbols x."""
        s = self.scores(x)
        steps, rows, n = s.shape
        moves = self._moves()
        back = np.empty((steps, rows, n), np.int8)
        best = s[0]
        for t in range(1, steps):
            ways = best[:, :, None] + moves
            back[t] = ways.argmax(axis=1)
            best = np.take_along_axis(ways, back[t][:, None, :].astype(np.int64), 1)[:, 0] + s[t]
        out = np.empty((rows, steps), np.int8)
        out[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(rows), out[:, t]]
        return out
