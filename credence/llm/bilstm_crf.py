"""A character-level bidirectional LSTM with a linear-chain CRF, trained and run in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class BiLstmCrf:
    """Tags sequences of character classes. Padding has class 0 and is masked."""

    def __init__(self, classes: int, tags: int, embed: int = 12, hidden: int = 20, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.hidden, self.tags = hidden, tags
        self.p = {"embed": rng.normal(0, 0.3, (classes, embed)).astype(f)}
        for d in "fb":
            self.p["wx" + d] = rng.normal(0, 1 / np.sqrt(embed), (embed, 4 * hidden)).astype(f)
            self.p["wh" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(f)
            bias = np.zeros(4 * hidden, f)
            bias[hidden : 2 * hidden] = 1.0  # forget gates begin open
            self.p["b" + d] = bias
        self.p["out"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, tags)).astype(f)
        self.p["bout"] = np.zeros(tags, f)
        self.p["trans"] = np.zeros((tags, tags), f)
        self.p["begin"] = np.zeros(tags, f)

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction; x: (time, batch, embed)."""
        h = self.hidden
        steps, n, _ = x.shape
        pre = x @ self.p["wx" + d] + self.p["b" + d]
        wh = self.p["wh" + d]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, saved = np.empty((steps, n, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + state @ wh
            gates = sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            i, fo, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, cell_before = state, cell
            cell = fo * cell + i * new
            tan = np.tanh(cell)
            state = o * tan
            out[t] = state
            if keep:
                saved.append((t, i, fo, o, new, before, cell_before, tan))
        return out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (batch, time, tags) of class sequences (batch, time)."""
        e = self.p["embed"][x.T]
        both = np.concatenate([self._lstm(e, "f", False)[0], self._lstm(e, "b", False)[0]], axis=2)
        return (both @ self.p["out"] + self.p["bout"]).transpose(1, 0, 2)

    def _crf(self, em: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood of tags y (time, batch), and its gradients."""
        steps, n, k = em.shape
        em = em.astype(np.float64)
        trans, begin = self.p["trans"].astype(np.float64), self.p["begin"].astype(np.float64)

        def lse(a, axis):
            m = a.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.empty((steps, n, k)), np.zeros((steps, n, k))
        alpha[0] = begin + em[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + em[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        marg = np.exp(alpha + beta - total[None, :, None])
        pair = np.exp(alpha[:-1, :, :, None] + trans + (em[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]).sum(axis=(0, 1))
        cols = np.arange(n)
        gold = begin[y[0]] + em[np.arange(steps)[:, None], cols, y].sum(axis=0) + trans[y[:-1], y[1:]].sum(axis=0)
        dem = marg.copy()
        dem[np.arange(steps)[:, None], cols, y] -= 1
        np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
        scale = 1.0 / n
        return (total - gold).mean(), (dem * scale).astype(np.float32), (pair * scale).astype(np.float32), (dem[0].sum(axis=0) * scale).astype(np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch; x and y: (batch, time)."""
        h, p = self.hidden, self.p
        ids = x.T
        e = p["embed"][ids]
        runs = {d: self._lstm(e, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        em = both @ p["out"] + p["bout"]
        loss, dem, dtrans, dbegin = self._crf(em, y.T)
        g = {"trans": dtrans, "begin": dbegin, "bout": dem.sum(axis=(0, 1)), "out": np.einsum("tbh,tbk->hk", both, dem)}
        dboth = dem @ p["out"].T
        de = np.zeros_like(e)
        for d, part in (("f", dboth[:, :, :h]), ("b", dboth[:, :, h:])):
            wh = p["wh" + d]
            dz_all = np.empty((len(ids), ids.shape[1], 4 * h), np.float32)
            dwh = np.zeros_like(wh)
            dstate, dcell = np.zeros((ids.shape[1], h), np.float32), np.zeros((ids.shape[1], h), np.float32)
            for t, i, fo, o, new, before, cell_before, tan in reversed(runs[d][1]):
                ds = part[t] + dstate
                dc = dcell + ds * o * (1 - tan * tan)
                dz = np.concatenate([dc * new * i * (1 - i), dc * cell_before * fo * (1 - fo), ds * tan * o * (1 - o), dc * i * (1 - new * new)], axis=1)
                dz_all[t] = dz
                dwh += before.T @ dz
                dstate, dcell = dz @ wh.T, dc * fo
            g["wh" + d] = dwh
            g["b" + d] = dz_all.sum(axis=(0, 1))
            g["wx" + d] = np.einsum("tbe,tbk->ek", e, dz_all)
            de += dz_all @ p["wx" + d].T
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], ids.ravel(), de.reshape(-1, de.shape[2]))
        return float(loss), g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 32, rate: float = 0.02, seed: int = 0) -> "BiLstmCrf":
        """Adam over random batches; gradients are clipped by their norm, the rate falls to a tenth."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for s in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            _, g = self.step(x[pick], y[pick])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            now = rate * (1 - 0.9 * s / steps)
            for k in self.p:
                grad = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                self.p[k] -= now * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)
        return self

    def decode(self, em: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Best tags of each sequence; em: (batch, time, tags), of which ``lengths`` count."""
        n, steps, k = em.shape
        trans = self.p["trans"]
        score = self.p["begin"] + em[:, 0]
        back = np.zeros((steps, n, k), np.int8)
        for t in range(1, steps):
            way = score[:, :, None] + trans
            best = way.argmax(axis=1)
            new = np.take_along_axis(way, best[:, None, :], 1)[:, 0] + em[:, t]
            on = t < lengths
            back[t] = np.where(on[:, None], best, np.arange(k))
            score = np.where(on[:, None], new, score)
        tag = score.argmax(axis=1)
        out = np.empty((n, steps), np.int8)
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            out[:, t] = tag
            tag = back[t][rows, tag]
        return [out[i, :m] for i, m in enumerate(lengths)]
