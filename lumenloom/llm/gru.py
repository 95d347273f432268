"""Gated recurrent networks in numpy: both directions at once, trained by backpropagation through time."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


#: Slope of straight gates: a line between shut and open, that of the logistic function where it is steepest.
SLOPE = F32(0.25)


def _line(x: np.ndarray) -> np.ndarray:
    x *= SLOPE
    x += F32(0.5)
    return np.clip(x, 0, 1, out=x)


class Adam:
    """Adam with gradient clipping by norm over all parameters."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 3e-3, clip: float = 5.0) -> None:
        self.p, self.rate, self.clip, self.t = params, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = F32(min(1.0, self.clip / (norm + 1e-6)))
        a = (rate or self.rate) * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (a * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(F32)


class BiGRU:
    """One bidirectional layer over symbols; inputs index a table of gate inputs (an embedding and its projection in one).

    ``ids`` is (batch, time) with 0 as padding at the end; the backward direction reads each row reversed by its own length.
    Gates are logistic, or ``straight``: a line that is cut at 0 and 1, which is cheaper to read with.
    """

    def __init__(self, symbols: int, hidden: int, rng: np.random.Generator, name: str, straight: bool = False) -> None:
        self.n, self.h, self.name, self.straight = symbols, hidden, name, straight
        s = 1 / np.sqrt(hidden)
        self.params = {
            f"{name}_x": rng.normal(0, 0.3, (2, symbols, 3 * hidden)).astype(F32),
            f"{name}_u": rng.uniform(-s, s, (2, hidden, 3 * hidden)).astype(F32),
            f"{name}_b": np.zeros((2, 1, 3 * hidden), F32),
            f"{name}_c": np.zeros((2, 1, hidden), F32),
        }
        self.params[f"{name}_b"][:, :, :hidden] = 1.0  # remember at first

    def _both(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        t = ids.shape[1]
        at = lengths[:, None] - 1 - np.arange(t)[None]
        back = np.where(at >= 0, np.take_along_axis(ids, np.maximum(at, 0), 1), 0)
        return np.stack([ids, back])

    @staticmethod
    def _unreverse(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows of (batch, time, width) from the reversed to the natural order; its own inverse inside the lengths."""
        t = h.shape[1]
        at = lengths[:, None] - 1 - np.arange(t)[None]
        out = np.take_along_axis(h, np.maximum(at, 0)[:, :, None], 1)
        out[at < 0] = 0
        return out

    def forward(self, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """States (batch, time, 2 * hidden) and, with ``keep``, what the backward pass needs."""
        p, n, h = self.params, self.name, self.h
        both = self._both(ids, lengths)
        _, b, t = both.shape
        table = p[f"{n}_x"] + p[f"{n}_b"]
        u, c = p[f"{n}_u"], p[f"{n}_c"]
        hs = np.zeros((t + 1, 2, b, h), F32)
        gates = np.empty((t if keep else 1, 2, b, 2 * h), F32)
        qs = np.empty((t if keep else 1, 2, b, h), F32)
        ms = np.empty((t if keep else 1, 2, b, h), F32)
        g = np.empty((2, b, 3 * h), F32)
        x = np.empty((2, b, 3 * h), F32)
        gate = _line if self.straight else _sigmoid
        with np.errstate(over="ignore"):
            for k in range(t):
                j = k if keep else 0
                np.take(table[0], both[0, :, k], 0, out=x[0])
                np.take(table[1], both[1, :, k], 0, out=x[1])
                state = hs[k]
                np.matmul(state, u, out=g)
                zr, q, m, new = gates[j], qs[j], ms[j], hs[k + 1]
                np.add(x[:, :, : 2 * h], g[:, :, : 2 * h], out=zr)
                gate(zr)
                np.add(g[:, :, 2 * h :], c, out=q)
                np.multiply(zr[:, :, h:], q, out=m)
                m += x[:, :, 2 * h :]
                np.tanh(m, out=m)
                np.subtract(state, m, out=new)
                new *= zr[:, :, :h]
                new += m
        fw = hs[1:, 0].transpose(1, 0, 2)
        bw = self._unreverse(hs[1:, 1].transpose(1, 0, 2), lengths)
        return np.concatenate([fw, bw], 2), (both, lengths, hs, gates, qs, ms) if keep else None

    def _slope(self, y: np.ndarray) -> np.ndarray:
        """Derivative of a gate by its input, from its output."""
        return SLOPE * ((y > 0) & (y < 1)) if self.straight else y * (1 - y)

    def backward(self, dout: np.ndarray, kept) -> dict[str, np.ndarray]:
        both, lengths, hs, gates, qs, ms = kept
        p, n, h = self.params, self.name, self.h
        u = p[f"{n}_u"]
        ut = np.ascontiguousarray(u.transpose(0, 2, 1))
        _, b, t = both.shape
        dboth = np.stack([dout[:, :, :h].transpose(1, 0, 2), self._unreverse(dout[:, :, h:], lengths).transpose(1, 0, 2)], 1)  # (t, 2, b, h)
        dg = np.empty((t, 2, b, 3 * h), F32)
        dm = np.empty((t, 2, b, h), F32)
        dh = np.zeros((2, b, h), F32)
        for k in range(t - 1, -1, -1):
            z, r, q, m = gates[k, :, :, :h], gates[k, :, :, h:], qs[k], ms[k]
            dh += dboth[k]
            d = dm[k]
            np.multiply(m, m, out=d)
            np.subtract(1, d, out=d)
            d *= 1 - z
            d *= dh
            out = dg[k]
            np.multiply(dh, (hs[k] - m) * self._slope(z), out=out[:, :, :h])
            np.multiply(d, q * self._slope(r), out=out[:, :, h : 2 * h])
            np.multiply(d, r, out=out[:, :, 2 * h :])
            dh *= z
            dh += np.matmul(out, ut)
        before = hs[:-1]
        du = np.stack([before[:, d].reshape(-1, h).T @ dg[:, d].reshape(-1, 3 * h) for d in range(2)])
        dc = dg[:, :, :, 2 * h :].sum((0, 2))[:, None]
        dx = dg
        dx[:, :, :, 2 * h :] = dm
        table = np.zeros_like(p[f"{n}_x"])
        for d in range(2):
            flat, ids = dx[:, d].reshape(-1, 3 * h), both[d].T.reshape(-1)
            order = np.argsort(ids, kind="stable")
            there, first = np.unique(ids[order], return_index=True)
            table[d][there] = np.add.reduceat(flat[order], first, axis=0)
        return {f"{n}_x": table, f"{n}_u": du, f"{n}_b": dx.sum((0, 2))[:, None], f"{n}_c": dc}


class Reader:
    """A fitted layer that only reads: what its states add to some sums at every position, without keeping the states.

    The same network as ``BiGRU.forward``. Gates lie apart, so that every step works on whole blocks; rows that have ended are not carried on. The
    line of straight gates is put into the weights, and the sign that the exponential of logistic ones needs.
    """

    def __init__(self, layer: BiGRU, out: np.ndarray) -> None:
        p, n, h = layer.params, layer.name, layer.h
        self.straight = layer.straight
        slope, level = (np.array(x, F32)[:, None, None, None] for x in (([SLOPE, SLOPE, 1], [0.5, 0.5, 0]) if layer.straight else ([-1, -1, 1], [0, 0, 0])))
        apart = lambda x: x.reshape(*x.shape[:2], 3, h).transpose(2, 0, 1, 3)
        self.h, self.offsets = h, (np.arange(6) * layer.n).reshape(3, 2, 1)
        self.table = np.ascontiguousarray(apart(p[f"{n}_x"] + p[f"{n}_b"]) * slope + level).reshape(-1, h)
        self.u, self.c = np.ascontiguousarray(apart(p[f"{n}_u"]) * slope), p[f"{n}_c"]
        self.out = np.ascontiguousarray(out.reshape(2, h, -1), F32)

    def __call__(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """States times ``out`` for each row of symbols, (its length, sums)."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        sizes = np.array([len(rows[i]) for i in order], np.int64)
        ids, lengths = pad([rows[i] for i in order])
        b, t = ids.shape
        h = self.h
        at = lengths[:, None] - 1 - np.arange(t)[None]
        both = np.ascontiguousarray(np.stack([ids, np.take_along_axis(ids, np.maximum(at, 0), 1)]).transpose(2, 0, 1))
        alive = np.count_nonzero(sizes[None] > np.arange(t)[:, None], axis=1)
        begin = np.cumsum(sizes) - sizes
        last = begin + sizes - 1
        forth, back = (np.empty((int(sizes.sum()), self.out.shape[2]), F32) for _ in range(2))
        buffers = [np.empty(k * b * h, F32) for k in (6, 6, 2, 2)]
        state = np.zeros((2, b, h), F32)
        for k in range(t):
            n = int(alive[k])
            x, g = (v[: 6 * n * h].reshape(3, 2, n, h) for v in buffers[:2])
            new = buffers[2 + k % 2][: 2 * n * h].reshape(2, n, h)
            state = state[:, :n]
            np.take(self.table, both[k, :, :n] + self.offsets, 0, out=x, mode="clip")
            np.matmul(state, self.u, out=g)
            zr, q = g[:2], g[2]
            zr += x[:2]
            if self.straight:
                np.clip(zr, 0, 1, out=zr)
            else:
                with np.errstate(over="ignore"):
                    np.exp(zr, out=zr)
                zr += F32(1)
                np.reciprocal(zr, out=zr)
            q += self.c
            q *= zr[1]
            q += x[2]
            np.tanh(q, out=q)
            np.subtract(state, q, out=new)
            new *= zr[0]
            new += q
            forth[begin[:n] + k], back[last[:n] - k] = new @ self.out
            state = new
        forth += back
        found: list[np.ndarray] = [forth[:0]] * b
        for j, i in enumerate(order):
            found[i] = forth[begin[j] : begin[j] + sizes[j]]
        return found


def softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([max(1, len(r)) for r in rows])
    ids = np.zeros((len(rows), int(lengths.max()) if len(rows) else 1), np.int64)
    for i, r in enumerate(rows):
        ids[i, : len(r)] = r
    return ids, lengths
