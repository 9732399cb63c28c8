"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, streaming state.

Symbols: 0 the end of a text, 1 any word outside the vocabulary, then the vocabulary by falling count.
They lie in CLASS_SIZE-wide classes in this order. p(symbol) = p(class | state) p(symbol | class, state). Documents
run in parallel lanes, one after another; a lane's state goes on from window to window and is
set back where a document begins, so a document of any length is scored as a whole.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
CLASSES = CLASS_SIZE = 24
SYMBOLS = CLASSES * CLASS_SIZE
END, OTHER = 0, 1
LANES, STEPS = 512, 12
CELLS = 8_000_000
UPDATES = 150

Params = dict[str, np.ndarray]


def initial(counts: np.ndarray, seed: int = 7) -> Params:
    """Weights that give the smoothed unigram distribution of `counts` in every state."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
    p = np.maximum(counts.astype(np.float64), 1e-3).reshape(CLASSES, CLASS_SIZE)
    return {
        "inputs": normal(SYMBOLS, 3 * HIDDEN),
        "state": normal(HIDDEN, 3 * HIDDEN),
        "class": np.zeros((CLASSES, HIDDEN), np.float32),
        "class_bias": np.log(p.sum(1) / p.sum()).astype(np.float32),
        "word": np.zeros((CLASSES, CLASS_SIZE, HIDDEN), np.float32),
        "word_bias": np.log(p / p.sum(1, keepdims=True)).astype(np.float32),
    }


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(v: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = v[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


class Lanes:
    """Documents dealt to lanes of about equal length, the longest lane first."""

    def __init__(self, docs: list[np.ndarray], most: int = LANES):
        sizes = np.array([len(d) for d in docs])
        longest, total = int(sizes.max()), int(sizes.sum())
        n = max(1, min(most, len(docs), -(-2 * total // longest), CELLS // longest))
        heap = [(0, i) for i in range(n)]
        own: list[list[int]] = [[] for _ in range(n)]
        for d in np.argsort(-sizes, kind="stable"):
            used, lane = heapq.heappop(heap)
            own[lane].append(int(d))
            heapq.heappush(heap, (used + int(sizes[d]), lane))
        own.sort(key=lambda x: -sum(sizes[i] for i in x))
        self.lengths = np.array([sum(sizes[i] for i in x) for x in own])
        width = int(self.lengths[0])
        self.targets = np.zeros((width, n), np.int32)
        self.first = np.zeros((width, n), bool)
        self.place: list[tuple[int, int, int]] = [(0, 0, 0)] * len(docs)
        for lane, ids in enumerate(own):
            at = 0
            for i in ids:
                self.targets[at : at + sizes[i], lane] = docs[i]
                self.first[at, lane] = True
                self.place[i] = (lane, at, int(sizes[i]))
                at += int(sizes[i])

    def windows(self, steps: int):
        """(from, to, active lanes) of every window."""
        for a in range(0, len(self.targets), steps):
            yield a, min(a + steps, len(self.targets)), int((self.lengths > a).sum())


def _states(p: Params, x: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool):
    """States after each input, and what the way back needs: gates, the candidate's part from the state, and the states that
    went in, 0 where a document begins. The state before that stays as it is, since it predicts the end of the document before."""
    steps, lanes = x.shape
    out = np.empty((steps + 1, lanes, HIDDEN), np.float32)
    gates = np.empty((steps, lanes, 3 * HIDDEN), np.float32) if keep else None
    inner = np.empty((steps, lanes, HIDDEN), np.float32) if keep else None
    given = np.empty((steps, lanes, HIDDEN), np.float32) if keep else None
    out[0] = h
    e = p["inputs"][x]
    for t in range(steps):
        h = np.where(first[t][:, None], np.float32(0), out[t]) if first[t].any() else out[t]
        a = h @ p["state"]
        g = e[t]
        g[:, : 2 * HIDDEN] += a[:, : 2 * HIDDEN]
        np.negative(g[:, : 2 * HIDDEN], out=g[:, : 2 * HIDDEN])
        s = np.exp(g[:, : 2 * HIDDEN])
        s += 1
        np.reciprocal(s, out=s)
        z, r = s[:, :HIDDEN], s[:, HIDDEN:]
        n = g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :]
        n *= -2
        np.exp(n, out=n)
        n += 1
        np.divide(2, n, out=n)
        n -= 1
        np.subtract(h, n, out=out[t + 1])
        out[t + 1] *= z
        out[t + 1] += n
        if keep:
            gates[t, :, : 2 * HIDDEN], gates[t, :, 2 * HIDDEN :], inner[t], given[t] = s, n, a[:, 2 * HIDDEN :], h
    return out, gates, inner, given


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort((y // CLASS_SIZE).astype(np.uint8), kind="stable")
    return order, np.searchsorted((y // CLASS_SIZE)[order], np.arange(CLASSES + 1))


def probabilities(p: Params, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """p(y | h) for rows of states and the symbols that follow."""
    own = _softmax(h @ p["class"].T + p["class_bias"])[np.arange(len(y)), y // CLASS_SIZE]
    order, cuts = _by_class(y)
    hs, ys, inner = h[order], (y % CLASS_SIZE)[order], np.empty(len(y), np.float32)
    for c in range(CLASSES):
        a, b = cuts[c], cuts[c + 1]
        if a < b:
            inner[a:b] = _softmax(hs[a:b] @ p["word"][c].T + p["word_bias"][c])[np.arange(b - a), ys[a:b]]
    own[order] *= inner
    return own


def _gradients(p: Params, x: np.ndarray, y: np.ndarray, first: np.ndarray, used: np.ndarray, h: np.ndarray, full: int) -> tuple[Params, np.ndarray]:
    """Gradients over one window, by its `full` number of symbols, and its last states. `used` leaves out what lies after a lane's end."""
    steps, lanes = x.shape
    out, gates, inner, given = _states(p, x, first, h, True)
    hs = out[1:].reshape(-1, HIDDEN)
    at = np.flatnonzero(used.ravel())
    ys, hv, n = y.ravel()[at], hs[at], np.float32(1 / full)
    d = _softmax(hv @ p["class"].T + p["class_bias"])
    d[np.arange(len(ys)), ys // CLASS_SIZE] -= 1
    g: Params = {"class": d.T @ hv, "class_bias": d.sum(0), "word": np.zeros_like(p["word"]), "word_bias": np.zeros_like(p["word_bias"])}
    dv = d @ p["class"]
    order, cuts = _by_class(ys)
    sh, sy, sd = hv[order], (ys % CLASS_SIZE)[order], np.empty_like(hv)
    for c in range(CLASSES):
        a, b = cuts[c], cuts[c + 1]
        if a < b:
            q = _softmax(sh[a:b] @ p["word"][c].T + p["word_bias"][c])
            q[np.arange(b - a), sy[a:b]] -= 1
            g["word"][c], g["word_bias"][c] = q.T @ sh[a:b], q.sum(0)
            sd[a:b] = q @ p["word"][c]
    dv[order] += sd
    back = np.zeros_like(hs)
    back[at] = dv
    back = back.reshape(steps, lanes, HIDDEN)
    dg = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
    du = np.empty_like(dg)
    z, r, c = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
    to_n = (1 - z) * (1 - c * c)
    to_z = (given - c) * z * (1 - z)
    to_r = inner * r * (1 - r)
    z, r = np.ascontiguousarray(z), np.ascontiguousarray(r)
    dh, turned = np.zeros((lanes, HIDDEN), np.float32), np.ascontiguousarray(p["state"].T)
    for t in range(steps - 1, -1, -1):
        dh += back[t]
        dn = dh * to_n[t]
        np.multiply(dh, to_z[t], out=dg[t, :, :HIDDEN])
        np.multiply(dn, to_r[t], out=dg[t, :, HIDDEN : 2 * HIDDEN])
        dg[t, :, 2 * HIDDEN :] = dn
        du[t, :, : 2 * HIDDEN] = dg[t, :, : 2 * HIDDEN]
        np.multiply(dn, r[t], out=du[t, :, 2 * HIDDEN :])
        dh *= z[t]
        dh += du[t] @ turned
        if first[t].any():
            dh[first[t]] = 0
    g["state"] = given.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
    xs, rows = x.ravel(), dg.reshape(-1, 3 * HIDDEN)
    order = np.argsort(xs.astype(np.uint16), kind="stable")
    ids, starts = np.unique(xs[order], return_index=True)
    g["inputs"] = np.zeros_like(p["inputs"])
    g["inputs"][ids] = np.add.reduceat(rows[order], starts, axis=0)
    for v in g.values():
        v *= n
    return g, out[-1]


def inputs_of(y: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What precedes each symbol: the end symbol at the start of a text."""
    x = np.concatenate([before[None], y[:-1]])
    x[first] = END
    return x


class Trainer:
    """Adam over windows of truncated backpropagation."""

    def __init__(self, p: Params, rate: float = 0.02):
        self.p = {k: v.copy() for k, v in p.items()}
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.rate, self.i, self.tokens = rate, 0, 0

    def train(self, docs: list[np.ndarray], lanes: int | None = None, steps: int = STEPS) -> None:
        """Once over all documents, laid end to end and cut into lanes of one length; few tokens get fewer lanes and so more steps.

        A state goes on from window to window, however long its document is; gradients end at the window. A lane that
        begins inside a document has the word before it as its input and no state yet.
        """
        y = np.concatenate(docs)
        if lanes is None:
            lanes = min(LANES, max(32, len(y) // (steps * UPDATES)))
        lanes = min(lanes, len(y))
        width = -(-len(y) // lanes)
        first, x = np.zeros(len(y), bool), np.append(END, y[:-1]).astype(np.int32)
        first[np.cumsum([0, *map(len, docs[:-1])])] = True
        x[first] = END
        spread = lambda a, fill: np.append(a, np.full(width * lanes - len(a), fill, a.dtype)).reshape(lanes, width).T
        x, first, used, y = spread(x, END), spread(first, False), spread(np.ones(len(y), bool), False), spread(y, END)
        h = np.zeros((lanes, HIDDEN), np.float32)
        with np.errstate(over="ignore"):
            for a in range(0, width, steps):
                at = slice(a, a + steps)
                g, h = _gradients(self.p, x[at], y[at], first[at], used[at], h, steps * lanes)
                self._step(g)
        self.tokens += int(used.sum())

    def _step(self, g: Params) -> None:
        self.i += 1
        size = np.float32(self.rate * np.sqrt(1 - 0.99**self.i) / (1 - 0.9**self.i))
        for k, d in g.items():
            m, v = self.m[k], self.v[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * d
            v *= np.float32(0.99)
            d *= d
            v += np.float32(0.01) * d
            self.p[k] -= size * m / (np.sqrt(v) + np.float32(1e-6))


def scores(p: Params, docs: list[np.ndarray], unigram: np.ndarray, share: float, lanes: int = LANES, steps: int = 64) -> np.ndarray:
    """log10 probability of each whole document's symbols under (1 - share) model + share unigram."""
    dealt = Lanes(docs, lanes)
    h = np.zeros((dealt.targets.shape[1], HIDDEN), np.float32)
    last, logs = np.zeros(len(h), np.int32), np.zeros(dealt.targets.shape[::-1])
    base = (share * unigram).astype(np.float32)
    with np.errstate(over="ignore"):
        for a, b, n in dealt.windows(steps):
            y, first = dealt.targets[a:b, :n], dealt.first[a:b, :n]
            out, *_ = _states(p, inputs_of(y, first, last[:n]), first, h[:n].copy(), False)
            h, last, ys = out[-1], y[-1], y.ravel()
            q = probabilities(p, out[1:].reshape(-1, HIDDEN), ys)
            q *= np.float32(1 - share)
            q += base[ys]
            logs[:n, a:b] = np.log10(q.reshape(b - a, n).T)
    return np.array([logs[lane, at : at + n].sum() for lane, at, n in dealt.place])
