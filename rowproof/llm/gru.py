"""A small gated recurrent language model in numpy, with a class-factored softmax."""

from __future__ import annotations

import numpy as np

END, UNKNOWN = 0, 1
CLASS = 32  # symbols in a class; classes are runs of symbol numbers
BLOCK = 2048  # steps of all lanes that are laid out at once; a multiple of every window
RUN = 1024  # tokens of a text that are learnt in one lane; scoring never cuts a text


def _sigmoid(x):
    x = np.tanh(x * np.float32(0.5))
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def streams(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Texts dealt to at most ``width`` streams of about equal total length, longest first."""
    order = np.argsort(-lengths, kind="stable")
    out = [[] for _ in range(max(1, min(width, len(lengths))))]
    load = np.zeros(len(out), np.int64)
    for i in order.tolist():
        k = int(load.argmin())
        out[k].append(i)
        load[k] += lengths[i]
    return [out[k] for k in np.argsort(-load, kind="stable")]


def side_by_side(lanes: list[np.ndarray], sizes: np.ndarray, begin: int) -> np.ndarray:
    """Steps ``begin`` to begin + BLOCK of the lanes that reach so far, one a column; -1 past an end."""
    live = int((sizes > begin).sum())
    out = np.full((min(BLOCK, int(sizes[0]) - begin), live), -1, np.int32)
    for k in range(live):
        part = lanes[k][begin : begin + BLOCK]
        out[: len(part), k] = part
    return out


class Gru:
    """Weights: ``inp`` (symbol -> gate inputs), ``rec`` (state -> gates), ``cls`` and ``sym``
    (state -> class, state -> symbol in class). Gates are reset, update, candidate."""

    def __init__(self, symbols: int, hidden: int = 16, seed: int = 5):
        self.classes = -(-symbols // CLASS)
        self.symbols, self.hidden = symbols, hidden
        rng = np.random.Generator(np.random.PCG64(seed))
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.w = {"inp": small(symbols, 3 * hidden), "rec": small(hidden, 3 * hidden), "cls": small(hidden + 1, self.classes), "sym": small(self.classes, CLASS, hidden + 1)}
        self.real = np.zeros((self.classes, CLASS), np.float32)  # minus infinity for padding
        self.real.reshape(-1)[symbols:] = -1e9

    def start_at(self, counts: np.ndarray) -> None:
        """Biases under which every symbol has its share of ``counts`` in any state."""
        table = np.full((self.classes, CLASS), 1e-9)
        table.reshape(-1)[: self.symbols] = counts + 0.5
        of_class = table.sum(1)
        self.w["cls"][-1] = np.log(of_class / of_class.sum())
        self.w["sym"][:, :, -1] = np.where(self.real < 0, 0, np.log(table / of_class[:, None]))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.w.values()])

    def unflat(self, values: np.ndarray) -> None:
        at = 0
        for name, x in self.w.items():
            self.w[name] = values[at : at + x.size].astype(np.float32).reshape(x.shape)
            at += x.size

    def step(self, before: np.ndarray, h: np.ndarray):
        n, rec, x = self.hidden, self.w["rec"], self.w["inp"][before]
        gates = _sigmoid(x[:, : 2 * n] + h @ rec[:, : 2 * n])
        r, z = gates[:, :n], gates[:, n:]
        c = np.tanh(x[:, 2 * n :] + (r * h) @ rec[:, 2 * n :])
        return c + z * (h - c), r, z, c

    def log_chance(self, h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Natural log chance of each symbol after each state."""
        h = np.c_[h, np.ones(len(h), np.float32)]
        group, inner = symbol // CLASS, symbol % CLASS
        logits = h @ self.w["cls"]
        top = logits.max(1)
        out = logits[np.arange(len(h)), group] - top - np.log(np.exp(logits - top[:, None]).sum(1))
        for g in np.unique(group).tolist():
            at = np.flatnonzero(group == g)
            own = h[at] @ self.w["sym"][g].T + self.real[g]
            top = own.max(1)
            out[at] += own[np.arange(len(at)), inner[at]] - top - np.log(np.exp(own - top[:, None]).sum(1))
        return out

    def score(self, texts: list[np.ndarray], width: int = 256, window: int = 32) -> np.ndarray:
        """log10 chance of each whole text (symbols, the end included). The state is carried
        from window to window; texts run side by side in streams and start from a zero state."""
        lengths = np.array([len(t) for t in texts], np.int64)
        out = np.zeros(len(texts))
        if not len(texts):
            return out
        lanes = streams(lengths, width)
        sizes = np.array([int(lengths[lane].sum()) for lane in lanes])
        joined = [np.concatenate([texts[i] for i in lane]).astype(np.int32) for lane in lanes]
        owner = [np.repeat(np.array(lane, np.int32), lengths[lane]) for lane in lanes]
        h, last = np.zeros((len(lanes), self.hidden), np.float32), np.full(len(lanes), END)
        for begin in range(0, int(sizes[0]), BLOCK):
            block, whose = side_by_side(joined, sizes, begin), side_by_side(owner, sizes, begin)
            chance = np.zeros(block.shape, np.float32)
            for start in range(0, len(block), window):
                live = int((sizes > begin + start).sum())
                target = block[start : start + window, :live]
                h, last = h[:live], last[:live]
                states = np.empty((*target.shape, self.hidden), np.float32)
                for t in range(len(target)):
                    h = self.step(last, h * (last != END)[:, None])[0]
                    states[t] = h
                    last = np.maximum(target[t], END)
                some = target >= 0
                chance[start : start + window, :live][some] = self.log_chance(states[some], target[some])
            real = block >= 0
            out += np.bincount(whose[real], chance[real], len(texts))
        return out / np.log(10)

    def train(self, texts: list[np.ndarray], moments=None, width: int = 512, window: int = 16, rate: float = 5e-3):
        """Truncated backpropagation through time with Adam, once over every token of every text.
        Texts run side by side in lanes; a lane that is through drops out. Texts of more than
        ``RUN`` tokens are learnt in runs of that many, which lie in any lanes, so that no lane is
        left alone with one text; a run that is no text's begin goes on from its lane's state.
        Returns the moments of Adam, for the next call."""
        texts = [t[i : i + RUN] for t in texts for i in range(0, len(t), RUN)]
        m, v, k = moments or (*({n: np.zeros_like(w) for n, w in self.w.items()} for _ in range(2)), 0)
        lanes = [np.concatenate([texts[i] for i in lane]) for lane in streams(np.array([len(t) for t in texts]), width)] if texts else []
        sizes = np.array([len(x) for x in lanes])
        h, last = np.zeros((len(lanes), self.hidden), np.float32), np.full(len(lanes), END)
        for start in range(0, int(sizes.max(initial=0)), window):
            if start % BLOCK == 0:
                block = side_by_side(lanes, sizes, start)
            live = int((sizes > start).sum())  # lanes are in the order of falling sizes
            at = start % BLOCK
            grads, h, last = self._window(block[at : at + window, :live], h[:live], last[:live])
            k += 1
            a, b = np.float32(rate / (1 - 0.9**k)), np.float32(1 / (1 - 0.99**k))
            for n, g in grads.items():
                np.clip(g, -1, 1, out=g)
                m[n] *= np.float32(0.9)
                m[n] += np.float32(0.1) * g
                g *= g
                v[n] *= np.float32(0.99)
                g *= np.float32(0.01)
                v[n] += g
                np.multiply(v[n], b, out=g)
                np.sqrt(g, out=g)
                g += np.float32(1e-6)
                np.divide(m[n], g, out=g)
                g *= a
                self.w[n] -= g
        return m, v, k

    def _window(self, target: np.ndarray, h: np.ndarray, last: np.ndarray):
        """Gradients over one window, mean per token; targets below 0 are past a lane's end."""
        n, (steps, width), w = self.hidden, target.shape, self.w
        kept, inputs = [], np.empty((steps, width), target.dtype)
        after = np.empty((steps, width, n + 1), np.float32)
        after[:, :, n] = 1
        for t in range(steps):
            inputs[t] = last
            h = h * (last != END)[:, None]
            new, r, z, c = self.step(last, h)
            kept.append((h, r, z, c))
            after[t, :, :n] = new
            h, last = new, np.maximum(target[t], END)
        g = {name: np.zeros_like(x) for name, x in w.items()}
        some = np.flatnonzero(target.reshape(-1) >= 0)
        flat = target.reshape(-1)[some]
        share = np.float32(1 / len(some) * steps)
        states = after.reshape(-1, n + 1)[some]
        group, inner, at = flat // CLASS, flat % CLASS, np.arange(len(flat))
        p = states @ w["cls"]
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[at, group] -= 1
        p *= share
        g["cls"] += states.T @ p
        near = p @ w["cls"].T
        for k in np.unique(group).tolist():
            own = np.flatnonzero(group == k)
            q = states[own] @ w["sym"][k].T + self.real[k]
            q = np.exp(q - q.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(own)), inner[own]] -= 1
            q *= share
            g["sym"][k] = q.T @ states[own]
            near[own] += q @ w["sym"][k]
        back = np.zeros((steps * width, n), np.float32)
        back[some] = near[:, :n]
        back = back.reshape(steps, width, n)
        dh, rec, into = np.zeros((width, n), np.float32), w["rec"], np.empty((steps, width, 3 * n), np.float32)
        for t in range(steps - 1, -1, -1):
            old, r, z, c = kept[t]
            d = dh + back[t]
            dz = into[t, :, n : 2 * n]
            dc = into[t, :, 2 * n :]
            np.multiply(d * (1 - z), 1 - c * c, out=dc)
            np.multiply(d * (old - c), z * (1 - z), out=dz)
            drh = dc @ rec[:, 2 * n :].T
            into[t, :, :n] = drh * old * r * (1 - r)
            g["rec"][:, : 2 * n] += old.T @ into[t, :, : 2 * n]
            g["rec"][:, 2 * n :] += (r * old).T @ dc
            dh = d * z + drh * r + into[t, :, : 2 * n] @ rec[:, : 2 * n].T
            dh *= (inputs[t] != END)[:, None]
        before = inputs.reshape(-1)
        order = np.argsort(before, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(before[order]) != 0])
        g["inp"][before[order][begin]] = np.add.reduceat(into.reshape(-1, 3 * n)[order], begin)
        return g, h, last
