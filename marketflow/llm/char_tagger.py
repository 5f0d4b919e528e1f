"""Character-level bidirectional LSTM with a CRF on top, in numpy: training by Adam on windows of equal
length, emissions for batches of windows, and Viterbi decoding of sequences of any length."""

from __future__ import annotations

import numpy as np

#: Printable ASCII has a code of its own; 96 letters, 97 white space, 98 all else; 0 is padding.
SYMBOLS = 99


def char_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = np.full(len(points), 98, np.int64)
    ascii_ = (points >= 32) & (points < 127)
    codes[ascii_] = points[ascii_] - 31
    codes[np.isin(points, (9, 10, 11, 12, 13))] = 97
    high = points >= 127
    if high.any():
        codes[high] = np.array([96 if chr(p).isalpha() else 98 for p in points[high]])
    return codes


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, tags: int, embedding: int = 12, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.hidden, self.tags = hidden, tags
        self.p = {"E": rng.normal(0, 0.5, (SYMBOLS, embedding)), "Wo": init(2 * hidden, tags), "bo": np.zeros(tags),
                  "T": np.zeros((tags, tags)), "s": np.zeros(tags), "e": np.zeros(tags)}
        for d in "fb":
            bias = np.zeros(4 * hidden)
            bias[hidden:2 * hidden] = 1  # forget gates open at first
            self.p |= {"Wx" + d: init(embedding, 4 * hidden), "Wh" + d: init(hidden, 4 * hidden), "b" + d: bias}

    def _lstm(self, x, d, keep=None):
        n, length, _ = x.shape
        h = c = np.zeros((n, self.hidden))
        gx = x @ self.p["Wx" + d] + self.p["b" + d]
        out = np.empty((n, length, self.hidden))
        H = self.hidden
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            g = gx[:, t] + h @ self.p["Wh" + d]
            i, f, o = _sigmoid(g[:, :H]), _sigmoid(g[:, H:2 * H]), _sigmoid(g[:, 2 * H:3 * H])
            z = np.tanh(g[:, 3 * H:])
            new = f * c + i * z
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, z, c, th, h))
            c, h = new, o * th
            out[:, t] = h
        return out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        x = self.p["E"][codes]
        return np.concatenate([self._lstm(x, "f"), self._lstm(x, "b")], 2) @ self.p["Wo"] + self.p["bo"]

    def _loss(self, codes, tags):
        """Mean negative log-likelihood of a batch and its gradients."""
        p, grads = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        n, length = codes.shape
        x = p["E"][codes]
        kept = {"f": [], "b": []}
        hidden = np.concatenate([self._lstm(x, d, kept[d]) for d in "fb"], 2)
        em = hidden @ p["Wo"] + p["bo"]
        alpha = np.empty_like(em)
        alpha[:, 0] = p["s"] + em[:, 0]
        for t in range(1, length):
            alpha[:, t] = _lse(alpha[:, t - 1, :, None] + p["T"], 1) + em[:, t]
        log_z = _lse(alpha[:, -1] + p["e"], 1)
        beta = np.empty_like(em)
        beta[:, -1] = p["e"]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _lse(p["T"] + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        marginal = np.exp(alpha + beta - log_z[:, None, None])
        rows, cols = np.arange(n)[:, None], np.arange(length)[None]
        gold = p["s"][tags[:, 0]] + p["e"][tags[:, -1]] + em[rows, cols, tags].sum(1) + p["T"][tags[:, :-1], tags[:, 1:]].sum(1)
        pair = np.exp(alpha[:, :-1, :, None] + p["T"] + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]).sum((0, 1))
        np.subtract.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        d_em = marginal.copy()
        d_em[rows, cols, tags] -= 1
        d_em /= n
        grads["T"], grads["s"] = pair / n, d_em[:, 0].sum(0)
        last = marginal[:, -1].copy()
        last[np.arange(n), tags[:, -1]] -= 1
        grads["e"] = last.sum(0) / n
        grads["Wo"] = hidden.reshape(-1, hidden.shape[2]).T @ d_em.reshape(-1, self.tags)
        grads["bo"] = d_em.sum((0, 1))
        d_hidden = d_em @ p["Wo"].T
        dx = np.zeros_like(x)
        H = self.hidden
        for k, d in enumerate("fb"):
            dh_next = dc_next = np.zeros((n, H))
            dg_all = np.zeros((n, length, 4 * H))
            for t, i, f, o, z, c, th, h in reversed(kept[d]):
                dh = d_hidden[:, t, k * H:(k + 1) * H] + dh_next
                dc = dh * o * (1 - th * th) + dc_next
                dg = np.concatenate([dc * z * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - z * z)], 1)
                dg_all[:, t] = dg
                grads["Wh" + d] += h.T @ dg
                dh_next, dc_next = dg @ p["Wh" + d].T, dc * f
            flat = dg_all.reshape(-1, 4 * H)
            grads["Wx" + d] = x.reshape(-1, x.shape[2]).T @ flat
            grads["b" + d] = flat.sum(0)
            dx += dg_all @ p["Wx" + d].T
        np.add.at(grads["E"], codes, dx)
        return float((log_z - gold).mean()), grads

    def train(self, codes: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 11):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            at = rng.integers(0, len(codes), min(batch, len(codes)))
            _, grads = self._loss(codes[at], tags[at])
            norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
            now = rate * (1 - step / (steps + 1)) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
            for k, g in grads.items():
                g = g * min(1.0, 5 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - now * m[k] / (np.sqrt(v[k]) + 1e-8)

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best tag sequences for emission sequences of any lengths (batched by similar length)."""
        out: list = [None] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(order):
            first = len(sequences[order[at]])
            stop = at
            while stop < len(order) and len(sequences[order[stop]]) <= 2 * first and stop - at < 512:
                stop += 1
            group = order[at:stop]
            for k, tags in zip(group, self._viterbi([sequences[k] for k in group])):
                out[k] = tags
            at = stop
        return out

    def _viterbi(self, group: list[np.ndarray]) -> list[np.ndarray]:
        size = np.array([len(x) for x in group])
        n, length = len(group), int(size.max())
        em = np.zeros((n, length, self.tags))
        for row, x in zip(em, group):
            row[:len(x)] = x
        back = np.zeros((n, length, self.tags), np.int8)
        best = self.p["s"] + em[:, 0]
        for t in range(1, length):
            both = best[:, :, None] + self.p["T"]
            back[:, t] = both.argmax(1)
            new = both.max(1) + em[:, t]
            best = np.where((size > t)[:, None], new, best)
        tag = (best + self.p["e"]).argmax(1)
        tags = np.zeros((n, length), np.int64)
        for t in range(length - 1, -1, -1):
            inside = size > t
            tags[inside, t] = tag[inside]
            tag = np.where(inside & (t > 0), back[np.arange(n), t, tag], tag)
        return [row[:k] for row, k in zip(tags, size)]
