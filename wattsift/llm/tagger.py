"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

All windows have one length, so that a batch of them is an array; a batch runs step by step over its characters.
"""

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
LENGTH = 64

#: Characters: letters of either case as one, digits as one, the signs below each, other ASCII and all beyond.
SIGNS = "@.+-()_ %:/,;=\"'#\n"
CLASSES = 26 + 1 + len(SIGNS) + 3
PAD, OTHER, WIDE = CLASSES - 3, CLASSES - 2, CLASSES - 1


def _classes() -> np.ndarray:
    out = np.full(128, OTHER, np.int64)
    for k in range(26):
        out[65 + k] = out[97 + k] = k
    out[48:58] = 26
    for k, sign in enumerate(SIGNS):
        out[ord(sign)] = 27 + k
    return out


ASCII = _classes()


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, ASCII[np.minimum(points, 127)], WIDE)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Tagger:
    def __init__(self, seed: int, weights: dict[str, np.ndarray] | None = None, embed: int = 12, hidden: int = 16):
        """Fresh weights by the seed, or given ones."""
        self.hidden = hidden
        if weights:
            self.p = weights
            return
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": draw(CLASSES, embed), "out": draw(2 * hidden, TAGS), "out_b": np.zeros(TAGS, np.float32)}
        self.p["move"] = np.zeros((TAGS, TAGS), np.float32)
        for side in ("f", "b"):
            self.p[side + "x"], self.p[side + "h"] = draw(embed, 4 * hidden), draw(hidden, 4 * hidden)
            self.p[side + "b"] = np.zeros(4 * hidden, np.float32)
            self.p[side + "b"][hidden : 2 * hidden] = 1

    def _lstm(self, side: str, x: np.ndarray):
        """x: steps x batch x embed. Hidden states, and what the way back needs."""
        h_size, wh = self.hidden, self.p[side + "h"]
        pre = x @ self.p[side + "x"] + self.p[side + "b"]
        h = c = np.zeros((x.shape[1], h_size), np.float32)
        hs, kept = np.empty((len(x), x.shape[1], h_size), np.float32), []
        for t in range(len(x)):
            z = pre[t] + h @ wh
            i, f, o = _sigmoid(z[:, :h_size]), _sigmoid(z[:, h_size : 2 * h_size]), _sigmoid(z[:, 2 * h_size : 3 * h_size])
            g = np.tanh(z[:, 3 * h_size :])
            before_c, before_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            kept.append((i, f, o, g, tc, before_c, before_h))
        return hs, kept

    def _lstm_back(self, side: str, x, kept, d_hs, grads) -> np.ndarray:
        wx, wh = self.p[side + "x"], self.p[side + "h"]
        dh = dc = np.zeros_like(d_hs[0])
        dz_all = np.empty((len(x), x.shape[1], 4 * self.hidden), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, tc, before_c, before_h = kept[t]
            dh = dh + d_hs[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            dz_all[t] = dz
            grads[side + "h"] += before_h.T @ dz
            dh, dc = dz @ wh.T, dc * f
        flat = dz_all.reshape(-1, dz_all.shape[2])
        grads[side + "x"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[side + "b"] += flat.sum(0)
        return dz_all @ wx.T

    def emissions(self, windows: np.ndarray):
        """windows: batch x steps of classes. Scores steps x batch x tags, and what the way back needs."""
        x = self.p["embed"][windows.T]
        forth, kept_f = self._lstm("f", x)
        back, kept_b = self._lstm("b", x[::-1])
        both = np.concatenate((forth, back[::-1]), axis=2)
        return both @ self.p["out"] + self.p["out_b"], (x, both, kept_f, kept_b)

    def marginals(self, scores: np.ndarray):
        """Tag probabilities at each step, log total, and the log messages from both sides."""
        move = self.p["move"]
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0]
        for t in range(1, len(scores)):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + move, 1) + scores[t]
        for t in range(len(scores) - 2, -1, -1):
            beta[t] = _logsum(move + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsum(alpha[-1], 1)
        return np.exp(alpha + beta - total[:, None]), total, alpha, beta

    def gradient(self, windows: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        scores, (x, both, kept_f, kept_b) = self.emissions(windows)
        gamma, total, alpha, beta = self.marginals(scores)
        n, gold = len(windows), tags.T
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = gamma.copy()
        np.put_along_axis(d, gold[:, :, None], np.take_along_axis(d, gold[:, :, None], 2) - 1, 2)
        d = (d / n).astype(np.float32)
        for t in range(1, len(scores)):
            pair = np.exp(alpha[t - 1][:, :, None] + self.p["move"] + (scores[t] + beta[t])[:, None, :] - total[:, None, None])
            grads["move"] += pair.sum(0) / n
        np.add.at(grads["move"], (gold[:-1].ravel(), gold[1:].ravel()), -1 / n)
        flat = d.reshape(-1, TAGS)
        grads["out"] += both.reshape(-1, both.shape[2]).T @ flat
        grads["out_b"] += flat.sum(0)
        d_both = d @ self.p["out"].T
        dx = self._lstm_back("f", x, kept_f, d_both[:, :, : self.hidden], grads)
        dx = dx + self._lstm_back("b", x[::-1], kept_b, d_both[::-1, :, self.hidden :], grads)[::-1]
        np.add.at(grads["embed"], windows.T, dx)
        return grads

    def fit(self, windows: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 1) -> "Tagger":
        """Adam on batches in a seeded order, the step falling to a tenth."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, max(1, epochs * (-(-len(windows) // batch)))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k, g in self.gradient(windows[own], tags[own]).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = (
                        self.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                    ).astype(np.float32)
        return self

    def best_paths(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi tags for pieces of any length, given scores steps x tags of each."""
        move = self.p["move"].copy()
        for to in range(2, TAGS, 2):  # inside a kind only after the same kind
            move[[k for k in range(TAGS) if k not in (to - 1, to)], to] = -1e4
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
        order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
        for a in range(0, len(order), 128):
            own = order[a : a + 128]
            longest = max(len(scores[k]) for k in own)
            best = np.zeros((len(own), TAGS))
            came = np.zeros((longest, len(own), TAGS), np.int8)
            lengths = np.array([len(scores[k]) for k in own])
            grid = np.zeros((longest, len(own), TAGS))
            for j, k in enumerate(own):
                grid[: len(scores[k]), j] = scores[k]
            best = grid[0].copy()
            best[:, 2::2] = -1e4
            ends = [best.copy()]
            for t in range(1, longest):
                ways = best[:, :, None] + move
                came[t] = ways.argmax(1)
                best = ways.max(1) + grid[t]
                ends.append(best)
            for j, k in enumerate(own):
                n = lengths[j]
                path = np.empty(n, np.int64)
                path[-1] = int(ends[n - 1][j].argmax())
                for t in range(n - 1, 0, -1):
                    path[t - 1] = came[t, j, path[t]]
                out[k] = path
        return out
