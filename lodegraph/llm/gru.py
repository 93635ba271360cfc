"""A small gated recurrent language model in numpy: truncated backpropagation, class-factored output softmax."""

from __future__ import annotations

import ctypes

import numpy as np

UNKNOWN = 0
#: Rows whose logits are held at once: they stay near the processor.
ROWS = 8192


def keep_memory(mmap: int = 32 << 20, trim: int = 128 << 20) -> bool:
    """Lets this process (a worker) use the memory of freed arrays again, up to trim bytes, instead of giving it back to the system and
    touching it anew at each step; whether the C library offers that (glibc)."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return False
    return bool(mallopt(-3, mmap) and mallopt(-1, trim))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def row_sums(x: np.ndarray) -> np.ndarray:
    """Of short rows, which a product with ones adds up faster than a reduction."""
    return x @ np.ones(x.shape[1], x.dtype)


def log_of(x: np.ndarray, goal: np.ndarray, bounded: bool = False) -> np.ndarray:
    """The goals' log probabilities by logits x, which are used up.  Bounded ones need no shift by their maximum."""
    if not bounded:
        x -= x.max(axis=1, keepdims=True)
    at_goal = x[np.arange(len(goal)), goal].astype(np.float64)
    np.exp(x, out=x)
    return at_goal - np.log(row_sums(x).astype(np.float64))


def softmax_of(x: np.ndarray, rows: np.ndarray, goal: np.ndarray, bounded: bool = False) -> float:
    """Turns logits into probabilities, in place; gives the sum of the goals' log probabilities.  Bounded ones need no shift by their maximum."""
    if not bounded:
        x -= x.max(axis=1, keepdims=True)
    at_goal = float(x[rows, goal].sum(dtype=np.float64))
    np.exp(x, out=x)
    total = row_sums(x)
    x *= np.reciprocal(total)[:, None]
    return at_goal - float(np.log(total).sum(dtype=np.float64))


class Adam:
    """Steps along gradients, their lengths bounded."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.turn = p, 0
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.s = {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, g: dict[str, np.ndarray], batch: int, rate: float) -> None:
        m, s = self.m, self.s
        self.turn += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        size = min(1.0, 5.0 * batch / max(norm, 1e-9)) / batch
        for k in self.p:
            x = g[k] * size
            m[k] += 0.1 * (x - m[k])
            s[k] += 0.01 * (x * x - s[k])
            self.p[k] -= rate * (m[k] / (1 - 0.9**self.turn)) / (np.sqrt(s[k] / (1 - 0.99**self.turn)) + 1e-6)


class Gru:
    """vocab words, numbered by falling frequency after the unknown word; classes of equal width over these numbers.

    P(word) = P(class | state) * P(word | class, state)."""

    def __init__(self, counts: np.ndarray, hidden: int = 16, width: int = 32, seed: int = 1, dtype: type = np.float32):
        """counts: training count of each word of the vocabulary (number 0: all unknown words together)."""
        rng = np.random.default_rng(seed)
        classes = -(-len(counts) // width)
        self.hidden, self.width, self.classes = hidden, width, classes
        mass = np.zeros(classes * width)
        mass[: len(counts)] = counts + 1.0
        grid = mass.reshape(classes, width)
        with np.errstate(divide="ignore"):
            word_bias = np.where(grid > 0, np.log(grid / grid.sum(axis=1, keepdims=True)), -40.0)
        scale = 1 / np.sqrt(hidden)
        self.p = {
            "E": rng.normal(0, 0.3, (classes * width, hidden)),
            "W": rng.normal(0, scale, (hidden, 3 * hidden)),
            "U": rng.normal(0, scale, (hidden, 3 * hidden)),
            "b": np.zeros(3 * hidden),
            "C": rng.normal(0, 0.05, (hidden, classes)),
            "c": np.log(grid.sum(axis=1) / grid.sum()),
            "V": rng.normal(0, 0.05, (classes, hidden, width)),
            "v": word_bias,
        }
        self.p = {k: x.astype(dtype) for k, x in self.p.items()}

    def bounded(self) -> tuple[bool, bool]:
        """Whether the classes' logits, and the words', stay where exp neither overflows nor leaves a row without a term, at any state (its parts are within 1)."""

        def holds(weights: np.ndarray, bias: np.ndarray) -> bool:
            reach, most = self.hidden * float(np.abs(weights).max()), bias.max(axis=-1)
            return float(most.max()) + reach < 60 and float(most.min()) - reach > -60

        return holds(self.p["C"], self.p["c"]), holds(self.p["V"], self.p["v"])

    @property
    def number(self) -> type:
        """Narrow word numbers are sorted by radix."""
        return np.int16 if self.classes * self.width <= 1 << 15 else np.int64

    def word_logits(self, flat: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The logits of each row's class, and the stretch of each class; cls ascends."""
        edges = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        stretches = [(k, edges[k], edges[k + 1]) for k in range(self.classes) if edges[k] < edges[k + 1]]
        out = np.empty((len(flat), self.width), flat.dtype)
        for k, a, b in stretches:
            np.matmul(flat[a:b], self.p["V"][k], out=out[a:b])
            out[a:b] += self.p["v"][k]
        return out, stretches

    def by_gate(self, x: np.ndarray) -> np.ndarray:
        """Columns of the three gates as three arrays of their own, each without gaps."""
        return np.ascontiguousarray(x.reshape(len(x), 3, self.hidden).transpose(1, 0, 2))

    def states(self, inputs: np.ndarray, h: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        """inputs: steps x batch.  The state after each step, and, where it is to be kept, what backpropagation needs."""
        p, n = self.p, self.hidden
        table, by_state = self.by_gate(p["E"] @ p["W"] + p["b"]), self.by_gate(p["U"])
        kept, out = [], np.empty((*inputs.shape, n), h.dtype)
        for t in range(len(inputs)):
            x = table.take(inputs[t], axis=1)
            u = np.matmul(h, by_state)
            x[:2] += u[:2]
            z, r = sigmoid(x[:2])
            new = x[2]
            new += r * u[2]
            np.tanh(new, out=new)
            if keep:
                kept.append((h, z, r, new, u[2]))
            h = np.subtract(h, new, out=out[t])
            h *= z
            h += new
        return out, kept

    def loss(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Sum of -ln P of the targets over a window, its gradients (cut at the window's begin), the last state."""
        p, n = self.p, self.hidden
        out, kept = self.states(inputs, h)
        g = {k: np.zeros_like(x) for k, x in p.items()}
        # words of one class side by side: each class works on a stretch of rows
        few_classes, few_words = self.bounded()
        goal = targets.ravel().astype(self.number)
        order = np.argsort(goal // self.width, kind="stable")
        flat, goal = out.reshape(-1, n).take(order, axis=0), goal[order]
        cls, inner = goal // self.width, goal % self.width
        back_in_place, loss = np.empty_like(flat), 0.0
        for i in range(0, len(goal), ROWS):
            at, want, rows = flat[i : i + ROWS], cls[i : i + ROWS], np.arange(min(ROWS, len(goal) - i))
            lc = at @ p["C"]
            lc += p["c"]
            loss -= softmax_of(lc, rows, want, few_classes)
            lc[rows, want] -= 1
            g["C"] += at.T @ lc
            g["c"] += lc.sum(axis=0)
            dh = lc @ p["C"].T
            lw, stretches = self.word_logits(at, want)
            loss -= softmax_of(lw, rows, inner[i : i + ROWS], few_words)
            lw[rows, inner[i : i + ROWS]] -= 1
            for k, a, b in stretches:
                g["V"][k] += at[a:b].T @ lw[a:b]
                g["v"][k] += lw[a:b].sum(axis=0)
                dh[a:b] += lw[a:b] @ p["V"][k].T
            back_in_place[order[i : i + ROWS]] = dh
        dh = back_in_place.reshape(out.shape)
        back = np.zeros_like(h)
        by_state = self.by_gate(p["U"]).transpose(0, 2, 1)
        dx = np.empty((3, *inputs.shape, n), h.dtype)  # by gate
        du = np.empty((*inputs.shape, n), h.dtype)  # of the third gate; the others' are as in dx
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, new, u = kept[t]
            back += dh[t]
            hold = back * z
            back -= hold
            dz, dr, dnew = dx[0, t], dx[1, t], dx[2, t]
            np.multiply(new, new, out=dnew)
            np.subtract(1, dnew, out=dnew)
            dnew *= back
            np.subtract(before, new, out=dz)
            dz *= hold - hold * z
            np.multiply(dnew, r, out=du[t])
            np.subtract(1, r, out=dr)
            dr *= u
            dr *= du[t]
            back = dz @ by_state[0]
            back += dr @ by_state[1]
            back += du[t] @ by_state[2]
            back += hold
        states = np.concatenate([k[0] for k in kept]).T
        flat_x = dx.reshape(3, -1, n)
        g["U"] = np.concatenate([states @ flat_x[0], states @ flat_x[1], states @ du.reshape(-1, n)], axis=1)
        # the inputs' gradients, summed by word
        e = inputs.ravel().astype(self.number)
        order = np.argsort(e, kind="stable")
        words, first = np.unique(e[order], return_index=True)
        if len(e):
            by_word = np.concatenate([np.add.reduceat(x.take(order, axis=0), first, axis=0) for x in flat_x], axis=1)
            g["b"] = by_word.sum(axis=0)
            g["W"] = p["E"][words].T @ by_word
            g["E"][words] = by_word @ p["W"].T
        return loss, g, out[-1]

    def train(self, stream: np.ndarray, batch: int = 32, window: int = 32, epochs: int = 3, rate: float = 0.01) -> list[float]:
        """Truncated backpropagation (Adam) over a stream of word numbers in which texts end with their end word; gives nats a word by epoch."""
        steps = (len(stream) - 1) // batch
        if steps < 1:
            return []
        inputs = stream[: steps * batch].reshape(batch, steps).T
        targets = stream[1 : steps * batch + 1].reshape(batch, steps).T
        adam, history = Adam(self.p), []
        for epoch in range(epochs):
            h = np.zeros((batch, self.hidden), self.p["U"].dtype)
            total = 0.0
            for a in range(0, steps, window):
                loss, g, h = self.loss(inputs[a : a + window], targets[a : a + window], h)
                total += loss
                adam.step(g, batch, rate * 0.5**epoch)
            history.append(total / (steps * batch))
        return history

    def learn(self, adam: Adam, block: np.ndarray, rate: float, batch: int = 32, window: int = 32) -> int:
        """One pass of truncated backpropagation over all words of a block but its first; gives their number."""
        at = 0
        while at < len(block) - 1:  # what doesn't fill equal rows goes into fewer, shorter ones
            left = len(block) - 1 - at
            rows = min(batch, max(1, left // window))
            steps = left // rows
            inputs = block[at : at + rows * steps].reshape(rows, steps).T
            targets = block[at + 1 : at + rows * steps + 1].reshape(rows, steps).T
            h = np.zeros((rows, self.hidden), self.p["U"].dtype)
            for a in range(0, steps, window):
                _, g, h = self.loss(inputs[a : a + window], targets[a : a + window], h)
                adam.step(g, rows, rate)
            at += rows * steps
        return max(0, len(block) - 1)

    def log_probability(self, texts: list[np.ndarray], first: int, window: int = 64) -> np.ndarray:
        """ln P of each whole text (word numbers, the end word last).  Texts go side by side, a window at a time, the state carried over."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lens, kind="stable")
        flow = np.concatenate([*texts, np.zeros(1, np.int64)]).astype(self.number)
        begins = (np.cumsum(lens) - lens)[order]
        lens = lens[order]
        out = np.zeros(len(texts))
        few_classes, few_words = self.bounded()
        p = self.p
        h = np.zeros((len(texts), self.hidden), p["U"].dtype)
        before = np.full(len(texts), first, self.number)
        for a in range(0, int(lens[0]) if len(lens) else 0, window):
            live = int((lens > a).sum())
            most = min(window, int(lens[0]) - a)
            steps = a + np.arange(most)[:, None]
            mask = steps < lens[:live]
            goal = flow[np.where(mask, begins[:live] + steps, len(flow) - 1)]
            inputs = np.concatenate([before[None, :live], goal[:-1]])
            states, _ = self.states(inputs, h[:live], keep=False)
            h[:live], before[:live] = states[-1], goal[-1]
            flat, want = states[mask], goal[mask]
            cls, inner = want // self.width, want % self.width
            # words of one class side by side: each class works on a stretch of rows
            by = np.argsort(cls, kind="stable")
            flat, cls, inner = flat[by], cls[by], inner[by]
            got = np.empty(len(want))
            for i in range(0, len(want), ROWS):
                at, of = flat[i : i + ROWS], cls[i : i + ROWS]
                logits = at @ p["C"]
                logits += p["c"]
                part = log_of(logits, of, few_classes)
                if len(want) <= 512:  # few words: their classes' weights side by side
                    logits = np.einsum("nh,nhw->nw", at, p["V"][of]) + p["v"][of]
                else:
                    logits, _ = self.word_logits(at, of)
                got[i : i + ROWS] = part + log_of(logits, inner[i : i + ROWS], few_words)
            out[:live] += np.bincount(np.nonzero(mask)[1][by], got, minlength=live)
        back = np.empty(len(texts))
        back[order] = out
        return back
