"""A gated recurrent network over word ids with a class-factored softmax, in numpy."""

from collections.abc import Iterator

import numpy as np

HIDDEN = 16
CLASS_SIZE = 32
CLASSES = 32
END, UNKNOWN = 0, 1
WORDS = CLASS_SIZE * CLASSES - 2  # besides the end and the unknown word

WINDOW = 32
TRAINED_TOGETHER = 256
SCORED_TOGETHER = 1024
# Ids in a window of texts that are scored; fewer texts go more steps at once.
SCORED_AT_ONCE = 1 << 14
RATE, DECAY_1, DECAY_2 = 0.02, 0.9, 0.99
CLIP = 1.0

Parameters = dict[str, np.ndarray]


def initial(counts: np.ndarray) -> Parameters:
    """Parameters whose predictions are the relative frequencies ``counts`` of the ids."""
    rng = np.random.default_rng(11)
    size, h = CLASSES * CLASS_SIZE, HIDDEN
    own = np.zeros(size)
    own[:len(counts)] = counts + 0.5
    by_class = own.reshape(CLASSES, CLASS_SIZE)
    with np.errstate(divide="ignore"):
        word = np.where(by_class > 0, np.log(by_class), -1e9)
        group = by_class.sum(1)
        group = np.where(group > 0, np.log(group), -1e9) - np.log(own.sum())
    out = {
        "input": rng.normal(0, 0.3, (size, 3 * h)),
        "state": rng.normal(0, 0.5 / np.sqrt(h), (h, 3 * h)),
        "class_out": rng.normal(0, 0.02, (h, CLASSES)), "class_bias": group,
        "word_out": rng.normal(0, 0.02, (CLASSES, h, CLASS_SIZE)), "word_bias": word,
    }
    return {name: value.astype(np.float32) for name, value in out.items()}


def pack(p: Parameters) -> np.ndarray:
    return np.concatenate([p[name].reshape(-1) for name in sorted(p)])


def unpack(flat: np.ndarray) -> Parameters:
    shapes = {name: value.shape for name, value in initial(np.zeros(0)).items()}
    out, at = {}, 0
    for name in sorted(shapes):
        size = int(np.prod(shapes[name]))
        out[name] = flat[at:at + size].reshape(shapes[name]).astype(np.float32)
        at += size
    return out


def _softmax(logit: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of the chosen column, sum) of rows that become exponentials in place."""
    np.minimum(logit, 80, out=logit)  # far beyond what is learned; keeps float32 finite
    picked = logit[np.arange(len(chosen)), chosen]
    np.exp(logit, out=logit)
    total = logit @ np.ones(logit.shape[1], np.float32)
    return picked - np.log(total), total[:, None]


def _sorted(values: np.ndarray, limit: int) -> np.ndarray:
    """The stable order of whole numbers below ``limit``; short ones are sorted by digits."""
    return np.argsort(values.astype(np.min_scalar_type(limit)), kind="stable")


class Window:
    """Some steps of texts side by side, the longest first, so that those still running are
    always the first ``active``.

    What runs stands step by step in arrays without gaps; the two gates and the new
    state of all are three blocks of one array.
    """

    def __init__(self, p: Parameters, state: np.ndarray, ids: np.ndarray, active: np.ndarray,
                 keep: bool):
        self.p, self.ids, self.active = p, ids, active
        h = HIDDEN
        self.running = np.arange(state.shape[0]) < active[:, None]
        self.target = ids[self.running]
        ends = np.cumsum(active)
        self.steps = list(zip((ends - active).tolist(), ends.tolist()))
        # a sigmoid is a tanh of half the argument
        half = np.array([0.5, 0.5, 1], np.float32)[:, None, None]
        x = np.take(_blocks(p["input"]) * half, self.target, axis=1)
        w = _blocks(p["state"]) * half
        # the states before each step, and behind them those of the texts that run to the end
        states = np.empty((len(self.target) + int(active[-1]), h), np.float32)
        states[:active[0]] = state[:active[0]]
        self.passed = np.empty((len(self.target) if keep else 0, h), np.float32)
        following = [*active[1:].tolist(), int(active[-1])]
        for (start, stop), n in zip(self.steps, following):
            past, here = states[start:stop], x[:, start:stop]
            both, new = here[:2], here[2]
            y = past @ w
            both += y[:2]
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            y = y[2]
            if keep:
                self.passed[start:stop] = y
            y *= both[1]
            new += y
            np.tanh(new, out=new)
            np.subtract(past, new, out=y)
            y *= both[0]
            np.add(new[:n], y[:n], out=states[stop:stop + n])
        self.before, self.state, self.gates = states[:len(self.target)], states[len(self.target):], x

    def predictions(self, gradients: Parameters | None = None):
        """Log-probabilities of the ids that run (flat); with ``gradients`` also fills them and
        returns the slopes of the states."""
        p, target, states = self.p, self.target, self.before
        group, within = np.divmod(target, CLASS_SIZE)
        logit = states @ p["class_out"] + p["class_bias"]
        out, total = _softmax(logit, group)
        out, slope = out.astype(np.float64), None
        if gradients is not None:
            logit /= total
            logit[np.arange(len(target)), group] -= 1
            gradients["class_out"] = states.T @ logit
            gradients["class_bias"] = logit.sum(0)
            slope = logit @ p["class_out"].T
        order = _sorted(group, CLASSES)
        own, group, within = states[order], group[order], within[order]
        cuts = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        classes = [(c, i, j) for c, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        logit = p["word_bias"][group]
        for c, i, j in classes:
            logit[i:j] += own[i:j] @ p["word_out"][c]
        found, total = _softmax(logit, within)
        out[order] += found
        if gradients is not None:
            logit /= total
            logit[np.arange(len(target)), within] -= 1
            back = np.empty_like(own)
            for c, i, j in classes:
                np.matmul(own[i:j].T, logit[i:j], out=gradients["word_out"][c])
                np.matmul(logit[i:j], p["word_out"][c].T, out=back[i:j])
            gradients["word_bias"][[c for c, _, _ in classes]] = np.add.reduceat(
                logit, [i for _, i, _ in classes])
            slope[order] += back
        return out, slope

    def gradients(self) -> Parameters:
        """Of the mean negative log-likelihood, back through this window and no further."""
        p, h = self.p, HIDDEN
        g = {name: np.zeros_like(value) for name, value in p.items()}
        _, slope = self.predictions(g)
        (z, r, new), before = self.gates, self.before
        changed = (1 - z) * (1 - new * new)
        # what a slope of the state after a step gives both gates and the new state's part of it
        factors = np.stack([(before - new) * z * (1 - z), changed * self.passed * r * (1 - r),
                            changed * r])
        given, back = np.empty_like(before), np.ascontiguousarray(
            _blocks(p["state"]).transpose(0, 2, 1))
        carried = np.zeros((int(self.active[0]), h), np.float32)
        for start, stop in reversed(self.steps):
            d = carried[:stop - start]
            given[start:stop] = d
            here = factors[:, start:stop]
            here *= d
            d *= z[start:stop]
            d += slope[start:stop]
            d += (here @ back).sum(0)
        g["state"] = np.concatenate(list(before.T @ factors), axis=1)
        inputs = np.concatenate([factors[0], factors[1], given * changed], axis=1)
        order = _sorted(self.target, len(p["input"]))
        ids = self.target[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        g["input"][ids[first]] = np.add.reduceat(inputs[order], first)
        for value in g.values():
            value /= len(ids)
        return g


def _blocks(weights: np.ndarray) -> np.ndarray:
    """Weights (n, 3 h) of both gates and the new state as (3, n, h)."""
    return np.ascontiguousarray(weights.reshape(len(weights), 3, HIDDEN).transpose(1, 0, 2))


class Adam:
    def __init__(self, p: Parameters):
        self.p = {name: value.copy() for name, value in p.items()}
        self.mean = {name: np.zeros_like(value) for name, value in p.items()}
        self.square = {name: np.zeros_like(value) for name, value in p.items()}
        self.steps = 0
        self.gathered, self.tokens = {name: np.zeros_like(value) for name, value in p.items()}, 0

    def gather(self, g: Parameters, tokens: int, enough: int) -> None:
        """Adds mean gradients of some tokens, and makes a step of ``enough`` tokens."""
        for name, value in g.items():
            self.gathered[name] += value * tokens
        self.tokens += tokens
        if self.tokens >= enough:
            self.release(enough)

    def release(self, enough: int) -> None:
        """A step of the gathered gradients, which count for less if they are of fewer tokens."""
        if self.tokens:
            count = max(self.tokens, enough)
            self.step({name: value / count for name, value in self.gathered.items()})
            for value in self.gathered.values():
                value[:] = 0
            self.tokens = 0

    def step(self, g: Parameters) -> None:
        self.steps += 1
        size = np.sqrt(sum(float((value * value).sum()) for value in g.values()))
        scale = min(1.0, CLIP / (size + 1e-9))
        for name, value in g.items():
            value *= scale
            m, s = self.mean[name], self.square[name]
            m += (1 - DECAY_1) * (value - m)
            s += (1 - DECAY_2) * (value * value - s)
            m_hat = m / (1 - DECAY_1**self.steps)
            s_hat = s / (1 - DECAY_2**self.steps)
            self.p[name] -= RATE * m_hat / (np.sqrt(s_hat) + 1e-6)


def _windows(texts: list[np.ndarray], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, active) of windows over texts sorted by falling length; ``ids`` has the running ones.

    A window has ``WINDOW`` steps, or as many as ``most`` ids allow.
    """
    flat, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    begins, rising = np.cumsum(lengths) - lengths, lengths[::-1]
    start = 0
    while start < lengths[0]:
        running = len(texts) - int(np.searchsorted(rising, start, "right"))
        steps = WINDOW if most is None else max(1, most // running)
        at = np.arange(start, min(start + steps, int(lengths[0])))
        active = len(texts) - np.searchsorted(rising, at, "right")
        ids = np.zeros((len(at), running), np.int64)
        some = at[:, None] < lengths[:running]
        ids[some] = flat[(begins[:running] + at[:, None])[some]]
        yield ids, active
        start += steps


def _sides(texts: list[np.ndarray], together: int) -> Iterator[np.ndarray]:
    order = np.argsort([-len(t) for t in texts], kind="stable")
    for start in range(0, len(order), together):
        yield order[start:start + together]


def train(adam: Adam, texts: list[np.ndarray]) -> None:
    """Truncated backpropagation over texts of ids; the state goes on from window to window.

    Every window is learned from. Windows in which few texts still run are gathered into one
    step until they hold half the tokens of a first window, so that no step follows a few texts.
    """
    enough = 1
    for side in _sides(texts, TRAINED_TOGETHER):
        chosen = [texts[i] for i in side]
        state = np.zeros((len(side), HIDDEN), np.float32)
        for k, (ids, active) in enumerate(_windows(chosen)):
            n = active[0]  # texts that have ended take no more part
            window = Window(adam.p, state[:n], ids, active, True)
            if k == 0:
                enough = max(enough, int(active.sum()) // 2)
            adam.gather(window.gradients(), int(active.sum()), enough)
            state = window.state
    adam.release(enough)


def score(p: Parameters, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each complete text of ids."""
    out = np.zeros(len(texts))
    for side in _sides(texts, SCORED_TOGETHER):
        state = np.zeros((len(side), HIDDEN), np.float32)
        for ids, active in _windows([texts[i] for i in side], SCORED_AT_ONCE):
            n = active[0]  # texts that have ended take no more part
            window = Window(p, state[:n], ids, active, False)
            found, _ = window.predictions()
            out[side[:n]] += np.bincount(np.nonzero(window.running)[1], found, n)
            state = window.state
    return out
