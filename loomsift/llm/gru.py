"""A gated recurrent language model in numpy with a class-factored softmax.

Input rows are looked up ready-made (embedding and input weights in one table).  The
output is P(class | state) times P(word | class, state); classes are equal slices of the
lexicon by frequency, and one more class stands for all other words.  Biases start at
the corpus frequencies, so an untrained model is the unigram model.  Lanes of tokens run
side by side; the state goes on from window to window and is reset where a text begins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CLASSES, WORDS, HIDDEN = 32, 32, 16
LEXICON = CLASSES * WORDS
RARE, BEGIN = LEXICON, LEXICON + 1


@dataclass
class Model:
    table: np.ndarray      # input rows: (LEXICON + 2, 3 HIDDEN)
    inner: np.ndarray      # (HIDDEN, 3 HIDDEN)
    classes: np.ndarray    # (CLASSES + 1, HIDDEN)
    class_bias: np.ndarray
    words: np.ndarray      # (CLASSES, WORDS, HIDDEN)
    word_bias: np.ndarray  # (CLASSES, WORDS)

    def arrays(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.classes, self.class_bias, self.words, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> Model:
        shapes = [(LEXICON + 2, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (CLASSES + 1, HIDDEN), (CLASSES + 1,), (CLASSES, WORDS, HIDDEN), (CLASSES, WORDS)]
        out, at = [], 0
        for s in shapes:
            n = int(np.prod(s))
            out.append(flat[at:at + n].reshape(s).copy())
            at += n
        return cls(*out)


def start_model(counts: np.ndarray, rare: int, seed: int = 7, kind: type = np.float32) -> Model:
    """Small random weights; biases from the counts of the lexicon (most frequent first) and of all other tokens."""
    rng = np.random.default_rng(seed)
    c = np.zeros(LEXICON)
    c[:len(counts)] = counts
    c = c.reshape(CLASSES, WORDS)
    sums = np.append(c.sum(1), rare) + 0.5

    def small(*shape):
        return (rng.normal(size=shape) * 0.1).astype(kind)

    return Model(small(LEXICON + 2, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), small(CLASSES + 1, HIDDEN) * 0, np.log(sums / sums.sum()).astype(kind),
                 small(CLASSES, WORDS, HIDDEN) * 0, np.log((c + 0.01) / (c + 0.01).sum(1, keepdims=True)).astype(kind))


def run_states(m: Model, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = False):
    """States (steps, HIDDEN, lanes) after each input of a window (steps, lanes).

    ``fresh`` marks inputs that begin a text; ``state`` is (HIDDEN, lanes).  ``keep`` also
    returns what backpropagation needs: states before, gates, candidates and their inner
    part.  Lanes come last, so every gate is one block of memory.
    """
    steps, lanes = inputs.shape
    h2 = 2 * HIDDEN
    half = np.ones((3 * HIDDEN, 1), m.table.dtype)
    half[:h2] = 0.5  # a sigmoid is a tanh of half its input
    x = m.table[inputs].transpose(0, 2, 1) * half
    weights = m.inner.T * half
    states = np.empty((steps, HIDDEN, lanes), m.table.dtype)
    before, inner, fill = (np.empty_like(states) for _ in range(3)) if keep else (None, None, None)
    gates = np.empty((steps, h2, lanes), m.table.dtype) if keep else None
    begins = fresh.any(1).tolist()
    for t in range(steps):
        if begins[t]:
            state = state * ~fresh[t]
        u = weights @ state
        zr, un = u[:h2], u[h2:]
        zr += x[t, :h2]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        n = zr[HIDDEN:] * un
        n += x[t, h2:]
        np.tanh(n, out=n)
        if keep:
            before[t], gates[t], fill[t], inner[t] = state, zr, n, un
        new = states[t]
        np.subtract(state, n, out=new)
        new *= zr[:HIDDEN]
        new += n
        state = new
    return states, state.copy(), (before, gates, fill, inner)


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the rows by class, and the slice of each class that occurs, without that of all other words."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(classes, minlength=CLASSES + 1)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends[:CLASSES - 1]], ends[:CLASSES], strict=True)) if b > a]


def _softmax(weights: np.ndarray, bias: np.ndarray, h: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits and their sums; logits are held below what would overflow."""
    e = h @ weights.T
    e += bias
    np.minimum(e, 80, out=e)
    np.exp(e, out=e)
    return e, e @ ones + 1e-30


def _rows(states: np.ndarray) -> np.ndarray:
    """(steps, HIDDEN, lanes) as one row for each step and lane."""
    return states.transpose(0, 2, 1).reshape(-1, HIDDEN)


def log_probs(m: Model, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of P(target | state), one row each; for RARE of its class alone."""
    classes = targets // WORDS
    ones = np.ones(max(CLASSES + 1, WORDS), states.dtype)
    order, slices = _by_class(classes)
    h, word, c = states[order], (targets - classes * WORDS)[order], classes[order]
    p = np.empty(len(targets), states.dtype)
    for at in range(0, len(targets), 4096):
        s = slice(at, at + 4096)
        e, total = _softmax(m.classes, m.class_bias, h[s], ones[:CLASSES + 1])
        p[s] = (e[np.arange(len(total)), c[s]] + 1e-30) / total
    for c, a, b in slices:
        e, total = _softmax(m.words[c], m.word_bias[c], h[a:b], ones[:WORDS])
        p[a:b] *= (e[np.arange(b - a), word[a:b]] + 1e-30) / total
    out = np.empty_like(p)
    out[order] = np.log(np.maximum(p, 1e-37))
    return out


def gradients(m: Model, inputs: np.ndarray, fresh: np.ndarray, targets: np.ndarray, state: np.ndarray):
    """Loss (nats), gradients by array of the model (the table's as rows, values) and the state after the window.

    Targets below 0 are empty lanes.  Backpropagation stops at the window's start.
    """
    steps, lanes = inputs.shape
    states, last, (before, gates, fill, inner) = run_states(m, inputs, fresh, state, keep=True)
    flat, goal = _rows(states), targets.ravel()
    used = np.flatnonzero(goal >= 0)
    classes = goal[used] // WORDS
    order, slices = _by_class(classes)
    used, classes = used[order], classes[order]
    h, word = flat[used], goal[used] - classes * WORDS
    at = np.arange(len(used))
    ones = np.ones(max(CLASSES + 1, WORDS), h.dtype)
    p, total = _softmax(m.classes, m.class_bias, h, ones[:CLASSES + 1])
    p /= total[:, None]
    loss = -np.log(p[at, classes] + 1e-30).sum()
    p[at, classes] -= 1
    d_classes, d_class_bias = p.T @ h, p.sum(0)
    dh = p @ m.classes
    d_words, d_word_bias = np.zeros_like(m.words), np.zeros_like(m.word_bias)
    for c, a, b in slices:
        q, total = _softmax(m.words[c], m.word_bias[c], h[a:b], ones[:WORDS])
        q /= total[:, None]
        some = at[:b - a]
        loss -= np.log(q[some, word[a:b]] + 1e-30).sum()
        q[some, word[a:b]] -= 1
        np.matmul(q.T, h[a:b], out=d_words[c])
        np.matmul(ones[:b - a] if b - a <= len(ones) else np.ones(b - a, h.dtype), q, out=d_word_bias[c])
        dh[a:b] += q @ m.words[c]
    d_states = np.zeros_like(flat)
    d_states[used] = dh
    d_states = np.ascontiguousarray(d_states.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1))
    h2 = 2 * HIDDEN
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    to_fill = (1 - z) * (1 - fill * fill)
    to_z = (before - fill) * z * (1 - z)
    to_r = inner * r * (1 - r)
    d_u = np.empty((steps, 3 * HIDDEN, lanes), h.dtype)
    d_fill = np.empty_like(d_states)
    back = np.zeros((HIDDEN, lanes), h.dtype)
    begins = fresh.any(1).tolist()
    for t in range(steps - 1, -1, -1):
        d = d_states[t]
        d += back
        dn, u = d_fill[t], d_u[t]
        np.multiply(d, to_fill[t], out=dn)
        np.multiply(d, to_z[t], out=u[:HIDDEN])
        np.multiply(dn, to_r[t], out=u[HIDDEN:h2])
        np.multiply(dn, r[t], out=u[h2:])
        back = m.inner @ u
        back += d * z[t]
        if begins[t]:
            back *= ~fresh[t]
    d_inner = before.transpose(1, 0, 2).reshape(HIDDEN, -1) @ d_u.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)
    d_u[:, h2:] = d_fill
    tokens = inputs.ravel()
    order = np.argsort(tokens.astype(np.uint16), kind="stable")
    ranked = tokens[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    d_table = np.add.reduceat(d_u.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order], first, axis=0)
    return float(loss), len(used), (ranked[first], d_table), [d_inner, d_classes, d_class_bias, d_words, d_word_bias], last


class Trainer:
    """Adagrad over windows."""

    def __init__(self, model: Model, rate: float = 0.1):
        self.model, self.rate = model, rate
        self.sums = [np.full_like(a, 1e-2) for a in model.arrays()]

    def update(self, n: int, table: tuple[np.ndarray, np.ndarray], rest: list[np.ndarray]) -> None:
        scale = 1.0 / np.sqrt(n)  # steps shrink less than the noise of larger windows
        rows, d = table
        d = d * scale
        self.sums[0][rows] += d * d
        self.model.table[rows] -= self.rate * d / np.sqrt(self.sums[0][rows])
        for a, s, d in zip(self.model.arrays()[1:], self.sums[1:], rest, strict=True):
            d = d * scale
            s += d * d
            a -= self.rate * d / np.sqrt(s)


def lanes_of(texts: list[np.ndarray], lanes: int) -> list[list[int]]:
    """Texts by number dealt to lanes, longest first to the shortest lane; the longest lane first."""
    import heapq

    heap = [(0, i) for i in range(min(lanes, len(texts)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        n, lane = heapq.heappop(heap)
        out[lane].append(i)
        heapq.heappush(heap, (n + len(texts[i]), lane))
    return sorted(out, key=lambda x: -sum(len(texts[i]) for i in x))


def balanced(texts: list[np.ndarray], most: int) -> int:
    """Lanes that end together: one lane holds the longest text, the others as much."""
    longest = max(map(len, texts), default=0)
    return max(8, min(most, sum(map(len, texts)) // max(1, longest)))


def windows(texts: list[np.ndarray], lanes: int, steps: int):
    """Windows over the lanes of targets: inputs, fresh, targets (-1: none) and the text of each place.

    Lanes come longest first, so those still running are always the first ones.
    """
    dealt = [lane for lane in lanes_of(texts, lanes) if sum(len(texts[i]) for i in lane)]
    if not dealt:
        return
    order = [i for lane in dealt for i in lane if len(texts[i])]
    sizes = np.array([len(texts[i]) for i in order])
    target = np.concatenate([texts[i] for i in order]).astype(np.int32)
    begin = np.zeros(len(target), bool)
    begin[np.cumsum(sizes) - sizes] = True
    given = np.concatenate([[BEGIN], target[:-1]]).astype(np.int32)
    given[begin] = BEGIN
    owner = np.repeat(np.array(order, np.int32), sizes)
    lengths = np.array([sum(len(texts[i]) for i in lane) for lane in dealt])
    starts = np.cumsum(lengths) - lengths
    step = np.arange(steps)[:, None]
    for start in range(0, int(lengths[0]), steps):
        n = int(np.searchsorted(-lengths, -start))
        here = start + step < lengths[:n]
        at = np.where(here, starts[:n] + start + step, 0)
        yield np.where(here, given[at], BEGIN), begin[at] | ~here, np.where(here, target[at], -1), owner[at]


def segments(texts: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Long texts in parts that are learnt side by side, each from a fresh state."""
    return [t[i:i + size] for t in texts for i in range(0, len(t), size)]


def train(model: Model, texts: list[np.ndarray], trainer: Trainer, lanes: int = 256, steps: int = 16, segment: int = 1024) -> tuple[float, int]:
    """One pass over the texts (arrays of targets), at most ``lanes`` at a time; returns loss and tokens."""
    loss = tokens = 0
    state = None
    texts = segments(texts, segment)
    for inputs, fresh, targets, _ in windows(texts, balanced(texts, lanes), steps):
        state = np.zeros((HIDDEN, inputs.shape[1]), model.table.dtype) if state is None else np.ascontiguousarray(state[:, :inputs.shape[1]])
        part, n, table, rest, state = gradients(model, inputs, fresh, targets, state)
        trainer.update(n, table, rest)
        loss, tokens = loss + part, tokens + n
    return loss, tokens


def score(model: Model, texts: list[np.ndarray], lanes: int = 512, steps: int = 16, together: int = 1 << 16) -> np.ndarray:
    """Natural log of each text's probability, RARE targets by their class.

    The output layer takes about ``together`` tokens at a time.
    """
    out = np.zeros(len(texts))
    state = None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        states, targets, text = (np.concatenate(x) for x in zip(*held, strict=True))
        out[:] += np.bincount(text, log_probs(model, states, targets).astype(np.float64), len(texts))
        held.clear()

    for inputs, fresh, targets, text in windows(texts, balanced(texts, lanes), steps):
        state = np.zeros((HIDDEN, inputs.shape[1]), model.table.dtype) if state is None else np.ascontiguousarray(state[:, :inputs.shape[1]])
        states, state, _ = run_states(model, inputs, fresh, state)
        used = np.flatnonzero(targets.ravel() >= 0)
        held.append((_rows(states)[used], targets.ravel()[used], text.ravel()[used]))
        if sum(len(x[1]) for x in held) >= together:
            flush()
    if held:
        flush()
    return out
