"""A gated recurrent language model in numpy: class-factored softmax and truncated backpropagation.

Words of the vocabulary lie in classes of ``WIDTH`` by rank; one more class holds
all other words. A word's probability is that of its class times that of the word
in the class; within the last class the caller supplies it.

Texts run in lanes side by side, window by window, and keep their state between
windows. Learning goes back through one window only. Long texts are learned from in
segments, which begin with the state of the window before, run without gradients, so
that no lane waits for the longest text; scoring runs through whole texts.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 32
WIDTH = 64
WINDOW = 32
LANES = 256
#: Words of a segment in learning.
SEGMENT = 16 * WINDOW
RATE = 0.2
#: What the squared gradients of a parameter start from.
CALM = 1e-6
#: Bounds of the output weights and biases: exponentials of logits stay finite.
MOST, MOST_BIAS = 2.0, 20.0
#: Rows of logits at once, so that they stay in the processor's cache.
ROWS = 2048


def unsigned_gate(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) in place; the sign of a gate's weights is free."""
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


def picked(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax at one place of each row; ``logits`` is overwritten."""
    chosen = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return chosen - np.log(logits @ np.ones(logits.shape[1], np.float32))


def off_target(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Softmax of each row less 1 at the target, in place: the gradient of the loss in the logits."""
    np.exp(logits, out=logits)
    logits *= np.reciprocal(logits @ np.ones(logits.shape[1], np.float32))[:, None]
    logits[np.arange(len(at)), at] -= 1
    return logits


def summed(rows: np.ndarray, key: np.ndarray, often: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of the rows of each; the key ``often``, which has very many, by a product."""
    mask = key == often
    rest = np.flatnonzero(~mask)
    order = rest[np.argsort(key[rest], kind="stable")]
    seen, at = np.unique(key[order], return_index=True)
    sums = np.add.reduceat(rows[order], at) if len(order) else np.empty((0, rows.shape[1]), rows.dtype)
    if len(rest) == len(key):
        return seen, sums
    return np.append(seen, often), np.concatenate([sums, (mask.astype(rows.dtype) @ rows)[None, :]])


class Gru:
    """Parameters by name. ``size`` words have ids 0..size-1; ``size`` is any other word, ``size + 1`` the start.

    The last row of the output weights is the bias; states have a last column of ones.
    """

    NAMES = ("inputs", "step", "classes", "words")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.size = len(params["inputs"]) - 2
        self.n_classes = len(params["words"])

    @classmethod
    def start(cls, counts: np.ndarray, other: float, seed: int = 1) -> Gru:
        """Small random weights; the biases make it the unigram model of the counts (by rank) and the mass of other words."""
        rng = np.random.default_rng(seed)
        n = -(-max(len(counts), 1) // WIDTH)
        padded = np.zeros(n * WIDTH)
        padded[: len(counts)] = counts
        by = padded.reshape(n, WIDTH)
        mass = np.append(by.sum(axis=1), other) + 0.1
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        share = by / np.maximum(by.sum(axis=1, keepdims=True), 1e-9)
        bias = np.where(by > 0, np.log(np.maximum(share, 1e-12)), -30.0)
        classes, words = normal(0.01, HIDDEN + 1, n + 1), normal(0.01, n, HIDDEN + 1, WIDTH)
        classes[HIDDEN] = np.log(mass / mass.sum())
        words[:, HIDDEN] = bias
        return cls({"inputs": normal(0.1, len(counts) + 2, 3 * HIDDEN), "step": normal(0.1, HIDDEN, 3 * HIDDEN), "classes": classes, "words": words})

    def advance(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The next state of every lane from the inputs of its word, with the gates, the candidate and what the reset gate lets through."""
        g = h @ self.p["step"]
        gates = unsigned_gate(g[:, : 2 * HIDDEN] + x[:, : 2 * HIDDEN])
        through = g[:, 2 * HIDDEN :]
        new = through * gates[:, :HIDDEN]
        new += x[:, 2 * HIDDEN :]
        np.tanh(new, out=new)
        h = h - new
        h *= gates[:, HIDDEN:]
        h += new
        return h, gates, new, through

    def classed(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each target, the targets in order of class, and the bounds of the classes but the last."""
        cls = np.minimum(target // WIDTH, self.n_classes)
        cls[target >= self.size] = self.n_classes
        cls = cls.astype(np.uint16 if self.n_classes >= 256 else np.uint8)
        order = np.argsort(cls, kind="stable")
        return cls, order, np.searchsorted(cls[order], np.arange(self.n_classes + 1))

    def log_probs(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target word; of its class only if that is the last."""
        cls, order, bounds = self.classed(target)
        out = np.empty(len(target), np.float32)
        for a in range(0, len(target), ROWS):
            part = slice(a, a + ROWS)
            out[part] = picked(states[part] @ self.p["classes"], cls[part])
        inside = states[order[: bounds[-1]]]
        place = target[order[: bounds[-1]]] % WIDTH
        found = np.empty(len(inside), np.float32)
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[k], bounds[k + 1])
            found[own] = picked(inside[own] @ self.p["words"][k], place[own])
        out[order[: bounds[-1]]] += found
        return out

    def score(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log-probability of each text ``ids[bounds[i]:bounds[i + 1]]``, whole; the longest texts begin."""
        n = len(bounds) - 1
        sizes = np.diff(bounds)
        queue = np.argsort(-sizes, kind="stable").tolist()
        queue = [i for i in queue if sizes[i]][::-1]
        total = np.zeros(n)
        lanes = min(LANES, len(queue))
        text = np.array([queue.pop() for _ in range(lanes)], np.int64)
        at = np.zeros(lanes, np.int64)
        h = np.zeros((lanes, HIDDEN), np.float32)
        while len(text):
            begin, left = bounds[text] + at, sizes[text] - at
            steps = int(min(WINDOW, left.max()))
            place = begin[None, :] + np.arange(steps)[:, None]
            good = np.arange(steps)[:, None] < left[None, :]
            np.minimum(place, len(ids) - 1, out=place)
            target = ids[place]
            word = np.empty_like(target)
            word[1:] = target[:-1]
            word[0] = np.where(at == 0, self.size + 1, ids[begin - 1])
            x = np.take(self.p["inputs"], word.reshape(-1), axis=0).reshape(steps, len(text), -1)
            states = np.ones((steps, len(text), HIDDEN + 1), np.float32)
            for t in range(steps):
                h = states[t, :, :HIDDEN] = self.advance(h, x[t])[0]
            if good.all():
                logs, owner = self.log_probs(states.reshape(-1, HIDDEN + 1), target.reshape(-1)), np.tile(text, steps)
            else:
                logs, owner = self.log_probs(states[good], target[good]), np.broadcast_to(text, good.shape)[good]
            total += np.bincount(owner, logs, n)
            at += steps
            done = np.flatnonzero(at >= sizes[text])
            fresh = done[: len(queue)]
            for k in fresh.tolist():
                text[k], at[k], h[k] = queue.pop(), 0, 0
            gone = done[len(fresh) :]
            if len(gone):
                text, at, h = np.delete(text, gone), np.delete(at, gone), np.delete(h, gone, axis=0)
        return total

    def learn(self, ids: np.ndarray, bounds: np.ndarray, memory: dict[str, np.ndarray], seed: int = 0) -> int:
        """Steps on every window of all texts, segments of about equal length side by side; how many words were learned from."""
        sizes = np.diff(bounds)
        per = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), per)
        begin = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT
        stop = np.minimum(begin + SEGMENT, bounds[text + 1])
        order = np.argsort(begin - stop, kind="stable")
        groups = np.arange(0, len(order), LANES)
        for g in np.random.default_rng(seed).permutation(groups).tolist():
            own = order[g : g + LANES]
            self._learn_lanes(ids, begin[own], stop[own], bounds[text[own]], memory)
        return int(sizes.sum())

    def _learn_lanes(self, ids: np.ndarray, begin: np.ndarray, stop: np.ndarray, first: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        """``begin`` and ``stop`` of segments, longest first, of texts that begin at ``first``."""
        h = np.zeros((len(begin), HIDDEN), np.float32)
        later = begin > first
        if later.any():
            for t in range(-WINDOW, 0):
                place = begin[later] + t
                word = np.where(place > first[later], ids[place - 1], self.size + 1)
                h[later] = self.advance(h[later], self.p["inputs"][word])[0]
        for a in range(0, int((stop - begin).max()), WINDOW):
            n = int((begin + a < stop).sum())
            h = self._learn_window(ids, begin[:n] + a, stop[:n], first[:n], h[:n], memory)

    def _learn_window(self, ids: np.ndarray, begin: np.ndarray, stop: np.ndarray, first: np.ndarray, h: np.ndarray, memory: dict[str, np.ndarray]) -> np.ndarray:
        p, n = self.p, len(begin)
        steps = int(min(WINDOW, (stop - begin).max()))
        place = begin[None, :] + np.arange(steps)[:, None]
        good = place < stop[None, :]
        np.minimum(place, len(ids) - 1, out=place)
        target = ids[place]
        word = np.empty_like(target)
        word[1:] = target[:-1]
        word[0] = np.where(begin > first, ids[begin - 1], self.size + 1)
        words = word.reshape(-1)
        x = np.take(p["inputs"], words, axis=0).reshape(steps, n, -1)
        states = np.ones((steps, n, HIDDEN + 1), np.float32)
        before = np.empty((steps, n, HIDDEN), np.float32)
        gates = np.empty((steps, n, 2 * HIDDEN), np.float32)
        new, through = np.empty_like(before), np.empty_like(before)
        for t in range(steps):
            before[t] = h
            h, gates[t], new[t], through[t] = self.advance(h, x[t])
            states[t, :, :HIDDEN] = h
        full = bool(good.all())
        flat = states.reshape(-1, HIDDEN + 1) if full else states[good]
        want = target.reshape(-1) if full else target[good]
        scale = np.float32(1 / max(len(want), 1))
        d = self._output_step(flat, want, scale, memory)
        if full:
            back = d.reshape(steps, n, HIDDEN)
        else:
            back = np.zeros((steps, n, HIDDEN), np.float32)
            back[good] = d
        r, z = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
        # What does not depend on the gradient from later steps, for the whole window at once.
        to_new = (1 - z) * (1 - new * new)
        to_z = (new - before) * z * (1 - z)
        to_r = through * r * (r - 1)
        moved = np.empty((steps, n, 3 * HIDDEN), np.float32)
        turned = np.empty((steps, n, 3 * HIDDEN), np.float32)
        back_step = np.ascontiguousarray(p["step"].T)
        carry = np.float32(0)
        for t in range(steps - 1, -1, -1):
            dh = back[t] + carry
            d_new = np.multiply(dh, to_new[t], out=moved[t, :, 2 * HIDDEN :])
            np.multiply(dh, to_z[t], out=moved[t, :, HIDDEN : 2 * HIDDEN])
            np.multiply(d_new, to_r[t], out=moved[t, :, :HIDDEN])
            turned[t] = moved[t]
            turned[t, :, 2 * HIDDEN :] *= r[t]
            carry = turned[t] @ back_step
            dh *= z[t]
            carry += dh
        self._move("step", ..., (before.reshape(-1, HIDDEN).T @ turned.reshape(-1, 3 * HIDDEN)) * scale, memory)
        seen, sums = summed(moved.reshape(-1, 3 * HIDDEN), words, self.size)
        sums *= scale
        self._move("inputs", seen, sums, memory)
        return h

    def _output_step(self, states: np.ndarray, target: np.ndarray, scale: np.float32, memory: dict[str, np.ndarray]) -> np.ndarray:
        """Moves the output layer and returns the gradients of the states."""
        p = self.p
        cls, order, bounds = self.classed(target)
        d = np.empty((len(target), HIDDEN), np.float32)
        back = np.ascontiguousarray(p["classes"][:HIDDEN].T)
        grad = np.zeros_like(p["classes"])
        for a in range(0, len(target), ROWS):
            part = slice(a, a + ROWS)
            e = off_target(states[part] @ p["classes"], cls[part])
            np.matmul(e, back, out=d[part])
            grad += states[part].T @ e
        self._move("classes", ..., grad * scale, memory)
        inside, place = states[order[: bounds[-1]]], target[order[: bounds[-1]]] % WIDTH
        d_inside = np.empty((len(inside), HIDDEN), np.float32)
        there = np.flatnonzero(np.diff(bounds))
        grads = np.empty((len(there), HIDDEN + 1, WIDTH), np.float32)
        for i, k in enumerate(there.tolist()):
            own = slice(bounds[k], bounds[k + 1])
            e = off_target(inside[own] @ p["words"][k], place[own])
            np.matmul(e, p["words"][k, :HIDDEN].T, out=d_inside[own])
            np.matmul(inside[own].T, e, out=grads[i])
        grads *= scale
        self._move("words", slice(None) if len(there) == self.n_classes else there, grads, memory)
        d[order[: bounds[-1]]] += d_inside
        return d

    def _move(self, name: str, at, g: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        """An AdaGrad step of the parameters ``name[at]``."""
        np.clip(g, -1, 1, out=g)
        m = memory[name][at] + g * g
        memory[name][at] = m
        g *= np.float32(RATE)
        g /= np.sqrt(m, out=m)
        new = self.p[name][at] - g
        if name in ("classes", "words"):
            weights, bias = new[..., :HIDDEN, :], new[..., HIDDEN:, :]
            np.clip(weights, -MOST, MOST, out=weights)
            np.minimum(bias, MOST_BIAS, out=bias)
        self.p[name][at] = new

    def memory(self) -> dict[str, np.ndarray]:
        return {k: np.full_like(v, CALM) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in self.NAMES])

    def with_flat(self, values: np.ndarray) -> Gru:
        out, at = {}, 0
        for k in self.NAMES:
            out[k] = values[at : at + self.p[k].size].astype(np.float32).reshape(self.p[k].shape)
            at += self.p[k].size
        return Gru(out)
