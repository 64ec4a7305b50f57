"""A gated recurrent language model in numpy, with class-factored output softmax.

Documents run in parallel lanes, one after the other in each lane; the state starts at zero
for each document and is carried over window borders. P(word) = P(class | state) x
P(word | class, state). Words beyond the vocabulary share the last class, within which they
are told apart by corpus counts, outside this module.
"""

from __future__ import annotations

import heapq

import numpy as np

END = 0


class Network:
    """Parameters by name; numbers 0 to ``vocabulary`` - 1 are words (0 ends a text), ``vocabulary`` is any other word."""

    NAMES = ("embed", "enter", "gate_bias", "again", "class_out", "class_bias", "word_out", "word_bias")

    def __init__(self, vocabulary: int, classes: int, hidden: int):
        self.vocabulary, self.classes, self.hidden = vocabulary, classes, hidden
        self.width = -(-vocabulary // classes)

    def shapes(self) -> list[tuple[int, ...]]:
        h, c, k = self.hidden, self.classes, self.width
        return [(self.vocabulary + 1, h), (h, 3 * h), (3 * h,), (h, 3 * h), (h, c + 1), (c + 1,), (c, h, k), (c, k)]

    def start(self, counts: np.ndarray, seed: int = 5) -> Network:
        """Random weights; the biases give the frequencies of ``counts`` (by number, others last)."""
        draw = np.random.default_rng(seed)
        scale = {"embed": 0.5, "enter": 0.3, "again": 0.3, "class_out": 0.1, "word_out": 0.1}
        for name, shape in zip(self.NAMES, self.shapes(), strict=True):
            setattr(self, name, (draw.normal(size=shape) * scale.get(name, 0)).astype(np.float32))
        full = np.full(self.classes * self.width, -30.0)
        full[: self.vocabulary] = np.log(counts[:-1] + 0.5)
        full = full.reshape(self.classes, self.width)
        mass = np.append(np.log(np.exp(full).sum(axis=1) + 1e-9), np.log(counts[-1] + 0.5))
        self.class_bias = (mass - mass.max()).astype(np.float32)
        self.word_bias = (full - full.max(axis=1, keepdims=True)).astype(np.float32)
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def cut(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of ``flat`` by name."""
        at, out = 0, {}
        for name, shape in zip(self.NAMES, self.shapes(), strict=True):
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def views(self, flat: np.ndarray) -> None:
        """Parameters are views of ``flat`` from now on."""
        for name, part in self.cut(flat).items():
            setattr(self, name, part)

    def load(self, flat: np.ndarray) -> Network:
        self.views(np.array(flat, np.float32))
        return self


def lanes(lengths: np.ndarray, count: int) -> list[list[int]]:
    """Texts dealt to at most ``count`` lanes, longest first to the emptiest; lanes come longest first."""
    heap = [(0, i) for i in range(min(count, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    total = np.zeros(len(heap), np.int64)
    for text in np.argsort(-lengths, kind="stable").tolist():
        load, lane = heapq.heappop(heap)
        out[lane].append(text)
        total[lane] = load + lengths[text]
        heapq.heappush(heap, (int(total[lane]), lane))
    return [out[i] for i in np.argsort(-total, kind="stable")]


def laid_out(texts: list[np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, text of each place) by step and lane, and the lanes' lengths; shorter lanes are filled with -1."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    dealt = lanes(lengths, count)
    size = np.array([int(lengths[lane].sum()) for lane in dealt], np.int64)
    numbers = np.full((int(size.max()) if len(size) else 0, len(dealt)), -1, np.int32)
    owner = np.full(numbers.shape, -1, np.int32)
    for i, lane in enumerate(dealt):
        numbers[: size[i], i] = np.concatenate([texts[t] for t in lane])
        owner[: size[i], i] = np.repeat(lane, lengths[lane])
    return numbers, owner, size


class Pass:
    """Runs a network over windows; with ``learn`` it also follows the truncated gradient after each window (Adam).

    Lanes run along the last axis of every array, so that gates and words of a class are contiguous rows; what one
    step or one part of a class needs stays in the processor's cache. Biases are a last row of weights, met by a row of ones.
    """

    #: Places of a class that are worked on at once.
    PART = 1024

    def __init__(self, network: Network, window: int = 32, learn: float = 0.0):
        self.net, self.window, self.rate = network, window, learn
        self.step = 0
        self.kept: dict = {}
        if learn:
            self.flat = network.flat()
            network.views(self.flat)
            self.gradient, self.first, self.second, self.spare = (np.zeros_like(self.flat) for _ in range(4))
            self.grads = network.cut(self.gradient)

    def _array(self, name: str, *shape: int) -> np.ndarray:
        """Memory used again in every window."""
        size = int(np.prod(shape))
        if name not in self.kept or len(self.kept[name]) < size:
            self.kept[name] = np.empty(size, np.float32)
        return self.kept[name][:size].reshape(shape)

    def run(self, numbers: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Natural log probability of every place; each is predicted from the places before it in its text."""
        steps, count = numbers.shape
        state = np.zeros((self.net.hidden, count), np.float32)
        out = np.zeros((steps, count), np.float32)
        for low in range(0, steps, self.window):
            active = int(np.searchsorted(-size, -low, side="left"))  # lanes come longest first
            high = min(low + self.window, steps)
            part = numbers[low:high, :active]
            out[low:high, :active], state = self._window(part, state[:, :active])
        return out

    def _window(self, numbers: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        net, h = self.net, self.net.hidden
        steps, count = numbers.shape
        there = numbers >= 0
        safe = np.where(there, numbers, END).astype(np.uint16)
        halved = np.repeat(np.array([0.5, 1], np.float32), (2 * h, h))[:, None]  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        embedded = net.embed[safe.ravel()].reshape(steps, count, h)
        entered = np.matmul(net.enter.T * halved, embedded.transpose(0, 2, 1), out=self._array("entered", steps, 3 * h, count))
        entered += net.gate_bias[:, None] * halved
        back_again = net.again.T * halved
        before = self._array("before", steps + 1, h + 1, count)
        before[:, h] = 1
        before[0, :h] = state
        again = self._array("again", steps, 3 * h, count)
        gates = self._array("gates", steps, 2 * h, count)
        new = self._array("new", steps, h, count)
        ended = safe == END
        keep = [(~e).astype(np.float32) if e.any() else None for e in ended]
        for t in range(steps):
            np.matmul(back_again, before[t, :h], out=again[t])
            g, n, ahead = gates[t], new[t], before[t + 1, :h]
            np.add(entered[t, : 2 * h], again[t, : 2 * h], out=g)
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            np.multiply(g[h:], again[t, 2 * h :], out=n)
            n += entered[t, 2 * h :]
            np.tanh(n, out=n)
            np.subtract(before[t, :h], n, out=ahead)
            ahead *= g[:h]
            ahead += n
            if keep[t] is not None:
                ahead *= keep[t]
        if self.rate:
            self.gradient[:] = 0
        # One order by number: runs of a class for the output, runs of a word for the embedding.
        order = np.argsort(safe.ravel(), kind="stable")
        back = self._array("back", steps, h, count)
        logs = self._classes(before, safe, there, back)
        self._words(before, safe, there, order, back, logs)
        if self.rate:
            self._learn(safe.ravel(), order, embedded, before, gates, new, again, keep, back, max(1, int(there.sum())))
        return np.where(there, logs, 0), before[steps, :h].copy()

    def _classes(self, before: np.ndarray, target: np.ndarray, there: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Log probability of the class of every place; ``back`` takes the gradient at the states."""
        net = self.net
        steps, count = target.shape
        group = np.where(target == net.vocabulary, net.classes, target // net.width)
        weights = np.vstack([net.class_out, net.class_bias]).T.copy()
        own, total, lanes_ = np.empty((steps, count), np.float32), np.empty((steps, count), np.float32), np.arange(count)
        e = self._array("classes", net.classes + 1, count)
        grad = np.zeros((net.hidden + 1, net.classes + 1), np.float32)
        for t in range(steps):
            np.matmul(weights, before[t], out=e)
            np.exp(e, out=e)
            own[t] = e[group[t], lanes_]
            np.sum(e, axis=0, out=total[t])
            if self.rate:
                weight = there[t].astype(np.float32)
                e *= weight / total[t]
                e[group[t], lanes_] -= weight
                np.matmul(net.class_out, e, out=back[t])
                grad += before[t] @ e.T
        if self.rate:
            self.grads["class_out"][...], self.grads["class_bias"][...] = grad[:-1], grad[-1]
        return np.log(own) - np.log(total)

    def _words(self, before: np.ndarray, target: np.ndarray, there: np.ndarray, order: np.ndarray, back: np.ndarray, logs: np.ndarray) -> None:
        """Adds the log probability of every word within its class, and the gradient at the states."""
        net, h, width = self.net, self.net.hidden, self.net.width
        steps, count = target.shape
        number = target.ravel()[order]
        order = order[: np.searchsorted(number, net.vocabulary)]
        number = number[: len(order)].astype(np.int64)
        cuts = np.searchsorted(number, np.arange(net.classes + 1) * width)
        rows = before[:steps].transpose(0, 2, 1).reshape(-1, h + 1)[order]
        weights = np.concatenate([net.word_out, net.word_bias[:, None]], axis=1).transpose(0, 2, 1).copy()
        inside, weight, places = number % width, there.ravel()[order].astype(np.float32), np.arange(self.PART)
        chosen, totals = np.empty(len(order), np.float32), np.empty(len(order), np.float32)
        if self.rate:
            more = self._array("more", len(order), h)
        for c in range(net.classes):
            for a in range(cuts[c], cuts[c + 1], self.PART):
                b = min(a + self.PART, cuts[c + 1])
                s, at, own, w = rows[a:b], places[: b - a], inside[a:b], weight[a:b]
                e = np.matmul(weights[c], s.T, out=self._array("words", width, b - a))
                np.exp(e, out=e)
                chosen[a:b] = e[own, at]
                np.sum(e, axis=0, out=totals[a:b])
                if self.rate:
                    e *= w / totals[a:b]
                    e[own, at] -= w
                    np.matmul(e.T, net.word_out[c].T, out=more[a:b])
                    grad = s.T @ e.T
                    self.grads["word_out"][c] += grad[:h]
                    self.grads["word_bias"][c] += grad[h]
        logs.reshape(-1)[order] += np.log(chosen) - np.log(totals)
        if self.rate:
            spread = self._array("spread", steps * count, h)
            spread[:] = 0
            spread[order] = more
            back += spread.reshape(steps, count, h).transpose(0, 2, 1)

    def _learn(self, ids, order, embedded, before, gates, new, again, keep, back, seen: int) -> None:
        net, h = self.net, self.net.hidden
        steps, _, count = back.shape
        through = self._array("through", steps, 3 * h, count)  # at the gates' inputs
        grad_again, grad_enter = np.zeros_like(net.again), np.zeros_like(net.enter)
        ahead = np.zeros((h, count), np.float32)
        left, inside, d = (self._array(name, h, count) for name in ("left", "inside", "d"))
        for t in range(steps - 1, -1, -1):
            z, r, n, s, own = gates[t, :h], gates[t, h:], new[t], before[t, :h], through[t]
            if keep[t] is None:
                d[:] = ahead
            else:
                np.multiply(ahead, keep[t], out=d)
            np.subtract(1, z, out=left)
            left *= d
            update, reset, entering = own[:h], own[h : 2 * h], own[2 * h :]
            np.subtract(s, n, out=update)
            update *= z
            update *= left
            np.multiply(n, n, out=inside)
            np.subtract(1, inside, out=inside)
            inside *= left
            np.multiply(inside, r, out=entering)
            np.subtract(1, r, out=reset)
            reset *= again[t, 2 * h :]
            reset *= entering
            grad_again += s @ own.T
            np.matmul(net.again, own, out=ahead)
            d *= z
            ahead += d
            ahead += back[t]
            entering[:] = inside
            grad_enter += embedded[t].T @ own.T
        self.grads["again"][...], self.grads["enter"][...] = grad_again, grad_enter
        self.grads["gate_bias"][...] = through.sum(axis=2).sum(axis=0)
        entering = np.matmul(through.transpose(0, 2, 1), net.enter.T).reshape(-1, h)[order]
        found = ids[order]
        starts = np.flatnonzero(np.diff(found.astype(np.int32), prepend=-1))
        self.grads["embed"][found[starts]] = np.add.reduceat(entering, starts, axis=0)
        self._adam(seen)

    def _adam(self, seen: int) -> None:
        g, spare = self.gradient, self.spare
        self.step += 1
        g /= seen
        np.subtract(g, self.first, out=spare)
        spare *= 0.1
        self.first += spare
        np.multiply(g, g, out=spare)
        spare -= self.second
        spare *= 0.01
        self.second += spare
        np.sqrt(self.second, out=spare)
        spare += 1e-7
        np.divide(self.first, spare, out=spare)
        spare *= self.rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        self.flat -= spare
