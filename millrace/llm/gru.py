"""A gated recurrent unit over word ids with a class-factored softmax, in numpy.

Texts are dealt over lanes and read side by side, one after another in a lane,
in windows of a fixed number of steps. The state is carried from window to
window and cleared where a text begins, so every text is read whole; gradients
are cut at the start of a window.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
CLASS_SIZE = 32
WINDOW = 16
LEAST_WINDOWS = 16
TRAIN_LANES = 384
SCORE_LANES = 512
SCORE_TOKENS = 16384
LEARNING_RATE = 0.02
WARM_UP = 20
# The largest logit whose exponential a float32 sum of a class still holds.
MOST_LOGIT = 80.0


@dataclass
class Lanes:
    """Texts dealt over lanes: ``tokens`` and ``starts`` by step and lane, longest lane first, and where each text lies."""

    tokens: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    places: list[tuple[int, int]]


def deal(texts: list[np.ndarray], lanes: int) -> Lanes:
    """Longest texts first, each to the lane that is shortest so far."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    heap = [(0, lane) for lane in range(max(1, min(lanes, len(texts))))]
    held: list[list[int]] = [[] for _ in heap]
    places = [(0, 0)] * len(texts)
    for i in order:
        length, lane = heapq.heappop(heap)
        places[i] = (lane, length)
        held[lane].append(i)
        heapq.heappush(heap, (length + len(texts[i]), lane))
    lengths = np.array([sum(len(texts[i]) for i in own) for own in held])
    rank = np.argsort(-lengths, kind="stable")
    new = np.empty(len(rank), np.int64)
    new[rank] = np.arange(len(rank))
    steps = int(lengths.max(initial=0))
    tokens, starts = np.zeros((steps, len(held)), np.int32), np.zeros((steps, len(held)), bool)
    for i, (lane, at) in enumerate(places):
        lane = int(new[lane])
        places[i] = (lane, at)
        tokens[at : at + len(texts[i]), lane] = texts[i]
        if len(texts[i]):
            starts[at, lane] = True
    return Lanes(tokens, starts, lengths[rank], places)


def spread(texts: list[np.ndarray], lanes: int) -> Lanes:
    """The texts as one stream cut into lanes of equal length; a text cut by an end of a lane begins anew."""
    stream = np.concatenate(texts)
    lengths = np.array([len(text) for text in texts if len(text)])
    starts = np.zeros(len(stream), bool)
    starts[np.cumsum(lengths) - lengths] = True
    steps = -(-len(stream) // lanes)
    width = -(-len(stream) // steps)
    padded = np.zeros(width * steps, np.int32), np.zeros(width * steps, bool)
    padded[0][: len(stream)], padded[1][: len(stream)] = stream, starts
    tokens, starts = (np.ascontiguousarray(part.reshape(width, steps).T) for part in padded)
    starts[0] = True
    held = np.full(width, steps)
    held[-1] = len(stream) - (width - 1) * steps
    return Lanes(tokens, starts, held, [])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log softmax of each row of ``x`` at one place, and the exponentials (in ``x``) with their sums."""
    np.minimum(x, MOST_LOGIT, out=x)
    chosen = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], x.dtype)
    return chosen - np.log(sums), x, sums


def add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each of ``rows`` to the row of ``table`` at its place: sorted by place, summed in runs, added once."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    begins = np.flatnonzero(np.diff(places, prepend=-1))
    table[places[begins]] += np.add.reduceat(rows[order], begins, axis=0)


class Model:
    """Word ids below ``vocabulary``; id 0 also stands before the first word of a text."""

    SHAPES = ("inputs", "recurrent", "gate_bias", "class_weights", "class_bias", "word_weights", "word_bias")

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, class_size: int = CLASS_SIZE):
        """Biases start at the log frequencies of ``counts``, so that the untrained model is the unigram model."""
        self.hidden, self.size = hidden, class_size
        self.classes = max(1, -(-len(counts) // class_size))
        frequency = np.zeros(self.classes * class_size)
        frequency[: len(counts)] = counts
        frequency = frequency.reshape(self.classes, class_size)
        valid = (np.arange(self.classes * class_size) < len(counts)).reshape(self.classes, class_size)
        frequency = np.where(valid, np.maximum(frequency, 0.5), 0)
        draw = np.random.default_rng(9)
        vocabulary = self.classes * class_size
        self.parameters = {
            "inputs": draw.normal(0, 0.1, (vocabulary, 3 * hidden)).astype(np.float32),
            "recurrent": draw.normal(0, 0.5 / hidden**0.5, (hidden, 3 * hidden)).astype(np.float32),
            "gate_bias": np.zeros(3 * hidden, np.float32),
            "class_weights": np.zeros((hidden, self.classes), np.float32),
            "class_bias": np.log(frequency.sum(axis=1) / frequency.sum()).astype(np.float32),
            "word_weights": np.zeros((self.classes, hidden, class_size), np.float32),
            "word_bias": np.where(valid, np.log(np.maximum(frequency, 1e-9) / frequency.sum(axis=1, keepdims=True)), -1e9).astype(np.float32),
        }

    def packed(self) -> np.ndarray:
        return np.concatenate([self.parameters[name].ravel() for name in self.SHAPES])

    def unpack(self, values: np.ndarray) -> Model:
        at = 0
        for name in self.SHAPES:
            shape = self.parameters[name].shape
            size = int(np.prod(shape))
            self.parameters[name] = np.ascontiguousarray(values[at : at + size], np.float32).reshape(shape)
            at += size
        return self

    def _gates(self) -> tuple[np.ndarray, np.ndarray]:
        """What an id and a state give to reset, update and new state: one block of rows for each, so that all lie together."""
        h = self.hidden
        inputs = self.parameters["inputs"] + self.parameters["gate_bias"]
        return tuple(
            np.ascontiguousarray(part.reshape(-1, 3, h).transpose(1, 0, 2)) for part in (inputs, self.parameters["recurrent"])
        )

    def _step(self, table: np.ndarray, recurrent: np.ndarray, state: np.ndarray, before: np.ndarray):
        """Next state from the states and the ids of the words before; also what the backward pass needs."""
        inner = np.matmul(state, recurrent)
        outer = table.take(before, axis=1)
        gates, new = outer[:2], outer[2]
        gates += inner[:2]
        _sigmoid(gates)
        reset, update = gates
        new += reset * inner[2]
        np.tanh(new, out=new)
        following = state - new
        following *= update
        following += new
        return following, reset, update, new, inner[2]

    def _window(self, lanes: Lanes, start: int, end: int, state: np.ndarray, last: np.ndarray, keep: bool):
        """Runs steps ``start`` to ``end``; lanes that have ended fall away from the right."""
        trail, states = [], []
        table, recurrent = self._gates()
        active_at = np.searchsorted(-lanes.lengths, -np.arange(start, end), "left")
        for step in range(start, end):
            active = int(active_at[step - start])
            fresh = lanes.starts[step, :active]
            state, last = state[:active], last[:active]
            if fresh.any():
                state = np.where(fresh[:, None], np.float32(0), state)
                last = np.where(fresh, 0, last)
            old = state
            state, *parts = self._step(table, recurrent, state, last)
            if keep:
                trail.append((old, last, fresh, *parts))
            states.append(state)
            last = lanes.tokens[step, :active]
        return states, state, last, trail

    def _scores(self, hidden: np.ndarray, words: np.ndarray, gradients: dict | None):
        """Log probability of each word after each state; adds to ``gradients`` and gives the states' if asked."""
        p = self.parameters
        # By class, so that a class is one run of rows; the last of a row's inputs is a one, for the bias.
        order = np.argsort((words // self.size).astype(np.int16), kind="stable")
        words = words.take(order)
        inputs = np.ones((len(words), self.hidden + 1), hidden.dtype)
        inputs[:, :-1] = hidden.take(order, axis=0)
        group, inside = words // self.size, words % self.size
        bounds = np.searchsorted(group, np.arange(self.classes + 1))
        runs = [(c, slice(bounds[c], bounds[c + 1])) for c in np.flatnonzero(np.diff(bounds))]
        logits = np.empty((len(words), self.size), hidden.dtype)
        weights = np.concatenate([p["word_weights"], p["word_bias"][:, None]], axis=1)
        for c, own in runs:
            np.matmul(inputs[own], weights[c], out=logits[own])
        found, chances, sums = _log_softmax_at(logits, inside)
        logits = inputs @ np.concatenate([p["class_weights"], p["class_bias"][None]])
        by_class, class_chances, class_sums = _log_softmax_at(logits, group)
        result = np.empty_like(found)
        result[order] = found + by_class
        if gradients is None:
            return result, None
        rows = np.arange(len(words))
        class_chances /= class_sums[:, None]
        class_chances[rows, group] -= 1
        gradient = inputs.T @ class_chances
        gradients["class_weights"] += gradient[:-1]
        gradients["class_bias"] += gradient[-1]
        back = class_chances @ p["class_weights"].T
        chances /= sums[:, None]
        chances[rows, inside] -= 1
        own_back, gradient = np.empty_like(back), np.zeros_like(weights)
        for c, own in runs:
            np.matmul(inputs[own].T, chances[own], out=gradient[c])
            np.matmul(chances[own], p["word_weights"][c].T, out=own_back[own])
        gradients["word_weights"] += gradient[:, :-1]
        gradients["word_bias"] += gradient[:, -1]
        unsorted = np.empty_like(back)
        unsorted[order] = back + own_back
        return result, unsorted

    def log_probabilities(self, texts: list[np.ndarray], lanes: int = SCORE_LANES, tokens: int = SCORE_TOKENS) -> np.ndarray:
        """Natural log probability of every text, as a whole; about ``tokens`` words a window."""
        dealt = deal(texts, lanes)
        result = np.zeros(len(texts))
        scores = np.zeros(dealt.tokens.shape, np.float32)
        width = dealt.tokens.shape[1]
        state, last = np.zeros((width, self.hidden), np.float32), np.zeros(width, np.int32)
        start = 0
        while start < len(dealt.tokens):
            active = int(np.searchsorted(-dealt.lengths, -start, "left"))
            end = min(start + max(1, tokens // active), len(dealt.tokens))
            states, state, last, _ = self._window(dealt, start, end, state, last, keep=False)
            words = np.concatenate([dealt.tokens[start + i, : len(s)] for i, s in enumerate(states)])
            found, _ = self._scores(np.concatenate(states), words, None)
            at = 0
            for i, s in enumerate(states):
                scores[start + i, : len(s)] = found[at : at + len(s)]
                at += len(s)
            start = end
        by_lane = np.ascontiguousarray(scores.T)
        for i, (lane, at) in enumerate(dealt.places):
            result[i] = by_lane[lane, at : at + len(texts[i])].sum(dtype=np.float64)
        return result


class Trainer:
    """Truncated back-propagation through time with Adam."""

    def __init__(self, model: Model, rate: float = LEARNING_RATE):
        self.model, self.rate, self.updates = model, rate, 0
        self.first = {name: np.zeros_like(value) for name, value in model.parameters.items()}
        self.second = {name: np.zeros_like(value) for name, value in model.parameters.items()}

    def read(self, texts: list[np.ndarray], lanes: int = TRAIN_LANES, window: int = WINDOW) -> int:
        """One pass over ``texts``; the number of tokens read. A short pass has fewer lanes, not fewer windows."""
        total = sum(map(len, texts))
        if not total:
            return 0
        model, dealt = self.model, spread(texts, max(1, min(lanes, total // (LEAST_WINDOWS * window))))
        width = dealt.tokens.shape[1]
        state, last = np.zeros((width, model.hidden), np.float32), np.zeros(width, np.int32)
        for start in range(0, len(dealt.tokens), window):
            end = min(start + window, len(dealt.tokens))
            states, state, last, trail = model._window(dealt, start, end, state, last, keep=True)
            words = [dealt.tokens[start + i, : len(s)] for i, s in enumerate(states)]
            gradients = {name: np.zeros_like(value) for name, value in model.parameters.items()}
            _, back = model._scores(np.concatenate(states), np.concatenate(words), gradients)
            self._backward(trail, states, back, gradients)
            self._update(gradients, sum(map(len, words)))
        return int(dealt.lengths.sum())

    def _backward(self, trail: list, states: list[np.ndarray], back: np.ndarray, gradients: dict) -> None:
        h = self.model.hidden
        _, recurrent = self.model._gates()
        onward = np.ascontiguousarray(recurrent.transpose(0, 2, 1))
        old, last, _, reset, update, new, inner = (np.concatenate(part) for part in zip(*trail, strict=True))
        # What the gradient of a state is multiplied with, for all steps at once.
        keep = 1 - update
        to_update = (old - new) * update * keep
        to_new = keep * (1 - new * new)
        to_reset = inner * reset * (1 - reset)
        # Rows of reset, update and new state, and the last of them before its reset.
        hidden = np.empty((3, len(back), h), back.dtype)
        fresh_new = np.empty_like(back)
        later = np.zeros((0, h), np.float32)
        at = len(back)
        for (_, _, fresh, *_), own in zip(reversed(trail), reversed(states), strict=True):
            here = slice(at - len(own), at)
            at -= len(own)
            grad = back[here]
            grad[: len(later)] += later
            d_new, step = fresh_new[here], hidden[:, here]
            np.multiply(grad, to_new[here], out=d_new)
            np.multiply(d_new, to_reset[here], out=step[0])
            np.multiply(grad, to_update[here], out=step[1])
            np.multiply(d_new, reset[here], out=step[2])
            later = grad * update[here]
            for gate in range(3):
                later += step[gate] @ onward[gate]
            if fresh.any():
                later[fresh] = 0
        by_gate = gradients["recurrent"].reshape(h, 3, h)
        for gate in range(3):
            by_gate[:, gate] += old.T @ hidden[gate]
        rows = np.concatenate([hidden[0], hidden[1], fresh_new], axis=1)
        gradients["gate_bias"] += np.ones(len(rows), rows.dtype) @ rows
        add_rows(gradients["inputs"], last, rows)

    def _update(self, gradients: dict, tokens: int) -> None:
        self.updates += 1
        step = self.rate * min(1, self.updates / WARM_UP) * (1 - 0.999**self.updates) ** 0.5 / (1 - 0.9**self.updates)
        for name, gradient in gradients.items():
            gradient /= max(1, tokens)
            np.clip(gradient, -1, 1, out=gradient)
            first, second = self.first[name], self.second[name]
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient * gradient - second)
            self.model.parameters[name] -= step * first / (np.sqrt(second) + 1e-8)
