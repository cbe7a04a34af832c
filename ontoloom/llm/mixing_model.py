"""Bit predictors of hashed contexts, combined by gated logistic mixing and refined by an adaptive table."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

STEPS = 33  # of the refinement over the mixed logit, -8 to 8
BATCH = 1 << 15
TOKENS = 32  # decisions of a document between two steps of `online`
LETTER_BITS = 64  # the same for the bits of spelled words
GROUP_BITS = 1 << 19  # bits of spelled words that are held at a time


class Bits(NamedTuple):
    """Binary decisions: a slot of each context's table, the kind of decision, the bit, and whose it is."""

    slots: list[np.ndarray]
    kind: np.ndarray
    bit: np.ndarray
    owner: np.ndarray


class Shape(NamedTuple):
    sizes: tuple[int, ...]  # slots of each context's table
    kinds: int
    sure: tuple[int, int]  # the contexts whose counts choose the weights

    @property
    def gates(self) -> int:
        return self.kinds * 16


def scattered(node: np.ndarray) -> np.ndarray:
    return node.astype(np.uint32) * np.uint32(0x9E3779B1)


def hashed(context: np.ndarray, node: np.ndarray, size: int) -> np.ndarray:
    """Slot of a context and a node, the latter `scattered`."""
    h = context ^ node
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(33 - int(size).bit_length())
    return h.view(np.int32)


def tally(sizes, bits: Bits) -> list[np.ndarray]:
    """Counts of zeros and ones by slot, for each context."""
    return [np.bincount(2 * s + bits.bit, minlength=2 * n).astype(np.float32) for s, n in zip(bits.slots, sizes)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


def _confidence(n: np.ndarray) -> np.ndarray:
    return (n >= 1).astype(np.int32) + (n >= 4) + (n >= 32)


class Mixer:
    """Weights by gate, learned online, and the refinement's counts. A word's own entry leaves the counts before they predict it."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.weights = np.full((shape.gates, len(shape.sizes)), 1.0 / len(shape.sizes) + 0.1)
        self.squares = np.full_like(self.weights, 1e-2)
        self.seen = np.zeros(shape.gates)
        self.refined = np.zeros((shape.kinds * STEPS, 2))
        self.of, self.cases = None, []

    def looked_up(self, counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Logit and confidence of every slot, in three cases: all entries count, an own zero or an own one is left out."""
        if self.of is not counts:
            self.of, self.cases = counts, []
            for t in counts:
                n0, n1 = (np.stack([np.maximum(t[b::2] - own, 0) for own in (0, 1 - b, b)], 1).ravel() for b in (0, 1))
                self.cases.append((np.log((n1 + np.float32(0.3)) / (n0 + np.float32(0.3))).astype(np.float32), _confidence(n0 + n1).astype(np.uint8)))
        return self.cases

    def inputs(self, counts: list[np.ndarray], bits: Bits, at: slice, own: np.ndarray):
        """Logit of each context's predictor and the gate; `own` says of each owner whether its entry is in the counts."""
        cases, (a, b) = self.looked_up(counts), self.shape.sure
        case = np.where(own[bits.owner[at]], bits.bit[at] + 1, 0).astype(np.int32)
        slots = [3 * s[at] + case for s in bits.slots]
        logits = [x.take(s) for (x, _), s in zip(cases, slots)]
        return logits, bits.kind[at] * 16 + 4 * cases[a][1].take(slots[a]) + cases[b][1].take(slots[b])

    def mixed(self, logits: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gate), np.float32)
        for c, x in enumerate(logits):
            out += self.weights[:, c].astype(np.float32).take(gate) * x
        return out

    def learn(self, counts: list[np.ndarray], bits: Bits) -> None:
        """One online pass over the decisions of words that the counts hold, in small batches."""
        own = np.ones(int(bits.owner[-1]) + 1 if len(bits.owner) else 0, bool)
        for i in range(0, len(bits.bit), BATCH):
            at = slice(i, i + BATCH)
            logits, gate = self.inputs(counts, bits, at, own)
            z = self.mixed(logits, gate)
            miss = (bits.bit[at] - sigmoid(z)).astype(np.float32)
            n = np.bincount(gate, minlength=self.shape.gates)
            for c, x in enumerate(logits):
                g = np.bincount(gate, miss * x, self.shape.gates) / np.maximum(n, 64)
                self.squares[:, c] += g * g
                self.weights[:, c] += 0.05 * g / np.sqrt(self.squares[:, c])
            self.seen += n
            self.refined += np.bincount(2 * self.step(z, bits.kind[at]) + bits.bit[at], minlength=self.refined.size).reshape(-1, 2)

    @staticmethod
    def step(z: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return kind * STEPS + np.rint((np.clip(z, -8, 8) + 8) * 2).astype(np.int32)

    def cost(self, counts: list[np.ndarray], bits: Bits, own: np.ndarray) -> np.ndarray:
        """log10 probability of each owner's bits."""
        out = np.zeros(len(own))
        seen = self.refined.sum(1)
        fine, often = (self.refined[:, 1] + 0.5) / (seen + 1), seen > 200
        for i in range(0, len(bits.bit), 1 << 17):
            at = slice(i, i + (1 << 17))
            logits, gate = self.inputs(counts, bits, at, own)
            z = self.mixed(logits, gate)
            p, steps = sigmoid(z), self.step(z, bits.kind[at])
            p = np.where(often[steps], 0.5 * p + 0.5 * fine[steps], p)
            p = np.clip(p, 1e-6, 1 - 1e-6)
            out += np.bincount(bits.owner[at], np.log10(np.where(bits.bit[at] == 1, p, 1 - p)), len(own))
        return out

    def begun(self, n_docs: int, prior: float = 200.0) -> tuple[np.ndarray, np.ndarray]:
        """Weights and refinement for `online` of texts that start from what this mixer has learned."""
        seen = self.refined.sum(1)
        middle = np.tile(sigmoid((np.arange(STEPS) - STEPS // 2) / 2), self.shape.kinds)
        p = np.where(seen > 200, (self.refined[:, 1] + 0.5) / (seen + 1), middle)
        return np.tile(self.weights.astype(np.float32), (n_docs, 1)), np.tile(np.stack([prior * (1 - p), prior * p], 1), (n_docs, 1))

    def state(self) -> np.ndarray:
        return np.concatenate([(self.weights * self.seen[:, None]).ravel(), self.seen, self.refined.ravel()])

    @classmethod
    def average(cls, shape: Shape, total: np.ndarray) -> Mixer:
        """The mixer whose weights are the mean of many, each counting by the decisions it saw."""
        out = cls(shape)
        a, b = shape.gates * len(shape.sizes), shape.gates
        out.seen = total[a : a + b]
        used = out.seen > 0
        out.weights[used] = (total[:a].reshape(b, -1) / np.maximum(out.seen, 1)[:, None])[used]
        out.refined = total[a + b :].reshape(-1, 2)
        return out


def online(x: np.ndarray, gate: np.ndarray, gates: int, kind: np.ndarray, bit: np.ndarray, doc: np.ndarray, n_docs: int, rate: float = 0.02, prior: float = 20.0, state: tuple[np.ndarray, np.ndarray] | None = None, tokens: int = TOKENS) -> np.ndarray:
    """log10 probability of each document's decisions. Every document starts from the same weights and learns its own, `tokens`
    decisions at a time; all documents step together. x has a logit for each decision and context; a document's decisions lie in order.
    `state` is what the documents start from, equal for all (`Mixer.begun`), or what one document has learned so far; it goes on learning."""
    k, kinds = x.shape[1], int(kind.max()) + 1 if len(kind) else 1
    size = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    size = size[order]
    if state is None:
        middle = sigmoid((np.arange(STEPS) - STEPS // 2) / 2)
        state = np.full((n_docs * gates, k), 1.25 / k, np.float32), np.tile(np.stack([prior * (1 - middle), prior * middle], 1), (n_docs * kinds, 1))
    weights, fine = state
    kinds = len(fine) // (STEPS * n_docs) if n_docs else kinds
    seen = fine.reshape(-1)
    fresh, first = np.arange(tokens), kind.astype(np.int64) * STEPS
    chance = np.ones(len(bit))  # of what each decision came to
    steps = np.arange(0, int(size[0]) if n_docs else 0, tokens)
    # documents with more than t decisions come first
    for t, live in zip(steps.tolist(), np.searchsorted(-size, -steps).tolist()):
        if live == 1:  # one document's decisions lie together
            at, rank = slice(int(start[0]) + t, int(start[0]) + min(t + tokens, int(size[0]))), 0
        else:
            place = t + fresh
            at, rank = (start[:live, None] + place).ravel(), np.repeat(np.arange(live), tokens)
            if size[live - 1] < t + tokens:  # a document ends in this step
                inside = (place < size[:live, None]).ravel()
                at, rank = at[inside], rank[inside]
        g, b = gate[at] + rank * gates, bit[at]
        xs = x[at] if live == 1 else x.take(at, 0)  # taking whole rows costs an eighth of indexing them
        z = np.einsum("ij,ij->i", weights.take(g, 0), xs)
        p = 1 / (1 + np.exp(-np.minimum(np.maximum(z, -20), 20)))
        step = 2 * (first[at] + rank * (kinds * STEPS) + np.rint((np.minimum(np.maximum(z, -8), 8) + 8) * 2).astype(np.int64))
        ones = seen[step + 1]
        q = np.minimum(np.maximum(0.5 * p + 0.5 * ones / (seen[step] + ones), 1e-6), 1 - 1e-6)
        chance[at] = np.abs(1 - b - q)
        miss, own = rate * (b - p), live * gates
        for c in range(k):
            weights[:own, c] += np.bincount(g, miss * xs[:, c], own)
        seen[: 2 * live * kinds * STEPS] += np.bincount(step + b, minlength=2 * live * kinds * STEPS)
    return np.bincount(doc, np.log10(chance), n_docs)
