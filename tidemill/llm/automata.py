"""Weighted acyclic automata over words: count transducers.

An arc has a word, a weight and a target.  A sequence's weight is that of its
last arc; 0 says that it is only a beginning of others.  Automata are built
incrementally from sorted sequences: as soon as the next sequence leaves a
state, the state is final, and shared with an equal one met before (so equal
endings with equal weights are stored once).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np

Phrase = tuple[bytes, ...]


class Automaton:
    """arcs[state] holds {word: (weight, target)} in order of words; the start is the last state."""

    def __init__(self, arcs: list[dict[bytes, tuple[int, int]]]):
        self.arcs = arcs

    @classmethod
    def build(cls, items: Iterable[tuple[Phrase, int]]) -> Automaton:
        """From (phrase, weight > 0), phrases in ascending order, each once and not empty."""
        arcs: list[dict] = []
        known: dict[tuple, int] = {}
        path: list[bytes] = []
        open_: list[dict] = [{}]
        weights: list[int] = []

        def freeze(state: dict) -> int:
            sign = tuple((w, *x) for w, x in state.items())
            at = known.get(sign)
            if at is None:
                at = known[sign] = len(arcs)
                arcs.append(state)
            return at

        def close(depth: int) -> None:
            while len(path) > depth:
                target = freeze(open_.pop())
                open_[-1][path.pop()] = (weights.pop(), target)

        for phrase, weight in items:
            same = 0
            while same < len(path) and same < len(phrase) and path[same] == phrase[same]:
                same += 1
            close(same)
            for word in phrase[same:]:
                path.append(word)
                weights.append(0)
                open_.append({})
            weights[-1] = weight
        close(0)
        arcs.append(open_[0])
        return cls(arcs)

    def __iter__(self) -> Iterator[tuple[Phrase, int]]:
        """(phrase, weight) in ascending order."""
        stack = [iter(self.arcs[-1].items())]
        path: list[bytes] = []
        while stack:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            word, (weight, target) = step
            path.append(word)
            if weight:
                yield tuple(path), weight
            stack.append(iter(self.arcs[target].items()))

    def compose(self, other: Automaton) -> Iterator[tuple[Phrase, int, int]]:
        """(phrase, weight here, weight there) of what both accept: both are walked at once."""
        stack: list[tuple[int, int, Phrase]] = [(len(self.arcs) - 1, len(other.arcs) - 1, ())]
        while stack:
            a, b, path = stack.pop()
            here, there = self.arcs[a], other.arcs[b]
            for word in here if len(here) < len(there) else there:
                if word in here and word in there:
                    (wa, ta), (wb, tb) = here[word], there[word]
                    phrase = (*path, word)
                    if wa and wb:
                        yield phrase, wa, wb
                    if self.arcs[ta] and other.arcs[tb]:
                        stack.append((ta, tb, phrase))

    def pack(self) -> bytes:
        """Words once each, then arcs as whole numbers, compressed."""
        words = sorted({w for state in self.arcs for w in state})
        number = {w: i for i, w in enumerate(words)}
        flat = [(number[w], weight, target) for state in self.arcs for w, (weight, target) in state.items()]
        arcs = np.array(flat, np.int64).reshape(-1, 3).T.tobytes()
        head = np.array([len(words), len(flat), len(self.arcs)], np.int64).tobytes()
        sizes = np.array([len(s) for s in self.arcs], np.int32).tobytes()
        lengths = np.array([len(w) for w in words], np.int32).tobytes()
        return zlib.compress(head + sizes + lengths + arcs + b"".join(words), 1)

    @classmethod
    def unpack(cls, data: bytes) -> Automaton:
        raw = zlib.decompress(data)
        n_words, n_arcs, n_states = np.frombuffer(raw, np.int64, 3).tolist()
        at = 24
        sizes = np.frombuffer(raw, np.int32, n_states, at).tolist()
        at += 4 * n_states
        lengths = np.frombuffer(raw, np.int32, n_words, at)
        at += 4 * n_words
        label, weight, target = np.frombuffer(raw, np.int64, 3 * n_arcs, at).reshape(3, -1).tolist()
        at += 24 * n_arcs
        ends = (np.cumsum(lengths) + at).tolist()
        words = [raw[e - n : e] for e, n in zip(ends, lengths.tolist())]
        arcs, a = [], 0
        for n in sizes:
            arcs.append({words[label[i]]: (weight[i], target[i]) for i in range(a, a + n)})
            a += n
        return cls(arcs)


def union(automata: Iterable[Automaton], least: int = 1) -> Automaton:
    """Weights of equal phrases added up; phrases of at least `least`."""
    total: dict[Phrase, int] = {}
    for a in automata:
        for phrase, weight in a:
            total[phrase] = total.get(phrase, 0) + weight
    return Automaton.build(sorted((p, w) for p, w in total.items() if w >= least))
