"""Weighted acyclic automata that map phrases (sequences of words) to counts.

A phrase's count is the sum of the weights along its path and at its last state. ``Builder`` takes phrases in order and
freezes a state as soon as no further phrase can reach into it: weights are pushed towards the root by what all ways on
have in common, and states with the same ways on are one. So the automaton is minimal while it grows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa

Phrase = tuple[str, ...]
#: A state's weight if phrases end there (else None), and its arcs (word, weight, state) by word.
State = tuple[int | None, tuple[tuple[str, int, int], ...]]


class Transducer:
    """States, children before parents; the last one is the root. ``base`` counts towards every phrase."""

    #: The columns of a transducer in a table.
    FIELDS = "base bigint, final array<bigint>, arcs array<int>, words array<string>, word array<int>, weight array<bigint>, target array<int>"

    def __init__(self, states: list[State], base: int = 0):
        self.states, self.base = states, base

    def columns(self, spelled: Sequence[str] | None = None) -> dict:
        """The transducer's columns; with ``spelled``, arcs bear places in that list for words."""
        words: dict = {}
        arcs = [a for _, own in self.states for a in own]
        word = [words.setdefault(a[0], len(words)) for a in arcs]
        names = list(words) if spelled is None else [spelled[w] for w in words]
        return {"base": self.base, "final": [f for f, _ in self.states], "arcs": [len(own) for _, own in self.states], "words": names, "word": word, "weight": [a[1] for a in arcs], "target": [a[2] for a in arcs]}

    @classmethod
    def of(cls, row: dict) -> Transducer:
        words, arcs, states = row["words"], zip(row["word"], row["weight"], row["target"], strict=True), []
        for final, n in zip(row["final"], row["arcs"], strict=True):
            states.append((final, tuple((words[w], c, t) for w, c, t in (next(arcs) for _ in range(n)))))
        return cls(states, row["base"])

_END: State = (0, ())


class Builder:
    """Builds a transducer from phrases in ascending order, each once."""

    def __init__(self):
        self.states: list[State] = []
        self.known: dict[State, int] = {}
        self.last: Phrase = ()
        self.open: list[list] = [[None, []]]  # along the last phrase: weight of phrases that end here, arcs so far

    def _freeze(self, down_to: int) -> None:
        states, known, last, path = self.states, self.known, self.last, self.open
        while len(path) > down_to:
            final, arcs = path.pop()
            if not arcs:  # a phrase's end that nothing goes on from: its count is all the weight there is
                state, common = _END, final
            else:
                common = min([a[1] for a in arcs] if final is None else [a[1] for a in arcs] + [final])
                state = (None if final is None else final - common, tuple([(w, c - common, t) for w, c, t in arcs]))
            number = known.get(state)
            if number is None:
                number = known[state] = len(states)
                states.append(state)
            path[-1][1].append((last[len(path) - 1], common, number))

    def add(self, phrase: Phrase, count: int) -> None:
        last, shared = self.last, 0
        for a, b in zip(phrase, last):
            if a != b:
                break
            shared += 1
        self._freeze(shared + 1)
        for _ in range(len(phrase) - shared):
            self.open.append([None, []])
        self.open[-1][0] = count
        self.last = phrase

    def finish(self) -> Transducer:
        self._freeze(1)
        final, arcs = self.open[0]
        return Transducer([*self.states, (final, tuple(arcs))])


def build(counts: Iterator[tuple[Phrase, int]]) -> Transducer:
    builder = Builder()
    for phrase, count in counts:
        builder.add(phrase, count)
    return builder.finish()


def phrases(automaton: Transducer) -> Iterator[tuple[Phrase, int]]:
    """All phrases in order, with their counts."""

    def walk(number: int, so_far: int, path: Phrase):
        final, arcs = automaton.states[number]
        if final is not None:
            yield path, so_far + final
        for word, weight, target in arcs:
            yield from walk(target, so_far + weight, (*path, word))

    return walk(len(automaton.states) - 1, automaton.base, ()) if automaton.states else iter(())


def union(automata: Sequence[Transducer], least: int = 0) -> Transducer:
    """The phrases of all automata with their counts summed, but those of fewer than ``least``: a walk over sets of states,
    which makes the union's states on its way back, weights pushed towards the root and like states as one."""
    states: list[State] = []
    known: dict[State, int] = {}

    def merged(here: list[tuple[list[State], int, int]]) -> State:
        """What the states give together; weights as they come."""
        ways: dict = {}
        total, ends = 0, False
        for own, number, so_far in here:
            final, arcs = own[number]
            if final is not None:
                total, ends = total + so_far + final, True
            for word, weight, target in arcs:
                if word in ways:
                    ways[word].append((own, target, so_far + weight))
                else:
                    ways[word] = [(own, target, so_far + weight)]
        arcs = []
        for word in sorted(ways):
            final, on = merged(ways[word])
            if final is None and not on:
                continue
            common = min([a[1] for a in on] + ([] if final is None else [final]))
            state = (None if final is None else final - common, tuple([(w, c - common, t) for w, c, t in on]))
            number = known.setdefault(state, len(states))
            if number == len(states):
                states.append(state)
            arcs.append((word, common, number))
        return (total if ends and total >= least else None), tuple(arcs)

    root = merged([(a.states, len(a.states) - 1, a.base) for a in automata if a.states])
    return Transducer([*states, root])


def compose(asked: Transducer, counts: Transducer) -> Iterator[tuple[Phrase, int]]:
    """The phrases of ``asked`` that ``counts`` has, with its counts: a walk over pairs of states."""
    arcs: dict[int, dict[str, tuple[int, int]]] = {}

    def walk(q: int, s: int, so_far: int, path: Phrase):
        final = counts.states[s][0]
        if asked.states[q][0] is not None and final is not None:
            yield path, so_far + final
        if s not in arcs:
            arcs[s] = {w: (c, t) for w, c, t in counts.states[s][1]}
        for word, _, target in asked.states[q][1]:
            if (way := arcs[s].get(word)) is not None:
                yield from walk(target, way[1], so_far + way[0], (*path, word))

    return walk(len(asked.states) - 1, len(counts.states) - 1, counts.base, ())


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()
