"""Weighted finite-state transducers over whole numbers as symbols.

Weights are of the tropical kind: those along a path add up, and of several paths the heaviest counts. Whole numbers keep
sums exact in any order. Composition is the
one way to join machines: what one writes the next reads.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass

#: What a machine may do on a symbol: the symbol it writes, the weight that it adds, and the state it goes to.
Step = tuple[int, float, Hashable]
LOST = float("-inf")


@dataclass(frozen=True)
class Transducer:
    """Arcs by state and symbol read, from a start state; weights of the states in which a sequence may end."""

    start: Hashable
    arcs: dict[Hashable, dict[int, tuple[Step, ...]]]
    final: dict[Hashable, float]

    @classmethod
    def of(cls, start: Hashable, symbols: Iterable[int], steps: Callable[[Hashable, int], Iterable[Step]], final: Callable[[Hashable], float]) -> Transducer:
        """The machine of all states that steps(state, symbol) reach from start."""
        symbols, arcs, todo = list(symbols), {}, [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = {x: made for x in symbols if (made := tuple(steps(state, x)))}
            todo += [target for made in arcs[state].values() for _, _, target in made]
        return cls(start, arcs, {s: w for s in arcs if (w := final(s)) > LOST})

    def then(self, other: Transducer) -> Transducer:
        """The composition: reads what self reads, writes what other writes of what self writes."""
        symbols = sorted({x for by in self.arcs.values() for x in by})

        def steps(state: tuple, symbol: int) -> Iterable[Step]:
            a, b = state
            for middle, w, to in self.arcs[a].get(symbol, ()):
                for out, v, other_to in other.arcs[b].get(middle, ()):
                    yield out, w + v, (to, other_to)

        final = lambda s: self.final.get(s[0], LOST) + other.final.get(s[1], LOST)
        return Transducer.of((self.start, other.start), symbols, steps, final)

    def weights(self, sequence: Iterable[int]) -> dict[tuple[int, ...], float]:
        """The weight of each sequence that can be written for one read (for tests: there may be many)."""
        ends: dict[tuple[Hashable, tuple[int, ...]], float] = {(self.start, ()): 0.0}
        for symbol in sequence:
            after: dict = {}
            for (state, out), w in ends.items():
                for x, v, to in self.arcs[state].get(symbol, ()):
                    after[to, (*out, x)] = max(after.get((to, (*out, x)), LOST), w + v)
            ends = after
        done: dict[tuple[int, ...], float] = {}
        for (state, out), w in ends.items():
            if state in self.final:
                done[out] = max(done.get(out, LOST), w + self.final[state])
        return done


class Reader:
    """Best weights of sequences: a machine made deterministic as far as sequences need it.

    A set of states with their weights, less the heaviest, is one state; memory of them is bounded.
    """

    def __init__(self, machine: Transducer, memory: int = 50_000):
        self.machine, self.memory = machine, memory
        self.number = {state: k for k, state in enumerate(machine.arcs)}
        self.arcs = [{x: [(w, self.number[to]) for _, w, to in made] for x, made in by.items()} for by in machine.arcs.values()]
        self.final = [machine.final.get(state, LOST) for state in machine.arcs]
        self.first = ((self.number[machine.start], 0.0),)
        self.known: dict[tuple, tuple[tuple, float]] = {}

    def _step(self, states: tuple, symbol: int) -> tuple[tuple, float]:
        after: dict[int, float] = {}
        for state, w in states:
            for v, to in self.arcs[state].get(symbol, ()):
                if w + v > after.get(to, LOST):
                    after[to] = w + v
        most = max(after.values(), default=LOST)
        if len(self.known) >= self.memory:
            self.known.clear()
        made = self.known[states, symbol] = (tuple(sorted((s, w - most) for s, w in after.items())), most)
        return made

    def best(self, sequence: Iterable[int]) -> float:
        """The weight of the heaviest path over sequence; LOST if there is none."""
        states, total, known = self.first, 0.0, self.known
        for symbol in sequence:
            states, gain = known.get((states, symbol)) or self._step(states, symbol)
            total += gain
        return total + max((w + self.final[s] for s, w in states), default=LOST)
