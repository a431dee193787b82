"""Small weighted transducers: states, arcs, composition, heaviest path.

A machine reads one label per token and writes one.  An arc adds its weight;
the weight of a path is the sum over its arcs, of several paths with the same
reading the heaviest counts (the max-plus semiring), and a path counts only if
it ends in a final state.  Composition feeds the labels that one machine
writes to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Machine:
    """``arcs(state, label)`` yields ``(written label, weight, next state)``; no arc ends the path."""

    start: Hashable
    arcs: Callable[[Hashable, str], Iterable[tuple[str, float, Hashable]]]
    final: Callable[[Hashable], bool]


def table(start, rows: dict, final: set) -> Machine:
    """A machine from explicit rows ``(state, label) -> [(written, weight, next)]``; ``*`` stands for every other label, written as read."""

    def arcs(state, label):
        found = rows.get((state, label))
        if found is None:
            found = [(label if out == "*" else out, w, to) for out, w, to in rows.get((state, "*"), ())]
        return found

    return Machine(start, arcs, final.__contains__)


def behind(triggers: str, subjects: Iterable[str], mark: str, reach: int) -> Machine:
    """Marks subjects within ``reach`` tokens after a trigger.  States count the tokens that are left."""
    rows = {}
    for s in range(reach + 1):
        rest = max(0, s - 1)
        rows[s, "*"] = [("*", 0.0, rest)]
        for x in subjects:
            rows[s, x] = [(x + mark if s else x, 0.0, rest)]
        for t in triggers:
            rows[s, t] = [(t, 0.0, reach)]
    return table(0, rows, set(range(reach + 1)))


def ahead(triggers: str, subjects: Iterable[str], mark: str, reach: int) -> Machine:
    """Marks subjects that a trigger follows within ``reach`` tokens: a marking path dies without one."""
    rows = {(0, "*"): [("*", 0.0, 0)]}
    for x in subjects:
        rows[0, x] = [(x, 0.0, 0), (x + mark, 0.0, reach)]
    for s in range(1, reach + 1):
        rows[s, "*"] = [("*", 0.0, s - 1)] if s > 1 else []
        for t in triggers:
            rows[s, t] = [(t, 0.0, 0)]
    return table(0, rows, {0})


def between(toggle: str, subjects: Iterable[str], mark: str, inside: bool = False) -> Machine:
    """Marks subjects between two toggles; ``inside`` starts within."""
    rows = {}
    for s in (0, 1):
        rows[s, "*"] = [("*", 0.0, s)]
        rows[s, toggle] = [(toggle, 0.0, 1 - s)]
        for x in subjects:
            rows[s, x] = [(x + mark if s else x, 0.0, s)]
    return table(int(inside), rows, {0, 1})


def weigh(weights: Callable[[str], float]) -> Machine:
    """Adds a weight per label."""
    return Machine(0, lambda _s, label: [(label, weights(label), 0)], lambda _s: True)


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that writes what ``second`` makes of what ``first`` writes."""

    def arcs(state, label):
        a, b = state
        return [(z, v + w, (x, y)) for out, v, x in first.arcs(a, label) for z, w, y in second.arcs(b, out)]

    return Machine((first.start, second.start), arcs, lambda s: first.final(s[0]) and second.final(s[1]))


class Decoder:
    """Heaviest paths through one machine; its states are numbered and its arcs remembered as they are met."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.number: dict = {machine.start: 0}
        self.states = [machine.start]
        self.known: dict[tuple[int, str], tuple] = {}

    def arcs(self, state: int, label: str) -> tuple:
        found = self.known.get((state, label))
        if found is None:
            out = []
            for written, w, to in self.machine.arcs(self.states[state], label):
                if to not in self.number:
                    self.number[to] = len(self.states)
                    self.states.append(to)
                out.append((written, w, self.number[to]))
            found = self.known[state, label] = tuple(out)
        return found

    def best(self, labels: list[str], scales: list[float]) -> tuple[float, list[tuple[int, str]]] | None:
        """Weight of the heaviest path and the labels it changes, by place; arc weights are scaled per token.

        Of equally heavy paths the first in the order of arcs counts; None if no path ends.
        """
        live = {0: (0.0, ())}
        for at, (label, scale) in enumerate(zip(labels, scales)):
            after: dict = {}
            for state, (total, trail) in live.items():
                for written, w, to in self.arcs(state, label):
                    value = total + w * scale
                    if to not in after or value > after[to][0]:
                        after[to] = (value, (trail, at, written) if w else trail)
            live = after
        ends = [v for s, v in live.items() if self.machine.final(self.states[s])]
        if not ends:
            return None
        total, trail = max(ends, key=lambda v: v[0])
        out = []
        while trail:
            trail, at, written = trail
            out.append((at, written))
        return total, out[::-1]
