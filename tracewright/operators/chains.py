"""Risk chains within functions: outside values that reach the size of an allocation by arithmetic.

A statement has fn, line, seq (the order within a line), kind and what its kind needs:

- ``parameter``: target is a name that the function is given.
- ``assign``: target takes names (an array) by operations (an array; empty: none); sources are the ids of calls in it that
  read outside values; allocation is the id of an allocating call in it, or null; narrow: whether target's type has a fixed
  width or wraps.
- ``allocate``: a call for an allocation whose result no assignment takes; names are those of its arguments.
- ``guard``: names of a condition whose branch leaves; strong: it compares with a limit or divides.
- ``copy``: names of the destination; sources has the call's id; bound: names of the condition of the loop around it.

Assignments are folded in order. The state of a name is what reaches it: source ids, lines, names and transforms, united
over the names that the assignment takes, with its own transform if it has operations. A later assignment replaces the
state, unless nothing known reaches it. Each allocation whose state has a transform begins one chain; one that no assignment
takes uses the states after the last assignment.

Score: 55, and 20 if a transform is narrow, otherwise 5; 15 for copies into the allocation from its line on; 5 if such a
copy's loop is bounded by a name of the state; less 5 for a guard of such names before it, less 50 for a strong one.
Defined cases: null arrays are empty, a null target is never assigned, a repeated row counts again, other kinds are ignored.
"""

from __future__ import annotations

from itertools import chain
from typing import NamedTuple

from pyspark.sql import DataFrame

from tracewright.operators.folds import ordered_fold

STATEMENT = ["fn", "line", "seq", "kind", "target", "names", "operations", "sources", "allocation", "narrow", "strong", "bound"]
RESULT = "allocation string, line long, sources array<string>, source_lines array<long>, names array<string>, transforms array<string>, guard string, guard_lines array<long>, copies array<string>, score long, confidence string"


class Reach(NamedTuple):
    """What reaches a name. Transforms are (line, target, operations, narrow), each once, in the order of their uniting."""

    sources: frozenset
    lines: frozenset
    names: frozenset
    transforms: tuple

    @staticmethod
    def of(parts: list[Reach]) -> Reach:
        sources, lines, names, transforms = zip(*parts, strict=True) if parts else ((), (), (), ())
        return Reach(frozenset().union(*sources), frozenset().union(*lines), frozenset().union(*names), tuple(dict.fromkeys(chain.from_iterable(transforms))))


class Function:
    """One function's states, guards, copies and allocations so far."""

    def __init__(self):
        self.states: dict[str, Reach] = {}
        self.guards: list[tuple[int, frozenset, bool]] = []
        self.copies: list[tuple[int, frozenset, str, frozenset]] = []
        self.found: list[tuple[str, int, str | None, Reach]] = []  # allocation, line, target, what reaches it
        self.loose: list[tuple[str, int, list[str]]] = []

    def step(self, row: dict) -> list[tuple]:
        names, sources, line = sorted(set(row["names"] or [])), row["sources"] or [], row["line"]
        if row["kind"] == "parameter":
            self.states[row["target"]] = Reach(frozenset(), frozenset([line]), frozenset([row["target"]]), ())
        elif row["kind"] == "assign" and row["target"] is not None:
            self._assign(row, names, sources)
        elif row["kind"] == "allocate" and row["allocation"] is not None:
            self.loose.append((row["allocation"], line, names))
        elif row["kind"] == "guard":
            self.guards.append((line, frozenset(names), bool(row["strong"])))
        elif row["kind"] == "copy" and sources:
            self.copies.append((line, frozenset(names), sources[0], frozenset(row["bound"] or [])))
        return []

    def _assign(self, row: dict, names: list[str], sources: list[str]) -> None:
        parts = [self.states[n] for n in names if n in self.states]
        if not parts and not sources:
            return
        target, operations = row["target"], sorted(set(row["operations"] or []))
        own = ((row["line"], target, " ".join(operations), bool(row["narrow"])),) if operations else ()
        read = [row["line"]] if sources else []
        state = Reach.of([*parts, Reach(frozenset(sources), frozenset(read), frozenset([target]), own)])
        self.states[target] = state
        if row["allocation"] is not None and state.transforms:
            self.found.append((row["allocation"], row["line"], target, state))

    def end(self) -> list[tuple]:
        for allocation, line, names in self.loose:
            state = Reach.of([self.states[n] for n in names if n in self.states])
            if state.transforms:
                self.found.append((allocation, line, None, state))
        return [self._chain(*x) for x in self.found]

    def _chain(self, allocation: str, line: int, target: str | None, state: Reach) -> tuple:
        copies = [(c, bool(bound & state.names)) for at, names, c, bound in self.copies if at >= line and target in names]
        weak = {at for at, names, _ in self.guards if at < line and names & state.names}
        strong = {at for at, names, s in self.guards if at < line and names & state.names and s}
        guard, lines = ("dominates", strong) if strong else ("partial", weak) if weak else ("absent", set())
        narrow = any(t[3] for t in state.transforms)
        score = 55 + (20 if narrow else 5) + (15 if copies else 0) + (5 if any(b for _, b in copies) else 0) - {"dominates": 50, "partial": 5, "absent": 0}[guard]
        confidence = "high" if narrow and copies and not strong else "medium" if narrow or copies else "low"
        steps = [f"{at}:{name}:{ops}{':narrow' if n else ''}" for at, name, ops, n in state.transforms]
        return (allocation, line, sorted(state.sources), sorted(state.lines), sorted(state.names), steps, guard, sorted(lines), sorted({c for c, _ in copies}), max(0, min(100, score)), confidence)


def risk_chains(statements: DataFrame) -> DataFrame:
    """fn and a row of RESULT for each chain."""
    return ordered_fold(statements.select(*STATEMENT), ["fn"], ["line", "seq"], Function, RESULT, unread=["seq"])
