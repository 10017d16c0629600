"""Regular expressions over bytes as one deterministic automaton: parser, subset construction, minimisation, transition arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

# A parsed rule is a tuple: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None).


class Parser:
    """Literals, \\xHH and \\. escapes, [classes], (groups), |, ?, *, + and {m}, {m,}, {m,n}. ASCII only; any_case as in (?i)."""

    def __init__(self, pattern: str, any_case: bool = False):
        self.text, self.at, self.any_case = pattern, 0, any_case

    def parse(self):
        tree = self.alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in {self.text!r}")
        return tree

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, part):
        while self.peek() and self.peek() in "?*+{":
            sign = self.text[self.at]
            if sign == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at + 1 : end].partition(",")
                part = ("rep", part, int(low), int(high) if high else None if comma else int(low))
                self.at = end + 1
            else:
                part = ("rep", part, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[sign])
                self.at += 1
        return part

    def atom(self):
        sign = self.peek()
        if sign == "(":
            self.at += 1
            inner = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"a group is open in {self.text!r}")
            self.at += 1
            return inner
        if sign == "[":
            return ("set", self.charset())
        return ("set", self.cased({self.char()}))

    def char(self) -> int:
        sign = self.text[self.at]
        self.at += 1
        if sign != "\\":
            return ord(sign)
        sign = self.text[self.at]
        self.at += 1
        if sign == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(sign)

    def charset(self) -> frozenset[int]:
        self.at += 1
        found: set[int] = set()
        while self.peek() != "]":
            low = high = self.char()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self.char()
            found.update(range(low, high + 1))
        self.at += 1
        return self.cased(found)

    def cased(self, found) -> frozenset[int]:
        both = {ord(x) for b in found for x in (chr(b).lower(), chr(b).upper())} if self.any_case else set()
        return frozenset(found | both)


def reverse(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if kind == "rep" else tree


def shortest(tree):
    """The rule without an open end: what it needs to match for the first time. Each match of the rule starts with one of these."""
    kind = tree[0]
    if kind == "cat" and tree[1]:
        return ("cat", [*tree[1][:-1], shortest(tree[1][-1])])
    if kind == "alt":
        return ("alt", [shortest(x) for x in tree[1]])
    if kind == "rep" and tree[2]:
        return ("rep", tree[1], tree[2], tree[2])
    return tree


@dataclass
class _Nfa:
    free: list[list[int]] = field(default_factory=list)
    step: list[tuple[frozenset[int], int] | None] = field(default_factory=list)

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Lay the rule out from start; its end state."""
        kind = tree[0]
        if kind == "set":
            at, end = self.state(), self.state()
            self.free[start].append(at)
            self.step[at] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "alt":
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end


@dataclass
class Dfa:
    """table[state + byte_class[b]] is the next state; states are multiples of `classes`. States from first_accepting on accept."""

    byte_class: bytes
    classes: int
    table: list[int]
    first_accepting: int
    start: int
    accepts: dict[int, tuple[int, ...]]
    dead: int


def compile_rules(trees: list, anywhere: bool) -> Dfa:
    """One minimal automaton for all rules; anywhere: a match may start at each byte. accepts: state -> numbers of the rules."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        ends[nfa.add(tree, root)] = k
    # Bytes that no rule tells apart are one class.
    marks = [tuple(b in s[0] for s in nfa.step if s) for b in range(256)]
    numbers: dict[tuple, int] = {}
    byte_class = bytes(numbers.setdefault(m, len(numbers)) for m in marks)
    sample = [byte_class.index(c) for c in range(len(numbers))]

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    first = closure([root])
    index, rows, todo = {first: 0}, [], [first]
    while todo:
        states = todo.pop(0)
        row = []
        for b in sample:
            to = {nfa.step[s][1] for s in states if nfa.step[s] and b in nfa.step[s][0]}
            to = closure(to | {root}) if anywhere else closure(to)
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row.append(index[to])
        rows.append(row)
    verdict = [tuple(sorted(ends[s] for s in states if s in ends)) for states in index]
    return _minimal(rows, verdict, byte_class, len(numbers))


def _minimal(rows, verdict, byte_class, classes) -> Dfa:
    """Moore's refinement: states stay together while their verdicts, and the groups they lead to, are the same."""
    names: dict = {}
    group = [names.setdefault(v, len(names)) for v in verdict]
    while True:
        names = {}
        finer = [names.setdefault((group[s], *(group[t] for t in row)), len(names)) for s, row in enumerate(rows)]
        if len(names) == len(set(group)):
            break
        group = finer
    member = {}
    for s, g in enumerate(group):
        member.setdefault(g, s)
    order = sorted(member, key=lambda g: (bool(verdict[member[g]]), member[g]))
    place = {g: k * classes for k, g in enumerate(order)}
    table = [place[group[t]] for g in order for t in rows[member[g]]]
    accepting = [place[g] for g in order if verdict[member[g]]]
    dead = next((place[g] for g in order if not verdict[member[g]] and all(group[t] == g for t in rows[member[g]])), -1)
    return Dfa(byte_class, classes, table, min(accepting, default=len(table)), place[group[0]], {place[g]: verdict[member[g]] for g in order if verdict[member[g]]}, dead)
