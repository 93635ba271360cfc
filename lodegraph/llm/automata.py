"""Regexes compiled to byte automata: parsing, subset construction, minimisation, transition arrays.

The dialect: literals, escapes (\\xHH, \\. and the like), classes, groups, |, ?, +, *, {m}, {m,}, {m,n}.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Parsed forms: ("set", frozenset of bytes), ("cat", [..]), ("or", [..]), ("rep", form, least, most or None)
Form = tuple


def parse(pattern: bytes, fold: bool = False) -> Form:
    """fold: ASCII letters outside classes in either case."""
    at = 0

    def peek() -> int:
        return pattern[at] if at < len(pattern) else -1

    def escaped() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == ord("x"):
            at += 2
            return int(pattern[at - 2 : at], 16)
        return {ord("n"): 10, ord("t"): 9, ord("r"): 13}.get(c, c)

    def either() -> Form:
        nonlocal at
        forms = [sequence()]
        while peek() == ord("|"):
            at += 1
            forms.append(sequence())
        return forms[0] if len(forms) == 1 else ("or", forms)

    def sequence() -> Form:
        forms = []
        while at < len(pattern) and peek() not in b"|)":
            forms.append(repeated())
        return ("cat", forms)

    def repeated() -> Form:
        nonlocal at
        form = atom()
        while at < len(pattern) and peek() in b"?+*{":
            c = peek()
            at += 1
            if c == ord("{"):
                end = pattern.index(b"}", at)
                low, comma, high = pattern[at:end].partition(b",")
                at = end + 1
                form = ("rep", form, int(low), int(high) if high else None if comma else int(low))
            else:
                form = ("rep", form, int(c == ord("+")), 1 if c == ord("?") else None)
        return form

    def atom() -> Form:
        nonlocal at
        c = peek()
        at += 1
        if c == ord("("):
            form = either()
            at += 1
            return form
        if c == ord("["):
            return ("set", char_class())
        if c == ord("."):
            return ("set", frozenset(range(256)) - {10})
        if c == ord("\\"):
            c = escaped()
        found = {c}
        if fold and chr(c).isalpha():
            found = {ord(chr(c).lower()), ord(chr(c).upper())}
        return ("set", frozenset(found))

    def char_class() -> frozenset[int]:
        nonlocal at
        negated = peek() == ord("^")
        at += negated
        found: set[int] = set()
        first = True
        while first or peek() != ord("]"):
            first = False
            c = peek()
            at += 1
            if c == ord("\\"):
                c = escaped()
            if peek() == ord("-") and pattern[at + 1] != ord("]"):
                at += 1
                d = peek()
                at += 1
                if d == ord("\\"):
                    d = escaped()
                found.update(range(c, d + 1))
            else:
                found.add(c)
        at += 1
        return frozenset(range(256)) - found if negated else frozenset(found)

    return either()


class Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, form: Form, start: int) -> int:
        """Lays the form out from start; gives the state where it ends."""
        kind = form[0]
        if kind == "set":
            mid, end = self.state(), self.state()
            self.free[start].append(mid)
            self.step[mid] = (form[1], end)
            return end
        if kind == "cat":
            for x in form[1]:
                start = self.add(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in form[1]:
                branch = self.state()
                self.free[start].append(branch)
                self.free[self.add(x, branch)].append(end)
            return end
        _, inner, least, most = form
        for _ in range(least):
            start = self.add(inner, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            self.free[loop].append(end)
        else:
            self.free[start].append(end)
            for _ in range(most - least):
                start = self.add(inner, start)
                self.free[start].append(end)
        return end


class Dfa:
    """table: transitions as a flat list, 256 a state, of target * 256; states from `accepting` on accept, masks[state - accepting] saying which rules."""

    def __init__(self, forms: Iterable[Form], search: bool, max_states: int = 60_000):
        nfa = Nfa()
        start = nfa.state()
        ends: dict[int, int] = {}
        for k, form in enumerate(forms):
            branch = nfa.state()
            nfa.free[start].append(branch)
            ends[nfa.add(form, branch)] = 1 << k
        self._subsets(nfa, start, ends, search, max_states)
        self._minimise()

    def _subsets(self, nfa: Nfa, start: int, ends: dict[int, int], search: bool, max_states: int) -> None:
        sets = {s[0] for s in nfa.step if s}
        signature: dict[tuple[bool, ...], list[int]] = {}
        for b in range(256):
            signature.setdefault(tuple(b in s for s in sets), []).append(b)
        self.classes = list(signature.values())
        first = [c[0] for c in self.classes]
        closures: dict[int, frozenset[int]] = {}

        def closure(s: int) -> frozenset[int]:
            if s not in closures:
                seen, todo = {s}, [s]
                while todo:
                    for t in nfa.free[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                closures[s] = frozenset(x for x in seen if nfa.step[x] or x in ends)
            return closures[s]

        begin = closure(start)
        known = {begin: 0}
        todo = [begin]
        self.rows: list[list[int]] = []
        self.masks: list[int] = []
        while todo:
            following = []
            for current in todo:
                self.masks.append(sum({ends[s] for s in current if s in ends}))
                row = []
                for b in first:
                    got = set(begin) if search else set()
                    for s in current:
                        step = nfa.step[s]
                        if step and b in step[0]:
                            got |= closure(step[1])
                    target = frozenset(got)
                    if target not in known:
                        if len(known) >= max_states:
                            raise ValueError(f"the rules need more than {max_states} states together")
                        known[target] = len(known)
                        following.append(target)
                    row.append(known[target])
                self.rows.append(row)
            todo = following

    def _minimise(self) -> None:
        """Moore's refinement: states part while their masks or the parts that they lead to differ."""
        part = {m: k for k, m in enumerate(sorted(set(self.masks)))}
        own = [part[m] for m in self.masks]
        count = len(part)
        while True:
            seen: dict[tuple, int] = {}
            new = [seen.setdefault((own[s], *(own[t] for t in row)), len(seen)) for s, row in enumerate(self.rows)]
            own = new
            if len(seen) == count:
                break
            count = len(seen)
        masks, rows = [0] * count, [[0] * len(self.classes) for _ in range(count)]
        for s, row in enumerate(self.rows):
            masks[own[s]] = self.masks[s]
            rows[own[s]] = [own[t] for t in row]
        order = sorted(range(count), key=lambda s: (masks[s] != 0, s != own[0]))
        place = {s: k for k, s in enumerate(order)}
        self.start = place[own[0]] * 256
        self.accepting = sum(m == 0 for m in masks) * 256
        self.masks = [masks[s] for s in order if masks[s]]
        self.table = [0] * (count * 256)
        for s, k in place.items():
            for c, t in zip(self.classes, rows[s], strict=True):
                for b in c:
                    self.table[k * 256 + b] = place[t] * 256
        self.states = count
        del self.rows, self.classes

    def dead(self) -> int | None:
        """The state that only leads to itself and doesn't accept."""
        for s in range(0, self.accepting, 256):
            if self.table[s : s + 256] == [s] * 256:
                return s
        return None

    def hits(self, data: bytes) -> int:
        """Mask of the rules with a match that ends somewhere in data; one pass, a table access a byte."""
        table, accepting, state, found = self.table, self.accepting, self.start, 0
        for b in data:
            state = table[state + b]
            if state >= accepting:
                found |= self.masks[(state - accepting) >> 8]
        return found

    def longest(self, data: bytes, at: int, dead: int | None) -> int:
        """End of the longest match that starts at `at`, or -1."""
        table, accepting, state, end = self.table, self.accepting, self.start, -1
        for i in range(at, len(data)):
            state = table[state + data[i]]
            if state >= accepting:
                end = i + 1
            elif state == dead:
                break
        return end
