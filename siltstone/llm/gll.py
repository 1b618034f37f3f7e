"""Generalised LL recognition with a graph-structured stack.

Grammars are written in a small notation (see ``Grammar``).  Brackets are matched before parsing:
the contents of a pair are recognised by themselves, once for every nonterminal that may stand in
such a pair, and the pair then counts as one token that carries the set of those nonterminals.
That is exact, as every production pairs its brackets, and turns deep texts into short sequences
over a finite alphabet, whose recognition is remembered.
"""

from __future__ import annotations

import re

_SYMBOL = re.compile(r"'[^']*'|[()|?*+]|[\w:]+|\S")


class Grammar:
    """Productions of one dialect.

    ``Name = alternatives`` on one line each; ``'x'`` is a terminal, ``P:X``, ``B:X``, ``S:X`` and
    ``I:X`` stand for a pair of parentheses, braces, square brackets or an indented block with the
    contents X; ``( | ? * +)`` have their usual meanings.  Names without a production are terminals.
    ``Name ~ sep Element`` declares a list that is split at ``sep`` before its elements are
    recognised (``~,`` commas with an optional trailing one, ``~!`` commas without, ``~0`` commas
    with empty places, ``~;`` statements, ended by ``;`` or NL).
    """

    def __init__(self, text: str):
        self.rules: dict[str, list[tuple]] = {}
        self.lists: dict[str, tuple[str, str]] = {}
        lines = [re.sub(r"\s+", " ", x).strip() for x in re.sub(r"\n[ \t]+", " ", text.strip("\n")).split("\n")]
        self.names = {m[1] for x in lines if (m := re.match(r"(\w+) [=~]", x))}
        for line in lines:
            if not line or line.startswith("#"):
                continue
            name, kind, rest = re.match(r"(\w+) ([=~]\S?)(?: (.*))?$", line).groups("")
            if kind[0] == "~":
                self.lists[name] = (kind[1:], rest.strip())
            else:
                self._define(name, _SYMBOL.findall(rest))
        self._compile()

    def _define(self, name: str, tokens: list[str]) -> None:
        at = 0

        def alternatives() -> list[tuple]:
            nonlocal at
            out, now = [], []
            while at < len(tokens) and tokens[at] != ")":
                t = tokens[at]
                at += 1
                if t == "|":
                    out.append(tuple(now))
                    now = []
                    continue
                if t == "(":
                    inner = alternatives()
                    at += 1
                    item = self._helper(inner)
                else:
                    item = t
                while at < len(tokens) and tokens[at] in "?*+" and len(tokens[at]) == 1:
                    mark = tokens[at]
                    at += 1
                    if mark == "?":
                        item = self._helper([(item,), ()])
                    elif mark == "*":
                        item = ("*", item)
                    else:
                        now.append(item)
                        item = ("*", item)
                now.append(item)
            out.append(tuple(now))
            return out

        self.rules.setdefault(name, []).extend(alternatives())

    def _helper(self, alternatives: list[tuple]) -> str:
        name = f"_{len(self.rules)}"
        self.rules[name] = alternatives
        return name

    def _compile(self) -> None:
        """Flat slots, nullable symbols and first sets."""
        pairs = {"P": "(", "B": "{", "S": "[", "I": "I"}
        self.inside: dict[str, list[str]] = {b: [] for b in pairs.values()}

        def symbol(s):
            if s.__class__ is tuple:
                return ("*", symbol(s[1]))
            if s in self.rules:
                return s
            if s[0] == "'":
                return ("t", s[1:-1])
            if s[1:2] == ":":
                b = pairs[s[0]]
                if s[2:] not in self.inside[b]:
                    self.inside[b].append(s[2:])
                return ("g", b, s[2:])
            return ("t", s)

        rules = {n: [tuple(map(symbol, a)) for a in alts] for n, alts in self.rules.items()}
        for kind, element in self.lists.values():
            assert element in rules, element
        nullable: set[str] = set()
        first: dict[str, set] = {n: set() for n in rules}
        changed = True
        while changed:
            changed = False
            for n, alts in rules.items():
                for a in alts:
                    got, empty = self._first(a, first, nullable)
                    if not got <= first[n]:
                        first[n] |= got
                        changed = True
                    if empty and n not in nullable:
                        nullable.add(n)
                        changed = True
        self.slots: list = []
        self.starts: dict[str, list[tuple[int, frozenset | None]]] = {}
        for n, alts in rules.items():
            self.starts[n] = []
            for a in alts:
                got, empty = self._first(a, first, nullable)
                self.starts[n].append((len(self.slots), None if empty else frozenset(got)))
                for x in a:
                    if x[0] == "*":  # a loop within the production: past it, or once more through it
                        at = len(self.slots)
                        self.slots += [("f", at + 3), x[1], ("j", at)]
                    else:
                        self.slots.append(x)
                self.slots.append(None)
        self.memo: dict[tuple, int] = {}
        self.classes: dict[tuple, int] = {}
        self.groups: list[tuple[str, frozenset]] = []
        self.known: dict[tuple, int] = {}

    @staticmethod
    def _first(symbols, first, nullable) -> tuple[set, bool]:
        out: set = set()
        for s in symbols:
            if s[0] == "*":
                out |= first[s[1]] if s[1].__class__ is str else {s[1][1]}
            elif isinstance(s, str):
                out |= first[s]
                if s not in nullable:
                    return out, False
            else:
                out.add(s[1])
                return out, False
        return out, True

    def recognise(self, name: str, tokens: tuple) -> int:
        """2: the nonterminal derives the sequence; 1: it may derive one that begins with it; 0: neither.

        Tokens are terminals, or numbers of groups.
        """
        n = len(tokens)
        reached = not n
        slots, starts, groups = self.slots, self.starts, self.groups
        look = [t if t.__class__ is str else groups[t][0] for t in tokens]
        look.append("")
        stack: dict[tuple, tuple[list, set]] = {}  # (nonterminal, position) -> (returns, ends)
        seen: set = set()
        work: list = []

        def call(child: str, pos: int, back) -> None:
            key = (child, pos)
            node = stack.get(key)
            if node is None:
                node = stack[key] = ([back], set())
                la = look[pos]
                for slot, need in starts[child]:
                    if need is None or la in need:
                        work.append((slot, key, pos))
            elif back not in node[0]:
                node[0].append(back)
                for end in node[1]:
                    if back is None:
                        continue
                    d = (back[0], back[1], end)
                    if d not in seen:
                        seen.add(d)
                        work.append(d)

        call(name, 0, None)
        goal = stack[(name, 0)][1]
        while work:
            slot, key, pos = work.pop()
            while True:
                s = slots[slot]
                if s is None:
                    returns, ends = stack[key]
                    if pos not in ends:
                        ends.add(pos)
                        if goal is ends and pos == n:
                            return 2
                        for back in returns:
                            if back is not None:
                                d = (back[0], back[1], pos)
                                if d not in seen:
                                    seen.add(d)
                                    work.append(d)
                    break
                if s.__class__ is str:
                    call(s, pos, (slot + 1, key))
                    break
                kind = s[0]
                if kind == "f":
                    d = (~slot, key, pos)  # once from each position
                    if d in seen:
                        break
                    seen.add(d)
                    work.append((s[1], key, pos))
                    slot += 1
                    continue
                if kind == "j":
                    slot = s[1]
                    continue
                if look[pos] != s[1]:
                    break
                if kind == "g" and s[2] not in groups[tokens[pos]][1]:
                    break
                pos += 1
                slot += 1
                if pos == n:
                    reached = True
        return 2 if n in goal else 1 if reached else 0

    def derives(self, name: str, tokens: tuple) -> bool:
        """Does the nonterminal derive the whole sequence?  Lists are split into their elements."""
        if name == "Tree":
            return True  # any tokens with paired brackets
        form = self.lists.get(name)
        if form is not None:
            return self._list(form[0], form[1], tokens)
        return self._state(name, tokens) == 2

    def _state(self, name: str, tokens: tuple) -> int:
        """``recognise``, remembered."""
        key = (name, tokens)
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
            found = self.memo[key] = self.recognise(name, tokens)
        return found

    def _list(self, kind: str, element: str, tokens: tuple) -> bool:
        if kind == ";":
            return self._statements(element, tokens)
        if not tokens:
            return True
        if "NL" in tokens or (";" in tokens):
            return False
        parts, now = [], []
        for t in tokens:
            if t == ",":
                parts.append(tuple(now))
                now = []
            else:
                now.append(t)
        if now or kind == "!":
            parts.append(tuple(now))
        loose = "<" in tokens or "lambda" in tokens  # an element may hold commas of its own
        at = 0
        while at < len(parts):
            part = parts[at]
            at += 1
            if (kind == "0" and not part) or (part and self.derives(element, part)):
                continue
            while loose and at < len(parts):
                part = (*part, ",", *parts[at])
                at += 1
                if self.derives(element, part):
                    break
            else:
                return False
        return True

    #: Tokens that continue a statement after what could be its end.
    joins = frozenset(["else", "catch", "finally", "elif", "except"])

    def _statements(self, element: str, tokens: tuple) -> bool:
        """Statements are taken one by one, the shortest that parse."""
        n = len(tokens)
        ends = [
            i + 1
            for i, t in enumerate(tokens)
            if (t in (";", "NL") or (t.__class__ is int and self.groups[t][0] == "I"))
            and not (i + 1 < n and tokens[i + 1] in self.joins)
        ]
        if not ends or ends[-1] != n:
            ends.append(n)
        at, k = 0, 0
        while k < len(ends):
            for to in range(k, len(ends)):
                state = self._state(element, tokens[at : ends[to]])
                if state == 2:
                    at, k = ends[to], to + 1
                    break
                if state == 0:
                    return False  # nothing that follows can mend it
            else:
                return False
        return True

    def group(self, bracket: str, tokens: tuple) -> int:
        """The number of the pair of brackets with these contents: which nonterminals they are."""
        key = (bracket, tokens)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            names = frozenset(x for x in self.inside[bracket] if self.derives(x, tokens))
            found = self.classes.get((bracket, names))
            if found is None:
                found = self.classes[(bracket, names)] = len(self.groups)
                self.groups.append((bracket, names))
            self.known[key] = found
        return found
