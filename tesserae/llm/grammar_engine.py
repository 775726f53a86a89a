"""Table-driven parsing of any grammar without left recursion: EBNF text -> NFA -> DFA -> prediction table.

A grammar is written as ``name: alternatives`` rules with quoted terminals, upper-case token
classes, ``( )`` groups, ``[ ]`` options and the postfix operators ``*`` and ``+``. Every rule
becomes one minimal deterministic automaton (subset construction left-factors common prefixes), the
automata are numbered in one space, and for each (state, terminal) every chain of pushes that
consumes the terminal is computed once. A parse holds the set of all stacks the tokens so far allow,
so that a cast, a bracketed expression and a lambda head are followed side by side until the tokens
decide; an LL(1) grammar never holds more than one stack.
"""

from __future__ import annotations

import re

_META = re.compile(r"\s*('(?:[^'\\]|\\.)+'|[A-Za-z_][\w]*|[()\[\]|*+:])")


class _Rule:
    def __init__(self, name: str):
        self.name, self.arcs, self.eps = name, [], []

    def node(self) -> int:
        self.arcs.append([])
        self.eps.append([])
        return len(self.arcs) - 1


def _read(text: str) -> dict[str, tuple[_Rule, int, int]]:
    rules = {}
    for block in re.split(r"\n(?=[a-z_]\w*:)", text.strip()):
        name, _, body = block.partition(":")
        rule, toks = _Rule(name.strip()), [m[1] for m in _META.finditer(body)]
        at = 0

        def alt():
            nonlocal at
            a, z = rule.node(), rule.node()
            while True:
                s, e = seq()
                rule.eps[a].append(s)
                rule.eps[e].append(z)
                if at < len(toks) and toks[at] == "|":
                    at += 1
                    continue
                return a, z

        def seq():
            a = z = rule.node()
            while at < len(toks) and toks[at] not in "|)]":
                s, e = item()
                rule.eps[z].append(s)
                z = e
            return a, z

        def item():
            nonlocal at
            t = toks[at]
            at += 1
            if t in "([":
                s, e = alt()
                at += 1
                if t == "[":
                    rule.eps[s].append(e)
            else:
                s, e = rule.node(), rule.node()
                rule.arcs[s].append((t[1:-1].replace("\\", "") if t[0] == "'" else f"<{t}>" if t.islower() else t, e))
            if at < len(toks) and toks[at] in "*+":
                rule.eps[e].append(s)
                if toks[at] == "*":
                    n = rule.node()
                    rule.eps[n].append(s)
                    rule.eps[e].append(n)
                    s = e = n
                at += 1
            return s, e

        s, e = alt()
        if at != len(toks):
            raise ValueError(f"rule {name}: unread {toks[at:at + 5]}")
        rules[f"<{rule.name}>"] = (rule, s, e)
    return rules


def _minimal(arcs: list[tuple[dict[str, int], bool]]) -> list[tuple[dict[str, int], bool]]:
    """The automaton with equivalent states merged; state 0 stays the start."""
    part = [int(final) for _, final in arcs]
    while True:
        keys = [(part[i], final, tuple(sorted((label, part[to]) for label, to in row.items()))) for i, (row, final) in enumerate(arcs)]
        number: dict[tuple, int] = {}
        new = [number.setdefault(k, len(number)) for k in keys]
        if len(number) == len(set(part)):
            break
        part = new
    first: dict[int, int] = {}
    for i, c in enumerate(new):
        first.setdefault(c, i)
    return [({label: new[to] for label, to in arcs[i][0].items()}, arcs[i][1]) for c, i in sorted(first.items())]


class Grammar:
    """Prediction table of one language. ``table[state]`` maps a terminal to the chains of states that may
    replace the top of the stack; ``final`` holds the states in which a rule may end. A ``soft`` word is
    accepted wherever the class ``ID`` is."""

    #: Memo entries kept; only speed depends on it, an evicted line is parsed again.
    MEMO_ENTRIES = 100_000

    def __init__(self, text: str, start: str, soft: tuple[str, ...] = ()):
        rules, dfas = _read(text), {}
        for name, (rule, s, e) in rules.items():
            def close(states, rule=rule):
                todo, seen = list(states), set(states)
                while todo:
                    for n in rule.eps[todo.pop()]:
                        if n not in seen:
                            seen.add(n)
                            todo.append(n)
                return frozenset(seen)

            first = close({s})
            names, order, arcs = {first: 0}, [first], []
            for cur in order:
                moves: dict[str, set[int]] = {}
                for n in sorted(cur):
                    for label, to in rule.arcs[n]:
                        moves.setdefault(label, set()).add(to)
                row = {}
                for label, to in moves.items():
                    c = close(to)
                    if c not in names:
                        names[c] = len(names)
                        order.append(c)
                    row[label] = names[c]
                arcs.append((row, e in cur))
            dfas[name] = _minimal(arcs)
        base, n = {}, 0
        for name, arcs in dfas.items():
            base[name] = n
            n += len(arcs)
        firsts: dict[str, dict[str, dict]] = {}

        def expand(name, row):
            """Terminal -> chains of states to stack after consuming it in a state of rule ``name``; a state with nothing to follow is left out."""
            out: dict[str, dict] = {}
            for label, to in row.items():
                rest = (base[name] + to,) if dfas[name][to][0] else ()
                if label in dfas:
                    for t, cs in chains(label).items():
                        out.setdefault(t, {}).update((rest + c, None) for c in cs)
                else:
                    out.setdefault(label, {})[rest] = None
            return out

        def chains(name):
            if name not in firsts:
                firsts[name] = {}
                row, final = dfas[name][0]
                if final:
                    raise ValueError(f"rule {name} may be empty")
                firsts[name] = expand(name, row)
            return firsts[name]

        self.table: list[dict[str, tuple]] = []
        self.final: list[bool] = []
        for name, arcs in dfas.items():
            for row, final in arcs:
                out = expand(name, row)
                for w in soft:
                    if "ID" in out:
                        out[w] = out.get(w, {}) | out["ID"]
                self.table.append({t: tuple(c) for t, c in out.items()})
                self.final.append(final)
        self.start = base[f"<{start}>"]
        self.memo: dict = {}

    def _step(self, stacks, term: str, low: int) -> tuple[list[tuple], int]:
        """All stacks after ``term``, and the least height looked at."""
        table, final, out = self.table, self.final, {}
        for st in stacks:
            n = len(st)
            while n:
                acts = table[st[-1]].get(term)
                if acts:
                    under = st[:-1]
                    for c in acts:
                        out[under + c] = None
                if n == 1 or not final[st[-1]]:
                    break
                st = st[:-1]
                n -= 1
            low = min(low, n)
        return list(out), low

    def _line(self, stacks, line: tuple, semicolons: bool) -> tuple[list[tuple], int, int]:
        """(stacks after ``line``, least height looked at, index of the first wrong terminal or -1)."""
        low = min(map(len, stacks))
        for i, t in enumerate(line):
            new, low = self._step(stacks, t, low)
            if not new and semicolons and (i == 0 or t == "}" or t == "EOF"):
                put, low = self._step(stacks, ";", low)
                new, low = self._step(put, t, low)
            if not new:
                return [], low, i
            stacks = new
        return stacks, low, -1

    def parse(self, lines, semicolons: bool = False) -> tuple[int, int] | None:
        """``lines``: tuples of terminals, the last ending in ``EOF``. None if the whole input is a
        sentence, else (line index, index in it) of the first token no sentence can have there.

        A line's effect on a stack depends only on the states looked at, so (those states, line)
        -> their replacements is remembered and identical line shapes are parsed once.
        ``semicolons``: where a token fits nowhere and starts a line, closes a block or ends the
        file, a ``;`` is put before it if that fits. Whether it fits is a question to all stacks
        together, so several stacks are then followed without the memo."""
        stacks, memo = [(self.start,)], self.memo
        for no, line in enumerate(lines):
            if not line:
                continue
            if semicolons and len(stacks) > 1:
                stacks, _, bad = self._line(stacks, line, True)
                if bad >= 0:
                    return no, bad
                continue
            after, wrong = {}, 0
            for st in stacks:
                for seen, new, bad in memo.get((st[-1], line), ()):
                    n = len(seen)
                    if st[-n:] == seen:
                        under = st[:-n]
                        break
                else:
                    new, low, bad = self._line((st,), line, semicolons)
                    seen, under, new = st[low - 1:], st[:low - 1], [s[low - 1:] for s in new]
                    if len(memo) > self.MEMO_ENTRIES:
                        memo.clear()
                    memo.setdefault((st[-1], line), []).append((seen, new, bad))
                for s in new:
                    after[under + s] = None
                wrong = max(wrong, bad)
            if not after:
                return no, wrong
            stacks = list(after)
        return None
