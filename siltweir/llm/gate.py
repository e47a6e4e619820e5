"""Many patterns over many texts: each alternative of a pattern is tried only where it can match.

From every alternative the literals are derived of which at least one must stand in whatever it matches; an Aho-Corasick
automaton of all of them reads the text once. Nothing is lost: a text without such a literal can't match. An alternative
that has no such literal is always tried."""

from __future__ import annotations

import re
import re._parser as sre  # the parse tree of patterns; standard library
from bisect import bisect_right

import ahocorasick

_NONE: frozenset[str] = frozenset()
_BLANK = frozenset({""})


def _least(literals: frozenset[str]) -> int:
    return min((len(x) for x in literals), default=0)


#: Letters that match others without case, but don't become these in lower case.
_ODD = {ord(a): b for a, b in zip("İıſᲀᲁᲂᲃᲄᲅᲆ", "iisвдосттъ")}


def folded(text: str) -> str:
    """The text in lower case, as literals are looked for in it."""
    return text.lower() if text.isascii() or not any(chr(c) in text for c in _ODD) else text.translate(_ODD).lower()


#: At most so many strings are spelled out of what may follow each other.
MANY = 200


def _spelled(op, arg) -> frozenset[str] | None:
    """All that an element of a pattern can match, lower-cased; None if these aren't a few strings."""
    if op is sre.LITERAL:
        return frozenset({chr(arg).lower()})
    if op is sre.AT:
        return _BLANK
    if op is sre.IN:
        return frozenset(chr(x).lower() for _, x in arg) if all(o is sre.LITERAL for o, _ in arg) else None
    if op is sre.SUBPATTERN and not arg[1] and not arg[2]:
        return _joined(arg[3])
    if op is sre.BRANCH:
        parts = [_joined(x) for x in arg[1]]
        return frozenset().union(*parts) if all(x is not None for x in parts) else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[:2] == (0, 1):
        inner = _joined(arg[2])
        return None if inner is None else inner | _BLANK
    return None


def _joined(seq) -> frozenset[str] | None:
    out = _BLANK
    for op, arg in seq:
        got = _spelled(op, arg)
        if got is None or len(got) * len(out) > MANY:
            return None
        out = frozenset(x + y for x in out for y in got)
    return out


def _of(seq) -> frozenset[str]:
    """Literals of which one must occur in a match of the sequence; empty if none is known."""
    best, run = _NONE, _BLANK
    for op, arg in [*seq, (None, None)]:
        got = _spelled(op, arg)
        if got is not None and len(got) * len(run) <= MANY:
            run = frozenset(x + y for x in run for y in got)
            continue
        if _least(run) > _least(best):
            best = run
        run = _BLANK if got is None else got
        got = _NONE
        if op is sre.SUBPATTERN:
            got = _of(arg[3])
        elif op is sre.BRANCH:
            parts = [_of(x) for x in arg[1]]
            got = frozenset().union(*parts) if all(parts) else _NONE
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            inner = list(arg[2])
            got = frozenset({chr(inner[0][1]).lower() * arg[0]}) if len(inner) == 1 and inner[0][0] is sre.LITERAL else _of(inner)
        if _least(got) > _least(best):
            best = got
    return best


def _edged(pattern: str) -> bool:
    """Whether each match begins, at the edge of a word, with one of the literals that are required."""
    seq = list(sre.parse(pattern))
    run = _BLANK
    for op, arg in seq:
        got = _spelled(op, arg)
        if got is None or len(got) * len(run) > MANY:
            break
        run = frozenset(x + y for x in run for y in got)
    return seq[0] == (sre.AT, sre.AT_BOUNDARY) and run == _of(seq) and all(x[:1].isalnum() for x in run)


def required(pattern: str) -> frozenset[str]:
    return _of(sre.parse(pattern))


def beginnings(pattern: str) -> frozenset[str]:
    """Lower-cased strings of which one begins whatever an anchored pattern matches; empty if they aren't known."""

    def of(seq) -> frozenset[str]:
        run = ""
        for at, (op, arg) in enumerate(seq):
            if op is sre.LITERAL:
                run += chr(arg).lower()
                continue
            got = _NONE
            if op is sre.SUBPATTERN:
                got = of(arg[3])
            elif op is sre.BRANCH:
                parts = [of(x) for x in arg[1]]
                got = frozenset().union(*parts) if all(parts) else _NONE
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                got = of(arg[2])
                if not arg[0] and not run and got:
                    rest = of(seq[at + 1 :])
                    got = got | rest if rest else _NONE
                elif not arg[0]:
                    got = _NONE
            return frozenset(run + x for x in got) if got else frozenset({run}) if run else _NONE
        return frozenset({run}) if run else _NONE

    seq = list(sre.parse(pattern))
    return of(seq[1:]) if seq and seq[0] == (sre.AT, sre.AT_BEGINNING) else _NONE


def alternatives(pattern: str) -> list[str]:
    """The sources of a pattern's alternatives at the top."""
    out, depth, square, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif square:
            square = c != "]"
        elif c == "[":
            square = True
            i += pattern[i + 1 : i + 2] in ("]", "^")
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


class Rules:
    """Named patterns, read without case. Each alternative is tried only where one of its literals stands."""

    def __init__(self, patterns: dict[str, str], least: int = 3) -> None:
        self.rules: list[tuple[re.Pattern, str]] = []
        self.free: list[int] = []
        words: dict[str, set[int]] = {}
        edged: set[int] = set()
        for name, p in patterns.items():
            for part in alternatives(p):
                n = len(self.rules)
                self.rules.append((re.compile(part, re.I), name))
                need = required(part)
                if _least(need) < least:
                    self.free.append(n)
                elif _edged(part):
                    edged.add(n)
                for w in need if _least(need) >= least else ():
                    words.setdefault(w, set()).add(n)
        self.auto = ahocorasick.Automaton()
        for w, ns in words.items():
            self.auto.add_word(w, (len(w), tuple(ns), tuple(ns - edged)))
        self.auto.make_automaton()

    def hits(self, text: str, starts: list[int]) -> dict[int, set[int]]:
        """line -> rules whose literals stand in it; starts are the places where the lines of the text begin."""
        low = folded(text)
        out: dict[int, set[int]] = {}
        if len(low) == len(text):
            for end, (_, ns, _) in self.auto.iter(low):
                out.setdefault(bisect_right(starts, end) - 1, set()).update(ns)
        else:  # lower-casing moved the places: every rule with a literal somewhere may match in every line
            ns = {n for _, (_, ns, _) in self.auto.iter(low) for n in ns}
            out = {i: set(ns) for i in range(len(starts))}
        return out

    def places(self, text: str, low: str, starts: list[int]) -> dict[int, list[tuple[int, tuple[int, ...]]]]:
        """line -> (place in it where a literal ends, its rules), in order; low is the folded text."""
        out: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        if len(low) == len(text):
            for end, (n, ns, inner) in self.auto.iter(low):
                if end >= n and (low[end - n].isalnum() or low[end - n] == "_"):  # it stands inside a word
                    ns = inner
                    if not ns:
                        continue
                i = bisect_right(starts, end) - 1
                out.setdefault(i, []).append((end - starts[i], ns))
        else:  # lower-casing moved the places: every rule with a literal somewhere may match at every place
            ns = tuple({n for _, (_, ns, _) in self.auto.iter(low) for n in ns})
            ends = [*(x - 1 for x in starts[1:]), len(text)]
            out = {i: [(at, ns) for at in range(b - a)] for i, (a, b) in enumerate(zip(starts, ends)) if ns}
        return out

    def names(self, text: str, tried: set[int] | None = None) -> set[str]:
        """Names of the patterns that match somewhere in the text, of all or of the rules to be tried."""
        if tried is None:
            tried = {n for _, (_, ns, _) in self.auto.iter(folded(text)) for n in ns} | set(self.free)
        out: set[str] = set()
        for n in tried:
            rule, name = self.rules[n]
            if name not in out and rule.search(text):
                out.add(name)
        return out


__all__ = ["Rules", "alternatives", "beginnings", "folded", "required"]
