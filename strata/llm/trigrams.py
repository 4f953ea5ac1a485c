"""Boolean trigram queries of regular expressions.

``query(pattern)`` gives a condition on the trigrams of a text that every text with a match
fulfils, in disjunctive normal form: a set of clauses, each a set of trigrams that must all
occur. ``None`` stands for a pattern without mandatory trigrams. Trigrams are lower-case, to
be looked up in lower-cased text, so one index serves rules of either case handling.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser

#: Strings kept per sub-expression and characters taken from one class; more are given up as "any text".
MOST, CLASS = 64, 8

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _simplify(clauses) -> Clauses:
    """Drop clauses that another clause implies."""
    clauses = frozenset(clauses)
    return frozenset(x for x in clauses if not any(y < x for y in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    out = _simplify(x | y for x in a for y in b)
    return out if len(out) <= MOST else min(a, b, key=len)


def _either(a: Clauses, b: Clauses) -> Clauses:
    out = _simplify(a | b)
    return out if len(out) <= MOST else ANY


class _Part:
    """exact: all strings the part may be, or None; need: what any match of it holds besides."""

    def __init__(self, exact: set[str] | None, need: Clauses = ANY):
        self.exact, self.need = exact, need

    def condition(self) -> Clauses:
        if self.exact is None:
            return self.need
        return _both(self.need, _simplify(_grams(s) for s in self.exact))


def _chars(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is c.LITERAL:
            out.add(chr(arg).lower())
        elif op is c.RANGE and arg[1] - arg[0] < CLASS:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= CLASS else None


def _sequence(tokens) -> _Part:
    run, need = {""}, ANY  # the exact strings of the open run; what closed runs need
    for op, arg in tokens:
        part = _part(op, arg)
        if part.exact is not None and len(run) * len(part.exact) <= MOST:
            run = {a + b for a in run for b in part.exact}
            need = _both(need, part.need)
        else:
            need = _both(_both(need, _Part(run).condition()), part.condition())
            run = {""}
            if part.exact is None:
                return _Part(None, _both(need, _sequence(tokens[list(tokens).index((op, arg)) + 1 :]).condition()))
    return _Part(run, need)


def _part(op, arg) -> _Part:
    if op is c.LITERAL:
        return _Part({chr(arg).lower()})
    if op is c.IN:
        return _Part(_chars(arg))
    if op in (c.AT, c.ASSERT_NOT):
        return _Part({""})
    if op is c.ASSERT:
        return _Part({""}, _sequence(list(arg[1])).condition())
    if op is c.SUBPATTERN:
        return _sequence(list(arg[3]))
    if op is c.BRANCH:
        parts = [_sequence(list(x)) for x in arg[1]]
        if all(p.exact is not None and p.need == ANY for p in parts) and len(union := set().union(*(p.exact for p in parts))) <= MOST:
            return _Part(union)
        need = parts[0].condition()
        for p in parts[1:]:
            need = _either(need, p.condition())
        return _Part(None, need)
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        least, most, inner = arg
        part = _sequence(list(inner))
        if (least, most) == (0, 1) and part.exact is not None and part.need == ANY and len(part.exact) < CLASS:
            return _Part(part.exact | {""})
        if least == most == 1:
            return part
        if least and part.exact is not None and least <= 8 and len(part.exact) ** least <= MOST:
            strings = {""}
            for _ in range(least):
                strings = {a + b for a in strings for b in part.exact}
            exact = _Part(strings, part.need)
            return exact if least == most else _Part(None, exact.condition())
        return _Part(None, part.condition() if least else ANY)
    return _Part(None)


def query(pattern: str) -> Clauses | None:
    clauses = _sequence(list(parser.parse(pattern))).condition()
    return None if frozenset() in clauses else clauses
