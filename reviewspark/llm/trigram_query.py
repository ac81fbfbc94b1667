"""Boolean trigram queries from regular expressions.

Walks the syntax tree of a pattern and keeps, for every part, the strings it can be (if they are few), the
strings it can begin and end with, and the trigrams that any match must hold: concatenation demands both
sides and the trigrams across the seam, alternation one of its branches, what may be absent demands nothing.
The query is a list of alternatives, each a set of trigrams that must all occur; a single empty alternative
demands nothing. Whatever is too large is replaced by something weaker, so a query never loses a match.

All strings are lower-case: the index folds letters. Patterns that are read differently by the engine that
runs them (Java's) and by the parser used here, or not at all, demand nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from itertools import product
from re import _constants as op
from re import _parser as parser

#: Strings of one part, characters of one class, and alternatives of a query that are kept apart.
STRINGS, CLASS, ALTERNATIVES = 64, 8, 64
Query = frozenset
ANYTHING: Query = frozenset([frozenset()])
#: Syntax that means something else, or nothing, to one of the two engines.
_DIFFERENT = re.compile(r"&&|\[[^\]\\]*\[|\\[0GQEhHRXpPzezcNk]|\(\?[a-zA-Z-]*[uUxd]|\(\?P|\(\?<[a-zA-Z]|\(\?#")


def simplified(query: Query) -> Query:
    """Without alternatives that another one contains."""
    kept = [a for a in query if not any(b < a for b in query)]
    return frozenset(kept) if len(kept) <= ALTERNATIVES else ANYTHING


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > ALTERNATIVES * 4:
        return min(a, b, key=len)
    return simplified(frozenset(x | y for x, y in product(a, b)))


def either(a: Query, b: Query) -> Query:
    return simplified(a | b)


def holding(strings: frozenset) -> Query:
    """The query of text that holds one of ``strings``."""
    return simplified(frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))


@dataclass(frozen=True)
class Part:
    """``exact``: all strings of the part, or None; ``begins``, ``ends``: strings one of which it begins or ends with."""

    exact: frozenset | None
    begins: frozenset
    ends: frozenset
    query: Query = ANYTHING


NOTHING = frozenset([""])
EMPTY = Part(NOTHING, NOTHING, NOTHING)
UNKNOWN = Part(None, NOTHING, NOTHING)


def bounded(p: Part) -> Part:
    """With few and short strings; what is given up goes into the query."""
    if p.exact is not None:
        if len(p.exact) <= STRINGS:
            return replace(p, begins=p.exact, ends=p.exact)
        p = replace(p, exact=None, query=both(p.query, holding(p.exact)))
    begins, ends, query = p.begins, p.ends, both(both(p.query, holding(p.begins)), holding(p.ends))
    begins, ends = frozenset(s[:2] for s in begins), frozenset(s[-2:] for s in ends)
    return Part(None, begins if len(begins) <= STRINGS else NOTHING, ends if len(ends) <= STRINGS else NOTHING, query)


def concatenated(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= 4 * STRINGS:
        exact = frozenset(x + y for x, y in product(a.exact, b.exact))
        return bounded(Part(exact, exact, exact, both(a.query, b.query)))
    query = both(a.query, b.query)
    if len(a.ends) * len(b.begins) <= 4 * STRINGS:
        query = both(query, holding(frozenset(x + y for x, y in product(a.ends, b.begins))))
    begins = frozenset(x + y for x, y in product(a.exact, b.begins)) if a.exact is not None and len(a.exact) * len(b.begins) <= 4 * STRINGS else a.begins
    ends = frozenset(x + y for x, y in product(a.ends, b.exact)) if b.exact is not None and len(a.ends) * len(b.exact) <= 4 * STRINGS else b.ends
    return bounded(Part(None, begins, ends, query))


def alternated(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None:
        return bounded(Part(a.exact | b.exact, a.exact | b.exact, a.exact | b.exact, either(a.query, b.query)))
    # a side known exactly demands what its strings hold
    whole = [p.query if p.exact is None else both(p.query, holding(p.exact)) for p in (a, b)]
    return bounded(Part(None, a.begins | b.begins, a.ends | b.ends, either(*whole)))


def character(code: int) -> Part:
    s = frozenset([chr(code).lower()])
    return Part(s, s, s)


def character_class(items) -> Part:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 4 * CLASS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return UNKNOWN
        if len(found) > CLASS:
            return UNKNOWN
    strings = frozenset(found)
    return Part(strings, strings, strings)


def part_of(tree) -> Part:
    out = EMPTY
    for kind, value in tree:
        out = concatenated(out, _one(kind, value))
    return out


def _one(kind, value) -> Part:
    if kind is op.LITERAL:
        return character(value)
    if kind is op.IN:
        return character_class(value)
    if kind is op.SUBPATTERN:
        return part_of(value[-1])
    if kind is op.ATOMIC_GROUP:
        return part_of(value)
    if kind is op.BRANCH:
        branches = [part_of(b) for b in value[1]]
        out = branches[0]
        for b in branches[1:]:
            out = alternated(out, b)
        return out
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        once = part_of(inner)
        if (least, most) == (0, 1):
            return alternated(once, EMPTY)
        out = EMPTY
        for _ in range(min(least, 3)):
            out = concatenated(out, once)
        if least == most and least <= 3:
            return out
        # more of it: still begins and ends as it does, with something between
        more = concatenated(concatenated(out, UNKNOWN), once) if least else UNKNOWN
        return more
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return EMPTY
    return UNKNOWN


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams that must all occur in a lower-cased text that matches; empty if nothing must."""
    if _DIFFERENT.search(pattern):
        return []
    try:
        whole = part_of(parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return []
    query = whole.query
    for strings in (whole.exact, whole.begins, whole.ends):
        if strings is not None:
            query = both(query, holding(strings))
    found = sorted(sorted(a) for a in query)
    return found if all(found) else []
