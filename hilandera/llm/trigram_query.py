"""Boolean trigram queries derived from regular expressions.

An expression's alternatives are followed through its syntax tree as sequences of literal
fragments with unknown text between them. A text can only match if, for one alternative, it holds
all trigrams of that alternative's fragments. The query is an OR of ANDs over lower-case trigrams
(so it also holds for expressions that ignore the case of letters). An alternative without any
trigram leaves nothing to ask: then every text must be scanned.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

_UNKNOWN = ("", "")
_MOST = 64


def _joined(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """Fragments of a followed by b; inner fragments too short for a trigram are let go."""
    whole = (*a[:-1], a[-1] + b[0], *b[1:])
    return (whole[0], *(f for f in whole[1:-1] if len(f) > 2), whole[-1]) if len(whole) > 1 else whole


def _sequence(parts) -> set[tuple[str, ...]]:
    out = {("",)}
    for alternatives in parts:
        both = {_joined(a, b) for a in out for b in alternatives}
        out = both if len(both) <= _MOST else {_joined(a, _UNKNOWN) for a in out}
    return out


def _members(items) -> set[tuple[str, ...]]:
    chars = [chr(v) for op, v in items if op is C.LITERAL]
    return {(c,) for c in chars} if len(chars) == len(items) <= 8 else {_UNKNOWN}


def _alternatives(tree) -> set[tuple[str, ...]]:
    parts = []
    for op, value in tree:
        if op is C.LITERAL:
            parts.append({(chr(value),)})
        elif op is C.IN:
            parts.append(_members(value))
        elif op is C.BRANCH:
            either = set().union(*(_alternatives(x) for x in value[1]))
            parts.append(either if len(either) <= _MOST else {_UNKNOWN})
        elif op is C.SUBPATTERN:
            parts.append(_alternatives(value[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            once = _alternatives(inner)
            if (low, high) == (0, 1):
                parts.append(once | {("",)})
            else:
                parts += [once] * min(low, 4)
                if low != high or low > 4:
                    parts.append({_UNKNOWN})
        elif op is C.AT:
            parts.append({("",)})
        else:
            parts.append({_UNKNOWN})
    return _sequence(parts)


def trigram_query(pattern: str) -> list[tuple[str, ...]] | None:
    """The clauses of the query, each a sorted tuple of trigrams that must all be there; None: scan every text."""
    clauses = set()
    for fragments in _alternatives(_parser.parse(pattern)):
        found = {f[i : i + 3].lower() for f in fragments for i in range(len(f) - 2)}
        if not found:
            return None
        clauses.add(frozenset(found))
    return sorted(tuple(sorted(c)) for c in clauses if not any(other < c for other in clauses))
