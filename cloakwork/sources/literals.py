"""Literals that a pattern can't match without: a cheap guard before an expensive search."""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

#: Letters beyond ASCII that match an ASCII letter if case is ignored.
FOLDS = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})
MOST = 24
CLAUSES = 4


def fold(text: str) -> str:
    return text.translate(FOLDS).lower()


def required(pattern: re.Pattern[str]) -> list[list[str]]:
    """Clauses of folded literals: the folded form of every text that matches has at least one literal of each clause.

    Runs of characters that every match has are found in the parse tree, also in what must stand before or behind; where
    alternatives are, the best clause of each is united. No clauses: nothing to tell.
    """
    found = _clauses(_parser.parse(pattern.pattern, pattern.flags & ~re.DEBUG))
    return sorted(found, key=_worth, reverse=True)[:CLAUSES]


def may_match(folded: str, clauses: list[list[str]]) -> bool:
    return all(any(x in folded for x in c) for c in clauses)


def _worth(clause: list[str]) -> tuple[int, int]:
    return min(map(len, clause)), -len(clause)


def _clauses(tree) -> list[list[str]]:
    found: list[list[str]] = []
    run = ""
    for op, arg in [*tree, (None, None)]:
        if op is K.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            found.append([run])
            run = ""
        inner: list[list[str]] = []
        if op is K.SUBPATTERN:
            inner = _clauses(arg[3])
        elif op is K.BRANCH:
            each = [_clauses(b) for b in arg[1]]
            if all(each):
                inner = [sorted({x for e in each for x in max(e, key=_worth)})]
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = _clauses(arg[2])
        elif op is K.ATOMIC_GROUP:
            inner = _clauses(arg)
        elif op is K.ASSERT:
            inner = _clauses(arg[1])
        elif op is K.IN and all(o is K.LITERAL and a < 128 for o, a in arg):
            inner = [sorted({chr(a).lower() for _, a in arg})]
        found += [c for c in inner if len(c) <= MOST and c not in found]
    return found
