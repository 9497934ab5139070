"""Texts that every match of a regular expression must hold, read off its syntax tree.

A search for plain text is far cheaper than one for a pattern. The required texts
come as a conjunction of alternatives: of each group at least one stands in every
line that the pattern is found in. What cannot be told gives no group, so a
pattern without groups has to be tried on every line.
"""

from __future__ import annotations

import re

#: Shortest text worth a test; most alternatives of one group.
SHORTEST, ALTERNATIVES = 2, 32
#: Letters that other signs than their capital fold to.
FOLDED_APART = frozenset("iks")

Groups = list[frozenset[str]]


def _flags(pattern: str) -> int:
    return re.compile(pattern).flags


def required(pattern: str, ignore_case: bool = False) -> Groups:
    """Groups of texts for a pattern that compiles; lower-cased ones under ``ignore_case`` (also as an inline flag)."""
    parser = re._parser
    tree = parser.parse(pattern)
    folded = ignore_case or bool(_flags(pattern) & re.IGNORECASE)
    return [g for g in dict.fromkeys(_of_sequence(list(tree), folded)) if g]


def folds(pattern: str, ignore_case: bool = False) -> bool:
    return ignore_case or bool(_flags(pattern) & re.IGNORECASE)


def best(groups: Groups) -> frozenset[str] | None:
    """The group that is rarest by the length of its shortest text, then by the number of its texts."""
    return max(groups, key=lambda g: (min(map(len, g)), -len(g)), default=None)


def _letter(code: int, folded: bool) -> str | None:
    sign = chr(code)
    if not folded:
        return sign
    if not sign.isascii() or sign.lower() in FOLDED_APART:
        return None
    return sign.lower()


def _literal(op, value, folded: bool) -> str | None:
    """The one text that an item stands for, if there is one."""
    name = str(op)
    if name == "LITERAL":
        return _letter(value, folded)
    if name == "IN" and len(value) == 1 and str(value[0][0]) == "LITERAL":
        return _letter(value[0][1], folded)
    return None


def _flatten(items: list) -> list:
    """Capturing groups without flags of their own put in line, and items that are there a fixed number of times written out."""
    out = []
    for op, value in items:
        name = str(op)
        if name == "SUBPATTERN" and not value[1] and not value[2]:
            out += _flatten(list(value[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] == value[1] and 1 <= value[0] <= 4:
            out += _flatten(list(value[2])) * value[0]
        elif name == "ATOMIC_GROUP":
            out += _flatten(list(value))
        else:
            out.append((op, value))
    return out


def _of_sequence(items: list, folded: bool) -> Groups:
    groups: Groups = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) >= SHORTEST:
            groups.append(frozenset([run]))
        run = ""

    for op, value in _flatten(items):
        name = str(op)
        sign = _literal(op, value, folded)
        if sign is not None:
            run += sign
            continue
        close()
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            groups += _of_sequence(list(value[2]), folded)
        elif name == "SUBPATTERN":
            changed = bool((value[1] | value[2]) & re.IGNORECASE)
            if not changed:
                groups += _of_sequence(list(value[3]), folded)
        elif name == "BRANCH":
            chosen = [best(_of_sequence(list(branch), folded)) for branch in value[1]]
            if all(c is not None for c in chosen):
                union = frozenset().union(*chosen)
                if len(union) <= ALTERNATIVES:
                    groups.append(union)
    close()
    return groups
