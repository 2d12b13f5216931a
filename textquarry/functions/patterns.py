"""Literals to regular expressions that Java and RE2 read alike, without flags.

Ignoring case follows ECMAScript's rule for expressions without the ``u`` flag:
two UTF-16 units match if they have the same simple upper case, and a unit
beyond ASCII never matches one within. Each unit becomes the class of all units
that match it, so neither engine's own folding, which differs, is asked.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

#: Characters with a meaning in a pattern.
SPECIAL = frozenset(r".*+?^${}()|[]\/-")


def canonical(ch: str) -> str:
    """A unit's representative: its upper case, if that is one unit and does not fall into ASCII from beyond."""
    up = ch.upper()
    if len(up) != 1 or ord(up) > 0xFFFF or (ord(ch) > 127 and ord(up) < 128):
        return ch
    return up


@lru_cache(maxsize=1)
def _folds() -> dict[str, str]:
    """Representative to all its units, for those that have more than one."""
    by = defaultdict(list)
    for code in (*range(0xD800), *range(0xE000, 0x10000)):
        by[canonical(chr(code))].append(chr(code))
    return {k: "".join(v) for k, v in by.items() if len(v) > 1}


def alike(ch: str) -> str:
    """All units that match ch without case, itself among them."""
    return _folds().get(canonical(ch), ch)


def escaped(ch: str) -> str:
    return "\\" + ch if ch in SPECIAL else ch


def literal(text: str, case_sensitive: bool = False) -> str:
    """A pattern that matches text."""
    if case_sensitive:
        return "".join(map(escaped, text))
    folds = _folds()
    return "".join(f"[{folds[c]}]" if (c := canonical(ch)) in folds else escaped(ch) for ch in text)


class _Node:
    """Literals with a common beginning. ends: one of them goes no further."""

    __slots__ = ("below", "ends")

    def __init__(self):
        self.below: dict[str, _Node] = {}
        self.ends = False


#: Groups within groups at most: engines go down into them by recursion.
MAX_NESTED = 200


def _unit(ch: str, fold: bool) -> str:
    return literal(ch, not fold)


def _in_class(ch: str, fold: bool) -> str:
    """A unit's characters as they stand between brackets."""
    return "".join("\\" + c if c in SPECIAL or c == "&" else c for c in (alike(ch) if fold else ch))


def _pattern(node: _Node, fold: bool, depth: int = 0) -> str:
    """What goes on at a node; longer ways first, as a literal stands before its own beginnings."""
    if depth > MAX_NESTED:
        raise RecursionError
    last, ways = [], []
    for ch, child in node.below.items():
        if not child.below:
            last.append(ch)
            continue
        out = _unit(ch, fold)
        while not child.ends and len(child.below) == 1:
            (ch, child), *_ = child.below.items()
            out += _unit(ch, fold)
        ways.append(out + (_pattern(child, fold, depth + 1) if child.below else ""))
    if last:
        ways.append(_unit(last[0], fold) if len(last) == 1 else "[" + "".join(_in_class(ch, fold) for ch in last) + "]")
    whole = "|".join(ways)
    if last and len(ways) == 1:
        return whole + "?" * node.ends
    return whole if not depth else f"(?:{whole})?" if node.ends else f"(?:{whole})"


def any_literal(texts: list[str] | tuple[str, ...], case_sensitive: bool = False) -> str | None:
    """A pattern that matches any of texts, the first of several at one place; None without texts.

    Common beginnings are shared, so what a place costs doesn't grow with the number of texts, only with that of
    first characters. The order of texts decides between two only if one is the beginning of the other: a text that
    goes on one before it is never matched and left out, so all that remain stand before their own beginnings.
    """
    texts = list(dict.fromkeys(t for t in texts if t))
    if not texts:
        return None
    root = _Node()
    for t in texts:
        node = root
        for ch in t:
            node = node.below.setdefault(ch if case_sensitive else canonical(ch), _Node())
            if node.ends:
                break
        else:
            node.ends = True
    try:
        return _pattern(root, not case_sensitive)
    except RecursionError:
        return "|".join(literal(t, case_sensitive) for t in texts)
