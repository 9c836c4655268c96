"""A scanner for description-logic formulas, and the test whether a formula is complete."""

from __future__ import annotations

import re

# The notation's symbols.
SUBSUMED, SUBSUMES, AND, OR, SOME, ALL, NOT = "⊑", "⊒", "⊓", "⊔", "∃", "∀", "¬"

_TOKEN = re.compile(r'"[^"]*"|[⊑⊒⊓⊔∃∀¬.()\[\]|"]|[≥≤=]\d*|[^\s⊑⊒⊓⊔∃∀¬.()\[\]|"≥≤=]+')
_PAIR = {")": "(", "]": "["}


def tokens(text: str) -> list[str]:
    """Symbols, quoted strings and names; a quote that isn't closed is a token of its own."""
    return _TOKEN.findall(text)


def flaw(toks: list[str]) -> str:
    """Why the tokens aren't one formula, or ''.

    'open': something is left open at the end, the formula may have lost its end; 'wrong': a fault further on the left.
    """
    stack: list[str] = []
    seen = 0
    n = len(toks)
    for i, t in enumerate(toks):
        before = toks[i - 1] if i else ""
        if t == '"':
            return "open"
        if t in "([" and len(t) == 1:
            stack.append(t)
        elif t in _PAIR:
            if not stack or stack.pop() != _PAIR[t]:
                return "wrong"
            if before == "(":
                return "wrong"
        elif t == SUBSUMED:
            if stack or seen or i == 0 or not _ends(before):
                return "wrong"
            seen = 1
        elif t == SUBSUMES or t == "|":
            return "wrong"
        elif t in (AND, OR):
            if "[" in stack:
                continue
            if not _ends(before):
                return "wrong"
            if i + 1 < n and not _begins(toks[i + 1]):
                return "wrong"
        elif t in (SOME, ALL) and "[" not in stack:
            if i + 1 < n and not _name(toks[i + 1]):
                return "wrong"
            if i + 2 < n and toks[i + 2] != ".":
                return "wrong"
            if i + 3 < n and not _begins(toks[i + 3]):
                return "wrong"
            if i + 3 >= n:
                return "open"
    if stack or (n and toks[-1] in (AND, OR, SOME, ALL, NOT, SUBSUMED, ".")):
        return "open"
    return "" if seen else "open"


def _name(t: str) -> bool:
    return t[0] not in '⊑⊒⊓⊔∃∀¬.()[]|"≥≤='


def _ends(t: str) -> bool:
    """Can an operand end with this token?"""
    return bool(t) and (t in (")", "]") or _name(t) or t[0] == '"' and len(t) > 1)


def _begins(t: str) -> bool:
    """Can an operand begin with this token?"""
    return t in ("(", SOME, ALL, NOT) or _name(t) or t[0] in "≥≤=" or t[0] == '"' and len(t) > 1


def split_axioms(toks: list[str]) -> list[list[str]]:
    """The tokens cut at each | outside brackets."""
    out: list[list[str]] = [[]]
    depth = 0
    for t in toks:
        depth += (t in ("(", "[")) - (t in _PAIR)
        if t == "|" and depth <= 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def formulas_valid(text: str | None) -> bool:
    """Blank, or one or more complete formulas separated by |."""
    if text is None or not text.strip():
        return True
    return all(flaw(part) == "" for part in split_axioms(tokens(text)))
