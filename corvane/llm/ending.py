"""Where and how an answer's formula ends."""

from __future__ import annotations

import re

# What a cut leaves behind at the end of a text, and the notation's symbols by their role.
CUT_MARKS = ("…", "...", "�")
UNFINISHED = "⊓⊔⊑⊒∃∀¬."
SUBSUMPTION = re.compile("[⊑⊒≡]|->|=>|<=")

_SYMBOL = re.compile("[⊑⊒⊓⊔∃∀]")
_STRING = re.compile(r'"[^"]*"')
_CLOSED = re.compile(r"\b[^\W\d_]\w*+(?=\s*[⊓⊔⊑)])")
_TYPED = re.compile(r"\b[^\W\d_]\w*+(?=\[)")
_STEM = re.compile(r"(?:[^\n]{0,40}[:!]\s+)?([A-ZÀ-ÖØ-Þ]\w*)")
_CAMEL = re.compile(r"[^\W\d_][^\W\d_A-ZÀ-ÖØ-Þ]*")


def outside_strings(text: str) -> str:
    """The text with every closed quoted string replaced by two quotes."""
    return _STRING.sub('""', text) if '"' in text else text


def is_formula(text: str | None) -> bool:
    """Are there symbols of the notation outside quoted strings?"""
    return bool(text) and bool(_SYMBOL.search(text)) and bool(_SYMBOL.search(outside_strings(text)))


def camel_words(name: str) -> list[str]:
    """The words of a name in camel case."""
    return _CAMEL.findall(name)


def trimmed(text: str) -> str:
    """The text without what a cut may have left at its end."""
    text = text.rstrip()
    while text.endswith(CUT_MARKS):
        text = text[: -3 if text.endswith("...") else -1].rstrip()
    return text


def _last_name(text: str) -> str:
    """The letters, digits and underscores at the end."""
    at = len(text)
    while at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    return text[at:]


def _bare_property(text: str) -> bool:
    """Does the text end with a quantifier and a name, so that a filler is missing?"""
    name = _last_name(text)
    return bool(name) and text[: -len(name)].rstrip().endswith(("∃", "∀"))


def ending(text: str | None) -> tuple[str, str]:
    """(state, name) of an answer.

    state: '' no formula at all; 'stem' a single capitalised name, behind a remark or not, which may be all that is left of
    a formula; 'cut' the text carries a mark of a cut or leaves something open, so its end is lost;
    'name' nothing is open and the last thing is the name given, which may be whole or not; 'whole' nothing is open and
    the end is a bracket or a quoted string. A full stop or closing brackets too many at the end open nothing.
    """
    if not text:
        return "", ""
    text = text.rstrip()
    if not _SYMBOL.search(text):
        stem = _STEM.fullmatch(trimmed(text)) if len(text) < 120 else None
        return ("stem", stem[1]) if stem else ("", "")
    bare = outside_strings(text)
    if not _SYMBOL.search(bare):
        return "", ""
    if text.endswith(CUT_MARKS) or text.count('"') % 2:
        return "cut", ""
    last = bare[bare.rfind("|") + 1 :].strip()
    if last.count("(") > last.count(")") or last.count("[") > last.count("]"):
        return "cut", ""
    if last.endswith(".") and not _bare_property(last[:-1].rstrip()):
        last = last[:-1].rstrip()
    if not last or last[-1] in UNFINISHED or _bare_property(last) or not SUBSUMPTION.search(last):
        return "cut", ""
    name = _last_name(last)
    return ("name", name) if name else ("whole", "")


def closed_names(text: str | None) -> list[str]:
    """Names in a formula that an operator or bracket follows, so that they are certainly whole."""
    return _CLOSED.findall(text) if text else []


def typed_names(text: str | None) -> list[str]:
    """Names in a formula that a value in square brackets follows, such as a datatype's."""
    return _TYPED.findall(text) if text else []
