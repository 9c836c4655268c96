"""Labelled spans of personal information: what the tagger in ``pii`` is trained on.

No table holds labels, so they are made here, from a bounded sample of the corpus's own lines: emails, numbers and
addresses by their fixed forms, names by bootstrapping. The words that follow a listed given name give the surnames'
endings, the words before such surnames give further given names, and from both come the name spans. Copies of the
labelled lines with other digits, other names (stems and endings recombined), other cases and other neighbours make the
training set varied; unlabelled lines keep the companies, places, codes and headings in it as counterexamples.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

TYPES = ("email", "phone", "id_number", "address", "name")

# Forms of personal information, titles, and words that open a sentence before a name.
_HOST = r"[\w-]+(?:\.[\w-]+)+"
_FORMS = (
    ("email", re.compile(rf"(?:mailto:)?[\w.+-]*\w@{_HOST}")),
    ("email", re.compile(r"(?:mailto:)?[\w.+-]*\w ?[\[(]at[\])] ?[\w-]+(?:(?:\.| ?[\[(]dot[\])] ?)[\w-]+)+")),
    ("email", re.compile(r"[\w.+-]*\w at [\w-]+(?: dot [\w-]+)+")),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}|00\d{3})(?:[ -]?\(0\))?(?:[ -]?\d{2,10}){1,5}(?: ext\. \d+)?(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.-])(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}([-.])\d{3}\1\d{4}|0\d{4} \d{6}|0\d{3} \d{3} \d{4})(?![\w-])")),
    ("id_number", re.compile(r"(?<![\w.-])(?:\d{6}[- ]?\d{5}|\d{3}-\d{2}-\d{4}|[A-Z]{2}\d{7})(?![\w-])")),
    ("address", re.compile(r"(?:Flat \d+, )?\b\d+[A-Z]? (?:[A-ZÀ-ÖØ-Þ][\w’'-]*[a-zà-ÿ] ){1,2}(?:St\.|Rd\b|Road|Lane|Avenue|Street|Drive)")),
    ("address", re.compile(r"\b\d+[A-Z]? (?:[A-ZÀ-ÖØ-Þ]{3,} ){1,2}(?:AVENUE|ROAD|LANE|STREET|ST\.|RD)")),
    ("address", re.compile(r"\b\d+, rue [A-ZÀ-ÖØ-Þ]\w+")),
    ("address", re.compile(r"\b[A-ZÀ-ÖØ-Þ]\w+(?:gata|gate|veien|vei|straße|strasse|weg) \d+(?: ?[A-Z]\b)?")),
)
_TOWN = re.compile(r", (?:\d{4,5} )?[A-ZÀ-ÖØ-Þ][\wÀ-ÿ]+(?: [A-ZÀ-ÖØ-Þ][\wÀ-ÿ]+)?")
_TITLE = r"(?:Dr|Mr|Mrs|Ms|Prof|M|Mme|Herr|Frau)\.?"
_CAP = r"[A-ZÀ-ÖØ-Þ][\wÀ-ÿ]*[a-zà-öø-ÿ]"
_LOUD = r"[A-ZÀ-ÖØ-Þ]{2,}"
OPENERS = {"Ask", "Only", "In", "By", "The", "Agreed", "According", "Drawn", "Reviewed", "Deliver", "Contact", "From", "To", "With", "For", "And", "Best", "Compare"}

_SIGNED = re.compile(r"(?:^|, ?)((?:[^\W\d_]+ ){1,2}[^\W\d_]+)[ .!]*$")
_PAIR = re.compile(rf"\b({_CAP}|{_LOUD}) (?=(?:[A-ZÀ-ÖØ-Þ]\. )?({_CAP}|{_LOUD})\b)")


def _no_emails(line: str) -> str:
    for kind, form in _FORMS:
        if kind == "email":
            line = form.sub(" ", line)
    return line


class Names:
    """Given names and surname stems and endings, learnt from lines."""

    def __init__(self, lines: list[str], listed: set[str]):
        self.listed = {n for n in listed if n}
        plain = Counter(w for line in lines for w in re.findall(r"(?<![\w.@-])[a-zà-ÿ]{3,}(?![\w@])", _no_emails(line)))
        proud = Counter(w.lower() for line in lines for w in re.findall(rf"{_CAP}|{_LOUD}", line))
        plain = {w for w, n in plain.items() if n > 2 and n > proud[w]}
        follow: set[str] = set()
        for line in lines:
            for m in _PAIR.finditer(line):
                if m[1].title() in self.listed and m[2].lower() not in plain:
                    follow.add(m[2].title() if m[2].isupper() else m[2])
        ends = Counter(w[-k:] for w in follow for k in range(3, 8) if len(w) >= k + 3)
        # an ending counts if several surnames have it, in its longest form that nearly all of them share
        often = {e: n for e, n in ends.items() if n >= max(3, len(follow) // 60)}
        longest = {e for e, n in often.items() if not any(len(o) > len(e) and o.endswith(e) and m >= 0.8 * n for o, m in often.items())}
        self.endings = {e for e in longest if not any(len(o) < len(e) and e.endswith(o) for o in longest)}
        self.plain = plain
        self.hosts = sorted({h.lower() for line in lines for h in re.findall(rf"@({_HOST})", line)}) or ["mail.example"]
        self.surname = re.compile(r"(?i:%s)$" % "|".join(sorted(map(re.escape, self.endings)))) if self.endings else None
        self.surnames = sorted(follow)
        before: Counter[str] = Counter()
        for line in lines:
            for m in _PAIR.finditer(line):
                if self.is_surname(m[2]) and m[1].lower() not in plain and m[1].title() not in OPENERS:
                    before[m[1].title()] += 1
        self.given = self.listed | {w for w, n in before.items() if n >= 2}

    def is_surname(self, word: str) -> bool:
        return bool(self.surname) and len(word) >= 5 and bool(self.surname.search(word))

    def spans(self, line: str) -> list[tuple[int, int, str]]:
        out = []
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(rf"{_CAP}(?:-{_CAP})?|{_LOUD}(?:-{_LOUD})?", line)]
        for k, (a, b, w) in enumerate(words):
            if not self.is_surname(w) or (a and (line[a - 1].isalnum() or line[a - 1] in "@._-+")) or line[b : b + 1] in ("@", "_", "+"):
                continue
            after = re.match(rf", ({_CAP}|{_LOUD})\b", line[b:])
            if after and after[1].title() in self.given:
                out.append((a, b + after.end(), "name"))
                continue
            lead = re.search(rf"(?:\b{_TITLE} |\b[A-ZÀ-ÖØ-Þ]\. |\b(?:{_CAP}|{_LOUD}) (?:[A-ZÀ-ÖØ-Þ]\. )?)$", line[:a])
            if lead:
                first = lead[0].split()[0]
                initial = re.search(r"\b[A-ZÀ-ÖØ-Þ]\. $", lead[0])
                if first in OPENERS and initial:
                    out.append((lead.start() + initial.start(), b, "name"))
                    continue
                known = first.title() in self.given or re.fullmatch(_TITLE, first) or len(first.rstrip(".")) == 1
                if known or (first.title() not in OPENERS and first.isalpha() and len(first) > 2):
                    out.append((lead.start(), b, "name"))
        signed = _SIGNED.search(line)
        if signed and signed[1].islower() and signed[1].split()[0].title() in self.given and self.is_surname(signed[1].split()[-1]):
            out.append((*signed.span(1), "name"))
        return out


def label(line: str, names: Names) -> list[tuple[int, int, str]]:
    """Spans without overlaps, in order; numbers and emails take precedence over addresses, these over names."""
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(line))

    def add(a: int, b: int, kind: str) -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, kind))

    for kind, form in _FORMS:
        for m in form.finditer(line):
            end = m.end()
            if kind == "address" and (town := _TOWN.match(line, end)):
                end = town.end()
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                continue
            add(m.start(), end, kind)
    for a, b, kind in names.spans(line):
        add(a, b, kind)
    return sorted(found)


def fits(text: str, kind: str) -> bool:
    """Has the whole text one of the type's fixed forms?"""
    return any(k == kind and form.fullmatch(text) for k, form in _FORMS)


def varied(line: str, spans: list[tuple[int, int, str]], names: Names, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """A copy with other digits in its numbers and other people in its names."""
    out, new, last, size = [], [], 0, 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    loud = rng.random() < 0.15
    for a, b, kind in spans:
        put(line[last:a])
        piece = line[a:b]
        if kind in ("phone", "id_number", "address"):
            piece = re.sub(r"\d", lambda m: m[0] if rng.random() < 0.25 else str(rng.integers(10)), piece)
        if kind == "id_number":
            piece = re.sub(r"^[A-Z]{2}", lambda m: "".join(chr(65 + rng.integers(26)) for _ in m[0]), piece)
        if kind == "email":
            piece = _email(names, rng) if rng.random() < 0.7 else piece
        if kind == "address":
            piece = re.sub(r"[A-ZÀ-ÖØ-Þ][a-zà-ÿ]{5,}", lambda m: _blurred(m[0], rng), piece)
            piece = piece.upper() if rng.random() < 0.12 and "rue" not in piece else piece
        if kind == "name" and piece.islower():
            piece = re.sub(r"[^\W\d_]+", lambda m: _other(m[0].title(), names, rng).lower(), piece)
        elif kind == "name":
            piece = re.sub(rf"{_CAP}|{_LOUD}", lambda m: _other(m[0], names, rng), piece)
            piece = piece.upper() if loud else piece
        new.append((size, size + len(piece), kind))
        put(piece)
        last = b
    put(line[last:])
    return "".join(out), new


_VOWELS, _CONSONANTS = "aeiouy", "bdfghklmnprstvwz"


def _blurred(word: str, rng: np.random.Generator) -> str:
    """Some letters in the first half replaced by others of their kind, so that a street's ending stays."""
    out = list(word)
    for i in range(1, max(2, len(word) // 2)):
        if rng.random() < 0.35 and out[i].isalpha():
            pool = _VOWELS if out[i] in _VOWELS else _CONSONANTS
            out[i] = pool[rng.integers(len(pool))]
    return "".join(out)


def _email(names: Names, rng: np.random.Generator) -> str:
    """An address made of a name's parts, in one of the forms that the label patterns know."""
    given = sorted(names.given)[rng.integers(len(names.given))].lower() if names.given else "post"
    family = _other(names.surnames[rng.integers(len(names.surnames))], names, rng).lower() if names.surnames else "desk"
    given, family = (re.sub(r"[^a-z]", "", w) or "x" for w in (given, family))
    local = [f"{given}.{family}", f"{given}_{family}", f"{given}-{family}", f"{given[:1]}{family}", f"{given}{rng.integers(1, 100)}", f"{family}+{names.hosts[rng.integers(len(names.hosts))].split('.')[0]}"][rng.integers(6)]
    host = names.hosts[rng.integers(len(names.hosts))]
    form = rng.integers(8)
    if form == 0:
        return f"{local}(at){host}"
    if form == 1:
        return f"{local} [at] {host.replace('.', ' [dot] ')}"
    if form in (2, 3):
        return f"{local} at {host.replace('.', ' dot ')}"
    text = f"{local}@{host}"
    return text.upper() if form == 4 else f"mailto:{text}" if form == 5 else text


def _other(word: str, names: Names, rng: np.random.Generator) -> str:
    if re.fullmatch(_TITLE, word):
        return word
    if names.is_surname(word):
        pick = names.surnames[rng.integers(len(names.surnames))] if names.surnames else word
        end = sorted(names.endings)[rng.integers(len(names.endings))]
        stem = names.surname.sub("", pick) or pick
        got = stem[:1] + stem[1:].lower() + end.lower() if rng.random() < 0.8 else pick
    else:
        pool = sorted(names.given)
        got = pool[rng.integers(len(pool))] if pool else word
    return got.upper() if word.isupper() and len(word) > 1 else got
