"""Places in a text where a piece of personal information can be at all, found with numpy over character classes.

Each type has a necessary condition that looks at neighbouring characters only:

* email: an @, an (at) or [at], an ``at`` before a host with a point, or a ``dot``;
* number (phone or id_number): six digits within 21 characters and no letter between them;
* address: a digit next to a capitalised word (before it, with ``,``, ``rue`` or a house letter between, or behind it);
* name: two capitalised words next to each other, at most three of `` .,-'’`` between, no sentence end between them; or
  two or three words without capitals that close a line behind a comma or are all of it, as in a signature.

A tagged span counts only if it holds a spot of its type, so text without a spot nearby need not be read.
"""

from __future__ import annotations

import re

import numpy as np

KINDS = ("email", "number", "address", "name")
DIGITS, WITHIN = 6, 20

_AT = re.compile(r"@|\(at\)|\[at\]", re.I)
_SAID = re.compile(r" at (?=[\w.-]*[^\W\d]\.[^\W\d])| dot |\[dot\]|\(dot\)", re.I)
_SIGNED = re.compile(r"[ \t]*((?:[^\W\d_]+[ -]){1,2}[^\W\d_]+)[ \t.!]*")
_RUE = re.compile(r"(?<=\d), rue |(?<=\d) rue ", re.I)
_LETTER, _UPPER, _DIGIT, _SPACE, _LINE, _GAP = (1 << i for i in range(6))
_TOP = 0x3000


def _classes() -> np.ndarray:
    """The classes of each character below _TOP; the last entry stands for all others, which count as letters."""
    out = np.zeros(_TOP + 1, dtype=np.uint8)
    for cp in range(_TOP):
        c = chr(cp)
        out[cp] = _LETTER * c.isalpha() | _UPPER * (c.isupper() or c.istitle()) | _DIGIT * c.isdigit() | _SPACE * (c.isspace() and c != "\n") | _LINE * (c == "\n")
        out[cp] |= _GAP * (bool(out[cp] & _SPACE) or c in ".,-'’")
    out[_TOP] = _LETTER
    return out


_CLASS = _classes()


def _signatures(text: str) -> list[tuple[int, int]]:
    """Two or three small words that close a line behind its last comma, or are all of it."""
    out, end = [], len(text)
    start = 0
    while start <= end:
        stop = text.find("\n", start)
        stop = end if stop < 0 else stop
        lead = max(start, text.rfind(",", start, stop) + 1, stop - 80)
        m = _SIGNED.fullmatch(text[lead:stop])
        if m and (lead == start or text[lead - 1] == ",") and m[1].islower():
            out.append((lead + m.start(1), lead + m.end(1)))
        start = stop + 1
    return out


def find(text: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each of KINDS the (start, end) arrays of its spots, ordered by start; no spot crosses a line break."""
    cp = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32), _TOP)
    kind = _CLASS[cp]
    none = np.zeros(0, np.int64)
    n = len(kind)
    if not n:
        return {k: (none, none) for k in KINDS}
    at = [m.span() for m in _AT.finditer(text)] + [m.span() for m in _SAID.finditer(text)] if "@" in text or " at " in text or "dot" in text or "at)" in text or "at]" in text else []
    email = np.array(sorted(at), np.int64).reshape(-1, 2)

    letter = (kind & _LETTER) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False]))
    first, last = edge[::2], edge[1::2]  # words: runs of letters
    capital = (kind[first] & _UPPER) > 0 if len(first) else np.zeros(0, bool)

    digit = np.flatnonzero(kind & _DIGIT)
    number = (none, none)
    if len(digit) >= DIGITS:
        a, b = digit[: 1 - DIGITS], digit[DIGITS - 1 :]
        near = np.flatnonzero(b - a <= WITHIN)
        a, b = a[near], b[near]
        calm = np.searchsorted(first, a) == np.searchsorted(first, b)  # no word begins between
        a, b = a[calm], b[calm]
        lines = np.flatnonzero(kind & _LINE)
        same = np.searchsorted(lines, a) == np.searchsorted(lines, b)
        number = (a[same], b[same] + 1)

    found: list[np.ndarray] = []
    up = first[capital]
    if len(up) and len(digit):
        # a digit before the word: "5 Abc", "5, Abc", "5B Abc"
        prev = lambda k: kind[np.maximum(up - k, 0)] * (up >= k)
        comma = lambda k: (cp[np.maximum(up - k, 0)] == 44) & (up >= k)
        space = (prev(1) & _SPACE) > 0
        for k, fits in ((2, (prev(2) & _DIGIT) > 0), (3, ((prev(3) & _DIGIT) > 0) & (comma(2) | ((prev(2) & _UPPER) > 0))), (3, ((prev(2) & _SPACE) > 0) & ((prev(3) & _DIGIT) > 0))):
            w = up[space & fits]
            found.append(np.stack([w - k, w + 1], 1))
        # a digit behind the word: "Abc 5", "Abc, 5"
        end = last[capital]
        after = lambda k: kind[np.minimum(end + k, n - 1)] * (end + k < n)
        for k, fits in ((1, ((after(0) & _SPACE) > 0) & ((after(1) & _DIGIT) > 0)), (2, ((after(0) & _GAP) > 0) & ((after(1) & _SPACE) > 0) & ((after(2) & _DIGIT) > 0))):
            some = np.flatnonzero(fits)
            found.append(np.stack([up[some], end[some] + k + 1], 1))
    if " rue " in text.lower() if len(digit) else False:
        found.append(np.array([(m.start() - 1, m.end()) for m in _RUE.finditer(text)], np.int64).reshape(-1, 2))
    address = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    address = address[np.argsort(address[:, 0], kind="stable")]

    names = (none, none)
    if len(first) > 1:
        gap = first[1:] - last[:-1]
        pair = np.flatnonzero(capital[:-1] & capital[1:] & (gap > 0) & (gap <= 3))
        fine = np.ones(len(pair), bool)
        for k in range(3):
            at_k = last[:-1][pair] + k
            fine &= (k >= gap[pair]) | ((kind[np.minimum(at_k, n - 1)] & _GAP) > 0)
        end_word = last[:-1][pair]
        stop = (cp[np.minimum(end_word, n - 1)] == 46) & ((last[:-1] - first[:-1])[pair] >= 4) & ((kind[np.minimum(end_word + 1, n - 1)] & _SPACE) > 0)
        pair = pair[fine & ~stop]
        spans = np.concatenate([np.stack([first[pair], last[pair + 1]], 1), np.array(_signatures(text), np.int64).reshape(-1, 2)])
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        names = (spans[:, 0], spans[:, 1])
    return {"email": (email[:, 0], email[:, 1]), "number": number, "address": (address[:, 0], address[:, 1]), "name": names}


def holds(spots: dict[str, tuple[np.ndarray, np.ndarray]], kind: str, a: int, b: int) -> bool:
    """Does [a, b) hold a spot of the type?"""
    starts, ends = spots["number" if kind in ("phone", "id_number") else kind]
    i, j = np.searchsorted(starts, a), np.searchsorted(starts, b)
    return bool((ends[i:j] <= b).any())


def regions(text: str, spots: dict[str, tuple[np.ndarray, np.ndarray]], pad: int) -> list[tuple[int, int]]:
    """The stretches within ``pad`` characters of a spot, cut at line breaks, without overlaps."""
    starts, ends = (np.concatenate([spots[k][i] for k in KINDS]) for i in (0, 1))
    if not len(starts):
        return []
    lines = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32) == 10)
    low, high = np.r_[0, lines + 1], np.r_[lines, len(text)]
    line = np.searchsorted(lines, starts)
    a, b = np.maximum(starts - pad, low[line]), np.minimum(ends + pad, high[line])
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return list(zip(a[new].tolist(), b[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]].tolist()))
