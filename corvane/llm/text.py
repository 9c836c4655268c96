"""Text normal forms that several operators share."""

from __future__ import annotations

import hashlib
import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_ENTRY = re.compile(r"[;>|]")


def fold(text: str) -> str:
    """NFC and case folding."""
    return text.casefold() if text.isascii() else unicodedata.normalize("NFC", text).casefold()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, folded."""
    return _WORD.findall(fold(text)) if text else []


def letters(text: str | None) -> str:
    """Letters and digits only, folded."""
    return "".join(words(text))


def sentence_first(req: str, headers: str | None) -> tuple[str, str]:
    """The column that holds the requirement sentence, then the other.

    Headers are short entries separated by ; > or |, so the sentence stands in the column with the longest single
    entry (in letters and digits); at a tie it is the one with fewer entries, then the one with the greater letters, so
    that a row and its copy with exchanged columns always give the same.
    """
    if not headers:
        return req, ""
    if len(req) > 2 * len(headers) and not _ENTRY.search(req):
        return req, headers  # the usual case: a single piece that no entry of headers can reach
    parts = [entries(c) for c in (req, headers)]
    rank = [(max(map(len, p), default=0), -len(p), sorted(p), letters(c)) for p, c in zip(parts, (req, headers))]
    return (headers, req) if rank[1] > rank[0] else (req, headers)


def entries(headers: str | None) -> list[str]:
    """The single entries, as letters and digits, without empty ones, sorted."""
    return sorted(e for e in map(letters, _ENTRY.split(headers)) if e) if headers else []


def digest(data: str | bytes) -> bytes:
    """16 bytes that stand for a text."""
    return hashlib.blake2b(data.encode("utf-8", "replace") if isinstance(data, str) else data, digest_size=16).digest()
