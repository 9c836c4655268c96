"""Formula text as columns: tokens, token sets, parts. Expressions run in the JVM; only the depth-aware split is an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The notation of formulas and the token limit for prompts.
QUANTIFIERS = "∃∀¬"
COUNTS = "≥≤="
PART_SYMBOLS = "⊓⊔⊑"
TOKEN_LIMIT = 600


def tokens(text: Column | str) -> Column:
    """Tokens of a formula; empty ones are kept, '' gives one empty token, NULL gives NULL."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.regexp_replace(F.regexp_replace(c, r"\[", " "), r"\]", "")
    c = F.regexp_replace(c, f"([{QUANTIFIERS}])", "$1 ")
    c = F.regexp_replace(c, f"([{COUNTS}][0-9])", "$1 ")
    return F.split(F.regexp_replace(c, r"[()]", ""), "[ .]", -1)


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def too_long(text: Column | str, limit: int = TOKEN_LIMIT) -> Column:
    """Does a prompt have more pieces than ``limit``, cut at blanks and full stops?"""
    c = F.col(text) if isinstance(text, str) else text
    return F.size(F.split(c, "[. ]", -1)) > limit


def split_at_top(text: str, symbols: str) -> list[str]:
    """Pieces between the symbols that stand outside parentheses, stripped."""
    if not any(s in text for s in symbols):
        return [text.strip()]
    if len(symbols) == 1 and "(" not in text and ")" not in text:
        return [piece.strip() for piece in text.split(symbols)]
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth == 0 and c in symbols:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def bare(piece: str) -> str:
    """Without the first opening and the last closing parenthesis, if there are both."""
    if "(" in piece and ")" in piece:
        a = piece.index("(")
        piece = piece[:a] + piece[a + 1 :]
        b = piece.rindex(")")
        piece = piece[:b] + piece[b + 1 :]
    return piece


@F.pandas_udf(T.ArrayType(T.StringType()))
def parts(text: pd.Series) -> pd.Series:
    """The distinct pieces of a formula between ⊓, ⊔ and ⊑ outside parentheses, sorted."""
    return text.map(lambda s: None if s is None else sorted(set(split_at_top(s, PART_SYMBOLS))))
