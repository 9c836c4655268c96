"""Loading delimited rows and setting the faulty ones apart with a reason (problem 3).

Structural indexing: the rows of an Arrow batch stand in one flat byte array. A mask marks the quotes, its running sum
restarted at each row gives every byte's parity, and the delimiters of even parity are the field ends; no byte is
visited by a Python loop. Every field is then tested with array operations: a field that begins with a quote has to end
with one, with an even run of quotes at each place in between; no other field may hold one. If all fields of a row pass,
the parity cut is the row's only reading; if not, the row fails as ``quoting``. Counts and types are checked next.

Reasons, in the order in which the first that applies is given: ``quoting``, ``column_count``, ``invalid_id``,
``invalid_fprime``; NULL for a row that reads properly.

Defined cases: a NULL row, or one whose delimiter is not a single ASCII character other than a quote, fails with
``column_count``; an empty row is one empty field and fails so too; line breaks inside quoted fields are kept; repeated
rows are judged each. Nothing is shuffled; a row costs its own length only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.functions.syntax import formulas_valid

FIELDS = ("id", "req", "headers", "f", "f_prime")
_QUOTE = 34
_ID = re.compile(r"0*([0-9]{1,19})", re.ASCII)
_SLICE_BYTES = 16_000_000


def parse_id(text: str) -> int | None:
    """A whole number from 0 to 2**63 - 1 in the digits 0-9, blanks around it aside."""
    m = _ID.fullmatch(text.strip())
    return int(m[1]) if m and int(m[1]) < 2**63 else None


def _index(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, delims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Field begins and ends, each row's first field and number of fields, and whether each row's quoting holds."""
    n = len(starts)
    sizes = ends - starts
    row = np.repeat(np.arange(n), sizes)
    quote = data == _QUOTE
    total = np.r_[0, np.cumsum(quote)]
    odd = (total[1:] - np.repeat(total[starts], sizes)) & 1
    cuts = np.flatnonzero((data == np.repeat(delims, sizes)) & (odd == 0) & ~quote)
    per_row = np.bincount(row[cuts], minlength=n) + 1
    first = np.r_[0, np.cumsum(per_row)[:-1]]
    begin = np.empty(per_row.sum(), dtype=np.int64)
    end = np.empty_like(begin)
    is_first = np.zeros(len(begin), dtype=bool)
    is_first[first] = True
    begin[is_first], begin[~is_first] = starts, cuts + 1
    last = np.r_[is_first[1:], True]
    end[last], end[~last] = ends, cuts
    field_row = np.repeat(np.arange(n), per_row)
    held = total[end] - total[begin]
    some = end > begin
    padded = np.r_[data, 0]
    opens = some & (padded[begin] == _QUOTE)
    closes = (end - begin >= 2) & (padded[np.maximum(end - 1, 0)] == _QUOTE)
    good = np.where(opens, closes & (held % 2 == 0), held == 0)
    # inside a quoted field every run of quotes has to be even
    at = np.flatnonzero(quote)
    if len(at):
        field = np.searchsorted(begin, at, side="right") - 1
        # empty fields share their begin with the next byte; the last field that begins there is the one that holds it
        inner = opens[field] & (at > begin[field]) & (at < end[field] - 1)
        at, field = at[inner], field[inner]
        if len(at):
            new = np.r_[True, (np.diff(at) > 1) | (np.diff(field) > 0)]
            run = np.diff(np.r_[np.flatnonzero(new), len(at)])
            good[field[new][run % 2 == 1]] = False
    fine = np.ones(n, dtype=bool)
    fine[field_row[~good]] = False
    return begin, end, first, per_row, fine


def read_rows(raws: list[str | None], delims: list[str | None]) -> tuple[list[str | None], list[list[str] | None]]:
    """The reason (or None) and the fields (or None) of each row."""
    usable = [r is not None and d is not None and len(d) == 1 and d.isascii() and d != '"' for r, d in zip(raws, delims)]
    raw = [r.encode("utf-8", "replace") if u else b"" for r, u in zip(raws, usable)]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    marks = np.array([ord(d) if u else 0 for d, u in zip(delims, usable)], dtype=np.uint8)
    begin, end, first, count, fine = _index(data, ends - sizes, ends, marks)
    buffer = data.tobytes()
    reasons: list[str | None] = []
    out: list[list[str] | None] = []
    for i in range(len(raw)):
        fields = None
        if not usable[i]:
            reason = "column_count"
        elif not fine[i]:
            reason = "quoting"
        elif count[i] != len(FIELDS):
            reason = "column_count"
        else:
            fields = []
            for k in range(first[i], first[i] + count[i]):
                piece = buffer[begin[k] : end[k]].decode("utf-8")
                fields.append(piece[1:-1].replace('""', '"') if piece.startswith('"') else piece)
            if parse_id(fields[0]) is None:
                reason = "invalid_id"
            elif not formulas_valid(fields[4]):
                reason = "invalid_fprime"
            else:
                reason = None
        reasons.append(reason)
        out.append(fields)
    return reasons, out


def _pieces(raws: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, r in enumerate(raws):
        size += len(r or "")
        if size >= _SLICE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(raws):
        yield start, len(raws)


def load_rows(rows: DataFrame, key: str = "raw_id", raw: str = "raw", delim: str = "delim") -> DataFrame:
    """``key, reason, id, req, headers, f, f_prime``: every input row once.

    ``reason`` is NULL for a row that reads properly; the fields are set only for those (blank F-prime stays as written).
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, delims = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in _pieces(raws):
                reasons, fields = read_rows(raws[a:b], delims[a:b])
                good = [f if r is None else None for r, f in zip(reasons, fields)]
                cols = [pa.array([parse_id(f[0]) if f else None for f in good], pa.int64())]
                cols += [pa.array([f[k] if f else None for f in good], pa.string()) for k in range(1, 5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(reasons, pa.string()), *cols], ["key", "reason", *FIELDS])

    out = rows.select(rows[key].alias("key"), rows[raw].alias("raw"), rows[delim].alias("delim")).mapInArrow(run, f"key {kind}, reason string, id bigint, req string, headers string, f string, f_prime string")
    return out.withColumnRenamed("key", key)


def faulty_rows(rows: DataFrame, key: str = "raw_id") -> DataFrame:
    """``key, reason`` of the rows that fail."""
    return load_rows(rows, key).where("reason is not null").select(key, "reason")
