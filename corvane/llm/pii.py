"""Personal information in free text (problem 9): a character tagger, BiLSTM with a CRF on top, in numpy.

The tagger is trained on the driver from labelled spans (see ``spans``), made from a bounded sample of ``SAMPLE_DOCS``
documents; its weights are kept in the shared folder under a hash of all that they are made from, so a second query over the
same data reads them. Every line of every document is then read on the executors: characters within ``PAD`` of a place
that meets some type's necessary condition (``spots``; the rest cannot pass the final check) are cut into overlapping
windows, windows of similar length run through the network together, the scores of overlapping windows are reconciled
(each character keeps the scores of the window in which it stands furthest from an edge), and one Viterbi pass over each
stretch gives its spans. Spans that cannot be what they claim (an email without a host, a phone number with three
digits) are dropped by an exact check. The corpus is read once and not shuffled.

Defined cases: NULL, empty and blank texts hold nothing and are returned as they are; a document id that occurs twice
gives its lines once in ``find_pii`` and twice in ``redact``; lines are split at '\\n' alone and counted from 1; with too
few labelled lines to train on (an empty corpus, say) nothing is found.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import spots
from corvane.llm.spans import TYPES, Names, fits, label, varied
from corvane.session import bounded_sample, shared_dir

SAMPLE_DOCS = 3_000
SAMPLE_DOC_CHARS = 20_000
TRAIN_WINDOWS = 14_000
EPOCHS = 5
HIDDEN = 32
MAX_NAMES = 1_000_000
VERSION = 2  # of the way from sample to weights
WINDOW, OVERLAP = 240, 60
PAD = 60
_GROUP, _GROUP_CHARS = 256, 200_000
_SLICE_CHARS = 400_000
TAGS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
K = len(TAGS)
_FORBIDDEN = -1e4

# ---- characters: the folded character and its class, by rule, for code points below _TOP; all others share two entries
_TOP = 0x250


def _char_tables() -> tuple[np.ndarray, np.ndarray, int]:
    folded: dict[str, int] = {}
    low = np.zeros(_TOP + 2, dtype=np.int32)
    kind = np.zeros(_TOP + 2, dtype=np.int32)
    for cp in range(_TOP):
        c = chr(cp)
        key = c.lower() if c.isalpha() else "0" if c.isdigit() else c if 32 < cp < 127 else " " if c.isspace() else "?"
        low[cp] = folded.setdefault(key, len(folded))
        kind[cp] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4
    low[_TOP], low[_TOP + 1] = len(folded), len(folded) + 1
    kind[_TOP], kind[_TOP + 1] = 0, 4
    return low, kind, len(folded) + 2


_LOW, _KIND, _N_LOW = _char_tables()
_N_KIND = 5


def codes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    high = cp >= _TOP
    if high.any():
        cp = cp.copy()
        at = np.flatnonzero(high)
        cp[at] = [_TOP if text[i].isalpha() else _TOP + 1 for i in at]
    return cp.astype(np.int32)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    move, start = np.zeros((K, K), np.float32), np.zeros(K, np.float32)
    for j, to in enumerate(TAGS):
        if to[0] == "I":
            start[j] = _FORBIDDEN
            for i, frm in enumerate(TAGS):
                if frm == "O" or frm[2:] != to[2:]:
                    move[i, j] = _FORBIDDEN
    return move, start


_MOVE, _START = _allowed()


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _log_product(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log(exp(x) @ m), safely."""
    top = x.max(axis=1, keepdims=True)
    return top + np.log(np.maximum(np.exp(x - top) @ m, 1e-30))


def _backwards(lengths: np.ndarray, width: int) -> np.ndarray:
    """For each sequence the positions of its reversal; the padding keeps its place."""
    t = np.arange(width)[None, :]
    return np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)


class Tagger:
    """Two LSTM directions over folded characters and their classes, a linear layer and a linear-chain CRF.

    The gates' order is input, forget, output, candidate; the first three are stored at half scale, so that one tanh
    serves all four.
    """

    def __init__(self, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {
            "low": rng.normal(0, 0.3, (_N_LOW, 2, 4 * hidden)),
            "kind": rng.normal(0, 0.3, (_N_KIND, 2, 4 * hidden)),
            "bias": np.zeros((2, 4 * hidden)),
            "u": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)),
            "out": rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, K)),
            "out_bias": np.zeros(K),
            "move": np.zeros((K, K)),
            "start": np.zeros(K),
            "end": np.zeros(K),
        }
        self.p["bias"][:, hidden : 2 * hidden] = 0.5
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _states(self, x: np.ndarray, lengths: np.ndarray, keep: bool) -> dict[str, np.ndarray]:
        """Runs both directions; x (batch, time). Hidden states (time, 2, batch, hidden), each in its own direction's time."""
        h_size, p = self.hidden, self.p
        # everything at -2 times its scale: 1 / (1 + exp(-2z)) is the gate, and twice that less 1 the tanh
        table, u = -2 * (p["low"][_LOW] + p["kind"][_KIND] + p["bias"]), -2 * p["u"]
        back = _backwards(lengths, x.shape[1])
        both = (x, np.take_along_axis(x, back, axis=1))
        batch, time = x.shape
        h = np.zeros((2, batch, h_size), np.float32)
        c = np.zeros_like(h)
        hs = np.empty((time, 2, batch, h_size), np.float32)
        saved: dict[str, np.ndarray] = {"back": back, "both": both}
        if keep:
            saved |= {"gates": np.empty((time, 2, batch, 4 * h_size), np.float32), "cs": np.empty_like(hs)}
        fwd, bwd = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])
        z = np.empty((2, batch, 4 * h_size), np.float32)
        with np.errstate(over="ignore"):
            for t in range(time):
                np.matmul(h, u, out=z)
                z[0] += fwd[both[0][:, t]]
                z[1] += bwd[both[1][:, t]]
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                new = z[:, :, 3 * h_size :]
                new *= 2
                new -= 1
                c = z[:, :, h_size : 2 * h_size] * c + z[:, :, :h_size] * new
                h = np.exp(-2 * c)
                h += 1
                np.divide(2, h, out=h)
                h -= 1
                h *= z[:, :, 2 * h_size : 3 * h_size]
                hs[t] = h
                if keep:
                    saved["gates"][t], saved["cs"][t] = z, c
        saved["hs"] = hs
        return saved

    def _joined(self, saved: dict) -> np.ndarray:
        """(batch, time, 2 * hidden) in the text's order."""
        hs, back = saved["hs"], saved["back"]
        out = np.empty((hs.shape[2], hs.shape[0], 2 * self.hidden), np.float32)
        out[:, :, : self.hidden] = hs[:, 0].transpose(1, 0, 2)
        out[:, :, self.hidden :] = hs[back, 1, np.arange(len(back))[:, None]]
        return out


    def scores(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self._joined(self._states(x, lengths, False)) @ self.p["out"] + self.p["out_bias"]

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (batch, time). Tags come first in the arrays, so that maxima run over whole batches; the way back
        looks for the best predecessor of the tags on the path alone."""
        move = self.p["move"] + _MOVE
        batch, time, _ = scores.shape
        by_tag = np.ascontiguousarray(scores.transpose(1, 2, 0))
        inside = np.arange(time)[:, None] < lengths[None, :]
        reached = np.empty((time, K, batch), np.float32)
        best = reached[0] = by_tag[0] + (self.p["start"] + _START)[:, None]
        steps = move[:, :, None]
        for t in range(1, time):
            new = (best[:, None, :] + steps).max(axis=0)
            new += by_tag[t]
            best = reached[t] = new if inside[t].all() else np.where(inside[t], new, best)
        tags = np.zeros((time, batch), np.int8)
        at = (best + self.p["end"][:, None]).argmax(axis=0)
        for t in range(time - 1, -1, -1):
            tags[t] = np.where(inside[t], at, 0)
            if t:
                at = np.where(inside[t], (reached[t - 1] + move[:, at]).argmax(axis=0), at)
        return tags.T


    def gradients(self, x: np.ndarray, lengths: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood a character, and its gradients."""
        p, h_size = self.p, self.hidden
        saved = self._states(x, lengths, True)
        joined = self._joined(saved)
        e = joined @ p["out"] + p["out_bias"]
        batch, time = x.shape
        mask = np.arange(time)[None, :] < lengths[:, None]
        move, start, end = p["move"] + _MOVE, p["start"] + _START, p["end"]
        alpha = np.empty((time, batch, K), np.float32)
        beta = np.empty_like(alpha)
        step = np.exp(move)  # forbidden moves become 0
        alpha[0] = start + e[:, 0]
        for t in range(1, time):
            alpha[t] = np.where(mask[:, t, None], _log_product(alpha[t - 1], step) + e[:, t], alpha[t - 1])
        beta[-1] = end
        for t in range(time - 2, -1, -1):
            beta[t] = np.where(mask[:, t + 1, None], _log_product(e[:, t + 1] + beta[t + 1], step.T), end)
        z = _lse(alpha[-1] + end, 1)
        rows = np.arange(batch)
        unary = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2) * mask[:, :, None]
        both = mask[:, 1:]
        total = max(1, int(mask.sum()))
        before, after = alpha[:-1].transpose(1, 0, 2)[both], (e[:, 1:] + beta[1:].transpose(1, 0, 2))[both]
        top, low = before.max(axis=1, keepdims=True), after.max(axis=1, keepdims=True)
        weight = np.exp(np.minimum(top + low - np.broadcast_to(z[:, None], both.shape)[both][:, None], 60))
        pairs = step * (np.exp(before - top).T @ (np.exp(after - low) * weight))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["move"] = np.where(_MOVE < 0, 0, pairs)
        pair_gold = gold[:, :-1][both].astype(int) * K + gold[:, 1:][both]
        g["move"] -= np.bincount(pair_gold, minlength=K * K).reshape(K, K)
        last = gold[rows, lengths - 1]
        g["start"] = unary[:, 0].sum(0) - np.bincount(gold[:, 0], minlength=K)
        g["end"] = np.exp(alpha[-1] + end - z[:, None]).sum(0) - np.bincount(last, minlength=K)
        picked = np.take_along_axis(e, gold[:, :, None].astype(np.int64), axis=2)[:, :, 0]
        gold_score = (picked * mask).sum() + start[gold[:, 0]].sum() + end[last].sum() + move.ravel()[pair_gold].sum()
        de = unary
        de[np.arange(batch)[:, None], np.arange(time)[None, :], gold] -= mask
        g["out"] = joined.reshape(-1, 2 * h_size).T @ de.reshape(-1, K)
        g["out_bias"] = de.sum((0, 1))
        dj = de @ p["out"].T
        dh_out = np.empty((time, 2, batch, h_size), np.float32)
        dh_out[:, 0] = dj[:, :, :h_size].transpose(1, 0, 2)
        dh_out[:, 1] = np.take_along_axis(dj[:, :, h_size:], saved["back"][:, :, None], axis=1).transpose(1, 0, 2)
        ut = p["u"].transpose(0, 2, 1)
        dz = np.empty((time, 2, batch, 4 * h_size), np.float32)
        dh = np.zeros((2, batch, h_size), np.float32)
        dc = np.zeros_like(dh)
        none = np.zeros_like(dh)
        for t in range(time - 1, -1, -1):
            gates, c = saved["gates"][t], saved["cs"][t]
            i, f, o, cand = (gates[:, :, k * h_size : (k + 1) * h_size] for k in range(4))
            tc = np.tanh(c)
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            before = saved["cs"][t - 1] if t else none
            d = dz[t]
            d[:, :, :h_size] = dc * cand * 2 * i * (1 - i)
            d[:, :, h_size : 2 * h_size] = dc * before * 2 * f * (1 - f)
            d[:, :, 2 * h_size : 3 * h_size] = dh * tc * 2 * o * (1 - o)
            d[:, :, 3 * h_size :] = dc * i * (1 - cand * cand)
            dc = dc * f
            dh = np.matmul(d, ut)
        prev = np.concatenate([np.zeros((1, 2, batch, h_size), np.float32), saved["hs"][:-1]])
        for k in range(2):
            g["u"][k] = prev[:, k].reshape(-1, h_size).T @ dz[:, k].reshape(-1, 4 * h_size)
            seen = saved["both"][k].T.ravel()
            flat = dz[:, k].reshape(-1, 4 * h_size)
            for name, of in (("low", _LOW), ("kind", _KIND)):
                hot = np.zeros((g[name].shape[0], len(seen)), np.float32)
                hot[of[seen], np.arange(len(seen))] = 1
                g[name][:, k] = hot @ flat
            g["bias"][k] = flat.sum(0)
        return float((z.sum() - gold_score) / total), {k: (v / total).astype(np.float32) for k, v in g.items()}

    def fit(self, samples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, batch: int = 48, rate: float = 8e-3, seed: int = 2) -> list[float]:
        rng = np.random.default_rng(seed)
        data = sorted((encoded(text, spans) for text, spans in samples if text), key=lambda d: len(d[0]))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        groups = [data[a : a + batch] for a in range(0, len(data), batch)]
        steps = epochs * len(groups)
        for _ in range(epochs):
            loss = 0.0
            for g in rng.permutation(len(groups)):
                x, lengths, gold = padded(groups[g])
                value, grads = self.gradients(x, lengths, gold)
                loss += value
                norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
                scale = min(1.0, 0.5 / (norm + 1e-9))
                now = rate * (1 - step / steps) + 2e-4
                step += 1
                for k, v in grads.items():
                    v = v * scale
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.01 * (v * v - s[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(loss / max(1, len(groups)))
        return losses

    def tag_lines(self, lines: list[str], everything: bool = False) -> list[list[tuple[int, int, str]]]:
        """The spans of each line. ``everything``: reads whole lines, not only the stretches around spots."""
        text = "\n".join(lines)
        seen = spots.find(text)
        starts = np.cumsum([0, *(len(line) + 1 for line in lines)])
        parts = [(int(a), int(a) + len(line)) for a, line in zip(starts, lines) if line] if everything else spots.regions(text, seen, PAD)
        known: dict[str, list[tuple[int, int]]] = {}
        for a, b in parts:
            known.setdefault(text[a:b], []).append((a, b))  # a stretch that occurs several times is read once
        out: list[list[tuple[int, int, str]]] = [[] for _ in lines]
        for piece, tags in self._tagged(sorted(known, key=len)):
            for a, b, kind in tag_spans(tags):
                kind = retyped(piece[a:b], kind)
                if plausible(piece[a:b], kind):
                    for at, _ in known[piece]:
                        if spots.holds(seen, kind, at + a, at + b):
                            n = int(np.searchsorted(starts, at + a, side="right")) - 1
                            out[n].append((at + a - int(starts[n]), at + b - int(starts[n]), kind))
        return [sorted(spans) for spans in out]

    def _tagged(self, pieces: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        """Pieces that have tags, with them; the pieces come by length and go through the network in groups of bounded size."""
        for lo, hi in _grouped([len(p) for p in pieces]):
            windows: list[tuple[int, int, np.ndarray]] = []
            scored: list[np.ndarray] = []
            for n, piece in enumerate(pieces[lo:hi]):
                x = codes(piece)
                scored.append(np.empty((len(x), K), np.float32))
                windows += [(n, a, x[a : a + WINDOW]) for a in range(0, max(1, len(x) - OVERLAP), WINDOW - OVERLAP)]
            windows.sort(key=lambda w: len(w[2]))
            for g in range(0, len(windows), _GROUP):
                part = windows[g : g + _GROUP]
                x, lengths, _ = padded([(w[2], None) for w in part])
                for (n, a, w), row in zip(part, self.scores(x, lengths)):
                    # of two overlapping windows each rules its half of the overlap
                    lead = 0 if a == 0 else OVERLAP // 2
                    end = len(w) if a + len(w) >= len(scored[n]) else WINDOW - OVERLAP // 2
                    scored[n][a + lead : a + end] = row[lead:end]
            lengths = np.array([len(e) for e in scored])
            e = np.zeros((len(scored), lengths.max(), K), np.float32)
            for i, own in enumerate(scored):
                e[i, : len(own)] = own
            tags = self.viterbi(e, lengths)
            for i in np.flatnonzero(tags.any(axis=1)):
                yield pieces[lo + i], tags[i, : lengths[i]]


def _grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive groups of at most _GROUP pieces whose padded size stays below _GROUP_CHARS (or of one piece)."""
    start = 0
    while start < len(sizes):
        stop = start + 1
        while stop < len(sizes) and stop - start < _GROUP and (stop - start + 1) * sizes[stop] <= _GROUP_CHARS:
            stop += 1
        yield start, stop
        start = stop


def padded(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(r[0]) for r in rows])
    x = np.full((len(rows), lengths.max()), 32, dtype=np.int32)
    gold = np.zeros_like(x)
    for i, r in enumerate(rows):
        x[i, : lengths[i]] = r[0]
        if r[1] is not None:
            gold[i, : lengths[i]] = r[1]
    return x, lengths, gold


def encoded(text: str, spans: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    tags = np.zeros(len(text), dtype=np.int32)
    for a, b, kind in spans:
        tags[a] = TAGS.index(f"B-{kind}")
        tags[a + 1 : b] = TAGS.index(f"I-{kind}")
    return codes(text), tags


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    out: list[list] = []
    for i in np.flatnonzero(tags).tolist():
        name = TAGS[tags[i]]
        if name[0] == "I" and out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1, name[2:]])
    return [tuple(s) for s in out]


def retyped(text: str, kind: str) -> str:
    """A number that has the full form of the other kind of number, and not of its own, is of that kind."""
    if kind in ("phone", "id_number") and not fits(text, kind):
        other = "id_number" if kind == "phone" else "phone"
        return other if fits(text, other) else kind
    return kind


def plausible(text: str, kind: str) -> bool:
    """Can the text be of this type at all?"""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return bool(re.search(r"\w\s?(?:@|[\[(]at[\])]|\bat\b)\s?\w", text, re.I)) and bool(re.search(r"\w(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)\w", text, re.I))
    if kind == "phone":
        return 7 <= digits <= 17
    if kind == "id_number":
        return 6 <= digits <= 14
    if kind == "address":
        return digits > 0 and sum(c.isalpha() for c in text) >= 4
    words = re.findall(r"[^\W\d_]+", text)
    one_piece = not re.search(r"[^\W\d_]{4,}\. ", text)  # no sentence ends inside a name
    cased = all(w[0].isupper() for w in words) or len(words) <= 3 and text.islower()
    return digits == 0 and len(words) >= 2 and one_piece and cased and any(len(w) > 3 for w in words)


def training_set(texts: list[str], listed: set[str], windows: int = TRAIN_WINDOWS, seed: int = 4) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Windows of at most about 160 characters: originals with spans, varied copies, lines without spans.

    Lines with a rare form are drawn more often than their number would give.
    """
    rng = np.random.default_rng(seed)
    lines = sorted({line for t in texts for line in t.split("\n") if line.strip()})
    names = Names(lines, listed)
    marked, bare = [], []
    for line in lines:
        spans = label(line, names)
        if spans:
            marked.append((line, spans))
        else:
            bare.append(line)
    if not marked:
        return []
    out = []
    forms = [tuple((k, re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", line[a:b]))) for a, b, k in spans) for line, spans in marked]
    often = Counter(forms)
    share = np.array([often[f] ** -0.5 for f in forms])
    share /= share.sum()

    def crop(line: str, spans: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
        if len(line) <= 160:
            return line, spans
        if spans:
            s = spans[rng.integers(len(spans))]
            a = max(0, s[0] - int(rng.integers(20, 90)))
            b = min(len(line), s[1] + int(rng.integers(20, 90)))
            for x, y, _ in spans:  # no span is cut in two
                a, b = (x if x < a < y else a), (y if x < b < y else b)
            return line[a:b], [(x - a, y - a, k) for x, y, k in spans if x >= a and y <= b]
        a = int(rng.integers(0, len(line) - 120))
        return line[a : a + 120], []

    def one(i: int, vary: bool) -> None:
        line, spans = marked[i]
        if vary:
            line, spans = varied(line, spans, names, rng)
        line, spans = crop(line, spans)
        if vary and rng.random() < 0.3 and bare:  # other neighbours
            lead = bare[rng.integers(len(bare))][-70:] + " "
            line, spans = lead + line, [(a + len(lead), b + len(lead), k) for a, b, k in spans]
        out.append((line, spans))

    half = windows // 2
    for n in range(half):
        one(int(rng.choice(len(marked), p=share)) if n >= len(marked) else n, n >= len(marked) or n % 3 == 2)
    # lines with digits or several capitals are the ones that could be mistaken; half of the rest comes from them
    hard = [line for line in bare if re.search(r"\d.*\d.*\d|@|[A-Z]\w+ [A-Z]\w+", line)]
    for n in range(windows - half):
        pool = hard if hard and n % 2 else bare
        if pool:
            out.append(crop(pool[rng.integers(len(pool))], []))
    return [(t, s) for t, s in out if t]


def _stored(spark: SparkSession, digest: str) -> tuple[str, Tagger | None]:
    """Where the weights of this digest belong, and the tagger if they are there."""
    path = f"{shared_dir(spark)}/corvane-tagger-{digest}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return path, None
    tagger = Tagger()
    for r in spark.read.parquet(path).collect():  # nine arrays
        tagger.p[r.name] = np.frombuffer(r.data, np.float32).reshape(list(r.shape)).copy()
    return path, tagger


def trained(docs: DataFrame, given_names: DataFrame | None, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS) -> Tagger | None:
    """A tagger trained on the driver from at most ``sample_docs`` documents of at most SAMPLE_DOC_CHARS characters.

    ``given_names`` only help to label that sample; more than MAX_NAMES are refused. The weights are stored in the shared
    folder under a hash of the sample, the names and the settings.
    """
    spark = docs.sparkSession
    some = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where((F.length("text") > 0) & (F.length("text") <= SAMPLE_DOC_CHARS))
    texts = [r.text for r in bounded_sample(some, ["id", "text"], sample_docs).collect()]
    names = given_names.select("given_name").where("given_name is not null").distinct().limit(MAX_NAMES + 1).collect() if given_names is not None else []
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} given names")
    listed = sorted(r[0] for r in names)
    seen = hashlib.blake2b(repr((VERSION, windows, epochs, HIDDEN, listed)).encode(), digest_size=16)
    for text in texts:
        seen.update(hashlib.blake2b(text.encode("utf-8", "replace")).digest())
    path, tagger = _stored(spark, seen.hexdigest())
    if tagger is None:
        samples = training_set(texts, set(listed), windows)
        if not samples:
            return None
        tagger = Tagger()
        tagger.fit(samples, epochs)
        rows = [(k, list(v.shape), bytearray(v.tobytes())) for k, v in tagger.p.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("ignore").parquet(path)
    return tagger


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _read(tagger: Tagger, texts: list[str | None]) -> list[list[list[tuple[int, int, str]]]]:
    """For each text the spans of each of its lines."""
    lines = [t.split("\n") if t else [] for t in texts]
    spans = tagger.tag_lines([line for t in lines for line in t])
    ends = np.cumsum([0, *map(len, lines)]).tolist()
    return [spans[a:b] for a, b in zip(ends, ends[1:])]


def find_pii(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, pii_type``: lines that hold at least one piece of the type."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                if sent.value is None:
                    continue
                rows = [(a + i, n, t) for i, lines in enumerate(_read(sent.value, texts[a:b])) for n, spans in enumerate(lines, 1) for t in sorted({s[2] for s in spans})]
                if rows:
                    at, line, types = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(line, pa.int64()), pa.array(types)], ["doc", "line_no", "pii_type"])

    base = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")).where("text is not null")
    return base.mapInArrow(run, f"doc {kind}, line_no bigint, pii_type string").distinct().withColumnRenamed("doc", id_col)


def replaced(line: str, spans: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, kind in spans:
        out += [line[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, line[last:]])


def redact(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_pii``: every document with each piece replaced by a placeholder of its type."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                part = texts[a:b]
                read = _read(sent.value, part) if sent.value is not None else [[] for _ in part]
                new = ["\n".join(map(replaced, t.split("\n"), r)) if r else t for t, r in zip(part, read)]
                count = [sum(map(len, r)) for r in read]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(new, pa.string()), pa.array(count, pa.int32())], ["doc", "text", "n_pii"])

    base = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    return base.mapInArrow(run, f"doc {kind}, text string, n_pii int").withColumnRenamed("doc", id_col)
