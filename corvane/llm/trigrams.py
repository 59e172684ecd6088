"""A trigram index over text chunks, and the trigrams that a regular expression requires.

A query is nested: True (no requirement), a trigram (bytes), ("and", queries) or ("or", queries). Texts are indexed in lower
case and UTF-8, and queries are derived in lower case, so the index serves case-sensitive and -insensitive expressions alike.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

import numpy as np

MAX_EXACT = 48  # strings kept for a sub-expression before they are turned into trigrams


def _of_string(s: str):
    b = s.lower().encode()
    tris = sorted({b[i : i + 3] for i in range(len(b) - 2)})
    return ("and", tris) if tris else True


def _or(qs: list):
    return True if not qs or any(q is True for q in qs) else qs[0] if len(qs) == 1 else ("or", qs)


def _and(qs: list):
    qs = [q for q in qs if q is not True]
    return True if not qs else qs[0] if len(qs) == 1 else ("and", qs)


def _close(exact: set[str]):
    return _or([_of_string(s) for s in sorted(exact)])


def _walk(items) -> tuple[set[str] | None, list]:
    """(all strings that the whole can match, or None if they are too many; what is required besides)."""
    run: set[str] = {""}
    need: list = []
    whole = True
    for op, arg in items:
        part, more = _one(op, arg)
        need += more
        if part is not None and len(run) * len(part) <= MAX_EXACT:
            run = {a + b for a in run for b in part}
            continue
        need.append(_close(run))
        whole = False
        run = part if part is not None else {""}
    return (run, need) if whole else (None, [*need, _close(run)])


def _one(op, arg) -> tuple[set[str] | None, list]:
    if op is K.LITERAL:
        return {chr(arg).lower()}, []
    if op is K.IN:
        chars: set[str] = set()
        for o, a in arg:
            if o is K.LITERAL:
                chars.add(chr(a).lower())
            elif o is K.RANGE and a[1] - a[0] < 8:
                chars |= {chr(x).lower() for x in range(a[0], a[1] + 1)}
            else:
                return None, []
        return (chars, []) if len(chars) <= 8 else (None, [])
    if op is K.SUBPATTERN:
        return _walk(arg[-1])
    if op is K.ATOMIC_GROUP:
        return _walk(arg)
    if op is K.BRANCH:
        parts = [_walk(b) for b in arg[1]]
        if all(p is not None and not n for p, n in parts) and sum(len(p) for p, _ in parts) <= MAX_EXACT:
            return set().union(*(p for p, _ in parts)), []
        return None, [_or([_and([*n, _close(p)] if p is not None else n) for p, n in parts])]
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        lo, hi, body = arg
        part, need = _walk(body)
        if lo == 0:
            return (part | {""}, []) if hi == 1 and part is not None and not need else (None, [])
        if part is not None and lo == hi and lo <= 4 and len(part) ** lo <= MAX_EXACT:
            out = {""}
            for _ in range(lo):
                out = {a + b for a in out for b in part}
            return out, need
        return None, [*need, *([_close(part)] if part is not None else [])]
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return {""}, []
    return None, []


def required(pattern: str):
    """A query that every text with a match of pattern fulfils."""
    exact, need = _walk(_parser.parse(pattern))
    return _and([*need, *([_close(exact)] if exact is not None else [])])


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_of(q) for q in query[1]))


class Segment:
    """The postings of one batch of texts, for the trigrams of interest: sorted numbers of the texts in which each occurs.

    Long texts are indexed in chunks that overlap; a text's number stands for each of its chunks. A query whose matches always fit into an
    overlap must be met within one chunk; others are met by the trigrams of all chunks of a text together.
    """

    def __init__(self, texts: list[str | None], wanted: set[bytes], chunk: int = 8192, overlap: int = 1024):
        code = lambda t: t[0] << 16 | t[1] << 8 | t[2]
        self.of_chunk, parts = [], []
        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t or "") - overlap), chunk - overlap) if t else ():
                parts.append(t[at : at + chunk].lower().encode("utf-8", "replace"))
                self.of_chunk.append(i)
        self.of_chunk = np.asarray(self.of_chunk, np.int64)
        buf = np.frombuffer(b"".join(p + b"\0\0" for p in parts), np.uint8).astype(np.int32)
        owner = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])
        codes = (buf[:-2] << 16 | buf[1:-1] << 8 | buf[2:]) if len(buf) > 2 else np.zeros(0, np.int32)
        want = np.array(sorted(code(t) for t in wanted), np.int32)
        at = np.searchsorted(want, codes).clip(0, max(0, len(want) - 1))
        hit = np.flatnonzero(want[at] == codes) if len(want) else np.zeros(0, np.int64)
        pair = np.unique(codes[hit].astype(np.int64) << 32 | owner[hit])
        tri, doc = pair >> 32, pair & 0xFFFFFFFF
        lo, hi = np.searchsorted(tri, want), np.searchsorted(tri, want, side="right")
        self.postings = {int(c): doc[a:b] for c, a, b in zip(want, lo, hi)}
        self.code, self.all, self.overlap = code, np.arange(len(parts)), overlap

    def _meet(self, q, whole: bool) -> np.ndarray:
        """Numbers of the chunks, or of the whole texts, that fulfil q."""
        if not isinstance(q, tuple):
            c = self.all if q is True else self.postings.get(self.code(q), self.all[:0])
            return np.unique(self.of_chunk[c]) if whole else c
        kind, qs = q
        if kind == "or":
            return np.unique(np.concatenate([self._meet(x, whole) for x in qs]))
        out = None
        for x in qs:
            c = self._meet(x, whole)
            out = c if out is None else out[np.isin(out, c, assume_unique=True)]
            if not len(out):
                break
        return out

    def candidates(self, q, widest: int) -> np.ndarray:
        """Numbers of the texts in which a match of at most `widest` characters can lie."""
        whole = widest > self.overlap
        c = self._meet(q, whole)
        return c if whole else np.unique(self.of_chunk[c])


def widest(pattern: str) -> int:
    """The largest number of characters that a match of pattern, and what it looks at around itself, can have."""
    return _parser.parse(pattern).getwidth()[1] + 64


def compile_rules(rules: dict[str, str]) -> dict[str, tuple[re.Pattern, object, int]]:
    """Of each rule: its expression, the query for its candidates, and the length that a match can have."""
    return {k: (re.compile(p), required(p), widest(p)) for k, p in rules.items()}
