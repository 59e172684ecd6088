"""Files that were not written by hand in their repository: minified, generated, copied from elsewhere, or data kept as code.

Linear support-vector classifiers, one for each kind, see hashed character n-grams of a block of comments, of the code and of its
shape, path components, and bins of size. A file may have many blocks of comments, and a banner may stand in any of them: a kind's
margin is that with the block that speaks most for it, in fitting as in scoring. The machines are fitted on a bounded sample that
labelling rules mark. Banners that give a file away are masked in half of the rows that are fitted, so that path and code must tell
by themselves; rows that nothing but a banner marks are left out when it is masked. Thresholds are set on repositories that are
held out, with all their comments masked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut

KINDS = ("minified", "generated", "vendored", "data")
#: Sizes of the hashed views, in order: comments, code, shape of the code, path, bins.
DIMS = {"comment": 4096, "body": 4096, "shape": 4096, "path": 4096, "bins": 512}
OFFSET = dict(zip(DIMS, np.cumsum([0, *DIMS.values()])))
N_DIMS = sum(DIMS.values())
WEIGHT = {"comment": 1.5, "body": 0.5, "shape": 1.0, "path": 1.2, "bins": 0.7}
MOST_BLOCKS = 32  # blocks of comments of a file that is fitted; of a file that is classified all are seen

#: Labelling rules for a block of comments: what tools and authors commonly write there. Fixed patterns.
BANNERS = {
    "generated": re.compile(
        r"""(?ix)\bauto(?:matically)?[- ]?generated\b|@generated\b|\bmachine[- ](?:generated|written|made)\b
        |\b(?:generated|regenerated)\s+(?:automatically|by|from|with|using|on|at)\b
        |\b(?:do\s+not|don't|never|must\s+not|should\s+not)\s+(?:be\s+)?(?:edit|modif|touch|chang)\w*(?:\s+(?:it|me|this(?:\s+(?:file|code))?|the\s+file|by\s+hand|manually|directly|here))*\s*(?:[.!;,*\-)]|$|\n)
        |\b(?:edits|changes|modifications)\b[^\n]{0,60}\b(?:lost|overwritten|discarded)
        |\b(?:emitted|produced|created|built|written)\s+by\s+(?:an?|the)?\s*(?:\w+\s+)?(?:tool|compiler|generator|script|codegen)\b
        |\b(?:emitted|produced|built)\s+by\s+\S+\s+(?:on|at|for|during)\s+(?:each|every)\b""", re.M),
    "vendored": re.compile(
        r"""(?ix)@license\b|@preserve\b|\bspdx-filecopyrighttext\b|\bupstream\b|\bpermission\s+(?:is\s+hereby\s+granted|to\s+use|to\s+copy)\b
        |(?:\(c\)|©|\bcopyright)\s+(?:\(c\)\s+)?(?:[\d,\s-]*\s)?the\s+[\w .-]{1,60}?\b(?:authors|contributors|foundation|developers|team|maintainers)\b
        |\bv?\d+\.\d+(?:\.\d+)*\b[^*]{0,20}(?:[\s*/\#]*\bhttps?:\S+)?[\s*/\#|,-]*(?:released|distributed|licen[sc]ed|available)\s+under\b
        |^\W*(?:vendored|imported|copied|taken|mirrored|forked|ported)\b[^\n]{0,80}(?:\bfrom\b|\bof\b|\bverbatim\b|\bunchanged\b|@)""", re.M),
}
PATH_RULES = {
    "minified": re.compile(r"(?i)[.\-]min\.(?:js|css|mjs)$|\.bundle\.js$|(?:^|/)chunk[-.][\w-]+\.\w+\.js$"),
    "generated": re.compile(r"(?i)\.g\.\w+$|\.pb\.\w+$|_pb2(?:_grpc)?\.py$|grpc\.java$|\.designer\.cs$|\.generated\.\w+$|_gen\.go$|(?:^|/)generated/"),
    "vendored": re.compile(r"(?:^|/)(?:node_modules|bower_components|site-packages|[Tt]hird[_-]?[Pp]arty|3rdparty|Godeps|vendor|jspm_packages|Pods|Carthage)/|(?:^|packages/[^/]+/)external/[^/]+/"),
    "data": re.compile(r"(?!)"),
}
#: A block of comments begins a line: lines of comments in a row, or one comment that has an end of its own.
BLOCK = re.compile(
    r"""(?xm)(?:^[ \t]*(?://|\#(?![ \t]*(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma|error|region|endregion)\b)|--|;;|;[ \t])[^\n]*(?:\n|\Z))+
    |^[ \t]*(?:/\*[^*]*(?:\*(?!/)[^*]*)*(?:\*/|\Z)|<!--[^-]*(?:-(?!->)[^-]*)*(?:-->|\Z)|\"\"\"[^"]*(?:"(?!"")[^"]*)*(?:\"\"\"|\Z))"""
)


def split_comments(text: str) -> tuple[list[str], str]:
    """(blocks of comments, each once, in order; the code) of a file's whole text."""
    return list(dict.fromkeys(m[0].strip() for m in BLOCK.finditer(text))), BLOCK.sub("", text)


def body_rules(body: str) -> set[str]:
    """Kinds that the form of the text marks: dense code with few blanks in long lines, or mostly numbers and encoded bytes."""
    if len(body) < 200:
        return set()
    lines = body.split("\n")
    longest = max(map(len, lines))
    digits = sum(map(body.count, "0123456789"))
    dense = sum(map(body.count, "(){};=&?:!,")) / len(body)
    words = len(re.findall(r"[A-Za-z_]{2,}", body))
    encoded = max((len(m) for m in re.findall(r"[A-Za-z0-9+/=]{200,}", body)), default=0)
    if encoded > 0.5 * len(body) or (digits > 0.3 * len(body) and len(body) > 600) or len(re.findall(r"0x[0-9a-fA-F]{2}\b", body)) * 5 > 0.5 * len(body) or (digits > 0.2 * len(body) and longest > 600):
        return {"data"}
    blanks = (body.count(" ") + body.count("\t")) / len(body)
    if words > 10 and dense > 0.1 and (longest > 400 and longest > 0.3 * len(body) and blanks < 0.12 or len(body) > 60 * len(lines) and blanks < 0.08):
        return {"minified"}
    return set()


def path_labels(path: str | None) -> set[str]:
    return {k for k, r in PATH_RULES.items() if path and r.search(path)}


def banner_labels(blocks: list[str]) -> set[str]:
    return {k for k, r in BANNERS.items() if any(r.search(b) for b in blocks)}


def rule_labels(path: str | None, text: str | None) -> tuple[set[str], set[str]]:
    """(kinds marked by path or code, kinds marked by a block of comments)."""
    blocks, body = split_comments(text) if text else ([], "")
    return path_labels(path) | body_rules(body), banner_labels(blocks)


def _hash(codes: np.ndarray, dims: int) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % dims


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1], _SHAPE[ord("A") : ord("Z") + 1], _SHAPE[ord("0") : ord("9") + 1], _SHAPE[128:] = ord("a"), ord("A"), ord("0"), ord("u")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def ngrams(b: np.ndarray, n: int) -> np.ndarray:
    if len(b) < n:
        return np.zeros(0, np.uint64)
    c = np.zeros(len(b) - n + 1, np.uint64)
    for i in range(n):
        c = (c << np.uint64(8)) | b[i : len(b) - n + 1 + i]
    return c


def _view(name: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    n = np.bincount(_hash(codes, DIMS[name]), minlength=DIMS[name])
    i = np.flatnonzero(n)
    v = np.log1p(n[i]).astype(np.float32)
    return (i + OFFSET[name]).astype(np.int32), v * (WEIGHT[name] / np.linalg.norm(v))


def _tokens(ts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in ts], dtype=np.uint64)


def path_tokens(path: str) -> list[str]:
    """Path components with their places, the name's shape and its endings."""
    parts = path.split("/")
    name, dirs = parts[-1], parts[:-1]
    if len(dirs) >= 2 and dirs[0] == "packages":
        dirs = dirs[2:]
    t = [f"dir:{d.lower()}" for d in dirs] + [f"at{i}:{d.lower()}" for i, d in enumerate(dirs[:3])] + [f"in:{a.lower()}>{b[:1].isupper()}" for a, b in zip(dirs, dirs[1:])]
    stem = re.split(r"[._\-]|(?<=[a-z])(?=[A-Z])", name)
    t += [f"end{k}:{'|'.join(stem[-k:]).lower()}" for k in (1, 2) if len(stem) >= k]
    ends = re.findall(r"[._\-][A-Za-z0-9]+", name)
    t += [f"marks:{''.join(e[0] for e in ends)}", f"last:{''.join(ends[-2:]).lower()}", f"start:{stem[0].lower()}"]
    return t


Sparse = tuple[np.ndarray, np.ndarray]  # indexes and values


@dataclass
class Features:
    blocks: list[Sparse]  # of each block of comments
    code: Sparse  # of code, shape, path and bins
    alone: Sparse  # of the path, as for a file without text


def block_features(block: str) -> Sparse:
    b = _LOWER[np.frombuffer(re.sub(r"\d+", "0", block).encode("utf-8", "replace"), np.uint8)]
    return _view("comment", np.concatenate([ngrams(b, n) for n in (4, 6)]))


def _joined(*views: Sparse) -> Sparse:
    return np.concatenate([v[0] for v in views]), np.concatenate([v[1] for v in views])


def features(path: str | None, size: float | None, loc: float | None, text: str | None, memo: dict | None = None) -> Features:
    """A file's features; whole texts are read. Missing fields have no features of their view but a mark. memo keeps those of blocks that come again."""
    blocks, body = split_comments(text) if text else ([], "")
    memo = {} if memo is None else memo
    if len(memo) > 20_000:
        memo.clear()
    b = np.frombuffer(body.encode("utf-8", "replace"), np.uint8)
    bins = ["text" if text else "no-text"]
    if text:
        n = max(1, len(b))
        lines = body.split("\n")
        longest = max(map(len, lines))
        bins += [f"longest:{int(np.log2(longest + 1))}", f"mean:{int(np.log2(n / len(lines) + 1))}", f"digits:{int(10 * np.count_nonzero((b >= 48) & (b < 58)) / n)}", f"space:{int(10 * np.count_nonzero(b <= 32) / n)}", f"size:{int(np.log2(n))}", f"share:{int(10 * longest / n)}"]
    if size is not None and loc is not None and size > 0 and loc > 0:
        bins.append(f"line:{int(2 * np.log2(size / loc + 1))}")
    where = _view("path", _tokens(path_tokens(path)) if path else np.zeros(0, np.uint64))
    seen = [memo[x] if x in memo else memo.setdefault(x, block_features(x)) for x in blocks]
    return Features(seen, _joined(_view("body", ngrams(_LOWER[b], 4)), _view("shape", ngrams(_SHAPE[b], 6)), where, _view("bins", _tokens(bins))), _joined(where, _view("bins", _tokens(["no-text"]))))


def fit_svms(rows: list[tuple[Sparse, list[Sparse], np.ndarray]], seed: int, epochs: int = 10, lam: float = 2e-4) -> np.ndarray:
    """Weights (dims + 1 rows, the last the biases; a column for each kind) of linear support-vector machines.

    rows: (features, blocks of comments, label of each kind: 1, -1, or 0 where it is not fitted). Hinge loss with averaged stochastic
    subgradients; the classes of a kind weigh alike. Of several blocks a step takes, for each kind, the one with the largest margin so far.
    """
    k = len(KINDS)
    rng = np.random.default_rng(seed)
    w, total, scale, step, kept = np.zeros((N_DIMS + 1, k)), np.zeros((N_DIMS + 1, k)), 1.0, 0, 0
    y_all = np.array([y for *_, y in rows])
    pos, neg = (y_all > 0).sum(0), (y_all < 0).sum(0)
    up = np.clip(neg / np.maximum(1, pos), 1.0, 10.0)
    for e in range(epochs):
        for r in rng.permutation(len(rows)):
            (i, v), blocks, y = rows[r]
            step += 1
            rate = 1.0 / (lam * (step + 1.0 / lam))
            scale *= 1 - rate * lam
            m = v @ w[i]
            if blocks:
                s = np.array([bv @ w[bi] for bi, bv in blocks])
                best = s.argmax(0)
                m = m + s[best, np.arange(k)]
            g = np.where(y * (scale * m + w[-1]) < 1, rate * y * np.where(y > 0, up, 1.0), 0.0)
            if g.any():
                w[i] += v[:, None] * (g / scale)
                w[-1] += 0.1 * g
                for c in np.flatnonzero(g) if blocks else ():
                    bi, bv = blocks[best[c]]
                    w[bi, c] += bv * (g[c] / scale)
            if scale < 1e-6:
                w[:-1] *= scale
                scale = 1.0
        if e >= epochs // 2:
            total += np.r_[w[:-1] * scale, w[-1:]]
            kept += 1
    return total / max(1, kept)


@dataclass
class Model:
    weights: np.ndarray  # (dims + 1) x kinds
    thresholds: np.ndarray
    held_out: dict[str, tuple[int, int, int, int, int]] | None = None  # by kind: files marked, found, rightly found; marked by path or code, found of these with comments masked

    def margins(self, f: Features, mask: bool = False) -> np.ndarray:
        """Margins of a file's kinds; mask leaves its comments out."""
        i, v = f.code
        m = v @ self.weights[i] + self.weights[-1]
        if f.blocks and not mask:
            m = m + np.max([bv @ self.weights[bi] for bi, bv in f.blocks], axis=0)
        return m


def fit(sample: list[tuple[str, Features, set[str], set[str], set[str]]], seed: int = 5) -> Model:
    """sample: (repository, features, kinds by path or code, kinds by a banner, kinds by the path).

    Every other row is fitted with its comments masked, but not for kinds that only a banner marks, and every third row also by its path alone, for files whose text is missing.
    """
    held = [xxhash.xxh64_intdigest(str(r)) % 5 == 0 for r, *_ in sample]
    rows, at = [], 0
    for (_, f, strong, banner, by_path), h in zip(sample, held):
        if h:
            continue
        y = np.array([1 if k in strong or k in banner else -1 for k in KINDS], float)
        if at % 2:
            rows.append((f.code, [], np.where([k in banner and k not in strong for k in KINDS], 0.0, y)))
        if not at % 2 or banner - strong:
            rows.append((f.code, f.blocks, y))
        if at % 3 == 0:
            rows.append((f.alone, [], np.array([1.0 if k in by_path else 0.0 if k in strong or k in banner else -1.0 for k in KINDS])))
        at += 1
    if not rows:
        return Model(np.zeros((N_DIMS + 1, len(KINDS)), np.float32), np.full(len(KINDS), np.inf), {})
    model = Model(fit_svms(rows, seed).astype(np.float32), np.zeros(len(KINDS)), {})
    out = [x for x, h in zip(sample, held) if h]
    masked, whole = (np.array([model.margins(f, mask=m) for _, f, *_ in out]).reshape(-1, len(KINDS)) for m in (True, False))
    for n, kind in enumerate(KINDS):
        if not any(kind in s or kind in b for _, _, s, b, _ in sample):
            model.thresholds[n] = np.inf
            continue
        t = np.array([kind in s for _, _, s, _, _ in out], bool)
        other = np.array([kind in b and kind not in s for _, _, s, b, _ in out], bool)  # what only a banner marks cannot be told without it
        best = (-1.0, 0.0)
        for th in np.linspace(-0.6, 0.6, 25):
            hit = (masked[:, n] >= th) & ~other
            f1 = 2 * (hit & t).sum() / max(1, hit.sum() + t.sum())
            best = max(best, (float(f1) - 0.05 * abs(th), float(th)))  # rules miss some cases: a gain must be worth the distance from 0
        model.thresholds[n] = th = best[1] if t.any() else 0.0
        hit = whole[:, n] >= th
        model.held_out[kind] = (int((t | other).sum()), int(hit.sum()), int((hit & (t | other)).sum()), int(t.sum()), int((t & (masked[:, n] >= th)).sum()))
    return model


def _row_features(pdf: pd.DataFrame, memo: dict) -> Iterator[Features]:
    num = lambda x: None if x is None or x != x else float(x)
    for p, s, l, t in zip(pdf["path"], pdf["size_bytes"], pdf["lines_of_code"], pdf["content"]):
        yield features(p if isinstance(p, str) else None, num(s), num(l), t if isinstance(t, str) else None, memo)


FIELDS = ["id", "repository_id", "path", "size_bytes", "lines_of_code", "content"]


def _bytes(f: Sparse) -> tuple[bytes, bytes]:
    return f[0].astype(np.int32).tobytes(), f[1].astype(np.float32).tobytes()


def _sparse(i: bytes, v: bytes) -> Sparse:
    return np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)


def sample_rows(files: DataFrame, most: int) -> list[tuple[str, Features, set[str], set[str], set[str]]]:
    """Features and rule labels of about `most` files, chosen by a hash of id, repository and path, and at most 1.2 times as many.

    Features are computed where the rows are; the limit after that only takes effect where many rows have the same id. Of a file with
    many blocks of comments, those with a banner are kept first.
    """
    n = files.count()
    share = int(np.ceil(1_000_000 * min(1.0, most / max(1, n))))
    d = files.where(F.pmod(F.xxhash64("id", "repository_id", "path"), F.lit(1_000_000)) < share).select(*FIELDS)
    cols = ["repository_id", "ci", "cv", "ai", "av", "bi", "bv", "by_path", "strong", "banner"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for pdf in batches:
            rows = []
            for r, p, t, f in zip(pdf["repository_id"], pdf["path"], pdf["content"], _row_features(pdf, memo)):
                p, t = p if isinstance(p, str) else None, t if isinstance(t, str) else None
                strong, banner = rule_labels(p, t)
                kept = f.blocks
                if len(kept) > MOST_BLOCKS:
                    told = [bool(banner_labels([b])) for b in split_comments(t)[0]]
                    kept = [kept[i] for i in np.argsort(~np.array(told), kind="stable")[:MOST_BLOCKS]]
                blocks = [_bytes(b) for b in kept]
                rows.append((r, *_bytes(f.code), *_bytes(f.alone), [b[0] for b in blocks], [b[1] for b in blocks], sorted(path_labels(p)), sorted(strong), sorted(banner)))
            yield pd.DataFrame(rows, columns=cols)

    got = d.mapInPandas(run, "repository_id string, ci binary, cv binary, ai binary, av binary, bi array<binary>, bv array<binary>, by_path array<string>, strong array<string>, banner array<string>").limit(int(1.2 * most)).toPandas()
    return [(r[0], Features([_sparse(i, v) for i, v in zip(r[5], r[6])], _sparse(r[1], r[2]), _sparse(r[3], r[4])), set(r[8]), set(r[9]), set(r[7])) for r in got[cols].itertuples(index=False)]


def classify(files: DataFrame, most: int = 8000, seed: int = 5) -> DataFrame:
    """(id, kind, margin) of the files that are not hand-written: the kind with the largest margin above its threshold.

    files: id, repository_id, path, size_bytes, lines_of_code, content, is_text. Files that are no text (is_text false) are left out.
    Null contents are judged by path and sizes; null, zero or negative sizes are not used. A file scanned twice is judged twice,
    alike. An empty table gives no rows. The sample for fitting has about `most` files; every file is classified, by its whole text.
    """
    d = files.where(F.coalesce(F.col("is_text"), F.lit(True))).select(*FIELDS)
    model = fit(sample_rows(d, most), seed)
    shared = files.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, memo = Model(*shared.value), {}
        for pdf in batches:
            over = np.array([m.margins(f) - m.thresholds for f in _row_features(pdf, memo)]).reshape(len(pdf), len(KINDS))
            best = over.argmax(1)
            top = over[np.arange(len(pdf)), best]
            ok = top >= 0
            yield pd.DataFrame({"id": pdf["id"][ok], "kind": [KINDS[k] for k in best[ok]], "margin": top[ok]})

    return d.mapInPandas(run, "id string, kind string, margin double")


def handwritten(files: DataFrame, most: int = 8000) -> DataFrame:
    """The rows of files, all columns, that are text and hand-written."""
    bad = cut(classify(files, most)).select(F.col("id").alias("__id")).distinct()
    return files.where(F.coalesce(F.col("is_text"), F.lit(True))).join(bad, F.col("id") == F.col("__id"), "left_anti")
