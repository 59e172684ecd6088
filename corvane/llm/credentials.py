"""Credentials in source text: found by regular expressions behind a trigram index, and redacted.

Every batch of texts becomes a segment of a trigram index; each rule's required trigrams select candidates, and only those are
matched. A match shows a place where a credential would stand; whether the value there is one is decided by its form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.trigrams import Segment, compile_rules, trigrams_of

HIDDEN = "[REDACTED]"
#: Names of things that hold credentials.
NAME = r"(?:pass(?:w(?:or)?d|phrase|wrd)|pwd|secret|token|api[_-]?key|key|credential|auth|_pass|-pass)"
QUOTED = r"""(?P<q>["'`])(?P<v>[^"'`\n]{6,})(?P=q)"""
BARE = r"""(?P<v>[^\s"'`,;&<>(){}\[\]]{6,})"""
#: Where a credential stands. Group v is the value, w its continuation; both are as long as they are, bounds hold for what stands before.
RULES = {
    "private_key": r"-----BEGIN (?:[A-Z]{2,12} ){0,2}PRIVATE KEY(?: BLOCK)?-----(?:\\r|\\n|\s)*(?P<v>[A-Za-z0-9+/=]{16,}(?:(?:\\r|\\n|\s)+[A-Za-z0-9+/=]{8,})*)",
    "quoted": rf"""(?i){NAME}[\w\-]*["'`\]]*\s*(?:=>|:=|[:=,])\s*[a-z]?{QUOTED}""",
    "bare": rf"(?i){NAME}[\w\-]*\s*[=:]\s*{BARE}",
    "env": rf"(?i)\b(?:env|export|set)\s+\w*{NAME}\w*\s+{BARE}",
    "xml": rf"""(?i){NAME}\w*["']\s+value\s*=\s*["'](?P<v>[^"'\n]{{6,}})["']""",
    "address": r"""(?i)://[^\s/:@"']*:(?P<v>[^\s/@"'{}$]{4,})@""",
    "header": r"(?i)\b(?:basic|bearer) {1,4}(?P<v>[A-Za-z0-9+/=._\-]{16,})",
    "curl": r"""(?i)\bcurl\b[^\n]{0,400}?\s(?:-u|--user)[ =]['"]?[^\s:'"]{1,200}:(?P<v>[^\s'"]{4,})""",
    "shell_pass": r"""(?i)\bsshpass\s+-p\s*['"]?(?P<v>[^\s'"]{4,})""",
    "client_pass": r"""(?i)\b(?:mysql|psql|redis-cli|mongo)[^\n]{0,400}?\s(?:-p|-a )(?P<v>[^\s'"]{6,})""",
    "sql": r"""(?i)\bidentified by\s+['"](?P<v>[^'"\n]{4,})['"]""",
    "login_call": r"""(?i)(?:login|authenticate|sign_?in|connect)\(\s*["'][^"'\n]{1,200}["']\s*,\s*["'](?P<v>[^"'\n]{4,})["']""",
    "comparison": rf"(?i)\b(?:given|entered|supplied|typed|\w*{NAME})\s*={{2,3}}\s*{QUOTED}",
    "note": r"(?i)\b(?:login|password|account|credentials?)\b[^\n:]{0,200}:\s*\S{1,100} / (?P<v>\S{6,})",
    "split": r"""(?P<q>["'`])(?P<v>[\w+/=.!#%*?\-]{4,})(?:" \+ "|' \+ '|` \+ `|"\+"|'\+'|" "|' '|" \. "|' \. ')(?P<w>[\w+/=.!#%*?\-]{4,})(?P=q)""",
    "webhook": r"(?i)https?://hooks?\.[^\s\"']{4,300}/(?P<v>[A-Za-z0-9]{16,})",
    "hashed_pair": r"""(?i)(?:md5|sha1|sha256|b64encode)\(\s*b?["'][\w.\-]{1,100}:(?P<v>[^"'\s]{8,})["']""",
    "known_form": r"(?P<v>gh[pousr]_[A-Za-z0-9]{30,}|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|xox[abprs]-[A-Za-z0-9-]{10,}|[srp]k_(?:live|test)_\w{16,}|AIza[\w-]{35}|glpat-[\w-]{20,}|npm_[A-Za-z0-9]{36}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})",
}
#: In reports of a scanner the value stands without its place: any word of the form of a credential. This requires no trigram.
REPORT = {"report": r"(?<![\w<{])(?P<v>[^\s\"'`<>]{8,})"}

PLACEHOLDER = re.compile(r"(?i)example|change.?me|placeholder|your[-_ ]|insert|replace|dummy|redacted|masked|\bnone\b|\bnull\b|todo|x{6,}|\*{3,}|\.{3,}|…|#{4,}")
REFERENCE = re.compile(r"^[$<{/\\]|^%[sd({]|^!?[a-z]+$|^\(|\$\{|\{\{|\}\}|^(?:env|vault|secret|ref|ssm|arn|file|https?|data|urn):|^(?:process|os|settings|config|self|this|request)\.")
DIGEST = re.compile(r"(?i)^(?:sha\d+|md5)[-:=]|^[a-z_]+:[0-9a-f]{8,}$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
#: A run of letters is one word or none: nothing is tried twice, however long the value.
_WORD = r"(?>[a-z]+(?![A-Za-z])|[A-Z]+(?![A-Za-z])|(?:[A-Z][a-z]{2,}|[a-z]{2,})(?:[A-Z][a-z]{2,})*)"
WORDS = re.compile(rf"^{_WORD}(?:[_.\-: /,]++{_WORD})*+[_.\-:?!,]*$")
COMPILED = compile_rules(RULES)
REPORT_COMPILED = compile_rules(REPORT)
WANTED = set().union(*(trigrams_of(q) for _, q, _ in COMPILED.values()))
#: Rules whose place is weak, so that the value must look random.
WEAK = {"split", "comparison", "report", "hashed_pair"}


def looks_random(v: str) -> bool:
    kinds = bool(re.search("[a-z]", v)) + bool(re.search("[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^\w\-./:]", v))
    return kinds >= 2 or len(v) >= 20 and len(set(v)) >= 10


def is_secret(v: str, weak: bool = False) -> bool:
    """Whether a value is one that could be used: not a placeholder, mask, reference, digest or plain words."""
    if len(v) < 6 or len(set(v)) < 4 or len(set(v[-12:])) < 3 or PLACEHOLDER.search(v) or REFERENCE.search(v) or DIGEST.search(v) or WORDS.match(v):
        return False
    if not re.search(r"[A-Za-z]", v) or re.fullmatch(r"[\w.]+\(.*\)?", v):
        return False
    return not weak or looks_random(v)


def spans(text: str, rules: dict | None = None, names: set[str] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the credential values in text, by the rules of the given names."""
    out = []
    for name, (rx, *_) in (rules or COMPILED).items():
        if names is not None and name not in names:
            continue
        for m in rx.finditer(text):
            v = m["v"]
            if name == "report":
                lead = text[: m.start()].lower()
                cut = re.match(r"[a-z_]{1,12}=(?!=|$)", v)
                start, v = m.start("v") + (cut.end() if cut else 0), v[cut.end() :] if cut else v
                v = v.rstrip(",;)") if "(" not in v else v
                if re.search(r"(?:commit|sha\d*|digest|checksum|revision)[ :=]$", lead) or not is_secret(v, True):
                    continue
                out.append((start, start + len(v), name))
            elif name == "split":
                if is_secret(v + m["w"], True) and len(v + m["w"]) >= 12:
                    out += [(m.start("v"), m.end("v"), name), (m.start("w"), m.end("w"), name)]
            elif name == "private_key" or is_secret(v.rstrip(";") if name == "bare" else v, name in WEAK):
                out.append((m.start("v"), m.end("v"), name))
    return sorted(out)


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """text with each span hidden and everything else as it was; overlapping spans are hidden together."""
    out, at = [], 0
    for a, z, _ in found:
        if a >= at:
            out += [text[at:a], HIDDEN]
        at = max(at, z)
    return "".join(out) + text[at:]


def scan_batch(code: list[str | None], report: list[str | None]) -> list[tuple[list, list]]:
    """Spans of each (code, report) pair; code is matched by candidates of the index, a report also by the values of its code."""
    both = [*code, *report]
    seg = Segment(both, WANTED)
    names: dict[int, set[str]] = {}
    for name, (_, q, most) in COMPILED.items():
        for i in seg.candidates(q, most):
            names.setdefault(int(i), set()).add(name)
    out = []
    for i, (c, r) in enumerate(zip(code, report)):
        fc = spans(c, names=names[i]) if c and i in names else []
        j = i + len(code)
        fr = spans(r, names=names[j]) if r and j in names else []
        if r:
            fr += spans(r, REPORT_COMPILED)
            joined = "".join(c[a:z] for a, z, n in fc if n == "split")
            for v in {c[a:z] for a, z, n in fc if n != "split"} | ({joined} if joined else set()):
                if len(v) >= 6:
                    fr += [(m.start(), m.end(), "same") for m in re.finditer(re.escape(v), r)]
        out.append((fc, sorted(fr)))
    return out


def scan(df: DataFrame, row_id: str = "id", code: str = "snippet", report: str = "evidence") -> DataFrame:
    """(id, snippet, evidence, snippet_rules, evidence_rules): both fields redacted, and the rules that found a value in them.

    Every row comes out; a field without a credential is unchanged and its rules are empty. Null fields stay null. Whole texts are
    scanned. Nothing is shuffled: each batch is a segment of the index by itself. Repeated rows are treated alike.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c, r = ([x if isinstance(x, str) else None for x in pdf[k]] for k in ("c", "r"))
            found = scan_batch(c, r)
            yield pd.DataFrame({
                row_id: pdf["i"],
                code: [redact(x, f) if f else x for x, (f, _) in zip(c, found)],
                report: [redact(x, f) if f else x for x, (_, f) in zip(r, found)],
                f"{code}_rules": [sorted({n for *_, n in f}) for f, _ in found],
                f"{report}_rules": [sorted({n for *_, n in f}) for _, f in found],
            })

    d = df.select(F.col(row_id).alias("i"), F.col(code).alias("c"), F.col(report).alias("r"))
    return d.mapInPandas(run, f"`{row_id}` string, `{code}` string, `{report}` string, `{code}_rules` array<string>, `{report}_rules` array<string>")


def found(df: DataFrame, row_id: str = "id", code: str = "snippet", report: str = "evidence") -> DataFrame:
    """(id, field_name) of the fields that show a credential; repeated rows count once."""
    s = scan(df, row_id, code, report)
    both = F.filter(F.array(F.when(F.size(f"{code}_rules") > 0, F.lit(code)), F.when(F.size(f"{report}_rules") > 0, F.lit(report))), lambda x: x.isNotNull())
    return s.select(row_id, F.explode(both).alias("field_name")).distinct()
