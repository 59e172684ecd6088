"""Defects of question and answer pairs, by a conditional random field over the clauses of the answer.

Each clause is tagged as answer, refusal, echo (of the question), foreign (another language than the one expected), unfinished or
empty. The tags' shares of the answer give the pair's defect. The field is a linear chain over what can be observed: words and pairs of
words, the overlap with the question, languages, and the shape of the answer's end. It is fitted on a bounded sample of pairs from
the data, whose clauses labelling rules mark, and on a few general examples; the rules have no part in the tagging.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import conversations as C
from corvane.llm.languages import asked_language, language
from corvane.session import cut

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished", "empty")
N_SEEN, N_FEATURES = 1 << 13, 1 << 16  # features of what is seen come first, those of words after them
#: Contents that stand for no answer; fixed values.
FILLERS = frozenset((
    "null", "none", "nil", "nan", "undefined", "n/a", "na", "no content", "no answer", "no response", "no reply", "empty", "blank", "todo", "tbd", "tba", "answer", "response", "reply", "assistant", "output", "result", "placeholder",
    "lorem ipsum", "pending", "antwort", "respuesta", "réponse", "resposta", "keine antwort", "sin respuesta", "sans réponse", "sem resposta",
))
#: General examples of declining, so that the field knows some before it sees data; fixed values.
SEED_REFUSALS = (
    "I cannot help with that.", "I'm sorry, but I can't answer this question.", "Sorry, I am not able to assist with this request.", "I would rather not discuss that.", "As an AI model I cannot provide this information.", "No comment.", "I don't know.",
    "Das kann ich leider nicht beantworten.", "Dabei kann ich nicht helfen.", "Es tut mir leid, dazu gebe ich keine Auskunft.", "No puedo responder a esa pregunta.", "Lo siento, no puedo ayudar con eso.",
    "Je ne peux pas répondre à cette question.", "Désolé, je ne suis pas en mesure d'aider.", "Não posso ajudar com isso.", "Desculpe, prefiro não responder.",
)
#: Expressions by which a speaker declines; fixed patterns. They mark clauses for fitting.
DECLINES = re.compile(
    r"""(?ix)\b(?:
    (?:i|we)(?:\s+am|'m|’m|\s+are|'re)?\s+(?:\w+\s+){0,3}?(?:can(?:no|'|’)?t|cannot|unable\s+to|not\s+able\s+to|not\s+allowed\s+to|not\s+permitted\s+to|not\s+going\s+to|won(?:'|’)t|will\s+not|must\s+decline\s+to|have\s+to\s+decline|decline\s+to|must\s+refuse\s+to|(?:woul)?d\s+rather\s+not|prefer\s+not\s+to)\s+(?:\w+\s+){0,2}?(?:answer|help|assist|discuss|comment|provide|respond|share|say|speculate|talk|do\s+that|look|reveal|disclose|guess)
    |(?:i|we)(?:'d|’d)\s+rather\s+not|(?:i|we)\s+(?:have\s+to|must)\s+(?:pass|leave\s+(?:it|this)|decline|refuse)
    |apologies,?\s+i\s+cannot|(?:outside|beyond)\s+(?:of\s+)?(?:my|what\s+i)|i\s+(?:have|do\s+not\s+have|don(?:'|’)t\s+have)\s+(?:no\s+|any\s+)?(?:information|access|knowledge)\b|as\s+an?\s+(?:ai|assistant|language\s+model)\b
    |not\s+a\s+(?:subject|topic)\s+i\b|(?:told|asked|instructed)\s+not\s+to\s+(?:share|discuss|say|answer|reveal)|(?:in)?appropriate\s+for\s+me|not\s+let\s+me\s+(?:respond|answer)|permit\s+me\s+to|for\s+me\s+to\s+say\s+anything|leave\s+it\s+unanswered|nope,?\s+won(?:'|’)t|won(?:'|’)t\s+do\s+that|no\s+comment|i\s+don(?:'|’)t\s+know
    |is\s+there\s+(?:something|anything)\s+else|(?:can|may)\s+i\s+help\s+(?:you\s+)?with\s+(?:something|anything)\s+else|ask\s+me\s+(?:something|anything)\s+else
    |please\s+(?:ask|contact|consult)\s+(?:a|an|the|someone|somebody|your)\b|let(?:'|’)s\s+talk\s+about\s+something\s+else
    |no\s+(?:answer|reply|comment)\s+(?:can|could|will)\s+be\s+(?:given|provided)|try\s+rephrasing|(?:this|that|your)\s+(?:question|request)\s+(?:exceeds|falls\s+(?:beyond|outside)|goes\s+beyond)
    |übersteigt\s+mein|nicht\s+befugt|(?:supera|excede)\s+mi|no\s+tengo\s+permi|dépasse\s+(?:mon|ma|mes|le\s+cadre)|pas\s+autorisé|não\s+tenho\s+permiss|(?:foge|ultrapassa)\s+(?:d[oa]\s+)?(?:meu|minha)
    |(?:kann|darf|möchte|will)\s+ich\s+(?:\w+\s+){0,3}?(?:nicht|keine)|nicht\s+(?:beantworten|helfen|weiterhelfen)|keine\s+auskunft|außerhalb\s+meiner|sage\s+ich\s+(?:\w+\s+){0,2}nichts|tut\s+mir\s+leid|ich\s+(?:kann|darf|weiß)\s+(?:\w+\s+){0,4}?nicht
    |no\s+(?:puedo|podemos|debo)\s+(?:\w+\s+){0,2}?(?:ayudar|responder|contestar|comentar|decir)|prefiero\s+no|no\s+estoy\s+autorizad|lo\s+siento|no\s+(?:dispongo|tengo)\s+(?:\w+\s+){0,2}?(?:información|acceso)|fuera\s+de\s+mi
    |je\s+ne\s+(?:peux|puis|suis|dispose|souhaite)\b|je\s+n(?:'|’)ai\s+(?:pas|aucun)|préfère\s+ne\s+pas|désolée?\b|en\s+dehors\s+de\s+mes
    |não\s+(?:posso|podemos|devo)\s+(?:\w+\s+){0,2}?(?:ajudar|responder|comentar|dizer)|prefiro\s+não|não\s+estou\s+autorizad|desculpe|não\s+(?:disponho|tenho)\s+(?:\w+\s+){0,2}?(?:informa|acesso)|fora\s+d[oa]\s+m
    )|无法回答|不能回答|抱歉|对不起|申し訳|お答えできません|答えられません"""
)
OPENERS = re.compile(r"^\s*(?:>+|[\"“„«'(*_\s-]+|(?:you\s+asked|question|q|user|human|frage|pregunta|pergunta)\s*:\s*)+", re.I)
_WORD = re.compile(r"[^\W_]+(?:[./_][^\W_]+)*")


def visible_words(text: str) -> str:
    """text without markup, code fences that hold nothing, marks and invisible characters."""
    t = re.sub(r"<[^<>]*>|&nbsp;", " ", text)
    t = re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", "", t) if t.isascii() else "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t")
    return re.sub(r"[\s`*_#>|~\-\[\](){}.,:;!?…\"'“”=+/\\]+", " ", t).strip()


def says_nothing(text: str | None) -> bool:
    if text is None:
        return True
    v = visible_words(text).lower()
    return not any(c.isalnum() for c in v) and not any(unicodedata.category(c) == "So" for c in v) or v in FILLERS or v.replace(" ", "/") in FILLERS


def clauses(text: str) -> list[str]:
    """Sentences and lines of text; a fenced block of code is one clause."""
    out = []
    for i, part in enumerate(re.split(r"(```.*?(?:```|\Z))", text, flags=re.S)):
        if i % 2:
            out.append(part)
        else:
            out += [s for s in re.split(r"(?<=[.!?])[\"'”»)]*\s+|(?<=[。！？])\s*|\s*[\r\n]+\s*", part) if s and s.strip()]
    return out


def ending(text: str) -> str:
    """How a text ends: a kind of whole ending, or open_<why>."""
    t = text.rstrip().rstrip("​‍️")
    if t.count("```") % 2:
        return "open_fence"
    if t.endswith("```"):
        return "fence"
    line = t.rsplit("\n", 1)[-1].strip()
    if line.startswith("|"):
        return "row" if line.endswith("|") else "open_row"
    if line.count("`") % 2:
        return "open_code"
    core = line.rstrip("\"'”»*_`")
    words = re.findall(r"[^\W\d_]{2,}", re.sub(r"`[^`]*`|(?<!\S)\S*[/\\._]\S+|\b[A-Z]\w*[A-Z]\w*", " ", line))
    if core.endswith(("...", "…")):
        return "open_dots"
    if core.endswith((".", "!", "?", "。", "！", "？")):
        return "stop"
    if core and unicodedata.category(core[-1]) in ("So", "Sk"):
        return "sign"
    if core.endswith(")"):
        return "bracket" if core.count("(") <= core.count(")") else "open_bracket"
    if core.count("(") > core.count(")"):
        return "open_bracket"
    if core.endswith((":", ",", ";", "-", "–", "(")):
        return "open_mark"
    if re.match(r"(?:[-*•+]|\d+[.)])\s", line) and len(words) <= 4:
        return "item"
    if re.match(r"(?:\*\*|__)?[^\W\d_][\w ]{0,24}:(?:\*\*|__)?\s*\S+$", line) and len(words) <= 4:
        return "field"
    if line.startswith("#") and len(words) <= 8:
        return "heading"
    if len(re.findall(r"\w+", t)) <= 1 or not re.findall(r"[^\W\d_]{2,}", re.sub(r"`[^`]*`|(?<!\S)\S*[/\\._]\S+|\b[A-Z]\w*[A-Z]\w*", " ", t)):
        return "bare"
    return "open_words"


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def declines(clause: str) -> bool:
    """Whether a clause has an expression of declining, and does not turn to an answer after it."""
    if not DECLINES.search(clause):
        return False
    turns = re.search(r"(?i)\bbut\b|\bso\b|which is why|\bhowever\b|\baber\b|\bpero\b|\bmais\b|\bmas\b", clause[clause.find(" ") :])
    return not turns or bool(re.search(r"(?i)sorry, but|leid, aber|siento, pero|désolé, mais|desculpe, mas|so i have to|and will not", clause))


def end_shape(text: str) -> list[str]:
    """What can be seen at the end of a text: its last signs, the kind of its last line, what is left open, how many words that line has."""
    t = text.rstrip().rstrip("\u200b\u200d\ufe0f")
    line = t.rsplit("\n", 1)[-1].strip()
    core = line.rstrip("\"'”»*_`")
    c = core[-1:] or "none"
    sign = "dots" if core.endswith(("...", "…")) else c if c in ".!?:,;-–)(|。！？" else "letter" if c.isalpha() else "digit" if c.isdigit() else "sign" if unicodedata.category(c[0]) in ("So", "Sk") else "other"
    kind = "row" if line.startswith("|") else "item" if re.match(r"(?:[-*•+]|\d+[.)])\s", line) else "field" if re.match(r"(?:\*\*|__)?[^\W\d_][\w ]{0,24}:(?:\*\*|__)?\s*\S+$", line) else "heading" if line.startswith("#") else "plain"
    no_code = re.compile(r"`[^`]*`|(?<!\S)\S*[/\\._]\S+|\b[A-Z]\w*[A-Z]\w*")
    n = len(re.findall(r"[^\W\d_]{2,}", no_code.sub(" ", line)))
    words = str(n) if n < 5 else "5-8" if n <= 8 else "9+"
    fence = "open" if t.count("```") % 2 else "closed" if t.endswith("```") else "none"
    left = f"{fence}{line.count('`') % 2}{core.count('(') > core.count(')')}"
    bare = len(re.findall(r"\w+", t)) <= 1 or not re.search(r"[^\W\d_]{2,}", no_code.sub(" ", t))
    return [f"sign:{sign}", f"kind:{kind}", f"left:{left}", f"fence:{fence}", f"fence,bare:{fence},{bare}", f"sign,kind,words:{sign},{kind},{words}", f"sign,left:{sign},{left}", f"sign,bare:{sign},{bare}", f"kind,last:{kind},{line[-1:]}", f"sign,kind,left,bare:{sign},{kind},{left},{bare}"]


_codes: dict[str, int] = {}


def code(feature: str) -> int:
    """A hash of a feature; of those seen lately it is remembered."""
    if (h := _codes.get(feature)) is None:
        if len(_codes) > 200_000:
            _codes.clear()
        h = _codes[feature] = xxhash.xxh64_intdigest(feature) & 0x7FFFFFFFFFFFFFFF
    return h


class Pair:
    """What the clauses of an answer look like beside its question. An answer without clauses has one, which is empty."""

    def __init__(self, question: str | None, answer: str | None):
        q, answer = question or "", answer or ""
        self.clauses, self.answer = clauses(answer) or [""], answer
        qt = tokens(q)
        self.q_words, self.q_pairs = set(qt), set(zip(qt, qt[1:]))
        self.expected = asked_language(q) or language(q)
        whole = language(answer)
        self.foreign = whole is not None and self.expected is not None and whole != self.expected
        self.rows = []
        for n, c in enumerate(self.clauses):
            t = tokens(OPENERS.sub("", c))
            fenced = c.startswith("```")
            one = sum(w in self.q_words for w in t) / len(t) if t else 0.0
            two = sum(p in self.q_pairs for p in zip(t, t[1:])) / (len(t) - 1) if len(t) > 1 else one
            lang = None if fenced else (whole if len(self.clauses) == 1 else language(c)) or (whole if len(t) > 2 else None)
            self.rows.append((t, one, two, lang, n == len(self.clauses) - 1, fenced))

    def features(self) -> list[np.ndarray]:
        """Hashed features of each clause; all words of a clause are read."""
        out = []
        seen = visible_words(self.answer).lower()
        short = f"only:{seen}" if len(seen) < 40 else "only:long"
        shown = f"seen:{any(x.isalnum() for x in seen)},{any(unicodedata.category(x) == 'So' for x in seen)},{min(3, len(seen.split()))}"
        for n, (t, one, two, lang, last, fenced) in enumerate(self.rows):
            told = "same" if lang == self.expected else "unknown" if lang is None or self.expected is None else "other"
            f = ["bias", short, shown, f"one:{int(one * 10)}", f"two:{int(two * 10)}", f"one,two:{one >= 0.75},{two >= 0.5},{len(t) >= 2}", f"n:{min(6, len(t) // 3)}", f"none:{not t}", f"place:{min(n, 2)}", f"last:{last}", f"fenced:{fenced}", f"lang:{told}", f"whole:{self.foreign}", f"lang,last:{told},{last}"]
            if last:
                ends = end_shape(self.answer)
                f += ends + [f"{e},{self.foreign}" for e in ends] + [f"endword:{t[-1] if t else ''}"]
            h = np.array([code(x) for x in f], np.int64) % N_SEEN
            if not fenced:
                w = np.array([code(x) for x in t if not _MIXED.search(x)], np.int64)
                if len(w):
                    p = (w[:-1] * 3 + w[1:] * 7) & 0x7FFFFFFFFFFFFFFF
                    skip = (w[:-2] * 5 + w[2:] * 11) & 0x7FFFFFFFFFFFFFFF
                    start = (w[:1] * 13 + (w[1:2] if len(w) > 1 else 0)) & 0x7FFFFFFFFFFFFFFF
                    h = np.concatenate([h, N_SEEN + np.concatenate([w, p, skip, start]) % (N_FEATURES - N_SEEN)])
            out.append(np.unique(h).astype(np.int32))
        return out

    def rule_tags(self) -> list[int]:
        """Labels for fitting."""
        if says_nothing(self.answer):
            return [5] * len(self.rows)
        out, end = [], ending(self.answer)
        for (t, one, two, lang, last, fenced), c in zip(self.rows, self.clauses):
            if not fenced and len(t) >= 2 and one >= 0.75 and two >= 0.5:
                out.append(2)
            elif declines(c):
                out.append(1)
            elif last and end.startswith("open") and not self.foreign:
                out.append(4)
            elif lang and self.expected and lang != self.expected:
                out.append(3)
            else:
                out.append(0)
        return out


_MIXED = re.compile(r"[\d/_.]")


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Sequences:
    """Clauses of many answers in one array; answers in descending order of length, so that those still running at a step come first."""

    def __init__(self, feats: list[list[np.ndarray]]):
        n = np.array([len(f) for f in feats])
        self.order = np.argsort(-n, kind="stable")
        self.n = n[self.order]
        self.start = np.r_[0, np.cumsum(self.n)[:-1]].astype(np.int64)
        flat = [x for i in self.order for x in feats[i]]
        self.size = np.array([len(x) for x in flat])
        self.flat = np.concatenate(flat)
        self.longest = int(self.n[0])
        self.live = [int((self.n > t).sum()) for t in range(self.longest)]

    def scores(self, state: np.ndarray, on: np.ndarray | None = None) -> np.ndarray:
        """Sums of the weights of each clause's features, of those that are on."""
        w = state[self.flat]
        return np.add.reduceat(w if on is None else w * on[:, None], np.r_[0, np.cumsum(self.size)[:-1]])


class Field:
    """A linear-chain conditional random field: weights of (feature, tag), of tag pairs and of first tags."""

    def __init__(self, state: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.state, self.trans, self.start = state, trans, start

    def best(self, feats: list[list[np.ndarray]]) -> list[np.ndarray]:
        """The most likely tags of the clauses of each answer (Viterbi, all answers a step at a time)."""
        q = Sequences(feats)
        s = q.scores(self.state)
        v, back = s[q.start] + self.start, []
        for t in range(1, q.longest):
            k = q.live[t]
            m = v[:k, :, None] + self.trans
            back.append(m.argmax(1))
            v[:k] = m.max(1) + s[q.start[:k] + t]
        tags, cur = np.empty(len(s), np.int64), v.argmax(1)
        for t in range(q.longest - 1, 0, -1):
            k = q.live[t]
            tags[q.start[:k] + t] = cur[:k]
            cur[:k] = back[t - 1][np.arange(k), cur[:k]]
        tags[q.start] = cur
        out: list = [None] * len(feats)
        for i, a, n in zip(q.order, q.start, q.n):
            out[i] = tags[a : a + n]
        return out


def fit_field(rows: list[tuple[list[np.ndarray], list[int]]], seed: int = 3, epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, batch: int = 48, dropped: float = 0.5) -> Field:
    """Maximum likelihood by AdaGrad over small batches; the gradient comes from the forward and backward sums of each sequence.

    In each step a share of the words' features is left out, so that frequent phrases do not outvote what is seen of a clause.
    """
    k = len(TAGS)
    state, trans, start = np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    gs, gt, g0 = np.full((N_FEATURES, k), 1e-2), np.full((k, k), 1e-2), np.full(k, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            q = Sequences([f for f, _ in part])
            want = np.concatenate([np.asarray(part[i][1]) for i in q.order])
            on = (q.flat < N_SEEN) | (rng.random(len(q.flat)) >= dropped)
            s = q.scores(state, on)
            a, b = s.copy(), np.zeros_like(s)
            a[q.start] += start
            for t in range(1, q.longest):
                x = q.start[: q.live[t]] + t
                a[x] = s[x] + _lse(a[x - 1][:, :, None] + trans, 1)
            for t in range(q.longest - 1, 0, -1):
                x = q.start[: q.live[t]] + t
                b[x - 1] = _lse(trans + (s[x] + b[x])[:, None, :], 2)
            z = np.repeat(_lse(a[q.start + q.n - 1], 1), q.n)
            d = -np.exp(a + b - z[:, None])
            d[np.arange(len(want)), want] += 1
            inner = np.setdiff1d(np.arange(len(want)), q.start)
            dt = np.zeros((k, k))
            if len(inner):
                dt -= np.exp(a[inner - 1][:, :, None] + trans + (s[inner] + b[inner])[:, None, :] - z[inner][:, None, None]).sum(0)
                np.add.at(dt, (want[inner - 1], want[inner]), 1)
            u, where = np.unique(q.flat, return_inverse=True)
            wide = np.repeat(d, q.size, axis=0) * on[:, None]
            g = np.stack([np.bincount(where, wide[:, c], len(u)) for c in range(k)], 1) - decay * state[u]
            gs[u] += g * g
            state[u] += rate * g / np.sqrt(gs[u])
            gt += dt * dt
            trans += rate * dt / np.sqrt(gt)
            first = d[q.start].sum(0)
            g0 += first * first
            start += rate * first / np.sqrt(g0)
    state[N_SEEN:] *= 1 - dropped
    return Field(state, trans, start)


def defects(field: Field, pairs: list[tuple[str | None, str | None]], step: int = 512) -> Iterator[tuple[str | None, dict[str, float]]]:
    """(defect or None, share of each tag in the answer's characters) of each (question, answer)."""
    for at in range(0, len(pairs), step):
        seen = [Pair(q, a) for q, a in pairs[at : at + step]]
        for p, tags in zip(seen, field.best([p.features() for p in seen])):
            size = np.array([max(1, len(c.strip())) for c in p.clauses], float)
            share = {t: float(size[tags == n].sum() / size.sum()) for n, t in enumerate(TAGS)}
            yield verdict(share, tags), share


def verdict(share: dict[str, float], tags: np.ndarray) -> str | None:
    """The defect that the coverage by tags shows; clauses that say nothing do not count beside others."""
    told = 1 - share["empty"]
    if told <= 0:
        return "empty"
    rest = told - share["echo"]
    if share["echo"] >= 0.9 * told:
        return "copied_question"
    if share["refusal"] >= 0.8 * rest:
        return "refusal"
    if share["foreign"] > 0.5 * rest:
        return "other_language"
    return "truncated" if tags[tags != TAGS.index("empty")][-1] == TAGS.index("unfinished") else None


def question_answer_pairs(messages: DataFrame) -> DataFrame:
    """(id, session_id, question, answer) of assistant rows that directly follow a user row, in the order of conversations.

    Turns are ordered without their contents; contents are then fetched by the rows' id and a hash of the row: those of questions
    are shuffled twice, those of answers once.
    """
    row = F.xxhash64("id", "session_id", "role", "created_at", "content")
    m = messages.where(F.col("session_id").isNotNull()).select("id", F.col("session_id").cast("string").alias("session_id"), "role", F.col("created_at").cast("timestamp").alias("created_at"), "content")
    text = m.select(F.coalesce("id", F.lit("")).alias("__i"), row.alias("__r"), C.speaker(F.col("role")).alias("speaker"), "content")
    turns = m.select("id", "session_id", C.speaker(F.col("role")).alias("speaker"), "created_at", row.alias("__r"))
    turns = turns.groupBy("id", "session_id", "speaker", "created_at").agg(F.min("__r").alias("__r")).withColumn("sender", F.col("speaker"))
    turns = cut(turns)
    p = C.with_previous(turns, ["speaker", "id", "__r"], C.clock_offsets(turns)).where((F.col("speaker") == "assistant") & (F.col("prev_speaker") == "user"))
    p = p.select("id", "session_id", F.coalesce("id", F.lit("")).alias("__ai"), F.col("__r").alias("__ar"), F.coalesce("prev_id", F.lit("")).alias("__qi"), F.col("prev___r").alias("__qr"))
    of = lambda who, name: text.where(F.col("speaker") == who).select("__i", "__r", F.col("content").alias(name)).dropDuplicates(["__i", "__r"])
    q = of("user", "question").withColumnsRenamed({"__i": "__qi", "__r": "__qr"})
    a = of("assistant", "answer").withColumnsRenamed({"__i": "__ai", "__r": "__ar"})
    return p.join(q, ["__qi", "__qr"]).join(a, ["__ai", "__ar"]).select("id", "session_id", "question", "answer")


def train(pairs: DataFrame, most: int = 9000, most_clauses: int = 40) -> Field:
    """A field fitted on about `most` pairs (at most 1.2 times as many), chosen by a hash, of each the last most_clauses clauses, and on the seeds.

    Features are computed where the pairs are; the limit after that only takes effect where many rows have the same id.
    """
    n = pairs.count()
    share = int(np.ceil(1_000_000 * min(1.0, most / max(1, n))))
    d = pairs.where(F.pmod(F.xxhash64("id", "session_id"), F.lit(1_000_000)) < share).select("question", "answer")

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q, a in zip(pdf["question"], pdf["answer"]):
                p = Pair(q, a)
                rows.append(([x.tobytes() for x in p.features()[-most_clauses:]], p.rule_tags()[-most_clauses:]))
            yield pd.DataFrame(rows, columns=["f", "t"])

    got = d.mapInPandas(label, "f array<binary>, t array<int>").limit(int(1.2 * most)).toPandas()
    rows = [([np.frombuffer(x, np.int32) for x in f], [int(x) for x in t]) for f, t in zip(got["f"], got["t"])]
    for text, tag in [*((f, 5) for f in sorted(FILLERS)), *((s, 1) for s in SEED_REFUSALS), (None, 5), ("---", 5)]:
        f = Pair(None, text).features()
        rows.append((f, [tag] * len(f)))
    return fit_field(rows)


def defective_pairs(messages: DataFrame, most: int = 9000) -> DataFrame:
    """(id, defect, and the tags' shares) of the answers that are defective.

    messages needs id, session_id, role, content, created_at. Repeated rows count once; rows without a session are no pairs; a
    null answer is empty; a null question is echoed by nothing and in no language. Whole answers are read. Pairs come from the
    distributed order of conversations, so that no session is held by one task. An empty table gives no rows.
    """
    pairs = cut(question_answer_pairs(messages))
    f = train(pairs, most)
    shared = messages.sparkSession.sparkContext.broadcast((f.state.astype(np.float32), f.trans.astype(np.float32), f.start.astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field(*shared.value)
        text = lambda x: x if isinstance(x, str) else None
        for pdf in batches:
            both = [(text(q), text(a)) for q, a in zip(pdf["question"], pdf["answer"])]
            rows = [(i, d, *(s[t] for t in TAGS)) for i, (d, s) in zip(pdf["id"], defects(field, both)) if d]
            yield pd.DataFrame(rows, columns=["id", "defect", *TAGS])

    return pairs.mapInPandas(run, "id string, defect string, " + ", ".join(f"{t} double" for t in TAGS))
