"""Abusive, hateful and sexual text by compression distance.

Texts are freed of disguises and cut into windows of a sentence. Two zstandard dictionaries are made, of ordinary and of toxic
windows; a window's score is the number of bytes that it takes less under the toxic one. The toxic windows of documents that
raters called toxic are those which the ordinary dictionary compresses worse than nearly all windows of clean documents. The
threshold is calibrated on documents that had no part in the dictionaries it is calibrated with.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut

#: Letters of other scripts that look like Latin ones; fixed values.
LOOKALIKES = dict(zip("абвгдеёзийкмнопрстухьъіїјѕһԁԛԝαβγεηικνορτυχω", "a6brdee3nnkmhonpctyxbbiijshdqwabyenikvoptuxw")) | {"в": "b", "н": "h", "п": "n", "г": "r", "ß": "ss", "ı": "i", "ł": "l", "ø": "o"}
#: Digits and signs that stand for letters within words; fixed values.
LEET = str.maketrans("0134578@$!|", "oieastbasil")
#: General examples, so that there are dictionaries before there are labels; fixed values.
SEED_TOXIC = (
    "you are an idiot", "you are a stupid moron", "you are worthless and pathetic", "what a useless loser", "shut up, you clown", "shut your mouth", "get lost, you jerk", "go to hell", "drop dead", "i hope you die",
    "go kill yourself", "i will find you and hurt you", "i will break your legs", "i know where you live", "you piece of shit", "you piece of trash", "you asshole", "you bastard", "fuck you", "you disgusting pig",
    "nobody likes you", "you should be fired, you imbecile", "they are vermin", "they are subhuman", "they are parasites and criminals by birth", "they are a disease and must be wiped out", "send them back home", "women are too stupid for this", "do not let these people in",
    "send me nude pictures", "i want to fuck you", "let us have sex in my bed", "show me your boobs", "want to see my dick", "free porn and naked girls",
    "du bist ein idiot", "halt die fresse", "du arschloch", "verpiss dich", "schick mir nacktbilder", "das sind alles untermenschen", "eres un idiota", "cállate, imbécil", "vete a la mierda", "pedazo de basura", "mándame fotos desnuda", "son una plaga",
    "tu es un crétin", "ferme ta gueule", "va te faire foutre", "envoie-moi des photos nue", "ces gens sont de la vermine", "você é um idiota", "cala a boca", "vai se foder", "me manda fotos pelada", "são uma praga",
)
SEED_ORDINARY = (
    "kill the child process before the parent exits", "the process was killed by the system", "abort the transaction and drop the table", "a dead lock", "dead code was removed", "the master and the slave database", "a naked pointer leaks memory", "the garbage collector frees it",
    "this damn bug took hours", "what a crap default", "a stupid mistake in the loop", "the dumb version is faster", "an ugly hack", "the word list of the filter has insults such as idiot", "a user was reported for insults", "the rules forbid hate speech, threats and sexual content",
    "the score says whether a comment is toxic", "the column sex has one letter", "strip the string and dump the rest", "penetration test", "male and female connectors", "the trash folder is emptied", "inject the dependency", "dependency hell", "execute the orphan task", "blow up the stack",
)
CODE = re.compile(r"`[^`\n]{1,200}`|(?<![\w/])[\w.\-]+(?:/[\w.\-]+)+|\bhttps?://\S+|\b[A-Za-z]+_\w+|\b(?=\w*[a-z]{2})[A-Z][a-z]+[A-Z]\w*")
#: Single letters joined by '_': a disguise, no name of code.
UNDERSCORED = re.compile(r"(?<![^\W_])[^\W\d_](?:_[^\W\d_])+(?![^\W_])")
#: Letters set apart by one kind of sign.
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:(?:-[^\W\d_])+|(?:\.[^\W\d_])+(?:\.(?=\s+[^\W\d_]))?|(?:_[^\W\d_])+|(?: [^\W\d_]){2,})(?![^\W_])")
LEETED = re.compile(r"(?<![\w@$!|])(?=[^\W\d_]*[\d@$!|])(?=[\d@$!|_]*[^\W\d_])[\w@$!|]+")
FORMAT = dict.fromkeys(c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf")
FOREIGN_LETTER = re.compile("[Ͱ-ӿԀ-ԯ]")
FOREIGN = re.compile(r"(?<![^\W\d_])[^\W\d_]*[Ͱ-ӿԀ-ԯ][^\W\d_]*")
LATIN = [(k, v) for k, v in LOOKALIKES.items() if ord(k) < 0x370]
ODD_LATIN = re.compile("[" + "".join(k for k, _ in LATIN) + "]")
#: Three letters, or two, with anything between.
THREE, TWO = (re.compile(r"[^\W\d_][\W\d_]*" * (n - 1) + r"[^\W\d_]") for n in (3, 2))
REPEATED = re.compile(r"([^\W\d_]|\*)\1+")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\s*[\r\n]+\s*")


#: Words of letters alone, set apart by blanks in backticks or by slashes: speech that is dressed up as code.
SPEECH = re.compile(r"`?[^\W\d_]+(?:[ ,!?']+[^\W\d_]+)+[.!?]*`?|[^\W\d_A-Z]+(?:/[^\W\d_A-Z]+)+")


def _mask(m: re.Match) -> str:
    """§ for a name of code; what is speech is kept, its slashes as blanks."""
    return f" {m[0].strip('`').replace('/', ' ')} " if SPEECH.fullmatch(m[0]) else "§"


def _latin(m: re.Match) -> str:
    w = m[0]
    return "".join(LOOKALIKES.get(c, c) for c in w) if re.search("[a-z]", w) or all(c in LOOKALIKES for c in w) else w


def _unleet(m: re.Match) -> str:
    w = m[0].rstrip("!|")
    return w.translate(LEET) + m[0][len(w) :]


def plain(text: str) -> str:
    """text in lower case, without disguises and with names of code and numbers masked."""
    latin = text.isascii()
    t = text if latin else unicodedata.normalize("NFKC", text).translate(FORMAT)
    t = CODE.sub(_mask, UNDERSCORED.sub(lambda m: m[0].replace("_", ""), t)).lower()
    if not latin:
        t = FOREIGN.sub(_latin, t) if FOREIGN_LETTER.search(t) else t
        for k, v in LATIN if ODD_LATIN.search(t) else ():
            t = t.replace(k, v)
    t = SPACED.sub(lambda m: re.sub(r"[\W_]", "", m[0]), t.replace("- -", " "))
    t = LEETED.sub(_unleet, re.sub(r"(?<!\S)@", "@ ", t))
    if not latin:
        t = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", t))
    return re.sub(r"\d+", "0", REPEATED.sub(r"\1", t))


def windows(text: str, size: int = 64) -> list[str]:
    """The sentences and lines of the whole text, plain; those longer than size in parts that overlap by half. One letter, or two Latin ones, say nothing."""
    out = []
    for s in SENTENCE.split(plain(text)):
        s = " ".join(s.split()).strip(" -*>#:.!?")
        if not (THREE if s.isascii() else TWO).search(s):
            continue
        out.append(s[:size])
        for i in range(size // 2, len(s) - size // 2, size // 2):
            out.append(s[i : i + size])
    return out


class Dictionary:
    """A zstandard dictionary of given windows."""

    def __init__(self, content: list[str], level: int = 12):
        self.content = content
        self.data = ("\n".join(content) or "\n" * 8).encode().ljust(8, b"\n")
        d = zstandard.ZstdCompressionDict(self.data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(self.data), source_size=256, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.c = zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def size(self, w: str) -> int:
        return len(self.c.compress(w.encode()))


def train_dictionary(samples: Iterable[str], seed: Iterable[str], budget: int, rounds: int = 4) -> Dictionary:
    """A dictionary of at most budget bytes: in each round, the samples that the dictionary so far compresses worst are added, each kind once."""
    left = sorted(set(samples), key=lambda s: xxhash.xxh64_intdigest(s))
    content = [plain(s) for s in seed]
    d = Dictionary(content)
    for r in range(rounds):
        room = budget * (r + 1) // rounds - len(d.data)
        if not left or room <= 0:
            continue
        cost = {s: d.size(s) / (len(s) + 12) for s in left}
        left.sort(key=lambda s: -cost[s])
        take, used, seen = [], 0, set()
        for s in left:
            key = frozenset(s.split())
            if used + len(s.encode()) + 1 > room:
                break
            if key not in seen:
                seen.add(key)
                take.append(s)
                used += len(s.encode()) + 1
        content = take + content  # zstandard finds the end of a dictionary at least cost
        d, taken = Dictionary(content), set(take)
        left = [s for s in left if s not in taken]
    return d


@dataclass
class Model:
    ordinary: Dictionary
    toxic: Dictionary
    threshold: float = 6.0

    def score(self, w: str) -> float:
        """Bytes saved by the toxic dictionary; short windows, which have less to save, count up to twice."""
        return (self.ordinary.size(w) - self.toxic.size(w)) * 40 / min(40, max(20, len(w)))


WORD = re.compile(r"[^\W\d_]*\*[^\W\d_]*|[^\W\d_]{2,}")


def word_pairs(window: str) -> set[tuple[str, str]]:
    """Neighbouring words of a window; names of code part their neighbours."""
    return {p for part in window.split("§") for w in [WORD.findall(part)] for p in zip(w, w[1:])}


@dataclass(frozen=True)
class Common:
    """Words and pairs of words that are frequent in the whole collection and so tell nothing."""

    words: frozenset = frozenset()
    pairs: frozenset = frozenset()

    def stock_phrase(self, window: str) -> bool:
        """Whether more than half of a window's pairs of words are frequent."""
        p = word_pairs(window)
        return 2 * len(p & self.pairs) > len(p)


def telling_words(clean: list[list[str]], toxic: list[list[str]], least: int, common: Common = Common()) -> set[str]:
    """Words that at least `least` toxic documents have, and of the documents that have them more than half (scaled to equal numbers: four fifths) are toxic."""
    df = [{}, {}]
    for k, docs in enumerate((clean, toxic)):
        for d in docs:
            for w in {x for s in d for x in WORD.findall(s)}:
                df[k][w] = df[k].get(w, 0) + 1
    odds = max(1.0, len(clean)) / max(1.0, len(toxic))
    return {w for w, n in df[1].items() if w not in common.words and n >= least and n > df[0].get(w, 0) and n * odds >= 4 * df[0].get(w, 0)}


def near_shares(candidates: set[str], docs: list[tuple[int, list[str]]], similarity: float = 0.4) -> dict[str, tuple[int, int]]:
    """Of each candidate window: the numbers of clean (0) and of toxic (1) documents with a window of similar words (Jaccard index)."""
    words = lambda w: frozenset(re.findall(r"[^\W\d_]+|§|\w*\*\w*", w))
    owners: dict[frozenset, set[int]] = {}
    for i, (_, ws) in enumerate(docs):
        for w in ws:
            owners.setdefault(words(w), set()).add(i)
    seen: dict[str, int] = {}
    for k in owners:
        for x in k:
            seen[x] = seen.get(x, 0) + 1
    # sets this similar share one of their rarest words: as many as may be missing from the other, and one more
    rarest = lambda k: sorted(k, key=lambda x: (seen.get(x, 0), x))[: len(k) - math.ceil(similarity * len(k)) + 1]
    index: dict[str, list[frozenset]] = {}
    for k in owners:
        for x in rarest(k):
            index.setdefault(x, []).append(k)
    out = {}
    for w in candidates:
        k = words(w)
        near, n = {k} & owners.keys(), len(k)
        for o in {o for x in rarest(k) for o in index.get(x, ()) if similarity * n <= len(o) <= n / similarity}:
            both = len(k & o)
            if both >= similarity * (n + len(o) - both):
                near.add(o)
        ids = set().union(*(owners[o] for o in near)) if near else set()
        bad = sum(docs[i][0] for i in ids)
        out[w] = (len(ids) - bad, bad)
    return out


def fit_once(clean: list[list[str]], toxic: list[list[str]], budget: int, common: Common = Common()) -> Model:
    """Dictionaries from the windows of documents called clean and toxic.

    Toxic documents hold ordinary windows too, and some documents are wrongly labelled. Windows of toxic documents count as toxic
    if they have a word that stands mostly in toxic documents, windows of similar words do too, and they are no stock phrase of the whole collection; windows of clean documents
    with such a word, whose like stands mostly in toxic documents, are left out as wrongly labelled.
    """
    has = lambda w, words: not words.isdisjoint(WORD.findall(w))
    once, often = telling_words(clean, toxic, 1, common), telling_words(clean, toxic, 2, common)
    bad = {w for d in toxic for w in d if has(w, once) and not common.stock_phrase(w)}
    doubtful = {w for d in clean for w in d if has(w, often)}
    near = near_shares(bad | doubtful, [(0, d) for d in clean] + [(1, d) for d in toxic])
    odds = max(1, len(clean)) / max(1, len(toxic))
    wrong = {w for w in doubtful if near[w][1] * odds > near[w][0]}
    good = {w for d in clean for w in d if w not in wrong} | {w for d in toxic for w in d if not has(w, once)}
    bad = {w for w in bad if near[w][1] * odds >= 4 * near[w][0]}
    m = Model(train_dictionary(good, SEED_ORDINARY, budget), train_dictionary(bad, SEED_TOXIC, budget))
    # ordinary windows that look toxic to this pair go into the ordinary dictionary as well
    hard, used, seen = [], 0, set()
    for score, w in sorted(((m.score(w), w) for w in good), reverse=True):
        if score < 4 or used > budget // 3:
            break
        if (key := frozenset(w.split())) not in seen:
            seen.add(key)
            hard.append(w)
            used += len(w.encode()) + 1
    return Model(Dictionary(m.ordinary.content + hard[::-1]), m.toxic)


def fit(docs: list[tuple[int, bool, list[str]]], common: Common = Common(), budget: int = 110_000) -> Model:
    """docs: (doc_id, toxic, windows); common: what is frequent in the whole collection. The threshold is that of the best F1 over documents, from dictionaries of the other half."""
    docs = sorted(docs, key=lambda d: xxhash.xxh64_intdigest(str(d[0])))
    split = lambda ds: ([w for _, t, w in ds if not t], [w for _, t, w in ds if t])
    scored: list[tuple[float, bool]] = []
    for fold in (0, 1):
        rest, held = [d for i, d in enumerate(docs) if i % 2 != fold], [d for i, d in enumerate(docs) if i % 2 == fold]
        m = fit_once(*split(rest), budget, common)
        scored += [(max([m.score(w) for w in ws], default=-99), t) for _, t, ws in held]
    model = fit_once(*split(docs), budget, common)
    best, positives = (0.0, 12.0), sum(t for _, t in scored)
    for th in range(8, 26):
        tp = sum(t for s, t in scored if s >= th)
        n = sum(s >= th for s, _ in scored)
        if n and positives:
            best = max(best, (2 * tp / (n + positives) + 1e-9 * th, float(th)))
    model.threshold = best[1]
    return model


TOXIC = ("abusive", "hateful", "sexual")


def labelled(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic) by the majority of raters; ties and missing labels are left out. At most `most` documents, chosen by a hash."""
    l = F.lower(F.trim("label"))
    v = labels.where(F.col("doc_id").isNotNull() & l.isin("clean", *TOXIC)).select("doc_id", "annotator", l.isin(*TOXIC).cast("int").alias("t")).distinct()
    v = v.groupBy("doc_id").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")).where("2 * t <> n")
    return v.select("doc_id", (F.col("t") * 2 > F.col("n")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(documents: DataFrame, labels: DataFrame, most_docs: int = 8000) -> Model:
    """A model from all windows of at most most_docs labelled documents (chosen by a hash). No labels: the seeds alone."""
    ids = cut(labelled(labels, most_docs))
    d = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most most_docs rows of two numbers

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ws = [sorted(set(windows(t)), key=xxhash.xxh64_intdigest) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "ws": ws})

    rows = d.mapInPandas(cut_up, "doc_id long, toxic boolean, ws array<string>").toPandas()
    docs = [(int(i), bool(t), list(w)) for i, t, w in zip(rows["doc_id"], rows["toxic"], rows["ws"])]
    return fit(docs, tells_nothing(docs, *counts(documents, docs)))


def _asked(docs: list[tuple[int, bool, list[str]]]) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """In how many toxic documents each of their words, and each of their pairs of words, stands."""
    words: dict[str, int] = {}
    pairs: dict[tuple[str, str], int] = {}
    for _, toxic, ws in docs:
        for x in {x for w in ws for x in WORD.findall(w)} if toxic else ():
            words[x] = words.get(x, 0) + 1
        for p in {p for w in ws for p in word_pairs(w)} if toxic else ():
            pairs[p] = pairs.get(p, 0) + 1
    return words, pairs


def tells_nothing(docs: list[tuple[int, bool, list[str]]], total: int, n_words: dict[str, int], n_pairs: dict[tuple[str, str], int]) -> Common:
    """What is too frequent in the whole collection to stand in toxic documents alone. total, n_words, n_pairs: all documents, and those with each word and pair.

    A word of toxic documents alone has, of all documents, hardly a larger share than of the labelled ones; the fewer toxic ones there
    are, the less their shares of a word are trusted. Its share of all documents is that of the toxic ones times the rate of toxic
    documents; the words of the lowest such ratio so give that rate, and words and pairs within 2.5 times of what the rate lets expect are kept.
    """
    words, pairs = _asked(docs)
    n_toxic = sum(t for _, t, _ in docs)
    if not n_toxic or not total:
        return Common()
    ratios = sorted(n_words[w] / total * n_toxic / n for w, n in words.items() if n_words.get(w))
    rate = ratios[len(ratios) // 10] if ratios else 0.0
    often = frozenset(w for w, n in words.items() if n_words.get(w, 0) > max(3, total * max(0.004, 1.5 * at_least(n, n_toxic) * n_toxic / len(docs), 2.5 * rate * n / n_toxic)))
    return Common(often, frozenset(p for p, n in pairs.items() if n_pairs.get(p, 0) > max(3, total * max(0.002, 2.5 * rate * n / n_toxic))))


def at_least(n: int, total: int, z: float = 1.28) -> float:
    """The share that n of total stand for at least, with a certainty of nine tenths (Wilson's lower bound)."""
    p = n / total
    return (p + z * z / (2 * total) - z * math.sqrt(p * (1 - p) / total + (z / (2 * total)) ** 2)) / (1 + z * z / total)


def rough_words(text: str) -> list[str]:
    """The words of text as plain() spells them, without the search for disguises: enough to count frequent ones."""
    t = text.lower()
    if not t.isascii():
        t = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", t))
    return WORD.findall(REPEATED.sub(r"\1", t))


def counts(documents: DataFrame, docs: list[tuple[int, bool, list[str]]]) -> tuple[int, dict[str, int], dict[tuple[str, str], int]]:
    """(all documents, of those the number with each word, and with each pair of words, that stands in toxic ones of docs); over whole texts, added up per task first."""
    words, pairs = _asked(docs)
    shared = documents.sparkSession.sparkContext.broadcast((frozenset(words), frozenset(pairs)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, asked_pairs = shared.value
        n, total = {}, 0
        for pdf in batches:
            for t in pdf["text"]:
                total += 1
                ws = rough_words(t) if t else []
                for w in asked.intersection(ws):
                    n[w] = n.get(w, 0) + 1
                for p in asked_pairs.intersection(zip(ws, ws[1:])):
                    n[p] = n.get(p, 0) + 1
        yield pd.DataFrame([("", total), *((" ".join(k) if isinstance(k, tuple) else k, v) for k, v in n.items())], columns=["word", "n"])

    rows = dict(documents.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n")).collect())
    total = int(rows.pop("", 0))
    return total, {w: n for w, n in rows.items() if " " not in w}, {tuple(w.split(" ")): n for w, n in rows.items() if " " in w}


_models: dict[int, Model] = {}


def score_documents(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep columns, score (most bytes saved by a window; 0 without windows), toxic (score at least the threshold) and that window, plain.

    Every document comes out once, scored over its whole text; null and empty texts score 0. No shuffle.
    """
    content = (model.ordinary.content, model.toxic.content, model.threshold)
    shared, key = documents.sparkSession.sparkContext.broadcast(content), xxhash.xxh64_intdigest(repr(content))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _models:
            o, t, th = shared.value
            _models.clear()
            _models[key] = Model(Dictionary(o), Dictionary(t), th)
        m, memo = _models[key], {}
        for pdf in batches:
            best = []
            for text in pdf["__text"]:
                top = (0.0, None)
                for w in windows(text) if text else ():
                    if (v := memo.get(w)) is None:
                        if len(memo) > 50_000:
                            memo.clear()
                        v = memo[w] = m.score(w)
                    if v > top[0]:
                        top = (v, w)
                best.append(top)
            out = pdf[list(keep)].copy()
            out["score"] = [b[0] for b in best]
            out["toxic"] = [b[0] >= m.threshold for b in best]
            out["window"] = [b[1] for b in best]
            yield out

    types = dict(documents.dtypes)
    d = documents.select(*keep, F.col("text").alias("__text"))
    return d.mapInPandas(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score double", "toxic boolean", "window string"]))


def rates(scored: DataFrame) -> DataFrame:
    """Per source (spellings put together): documents, toxic ones and their share."""
    s = F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_")
    g = scored.groupBy(s.alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("toxic").cast("long")).alias("n_toxic"))
    return g.withColumn("rate", F.round(F.col("n_toxic") / F.col("n_docs"), 6))
